"""Language identification by rank-order statistics (Cavnar and Trenkle, 1994).

A text's n-grams of 1 to 3 characters (words of lower-case letters between blanks) are ranked by
frequency; the same is done for each language over its labelled texts. The out-of-place distance
of a text to a language sums, over the text's `profile` most frequent n-grams, how far each is
from its place in the language's profile, or `profile` where it isn't in it. The nearest
language wins. Ties in frequency go by n-gram, ties in distance by the language's name.

Training counts cover every labelled text of the learning folds; they are summed per language and
n-gram and only the profiles (`profile` n-grams a language) reach the driver.

Defined results: `und` with score 0 for a null text or one without letters, and for every text
where no language was learned; very long texts are counted whole; score is 1 - distance / largest
possible distance; columns of any name pass `predict`. Null languages are not learned from. A language holding a third of all rows is
no hot key: counts are summed per task before the shuffle.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_row, fold, strings

PROFILE = 300


@lru_cache(1)
def _folded() -> np.ndarray:
    """Code point of the lower-case letter, or 0 for what is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for x in range(0x110000):
        c = chr(x)
        if c.isalpha():
            low = c.lower()
            out[x] = ord(low) if len(low) == 1 else x
    return out


def grams(text: str) -> np.ndarray:
    """Codes of all n-grams of a text: three code points of 21 bits, 0 for none, 1 for a blank."""
    x = _folded()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not x.any():
        return np.empty(0, np.int64)
    x = np.concatenate(([0], x, [0])).astype(np.int64)
    x = x[np.concatenate(([True], (x[1:] != 0) | (x[:-1] != 0)))]  # one blank between words
    x[x == 0] = 1
    two = (x[:-1] << 21) | x[1:]
    three = (two[:-1] << 21) | x[2:]
    mid = x[1:-1] != 1  # blanks only at an end
    return np.concatenate((x[x != 1], two, three[mid]))


def ranked(codes: np.ndarray, most: int) -> np.ndarray:
    """The most frequent codes, ties by code."""
    codes = np.sort(codes)
    at = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    n = np.diff(np.concatenate((at, [len(codes)])))
    if len(at) > most:
        least = np.partition(n, len(n) - most)[len(n) - most]
        keep = n >= least
        at, n = at[keep], n[keep]
    return codes[at[np.argsort(-n, kind="stable")[:most]]]


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", profile: int = PROFILE) -> dict[str, list[int]]:
    """The profile of each language, from all rows of `df` whose text and language aren't null."""

    def count(batches):
        for batch in batches:
            by: dict[str, list[np.ndarray]] = {}
            size = 0
            for lang, text in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True):
                by.setdefault(lang, []).append(g := grams(text))
                size += len(g)
                if size > 4_000_000:
                    yield from summed(by)
                    by, size = {}, 0
            yield from summed(by)

    def summed(by):
        for lang, parts in by.items():
            codes, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    counts = df.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = W.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= profile).collect()
    out: dict[str, list[int]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r["rank"])):
        out.setdefault(r.lang, []).append(r.gram)
    return out


class Profiles:
    """All profiles as one sorted table of n-grams, each with its place in every language."""

    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE):
        self.langs, self.size = sorted(profiles), size
        self.codes = np.unique(np.array([g for own in profiles.values() for g in own], np.int64))
        self.place = np.full((len(self.langs), len(self.codes)), -1, np.int64)
        for k, lang in enumerate(self.langs):
            self.place[k, np.searchsorted(self.codes, profiles[lang])] = np.arange(len(profiles[lang]))

    def predict(self, text: str) -> tuple[str, float]:
        codes = grams(text) if text else ()
        if not len(codes) or not self.langs:
            return "und", 0.0
        top = ranked(codes, self.size)
        at = np.minimum(np.searchsorted(self.codes, top), len(self.codes) - 1)
        place = np.where(self.codes[at] == top, self.place[:, at], -1)
        distance = np.where(place >= 0, np.abs(place - np.arange(len(top))), self.size).sum(axis=1)
        k = int(distance.argmin())
        return self.langs[k], float(1 - distance[k] / (self.size * len(top)))


def predict(df: DataFrame, profiles: dict[str, list[int]], text_col: str = "text", profile: int = PROFILE) -> DataFrame:
    """(row, lang_pred, score): `row` is a struct of all columns of `df`, so none can clash."""
    known = Profiles(profiles, profile)
    frame = df.select(as_row(df).alias("row"), F.col(text_col).alias("text"))
    schema = frame.drop("text").schema.add("lang_pred", "string").add("score", "double")

    def run(batches):
        for batch in batches:
            got = [known.predict(x) for x in strings(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], names=["row", "lang_pred", "score"])

    return frame.mapInArrow(run, schema)


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the texts of the folds 0 and 2 of 3."""
    known = train(df.where(fold(id_col, 3) != 1), text_col, lang_col)
    frame = df.select(F.col(id_col).cast("long").alias("doc_id"), (fold(id_col, 3) == 1).alias("held_out"), F.col(text_col).alias("text"))
    return predict(frame, known).select("row.doc_id", "row.held_out", "lang_pred", "score")

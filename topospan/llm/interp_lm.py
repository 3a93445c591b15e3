"""Language-model scores by deleted interpolation of n-gram estimates (Jelinek and Mercer, 1980).

Model: P(w | v) = l2[b] c(v,w)/c(v) + l1[b] c(w)/N + l0[b] /(V+1), with maximum-likelihood
estimates from the training texts; b is the bucket of the context's frequency c(v) (powers of
two). A text is its words and one end token, which is also the context of its first word, so a
token's count is its count as a context too. The weights of each bucket come from expectation
maximisation on held-out counts: training texts are split in two halves by a hash of the text, each
half is deleted in turn, and its tokens are predicted from the counts of the other.

Shape of the job. Counts of words and pairs are too many to broadcast and joining each of a
corpus's tokens by a shuffle is dear, so texts are packed into blocks of about `block_tokens`
tokens: a block holds its distinct words (64-bit hashes), its distinct pairs with local counts of
both halves, and each text as sorted indices of pairs. Blocks are written once, bucketed by block.
Each block sends its distinct keys, sorted, to shards of the key space (their number follows from
the number of keys, so no shard grows with the data); a shard adds the counts and answers every
block in the order of its keys. Answers join the blocks, which stay where they are. Held-out
events, gathered as a histogram of (bucket, estimates in steps of 1/4 octave), are the only thing
collected: at most 40 x 252 x 252 rows. Scores are exact under the model, not histogrammed.

Defined results: a null or empty text is one end token; whole texts are scored; repeated rows count
as often as they stand; a null id counts as the empty text for its fold; with no training text the
model is uniform and the base score is 0.
"""

from __future__ import annotations

import uuid
import zlib
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, fold, written

BLOCK_TOKENS = 1_200_000
SHARD_KEYS = 600_000
ROUNDS = 60
_LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
_END = b""  # no word is empty
_BUCKETS = 40


def put(x: np.ndarray) -> bytes:
    """An integer array by planes of bytes, compressed."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), 1) if len(x) else b""


def get(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(size, -1).T).view(kind).ravel() if raw else np.empty(0, kind)


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit keys of pairs of word hashes."""
    with np.errstate(over="ignore"):
        x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ ((b + np.uint64(0x165667B19E3779F9)) * np.uint64(0xC2B2AE3D27D4EB4F))
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


class Block:
    """Texts being packed."""

    def __init__(self):
        self.words: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.end = self.words[_END]
        self.codes: list[np.ndarray] = []
        self.ids, self.halves, self.n = [], [], 0

    def add(self, key, half: int, text: str | None) -> None:
        """half: 0 or 1 of the training texts, -1 of texts that are held out."""
        words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
        codes = np.fromiter(map(self.words.__getitem__, words), np.int32, len(words))
        self.codes.append(np.concatenate((codes, [self.end])).astype(np.int32))
        self.ids.append(key)
        self.halves.append(half)
        self.n += len(words) + 1

    def row(self, block: int) -> dict:
        lengths = np.array(list(map(len, self.codes)))
        tokens = np.concatenate(self.codes)
        before = np.concatenate(([self.end], tokens[:-1]))
        v = len(self.words)
        local = before.astype(np.int64) * v + tokens
        pairs, at = np.unique(local, return_inverse=True)
        half = np.repeat(np.array(self.halves), lengths)
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        order = np.lexsort((at, np.repeat(np.arange(len(lengths)), lengths)))
        steps = np.diff(at[order], prepend=0)
        steps[starts] = at[order][starts]
        by_half = [np.bincount(at[half == h], minlength=len(pairs)).astype(np.uint32) for h in (0, 1)]
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, v)
        return {"block": block, "n_keys": len(pairs) + v, "ids": self.ids, "held": [h < 0 for h in self.halves], "lengths": lengths.tolist(), "hashes": hashes.tobytes(), "fan": put(np.bincount(pairs // v, minlength=v).astype(np.uint32)), "second": put((pairs % v).astype(np.uint32)), "c0": put(by_half[0]), "c1": put(by_half[1]), "steps": put(steps.astype(np.uint32))}


BLOCKS = "block long, n_keys long, ids array<long>, held array<boolean>, lengths array<long>, hashes binary, fan binary, second binary, c0 binary, c1 binary, steps binary"
_BLOCKS = pa.schema([("block", pa.int64()), ("n_keys", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int64())), *((k, pa.binary()) for k in ("hashes", "fan", "second", "c0", "c1", "steps"))])


def blocks(df: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of (doc_id, held, text)."""

    def run(batches):
        part, seq = TaskContext.get().partitionId(), count()
        own = Block()
        for batch in batches:
            for key, held, text in zip(*batch.columns, strict=True):
                text = text.as_py()
                half = -1 if held.as_py() else zlib.crc32((text or "").encode("utf-8", "surrogatepass")) & 1
                own.add(key.as_py(), half, text)
                if own.n >= block_tokens:
                    yield pa.RecordBatch.from_pylist([own.row((part << 24) + next(seq))], _BLOCKS)
                    own = Block()
        if own.n:
            yield pa.RecordBatch.from_pylist([own.row((part << 24) + next(seq))], _BLOCKS)

    return df.mapInArrow(run, BLOCKS)


def unpacked(r: dict):
    """hashes, first and second word of each pair, local counts of both halves (words' too), keys in sorted order."""
    hashes = np.frombuffer(r["hashes"], np.uint64)
    first = np.repeat(np.arange(len(hashes)), get(r["fan"], np.uint32))
    second = get(r["second"], np.uint32)
    keys = np.concatenate((pair_keys(hashes[first], hashes[second]), pair_keys(hashes, hashes * np.uint64(3) + np.uint64(1))))
    counts = []
    for h in ("c0", "c1"):
        c = get(r[h], np.uint32)
        counts.append(np.concatenate((c, np.bincount(second, weights=c, minlength=len(hashes)).astype(np.uint32))))
    return hashes, first, second, counts, keys, np.argsort(keys)


ANSWERS = "block long, shard int, answer binary, half0 long, half1 long, words long"


def totals(table: DataFrame, shards: int) -> DataFrame:
    """The counts of every block's keys over the corpus; with block -1 each shard's tokens and distinct words."""

    def ask(batches):
        for batch in batches:
            for r in batch.to_pylist():
                hashes, _, _, (c0, c1), keys, order = unpacked(r)
                keys, is_word = keys[order], (order >= len(keys) - len(hashes))
                c0, c1 = c0[order], c1[order]
                of = np.searchsorted(keys, (np.arange(1, shards, dtype=np.float64) * (2.0**64 / shards)).astype(np.uint64))
                cuts = [0, *of.tolist(), len(keys)]
                rows = []
                for s in range(shards):
                    a, b = cuts[s], cuts[s + 1]
                    if a < b:
                        rows.append({"block": r["block"], "shard": s, "keys": put(np.diff(keys[a:b], prepend=np.uint64(0))), "c0": put(c0[a:b]), "c1": put(c1[a:b]), "is_word": zstandard.compress(np.packbits(is_word[a:b]).tobytes(), 1)})
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("block", pa.int64()), ("shard", pa.int32()), *((k, pa.binary()) for k in ("keys", "c0", "c1", "is_word"))]))

    def answer(own):
        parts = [np.cumsum(get(x, np.uint64), dtype=np.uint64) for x in own["keys"]]
        known, at = np.unique(np.concatenate(parts), return_inverse=True)
        sums = [np.bincount(at, weights=np.concatenate([get(x, np.uint32) for x in own[h]]), minlength=len(known)).astype(np.uint32) for h in ("c0", "c1")]
        word = np.zeros(len(known), bool)
        word[at[np.concatenate([np.unpackbits(np.frombuffer(zstandard.decompress(x), np.uint8), count=len(p)).astype(bool) for x, p in zip(own["is_word"], parts, strict=True)])]] = True
        both = sums[0].astype(np.int64) + sums[1]
        rows, start = [], 0
        shard = int(own["shard"].iloc[0])
        for block, p in zip(own["block"], parts, strict=True):
            mine = at[start : start + len(p)]
            start += len(p)
            rows.append((int(block), shard, put(np.concatenate((sums[0][mine], sums[1][mine]))), 0, 0, 0))
        rows.append((-1, shard, b"", *(int(sums[h][word].sum(dtype=np.int64)) for h in (0, 1)), int((both[word] > 0).sum())))
        return pd.DataFrame(rows, columns=["block", "shard", "answer", "half0", "half1", "words"])

    import pandas as pd

    return table.mapInArrow(ask, "block long, shard int, keys binary, c0 binary, c1 binary, is_word binary").groupBy("shard").applyInPandas(answer, ANSWERS)


def _global(r: dict):
    """first, second, local counts by half, and global counts of pairs and words by half."""
    hashes, first, second, counts, keys, order = unpacked(r)
    n = len(keys)
    got = np.empty((2, n), np.uint32)
    at = 0
    for a in sorted(r["answers"], key=lambda a: a["shard"]):
        x = get(a["answer"], np.uint32).reshape(2, -1)
        got[:, order[at : at + x.shape[1]]] = x
        at += x.shape[1]
    if at != n:
        raise ValueError("a block lacks answers")
    p = len(second)
    return first, second, [c[:p] for c in counts], got[:, :p].astype(np.int64), got[:, p:].astype(np.int64)


def bucket(c: np.ndarray) -> np.ndarray:
    """0 for unseen contexts, else 1 + the whole part of log2 of their count."""
    return np.where(c > 0, np.frexp(c.astype(np.float64))[1], 0)


def _level(x: np.ndarray) -> np.ndarray:
    """Steps of 1/4 octave below 1, at most 250; 999 for nothing."""
    with np.errstate(divide="ignore"):
        return np.where(x > 0, np.minimum(np.rint(-4 * np.log2(np.maximum(x, 1e-300))), 250), 999).astype(np.int64)


def held_out_events(joined: DataFrame, tokens: list[int]) -> DataFrame:
    """Histogram of the held-out tokens of both deletions: bucket, levels of the two estimates, weight."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                first, second, local, pair, word = _global(r)
                for h in (0, 1):
                    weight, c2, c1, cw = local[h], pair[1 - h], word[1 - h][first], word[1 - h][second]
                    some = weight > 0
                    b = bucket(2 * c1)[some]  # what the context's count is likely to be over both halves
                    f2 = _level(c2[some] / np.maximum(c1[some], 1))
                    f1 = _level(cw[some] / max(tokens[1 - h], 1))
                    cell, at = np.unique((b * 1000 + f2) * 1000 + f1, return_inverse=True)
                    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.bincount(at, weights=weight[some]).astype(np.int64))], names=["cell", "n"])

    return joined.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def mixture(cells: np.ndarray, n: np.ndarray, vocabulary: int, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (bucket, [pair, word, uniform]) by expectation maximisation; unseen buckets take those of the one below."""
    value = lambda x: np.where(x < 999, 2.0 ** (-x / 4), 0.0)
    b = cells // 1_000_000
    f = np.stack((value(cells // 1000 % 1000), value(cells % 1000), np.full(len(cells), 1 / (vocabulary + 1))), axis=1)
    out = np.full((_BUCKETS, 3), 1 / 3)
    out[0] = 0, 0.5, 0.5
    for k in range(_BUCKETS):
        own = b == k
        if own.any():
            x, w, weights = f[own], n[own], out[k].copy()
            for _ in range(rounds):
                share = x * weights
                share /= share.sum(axis=1, keepdims=True)
                weights = (w[:, None] * share).sum(axis=0) / w.sum()
                weights = np.maximum(weights, [0, 1e-6, 1e-6])
                weights /= weights.sum()
            out[k] = weights
        elif k > 1:
            out[k] = out[k - 1]
    out[0] = [0, out[0][0] + out[0][1], out[0][2]]
    return out


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scores(joined: DataFrame, weights: np.ndarray, tokens: int, words: int) -> DataFrame:
    n, v = max(tokens, 1), words

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                first, second, _, pair, word = _global(r)
                pair, word = pair.sum(axis=0), word.sum(axis=0)
                c1, cw = word[first], word[second]
                w = weights[bucket(c1)]
                p = np.log10(w[:, 0] * (pair / np.maximum(c1, 1)) + w[:, 1] * (cw / n) + w[:, 2] / (v + 1))
                base = np.log10((cw + 1) / (tokens + v + 1))
                lengths = np.array(r["lengths"])
                starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
                steps = get(r["steps"], np.uint32).astype(np.int64)
                whole = np.cumsum(steps)
                at = whole - np.repeat(whole[starts] - steps[starts], lengths)
                summed = [np.add.reduceat(x[at], starts) for x in (base, p, (cw > 0).astype(np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array(r["ids"], pa.int64()), pa.array(r["held"], pa.bool_()), pa.array(lengths), pa.array(summed[2]), pa.array(np.full(len(lengths), tokens)), pa.array(summed[0]), pa.array(summed[1])], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return joined.mapInArrow(run, SCORES)


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """Scores of all texts, learned from those whose crc32 of the id modulo 7 isn't 2."""
    spark = df.sparkSession
    slim = df.select(F.col(id_col).cast("long").alias("doc_id"), (fold(id_col, 7) == 2).alias("held"), F.col(text_col).alias("text"))
    name = f"topospan_lm_{uuid.uuid4().hex}"
    packed = blocks(slim, block_tokens)
    buckets = max(12, int(spark.conf.get("spark.sql.shuffle.partitions")))
    packed.write.bucketBy(buckets, "block").format("parquet").saveAsTable(name)
    table = spark.table(name)
    answers = held = None
    try:
        shards = max(1, -(-(table.agg(F.sum("n_keys")).first()[0] or 0) // shard_keys))
        answers = written(totals(table, shards), "lm-answers")
        ends = answers.df.where("block = -1").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("half0", "half1", "words"))).first()
        half, words = [ends[0], ends[1]], ends[2]
        tokens = sum(half)
        by_block = answers.df.where("block >= 0").groupBy("block").agg(F.collect_list(F.struct("shard", "answer")).alias("answers"))
        joined = table.join(by_block.hint("shuffle_hash"), "block")
        events = held_out_events(joined, half).toPandas()
        weights = mixture(events["cell"].to_numpy(np.int64), events["n"].to_numpy(np.float64), words)
        held = written(scores(joined, weights, tokens, words), "lm-scores")
        return held.df
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        if isinstance(answers, Table):
            answers.drop()

"""Secret scans: fixed patterns, and character Markov models of random strings and identifiers.

Two first-order character models are trained from labelled samples: random strings (hexadecimal,
base64 and upper-case alphanumeric digests of a counter) and ordinary identifiers (the words of
`sample_docs` documents, those with the least hash of their id, outside the fixed patterns' spans,
as they stand, in upper case and in pairs joined by `_`, `-` or a capital). A run of 20 or more
characters of `[A-Za-z0-9+/_=-]` that holds a letter and a digit or both cases is a secret too if
its log-likelihood ratio, random over ordinary, reaches `least_ratio` nats and `least_mean` nats a
transition; such spans have the kind `markov`. Runs are taken from the text outside the fixed spans.

Everything is a DataFrame expression; of the corpus only the counts of character pairs of the
bounded sample (at most 128 x 128) reach the driver, and the log ratios go back into the plan as
one constant.

Defined results: null and empty texts have no spans; whole texts are scanned, a megabyte of one
match or of many included; equal texts have equal spans; columns of any name pass `redact`; without any sample word both models are uniform but for the random strings' own
counts; offsets are code points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans as S
from .common import as_row

#: Fixed patterns. Runs are maximal, so a least length can stand in the pattern of access and hex.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
RUN = r"[A-Za-z0-9+/_=-]{20,}"
BASE = ("assign", "access", "hex")
SAMPLE_DOCS = 2000
LEAST_RATIO = 12.0
LEAST_MEAN = 0.75


def found(text: Column) -> dict[str, Column]:
    """Matches of each fixed pattern, to be projected before `located` reads them."""
    return {"assign": S.matches(text, ASSIGN), "access": S.matches(text, ACCESS), "hex": S.matches(text, HEX)}


def base_spans(text: Column) -> Column:
    """The ordered spans of the fixed patterns, from the columns `found` of the same names."""
    long_enough = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6
    assign = S.located(text, ASSIGN, F.col("assign"), 0, "assign", long_enough)
    access = S.located(text, ACCESS, F.col("access"), 1, "access")
    hexes = S.located(text, HEX, F.col("hex"), 2, "hex")
    return F.when(F.size("assign") + F.size("access") + F.size("hex") > 0, S.in_order(F.concat(assign, access, hexes))).otherwise(S.no_spans())


def _pair_counts(words: DataFrame) -> dict[str, int]:
    """Counts of adjacent characters of the column `w`."""
    pairs = words.select(F.explode(F.regexp_extract_all("w", F.lit("(?s)(?=(..))"), F.lit(1))).alias("p"))
    return {r.p: r.n for r in pairs.groupBy("p").agg(F.count("*").alias("n")).collect()}


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, n_random: int = 4000) -> list[float]:
    """log(P random / P ordinary) of each pair of ASCII characters, at 128 * first + second."""
    h = F.xxhash64(F.col(id_col).cast("string"))
    last = df.select(h.alias("h")).orderBy("h").limit(sample_docs).agg(F.max("h")).first()[0]
    sample = df.where(h <= (0 if last is None else last)).select(h.alias("h"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).orderBy("h", "text").limit(sample_docs)
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    words = sample.select(F.regexp_extract_all(plain, F.lit("[A-Za-z]{2,}"), F.lit(0)).alias("words")).where(F.size("words") > 0)
    joint = F.transform("words", lambda w, i: F.concat(w, F.element_at(F.array(F.lit("_"), F.lit("-"), F.lit("")), (i % 3 + 1).cast("int")), F.when(i % 3 == 2, F.initcap(F.col("words")[(i + 1) % F.size("words")])).otherwise(F.col("words")[(i + 1) % F.size("words")])))
    ordinary = _pair_counts(words.select(F.explode(F.concat("words", F.transform("words", F.upper), joint)).alias("w")))
    digest = F.sha2(F.concat(F.lit("random "), F.col("id").cast("string")), 256)
    base64 = F.base64(F.unhex(digest))
    random = _pair_counts(df.sparkSession.range(n_random).select(F.explode(F.array(digest, F.substring(base64, 1, 42), F.regexp_replace(F.upper(base64), "[+/=]", ""), F.translate(F.substring(base64, 1, 42), "+/", "-_"))).alias("w")))
    symbols = [chr(x) for x in range(128) if chr(x).isalnum() or chr(x) in "+/_=-"]

    def log_p(counts: dict[str, int], prior: float) -> dict[str, float]:
        total = {a: sum(counts.get(a + b, 0) + prior for b in symbols) for a in symbols}
        return {a + b: math.log((counts.get(a + b, 0) + prior) / total[a]) for a in symbols for b in symbols}

    r, o = log_p(random, 0.5), log_p(ordinary, 0.5)
    return [round(r.get(chr(a) + chr(b), 0.0) - o.get(chr(a) + chr(b), 0.0), 6) for a in range(128) for b in range(128)]


def ratio(word: Column, table: list[float]) -> Column:
    """The log-likelihood ratio of a word."""
    known = F.split(F.lit(",".join(map(repr, table))), ",").cast("array<double>")

    def step(acc, c):
        code = F.ascii(c)
        return F.struct(code.alias("last"), (acc["sum"] + F.when(acc["last"] >= 0, F.get(known, acc["last"] * 128 + code)).otherwise(0.0)).alias("sum"))

    return F.aggregate(S.matches(word, "(?s)."), F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum")), step, lambda acc: acc["sum"])


def with_spans(df: DataFrame, table: list[float], least_ratio: float = LEAST_RATIO, least_mean: float = LEAST_MEAN) -> DataFrame:
    """(row, text, base, spans) from (row, text): the fixed patterns' spans, and all spans; both ordered."""
    text = F.coalesce(F.col("text"), F.lit(""))
    mixed = lambda m: m.rlike("[A-Za-z]") & (m.rlike("[0-9]") | m.rlike("^[^a-z]*+[a-z][^A-Z]*+[A-Z]"))

    def random(m):
        return F.when(mixed(m), S.let(ratio(m, table), lambda r: (r >= least_ratio) & (r >= least_mean * (F.length(m) - 1)))).otherwise(False)

    base = df.withColumns(found(text)).select("row", "text", base_spans(text).alias("base"))
    runs = base.withColumn("clear", F.when(F.size("base") > 0, S.blanked(text, F.col("base"))).otherwise(text)).withColumn("runs", S.matches(F.col("clear"), RUN))
    more = F.when(F.exists("runs", mixed), S.located(F.col("clear"), RUN, F.col("runs"), 3, "markov", random)).otherwise(S.no_spans())
    return runs.withColumn("more", more).select("row", "text", "base", F.when(F.size("more") > 0, S.in_order(F.concat("base", "more"))).otherwise(F.col("base")).alias("spans"))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and spans of each text; one row per row."""
    slim = df.select(F.col(id_col).cast("long").alias("row"), F.col(text_col).alias("text"))
    out = with_spans(slim, train(slim, "row"))
    return out.select(F.col("row").alias("doc_id"), *(S.of_kind(F.col("base"), k).alias(f"n_{k}") for k in BASE), F.sha2(S.joined(F.col("base")), 256).alias("base_sha256"), S.joined(F.col("spans")).alias("spans"))


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`df` with every secret in its texts replaced by [SECRET]; a null text stays null."""
    out = with_spans(df.select(as_row(df).alias("row"), F.col(text_col).alias("text")), train(df, id_col, text_col))
    text = F.when(F.size("spans") > 0, S.replaced(F.col("text"), F.col("spans"), lambda x: F.lit("[SECRET]"))).otherwise(F.col("text"))
    return out.select(*(text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in df.columns))

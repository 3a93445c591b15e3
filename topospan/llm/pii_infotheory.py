"""Personal data: fixed patterns, and information-theoretic sanitisation of what reveals it.

The protected entities are the values that the fixed patterns find (an address, a number, as
written but for case). Corpus co-occurrence estimates how strongly a term reveals an entity
(Sanchez, Batet and Viejo, 2013): with n(c) documents that hold entity c, n(t) that hold term t,
n(c,t) that hold both, wherever they stand, and N documents in all,

    disclosure(c, t) = PMI(c; t) / IC(c) = log(n(c,t) N / (n(c) n(t))) / log(N / n(c)),

which is 1 if the term gives the entity away. Terms (runs of letters and digits of any length, in
lower case, outside the protected values' spans) of at least `least` are disclosing, however few
texts hold c; in each text that holds c they are removed or generalised too, wherever they stand,
as spans of the kind `term`.

Everything is a DataFrame expression and all statistics cover all documents; equal texts are scanned
as one, by a 128-bit hash of the text, and counted as many. Entities that stand in the same texts
have the same disclosures and are scored as one, so a list of numbers isn't paired with every word
beside it. Counts are summed before each shuffle.

Defined results: null and empty texts have no spans; whole texts are scanned, a megabyte of digits
or of address parts included; equal texts have equal spans; columns of any name pass; texts without an entity never get term spans; offsets are code points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans as S
from .common import written

#: Fixed patterns. Look-behinds start a match only where the leftmost one can start; possessive
#: repeats of a group are loops, not recursions, and stop where the greedy ones do.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ("email", "ip", "card", "phone")
LEAST = 0.9
#: A term: a run of letters, their marks and digits, of any length.
TOKEN = r"[\p{L}\p{M}\p{N}]+"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def add(acc, i):
        d = F.ascii(F.substring(digits, n - i, F.lit(1))) - 48
        return acc + F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _ip_ok(m: Column) -> Column:
    """Every part, without leading zeros, has at most three digits and is at most 255."""
    bare = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.forall(F.split(m, r"\."), lambda p: F.when(F.length(bare(p)) <= 3, bare(p).cast("int") <= 255).otherwise(False))


def _card_ok(m: Column) -> Column:
    d = _digits(m)
    return F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False)


def _phone_ok(m: Column) -> Column:
    return F.length(_digits(m)).between(10, 15)


_KINDS = (("email", EMAIL, None), ("ip", IP, _ip_ok), ("card", CARD, _card_ok), ("phone", PHONE, _phone_ok))


def with_base(df: DataFrame) -> DataFrame:
    """Adds `base`, the ordered spans of the fixed patterns, to (doc_id, text)."""
    found = df.withColumns({k: S.matches(F.col("text"), p) for k, p, _ in _KINDS})
    each = [S.located(F.col("text"), p, F.col(k), o, k, ok) for o, (k, p, ok) in enumerate(_KINDS)]
    some = sum(F.size(k) for k in BASE) > 0
    return found.withColumn("base", F.when(some, S.in_order(F.concat(*each))).otherwise(S.no_spans())).drop(*BASE)


def _key(text: Column) -> Column:
    """A text's identity: 128 bits of hashes."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b"))


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)))


def disclosing(held: DataFrame, texts: DataFrame, least: float = LEAST) -> DataFrame:
    """(key, term), distinct: of each text that holds an entity, the terms that disclose one of its entities.

    held: key, copies, entities, terms (outside the protected spans), inside (words of the whole text
    that aren't among them), edge (those that are no whole word of the text); texts: text, over the
    corpus. n(t) counts terms outside the spans too.
    """
    all_ = texts.select(F.explode(_words(F.col("text"))).alias("term"), F.lit(1).cast("long").alias("k"))
    inside = held.select(F.explode("inside").alias("term"), (-F.col("copies")).alias("k"))
    edge = held.select(F.explode("edge").alias("term"), F.col("copies").alias("k"))
    nt = all_.union(inside).union(edge).groupBy("term").agg(F.sum("k").alias("nt")).where("nt > 0")
    owned = held.select("key", "copies", F.explode("entities").alias("entity"))
    # Entities of the same texts have the same disclosures: one of them stands for all in each text.
    same = F.struct(F.count("*").alias("n"), F.bit_xor(F.xxhash64("key")).alias("a"), F.bit_xor(F.xxhash64(F.lit(5), "key")).alias("b"))
    groups = owned.groupBy("entity").agg(F.sum("copies").alias("nc"), same.alias("group"))
    nc = written(owned.join(groups, "entity").select("key", "copies", "group", "nc").distinct(), "pii-entities")
    n = float(max(texts.count(), 2))
    # As n(c,t) <= n(c), no term of more than n^(1 - least) n(c)^least documents can disclose c.
    most = lambda c: (1 - least) * math.log(n) + least * F.log(c) + 1e-9
    rare = nt.crossJoin(F.broadcast(nc.df.agg(F.max("nc").alias("most")))).where(F.log("nt") <= most(F.col("most"))).drop("most")  # a row of one number
    terms = held.select("key", F.explode("terms").alias("term")).join(rare, "term")
    pairs = written(terms.join(nc.df, "key").where(F.log("nt") <= most(F.col("nc"))), "pii-pairs")
    score = F.log(F.sum("copies") * n / (F.col("nc") * F.col("nt"))) / F.greatest(F.log(n / F.col("nc")), F.lit(1e-9))
    scored = pairs.df.groupBy("group", "term", "nc", "nt").agg(score.alias("disclosure")).where(F.col("disclosure") >= least)
    out = written(pairs.df.join(scored.select("group", "term"), ["group", "term"]).select("key", "term").distinct(), "pii-terms")
    nc.drop()
    pairs.drop()
    return out.df


def with_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, base) of every row, and (key, terms) of the texts with disclosing terms.

    The first is written once; the second's spans keep clear of base ones. A text's words meet its
    disclosing terms in a join by (text, word), however many it has of either.
    """
    slim = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    some = F.size("base") > 0
    entities = F.array_distinct(F.transform(S.cut(F.col("text"), F.col("base")), F.lower))
    marked = with_base(slim).select("doc_id", "text", _key(F.col("text")).alias("key"), "base", F.when(some, S.blanked(F.col("text"), F.col("base"))).alias("clear"))
    worded = marked.withColumn("terms", F.when(some, _words(F.col("clear")))).withColumn("all", F.when(some, _words(F.col("text"))))
    base = written(worded.select("doc_id", "key", "base", F.when(some, entities).alias("entities"), "terms", F.when(some, F.array_except("all", "terms")).alias("inside"), F.when(some, F.array_except("terms", "all")).alias("edge")), "pii-base").df
    one = base.where(F.size("base") > 0).groupBy("key").agg(F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("base", "entities", "terms", "inside", "edge")))
    held = written(one, "pii-held").df
    wanted = disclosing(held, slim.select("text"), least)
    texts = slim.withColumn("key", _key(F.col("text"))).join(wanted.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"]).join(held.select("key", "base"), "key")
    found = texts.select("key", S.blanked(F.col("text"), F.col("base")).alias("text")).withColumn("found", S.matches(F.col("text"), TOKEN))
    spans = found.select("key", F.explode(F.arrays_zip(F.transform("found", F.lower).alias("term"), S.located(F.col("text"), TOKEN, F.col("found"), 4, "term").alias("span"))).alias("x")).select("key", "x.term", "x.span")
    return base.select("doc_id", "key", "base"), spans.join(wanted, ["key", "term"]).groupBy("key").agg(F.sort_array(F.collect_list("span")).alias("terms"))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and spans of each text; one row per row."""
    base, terms = with_spans(df, id_col, text_col)
    both = base.join(terms, "key", "left")
    spans = F.when(F.size("terms") > 0, S.in_order(F.concat("base", "terms"))).otherwise(F.col("base"))
    return both.select("doc_id", *(S.of_kind(F.col("base"), k).alias(f"n_{k}") for k in BASE), F.sha2(S.joined(F.col("base")), 256).alias("base_sha256"), S.joined(spans).alias("spans"))


def sanitise(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): entities generalised to their kind, disclosing terms removed to [...]; null stays null."""
    base, terms = with_spans(df, id_col, text_col)
    spans = base.join(terms, "key", "left").select("key", F.when(F.size("terms") > 0, S.in_order(F.concat("base", "terms"))).otherwise(F.col("base")).alias("spans")).where(F.size("spans") > 0).dropDuplicates(["key"])
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("key", _key(F.coalesce("text", F.lit(""))))
    label = lambda x: F.when(x["kind"] == "term", F.lit("[...]")).otherwise(F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))
    return texts.join(spans, "key", "left").select("doc_id", F.when(F.size("spans") > 0, S.replaced(F.col("text"), F.col("spans"), label)).otherwise(F.col("text")).alias("text"))

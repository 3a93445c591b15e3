"""Conflict-constrained best-fit packing of documents into training sequences.

Documents are cut into pieces of at most `capacity` tokens (whole pieces first, the rest last).
Pieces are taken longest first; each goes to the bin with the least room that still holds it and
conflicts with nothing in it: bins carry a bitmap of their sources and one of their duplicate
clusters, and a piece whose source or cluster is in a bin's bitmaps can't go there (sources and
clusters of at most WALK pieces keep the few bins that hold them instead). Bins are kept
ordered by residual capacity; the successor search starts at the smallest residual that fits and
continues until the tightest compatible bin is found; if none is, a bin is opened. Where the first
WALK bins all conflict, the search goes on by groups of bins with the same bitmaps: a group that
holds the piece's bit is passed as one, and in each of the others the successor is looked up. Both ways find the same bin.

Packing is sequential, so documents are dealt by a hash of their id (of their text, where that is
null) into shards of about `shard_tokens` tokens, or an eighth as many documents (the number of
shards follows from the total, so a shard's size doesn't grow with the data), and a bin never spans
shards. The hash spreads a hot source or a hot cluster over all shards. No piece is dropped and no
bin holds two documents of one source or one cluster.

Defined results: texts that are null, empty or hold no token have one piece of 0 tokens (it takes
a place in a bin like any other and obeys the same conflicts, but for clusters: texts without
tokens are no copies); a null source is no source and conflicts with none; a null cluster
likewise; ties go by id, tokens, the text's hash and the piece's offset; repeated rows are separate
documents; columns of any name pass.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .lsh_forest import classed

CAPACITY = 2048
SHARD_TOKENS = 8_000_000
PIECE_TOKENS = 8
WALK = 32


def best_fit(pieces: list[tuple[int, int | None, int | None, int]], capacity: int) -> list[int]:
    """The bin of each piece (size, source, cluster, document), taken in the given order.

    Pieces of one document are of one source, and so are never together either.
    """
    order: list[tuple[int, int]] = []  # (residual, bin), ascending
    maps: list[tuple[int, int]] = []  # the sources and the clusters of each bin
    bits: list[dict] = []
    for k in (1, 2):
        often = (x for x, n in Counter(p[k] for p in pieces if p[k] is not None).items() if n > WALK)
        bits.append({x: 1 << n for n, x in enumerate(often)})
    rare: defaultdict[tuple[int, int], set[int]] = defaultdict(set)  # where each of the others is
    groups: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def tightest(size: int, s: int, c: int, closed: set[int]) -> tuple[int, int] | None:
        best = None
        for (own_s, own_c), bins in groups.items():
            if own_s & s or own_c & c:
                continue
            for at in range(bisect_left(bins, (size, -1)), len(bins)):
                if best is not None and bins[at] >= best:
                    break
                if bins[at][1] not in closed:
                    best = bins[at]
                    break
        return best

    out = []
    for size, source, cluster, _ in pieces:
        s, c = bits[0].get(source, 0), bits[1].get(cluster, 0)
        keys = [x for x in ((0, source), (1, cluster)) if x[1] is not None and x[1] not in bits[x[0]]]
        closed = set().union(*(rare[x] for x in keys)) if keys else set()
        found, at = None, bisect_left(order, (size, -1))
        for place in order[at : at + WALK]:
            own_s, own_c = maps[place[1]]
            if not (own_s & s or own_c & c or place[1] in closed):
                found = place
                break
        if found is None and at + WALK < len(order):
            found = tightest(size, s, c, closed)
        if found:
            residual, b = found
            del order[bisect_left(order, found)]
            own = groups[maps[b]]
            del own[bisect_left(own, found)]
            if not own:
                del groups[maps[b]]
            maps[b] = maps[b][0] | s, maps[b][1] | c
        else:
            residual, b = capacity, len(maps)
            maps.append((s, c))
        insort(order, (residual - size, b))
        insort(groups.setdefault(maps[b], []), (residual - size, b))
        for x in keys:
            rare[x].add(b)
        out.append(b)
    return out


def n_tokens(text_col: str) -> Column:
    """Maximal runs of other than ASCII white space."""
    return F.when(F.length(F.trim(F.translate(text_col, "\t\n\x0b\x0c\r", "     "))) > 0, F.size(F.split(F.trim(F.translate(text_col, "\t\n\x0b\x0c\r", "     ")), " +"))).otherwise(0)


RESULT = "shard int, bin int, doc_id long, source string, start long, n_tokens long, residual long"


def pack(df: DataFrame, id_col: str = "doc_id", tokens: Column | None = None, source_col: str = "source", cluster: Column | None = None, text_col: str = "text", capacity: int = CAPACITY, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per piece: its shard and bin, where it starts in its document, its tokens and the bin's final residual.

    `tokens` defaults to the words of the text, `cluster` to the equal texts.
    """
    mark = F.xxhash64(F.col(text_col))
    tokens = n_tokens(text_col) if tokens is None else tokens
    cluster = F.when(tokens > 0, mark) if cluster is None else cluster
    return _packed(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), cluster.cast("long").alias("cluster"), F.coalesce(tokens, F.lit(0)).cast("long").alias("n"), mark.alias("mark")), capacity, shard_tokens)


def _packed(slim: DataFrame, capacity: int, shard_tokens: int) -> DataFrame:
    """pack() of (doc_id, source, cluster, n, mark)."""
    slim = written(slim, "pack-slim").df
    total = slim.agg(F.sum(F.greatest("n", F.lit(PIECE_TOKENS)))).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["doc_id", "n", "mark"], kind="stable", na_position="first")
        names, kinds = pd.factorize(own["source"])
        groups, _ = pd.factorize(own["cluster"])
        ids = own["doc_id"].tolist()
        pieces = []
        for k, (n, s, c) in enumerate(zip(own["n"].tolist(), names.tolist(), groups.tolist(), strict=True)):
            for start in range(0, max(n, 1), capacity):
                pieces.append((min(capacity, n - start), s if s >= 0 else None, c if c >= 0 else None, k, start))
        pieces.sort(key=lambda x: (-x[0], x[3], x[4]))
        bins = best_fit([x[:4] for x in pieces], capacity)
        out = pd.DataFrame({"shard": int(own["shard"].iloc[0]), "bin": bins, "doc_id": pd.array([None if pd.isna(ids[x[3]]) else int(ids[x[3]]) for x in pieces], "Int64"), "source": [None if x[1] is None else kinds[x[1]] for x in pieces], "start": [x[4] for x in pieces], "n_tokens": [x[0] for x in pieces]})
        out["residual"] = capacity - out.groupby("bin")["n_tokens"].transform("sum")
        return out

    dealt = slim.withColumn("shard", F.pmod(F.xxhash64(F.coalesce("doc_id", "mark"), F.lit(17)), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInPandas(run, RESULT)


def pack_near(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", capacity: int = CAPACITY, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """pack() with the near-duplicate classes of lsh_forest as clusters; tokens are counted where the texts are signed."""
    rows = classed(df, id_col, text_col, [source_col])
    mark = F.xxhash64("a", "b")
    return _packed(rows.select("doc_id", F.col("row")[source_col].cast("string").alias("source"), F.when(F.col("n_tokens") > 0, F.coalesce("class_id", mark)).alias("cluster"), F.col("n_tokens").alias("n"), mark.alias("mark")), capacity, shard_tokens)

"""Nearest neighbours by a block matrix join with int8 product tiles.

Vectors are packed into blocks. Every block of queries meets every block of candidates of its
dimension: both are quantised to int8 with a scale a vector, the product tile is a matrix product
of integers (exact), and by Cauchy and Schwarz

    |q.c - q'.c'| <= |q - q'| |c| + |q'| |c - c'|

bounds what quantisation can change. Pairs whose upper bound reaches neither the k-th lower bound
of the tile nor the query's k-th score so far can't be among the k nearest; the surviving pairs
are recomputed in double precision and go through a heap for each query. A task's heaps meet in a
ranking by query, which Spark limits to k rows a query before its shuffle. The result is exact.

The queries are a stated set against all rows, in blocks: groups of QUERY_BLOCKS query blocks meet
groups of CANDIDATE_BLOCKS candidate blocks by an equality join on both groups, at every size. So a
key holds a bounded rectangle of the matrix, tasks read the rectangles one after another in the
order of the query groups, and a task's heaps are those of one group. Vectors travel in the type
they came in (4 bytes a component of float arrays); the int8 form is made beside the product.

Defined results: rows with a null id, or a vector that is null, empty, zero or holds a null or a
non-finite component, take no part; vectors of other dimensions than the query's are no candidates
of it; a row with the query's id is its own, repeated or not; equal scores go to the smaller id,
and equal rows (same id, same score) keep a place each.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

K = 20
BLOCK = 4096
QUERY_BLOCKS = 4
CANDIDATE_BLOCKS = 4


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0), F.lit(False))


def pack(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """Blocks of up to `block` vectors of one dimension: (dim, width, n, ids, vectors), from (id, vector)."""
    kind = np.float32 if df.schema["vector"].dataType.elementType.typeName() == "float" else np.float64
    width = np.dtype(kind).itemsize

    def run(batches):
        held: dict[int, list] = {}

        def row(dim, own):
            ids, vectors = np.array([x[0] for x in own], np.int64), np.array([x[1] for x in own], kind)
            return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "width": pa.array([width], pa.int32()), "n": pa.array([len(own)], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()), "vectors": pa.array([vectors.tobytes()], pa.binary())})

        for batch in batches:
            for key, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = held.setdefault(len(vector), [])
                own.append((key, vector))
                if len(own) == block:
                    yield row(len(vector), held.pop(len(vector)))
        for dim, own in held.items():
            yield row(dim, own)

    return df.mapInArrow(run, "dim int, width int, n int, ids binary, vectors binary")


class Tile:
    """A block with its quantised form and the norms that bound its error."""

    def __init__(self, dim: int, width: int, ids: bytes, vectors: bytes):
        self.ids = np.frombuffer(ids, np.int64)
        self.x = np.frombuffer(vectors, f"f{width}").reshape(-1, dim).astype(np.float64)
        self.scale = np.abs(self.x).max(axis=1) / 127
        with np.errstate(divide="ignore", invalid="ignore"):
            self.q = np.where(self.scale[:, None] > 0, np.rint(self.x / self.scale[:, None]), 0).astype(np.int8)
        back = self.q * self.scale[:, None]
        self.norm = np.sqrt((self.x**2).sum(axis=1))
        self.near = np.sqrt((back**2).sum(axis=1))
        self.off = np.sqrt(((self.x - back) ** 2).sum(axis=1))


def survivors(q: Tile, c: Tile, k: int, least: np.ndarray, chunk: int = 512):
    """(query row, candidate row, exact score) of pairs that may be among the k nearest; `least`: scores to reach."""
    kind = np.float32 if q.x.shape[1] <= 1024 else np.float64  # products of int8 sum exactly
    ci = c.q.astype(kind).T.copy()
    for at in range(0, len(q.ids), chunk):
        s = slice(at, at + chunk)
        near = (q.q[s].astype(kind) @ ci).astype(np.float64) * q.scale[s, None] * c.scale
        error = q.off[s, None] * c.norm + q.near[s, None] * c.off
        error += 1e-12 * (q.norm[s, None] * c.norm)
        own = q.ids[s, None] == c.ids
        low = np.where(own, -np.inf, near - error)
        bar = least[s]
        if low.shape[1] > k:
            bar = np.maximum(bar, np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k])
        i, j = np.nonzero((near + error >= bar[:, None]) & ~own)
        yield i + at, j, np.einsum("ij,ij->i", q.x[i + at], c.x[j])


def nearest(df: DataFrame, query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, block: int = BLOCK, query_blocks: int = QUERY_BLOCKS, candidate_blocks: int = CANDIDATE_BLOCKS) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest of each row that `query` (of the column id) holds for."""
    vector = F.col(vector_col)
    if df.schema[vector_col].dataType.elementType.typeName() not in ("float", "double"):
        vector = vector.cast("array<double>")
    slim = df.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector")).where(F.col("id").isNotNull() & usable(F.col("vector")))
    queries = written(pack(slim.where(query), block), "ann-queries").df
    blocks = written(pack(slim, block), "ann-blocks").df
    rows, columns = (max(1, -(-x.count() // n)) for x, n in ((queries, query_blocks), (blocks, candidate_blocks)))

    def dealt(x, own, n, other, m):
        return x.withColumn(own, F.pmod(F.xxhash64("ids"), F.lit(n))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))))

    asked = dealt(queries, "g", rows, "h", columns).select("dim", "g", "h", "width", F.col("ids").alias("qids"), F.col("vectors").alias("qvectors"))
    tiles = asked.join(dealt(blocks, "h", columns, "g", rows).select("dim", "g", "h", "ids", "vectors").hint("merge"), ["dim", "g", "h"])

    def run(batches):
        heaps: dict[bytes, list] = {}
        seen: dict[bytes, Tile] = {}
        group, last = None, (None, None)

        def out():
            for qids, q in seen.items():
                best = [(int(q.ids[n]), -key, x) for n, h in enumerate(heaps[qids]) for x, key in h]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in best], pa.int64()), pa.array([r[1] for r in best], pa.int64()), pa.array([r[2] for r in best], pa.float64())], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for n in range(batch.num_rows):
                r = batch.slice(n, 1).to_pylist()[0]
                if group != (r["dim"], r["g"]):  # the join is sorted by its key
                    yield from out()
                    group, heaps, seen = (r["dim"], r["g"]), {}, {}
                if r["qids"] not in seen:
                    seen[r["qids"]] = Tile(r["dim"], r["width"], r["qids"], r["qvectors"])
                    heaps[r["qids"]] = [[] for _ in seen[r["qids"]].ids]
                q, own = seen[r["qids"]], heaps[r["qids"]]
                if last[0] != (r["dim"], r["ids"]):
                    last = (r["dim"], r["ids"]), Tile(r["dim"], r["width"], r["ids"], r["vectors"])
                least = np.array([h[0][0] if len(h) == k else -np.inf for h in own])
                for i, j, score in survivors(q, last[1], k, least):
                    for at, key, x in zip(i.tolist(), last[1].ids[j].tolist(), score.tolist(), strict=True):
                        h = own[at]
                        if len(h) < k:
                            heapq.heappush(h, (x, -key))
                        elif (x, -key) > h[0]:
                            heapq.heapreplace(h, (x, -key))
        yield from out()

    found = tiles.mapInArrow(run, "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def self_search(df: DataFrame, every: int = 20) -> DataFrame:
    """The rows whose id is divisible by `every`, against all rows."""
    return nearest(df, F.col("id") % every == 0)

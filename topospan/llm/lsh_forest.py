"""Similarity join on word shingles: MinHash LSH forest, then exact verification.

Texts (lower case, split at white space) are sets of their shingles of five words; a text of fewer
words is one shingle. Texts of one set are copies and are represented by their least id. Each of
`trees` tries holds a path for every set: a level for each of `depth` min-hashes, packed into 64
bits (LEVELS), so that the sorted paths are the trie and a node is a run of them that share a
prefix. Paths are sorted over the cluster by ranges, and one scan of each range finds the runs at
every depth from `depth` down to the least that can be needed; runs that cross ranges are tied by
their ends. No node is gathered, however many sets it holds: its members are tied to its first.

Sets that share a node meet. Matched prefixes are shortened adaptively: the first look takes the
whole depth; how alike the sets that meet there are is estimated from all levels of their paths,
and, weighting each pair by the inverse of its chance to be found, the next prefix is the longest
that would miss at most 1 - `recall` of such pairs, in total (a pair at the least similarity is
added for what hasn't been seen) and at each similarity; that is repeated until no shorter prefix is
asked for. At the least depth even a pair at the least similarity is missed with a chance of at
most 1 - `recall`. Every set is looked at in every tree.

Verification is exact: connected components of the ties are verified whole if they have at most
`tile` sets; larger ones are dealt into blocks by a hash and only the blocks of sets that met in a
node meet again, so a chain of many sets doesn't become a square. Tiles hold at most about
`tile` x `tile` sets, and intersections of all their pairs are one product of 0/1 matrices. A tile
returns a row per set (its verified neighbours, and the least id that it is linked to), never the
pairs. Copies are counted before anything is joined.

Result: doc_id, class_id (least id of the group linked by similarities of at least `similarity`),
text_id (least id of the same set), n_copies (rows of that set), n_links (other sets at least as
similar).

Defined results: a text that is null, empty or blank is its own class, with no links; a row whose
id is null has a null class and no links; repeated rows are copies; ids are taken to name one text;
columns of any name pass `one_of_each`.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .common import as_row, written

WORDS = 5
SIMILARITY = 0.8
TREES = 30
DEPTH = 6
RECALL = 0.99999
TILE = 2048
SMALL_BYTES = 16 << 20
_RNG = np.random.default_rng(20240501)
_STEP = _RNG.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Random numbers of bytes, powers of an odd base and of its inverse: the hash of words of up to LONG bytes, in blocks of BLOCK bytes.
LONG, BLOCK = 256, 1 << 18
_BYTE = np.random.default_rng(7).integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_POWER, _BACK = (np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(BLOCK + LONG - 1, x, np.uint64)))) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
_MUL = _RNG.integers(0, 2**31, TREES * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _RNG.integers(0, 2**32, TREES * DEPTH, dtype=np.uint32)
#: Bits of each level of a path.
LEVELS = (11, 11, 11, 11, 10, 10)
#: How far a path is shifted to leave the prefix of each depth.
SHIFTS = tuple(64 - sum(LEVELS[:k]) for k in range(DEPTH + 1))
#: Nodes with more ties than this are joined by a broadcast; one in so many ties can be such a node.
HOT, HOT_SHARE = 10_000, 1_000


def reach(similarity, depth: int, trees: int = TREES):
    """The chance that a pair of that similarity shares a prefix of that depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def least_depth(trees: int, depth: int, similarity: float, recall: float) -> int:
    """The longest prefix, at most `depth`, at which a pair of that similarity meets with chance `recall`."""
    while depth > 1 and reach(similarity, depth, trees) < recall:
        depth -= 1
    return depth


def next_depth(found: dict[float, int], depth: int, least: int, similarity: float, recall: float, trees: int = TREES) -> int:
    """The longest prefix, at most `depth`, at which the pairs found at `depth` (counts by similarity) would reach `recall`."""
    s = np.array([similarity, *found])
    n = np.array([1.0, *(n / reach(x, depth, trees) for x, n in found.items())])
    while depth > least and (reach(s[1:], depth, trees).min(initial=1.0) < recall or (n * reach(s, depth, trees)).sum() / n.sum() < recall):
        depth -= 1
    return depth


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word of the lower-case texts, words of each text), all texts at once.

    A word's hash is the sum of random numbers of its bytes times powers of an odd base, mixed with its
    length: a difference of a running sum, brought to a common power. Words over LONG bytes are hashed by themselves.
    """
    lists = pc.utf8_split_whitespace(pa.array([x.lower() for x in texts], pa.large_string()))
    ends = np.frombuffer(lists.values.buffers()[1], np.int64, len(lists.values) + 1)
    data = np.frombuffer(lists.values.buffers()[2] or b"", np.uint8)
    full = np.diff(ends) > 0  # white space at either end leaves an empty word
    n = np.diff(np.concatenate(([0], np.cumsum(full)))[lists.offsets.to_numpy()])
    start, end = ends[:-1][full], ends[1:][full]
    h = np.empty(len(start), np.uint64)
    for at in range(0, int(ends[-1]), BLOCK):
        own = slice(*np.searchsorted(start, (at, at + BLOCK)))
        part = data[at : min(at + BLOCK + LONG, int(ends[-1]))]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * _POWER[: len(part)], out=total[1:])
        a = start[own] - at
        h[own] = (total[np.minimum(end[own] - at, len(part))] - total[a]) * _BACK[a]
    size = end - start
    for k in np.flatnonzero(size > LONG).tolist():
        h[k] = xxhash.xxh3_64_intdigest(data[start[k] : end[k]].tobytes())
    return _mix(h + size.astype(np.uint64) * _STEP[15]), n


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """Sorted 64-bit hashes of each text's shingles; none for a text without words."""
    if not texts:
        return []
    h, sizes = _word_hashes(texts)
    h = _mix(h)
    sums = h * _STEP[0]
    for k in range(1, words):
        sums[: max(len(h) - k, 0)] += h[k:] * _STEP[k]
    sums = _mix(sums + np.uint64(words))
    out, at = [], 0
    for n in sizes.tolist():
        if n >= words:
            own = np.sort(sums[at : at + n - words + 1])
            new = np.empty(len(own), bool)
            new[0] = True
            np.not_equal(own[1:], own[:-1], out=new[1:])
            out.append(own[new])
        elif n:
            out.append(_mix((h[at : at + n] * _STEP[:n]).sum(keepdims=True) + np.uint64(n)))
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out


def paths(sets: list[np.ndarray], trees: int = TREES) -> np.ndarray:
    """The path of each set in each tree, a row per set; of no meaning where the set is empty."""
    n = trees * DEPTH
    least = np.full((len(sets), n), 2**32 - 1, np.uint32)
    buffer = np.empty((256, n), np.uint32)  # small enough for a core's cache
    for own, shingles in zip(least, sets, strict=True):
        low = (shingles >> np.uint64(11)).astype(np.uint32)
        for at in range(0, len(low), 256):
            x = low[at : at + 256]
            hashed = buffer[: len(x)]
            np.multiply(x[:, None], _MUL[:n], out=hashed)
            hashed += _ADD[:n]
            np.minimum(own, hashed.min(axis=0), out=own)
    out = np.zeros((len(sets), trees), np.uint64)
    for k, bits in enumerate(LEVELS):
        level = (least[:, k::DEPTH] * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
        out |= level.astype(np.uint64) << np.uint64(SHIFTS[k + 1])
    return out.view(np.int64)


def _parts(texts: pa.Array, most_chars: int = 2_000_000):
    """(start, end, texts) of a column in parts of bounded size."""
    start, own, size = 0, [], 0
    for k, text in enumerate(texts):
        own.append(text.as_py() or "")
        size += len(own[-1])
        if size >= most_chars:
            yield start, k + 1, own
            start, own, size = k + 1, [], 0
    if own:
        yield start, len(texts), own


def signed(df: DataFrame, words: int, trees: int) -> DataFrame:
    """(doc_id, row) with a and b (128-bit hash of the set; null without words), keys (path in each tree) and n_tokens, from (doc_id, row, text)."""
    schema = df.select("doc_id", "row").schema.add("a", "long").add("b", "long").add("keys", ArrayType(LongType())).add("n_tokens", "long")

    def run(batches):
        for batch in batches:
            for start, end, texts in _parts(batch.column(2)):
                sets = shingle_sets(texts, words)
                marks = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                a, b = ([None if m is None else int.from_bytes(m[k : k + 8], "little", signed=True) for m in marks] for k in (0, 8))
                tokens = [len(x.encode("utf-8", "surrogatepass").split()) for x in texts]
                ends = np.arange(len(sets) + 1, dtype=np.int32) * trees
                keys = pa.ListArray.from_arrays(ends, paths(sets, trees).ravel(), mask=pa.array([m is None for m in marks]))
                own = [batch.column(k).slice(start, end - start) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(a, pa.int64()), pa.array(b, pa.int64()), keys, pa.array(tokens, pa.int64())], names=["doc_id", "row", "a", "b", "keys", "n_tokens"])

    return df.mapInArrow(run, schema)


def forest(sets: DataFrame, least: int) -> DataFrame:
    """The runs of all tries from (doc, keys): (tree, key, doc, depth, leaders).

    Rows of depth 0: a set that shares a prefix of `least` levels with the set before it, and the
    first set of its run at depths DEPTH, DEPTH - 1, ..., `least`. Rows of a depth: the first set
    (doc) of the first and of the last run of a range, with their prefix as the key.
    """
    placed = sets.select(F.posexplode("keys").alias("tree", "key"), "doc").repartitionByRange("tree", "key", "doc").sortWithinPartitions("tree", "key", "doc")
    depths = list(range(DEPTH, least - 1, -1))

    def out(tree, key, doc, depth, leaders):
        return pa.RecordBatch.from_arrays([pa.array(tree, pa.int32()), pa.array(key, pa.int64()), pa.array(doc, pa.int64()), pa.array(depth, pa.int32()), pa.array(leaders, pa.list_(pa.int64()))], names=["tree", "key", "doc", "depth", "leaders"])

    def run(batches):
        last = None  # tree, key and the leaders of the row before
        ends = []
        for batch in batches:
            tree, key, doc = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            if not len(doc):
                continue
            before_tree = np.concatenate(([tree[0] if last is None else last[0]], tree[:-1]))
            before_key = np.concatenate(([key[0] if last is None else last[1]], key[:-1]))
            leaders = np.empty((len(depths), len(doc)), np.int64)
            for n, d in enumerate(depths):
                shift = np.int64(SHIFTS[d])
                new = (tree != before_tree) | (key >> shift != before_key >> shift)
                new[0] |= last is None
                at = np.maximum.accumulate(np.where(new, np.arange(len(doc)), -1))
                leaders[n] = np.where(at >= 0, doc[at], 0 if last is None else last[2][n])
            if last is None:
                ends += [(tree[0], key[0] >> np.int64(SHIFTS[d]), doc[0], d) for d in depths]
            met = ~new
            last = tree[-1], key[-1], leaders[:, -1].copy()
            if met.any():
                yield out(tree[met], key[met], doc[met], np.zeros(int(met.sum()), np.int32), list(leaders[:, met].T))
        if last is not None:
            ends += [(last[0], last[1] >> np.int64(SHIFTS[d]), last[2][n], d) for n, d in enumerate(depths)]
            yield out(*(np.array([x[k] for x in ends]) for k in range(4)), [None] * len(ends))

    return placed.mapInArrow(run, "tree int, key long, doc long, depth int, leaders array<long>")


def nodes(runs: DataFrame, depth: int) -> DataFrame:
    """(tree, doc, node): the sets that share a prefix of `depth` with another, each with the first set of the trie's node."""
    edge = runs.where(F.col("depth") == depth).select("tree", "key", "doc").distinct()
    whole = edge.groupBy("tree", "key").agg(F.min("doc").alias("node"), F.count("*").alias("n")).where("n > 1").drop("n")
    crossing = F.broadcast(edge.join(whole, ["tree", "key"]).select("tree", F.col("doc").alias("first"), "node"))  # two rows a range
    inner = runs.where("depth = 0").select("tree", "doc", F.col("leaders")[DEPTH - depth].alias("first"))
    tied = inner.where("doc != first").join(crossing, ["tree", "first"], "left").select("tree", "doc", F.coalesce("node", "first").alias("node"))
    return tied.union(crossing.select("tree", F.col("first").alias("doc"), "node"))


def alike(met: DataFrame, sets: DataFrame, similarity: float) -> dict[float, int]:
    """Numbers of met pairs (a set and its node's first) by estimated similarity in hundredths, of those at least as similar."""
    pairs = met.select("doc", "node").distinct()
    keys = sets.select("doc", "keys")
    both = pairs.join(keys, "doc").join(keys.select(F.col("doc").alias("node"), F.col("keys").alias("others")), "node")

    def same(k):  # an equal level is an equal min-hash, but for one of 2^bits chances
        equal = lambda a, b: F.shiftrightunsigned(a.bitwiseXOR(b), SHIFTS[k + 1]).bitwiseAND((1 << LEVELS[k]) - 1) == 0
        return F.size(F.filter(F.zip_with("keys", "others", equal), lambda x: x))

    share = (same(0) + same(1) + same(2) + same(3) + same(4)) / (5 * F.size("keys"))
    found = both.select(F.floor(share * 100 + 1e-6).alias("s")).where(F.col("s") >= math.floor(100 * similarity)).groupBy("s").count()
    return {max(r.s / 100, similarity): r["count"] for r in found.collect()}  # a row for each hundredth


def _with_least(edges: DataFrame, least: DataFrame, cut: int) -> DataFrame:
    """edges (a, b) with m of `least` (a, m, n): nodes of more than `cut` edges by a broadcast, so none is one task's; cut 0: there are none."""
    if not cut:
        return edges.join(least.select("a", "m"), "a")
    hot = F.broadcast(least.where(F.col("n") > cut).select("a", "m"))
    return edges.join(hot, "a").union(edges.join(hot.select("a"), "a", "left_anti").join(least.where(F.col("n") <= cut).select("a", "m"), "a"))


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, root): the least node of each connected component, for every node that isn't one.

    Large-star and small-star rounds (Kiveris et al., 2014) as sums and joins, each round written.
    """
    e = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "cc")
    last = None
    n = e.df.count()
    cut = max(HOT, 2 * n // HOT_SHARE) if n > HOT else 0  # so at most HOT_SHARE nodes are broadcast
    for _ in range(most_rounds):
        both = e.df.union(e.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = _with_least(both, low, cut).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        large = written(large, "cc")
        met = _with_least(large.df, large.df.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), cut)
        small = met.select("a", F.col("m").alias("b")).union(met.select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a != b").distinct()
        e, old = written(small, "cc"), (e, large)
        state = e.df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        for t in old:
            t.drop()
        if state == last:
            return e.df.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = state
    raise RuntimeError("components didn't settle")


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity_parts: tuple[int, int]) -> np.ndarray:
    """Whether each set of `left` and of `right` (indices) are similar, as a matrix.

    p/q is the least similarity: |x & y| (p + q) >= p (|x| + |y|), in whole numbers.
    """
    p, q = similarity_parts
    size = np.array(list(map(len, sets)), np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate(([True], flat[1:] != flat[:-1]))
    number = np.cumsum(new) - 1
    shared = np.bincount(number) > 1
    column = np.cumsum(shared) - 1
    keep = shared[number]
    column, owner = column[number[keep]], owner[keep]
    both = np.zeros((len(left), len(right)), np.float32)
    place_l, place_r = np.full(len(sets), -1), np.full(len(sets), -1)
    place_l[left], place_r[right] = np.arange(len(left)), np.arange(len(right))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, (at, at + 4096))
        width = min(4096, int(column[-1]) + 1 - at)
        m = [np.zeros((len(x), width), np.float32) for x in (left, right)]
        for matrix, place in zip(m, (place_l, place_r), strict=True):
            here = place[owner[a:b]]
            matrix[here[here >= 0], column[a:b][here >= 0] - at] = 1
        both += m[0] @ m[1].T
    return both.astype(np.int64) * (p + q) >= p * (size[left][:, None] + size[right])


def _verified(own: pd.DataFrame, words: int, similarity_parts: tuple[int, int]) -> list[tuple[int, int, int]]:
    """(set, least id linked to it here, links) of one tile: rows of doc, side (0 left, 1 right, 2 both), text."""
    own = own.drop_duplicates("doc").sort_values("doc")
    docs, side = own["doc"].to_numpy(), own["side"].to_numpy()
    sets = shingle_sets(own["text"].tolist(), words)
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    if not len(left) or not len(right):
        return []
    near = linked(sets, left, right, similarity_parts)
    near &= left[:, None] != right
    links = np.zeros(len(docs), np.int64)
    links[left] += near.sum(axis=1)
    if side.min() < 2:
        links[right] += near.sum(axis=0)
    label = np.arange(len(docs))
    while True:
        old = label.copy()
        label[left] = np.minimum(label[left], np.where(near, label[right], len(docs)).min(axis=1))
        label[right] = np.minimum(label[right], np.where(near, label[left][:, None], len(docs)).min(axis=0))
        if (old == label).all():
            break
    return [(int(d), int(docs[k]), int(n)) for d, k, n in zip(docs, label, links, strict=True)]


def _blocks(members: DataFrame, sizes: DataFrame, met: DataFrame, tile: int, small_bytes: int) -> DataFrame:
    """(doc, root, i, j, side, bin): sets of the components of more than `tile`, dealt to the pairs of blocks that met in a node.

    The blocks of a node are sent to its members by a broadcast where all are few or the node is hot, so that none is one task's.
    """
    blocks = F.ceil(F.col("n") / tile).cast("int")
    large = members.join(sizes.where(F.col("n") > tile), "root").withColumn("own", F.pmod(F.xxhash64("doc"), blocks).cast("int")).select("doc", "root", "own")
    places = met.union(met.select("tree", F.col("node").alias("doc"), "node").distinct()).join(large, "doc")
    others = written(places.groupBy("tree", "node").agg(F.collect_set("own").alias("others"), F.count("*").alias("n")), "near-others")  # at most n / tile numbers each
    sent, key = others.df.select("tree", "node", "others"), ["tree", "node"]
    if others.size() <= small_bytes:
        both = places.join(F.broadcast(sent), key)
    else:
        cut = max(HOT, 2 * others.df.agg(F.sum("n")).first()[0] // HOT_SHARE)
        hot = others.df.where(F.col("n") > cut).select(*sent.columns)  # at most HOT_SHARE nodes
        both = places.join(F.broadcast(hot), key).union(places.join(F.broadcast(hot.select(*key)), key, "left_anti").join(others.df.where(F.col("n") <= cut).select(*sent.columns), key).select("tree", "node", "doc", "root", "own", "others"))
    own, other = F.col("own"), F.col("other")
    pairs = both.select("doc", "root", "own", F.explode("others").alias("other")).distinct()
    return pairs.select("doc", "root", F.least(own, other).alias("i"), F.greatest(own, other).alias("j"), F.when(own == other, 2).when(own < other, 0).otherwise(1).alias("side"), F.xxhash64("root", F.least(own, other), F.greatest(own, other)).alias("bin"))


def verify(members: DataFrame, met: DataFrame, texts: DataFrame, words: int, similarity_parts: tuple[int, int], tile: int, small_bytes: int) -> DataFrame:
    """(doc, leader, links) over tiles; members: (doc, root), met: (tree, doc, node), texts: (doc_id, text)."""
    sizes = members.groupBy("root").agg(F.count("*").alias("n"))
    total, most = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    whole = members.join(sizes.where(F.col("n") <= tile).select("root"), "root").select("doc", "root", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(2).alias("side"), F.pmod(F.xxhash64("root"), F.lit(max(1, -(-total // tile)))).alias("bin"))
    dealt = written(whole.union(_blocks(members, sizes, met, tile, small_bytes)) if most > tile else whole, "near-tiles")
    small = F.broadcast(dealt.df) if dealt.size() <= small_bytes else dealt.df
    rows = texts.select(F.col("doc_id").alias("doc"), "text").join(small, "doc")

    def run(own: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in own.groupby(["root", "i", "j"], sort=False):
            out += _verified(g, words, similarity_parts)
        return pd.DataFrame(out, columns=["doc", "leader", "links"])

    return rows.groupBy("bin").applyInPandas(run, "doc long, leader long, links long")


def classed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, words: int = WORDS, similarity_parts: tuple[int, int] = (4, 5), trees: int = TREES, recall: float = RECALL, tile: int = TILE, small_bytes: int = SMALL_BYTES) -> DataFrame:
    """doc_id, row (the columns `carry`), n_tokens, a and b (the set, null without words) of every row, and its set's text_id, n_copies, class_id, n_links.

    similarity_parts: numerator, denominator. The last four are null for sets that no row with an id has.
    """
    similarity = similarity_parts[0] / similarity_parts[1]
    least = least_depth(trees, DEPTH, similarity, recall)
    slim = df.select(F.col(id_col).cast("long").alias("doc_id"), as_row(df.select(carry or [])).alias("row") if carry else F.lit(None).cast("int").alias("row"), F.col(text_col).alias("text"))
    marks = written(signed(slim, words, trees), "near-signed").df
    known = marks.where("a is not null and doc_id is not null")
    sets = written(known.groupBy("a", "b").agg(F.min("doc_id").alias("doc"), F.count("*").alias("n_copies"), F.first("keys").alias("keys")), "near-sets").df
    runs = written(forest(sets, least), "near-runs")
    depth = DEPTH
    while depth > least:
        shorter = next_depth(alike(nodes(runs.df, depth), sets, similarity), depth, least, similarity, recall, trees)
        if shorter == depth:
            break
        depth = shorter
    met = written(nodes(runs.df, depth), "near-nodes")
    tied = components(met.df.select(F.col("doc").alias("a"), F.col("node").alias("b")))
    members = written(tied.select(F.col("node").alias("doc"), "root").union(tied.select(F.col("root").alias("doc"), "root").distinct()), "near-members")
    found = written(verify(members.df, met.df, slim, words, similarity_parts, tile, small_bytes), "near-links").df
    for table in (runs, met, members):
        table.drop()
    whole = components(found.select(F.col("doc").alias("a"), F.col("leader").alias("b")))
    linked_ = found.groupBy("doc").agg(F.sum("links").alias("n_links")).where("n_links > 0").join(whole.select(F.col("node").alias("doc"), "root"), "doc", "left")
    classes = sets.drop("keys").join(linked_, "doc", "left").select("a", "b", F.col("doc").alias("text_id"), "n_copies", F.coalesce("root", "doc").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return marks.drop("keys").join(classes, ["a", "b"], "left")


def similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """doc_id, class_id, text_id, n_copies, n_links of every row; `how` goes to `classed`."""
    out = classed(df, id_col, text_col, **how)
    alone = F.col("text_id").isNull() | F.col("doc_id").isNull()
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, F.col("doc_id")).otherwise(F.col("text_id")).alias("text_id"), F.when(alone, F.lit(1)).otherwise(F.col("n_copies")).cast("long").alias("n_copies"), F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `df` whose id is the least of its class; of repeated rows one stays, rows with a null id all do.

    Only sets with copies can hold repeated rows, so no others are shuffled whole.
    """
    firsts = written(similar(df, id_col, text_col).where("doc_id = class_id").groupBy(F.col("doc_id").alias("first")).agg(F.max(F.col("n_copies") > 1).alias("copies")), "near-firsts").df
    rows = df.select(F.col(id_col).cast("long").alias("id"), as_row(df).alias("row"))
    kept = rows.join(firsts.hint("merge"), rows["id"] == firsts["first"])
    once = kept.where("not copies").select("row").union(kept.where("copies").dropDuplicates(["id"]).select("row")).union(rows.where("id is null").select("row"))
    return once.select(*(F.col("row")[c].alias(c) for c in df.columns))

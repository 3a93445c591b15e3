import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from topospan.datasets import ranges, upsampling
from topospan.functions import basis as B
from topospan.functions.spline import Axes, decode, encode, parameters
from topospan.operators import contour, graph, prune, spatial, trace
from topospan.operators.solve import critical_points, level_roots
from topospan.operators.tables import written
from topospan.sources import files, grids, sinks


def test_bases_sum_to_one_and_match_finite_differences():
    knots, u, h = B.clamped_knots(9, 4), np.linspace(0.01, 0.99, 31), 1e-6
    assert np.allclose(B.design(u, 9, 4).sum(axis=1), 1)
    slope = (B.design(u + h, 9, 4) - B.design(u - h, 9, 4)) / (2 * h)
    assert np.allclose(slope, B.design(u, 9, 4, 1), atol=1e-5)
    assert len(B.greville(knots, 4)) == 9


def test_encode_matches_dense_least_squares(spark):
    axes = Axes([3, 3], [8, 7], [-1.0, -0.8], [1.0, 2.3])
    field = grids.rectilinear(spark, "gaussian_mixture", (15, 14))
    v = np.zeros((15, 14))
    for r in field.collect():
        v[r.i, r.j] = r.value
    w = [np.linalg.pinv(B.design(parameters(n), m, 3)) for n, m in ((15, 8), (14, 7))]
    want, got = w[0] @ v @ w[1].T, np.zeros((8, 7))
    controls = encode(field, (15, 14), axes)
    for r in controls.collect():
        got[r.i, r.j] = r.c
    assert np.allclose(got, want, atol=1e-9)
    n = [B.design(parameters(k), m, 3, d) for k, m, d in ((5, 8, 1), (6, 7, 0))]
    back = n[0] @ want @ n[1].T / 2
    for r in decode(controls, axes, [parameters(5), parameters(6)], [1, 0]).collect():
        assert abs(r.value - back[r.i, r.j]) < 1e-9


@pytest.mark.parametrize(("name", "n", "level", "want"), [("sinc_sum", 81, 0.33, (60, 40)), ("schwefel", 151, 500.0, (22, 21))])
def test_published_betti_numbers_of_level_sets(spark, name, n, level, want):
    b = graph.betti(*contour.level_set(grids.rectilinear(spark, name, (n, n)), level)).first()
    assert (b.components, b.loops) == want


def test_traced_level_set_has_the_published_betti_numbers_and_small_residuals(spark):
    two = 2 * math.pi
    axes = Axes([4, 4], [31, 31], [-two, -two], [two, two])
    controls = written(encode(grids.rectilinear(spark, "sinc_sum", (151, 151)), (151, 151), axes), "model").df
    points = written(trace.trace(level_roots(controls, axes, prune.level_spans(controls, axes, 0.79), "level", 0.79), controls, axes, "level", 0.79), "points").df
    assert points.agg(F.max("residual")).first()[0] < 1e-10
    b = graph.betti(*trace.stitch(points, None, axes.span_size()[0] / 8)).first()
    assert (b.components, b.loops) == (32, 28)
    kinds = dict(critical_points(controls, axes).groupBy("morse_index").count().collect())
    assert kinds == {0: 100, 1: 180, 2: 81}


def test_components_by_rounds_equal_those_of_one_task(spark):
    e = spark.range(400).where("id % 37 != 0").select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert sorted(graph.components(e).collect()) == sorted(graph.components(e, small_edges=0).collect())


def test_distance_joins_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    p = rng.random((200, 2))
    rows = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(p)], "id long, x double, y double")
    got = {(r.a, r.b) for r in spatial.pairs_within(rows, rows, 0.05).collect()}
    want = {(a, b) for a in range(200) for b in range(200) if ((p[a] - p[b]) ** 2).sum() <= 0.0025}
    assert got == want


def test_files_round_trip(spark, tmp_path):
    a = np.arange(24, dtype="<f4").reshape(4, 3, 2)
    (tmp_path / "v.raw").write_bytes(a.tobytes())  # C order of (k, j, i): the first index is fastest
    rows = files.raw(spark, str(tmp_path / "v.raw"), (2, 3, 4), starts=(0, 1, 0), counts=(2, 2, 4)).collect()
    assert len(rows) == 16
    assert all(r.value == a[r.k, r.j, r.i] for r in rows)
    (tmp_path / "m.bin").write_bytes(sinks.matrix_bytes([np.arange(6.0).reshape(2, 3)]))
    assert {(r.row, r.col): r.value for r in files.matrices(spark, str(tmp_path / "m.bin")).collect()} == {(i, j): 3.0 * i + j for i in range(2) for j in range(3)}
    v = spark.createDataFrame([(0, 0.5, 1.0, 2.0), (1, 1.5, 1.0, 3.0), (2, 2.5, 0.0, 1.0)], "vid long, x double, y double, z double")
    e = spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long")
    sinks.obj(v, e, str(tmp_path / "g.obj"))
    v2, e2 = files.obj(spark, str(tmp_path / "g.obj"))
    assert sorted(v2.collect()) == sorted(v.collect())
    assert sorted(e2.collect()) == sorted(e.collect())


def test_missing_values_are_filled_from_neighbours(spark):
    f = grids.lattice(spark, (5, 5)).withColumn("value", F.when((F.col("i") == 2) & (F.col("j") == 2), float("nan")).otherwise(F.lit(3.0)))
    assert {r.value for r in files.fill_missing(f).collect()} == {3.0}


def test_range_texts():
    assert ranges("1-2-3") == [1.0, 2.0, 3.0]
    assert upsampling("4", 3) == [4, 4, 4]
    with pytest.raises(ValueError, match="structured"):
        grids.analytic(None, "sinc", (3, 3), structured=True, random=True)


def test_whole_table_queries_against_brute_force(spark, tmp_path):
    from topospan.plans.queries import QUERIES

    rng = np.random.default_rng(5)
    orders = [(k, int(c)) for k, c in enumerate(rng.integers(1, 25, 60))]
    lines = [(int(o), int(s), float(q), int(d) / 100, int(t) / 100) for o, s, q, d, t in zip(rng.integers(0, 60, 150), rng.integers(1, 20, 150), rng.integers(1, 51, 150), rng.integers(0, 11, 150), rng.integers(0, 9, 150), strict=True)]
    points = [(k, [float(x), float(y)], 0) for k, (x, y) in enumerate(rng.random((120, 2)) * 0.12)]
    for name, rows, schema in (("orders", orders, "o_orderkey long, o_custkey long"), ("lineitem", lines, "l_orderkey long, l_suppkey long, l_quantity double, l_discount double, l_tax double"), ("embeddings", points, "vec_id long, embedding array<float>, label int")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    run = lambda name: [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()]

    def roots(nodes, near):
        up = {v: v for v in nodes}
        while True:
            new = {v: min([up[v], *(up[w] for w in near[v])]) for v in nodes}
            if new == up:
                return up
            up = new

    owner = dict(orders)
    edges = {(owner[o], s + 10000000) for o, s, *_ in lines}
    vertices = {v for e in edges for v in e}
    near = {v: {w for e in edges if v in e for w in e} for v in vertices}
    betti = QUERIES["agg10_betti_loops"](spark, str(tmp_path)).first()
    assert (betti.vertices, betti.edges) == (len(vertices), len(edges))
    assert betti.deg3 == sum(len(n) - 1 >= 3 for n in near.values())
    assert betti.components == len(set(roots(vertices, near).values()))
    number = {v: k for k, v in enumerate(sorted(v for v in vertices if v % 3))}
    assert sorted(run("flt14_subgraph")) == sorted((number[a], number[b]) for a, b in edges if a in number and b in number)
    xy = {k: np.array(e, np.float32).astype(float) for k, e, _ in points}
    near = {k: {m for m in xy if ((xy[k] - xy[m]) ** 2).sum() <= 0.0001} for k in xy}
    leader = roots(xy, near)
    assert dict(run("ded02_eps_clusters")) == leader
    first = {}
    for k in sorted(xy, key=lambda k: (*xy[k], k)):
        first.setdefault(leader[k], k)
    assert sorted(k for (k,) in run("ded01_eps_distinct")) == sorted(first.values())
    spans = {(int(q), round(d * 100)) for _, _, q, d, _ in lines}
    assert sorted(run("jn01_neighbour_spans")) == sorted((*a, *b) for a in spans for b in spans if max(abs(a[0] - b[0]), abs(a[1] - b[1])) <= 1)


def test_models_and_roots_round_trip(spark, tmp_path):
    from topospan.functions.spline import encode_adaptive

    field = grids.rectilinear(spark, "gaussian_mixture", (25, 24))
    axes, controls = encode_adaptive(field, (25, 24), [3, 3], [-1.0, -0.8], [1.0, 2.3], 1e-4, most_rounds=3)
    assert all(len(k) - p - 1 == n for k, p, n in zip(axes.knots, axes.degree, axes.controls, strict=True))
    sinks.model(controls, axes, str(tmp_path / "model"))
    back, c = files.model(spark, str(tmp_path / "model"))
    assert back.degree == axes.degree and back.controls == axes.controls
    assert all(np.array_equal(a, b) for a, b in zip(back.knots, axes.knots, strict=True))
    assert sorted(c.collect()) == sorted(controls.collect())
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.001, 0.0), (3, 1.0, 1.0)], "id long, x double, y double")
    sinks.roots(points, str(tmp_path / "roots"), eps=0.01, value=2.5)
    assert sorted(map(tuple, spark.read.csv(str(tmp_path / "roots"), header=True, inferSchema=True).collect())) == [(0.0, 0.0, 2.5), (1.0, 1.0, 2.5)]
    assert sinks.snapped_box([0.0], [10.0], [11], [(0.22, 0.78)]) == [(2.0, 8.0)]


def test_zoom_interpolates_and_keeps_ends(spark):
    from topospan.functions.spline import zoom_weights, zoomed

    assert np.allclose(zoom_weights(9, 1.0), np.eye(9))
    v = np.random.default_rng(3).random((9, 7))
    rows = spark.createDataFrame([(i, j, float(v[i, j])) for i in range(9) for j in range(7)], "i long, j long, value double")
    got = {(r.i, r.j): r.value for r in zoomed(rows, (9, 7), 5 / 9).collect()}
    assert len(got) == 5 * 4
    assert abs(got[0, 0] - v[0, 0]) < 1e-9 and abs(got[4, 3] - v[8, 6]) < 1e-9
    assert all(abs(got[i, j] - v[2 * i, 2 * j]) < 1e-9 for i in range(5) for j in range(4))

"""Registered queries of the field operators, each with the SQL that gives the same rows.

Names start with the operators' inventory ids. Values are rounded, ids are long, so that two
engines' results hash alike.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..datasets import DATASETS, ranges, upsampling
from ..functions import basis as B
from ..functions import radon
from ..functions.signals import SIGNALS, ackley_gradient_sql, line_integral_sql, sinc_derivatives_sql
from ..functions.spline import Axes, blend, blocks, control_range, decode, derivative_net, encode, encode_adaptive, error_norms, net_coordinates, owner_of_max_error, parameters, range_error, resample, sampled_ridge_function, sampled_steepness, zoom_weights, zoomed
from ..operators import contour, graph, prune, score, spatial, trace, track
from ..operators.solve import boundary_roots, critical_points, degenerate_points, jacobi_critical_points, level_roots, morse_index_2d
from ..operators.tables import written
from ..sources import files, grids, sinks
from .sql_text import betti_sql, crossings_sql, grid_sql, jacobi_sql, neighbours_sql, spread_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c, digits: int = 6):
    """Rounded, without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


# Signals, one query each, on grids that avoid their singular points.
_SHAPES = {"rotating_gaussian": (21, 21, 9), "ml": (11, 11, 11), "f17": (11, 11, 11), "f18": (6, 6, 6, 6), "f16": (20, 20)}
_IDS = {name: f"fn{k:02d}_{name}" for k, name in enumerate(SIGNALS, 1)}


def _signal_query(name):
    shape = _SHAPES.get(name, (40, 40))
    names = ", ".join(grids.INDEX[: len(shape)])
    options = {"scale": 2.0, "frequency": 0.5} if name in ("sine", "cosine", "ncosp1", "sinc", "ml") else {}

    @query(_IDS[name], f"SELECT {names}, round(value, 6) + 0.0 AS value FROM {grid_sql(name, shape, **options)}")
    def run(spark, sf_dir):
        return grids.rectilinear(spark, name, shape, **options).select(*grids.INDEX[: len(shape)], r("value").alias("value"))


for _name in SIGNALS:
    _signal_query(_name)


@query("fn22_line_integral", f"SELECT k, round({line_integral_sql('x0', 'y0', 'x1', 'y1')}, 6) + 0.0 AS value FROM (SELECT CAST(k AS BIGINT) AS k, k * 0.1e0 AS x0, k * 0.05e0 AS y0, 3e0 - k * 0.02e0 AS x1, 1e0 + k * 0.07e0 AS y1 FROM range(60) t(k))")
def fn22(spark, sf_dir):
    p = spark.range(60).select(F.col("id").alias("k"), F.expr("id * 0.1e0").alias("x0"), F.expr("id * 0.05e0").alias("y0"), F.expr("3e0 - id * 0.02e0").alias("x1"), F.expr("1e0 + id * 0.07e0").alias("y1"))
    return p.select("k", r(F.expr(line_integral_sql("x0", "y0", "x1", "y1"))).alias("value"))


_ACKLEY = ackley_gradient_sql(["x", "y"])
_SINC = sinc_derivatives_sql("x")


@query("fn23_closed_derivatives", f"SELECT i, j, round({_ACKLEY[0]}, 6) + 0.0 AS ax, round({_ACKLEY[1]}, 6) + 0.0 AS ay, round({_SINC[1]}, 6) + 0.0 AS s1, round({_SINC[2]}, 6) + 0.0 AS s2 FROM {grid_sql('ackley', (40, 40))}")
def fn23(spark, sf_dir):
    g = grids.rectilinear(spark, "ackley", (40, 40))
    return g.select("i", "j", r(F.expr(_ACKLEY[0])).alias("ax"), r(F.expr(_ACKLEY[1])).alias("ay"), r(F.expr(_SINC[1])).alias("s1"), r(F.expr(_SINC[2])).alias("s2"))


# Sources
@query("src01_analytic_grid", f"SELECT i, j, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(value, 6) + 0.0 AS value FROM {grid_sql('rastrigin', (61, 31))}")
def src01(spark, sf_dir):
    return grids.rectilinear(spark, "rastrigin", (61, 31)).select("i", "j", r("x").alias("x"), r("y").alias("y"), r("value").alias("value"))


@query("src02_noise_bounds", "SELECT CAST(40000 AS BIGINT) AS n, true AS unbiased")
def src02(spark, sf_dir):
    a = grids.rectilinear(spark, lambda x, y: x * 0 + 1, (200, 200), (0, 0), (1, 1), noise=0.1, seed=7)
    return a.agg(F.count("*").alias("n"), ((F.abs(F.avg("value") - 1) < 0.01) & (F.abs(F.stddev("value") - 0.1) < 0.01)).alias("unbiased"))


@query("src03_twist", f"SELECT i, j, round(x + 0.3 * sin(y), 6) + 0.0 AS x, round(y + 0.3 * sin(x), 6) + 0.0 AS y FROM {grid_sql('sinc_sum', (31, 31))}")
def src03(spark, sf_dir):
    return grids.twisted(grids.rectilinear(spark, "sinc_sum", (31, 31)), 0.3).select("i", "j", r("x").alias("x"), r("y").alias("y"))


@query("src04_rotation", f"SELECT i, j, round(x * cos(0.7e0) - y * sin(0.7e0), 6) + 0.0 AS x, round(x * sin(0.7e0) + y * cos(0.7e0), 6) + 0.0 AS y FROM {grid_sql('sinc_sum', (31, 31))}")
def src04(spark, sf_dir):
    return grids.rotated(grids.rectilinear(spark, "sinc_sum", (31, 31)), 0.7).select("i", "j", r("x").alias("x"), r("y").alias("y"))


@query("src05_random_cloud", "SELECT true AS inside, true AS outside_voids, true AS enough")
def src05(spark, sf_dir):
    voids = [((0.3, 0.3), 0.1), ((0.7, 0.3), 0.1), ((0.3, 0.7), 0.1), ((0.7, 0.7), 0.1)]
    c = grids.random_cloud(spark, "f16", 20000, (0, 0), (1, 1), voids, seed=3)
    clear = [(F.col("x") - v[0]) * (F.col("x") - v[0]) + (F.col("y") - v[1]) * (F.col("y") - v[1]) >= rad * rad for v, rad in voids]
    return c.agg(F.bool_and(F.col("x").between(0, 1) & F.col("y").between(0, 1)).alias("inside"), F.bool_and(clear[0] & clear[1] & clear[2] & clear[3]).alias("outside_voids"), (F.abs(F.count("*") - 20000) < 1000).alias("enough"))


@query("src07_pairs_1d", "SELECT CAST(k AS BIGINT) AS i, k * 0.5e0 AS x, k * k * 1e0 AS value FROM range(20) t(k)")
def src07(spark, sf_dir):
    return grids.pairs_1d(spark, [k * 0.5 for k in range(20)], [k * k for k in range(20)])


@query("src22_level_scan", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 950 AND c_acctbal < 1050")
def src22(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("value"))
    return files.critical_points(c, 1000.0, 50.0).select("c_custkey", F.col("value").alias("c_acctbal"))


# Fields from tables: quantity x discount, with the mean price and the mean tax.
_FIELD = "(SELECT CAST(l_quantity AS BIGINT) - 1 AS i, CAST(round(l_discount * 100) AS BIGINT) AS j, round(avg(CAST({c} AS DECIMAL(18,4))), 2) AS value FROM lineitem GROUP BY 1, 2)"


def lineitem_field(spark, sf_dir, column="l_extendedprice") -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select((F.col("l_quantity").cast("long") - 1).alias("i"), F.round(F.col("l_discount") * 100).cast("long").alias("j"), F.col(column).cast("decimal(18,4)").alias("v"))
    return l.groupBy("i", "j").agg(F.round(F.avg("v").cast("double"), 2).alias("value")).withColumns({"x": F.col("i").cast("double"), "y": F.col("j").cast("double")})


@query("agg02_field_bounds", "SELECT min(l_quantity) AS x_min, max(l_quantity) AS x_max, min(l_discount) AS y_min, max(l_discount) AS y_max FROM lineitem")
def agg02(spark, sf_dir):
    return grids.bounds(table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_discount").alias("y")))


@query("ext01_critical_points_table", neighbours_sql(_FIELD.format(c="l_extendedprice")) + " SELECT * FROM q WHERE type IS NOT NULL")
def ext01_table(spark, sf_dir):
    return contour.discrete_critical_points(lineitem_field(spark, sf_dir))


@query("ext01_critical_points", neighbours_sql(grid_sql("sinc_sum", (61, 61), digits=6)) + " SELECT type, count(*) AS n FROM q WHERE type IS NOT NULL GROUP BY type")
def ext01(spark, sf_dir):
    f = grids.rectilinear(spark, "sinc_sum", (61, 61)).withColumn("value", F.round("value", 6))
    return contour.discrete_critical_points(f).groupBy("type").agg(F.count("*").alias("n"))


def _contour(name, n, level):
    @query(f"ext03_contour_{name}_{str(level).replace('.', '_')}", betti_sql(crossings_sql(grid_sql(name, n), level)))
    def run(spark, sf_dir):
        return graph.betti(*contour.level_set(grids.rectilinear(spark, name, n), level))


for _case in (("sinc_sum", (81, 81), 0.33), ("sinc_sum", (81, 81), 0.79), ("schwefel", (151, 151), 100.0), ("schwefel", (151, 151), 500.0)):
    _contour(*_case)


@query("ext03_contour_table", f"WITH {crossings_sql(_FIELD.format(c='l_extendedprice'), 38250.5)} SELECT src, dst FROM e")
def ext03_table(spark, sf_dir):
    return contour.level_set(lineitem_field(spark, sf_dir), 38250.5)[1].select("src", "dst")


@query("ext04_jacobi_set", betti_sql(jacobi_sql(grid_sql("gaussian_pair1", (101, 101)), grid_sql("gaussian_pair2", (101, 101))) + ", " + crossings_sql("h", 0.0)))
def ext04(spark, sf_dir):
    h = contour.jacobi_field(grids.rectilinear(spark, "gaussian_pair1", (101, 101)), grids.rectilinear(spark, "gaussian_pair2", (101, 101)))
    return graph.betti(*contour.level_set(h, 0.0))


# Graph operators on orders
_EDGES = "(SELECT DISTINCT o_custkey AS src, 10000000 + l_suppkey AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"


def order_edges(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    return o.join(l, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("src"), (F.col("l_suppkey") + 10000000).alias("dst")).distinct()


@query("agg10_betti_orders", f"WITH e AS {_EDGES}, d AS (SELECT x, count(*) AS n FROM (SELECT src AS x FROM e UNION ALL SELECT dst FROM e) GROUP BY x) SELECT (SELECT count(*) FROM d) AS vertices, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM d WHERE n >= 3) AS deg3")
def agg10(spark, sf_dir):
    e = order_edges(spark, sf_dir)
    v = e.select(F.col("src").alias("vid")).union(e.select("dst")).distinct()
    return graph.betti(v, e).select("vertices", "edges", "deg3")


@query("agg10_betti_loops")
def agg10_loops(spark, sf_dir):
    e = written(order_edges(spark, sf_dir), "edges").df
    v = e.select(F.col("src").alias("vid")).union(e.select("dst")).distinct()
    return graph.betti(v, e)


@query("agg10_components_regions", "SELECT n_nationkey + CAST(0 AS BIGINT) AS node, first_value(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) + CAST(0 AS BIGINT) AS root FROM nation")
def agg10_regions(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), "n_regionkey")
    line = W.partitionBy("n_regionkey").orderBy("k")
    return graph.components(n.select(F.col("k").alias("src"), F.coalesce(F.lead("k").over(line), F.col("k")).alias("dst"))).select("node", "root")


# Point sets from embeddings: the first two components, even against odd ids.
_P = "(SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(label AS BIGINT) AS type FROM embeddings WHERE vec_id % 2 = {k})"


_ALL = _P.partition(" WHERE ")[0] + ")"


def half(spark, sf_dir, k) -> DataFrame:
    return all_points(spark, sf_dir).where(F.col("id") % 2 == k)


def all_points(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), F.col("label").cast("long").alias("type"))


_NEAR = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.0004"


@query("ded04_eps_semi_join", f"SELECT id FROM {_P.format(k=0)} a WHERE EXISTS (SELECT 1 FROM {_P.format(k=1)} b WHERE {_NEAR})")
def ded04(spark, sf_dir):
    return spatial.near_any(half(spark, sf_dir, 0), half(spark, sf_dir, 1), 0.02).select("id")


@query("sj01_unmatched", f"SELECT id FROM {_P.format(k=0)} a WHERE NOT EXISTS (SELECT 1 FROM {_P.format(k=1)} b WHERE {_NEAR})")
def sj01_unmatched(spark, sf_dir):
    return spatial.near_none(half(spark, sf_dir, 0), half(spark, sf_dir, 1), 0.02).select("id")


@query("sj01_overlap", f"WITH a AS {_P.format(k=0)}, b AS {_P.format(k=1)}, p AS (SELECT a.id AS a, b.id AS b, a.type AS ta, b.type AS tb, row_number() OVER (PARTITION BY a.id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.id) AS k FROM a JOIN b ON {_NEAR}) SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(DISTINCT a) FROM p) AS matched_a, (SELECT count(DISTINCT b) FROM p) AS matched_b, (SELECT count(*) FROM p WHERE k = 1 AND ta = tb) AS same_type, (SELECT count(*) FROM a) - (SELECT count(DISTINCT a) FROM p) AS unmatched_a, (SELECT count(*) FROM b) - (SELECT count(DISTINCT b) FROM p) AS unmatched_b")
def sj01(spark, sf_dir):
    return spatial.overlap(half(spark, sf_dir, 0), half(spark, sf_dir, 1), 0.02)


@query("jn03_nearest", f"SELECT a, b FROM (SELECT a.id AS a, b.id AS b, row_number() OVER (PARTITION BY a.id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.id) AS k FROM {_P.format(k=0)} a JOIN {_P.format(k=1)} b ON {_NEAR}) WHERE k = 1")
def jn03(spark, sf_dir):
    return spatial.nearest(half(spark, sf_dir, 0), half(spark, sf_dir, 1), 0.02).select("a", "b")


@query("ded01_eps_distinct", f"WITH RECURSIVE p AS {_ALL}, n AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.0001), reach(a, b) AS (SELECT a, b FROM n UNION SELECT reach.a, n.b FROM reach JOIN n ON n.a = reach.b), g AS (SELECT a AS id, min(b) AS leader FROM reach GROUP BY a), k AS (SELECT p.id, row_number() OVER (PARTITION BY leader ORDER BY x, y, p.id) AS k FROM p JOIN g ON p.id = g.id) SELECT id FROM k WHERE k = 1")
def ded01(spark, sf_dir):
    return spatial.eps_distinct(all_points(spark, sf_dir), 0.01).select("id")


@query("ded02_eps_clusters", f"WITH RECURSIVE p AS {_ALL}, n AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.0001), reach(a, b) AS (SELECT a, b FROM n UNION SELECT reach.a, n.b FROM reach JOIN n ON n.a = reach.b) SELECT a AS id, min(b) AS leader FROM reach GROUP BY a")
def ded02(spark, sf_dir):
    return spatial.eps_clusters(all_points(spark, sf_dir), 0.01)


@query("jn02_assign_span", "SELECT p_partkey, least(CAST(floor((p_size - 1) / 49e0 * 7) AS BIGINT), 6) + 3 AS si FROM part")
def jn02(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"))
    return spatial.assign_span(p, [7], [1.0], [50.0], [3], ["x"]).select("p_partkey", "si")


@query("jn01_neighbour_spans", "WITH s AS (SELECT DISTINCT CAST(l_quantity AS BIGINT) AS si, CAST(round(l_discount * 100) AS BIGINT) AS sj FROM lineitem) SELECT a.si, a.sj, b.si AS ni, b.sj AS nj FROM s a JOIN s b ON abs(a.si - b.si) <= 1 AND abs(a.sj - b.sj) <= 1")
def jn01(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("long").alias("si"), F.round(F.col("l_discount") * 100).cast("long").alias("sj"))
    return spatial.neighbour_spans(l).select("si", "sj", "ni", "nj")


# Splines. Small tables of weights come from the same basis functions, as literals.
_AX = Axes([3, 3], [9, 8], list(DATASETS["gaussian_mixture"].mins), list(DATASETS["gaussian_mixture"].maxs))
_N = (21, 25)


def _values(m: np.ndarray, name: str) -> str:
    rows = ", ".join(f"({a}, {b}, {float(m[a, b])!r}e0)" if "e" not in repr(float(m[a, b])) else f"({a}, {b}, {float(m[a, b])!r})" for a in range(m.shape[0]) for b in range(m.shape[1]) if m[a, b])
    return f"{name}(p, q, w) AS (SELECT * FROM (VALUES {rows}))"


def _fit(d: int) -> np.ndarray:
    n = B.design(parameters(_N[d]), _AX.controls[d], _AX.degree[d])
    return np.linalg.solve(n.T @ n, n.T)


_ENCODE = f"{_values(_fit(0), 'wx')}, {_values(_fit(1), 'wy')}, c AS (SELECT CAST(wx.p AS BIGINT) AS i, CAST(wy.p AS BIGINT) AS j, sum(wx.w * wy.w * g.value) AS c FROM {grid_sql('gaussian_mixture', _N)} g JOIN wx ON wx.q = g.i JOIN wy ON wy.q = g.j GROUP BY 1, 2)"


def _model(spark) -> DataFrame:
    return encode(grids.rectilinear(spark, "gaussian_mixture", _N), _N, _AX)


@query("spl01_encode", f"WITH {_ENCODE} SELECT i, j, round(c, 6) + 0.0 AS c FROM c")
def spl01(spark, sf_dir):
    return _model(spark).select("i", "j", r("c").alias("c"))


def _decoded(n, dx=0, dy=0) -> str:
    bx = B.design(parameters(n[0]), _AX.controls[0], _AX.degree[0], dx) / _AX.range(0) ** dx
    by = B.design(parameters(n[1]), _AX.controls[1], _AX.degree[1], dy) / _AX.range(1) ** dy
    return f"{_values(bx, 'bx')}, {_values(by, 'by_')}, d AS (SELECT CAST(bx.p AS BIGINT) AS i, CAST(by_.p AS BIGINT) AS j, sum(bx.w * by_.w * c.c) AS value FROM c JOIN bx ON bx.q = c.i JOIN by_ ON by_.q = c.j GROUP BY 1, 2)"


def _decode_query(name, dx, dy):
    @query(name, f"WITH {_ENCODE}, {_decoded((15, 17), dx, dy)} SELECT i, j, round(value, 5) + 0.0 AS value FROM d")
    def run(spark, sf_dir):
        return decode(_model(spark), _AX, [parameters(15), parameters(17)], [dx, dy]).select("i", "j", r("value", 5).alias("value"))


for _case in (("spl04_decode", 0, 0), ("spl11_gradient_x", 1, 0), ("spl11_gradient_y", 0, 1), ("spl11_hessian_xy", 1, 1)):
    _decode_query(*_case)


@query("spl17_range_error", f"WITH {_ENCODE}, {_decoded(_N)}, e AS (SELECT abs(g.value - d.value) AS e, g.value AS v FROM {grid_sql('gaussian_mixture', _N)} g JOIN d ON d.i = g.i AND d.j = g.j) SELECT count(*) AS n, round(max(e), 6) AS max_error, round(sqrt(avg(e * e)), 6) AS rms_error, round(max(e) / (max(v) - min(v)), 6) AS max_relative FROM e")
def spl17(spark, sf_dir):
    e = range_error(grids.rectilinear(spark, "gaussian_mixture", _N), decode(_model(spark), _AX, [parameters(n) for n in _N]), 2)
    return e.select("n", *(F.round(c, 6).alias(c) for c in ("max_error", "rms_error", "max_relative")))


_NET = _AX.degree[0] / _AX.range(0)


@query("spl08_derivative_net", f"WITH {_ENCODE}, k(i, w) AS (SELECT * FROM (VALUES {', '.join(f'({i}, {float(_NET / (_AX.knots[0][i + 4] - _AX.knots[0][i + 1]))!r}e0)' for i in range(8))})) SELECT a.i, a.j, round((b.c - a.c) * k.w, 5) + 0.0 AS c FROM c a JOIN c b ON b.i = a.i + 1 AND b.j = a.j JOIN k ON k.i = a.i")
def spl08(spark, sf_dir):
    return derivative_net(_model(spark), _AX, 0).select("i", "j", r("c", 5).alias("c"))


_D0 = f"d0 AS (SELECT a.i, a.j, (b.c - a.c) AS c FROM c a JOIN c b ON b.i = a.i + 1 AND b.j = a.j), d1 AS (SELECT a.i, a.j, (b.c - a.c) AS c FROM c a JOIN c b ON b.j = a.j + 1 AND b.i = a.i)"


@query("flt01_span_filter", f"WITH {_ENCODE}, {_D0}, s AS (SELECT i.i + 3 AS si, j.j + 3 AS sj FROM range(6) i(i), range(5) j(j)), m0 AS (SELECT si, sj FROM s JOIN d0 ON d0.i BETWEEN si - 3 AND si - 1 AND d0.j BETWEEN sj - 3 AND sj GROUP BY si, sj HAVING max(c) >= 0 AND min(c) <= 0), m1 AS (SELECT si, sj FROM s JOIN d1 ON d1.i BETWEEN si - 3 AND si AND d1.j BETWEEN sj - 3 AND sj - 1 GROUP BY si, sj HAVING max(c) >= 0 AND min(c) <= 0) SELECT CAST(m0.si AS BIGINT) AS si, CAST(m0.sj AS BIGINT) AS sj FROM m0 JOIN m1 ON m0.si = m1.si AND m0.sj = m1.sj")
def flt01(spark, sf_dir):
    return prune.critical_spans(_model(spark), _AX, slack=0.0).select("si", "sj")


@query("flt06_level_spans", f"WITH {_ENCODE}, s AS (SELECT i.i + 3 AS si, j.j + 3 AS sj FROM range(6) i(i), range(5) j(j)) SELECT CAST(si AS BIGINT) AS si, CAST(sj AS BIGINT) AS sj FROM s JOIN c ON c.i BETWEEN si - 3 AND si AND c.j BETWEEN sj - 3 AND sj GROUP BY si, sj HAVING max(c) >= 0.7 AND min(c) <= 0.7")
def flt06(spark, sf_dir):
    return prune.level_spans(_model(spark), _AX, 0.7, 0.0).select("si", "sj")


_SPANS = "(SELECT s AS span_id, s % 6 + 3 AS si, s // 6 + 3 AS sj, -1 + (s % 6) * 2 / 6e0 AS lo_0, -1 + (s % 6 + 1) * 2 / 6e0 AS hi_0, -0.8e0 + (s // 6) * 3.1e0 / 5 AS lo_1, -0.8e0 + (s // 6 + 1) * 3.1e0 / 5 AS hi_1 FROM range(30) t(s))"


@query("flt03_overlapping_spans", f"SELECT CAST(span_id AS BIGINT) AS span_id FROM {_SPANS} WHERE hi_0 >= -0.5 AND lo_0 <= 0.1 AND hi_1 >= 0.1 AND lo_1 <= 1")
def flt03(spark, sf_dir):
    return prune.overlapping(prune.all_spans(spark, _AX), [(-0.5, 0.1), (0.1, 1.0)]).select("span_id")


@query("flt04_contained_spans", f"SELECT CAST(span_id AS BIGINT) AS span_id FROM {_SPANS} WHERE lo_0 >= -0.8 AND hi_0 <= 0.8 AND lo_1 >= -0.5 AND hi_1 <= 2")
def flt04(spark, sf_dir):
    return prune.contained(prune.all_spans(spark, _AX), [(-0.8, 0.8), (-0.5, 2.0)]).select("span_id")


@query("flt05_boundary_spans", f"SELECT CAST(span_id AS BIGINT) AS span_id FROM {_SPANS} WHERE si IN (3, 8) OR sj IN (3, 7)")
def flt05(spark, sf_dir):
    return prune.boundary(prune.all_spans(spark, _AX), _AX).select("span_id")


@query("flt13_points_in_box", "SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 20 AND p_retailprice BETWEEN 1000 AND 1500")
def flt13(spark, sf_dir):
    return files.box(table(spark, sf_dir, "part"), {"p_size": (5, 20), "p_retailprice": (1000, 1500)}).select("p_partkey")


@query("flt17_clamp", "SELECT c_custkey, round(greatest(0e0, least(5000e0, c_acctbal)), 2) AS c_acctbal FROM customer")
def flt17(spark, sf_dir):
    return files.clamped(table(spark, sf_dir, "customer"), {"c_acctbal": (0, 5000)}).select("c_custkey", F.round("c_acctbal", 2).alias("c_acctbal"))


@query("prj04_linear_index", "SELECT CAST(k AS BIGINT) AS k, CAST(k % 5 AS BIGINT) AS i, CAST((k // 5) % 4 AS BIGINT) AS j, CAST(k // 20 AS BIGINT) AS m FROM range(120) t(k)")
def prj04(spark, sf_dir):
    i, j, m = files.unlinear_index(F.col("id"), (5, 4, 6))
    back = spark.range(120).select(i.alias("i"), j.alias("j"), m.alias("m"))
    return back.select(files.linear_index([F.col("i"), F.col("j"), F.col("m")], (5, 4, 6)).alias("k"), "i", "j", "m")


_UP = upsampling("3-2", 2)


@query("prj07_resample", f"WITH {_ENCODE}, {_decoded((6 * _UP[0] + 1, 5 * _UP[1] + 1))} SELECT i, j, round(-1 + i * 2 / 18e0, 6) + 0.0 AS x, round(-0.8e0 + j * 3.1e0 / 10, 6) + 0.0 AS y, round(value, 5) + 0.0 AS value FROM d")
def prj07(spark, sf_dir):
    return resample(_model(spark), _AX, _UP).select("i", "j", r("x").alias("x"), r("y").alias("y"), r("value", 5).alias("value"))


@query("prj10_two_fields", f"SELECT a.i, a.j, round(a.value, 6) + 0.0 AS f, round(b.value, 6) + 0.0 AS g FROM {grid_sql('gaussian_pair1', (31, 31))} a JOIN {grid_sql('gaussian_pair2', (31, 31))} b ON a.i = b.i AND a.j = b.j")
def prj10(spark, sf_dir):
    a, b = (grids.rectilinear(spark, n, (31, 31)).select("i", "j", r("value").alias(c)) for n, c in (("gaussian_pair1", "f"), ("gaussian_pair2", "g")))
    return a.join(b, ["i", "j"])


@query("agg07_morse_index", "SELECT CASE WHEN abs(a * c - b * b) < 1e-13 THEN -1 WHEN a * c - b * b < 0 THEN 1 WHEN a < 0 THEN 2 ELSE 0 END AS morse_index, count(*) AS n FROM (SELECT l_tax - 0.04 AS a, l_discount - 0.05 AS b, l_quantity - 25 AS c FROM lineitem) GROUP BY 1")
def agg07(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    return l.select(morse_index_2d(F.col("l_tax") - 0.04, F.col("l_discount") - 0.05, F.col("l_quantity") - 25).alias("morse_index")).groupBy("morse_index").agg(F.count("*").alias("n"))


@query("agg01_error_summary", "SELECT round(min(e), 4) AS least, round(max(e), 4) AS largest, round(avg(CAST(e AS DECIMAL(18,6))), 4) AS mean, count(*) AS n FROM (SELECT round(abs(l_extendedprice - l_quantity * 1500), 4) AS e FROM lineitem)")
def agg01(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select(F.round(F.abs(F.col("l_extendedprice") - F.col("l_quantity") * 1500), 4).alias("e"))
    return e.agg(F.round(F.min("e"), 4).alias("least"), F.round(F.max("e"), 4).alias("largest"), F.round(F.avg(F.col("e").cast("decimal(18,6)")).cast("double"), 4).alias("mean"), F.count("*").alias("n"))


@query("agg05_statistical_mode", "SELECT p_brand, p_size AS mode FROM (SELECT p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_size) AS k FROM part GROUP BY p_brand, p_size) WHERE k = 1")
def agg05(spark, sf_dir):
    return score.statistical_mode(table(spark, sf_dir, "part"), "p_brand", "p_size")


@query("agg09_max_error_owner", "SELECT max(e) AS max_error, arg_max(b, (e, -b)) AS block_id FROM (SELECT l_suppkey % 16 AS b, max(l_extendedprice) AS e FROM lineitem GROUP BY 1)")
def agg09(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 16).alias("block_id")).agg(F.max("l_extendedprice").alias("error"))
    return owner_of_max_error(e)


@query("agg11_persistence_levels", "SELECT k * 157e0 / 199 AS level, (SELECT count(*) FROM events WHERE value > k * 157e0 / 199) AS n FROM range(200) t(k)")
def agg11(spark, sf_dir):
    return score.persistence_counts(table(spark, sf_dir, "events").select(F.col("value").alias("persistence")), 200, 157.0)


@query("spl16_error_norms", f"SELECT round(avg(e), 6) AS l1, round(sqrt(avg(e * e)), 6) AS l2, round(max(e), 6) AS linf FROM (SELECT abs(value - (0.25e0 * x)) AS e FROM {grid_sql('gaussian_pair1', (61, 61))} WHERE x BETWEEN 0.2 AND 0.8 AND y BETWEEN 0.1 AND 0.5)")
def spl16(spark, sf_dir):
    g = grids.rectilinear(spark, "gaussian_pair1", (61, 61)).withColumn("truth", 0.25 * F.col("x"))
    return error_norms(g, 2, box=[(0.2, 0.8), (0.1, 0.5)]).select(*(F.round(c, 6).alias(c) for c in ("l1", "l2", "linf")))


@query("utl07_blend", "SELECT i, j, round(10e0 * i + j, 6) AS value FROM (SELECT CAST(a AS BIGINT) AS i, CAST(b AS BIGINT) AS j FROM range(21) x(a), range(21) y(b))")
def utl07(spark, sf_dir):
    g = grids.lattice(spark, (21, 21)).withColumns({"x": F.col("i") / 20, "y": F.col("j") / 20, "value": 10.0 * F.col("i") + F.col("j")})
    return blend(blocks(g, (2, 3), (0.0, 0.0), (1.0, 1.0), 0.11)).select("i", "j", F.round("value", 6).alias("value"))


@query("spl21_trapezoid", "SELECT CAST(k AS BIGINT) AS k, round(sum((v + w) / 2 * 0.01), 6) AS value FROM (SELECT k, sin(k * 0.1 + s * 0.01) AS v, sin(k * 0.1 + (s + 1) * 0.01) AS w FROM range(20) a(k), range(100) b(s)) GROUP BY k")
def spl21(spark, sf_dir):
    t = spark.range(20).select(F.col("id").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(100))).alias("s"))
    return radon.trapezoid(t.select("k", "s", F.sin(F.col("k") * 0.1 + F.col("s") * 0.01).alias("v")), ["k"], "s", "v", 0.01).select("k", F.round("value", 6).alias("value"))


@query("spl20_radon_lines", "SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, round(b * 0.1e0 * cos(a * 0.2e0) - 0.5e0 * sin(a * 0.2e0), 6) + 0.0 AS x, round(b * 0.1e0 * sin(a * 0.2e0) + 0.5e0 * cos(a * 0.2e0), 6) + 0.0 AS y FROM range(12) p(a), range(10) q(b)")
def spl20(spark, sf_dir):
    g = grids.lattice(spark, (12, 10)).select(F.col("i").alias("a"), F.col("j").alias("b"))
    x, y = radon.to_cartesian(F.lit(0.5), F.col("b") * 0.1, F.col("a") * 0.2)
    return g.select("a", "b", r(x).alias("x"), r(y).alias("y"))


@query("utl_ranges", "SELECT * FROM (VALUES (1e0, 2e0, 3e0, 4e0)) t(a, b, c, d)")
def utl_ranges(spark, sf_dir):
    return spark.createDataFrame([tuple(ranges("1-2-3-4"))], "a double, b double, c double, d double")


@query("snk09_triangles", "SELECT CAST(2 * s AS BIGINT) AS n, CAST(v AS BIGINT) AS a, CAST(v + 1 AS BIGINT) AS b, CAST(v + 7 AS BIGINT) AS c FROM (SELECT s, (s // 6) * 7 + s % 6 AS v FROM range(30) t(s)) UNION ALL SELECT 2 * s + 1, v + 1, v + 8, v + 7 FROM (SELECT s, (s // 6) * 7 + s % 6 AS v FROM range(30) t(s))")
def snk09(spark, sf_dir):
    return sinks.triangles(7, 6, spark)


_KINDS = ("click", "error", "purchase", "signup", "view")


@query("snk12_time_slices", "SELECT CAST(extract(hour FROM ts) AS BIGINT) AS i, CAST(user_id % 4 AS BIGINT) AS j, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{e}') AS t_{k}" for k, e in enumerate(_KINDS)) + " FROM events GROUP BY 1, 2")
def snk12(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("t", F.array_position(F.array(*map(F.lit, _KINDS)), F.col("event_type")) - 1)
    s = e.groupBy(F.hour("ts").cast("long").alias("i"), (F.col("user_id") % 4).alias("j"), "t").agg(F.count("*").alias("value"))
    return sinks.time_slices(s, list(range(len(_KINDS)))).na.fill(0)


@query("ded06_merge_vertices", "WITH p AS (SELECT p_partkey AS vid, p_retailprice AS x, CAST(p_size AS DOUBLE) AS y FROM part), m AS (SELECT vid, min(vid) OVER (PARTITION BY CAST(round(x / 50) AS BIGINT), CAST(round(y / 50) AS BIGINT)) AS n FROM p) SELECT DISTINCT n AS vid FROM m")
def ded06(spark, sf_dir):
    v = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("vid"), F.col("p_retailprice").alias("x"), F.col("p_size").cast("double").alias("y"))
    e = v.select(F.col("vid").alias("src"), (F.col("vid") + 1).alias("dst"))
    return graph.merged(v, e, 50.0)[0].select("vid")


@query("flt14_subgraph", f"WITH e AS {_EDGES}, v AS (SELECT src AS vid FROM e UNION SELECT dst FROM e), k AS (SELECT vid, row_number() OVER (ORDER BY vid) - 1 AS n FROM v WHERE vid % 3 <> 0) SELECT a.n AS src, b.n AS dst FROM e JOIN k a ON a.vid = e.src JOIN k b ON b.vid = e.dst")
def flt14(spark, sf_dir):
    e = order_edges(spark, sf_dir)
    v = e.select(F.col("src").alias("vid")).union(e.select("dst")).distinct()
    return graph.induced(v, e, F.col("vid") % 3 != 0)[1]


_H = math.pi / 2


@query("ext05_tracking", f"WITH p AS (SELECT t, id, type, x, y FROM (SELECT CAST(t AS BIGINT) AS t, CAST(t * 10 + k AS BIGINT) AS id, CAST(k % 2 AS BIGINT) AS type, k + 0.1e0 * cos(t * {_H!r} / 4) AS x, 0.1e0 * sin(t * {_H!r} / 4) AS y FROM range(8) a(t), range(6) b(k))), m AS (SELECT a.t, a.id, b.id AS next_id, row_number() OVER (PARTITION BY a.id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.id) AS k FROM p a JOIN p b ON b.t = a.t + 1 AND a.type = b.type AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.25) SELECT t, id, next_id FROM m WHERE k = 1")
def ext05(spark, sf_dir):
    g = grids.lattice(spark, (8, 6))
    p = g.select(F.col("i").alias("t"), (F.col("i") * 10 + F.col("j")).alias("id"), (F.col("j") % 2).alias("type"), F.expr(f"j + 0.1e0 * cos(i * {_H!r} / 4)").alias("x"), F.expr(f"0.1e0 * sin(i * {_H!r} / 4)").alias("y"))
    return contour.nearest_over_time(p, 0.5)


# Solvers and tracers: no SQL; residuals and counts are tested instead.
def _sinc_model(spark) -> tuple[DataFrame, Axes]:
    d = DATASETS["sinc_sum"]
    axes = Axes([4, 4], [31, 31], list(d.mins[:2]), list(d.maxs[:2]))
    return written(encode(grids.rectilinear(spark, "sinc_sum", (151, 151)), (151, 151), axes), "model").df, axes


@query("rt01_critical_points")
def rt01(spark, sf_dir):
    controls, axes = _sinc_model(spark)
    return critical_points(controls, axes).select("id", "x", "y", "value", "morse_index", "iterations")


def _traced_level(spark, level=0.33):
    controls, axes = _sinc_model(spark)
    roots = level_roots(controls, axes, prune.level_spans(controls, axes, level), "level", level)
    return trace.trace(roots, controls, axes, "level", level), controls, axes


@query("tr08_level_traces")
def tr08(spark, sf_dir):
    return _traced_level(spark)[0]


@query("jn08_level_graph_betti")
def jn08(spark, sf_dir):
    points, _, axes = _traced_level(spark)
    return graph.betti(*trace.stitch(points, None, axes.span_size()[0] / 8))


@query("tr11_ridge_valley_graph")
def tr11(spark, sf_dir):
    d = DATASETS["gaussian_mixture"]
    axes = Axes([4, 4], [25, 38], list(d.mins), list(d.maxs))
    controls = written(encode(grids.rectilinear(spark, "gaussian_mixture", (100, 151)), (100, 151), axes), "model").df
    roots = level_roots(controls, axes, prune.all_spans(spark, axes), "ridge")
    vertices, edges = trace.stitch(trace.trace(roots, controls, axes, "ridge"), critical_points(controls, axes), axes.span_size()[0] / 8)
    return graph.typed_edges(vertices, edges)


def _pair_models(spark):
    d = DATASETS["gaussian_pair1"]
    axes = Axes([4, 4], [21, 21], list(d.mins), list(d.maxs))
    return (*(written(encode(grids.rectilinear(spark, n, (101, 101)), (101, 101), axes), "model").df for n in ("gaussian_pair1", "gaussian_pair2")), axes)


@query("rt04_jacobi_traces")
def rt04(spark, sf_dir):
    f, g, axes = _pair_models(spark)
    return trace.trace(level_roots(f, axes, prune.all_spans(spark, axes), "jacobi", other=g), f, axes, "jacobi", other=g)


@query("rt05_jacobi_critical_points")
def rt05(spark, sf_dir):
    f, g, axes = _pair_models(spark)
    return jacobi_critical_points(f, g, axes, prune.all_spans(spark, axes), residual=1.0)


def _moving_model(spark):
    d = DATASETS["rotating_gaussian"]
    axes = Axes([3, 3, 3], [15, 15, 11], list(d.mins), list(d.maxs))
    return written(encode(grids.rectilinear(spark, "rotating_gaussian", (31, 31, 25)), (31, 31, 25), axes), "model").df, axes


@query("rt06_tracking_seeds")
def rt06(spark, sf_dir):
    controls, axes = _moving_model(spark)
    spans = prune.boundary(prune.critical_spans(controls, axes, 2), axes, True)
    return boundary_roots(controls, axes, spans).select("id", "x", "y", "t")


@query("tr13_trajectories")
def tr13(spark, sf_dir):
    controls, axes = _moving_model(spark)
    spans = prune.boundary(prune.critical_spans(controls, axes, 2), axes, True)
    return track.trajectories(boundary_roots(controls, axes, spans), controls, axes)


@query("rt07_degenerate_points")
def rt07(spark, sf_dir):
    controls, axes = _moving_model(spark)
    return degenerate_points(controls, axes, prune.critical_spans(controls, axes, 2)).select("id", "x", "y", "t")


@query("spl02_encode_adaptive")
def spl02(spark, sf_dir):
    d = DATASETS["gaussian_mixture"]
    samples = grids.rectilinear(spark, "gaussian_mixture", (61, 91))
    _, controls = encode_adaptive(samples, (61, 91), (3, 3), d.mins, d.maxs, 0.01)
    return controls


@query("spl21_sinogram")
def spl21_sinogram(spark, sf_dir):
    lines = spark.range(400).select(F.col("id").alias("line"), ((F.col("id") % 20 - 10) * 0.3).alias("rho"), (F.floor(F.col("id") / 20) * math.pi / 20).alias("alpha"))
    return radon.sinogram(lines, "sinc_sum", (-6.0, -6.0), (6.0, 6.0))


# Sampled derivatives of a model, regularised fits and the smaller summaries.
_AT = (11, 12)


def _jet_sql(orders: dict[str, tuple[int, int]], controls: str = "c") -> str:
    """CTEs of several derivatives on the grid _AT, joined as `jet`."""
    parts, joins = [], ""
    for k, (name, (dx, dy)) in enumerate(orders.items()):
        wx = B.design(parameters(_AT[0]), _AX.controls[0], _AX.degree[0], dx) / _AX.range(0) ** dx
        wy = B.design(parameters(_AT[1]), _AX.controls[1], _AX.degree[1], dy) / _AX.range(1) ** dy
        parts.append(f"{_values(wx, f'x{k}')}, {_values(wy, f'y{k}')}, s{k} AS (SELECT CAST(a.p AS BIGINT) AS i, CAST(b.p AS BIGINT) AS j, sum(a.w * b.w * c.c) AS {name} FROM {controls} c JOIN x{k} a ON a.q = c.i JOIN y{k} b ON b.q = c.j GROUP BY 1, 2)")
        joins += f"s{k}" if k == 0 else f" JOIN s{k} USING (i, j)"
    return ", ".join(parts) + f", jet AS (SELECT * FROM {joins})"


_GRID = [parameters(n) for n in _AT]


@query("prj08_steepness", f"WITH {_ENCODE}, {_jet_sql({'value': (0, 0), 'fx': (1, 0), 'fy': (0, 1)})} SELECT i, j, round(value, 5) + 0.0 AS value, round(fx * fx + fy * fy, 4) + 0.0 AS steepness FROM jet")
def prj08(spark, sf_dir):
    return sampled_steepness(_model(spark), _AX, _GRID).select("i", "j", r("value", 5).alias("value"), r("steepness", 4).alias("steepness"))


@query("prj09_ridge_function", f"WITH {_ENCODE}, {_jet_sql({'fx': (1, 0), 'fy': (0, 1), 'fxx': (2, 0), 'fxy': (1, 1), 'fyy': (0, 2)})} SELECT i, j, round(fx * 2 * (fx * fxy + fy * fyy) - fy * 2 * (fx * fxx + fy * fxy), 3) + 0.0 AS value FROM jet")
def prj09(spark, sf_dir):
    return sampled_ridge_function(_model(spark), _AX, _GRID).select("i", "j", r("value", 3).alias("value"))


def _smooth(d: int) -> np.ndarray:
    u = parameters(_N[d])
    return np.linalg.solve(B.normal_matrix(u, _AX.controls[d], _AX.degree[d], 1e-4), B.design(u, _AX.controls[d], _AX.degree[d]).T)


@query("spl03_regularised_encode", f"WITH {_values(_smooth(0), 'wx')}, {_values(_smooth(1), 'wy')} SELECT CAST(wx.p AS BIGINT) AS i, CAST(wy.p AS BIGINT) AS j, round(sum(wx.w * wy.w * g.value), 5) + 0.0 AS c FROM {grid_sql('gaussian_mixture', _N)} g JOIN wx ON wx.q = g.i JOIN wy ON wy.q = g.j GROUP BY 1, 2")
def spl03(spark, sf_dir):
    return encode(grids.rectilinear(spark, "gaussian_mixture", _N), _N, _AX, smooth=1e-4).select("i", "j", r("c", 5).alias("c"))


@query("spl10_net_coordinates", f"SELECT CAST(a.p AS BIGINT) AS i, CAST(b.p AS BIGINT) AS j, round(a.x, 6) + 0.0 AS x, round(b.y, 6) + 0.0 AS y FROM (VALUES {', '.join(f'({k}, {float(_AX.mins[0] + g * _AX.range(0))!r}e0)' for k, g in enumerate(B.derivative_coordinates(_AX.knots[0], 3).round(12)))}) a(p, x), (VALUES {', '.join(f'({k}, {float(_AX.mins[1] + g * _AX.range(1))!r}e0)' for k, g in enumerate(B.greville(_AX.knots[1], 3).round(12)))}) b(p, y)")
def spl10(spark, sf_dir):
    return net_coordinates(derivative_net(_model(spark), _AX, 0), _AX, 0).select("i", "j", r("x").alias("x"), r("y").alias("y"))


@query("spl18_control_range", f"WITH {_ENCODE} SELECT round(1 / (max(c) - min(c)), 5) AS coefficient FROM c")
def spl18(spark, sf_dir):
    return control_range(_model(spark)).select(F.round("coefficient", 5).alias("coefficient"))


@query("agg06_average_norm", "SELECT round(avg(sqrt(l_discount * l_discount + l_tax * l_tax)), 6) AS average_norm FROM lineitem")
def agg06(spark, sf_dir):
    return score.average_norm(table(spark, sf_dir, "lineitem"), ["l_discount", "l_tax"]).select(F.round("average_norm", 6).alias("average_norm"))


# Slices: the mean price by quantity and discount, a slice a return flag (kept apart by 1000 in the SQL).
_SLICES = "(SELECT ascii(l_returnflag) * 1000 + CAST(l_quantity AS BIGINT) AS i, CAST(round(l_discount * 100) AS BIGINT) AS j, round(avg(CAST(l_extendedprice AS DECIMAL(18,4))), 2) AS value FROM lineitem GROUP BY 1, 2)"
_HIGHER = [f"(value_{k} > value_0 OR (value_{k} = value_0 AND {b > 0 or (b == 0 and a > 0)}))" for k, (a, b) in enumerate(contour.LINK, 1)]
_TURNS = " + ".join(f"CASE WHEN {a} <> {b} THEN 1 ELSE 0 END" for a, b in zip(_HIGHER, [*_HIGHER[1:], _HIGHER[0]], strict=True))


@query("ext02_slice_critical_points", f"WITH {spread_sql(_SLICES, contour.LINK, ['value'], 'w')}, q AS (SELECT CAST(i // 1000 AS BIGINT) AS t, CAST(i % 1000 AS BIGINT) AS i, CAST(j AS BIGINT) AS j, CASE WHEN {_TURNS} = 0 AND {_HIGHER[0]} THEN 'min' WHEN {_TURNS} = 0 THEN 'max' WHEN {_TURNS} >= 4 THEN 'saddle' END AS type FROM w) SELECT * FROM q WHERE type IS NOT NULL")
def ext02(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.ascii("l_returnflag").cast("long").alias("t"), F.col("l_quantity").cast("long").alias("i"), F.round(F.col("l_discount") * 100).cast("long").alias("j"), F.col("l_extendedprice").cast("decimal(18,4)").alias("v"))
    return contour.pl_critical_points(l.groupBy("t", "i", "j").agg(F.round(F.avg("v").cast("double"), 2).alias("value")), ["t"])


def _weights_sql(n: int) -> str:
    w = zoom_weights(n, 0.5)
    return "(VALUES " + ", ".join(f"({a}, {b}, {float(w[a, b])!r}::DOUBLE)" for a in range(w.shape[0]) for b in range(n)) + ")"


@query("prj12_downsample", f"SELECT CAST(a.p AS BIGINT) AS i, CAST(b.p AS BIGINT) AS j, round(sum(a.w * b.w * value), 4) + 0.0 AS value FROM {_FIELD.format(c='l_extendedprice')} JOIN {_weights_sql(50)} a(p, q, w) ON a.q = i JOIN {_weights_sql(11)} b(p, q, w) ON b.q = j GROUP BY 1, 2")
def prj12(spark, sf_dir):
    return zoomed(lineitem_field(spark, sf_dir), (50, 11)).select("i", "j", r("value", 4).alias("value"))


_CUT = {"x": (10.0, 40.0), "y": (1000.0, 1600.0)}
_IN = {c: f"CASE WHEN {c}1 = {c}0 THEN 0 ELSE least(({lo}e0 - {c}0) / ({c}1 - {c}0), ({hi}e0 - {c}0) / ({c}1 - {c}0)) END" for c, (lo, hi) in _CUT.items()}
_OUT = {c: f"CASE WHEN {c}1 = {c}0 THEN 1 ELSE greatest(({lo}e0 - {c}0) / ({c}1 - {c}0), ({hi}e0 - {c}0) / ({c}1 - {c}0)) END" for c, (lo, hi) in _CUT.items()}
_PART = "(SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS x0, p_retailprice AS y0, CAST(51 - p_size AS DOUBLE) AS x1, p_retailprice + p_size * 10 AS y1 FROM part)"


@query("flt16_clipped_segments", f"SELECT id, round(x0 + a * (x1 - x0), 4) + 0.0 AS x0, round(y0 + a * (y1 - y0), 4) + 0.0 AS y0, round(x0 + b * (x1 - x0), 4) + 0.0 AS x1, round(y0 + b * (y1 - y0), 4) + 0.0 AS y1 FROM (SELECT *, greatest(0, {_IN['x']}, {_IN['y']}) AS a, least(1, {_OUT['x']}, {_OUT['y']}) AS b FROM {_PART}) WHERE a <= b")
def flt16(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x0"), F.col("p_retailprice").alias("y0"), (51 - F.col("p_size")).cast("double").alias("x1"), (F.col("p_retailprice") + F.col("p_size") * 10).alias("y1"))
    planes = [((10, 1000), (-1, 0)), ((10, 1000), (0, -1)), ((40, 1600), (0, 1)), ((40, 1600), (1, 0))]
    return files.clipped(p, planes).select("id", *(r(c, 4).alias(c) for c in ("x0", "y0", "x1", "y1")))


@query("utl11_root_check", "SELECT count(*) AS n, count(*) FILTER (WHERE l_discount * l_discount + l_tax * l_tax > 0.01015e0) AS not_roots, round(max(sqrt(l_discount * l_discount + l_tax * l_tax)), 6) AS largest FROM lineitem")
def utl11(spark, sf_dir):
    return score.root_check(table(spark, sf_dir, "lineitem"), ["l_discount", "l_tax"], math.sqrt(0.01015)).withColumn("largest", r("largest"))

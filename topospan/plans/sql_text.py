"""Small pieces of SQL that the registered queries' oracles share."""

from __future__ import annotations

from collections.abc import Sequence

from ..datasets import DATASETS
from ..functions.signals import signal_sql
from ..sources.grids import AXES, INDEX, coordinates

CELL = "CAST(((j + {dj}) * 1073741824 + (i + {di})) * 4 + {kind} AS BIGINT)"


def grid_sql(name: str, n: Sequence[int], value: str = "value", digits: int | None = None, **options) -> str:
    """A sampled signal: (i, j, ..., x, y, ..., value)."""
    d = DATASETS[name]
    total = 1
    for k in n:
        total *= k
    index, step = [], 1
    for c, k in zip(INDEX, n, strict=False):
        index.append(f"CAST((r // {step}) % {k} AS BIGINT) AS {c}")
        step *= k
    axes = AXES[: len(n)]
    places = ", ".join(f"{t} AS {a}" for a, t in zip(axes, coordinates(n, d.mins[: len(n)], d.maxs[: len(n)]), strict=True))
    text = signal_sql(name, axes, **options)
    v = f"round({text}, {digits})" if digits is not None else text
    return f"(SELECT *, {v} AS {value} FROM (SELECT *, {places} FROM (SELECT {', '.join(index)} FROM range({total}) t(r))))"


def spread_sql(field: str, offsets: Sequence[tuple[int, int]], columns: Sequence[str], name: str) -> str:
    """A CTE of the vertices that have all offsets, with the values there: columns c_0 (own), c_1, ..."""
    rows = ", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate([(0, 0), *offsets]))
    wide = ", ".join(f"max(CASE WHEN o = {k} THEN {c} END) AS {c}_{k}" for k in range(len(offsets) + 1) for c in columns)
    return f"{name} AS (SELECT i - a AS i, j - b AS j, {wide} FROM {field}, (VALUES {rows}) t(o, a, b) GROUP BY 1, 2 HAVING count(*) = {len(offsets) + 1})"


def crossings_sql(field: str, level: float) -> str:
    """CTEs v(vid) and e(src, dst) of marching triangles on a field (i, j, value)."""
    sides = {"b": (0, 1, 0, 0, 0), "l": (0, 2, 1, 0, 0), "d": (1, 2, 2, 0, 0), "r": (1, 3, 1, 1, 0), "t": (2, 3, 0, 0, 1)}
    keys = ", ".join(f"CASE WHEN (value_{a} > {level}) <> (value_{b} > {level}) THEN {CELL.format(di=di, dj=dj, kind=k)} END AS {s}" for s, (a, b, k, di, dj) in sides.items())
    pairs = " UNION ALL ".join(f"SELECT least({p}, {q}) AS src, greatest({p}, {q}) AS dst FROM k WHERE {p} IS NOT NULL AND {q} IS NOT NULL" for p, q in (("b", "d"), ("b", "l"), ("d", "l"), ("r", "t"), ("r", "d"), ("t", "d")))
    return f"""{spread_sql(field, [(1, 0), (0, 1), (1, 1)], ["value"], "c")},
k AS (SELECT {keys} FROM c),
e AS MATERIALIZED ({pairs}),
v AS MATERIALIZED (SELECT src AS vid FROM e UNION SELECT dst FROM e)"""


def jacobi_sql(f: str, g: str) -> str:
    """CTE h(i, j, value): f_x g_y - f_y g_x by central differences of two fields on one grid."""
    both = f"(SELECT f.i, f.j, f.x, f.y, f.value AS f, g.value AS g FROM {f} f JOIN {g} g ON f.i = g.i AND f.j = g.j)"
    d = lambda c, a, b, h: f"(({c}_{a} - {c}_{b}) / ({h}))"
    dx, dy = "x_1 - x_2", "y_3 - y_4"
    return f"{spread_sql(both, [(1, 0), (-1, 0), (0, 1), (0, -1)], ['f', 'g', 'x', 'y'], 'w')}, h AS (SELECT i, j, {d('f', 1, 2, dx)} * {d('g', 3, 4, dy)} - {d('f', 3, 4, dy)} * {d('g', 1, 2, dx)} AS value FROM w)"


def betti_sql(ctes: str) -> str:
    """Betti numbers of the graph v(vid), e(src, dst) that the CTEs define; components by least labels, kept by node."""
    return f"""WITH RECURSIVE {ctes},
n AS MATERIALIZED (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
root(a, r) USING KEY (a) AS (SELECT vid, vid FROM v UNION (SELECT n.a, min(o.r) FROM root o JOIN n ON n.b = o.a JOIN recurring.root m ON m.a = n.a WHERE o.r < m.r GROUP BY n.a)),
deg AS (SELECT vid, count(x) AS degree FROM v LEFT JOIN (SELECT src AS x FROM e UNION ALL SELECT dst FROM e) ON x = vid GROUP BY vid),
s AS (SELECT (SELECT count(*) FROM v) AS vertices, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM deg WHERE degree = 0) AS isolated, (SELECT count(*) FROM root JOIN deg ON vid = a WHERE a = r AND degree > 0) AS components, (SELECT count(*) FROM deg WHERE degree >= 3) AS deg3)
SELECT vertices, edges, isolated, components, edges - vertices + components + isolated AS loops, deg3 FROM s"""


def neighbours_sql(field: str) -> str:
    """CTE q(i, j, type) of discrete critical points by all eight neighbours."""
    ring = [(1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)]
    up = [f"(value_{k} > value_0)" for k in range(1, 9)]
    changes = " + ".join(f"CASE WHEN {a} <> {b} THEN 1 ELSE 0 END" for a, b in zip(up, [*up[1:], up[0]], strict=True))
    low = " AND ".join(f"value_{k} < value_0" for k in range(1, 9))
    return f"WITH {spread_sql(field, ring, ['value'], 'w')}, q AS (SELECT i, j, CASE WHEN {low} THEN 'max' WHEN {' AND '.join(up)} THEN 'min' WHEN {changes} >= 4 THEN 'saddle' END AS type FROM w)"

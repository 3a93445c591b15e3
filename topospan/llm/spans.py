"""Spans of regular-expression matches as Spark expressions, in code points.

A span is a struct (s, e, o, kind) that sorts by itself: start, order of its kind, exclusive end, kind.

Running sums go by blocks (an append copies a block, never the whole result), and a text is cut at
the blocks before it is cut at the spans. Subexpressions that a lambda needs are bound by `let`,
since Spark evaluates a lambda's whole body once an element. So a text with n matches costs about
n sqrt(n) / 16 steps, not n times its length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<s:int,o:int,e:int,kind:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with `value` evaluated once."""
    return F.transform(F.array(value), body)[0]


def no_spans() -> Column:
    return F.from_json(F.lit("[]"), SPANS)


def span(s: Column, e: Column, order: int, kind: str) -> Column:
    return F.struct(s.cast("int").alias("s"), F.lit(order).alias("o"), e.cast("int").alias("e"), F.lit(kind).alias("kind"))


def matches(text: Column, pattern: Column | str) -> Column:
    """All leftmost, non-overlapping matches."""
    return F.regexp_extract_all(text, F.lit(pattern) if isinstance(pattern, str) else pattern, F.lit(0))


def blocks(n: Column, roots: float = 1 / 16) -> Column:
    """The indices 0 to n - 1 (n > 0) as an array of arrays of roots * sqrt(n) + 32."""
    size = (F.floor(F.sqrt(n) * roots) + 32).cast("int")
    return F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), lambda k: F.sequence(k * size, F.least(k * size + size, n) - 1))


def before(numbers: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each place of an array of integers, op over 0 and all numbers before it."""
    none = F.from_json(F.lit("[]"), "array<int>")
    zero = lambda at: F.struct(at.alias("at"), none.alias("out"))

    def step(acc, x):
        return F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def over(a, own):
        whole = F.transform(own, lambda b: F.aggregate(b, F.lit(0), lambda acc, i: op(acc, F.get(a, i))))
        starts = F.aggregate(whole, zero(F.lit(0)), step, lambda acc: acc["out"])
        return F.flatten(F.zip_with(own, starts, lambda b, at: F.aggregate(b, zero(at), lambda acc, i: step(acc, F.get(a, i)), lambda acc: acc["out"])))

    return let(numbers, lambda a: F.when(F.size(a) > 0, let(blocks(F.size(a)), lambda own: over(a, own))).otherwise(none))


def located(text: Column, pattern: Column | str, found: Column, order: int, kind: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """Spans of the matches `found` of `pattern`, of those that `keep` holds for.

    What lies between matches comes from a split by the same pattern; only texts with a match are
    split, so most are scanned once.
    """
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    sizes = F.zip_with(found, gaps, lambda m, gap: F.struct((F.length(gap) + F.length(m)).alias("step"), F.length(m).alias("n"), (keep(m) if keep else F.lit(True)).alias("ok")))

    def spans(own):
        starts = before(F.transform(own, lambda x: x["step"]), lambda x, y: x + y)
        all_ = F.zip_with(own, starts, lambda x, at: F.struct(x["ok"].alias("ok"), span(at + x["step"] - x["n"], at + x["step"], order, kind).alias("x")))
        return F.transform(F.filter(all_, lambda r: r["ok"]), lambda r: r["x"])

    return F.when(F.size(found) > 0, let(sizes, spans)).otherwise(no_spans())


def in_order(spans: Column) -> Column:
    """By start, then by the order of kinds, then by end."""
    return F.sort_array(spans)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def of_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def _rebuilt(text: Column, spans: Column, label: Callable[[Column, Column], Column]) -> Column:
    """`text` with each of the ordered spans replaced by label(span, at); `at` is where the spans before it end."""

    def whole(a):
        pieces = F.zip_with(a, before(F.transform(a, lambda x: x["e"]), F.greatest), lambda x, at: F.struct(at.alias("p"), F.greatest(x["s"], at).alias("s"), F.greatest(x["e"], at).alias("e"), label(x, at).alias("label")))
        return let(pieces, lambda p: F.concat(F.array_join(F.transform(blocks(F.size(p), 1), lambda own: part(p, own)), ""), F.substring(text, F.element_at(p, -1)["e"] + 1, F.length(text))))

    def part(p, own):
        base = p[own[0]]["p"]
        cut = F.substring(text, base + 1, p[F.element_at(own, -1)]["e"] - base)
        return let(cut, lambda w: F.aggregate(own, F.lit(""), lambda acc, i: F.concat(acc, F.substring(w, p[i]["p"] - base + 1, p[i]["s"] - p[i]["p"]), p[i]["label"])))

    return let(spans, lambda a: F.when(F.size(a) > 0, whole(a)).otherwise(text))


def cut(text: Column, spans: Column) -> Column:
    """What the text holds in each of the ordered spans."""

    def part(a, own):
        base = a[own[0]]["s"]
        whole = F.substring(text, base + 1, F.array_max(F.transform(own, lambda i: a[i]["e"])) - base)
        return let(whole, lambda w: F.transform(own, lambda i: F.substring(w, a[i]["s"] - base + 1, a[i]["e"] - a[i]["s"])))

    none = F.from_json(F.lit("[]"), "array<string>")
    return let(spans, lambda a: F.when(F.size(a) > 0, F.flatten(F.transform(blocks(F.size(a), 1), lambda own: part(a, own)))).otherwise(none))


def replaced(text: Column, spans: Column, label: Callable[[Column], Column]) -> Column:
    """`text` with each span of the ordered `spans` replaced by label(span); overlapping spans count as the first."""
    return _rebuilt(text, spans, lambda x, at: F.when(x["s"] >= at, label(x)).otherwise(F.lit("")))


def blanked(text: Column, spans: Column) -> Column:
    """`text` with every character inside the ordered spans a blank; offsets stay."""
    return _rebuilt(text, spans, lambda x, at: F.repeat(F.lit(" "), F.greatest(x["e"] - F.greatest(x["s"], at), F.lit(0))))

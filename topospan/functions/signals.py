"""Analytic signals as SQL expressions of coordinate columns.

A signal is a text that Spark and any SQL engine with sin, cos, exp, sqrt, pow and atanh evaluate
alike; `signal()` makes a Column of it, so that sampling stays inside whole-stage code generation.
User-defined signals are callables over Columns, taken wherever a name is.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(x: float) -> str:
    """A double literal; engines take 0.5 for a decimal."""
    return repr(float(x)) if "e" in repr(float(x)) else f"{float(x)!r}e0"


PI, E = number(math.pi), number(math.e)


def _sum(terms) -> str:
    return "(" + " + ".join(terms) + ")"


def _product(terms) -> str:
    return "(" + " * ".join(terms) + ")"


def _sine(x, s, f, l):
    return f"{s} * {_product(f'sin({f} * {c})' for c in x)} * {1 + l}"


def _cosine(x, s, f, l):
    return f"{s} * {_product(f'cos({f} * {c})' for c in x)} * {1 + l}"


def _ncosp1(x, s, f, l):
    return f"{s} * {_product(f'(1 - cos({f} * {c}))' for c in x)}"


def _sinc(x, s, f, l):
    return f"{s} * {_product(f'CASE WHEN {c} = 0 THEN 1e0 ELSE sin({f} * {c}) / {c} END' for c in x)} * {1 + l}"


def _damped(x, s, rate, shift):
    arg = lambda c: f"({rate} * {c} + {shift})"
    return f"{s} * {_sum(f'CASE WHEN {arg(c)} = 0 THEN 5e0 ELSE 5e0 * sin({arg(c)}) / {arg(c)} END' for c in x)}"


def _sinc_sum(x, s, f, l):
    return _damped(x, s, "5e0", "0e0")


def _sinc_sum_2(x, s, f, l):
    return _damped(x, s, "3e0", "2e0")


def _ackley(x, s, f, l):
    d = len(x)
    return f"{s} * (-20e0 * exp(-0.2e0 * sqrt({_sum(f'{c} * {c}' for c in x)} / {d})) - exp({_sum(f'cos({number(2 * math.pi)} * {c})' for c in x)} / {d}) + 20e0 + {E})"


def _gaussian(x, y, amplitude, cx, cy, ax, ay):
    return f"{amplitude} * exp(-({ax}) * ({x} - ({cx})) * ({x} - ({cx})) - ({ay}) * ({y} - ({cy})) * ({y} - ({cy})))"


#: Amplitude, centre and inverse widths of the mixture's bumps.
MIXTURE = ((1.0, -0.4, 0.0, 8.0, 4.0), (1.0, 0.5, 0.0, 8.0, 4.0), (1.0, 0.0, 0.77, 8.0, 4.0), (1.0, 0.0, 1.5, 8.0, 4.0), (0.2, 0.0, 0.5, 0.3, 0.3))
#: Amplitude, centre and width of the two fields of the pair.
PAIR_1 = ((0.25, 0.5, 0.4, 0.1),)
PAIR_2 = ((0.25, 0.3, 0.2, 0.1), (0.5, 0.75, 0.25, 0.12))


def _gaussian_mixture(x, s, f, l):
    return _sum(_gaussian(x[0], x[1], *(f"{number(v)}" for v in bump)) for bump in MIXTURE)


def _pair(bumps):
    return lambda x, s, f, l: _sum(_gaussian(x[0], x[1], f"{number(a)}", f"{number(cx)}", f"{number(cy)}", f"{number(1 / (2 * w * w))}", f"{number(1 / (2 * w * w))}") for a, cx, cy, w in bumps)


def _rotating_gaussian(x, s, f, l):
    """A bump on a circle of radius 0.7; for 1 < t < 3 the larger of it and one that turns the other way."""
    px, py, t = x
    angle = f"{number(math.pi / 2)} * {t}"

    def bump(sign, offset):
        return _gaussian(px, py, "1e0", f"0.7e0 * cos({sign}{angle} + {offset})", f"0.7e0 * sin({sign}{angle} + {offset})", "2e0", "2e0")

    one, two = bump("", "0e0"), bump("-", PI)
    return f"CASE WHEN {t} > 1 AND {t} < 3 THEN greatest({one}, {two}) ELSE {one} END"


def _schwefel(x, s, f, l):
    return f"{s} * 0.5e0 * ({number(418.9829 * len(x))} - {_sum(f'{c} * sin(sqrt(abs({c})))' for c in x)})"


def _rastrigin(x, s, f, l):
    return f"{s} * 0.1e0 * ({number(10.0 * len(x))} + {_sum(f'({c} * {c} - 10e0 * cos({number(2 * math.pi)} * {c}))' for c in x)})"


def _squares(x, offsets, weights):
    return _sum(f"{w} * ({c} - ({o})) * ({c} - ({o}))" for c, o, w in zip(x, offsets, weights, strict=True))


def _ratio(a, k):
    return f"CASE WHEN {a} = 0 THEN {number(float(k))} ELSE sin({k} * {a}) / {a} END"


def _psinc(kind):
    def text(x, s, f, l):
        d = len(x)
        if kind == 1:
            a = _squares(x, [-1 if i % 2 == 0 else 1 for i in range(d)], [1] * d)
            b = _squares(x, [1 if i % 2 == 0 else -1 for i in range(d)], [1] * d)
        else:
            a = _squares(x, [0] * d, [1] * d)
            b = _squares(x, [2 if i % 2 == 0 else -2 for i in range(d)], [2 if i == 0 else 1 for i in range(d)])
        if kind >= 3:
            a = f"sqrt({a})"
        k = 1 if kind == 4 else 1 + l
        whole = f"({_ratio(a, k)} + {_ratio(b, k)})"
        return f"{s} * {whole}" + (f" / sqrt(0.1e0 + {_squares(x, [0] * d, [1] * d)})" if kind == 4 else "")

    return text


def _ml(x, s, f, l):
    px, py, pz = x
    radius = f"sqrt({px} * {px} + {py} * {py} + {pz} * {pz})"
    wave = f"cos({number(2 * math.pi)} * {f} * cos({PI} * {radius} / 2))"
    return f"(1 - sin({PI} * {pz} / 2) + {s} * (1 + {wave} * sqrt({px} * {px} + {py} * {py}))) / (2 * (1 + {s}))"


def _f16(x, s, f, l):
    a, b = x
    return f"(pow({a}, 4) + pow({b}, 4) + {a} * {a} * {b} * {b} + {a} * {b}) / (pow({a}, 3) + pow({b}, 3) + 4)"


def _f17(x, s, f, l):
    e, g, m = x
    gamma = f"sqrt({m} * {m} * ({m} * {m} + {g} * {g}))"
    return f"({number(2 * math.sqrt(2))} * {m} * {g} * {gamma} / ({PI} * sqrt({m} * {m} + {gamma}))) / (({e} * {e} - {m} * {m}) * ({e} * {e} - {m} * {m}) + {m} * {m} * {g} * {g})"


def _f18(x, s, f, l):
    return f"{_sum(f'atanh({c})' for c in x)} / (({x[0]} * {x[0]} - 1) / {x[1]})"


SIGNALS: dict[str, Callable] = {
    "sine": _sine, "cosine": _cosine, "ncosp1": _ncosp1, "sinc": _sinc, "sinc_sum": _sinc_sum, "sinc_sum_2": _sinc_sum_2, "ackley": _ackley, "gaussian_mixture": _gaussian_mixture,
    "rotating_gaussian": _rotating_gaussian, "gaussian_pair1": _pair(PAIR_1), "gaussian_pair2": _pair(PAIR_2), "schwefel": _schwefel, "rastrigin": _rastrigin, "psinc1": _psinc(1), "psinc2": _psinc(2),
    "psinc3": _psinc(3), "psinc4": _psinc(4), "ml": _ml, "f16": _f16, "f17": _f17, "f18": _f18,
}


def signal_sql(name: str, coordinates: Sequence[str], scale: float = 1.0, frequency: float = 1.0, component: int = 0) -> str:
    """The SQL text of a signal of coordinate expressions."""
    return SIGNALS[name](list(coordinates), f"{number(float(scale))}", f"{number(float(frequency))}", component)


def signal(name: str | Callable[..., Column], coordinates: Sequence[str], scale: float = 1.0, frequency: float = 1.0, component: int = 0) -> Column:
    """The Column of a signal: a name, or a callable over coordinate Columns."""
    if callable(name):
        return name(*(F.col(c) for c in coordinates))
    return F.expr(signal_sql(name, coordinates, scale, frequency, component))


def line_integral_sql(x0: str, y0: str, x1: str, y1: str) -> str:
    """Integral of sin(x) sin(y) along a segment, in closed form.

    With x = x0 + a t and y = y0 + b t the product is (cos((x0 - y0) + (a - b) t) - cos((x0 + y0) + (a + b) t)) / 2.
    """
    a, b = f"({x1} - {x0})", f"({y1} - {y0})"

    def part(phase, rate):
        return f"CASE WHEN abs({rate}) < 1e-12 THEN cos({phase}) ELSE (sin({phase} + {rate}) - sin({phase})) / {rate} END"

    return f"0.5e0 * sqrt({a} * {a} + {b} * {b}) * ({part(f'({x0} - {y0})', f'({a} - {b})')} - ({part(f'({x0} + {y0})', f'({a} + {b})')}))"


def ackley_gradient_sql(x: Sequence[str]) -> list[str]:
    """First derivatives of ackley away from 0."""
    d = len(x)
    r = f"sqrt({_sum(f'{c} * {c}' for c in x)} / {d})"
    waves = f"exp({_sum(f'cos({number(2 * math.pi)} * {c})' for c in x)} / {d})"
    return [f"(4e0 * exp(-0.2e0 * {r}) * {c} / ({d} * {r}) + {number(2 * math.pi / d)} * sin({number(2 * math.pi)} * {c}) * {waves})" for c in x]


def sinc_derivatives_sql(x: str) -> tuple[str, str, str]:
    """sin(x)/x with its first and second derivatives, away from 0."""
    return f"sin({x}) / {x}", f"(cos({x}) / {x} - sin({x}) / ({x} * {x}))", f"(-sin({x}) / {x} - 2 * cos({x}) / ({x} * {x}) + 2 * sin({x}) / ({x} * {x} * {x}))"

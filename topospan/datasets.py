"""Catalog of datasets: domains, sample counts and control points."""

from __future__ import annotations

import math
from dataclasses import dataclass

_P = math.pi


@dataclass(frozen=True)
class Dataset:
    kind: str
    mins: tuple[float, ...]
    maxs: tuple[float, ...]
    points: tuple[int, ...] | None = None
    controls: tuple[int, ...] | None = None


def _cube(kind: str, half: float, dims: int = 2) -> Dataset:
    return Dataset(kind, (-half,) * dims, (half,) * dims)


def _indexed(points: tuple[int, ...], controls: tuple[int, ...], kind: str = "grid") -> Dataset:
    return Dataset(kind, (0.0,) * len(points), tuple(float(n - 1) for n in points), points, controls)


#: Fixed values.
DATASETS: dict[str, Dataset] = {
    **{k: _cube("analytic", 4 * _P) for k in ("sine", "cosine", "ncosp1", "sinc", "psinc1", "psinc2", "psinc3", "psinc4")},
    **{k: _cube("analytic", 2 * _P) for k in ("sinc_sum", "sinc_sum_2")},
    "rastrigin": _cube("analytic", 6.0),
    "ackley": _cube("analytic", 2.0),
    "schwefel": _cube("analytic", (10.5 * _P) ** 2),
    "gaussian_pair1": Dataset("analytic", (0.1, 0.0), (0.9, 0.6)),
    "gaussian_pair2": Dataset("analytic", (0.1, 0.0), (0.9, 0.6)),
    "gaussian_mixture": Dataset("analytic", (-1.0, -0.8), (1.0, 2.3)),
    "rotating_gaussian": Dataset("analytic", (-2.0, -2.0, 0.0), (2.0, 2.0, 4.0), (100, 100, 40), (23, 23, 15)),
    "ml": _cube("analytic", 1.0, 3),
    "f16": _cube("analytic", 1.0),
    "f17": Dataset("analytic", (80.0, 5.0, 90.0), (100.0, 10.0, 93.0)),
    "f18": _cube("analytic", 0.95, 4),
    "cesm": _indexed((3600, 1800), (204, 104)),
    "vortex_street": Dataset("grid", (-0.5, -0.5), (7.5, 0.5), (640, 80), (160, 20)),
    "boussinesq": Dataset("grid", (-0.5, -0.5), (0.5, 2.5), (150, 450), (50, 150)),
    "hurricane_isabel": _indexed((500, 500), (166, 166)),
    "s3d": _indexed((704, 540, 550), (140, 108, 110), "vector grid"),
    "nek": _indexed((200, 200, 200), (100, 100, 100), "vector grid"),
    "rti": _indexed((288, 512, 512), (72, 128, 128), "vector grid"),
    "tornado": _indexed((128, 128, 128), (100, 100, 100), "vector grid"),
    "miranda": _indexed((256, 384, 384), (256, 384, 384), "grid"),
    "tornado4d": _indexed((128, 128, 128, 49), (100, 100, 100, 35), "vector series"),
    "edelta": Dataset("points", (0.0, 0.0), (1.0, 1.0), (108822,)),
    "climate": Dataset("points", (0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (585765,)),
    "nuclear": Dataset("points", (0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (63048,)),
    "nasa": Dataset("points", (0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (55365,)),
}


def ranges(text: str | list[float]) -> list[float]:
    """A list of numbers, or their text `a-b-c-d` (which can't say negative numbers; pass a list for those)."""
    return [float(x) for x in text.split("-")] if isinstance(text, str) else [float(x) for x in text]


def upsampling(text: str | list[int], dims: int) -> list[int]:
    """Factors per dimension, the last repeated."""
    own = [int(x) for x in text.split("-")] if isinstance(text, str) else list(text)
    return (own + own[-1:] * dims)[:dims]

"""One vocabulary of numeric operations with two carriers: Spark columns and numpy arrays.

Formulas are written once against this vocabulary.  Evaluated with `ColumnOps`
they are Catalyst expressions; with `ArrayOps` they are vectorised numpy over many
candidates, as the solver needs.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")


class ColumnOps:
    """Operations on double columns.  `samples` names an array<struct<l,a,b,weight,saliency>> column."""

    def __init__(self, samples: str | None = None, grid: str | None = None) -> None:
        self.samples, self.grid = samples, grid

    @staticmethod
    def const(x: float) -> Column:
        return F.lit(float(x))

    sqrt, exp, log, sin, cos, atan2, cbrt, absolute, floor = map(staticmethod, (F.sqrt, F.exp, F.ln, F.sin, F.cos, F.atan2, F.cbrt, F.abs, F.floor))

    @staticmethod
    def power(x, p):
        return F.pow(x, F.lit(float(p)))

    @staticmethod
    def remainder(x, m: float):
        return x % F.lit(m)

    @staticmethod
    def maximum(x, y):
        return F.greatest(x if isinstance(x, Column) else F.lit(float(x)), y if isinstance(y, Column) else F.lit(float(y)))

    @staticmethod
    def minimum(x, y):
        return F.least(x if isinstance(x, Column) else F.lit(float(x)), y if isinstance(y, Column) else F.lit(float(y)))

    @staticmethod
    def where(test, x, y):
        return F.when(test, x).otherwise(y)

    @staticmethod
    def finite(x):
        return ~F.isnan(x) & (F.abs(x) < F.lit(INFINITY))

    def n_samples(self):
        return F.size(self.samples).cast("double")

    def sum_samples(self, f):
        return F.aggregate(F.col(self.samples), F.lit(0.0), lambda total, s: total + f(s))

    def min_samples(self, f):
        return F.array_min(F.transform(F.col(self.samples), f))

    def cell(self, index):
        return F.element_at(F.col(self.grid), (index + 1).cast("int"))


class _Sample:
    def __init__(self, table: np.ndarray) -> None:
        self.table = table

    def __getitem__(self, name: str) -> np.ndarray:
        return self.table[:, ("l", "a", "b", "weight", "saliency").index(name)][:, None]


class ArrayOps:
    """The same on arrays of one value for each candidate; samples run along the first axis."""

    def __init__(self, samples: np.ndarray | None = None, grid: np.ndarray | None = None) -> None:
        self.samples, self.grid = samples, grid

    const = staticmethod(float)
    sqrt, exp, log, sin, cos, cbrt, absolute = map(staticmethod, (np.sqrt, np.exp, np.log, np.sin, np.cos, np.cbrt, np.abs))
    power, maximum, minimum, where, finite = map(staticmethod, (np.power, np.maximum, np.minimum, np.where, np.isfinite))
    atan2, remainder = staticmethod(np.arctan2), staticmethod(np.fmod)

    @staticmethod
    def floor(x):
        return np.floor(x).astype(np.int64)

    def n_samples(self):
        return float(len(self.samples))

    def sum_samples(self, f):
        return np.sum(f(_Sample(self.samples)), axis=0)

    def min_samples(self, f):
        return np.min(f(_Sample(self.samples)), axis=0)

    def cell(self, index):
        return self.grid[index]


COLUMNS = ColumnOps()
ARRAYS = ArrayOps()
TAU = 2.0 * math.pi
EPS = 1.0e-12

"""Vector arithmetic on array<float|double> columns."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the tables: steps, and the largest argument of the sigmoid.
STEPS, SIGMOID_MAX = 512, 8
#: Added before a logarithm is taken.
LOG_SHIFT = 1e-5
_ZERO = lambda: F.lit(0.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), _ZERO(), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def checked_norm(v):
    """norm, but an error where it isn't a number."""
    n = norm(v)
    return F.when(F.isnan(n), F.raise_error(F.lit("a norm isn't a number"))).otherwise(n)


def add(a: Column, b: Column, scale: float = 1.0) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y * F.lit(scale))


def multiply(v: Column, by: Column | float) -> Column:
    return F.transform(v, lambda x: x * (by if isinstance(by, Column) else F.lit(by)))


def l2_normalize(v: Column) -> Column:
    """v at length 1; unchanged if it is shorter than 1e-8."""
    return F.get(F.transform(F.array(norm(v)), lambda n: F.when(n < 1e-8, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x / n))), F.lit(0))


def argmax(v: Column) -> Column:
    """Place of the first largest element, from 0; 0 for an empty vector."""
    return F.greatest(F.coalesce(F.array_position(v, F.array_max(v)) - 1, F.lit(0)), F.lit(0)).cast("int")


def softmax(v: Column) -> Column:
    def shifted(top: Column) -> Column:
        powers = F.transform(v, lambda x: F.exp(x - top))
        return F.get(F.transform(F.array(powers), lambda e: F.transform(e, lambda x: x / F.aggregate(e, _ZERO(), lambda s, y: s + y))), F.lit(0))

    return F.get(F.transform(F.array(F.array_max(v)), shifted), F.lit(0))


def exact_sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def table_sigmoid(x: Column) -> Column:
    """The sigmoid at the grid point below x: 512 steps from -8 to 8, 0 and 1 beyond."""
    step = F.floor((x + SIGMOID_MAX) * STEPS / (2 * SIGMOID_MAX))
    return F.when(x < -SIGMOID_MAX, 0.0).when(x > SIGMOID_MAX, 1.0).otherwise(exact_sigmoid(step * (2.0 * SIGMOID_MAX) / STEPS - SIGMOID_MAX))


def grid_sigmoid(x: np.ndarray) -> np.ndarray:
    """table_sigmoid of an array, in NumPy."""
    grid = np.floor((np.clip(x, -SIGMOID_MAX, SIGMOID_MAX) + SIGMOID_MAX) * STEPS / (2 * SIGMOID_MAX)) * (2 * SIGMOID_MAX) / STEPS - SIGMOID_MAX
    return np.where(x < -SIGMOID_MAX, 0.0, np.where(x > SIGMOID_MAX, 1.0, 1.0 / (1.0 + np.exp(-grid))))


def table_log(x: Column) -> Column:
    """The logarithm at the grid point below x in 512 steps up to 1; 0 beyond 1."""
    return F.when(x > 1.0, 0.0).otherwise(F.log((F.floor(x * STEPS) + LOG_SHIFT) / STEPS))


def std_log(p: Column) -> Column:
    return F.log(p + LOG_SHIFT)


def mean_of(column: str, dim: int) -> Column:
    """Aggregate: the mean of vectors of ``dim`` elements, element by element, with partial sums in each task."""
    return F.array(*(F.avg(F.get(column, F.lit(i)).cast("double")) for i in range(dim)))


def sum_of(column: str, dim: int, weight: Column | None = None) -> Column:
    part = lambda i: F.get(column, F.lit(i)).cast("double") * (weight if weight is not None else F.lit(1.0))
    return F.array(*(F.sum(part(i)) for i in range(dim)))


def is_finite(v: Column) -> Column:
    return ~F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == math.inf))

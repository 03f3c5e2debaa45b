"""Column functions on numeric arrays: distances, normalisation, log-sum-exp, Gaussian log-densities. All but ``from_python`` stay in the JVM."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

Distance = Callable[[Column, Column], Column]


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda u, v: (u - v) * (u - v)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def manhattan(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda u, v: F.abs(u - v)))


def cosine(a: Column, b: Column) -> Column:
    """1 minus the cosine of the angle; null if either vector is zero."""
    norms = F.sqrt(total(F.transform(a, lambda v: v * v)) * total(F.transform(b, lambda v: v * v)))
    return 1 - total(F.zip_with(a, b, lambda u, v: u * v)) / F.nullif(norms, F.lit(0.0))


def from_python(f: Callable[[np.ndarray, np.ndarray], float]) -> Distance:
    """A distance of Columns from a function of two numpy vectors, for what Columns can't say. It runs row by row over Arrow batches in
    Python workers, so a distance of Columns is the one to write where there is a choice. Null if either side is null."""

    @F.arrow_udf("double")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        rows = zip(a.to_pylist(), b.to_pylist())
        return pa.array([None if u is None or v is None else float(f(np.array(u, float), np.array(v, float))) for u, v in rows], pa.float64())

    return lambda a, b: run(a, b)


def normalised(x: Column) -> Column:
    """x divided by its sum; a sum of zero is an error."""
    s = total(x)
    checked = F.when(s == 0, F.raise_error(F.lit("a row sums to zero: it can't be normalised")).cast("double")).otherwise(s)
    return F.transform(x, lambda v: v / checked)


def logsumexp(x: Column) -> Column:
    """log(sum(exp(x))), shifted by the largest entry."""
    m = F.array_max(x)
    return m + F.log(total(F.transform(x, lambda v: F.exp(v - m))))


def argmax(x: Column) -> Column:
    """1-based position of the first largest entry."""
    return F.array_position(x, F.array_max(x)).cast("int")


def diagonal_log_density(x: Column, mean: Sequence[float], variance: Sequence[float]) -> Column:
    """Log-density of a Gaussian with a diagonal covariance."""
    inverse = vector([1 / v for v in variance])
    norm = sum(math.log(v) for v in variance) + len(mean) * math.log(2 * math.pi)
    square = total(F.zip_with(F.zip_with(x, vector(mean), lambda u, v: (u - v) * (u - v)), inverse, lambda q, w: q * w))
    return -0.5 * (square + norm)

"""Distances between a vector column and one query vector, as Spark columns.

Both forms add the products up one dimension after the other in double precision, so
they return the same bits: ``native`` stays in the JVM, ``arrow`` hands whole Arrow
batches to NumPy and is several times faster once the data outweighs starting Python.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The distance kinds, and whether the nearest row has the largest value.
METRICS = {"l2": False, "cosine": False, "ip": True}


class VectorError(ValueError):
    """A vector, ``k`` or distance kind that cannot be searched with."""


def check_metric(metric: str) -> str:
    if metric not in METRICS:
        raise VectorError(f"distance kind must be one of {sorted(METRICS)}, not {metric!r}")
    return metric


def check_query(query: Sequence[float]) -> list[float]:
    values = [float(value) for value in query]
    if not values or not all(math.isfinite(value) for value in values):
        raise VectorError("a query vector needs at least one number, all of them finite")
    return values


def nearest_first(metric: str, distance: Column) -> Column:
    return distance.desc_nulls_last() if METRICS[metric] else distance.asc_nulls_last()


def distance(vector: Column, query: Sequence[float], metric: str, form: str = "native") -> Column:
    """Distance from ``vector`` to ``query``; null where it is undefined (zero norm, NaN).

    A vector of another length than the query fails the job.
    """
    check_metric(metric)
    values = check_query(query)
    if form == "native":
        measured = _native(_of_length(vector, len(values)), values, metric)
    elif form == "arrow":
        measured = _arrow(values, metric)(vector)
    else:
        raise VectorError(f"form must be 'native' or 'arrow', not {form!r}")
    return F.nanvl(measured, F.lit(None).cast("double"))


def norm(vector: Column) -> Column:
    """Euclidean length of a vector column."""
    return F.sqrt(_total(F.transform(vector, lambda a: a.cast("double") * a.cast("double"))))


def _native(vector: Column, query: list[float], metric: str) -> Column:
    fixed = F.expr("array(" + ", ".join(f"{value!r}D" for value in query) + ")")

    def pairwise(combine) -> Column:
        return _total(F.zip_with(vector, fixed, lambda a, b: combine(a.cast("double"), b)))

    if metric == "l2":
        return F.sqrt(pairwise(lambda a, b: (a - b) * (a - b)))
    product = pairwise(lambda a, b: a * b)
    if metric == "ip":
        return product
    size = 0.0
    for value in query:
        size += value * value
    similarity = F.try_divide(product, norm(vector) * F.lit(math.sqrt(size)))
    similarity = F.nanvl(similarity, F.lit(None).cast("double"))

    # least and greatest skip nulls, so an undefined similarity must not reach them. It is worked
    # out once and handed on as the one item of an array.
    def from_one(value: Column) -> Column:
        bounded = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value))
        return F.when(value.isNotNull(), F.lit(1.0) - bounded)

    return F.get(F.transform(F.array(similarity), from_one), F.lit(0))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, value: total + value)


def _of_length(vector: Column, length: int) -> Column:
    message = F.concat(
        F.lit(f"vector length differs from the query's {length}: "), F.size(vector).cast("string")
    )
    return F.when(F.size(vector) == length, vector).otherwise(F.raise_error(message))


def _arrow(query: list[float], metric: str):
    wanted = np.array(query).reshape(-1, 1)

    @F.arrow_udf("double")
    def measure(vectors: pa.Array) -> pa.Array:
        matrix = to_matrix(vectors, len(wanted))
        return pa.array(by_dimension(np.ascontiguousarray(matrix.T), wanted, metric))

    return measure


def to_matrix(vectors: pa.Array, length: int) -> np.ndarray:
    """A list array without nulls as one double matrix, never touching single rows."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    if (lengths != length).any():
        raise VectorError(f"vector length differs from the query's {length}")
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    return values.astype(np.float64).reshape(len(vectors), length)


def by_dimension(left: np.ndarray, right: np.ndarray, metric: str) -> np.ndarray:
    """Distances between the columns of two matrices, summed one dimension after the other."""
    total = np.zeros(left.shape[1])
    own, other = np.zeros(left.shape[1]), np.zeros(right.shape[1])
    with np.errstate(all="ignore"):
        for a, b in zip(left, right):
            if metric == "l2":
                step = a - b
                total += step * step
                continue
            total += a * b
            if metric == "cosine":
                own += a * a
                other += b * b
        if metric == "l2":
            return np.sqrt(total)
        if metric == "ip":
            return total
        sizes = np.sqrt(own) * np.sqrt(other)
        similarity = np.where(sizes == 0, np.nan, total / sizes)
        return 1.0 - np.clip(similarity, -1.0, 1.0)

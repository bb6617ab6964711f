"""Distances and vector functions as Columns, computed in double; elements fold from the left."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvex.errors import InvalidConfig

EPSILON = 1.1920928955078125e-07  # of a 32-bit float


def literal(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))


def _fold(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def _pairs(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))))


def dot(a: Column, b: Column) -> Column:
    return _pairs(a, b, lambda x, y: x * y)


def norm2(a: Column) -> Column:
    return _fold(F.transform(a, lambda x: x.cast("double") * x.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(norm2(a))


def cosine(a: Column, b: Column) -> Column:
    """1 - cosine; 1 where either vector has no length."""
    n = F.sqrt(norm2(a) * norm2(b))
    return F.when(n == 0, 1.0).otherwise(1 - dot(a, b) / n)


def squared_euclidean(a: Column, b: Column) -> Column:
    return _pairs(a, b, lambda x, y: (x - y) * (x - y))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_euclidean(a, b))


def dot_distance(a: Column, b: Column) -> Column:
    """Lower is more similar."""
    return -dot(a, b)


def manhattan(a: Column, b: Column) -> Column:
    return _pairs(a, b, lambda x, y: F.abs(x - y))


_METRICS = {"cosine": cosine, "euclidean": euclidean, "dot": dot_distance, "manhattan": manhattan}


def _checked(a: Column, b: Column, value: Column) -> Column:
    wrong = F.raise_error(F.concat(F.lit("expected dimension "), F.size(a).cast("string"), F.lit(", got "), F.size(b).cast("string"))).cast("double")
    return F.when(F.size(a) != F.size(b), wrong).otherwise(value)


def distance(metric: str, a: Column, b: Column) -> Column:
    """Distance by name. Vectors of different length fail the query; a null vector gives null."""
    if metric not in _METRICS:
        raise InvalidConfig(f"unknown metric {metric}")
    return _checked(a, b, _METRICS[metric](a, b))


def squared_distance(metric: str, a: Column, b: Column) -> Column:
    """The same, squared; without a root for the Euclidean one."""
    return _checked(a, b, squared_euclidean(a, b)) if metric == "euclidean" else F.pow(distance(metric, a, b), F.lit(2.0))


def normalized(a: Column, least: float = 0.0) -> Column:
    """Divided by its length if that is more than ``least``, else unchanged; elements are double."""
    n = norm(a)
    return F.when(n > least, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 where either vector is shorter than a float's epsilon."""
    na, nb = norm(a), norm(b)
    return F.when((na > EPSILON) & (nb > EPSILON), dot(a, b) / (na * nb)).otherwise(0.0)


def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), n)


def similarity(score: Column) -> Column:
    """1 / (1 + distance)."""
    return 1 / (1 + score)


def service_score(d: Column) -> Column:
    return 1 - d

"""Vector expressions on ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusqa.functions.text import let


def as_doubles(vec: Column) -> Column:
    return vec.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def magnitude(vec: Column) -> Column:
    """L2 norm."""
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x * x))


def scale_down(vec: Column, divisor: Column) -> Column:
    """Every element divided by ``divisor`` if that is positive, else the vector itself."""
    return F.when(divisor > 0, F.transform(vec, lambda x: x / divisor)).otherwise(vec)


def normalize(vec: Column) -> Column:
    """Unit vector; the zero vector gives NaN elements. Vector and norm are worked out once, not for each element."""

    def scaled(v: Column) -> Column:
        return let(magnitude(v), lambda norm: F.transform(v, lambda x: F.when(norm != 0, x / norm).otherwise(float("nan"))))

    return let(vec, scaled)


def add(a: Column, b: Column) -> Column:
    """Element sum over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def euclidean(a: Column, b: Column) -> Column:
    """Distance; null if the lengths differ."""
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.when(
        F.size(a) == F.size(b), F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))
    )


def cosine(a: Column, b: Column) -> Column:
    """Similarity; null if the lengths differ, NaN if a vector is zero."""
    norms = magnitude(a) * magnitude(b)
    return F.when(
        F.size(a) == F.size(b),
        F.when(norms != 0, dot(a, b) / norms).otherwise(float("nan")),
    )


def from_best(score: Column) -> Column:
    """Ascending sort key of scores: highest rounded score first, NaN last."""
    return F.when(F.isnan(score), float("inf")).otherwise(-F.round(score, 6))


def sums(vec: Column, dim: int, weight: Column | None = None) -> list[Column]:
    """One sum per vector element, for ``groupBy().agg``; short vectors count as padded with 0."""
    out = []
    for i in range(dim):
        x = F.coalesce(F.get(vec, F.lit(i)), F.lit(0.0))
        out.append(F.sum(x if weight is None else x * weight).alias(f"_v{i}"))
    return out


def gather(dim: int) -> Column:
    """The vector whose elements ``sums`` left in columns."""
    return F.array(*[F.col(f"_v{i}") for i in range(dim)])

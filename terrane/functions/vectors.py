"""Vector arithmetic on array columns, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: str | Column) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def euclidean(a: str | Column, b: str | Column) -> Column:
    diff = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") - y.cast("double"))
    return F.sqrt(F.aggregate(diff, F.lit(0.0), lambda s, v: s + v * v))


def cosine(a: str | Column, b: str | Column) -> Column:
    """0 where a norm is 0."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def l2_normalise(a: str | Column) -> Column:
    """Each element over the norm; a zero vector stays as it is."""
    n = norm(a)
    return F.transform(_c(a), lambda x: x.cast("double") / F.when(n > 0, n).otherwise(F.lit(1.0)))


def row_normalise(a: str | Column) -> Column:
    """Each element over the sum; a zero sum leaves the vector as it is."""
    total = F.aggregate(_c(a), F.lit(0.0), lambda s, v: s + v.cast("double"))
    return F.transform(_c(a), lambda x: x.cast("double") / F.when(total != 0, total).otherwise(F.lit(1.0)))


def rounded(a: str | Column, digits: int = 6) -> Column:
    return F.transform(_c(a), lambda x: F.round(x, digits))


def round_half_away(x: Column, digits: int = 6) -> Column:
    """A double to ``digits`` digits in binary arithmetic, halves away from zero, the sign of zero kept; what overflows stays.

    ``F.round`` goes by the decimal digits and loses the sign of zero; DuckDB's ``round`` does as here.
    """
    scale = 10.0**digits
    s, r = x * scale, F.rint(x * scale)
    away = F.when((s - r == 0.5) & (s > 0), r + 1).when((s - r == -0.5) & (s < 0), r - 1).otherwise(r) / scale
    return F.when(F.isnan(s) | (F.abs(s) == float("inf")), x).otherwise(away)


def shuffle_key(node: str | Column, seed: int) -> Column:
    """Portable pseudo-random order of integer ids; ties are settled by the id."""
    return F.pmod(_c(node).cast("long") * F.lit(2654435761) + F.lit(seed * 97), F.lit(4294967296))


def elementwise_mean(vectors: str | Column, size: Column) -> Column:
    """Mean of an array of arrays, position by position."""
    return F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.aggregate(_c(vectors), F.lit(0.0), lambda s, v: s + v[i]) / F.size(_c(vectors)))

"""Vector functions over ARRAY columns, in doubles.

Lambdas of higher-order functions run outside whole-stage code generation: for many pairs use the blocks of operators.vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(doubles(x), doubles(y), lambda a, b: a * b))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(doubles(v), lambda a: a * a)))


def normalized(v: Column) -> Column:
    """v over its length; a zero vector stays.  The length goes into the inner lambda as a variable: a column would be computed again for every element."""
    by = lambda n: F.transform(doubles(v), lambda a: F.when(n > 0, a / n).otherwise(F.lit(0.0)))
    return F.try_element_at(F.transform(F.array(norm(v)), by), F.lit(1))


def cosine(x: Column, y: Column) -> Column:
    """Null if either is a zero vector."""
    return F.try_divide(dot(x, y), norm(x) * norm(y))


def cosine_or_zero(x: Column, y: Column) -> Column:
    return F.coalesce(cosine(x, y), F.lit(0.0))


def overlapping(offsets: Column, start: Column, end: Column) -> Column:
    """Indices (from 0) of the half-open, non-empty offsets (s, e) that overlap [start, end)."""
    indexed = F.transform(offsets, lambda o, i: F.struct(i.alias("i"), o["s"].alias("s"), o["e"].alias("e")))
    return F.transform(F.filter(indexed, lambda o: (o["s"] != o["e"]) & (o["s"] < end) & (o["e"] > start)), lambda o: o["i"])


def mean_of(vectors: Column) -> Column:
    """Element-wise mean of an array of vectors; null if there are none."""
    n = F.size(vectors)
    first = F.try_element_at(vectors, F.lit(1))
    added = F.aggregate(F.slice(vectors, 2, F.greatest(n - 1, F.lit(0))), doubles(first), lambda a, v: F.zip_with(a, doubles(v), lambda p, q: p + q))
    return F.when(n > 0, F.transform(added, lambda a: a / n))


def mean_at(vectors: Column, indices: Column) -> Column:
    """Mean of the vectors at the indices (from 0); null if there are none."""
    return mean_of(F.transform(indices, lambda i: F.get(vectors, i)))

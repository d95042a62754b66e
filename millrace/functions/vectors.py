"""Vector distances on array<double> columns. Vectors of different lengths are an error; a zero vector has no cosine distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _checked(a: Column, b: Column, value: Column) -> Column:
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in length")).cast("double")).otherwise(value)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _checked(a, b, _sum(F.zip_with(a, b, lambda x, y: x * y)))


def l2(a: Column, b: Column) -> Column:
    return _checked(a, b, F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))))


def negative_inner(a: Column, b: Column) -> Column:
    return -dot(a, b)


def cosine(a: Column, b: Column) -> Column:
    norms = F.sqrt(_sum(F.transform(a, lambda x: x * x))) * F.sqrt(_sum(F.transform(b, lambda x: x * x)))
    return F.when(norms > 0, 1 - dot(a, b) / norms)

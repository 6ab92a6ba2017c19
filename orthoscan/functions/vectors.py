"""Column builders for points (array<float>) and boxes (arrays lo and hi).

Elements are stored as floats and computed with as doubles.  A literal query
of up to UNROLL dimensions is written out term by term, which stays inside
generated code; longer ones, and queries in columns, use array functions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

UNROLL = 64


def literal_point(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _double(c: Column) -> Column:
    return c.cast("double")


def _fold(arrays: Sequence[Column], term) -> Column:
    """Sum of ``term`` over the places of arrays of one length."""
    zipped = F.arrays_zip(*[a.alias(f"_{i}") for i, a in enumerate(arrays)])
    return F.aggregate(zipped, F.lit(0.0), lambda s, x: s + term(*[_double(x[f"_{i}"]) for i in range(len(arrays))]))


def squared_distance(point: Column, query: Sequence[float] | Column) -> Column:
    """Squared Euclidean distance to a literal point or to another column."""
    if isinstance(query, Column):
        return _fold([point, query], lambda a, b: (a - b) * (a - b))
    if len(query) > UNROLL:
        return squared_distance(point, literal_point(query))
    return reduce(add, [(_double(point[i]) - float(q)) * (_double(point[i]) - float(q)) for i, q in enumerate(query)], F.lit(0.0))


def distance(point: Column, query: Sequence[float] | Column) -> Column:
    return F.sqrt(squared_distance(point, query))


def min_squared_distance(lo: Column, hi: Column, query: Column) -> Column:
    """Squared distance from a point to the nearest point of a box; 0 inside."""
    gap = lambda a, b, q: q - F.least(F.greatest(q, a), b)
    return _fold([lo, hi, query], lambda a, b, q: gap(a, b, q) * gap(a, b, q))


def volume(lo: Column, hi: Column) -> Column:
    """Product of the spans; 0 if any is negative."""
    spans = F.zip_with(hi, lo, lambda b, a: _double(b) - _double(a))
    return F.when(F.exists(spans, lambda s: s < 0), F.lit(0.0)).otherwise(F.aggregate(spans, F.lit(1.0), lambda p, s: p * s))


def union_lo(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.least(x, y))


def union_hi(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.greatest(x, y))


def enlargement(lo: Column, hi: Column, other_lo: Column, other_hi: Column) -> Column:
    """How much a box's volume grows to take in another box, or a point given as both corners."""
    return volume(union_lo(lo, other_lo), union_hi(hi, other_hi)) - volume(lo, hi)


def dead_space(lo: Column, hi: Column, other_lo: Column, other_hi: Column) -> Column:
    return volume(union_lo(lo, other_lo), union_hi(hi, other_hi)) - volume(lo, hi) - volume(other_lo, other_hi)


def _all(checks: Column) -> Column:
    return F.forall(checks, lambda ok: ok)


def overlaps(lo: Column, hi: Column, other_lo: Column, other_hi: Column) -> Column:
    """Closed boxes: touching ones overlap."""
    return _all(F.zip_with(lo, other_hi, lambda a, b: a <= b)) & _all(F.zip_with(hi, other_lo, lambda a, b: a >= b))


def contains(lo: Column, hi: Column, point: Column) -> Column:
    """Closed bounds; an inverted box contains nothing."""
    return _all(F.zip_with(lo, point, lambda a, p: a <= p)) & _all(F.zip_with(hi, point, lambda b, p: b >= p))


def truncate(point: Column, dims: int) -> Column:
    return F.slice(point, 1, dims)


def dot(point: Column, weights: Sequence[float]) -> Column:
    return reduce(add, [_double(point[i]) * float(w) for i, w in enumerate(weights)], F.lit(0.0))


def norm(point: Column) -> Column:
    return F.sqrt(F.aggregate(point, F.lit(0.0), lambda s, x: s + _double(x) * _double(x)))


def is_valid(point: Column, dims: int) -> Column:
    """Of the right length, with neither null, NaN nor infinite elements."""
    return point.isNotNull() & (F.size(point) == dims) & _all(F.transform(point, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))

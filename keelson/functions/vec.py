"""Vector arithmetic as column expressions over ``array<float|double>``.

Sums run from the first element to the last in double precision, so that the
same expression gives the same bits wherever it is evaluated.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Relative slack of gates: bounds and thresholds come from different expressions.
SLACK = 1e-9


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def doubles(v: Column | str) -> Column:
    """v, a column or its name, in double precision."""
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(doubles(v), lambda x: x * x)))


def norm1(v: Column) -> Column:
    return total(F.transform(doubles(v), lambda x: F.abs(x)))


def norm_inf(v: Column) -> Column:
    return F.array_max(F.transform(doubles(v), lambda x: F.abs(x)))


def norm_p(v: Column, p: float) -> Column:
    return F.pow(total(F.transform(doubles(v), lambda x: F.pow(F.abs(x), F.lit(p)))), F.lit(1.0 / p))


def scaled(v: Column, c: Column | float) -> Column:
    return F.transform(doubles(v), lambda x: x * c)


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x + y)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x - y)


def times(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x * y)


def distance(a: Column, b: Column) -> Column:
    return norm(minus(a, b))


def unit(v: Column, least: float = 1e-12) -> Column:
    """v divided by its length, which counts as ``least`` at least."""
    return scaled(v, 1.0 / F.greatest(norm(v), F.lit(least)))


def split_widths(dim: int, parts: int) -> list[tuple[int, int]]:
    """(start, width) of contiguous slices; the first ones take the remainder."""
    base, extra = divmod(dim, parts)
    widths = [base + (i < extra) for i in range(parts)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def piece(v: Column, start: int, width: int) -> Column:
    return F.slice(v, start + 1, width)


def interleaved(v: Column, part: int, parts: int) -> Column:
    return F.filter(v, lambda x, i: i % parts == part)


def each_dim(dim: int, make) -> Column:
    """An array of one aggregate per dimension; partial aggregates combine before the shuffle."""
    return F.array(*[make(i) for i in range(dim)])


def box_bound(q: Column, lo: Column, hi: Column) -> Column:
    """Largest q.k over the box: the better corner in each dimension."""
    return total(F.zip_with(doubles(q), F.arrays_zip(lo.alias("lo"), hi.alias("hi")), lambda x, b: F.greatest(x * b["lo"], x * b["hi"])))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)

"""Vector functions as Column expressions over array<double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f) -> Column:
    """f of a value that is computed once: a lambda's variable holds it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def unit(a: Column) -> Column:
    """At length one; a zero vector stays."""
    return let(F.greatest(norm(a), F.lit(1e-12)), lambda n: F.transform(a, lambda x: x / n))


def prefix(a: Column, k: int) -> Column:
    """The first k components at length one; a zero vector stays."""
    return let(F.slice(a, 1, k), unit)


def int8_scale(a: Column) -> Column:
    return F.greatest(F.array_max(F.transform(a, lambda x: F.abs(x))) / 127.0, F.lit(1e-8))


def int8(a: Column, scale: Column) -> Column:
    """Symmetric whole numbers of a row; halves go to even."""
    return F.transform(a, lambda x: F.greatest(F.lit(-128.0), F.least(F.lit(127.0), F.bround(x / scale))).cast("int"))


def from_int8(codes: Column, scale: Column) -> Column:
    return F.transform(codes, lambda x: x * scale)


def mean_pool(rows: Column, mask: Column) -> Column:
    """The mean of the rows whose mask is 1, at length one (a zero vector stays)."""
    kept = F.transform(F.filter(F.arrays_zip(rows.alias("v"), mask.alias("m")), lambda x: x["m"] == 1), lambda x: x["v"])
    zero = F.array_repeat(F.lit(0.0), F.size(F.get(rows, F.lit(0))))
    total = lambda vs: F.aggregate(vs, zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    mean = let(kept, lambda vs: let(total(vs), lambda t: F.transform(t, lambda x: x / F.greatest(F.size(vs), F.lit(1)))))
    return let(mean, unit)

"""Column expressions that the native operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 256


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)


def sums_before(lengths: Column) -> Column:
    """For each element of an array of longs the sum of all before it. Long arrays are summed in chunks, so the work is nearly linear."""
    chunks = F.transform(F.when(F.size(lengths) > 0, F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / CHUNK).cast("int"))).otherwise(F.array().cast("array<int>")), lambda k: F.slice(lengths, k * CHUNK + 1, CHUNK))
    sums = F.transform(chunks, _sum)
    bases = F.transform(sums, lambda x, i: _sum(F.slice(sums, F.lit(1), i)))
    return F.flatten(F.zip_with(chunks, bases, lambda c, b: F.transform(c, lambda x, i: b + _sum(F.slice(c, F.lit(1), i)))))

"""Byte strings as columns: one character per byte, so that regular expressions see bytes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed and read from its row once: each mention of a binary column copies the whole of it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def byte_text(content: Column | str) -> Column:
    """Binary content, or a string's UTF-8 bytes, as a string of characters 0 to 255. Its length is the size in bytes."""
    return F.decode(col(content).cast("binary"), "ISO-8859-1")


def to_hex(content: Column | str) -> Column:
    """Bytes as lower-case hexadecimal digits."""
    return F.lower(F.hex(col(content).cast("binary")))


def from_hex(digits: Column | str) -> Column:
    """Bytes of hexadecimal digits in either case, null for other text."""
    return F.unhex(col(digits))


def to_base64(content: Column | str) -> Column:
    """Bytes in base64, on one line."""
    return F.regexp_replace(F.base64(col(content).cast("binary")), r"\s", "")


def from_base64(text: Column | str) -> Column:
    """Bytes of base64 text; white space is passed over."""
    return F.unbase64(F.regexp_replace(col(text), r"\s", ""))


def window(content: Column | str, offset: Column | int, length: Column | int) -> Column:
    """The bytes ``offset`` to ``offset + length``: a nested view of an object."""
    return F.substring(col(content).cast("binary"), F.lit(offset) + 1, F.lit(length) if isinstance(length, int) else length)


def sums_before(lengths: Column, chunk: int = 256) -> Column:
    """For each element of an array of longs the sum of those before it; long arrays are summed chunk by chunk."""
    zero = F.lit(0).cast("long")
    add = lambda c: F.aggregate(c, zero, lambda a, x: a + x)
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(lengths) / chunk).cast("int") - 1)), lambda k: F.slice(lengths, k * chunk + 1, chunk))
    totals = F.transform(pieces, add)
    bases = F.transform(totals, lambda x, i: add(F.slice(totals, F.lit(1), i)))
    return F.flatten(F.zip_with(pieces, bases, lambda c, b: F.transform(c, lambda x, i: b + add(F.slice(c, F.lit(1), i)))))


def match_offsets(text: Column | str, regex: str) -> Column:
    """All offsets where ``regex`` matches, overlapping ones too, in ascending order, without a UDF.

    The text is split before every match; the pieces' lengths add up to the offsets.
    """
    t, ahead = col(text), f"(?s)(?={regex})"
    cut = F.split(t, ahead, -1)
    ends = F.zip_with(sums_before(F.transform(cut, lambda p: F.length(p).cast("long"))), cut, lambda a, p: a + F.length(p))
    inner = F.slice(ends, F.lit(1), F.size(ends) - 1)
    none = F.array().cast("array<bigint>")
    return F.when(~t.rlike(ahead), none).otherwise(F.concat(F.when(t.rlike(rf"\A{ahead}"), F.array(F.lit(0).cast("long"))).otherwise(none), inner))


def match_count(text: Column | str, regex: str) -> Column:
    """The number of offsets where ``regex`` matches. Overlapping hits all count."""
    return F.regexp_count(col(text), F.lit(f"(?s)(?={regex})"))


def _entropies(content: pd.Series) -> pd.Series:
    out = []
    for data in content:
        if data is None or not len(data):
            out.append(None)
            continue
        n = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        p = n[n > 0] / len(data)
        out.append(float(-(p * np.log2(p)).sum()))
    return pd.Series(out, dtype="Float64")


def entropy(content: Column | str) -> Column:
    """Shannon entropy of the bytes, in bits; null for no bytes. A histogram of bytes is no built-in function, so it is made in Arrow batches."""
    return pandas_udf(_entropies, "double")(col(content).cast("binary"))

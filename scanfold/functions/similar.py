"""Similarity of strings and pictures: what built-in functions have no equivalent for."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .raw import col

LONGEST = 49


def _common(a: str, b: str) -> tuple[int, int, int]:
    """Place in either string and length of the first of the longest common stretches."""
    best, before = (0, 0, 0), [0] * (len(b) + 1)
    for i, x in enumerate(a):
        row = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                row[j + 1] = before[j] + 1
                if row[j + 1] > best[2]:
                    best = (i - row[j + 1] + 1, j - row[j + 1] + 1, row[j + 1])
        before = row
    return best


def resemblance(a: str, b: str) -> int | None:
    """Percent of characters in common stretches, found longest first to either side; null for strings of over 49 characters."""
    if a.lower() == b.lower():
        return 100
    a, b = a.strip(), b.strip()
    if max(len(a), len(b)) > LONGEST:
        return None
    score, todo = 0, [(a, b)]
    while todo:
        x, y = todo.pop()
        i, j, n = _common(x, y)
        if n:
            score += n
            for p, q in ((x[:i], y[:j]), (x[i + n :], y[j + n :])):
                if p and q and len(p) + len(q) > 2:
                    todo.append((p, q))
    return score * 200 // (len(a) + len(b)) if a or b else 0


def _resembles(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else resemblance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def similarity(a: Column | str, b: Column | str) -> Column:
    return pandas_udf(_resembles, "int")(col(a), col(b))


def _lanczos(n: int, size: int = 32, lobes: int = 3) -> np.ndarray:
    """size x n weights of a resampling with a windowed sinc, widened when it shrinks."""
    scale = n / size
    wide = max(scale, 1.0)
    centre = (np.arange(size) + 0.5) * scale
    x = (np.arange(n)[None, :] + 0.5 - centre[:, None]) / wide
    w = np.where(np.abs(x) < lobes, np.sinc(x) * np.sinc(x / lobes), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def grey(pixels: np.ndarray) -> np.ndarray:
    """Luma of height x width x channels, or what is grey already."""
    return pixels.astype(np.float64) if pixels.ndim == 2 else np.floor(pixels[..., :3].astype(np.float64) @ (0.2126, 0.7152, 0.0722))


def picture_hash(pixels: np.ndarray) -> str:
    """Sixteen hexadecimal digits: are the lowest 8 x 8 cosine coefficients of the picture, shrunk to 32 x 32, over their median?"""
    g = grey(pixels)
    small = np.clip(np.round(_lanczos(g.shape[0]) @ g @ _lanczos(g.shape[1]).T), 0, 255) / 255
    basis = 2 * np.cos(np.pi * np.arange(8)[:, None] * (2 * np.arange(32) + 1) / 64)
    low = np.round((basis @ small @ basis.T).ravel(), 9)
    return np.packbits(low > np.median(low)).tobytes().hex()


def _picture(pixels: pd.Series, width: pd.Series, channels: pd.Series) -> pd.Series:
    out = []
    for p, w, c in zip(pixels, width, channels, strict=True):
        try:
            a = np.frombuffer(p, np.uint8).reshape(-1, int(w), int(c))
            out.append(picture_hash(a[..., 0] if c == 1 else a))
        except (TypeError, ValueError):
            out.append(None)
    return pd.Series(out, dtype=object)


def image_hash(pixels: Column | str, width: Column | str, channels: Column | int = 1) -> Column:
    """The hash of raw 8-bit samples of a picture; null where they don't fill its rows."""
    return pandas_udf(_picture, "string")(col(pixels), col(width), F.lit(channels) if isinstance(channels, int) else channels)


def regex_suffixes(pattern: str, limit: int = 64) -> list[str]:
    """Literal endings that any match of a host pattern has, from the last dot on: keys to join by before the pattern is tried.

    An empty list says that there are none; alternatives at the end give one each.
    """
    import re

    body = re.sub(r"\$\Z", "", pattern)
    m = re.search(r"((?:\\\.|[A-Za-z0-9-])+)\Z", body)
    if m and not body[: m.start()].endswith("\\"):
        return [m[1].replace("\\.", ".")]
    m = re.search(r"((?:\\\.|[A-Za-z0-9-])*)\(((?:[A-Za-z0-9-]|\\\.|\|)+)\)\Z", body)
    if m:
        found = [(m[1] + x).replace("\\.", ".") for x in m[2].split("|")]
        return found if len(found) <= limit else []
    return []

"""PNG columns: lossless storage of bytes as grey samples, checked reading, cosine-transform hashes."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def filtered(rows: np.ndarray, kind: int, bpp: int = 1) -> np.ndarray:
    """Rows of bytes under one of the five row filters, each with its type in front."""
    left = np.zeros_like(rows)
    left[:, bpp:] = rows[:, :-bpp]
    up = np.zeros_like(rows)
    up[1:] = rows[:-1]
    if kind == 4:
        corner = np.zeros_like(rows)
        corner[1:, bpp:] = rows[:-1, :-bpp]
        guess = _paeth(left, up, corner)
    else:
        guess = (0, left, up, ((left.astype(np.uint16) + up) >> 1).astype(np.uint8))[kind]
    return np.hstack([np.full((len(rows), 1), kind, np.uint8), rows - guess])


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    a, b, c = (x.astype(np.int16) for x in (a, b, c))
    pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
    return np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c)).astype(np.uint8)


def unfiltered(data: np.ndarray, bpp: int = 1) -> np.ndarray:
    """The samples of filtered rows; runs of rows under filters 0 and 2 are undone at once."""
    kinds, rows = data[:, 0], data[:, 1:].copy()
    y, n = 0, len(rows)
    while y < n:
        kind, prior = kinds[y], rows[y - 1] if y else np.zeros(rows.shape[1], np.uint8)
        end = y + 1
        if kind in (0, 2):
            other = np.flatnonzero(kinds[y:] != kind)
            end = y + int(other[0]) if len(other) else n
        if kind == 2:
            rows[y] += prior
            rows[y:end] = np.cumsum(rows[y:end], axis=0, dtype=np.uint8)
        elif kind == 1:
            for k in range(bpp):
                rows[y, k::bpp] = np.cumsum(rows[y, k::bpp], dtype=np.uint8)
        elif kind == 3:
            row, up = bytearray(rows[y].tobytes()), prior.tobytes()
            for k in range(len(row)):
                row[k] = row[k] + ((row[k - bpp] if k >= bpp else 0) + up[k] >> 1) & 255
            rows[y] = np.frombuffer(row, np.uint8)
        elif kind == 4:
            row, up = bytearray(rows[y].tobytes()), prior.tobytes()
            for k in range(len(row)):
                a, b, c = (row[k - bpp], up[k], up[k - bpp]) if k >= bpp else (0, up[k], 0)
                d = a + b - c
                x, y_, z = abs(d - a), abs(d - b), abs(d - c)
                row[k] = row[k] + (a if x <= y_ and x <= z else b if y_ <= z else c) & 255
            rows[y] = np.frombuffer(row, np.uint8)
        elif kind != 0:
            raise ValueError(f"unknown row filter {kind}")
        y = end
    return rows


def encode_png(samples: np.ndarray, row_filter: int = 2, level: int = 1, stripe: int = 1 << 20) -> bytes:
    """An 8-bit grey PNG of a two-dimensional array of bytes; rows are filtered and compressed a stripe at a time."""
    height, width = samples.shape
    deflate, body, step = zlib.compressobj(level), [], max(1, stripe // max(1, width))
    for y in range(0, height, step):
        above = samples[y - 1 : y] if y else samples[:0]
        rows = filtered(np.vstack([above, samples[y : y + step]]), row_filter)[len(above) :]
        body.append(deflate.compress(rows.tobytes()))
    body.append(deflate.flush())
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", b"".join(body)) + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """The 8-bit samples of a PNG that isn't interlaced, as height x width x channels. Every chunk's checksum is tested."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, body = 8, None, []
    while True:
        if at + 12 > len(data):
            raise ValueError("the PNG ends within a chunk")
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        if len(part) < n or at + 12 + n > len(data) or struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + part):
            raise ValueError(f"bad checksum in chunk {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        elif kind == b"IEND":
            break
        at += 12 + n
    if head is None or head[2] != 8 or head[6]:
        raise ValueError("only 8-bit PNGs without interlacing are read")
    bpp = CHANNELS[head[3]]
    size, inflate = head[1] * (1 + head[0] * bpp), zlib.decompressobj()
    raw = np.frombuffer(inflate.decompress(b"".join(body), size + 1), np.uint8)  # never more than the head tells
    if len(raw) != size or inflate.unconsumed_tail:
        raise ValueError("the samples don't fill the image")
    return unfiltered(raw.reshape(head[1], -1), bpp).reshape(head[1], head[0], bpp)


_COSINE = np.cos(np.pi * np.arange(8)[:, None] * (2 * np.arange(32) + 1) / 64)


def _means(x: np.ndarray, size: int = 32) -> np.ndarray:
    """Means over ``size`` equal stretches of the rows; a row that a stretch cuts counts in part."""
    n = len(x)
    out = np.zeros((size, x.shape[1]))
    for k in range(size):
        a, b = k * n, (k + 1) * n  # in parts of 1 / size of a row
        first, last = -(-a // size), b // size
        if first <= last:
            out[k] = x[first:last].sum(axis=0, dtype=np.float64) * size
            if a < first * size:
                out[k] += x[first - 1].astype(np.float64) * (first * size - a)
            if last * size < b:
                out[k] += x[last].astype(np.float64) * (b - last * size)
        else:
            out[k] = x[last].astype(np.float64) * (b - a)
    return out / n


def dct_hash(grey: np.ndarray) -> bytes:
    """64 bits, row by row: is each of the 8 x 8 lowest cosine coefficients of the image, reduced to 32 x 32 means, over their median?"""
    c = np.round(_COSINE @ _means(_means(grey).T) @ _COSINE.T, 3).T.ravel()
    return np.packbits(c > np.median(c)).tobytes()


def store(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 64, row_filter: int = 2, level: int = 1) -> DataFrame:
    """Texts as PNG columns: (doc_id, n_bytes long, media binary).

    The UTF-8 bytes, zeros up to a positive multiple of ``width`` added, are the samples of a grey image ``width``
    wide, each stored as its difference from the row above (filter 2). A null or empty text is a row of zeros. Null ids and
    repeated rows are stored row by row; a very long text is filtered and compressed a stripe at a time, so it takes a few
    times its own size of memory; other columns are ignored, whatever their names; an empty table gives no rows.
    """
    work = common.with_small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.text_slices(batches, "text"):
            body, at = common.utf8(batch.column("text"))
            media = []
            for a, b in zip(at[:-1], at[1:], strict=True):
                samples = np.zeros(max(1, -(-(b - a) // width)) * width, np.uint8)
                samples[: b - a] = body[a:b]
                media.append(encode_png(samples.reshape(-1, width), row_filter, level))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return work.mapInArrow(run, f"doc_id {work.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def features(stored: DataFrame, *, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Read PNG columns back: (doc_id, n_bytes, media, payload binary, feature binary, error string).

    payload holds the samples, feature the cosine-transform hash of the image (colour channels averaged). Media that
    is null, cut short, fails a checksum or holds more than its head tells has null payload and feature, and says why in
    error. Repeated rows and null ids are read row by row; other columns are ignored; an empty table gives no rows.
    """
    size = "n_bytes" if "n_bytes" in stored.columns else None
    work = common.with_small_batches(stored).select(F.col(id_col).alias("doc_id"), (F.col(size) if size else F.lit(None)).cast("long").alias("n_bytes"), F.col(media_col).cast("binary").alias("media"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.text_slices(batches, "media"):
            rows = []
            for data in batch.column("media").to_pylist():
                try:
                    samples = decode_png(data or b"")
                    rows.append((samples.tobytes(), dct_hash(samples.mean(axis=2) if samples.shape[2] > 1 else samples[:, :, 0]), None))
                except (ValueError, KeyError, zlib.error, struct.error) as e:
                    rows.append((None, None, str(e)))
            out = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.binary(), pa.binary(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=["doc_id", "n_bytes", "media", "payload", "feature", "error"])

    return work.mapInArrow(run, f"doc_id {work.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary, payload binary, feature binary, error string")



"""Pictures from their files: PNG, GIF and BMP to samples, and their perceptual hashes."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .similar import picture_hash

MOST = 64 << 20


def png(data: bytes) -> np.ndarray:
    """Samples of a PNG of 8 bits a channel that isn't interlaced, palettes resolved: height x width x channels."""
    at, head, body, palette = 8, None, [], None
    while at + 12 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(part)
        elif kind == b"IEND":
            break
        at += 12 + n
    if head is None or head[2] != 8 or head[6] or head[3] not in (0, 2, 3, 4, 6):
        raise ValueError("a form of PNG that isn't read")
    width, height, bpp = head[0], head[1], {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[head[3]]
    size = height * (1 + width * bpp)
    if size > MOST:
        raise ValueError("too large a picture")
    raw = zlib.decompressobj().decompress(b"".join(body), size)
    if len(raw) < size:
        raise ValueError("a picture cut short")
    rows, prior = [], bytes(width * bpp)
    for y in range(height):
        kind, row = raw[y * (1 + width * bpp)], bytearray(raw[y * (1 + width * bpp) + 1 : (y + 1) * (1 + width * bpp)])
        if kind == 2:
            row = bytearray((np.frombuffer(row, np.uint8) + np.frombuffer(prior, np.uint8)).tobytes())
        elif kind:
            for k in range(len(row)):
                a, b, c = (row[k - bpp], prior[k], prior[k - bpp]) if k >= bpp else (0, prior[k], 0)
                if kind == 1:
                    guess = a
                elif kind == 3:
                    guess = a + b >> 1
                else:
                    d = a + b - c
                    guess = min((abs(d - a), 0, a), (abs(d - b), 1, b), (abs(d - c), 2, c))[2]
                row[k] = row[k] + guess & 255
        prior = bytes(row)
        rows.append(prior)
    out = np.frombuffer(b"".join(rows), np.uint8).reshape(height, width, bpp)
    return palette[out[..., 0]] if head[3] == 3 else out


def _gif_codes(data: bytes, least: int, most: int) -> bytes:
    table, out = [bytes([k]) for k in range(1 << least)] + [b"", b""], bytearray()
    clear, width, held, count, before = 1 << least, least + 1, 0, 0, None
    for b in data:
        held |= b << count
        count += 8
        while count >= width:
            code, held, count = held & (1 << width) - 1, held >> width, count - width
            if code == clear:
                table, width, before = table[: clear + 2], least + 1, None
                continue
            if code == clear + 1 or len(out) >= most:
                return bytes(out)
            entry = table[code] if code < len(table) else (before or b"") + (before or b"")[:1]
            out += entry
            if before is not None and len(table) < 4096:
                table.append(before + entry[:1])
            before = entry
            if len(table) == 1 << width and width < 12:
                width += 1
    return bytes(out)


def gif(data: bytes) -> np.ndarray:
    """The first frame of a GIF."""
    flags, at = data[10], 13
    palette = np.zeros((256, 3), np.uint8)
    if flags & 0x80:
        n = 2 << (flags & 7)
        palette[:n] = np.frombuffer(data[at : at + 3 * n], np.uint8).reshape(-1, 3)
        at += 3 * n
    while data[at] == 0x21:
        at += 2
        while data[at]:
            at += data[at] + 1
        at += 1
    if data[at] != 0x2C:
        raise ValueError("a GIF without a frame")
    width, height, own = struct.unpack_from("<HHB", data, at + 5)
    at += 10
    if own & 0x80:
        n = 2 << (own & 7)
        palette[:n] = np.frombuffer(data[at : at + 3 * n], np.uint8).reshape(-1, 3)
        at += 3 * n
    least, at, parts = data[at], at + 1, []
    while data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += data[at] + 1
    codes = np.frombuffer(_gif_codes(b"".join(parts), least, min(width * height, MOST)), np.uint8)
    if len(codes) < width * height or own & 0x40:
        raise ValueError("a form of GIF that isn't read")
    return palette[codes[: width * height].reshape(height, width)]


def bmp(data: bytes) -> np.ndarray:
    """An uncompressed bitmap of 24 or 32 bits."""
    start, _, width, height, _, depth, packing = struct.unpack_from("<IIiiHHI", data, 10)
    if depth not in (24, 32) or packing not in (0, 3) or width <= 0:
        raise ValueError("a form of bitmap that isn't read")
    step = (width * depth // 8 + 3) // 4 * 4
    rows = np.frombuffer(data[start : start + step * abs(height)], np.uint8).reshape(abs(height), step)[:, : width * depth // 8]
    out = rows.reshape(abs(height), width, depth // 8)[..., 2::-1]
    return out[::-1] if height > 0 else out


READERS = ((b"\x89PNG", png), (b"GIF8", gif), (b"BM", bmp))


def file_hash(data: bytes | None) -> str | None:
    """The perceptual hash of a picture's file, None for what isn't a picture of a kind that is read."""
    for magic, read in READERS:
        if data and data.startswith(magic):
            try:
                pixels = read(data)
                return picture_hash(pixels[..., 0] if pixels.shape[2] < 3 else pixels[..., :3])
            except (ValueError, IndexError, struct.error, zlib.error):
                return None
    return None


def hashed(objects: DataFrame, *, id_col: str = "object_id", content: str = "content") -> DataFrame:
    """(object, image_hash) of the objects that are pictures; others aren't sent to Python."""
    head = F.hex(F.substring(F.col(content).cast("binary"), 1, 4))
    looks = head.startswith("89504E47") | head.startswith("47494638") | head.startswith("424D")
    rows = objects.where(looks).select(F.col(id_col).alias("id"), F.col(content).cast("binary").alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [file_hash(batch.column("content")[k].as_py()) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.string())], names=["id", "image_hash"])

    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, image_hash string")
    return out.where("image_hash is not null").withColumnRenamed("id", id_col)

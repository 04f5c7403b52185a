"""Structure checks of media and further containers, registered beside the decoders."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import raw
from . import members


def jpeg(data: bytes, limit: int) -> Iterator[tuple]:
    """Marker segments; what breaks the order or is cut short raises an alert."""
    say = lambda x: (None, 0, 0, False, 0, None, f"Heuristics.Broken.Media.JPEG.{x}")
    at, k, seen, images = 2, 0, set(), 0
    while at < len(data):
        if data[at] != 0xFF:
            yield say("SpuriousBytesBeforeSegment")
            return
        while at < len(data) and data[at] == 0xFF:
            at += 1
        if at >= len(data):
            yield say("CantReadMarker")
            return
        mark = data[at]
        at += 1
        if mark == 0xD9:
            break
        if mark in (0x01, *range(0xD0, 0xD9)):
            continue
        if at + 2 > len(data):
            yield say("CantReadSegmentSize")
            return
        n = struct.unpack_from(">H", data, at)[0]
        if n < 2:
            yield say("InvalidSegmentSize") if mark != 0xFE else (None, 0, 0, False, 0, None, "Heuristics.Exploit.W32.MS04-028")
            return
        if at + n > len(data):
            yield say("SegmentDataOutOfFile")
            return
        k += 1
        body = data[at + 2 : at + n]
        if mark == 0xE0 and body[:5] == b"JFIF\0":
            if "jfif" in seen:
                yield say("JFIFdupAppMarker")
            if n < 16:
                yield say("JFIFheaderTooShort")
            seen.add("jfif")
        if mark == 0xE1 and body[:6] == b"Exif\0\0":
            if "exif" in seen:
                yield say("ExifDupAppMarker")
            if n < 16:
                yield say("ExifHeaderTooShort")
            seen.add("exif")
        yield f"ff{mark:02x}", n, n, False, k, body[:limit], None
        at += n
        if mark == 0xDA:
            images += 1
            while at + 1 < len(data) and not (data[at] == 0xFF and data[at + 1] not in (0, *range(0xD0, 0xD8))):
                at += 1
    if not images:
        yield say("NoImages")


def tiff(data: bytes, limit: int) -> Iterator[tuple]:
    """Directories and their entries; places outside the file raise an alert."""
    say = lambda x: (None, 0, 0, False, 0, None, f"Heuristics.Broken.Media.TIFF.{x}")
    order = "<" if data[:2] == b"II" else ">"
    if len(data) < 8:
        yield say("EOFReadingFirstIFDOffset")
        return
    at, k, before = struct.unpack_from(order + "I", data, 4)[0], 0, 0
    if at == 0 or at >= len(data):
        yield say("InvalidIFDOffset")
        return
    sizes = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
    while at:
        if at <= before:
            yield say("OutOfOrderIFDOffset")
            return
        if at + 2 > len(data):
            yield say("EOFReadingNumIFDDirectoryEntries")
            return
        n = struct.unpack_from(order + "H", data, at)[0]
        for e in range(n):
            p = at + 2 + 12 * e
            if p + 12 > len(data):
                yield say("EOFReadingIFDEntry")
                return
            tag, kind, count, value = struct.unpack_from(order + "HHII", data, p)
            size = sizes.get(kind, 0) * count
            if size > 4 and value + size > len(data):
                yield say("OutOfBoundsAccess")
                return
            k += 1
            yield f"tag{tag}", size, size, False, k, data[value : value + min(size, limit)] if size > 4 else data[p + 8 : p + 12], None
        end = at + 2 + 12 * n
        if end + 4 > len(data):
            yield say("EOFReadingChunkCRC")
            return
        before, at = at, struct.unpack_from(order + "I", data, end)[0]
        if at >= len(data):
            yield say("InvalidIFDOffset")
            return


def riff(data: bytes, limit: int) -> Iterator[tuple]:
    """Chunks; an animated cursor whose header is longer than its format says raises an alert."""
    order = "<" if data[:4] == b"RIFF" else ">"
    todo, k = [(12, len(data))], 0
    while todo:
        at, end = todo.pop()
        while at + 8 <= end:
            kind, n = data[at : at + 4], struct.unpack_from(order + "I", data, at + 4)[0]
            k += 1
            alert = "Heuristics.Exploit.W32.MS05-002" if kind == b"anih" and n != 36 else None
            yield kind.decode("latin-1"), n, n, False, k, data[at + 8 : at + 8 + min(n, limit)], alert
            if kind in (b"LIST", b"PROP", b"FORM", b"CAT "):
                todo.append((at + 12, min(end, at + 8 + n)))
            at += 8 + n + (n & 1)


def apple_map(data: bytes, limit: int) -> Iterator[tuple]:
    """Partitions of an Apple map; ones that cross raise an alert."""
    size = struct.unpack_from(">H", data, 2)[0] or 512
    count = struct.unpack_from(">I", data, size + 4)[0]
    found = []
    for k in range(1, min(count, 128) + 1):
        if data[size * k : size * k + 2] != b"PM":
            break
        first, n = struct.unpack_from(">II", data, size * k + 8)
        name = data[size * k + 16 : size * k + 48].split(b"\0")[0].decode("latin-1")
        if data[size * k + 48 : size * k + 80].split(b"\0")[0] != b"Apple_partition_map":
            found.append((name, first * size, n * size))
    end, crossed = -1, False
    for _, a, n in sorted(found, key=lambda x: x[1:]):
        crossed |= a < end
        end = max(end, a + n)
    for k, (name, a, n) in enumerate(found):
        yield name, n, n, False, k + 1, data[a : a + min(n, limit)], "Heuristics.APMPartitionIntersection" if crossed and k == 0 else None


def binhex(data: bytes, limit: int) -> Iterator[tuple]:
    """Data and resource forks of a BinHex file."""
    table = b"!\"#$%&'()*+,-012345689@ABCDEFGHIJKLMNPQRSTUVXYZ[`abcdefhijklmpqr"
    start = data.find(b":")
    body = data[start + 1 : data.find(b":", start + 1)].translate(None, b" \t\r\n")
    bits, n, raw_ = 0, 0, bytearray()
    for c in body:
        bits, n = bits << 6 | table.index(c), n + 6
        if n >= 8:
            n -= 8
            raw_.append(bits >> n & 255)
            bits &= (1 << n) - 1
    out = bytearray()
    k = 0
    while k < len(raw_):
        if raw_[k] == 0x90 and k + 1 < len(raw_):
            out += b"\x90" if raw_[k + 1] == 0 else out[-1:] * (raw_[k + 1] - 1)
            k += 2
        else:
            out.append(raw_[k])
            k += 1
    length = out[0]
    name = bytes(out[1 : 1 + length]).decode("latin-1")
    head = 2 + length
    data_size, res_size = struct.unpack_from(">II", out, head + 10)
    at = head + 20
    yield name, len(data), data_size, False, 1, bytes(out[at : at + min(data_size, limit)]), None
    if res_size:
        at += data_size + 2
        yield f"{name}/rsrc", len(data), res_size, False, 2, bytes(out[at : at + min(res_size, limit)]), None


def tnef(data: bytes, limit: int) -> Iterator[tuple]:
    """Attachments of a TNEF stream, under their titles."""
    at, k, title, found = 6, 0, None, []
    while at + 9 <= len(data):
        level, tag, n = struct.unpack_from("<BII", data, at)
        body = data[at + 9 : at + 9 + n]
        if level == 2 and tag & 0xFFFF == 0x9002:
            title = None
        elif level == 2 and tag & 0xFFFF == 0x8010:
            title = body.rstrip(b"\0").decode("latin-1")
            if found and found[-1][0] is None:
                found[-1][0] = title
        elif level == 2 and tag & 0xFFFF == 0x800F:
            found.append([title, body])
        at += 9 + n + 2
    for k, (name, body) in enumerate(found):
        yield name, len(body), len(body), False, k + 1, body[:limit], None


for _kind, _decoder in {"JPEG": jpeg, "TIFF": tiff, "RIFF": riff, "APM": apple_map, "BINHEX": binhex, "TNEF": tnef}.items():
    members.register(_kind, _decoder)


#: Types that are looked for inside of other objects: magic, type.
INSIDE = ((b"PK\x03\x04", "ZIPSFX"), (b"Rar!\x1a\x07", "RARSFX"), (b"7z\xbc\xaf\x27\x1c", "7ZSFX"), (b"MSCF", "CABSFX"), (b"MZ", "MSEXE"), (b"\xef\xbe\xad\xdeNullsoftInst", "NULSFT"), (b"%PDF-", "PDF"))
MOST = 10


def embedded(objects: DataFrame, kinds: tuple[tuple[bytes, str], ...] = INSIDE, *, id_col: str = "object_id", content: str = "content", most: int | None = MOST) -> DataFrame:
    """(parent_id, offset, type, content): from each place past the start where a magic stands, the object to its end.

    Each place counts once, in ascending order; with more than ``most`` places the first ones are taken, as the rule has
    it; None takes all. All in expressions, one pass.
    """
    text = raw.byte_text(content)
    every = F.concat(*(_places(magic, kind) for magic, kind in kinds))
    rows = objects.select(F.col(id_col).alias("parent_id"), F.col(content).cast("binary").alias("_c"), text.alias("_t"))
    hits = F.array_sort(F.filter(every, lambda p: p["offset"] > 0))
    hits = hits if most is None else F.slice(hits, 1, most)
    out = rows.select("parent_id", "_c", F.explode(hits).alias("p"))
    return out.select("parent_id", F.col("p.offset").alias("offset"), F.col("p.type").alias("type"), F.substring(F.col("_c"), (F.col("p.offset") + 1).cast("int"), F.lit(2147483647)).alias("content"))


def _places(magic: bytes, kind: str) -> Column:
    regex = "".join(f"\\x{b:02x}" for b in magic)
    return F.transform(raw.match_offsets("_t", regex), lambda o: F.struct(o.alias("offset"), F.lit(kind).alias("type")))


def archive_tables(objects: DataFrame, *, id_col: str = "object_id", content: str = "content") -> DataFrame:
    """Members of signature archives: what follows the 512-byte head, a tar, packed or plain."""
    rest = F.substring(F.col(content).cast("binary"), F.lit(513), F.lit(2147483647))
    packed = F.hex(F.substring(rest, 1, 2)) == "1F8B"
    rows = objects.select(F.col(id_col).alias("object_id"), rest.alias("content"), F.when(packed, "GZ").otherwise("POSIX_TAR").alias("type"))
    plain = rows.where("type = 'POSIX_TAR'")
    opened = members.children(rows.where("type = 'GZ'")).select(F.col("parent_id").alias("object_id"), "content", F.lit("POSIX_TAR").alias("type"))
    return members.children(plain.unionByName(opened.select("object_id", "content", "type"))).select(F.col("parent_id").alias("object_id"), "fname", "content")


def indicators_of_compromise(text: Column | str) -> Column:
    """Digests (type, value) that an indicator document in XML names."""
    c = F.col(text) if isinstance(text, str) else text
    items = F.regexp_extract_all(c, F.lit(r"(?is)(<IndicatorItem\b.*?</IndicatorItem>)"), F.lit(1))
    one = lambda i: F.struct(F.lower(F.regexp_extract(i, r"(?is)<Content\b[^>]*type=\"(md5|sha1|sha256)\"", 1)).alias("algo"), F.lower(F.trim(F.regexp_extract(i, r"(?is)<Content\b[^>]*>([^<]*)<", 1))).alias("digest"))
    return F.filter(F.transform(items, one), lambda d: d["algo"] != "")


def dumped(objects: DataFrame, path: str) -> None:
    """Write objects with their metadata as Parquet, by type."""
    objects.write.mode("append").partitionBy("type").parquet(path)

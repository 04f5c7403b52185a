"""Decoders of office documents: compound files and their macros, rich text, XML forms, notebooks."""

from __future__ import annotations

import base64
import re
import struct
import zlib
from collections.abc import Iterator

from . import members
from .members import Row
from .packed import copied

FREE, END = 0xFFFFFFFF, 0xFFFFFFFE


class Compound:
    """A compound file: sectors in chains, small streams in a chain of their own, a tree of names."""

    def __init__(self, data: bytes):
        if data[:8] != b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
            raise ValueError("not a compound file")
        self.data = data
        self.sector, self.small = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
        n_fat, root, _, self.cut, mini, _, more, n_more = struct.unpack_from("<8I", data, 44)
        listed = list(struct.unpack_from("<109I", data, 76))
        seen: set[int] = set()
        while more < END and more not in seen and len(seen) <= n_more:
            seen.add(more)
            part = struct.unpack_from(f"<{self.sector // 4}I", data, self._at(more))
            listed, more = listed + list(part[:-1]), part[-1]
        self.fat: list[int] = []
        for s in [x for x in listed if x < END][:n_fat]:
            self.fat += struct.unpack(f"<{self.sector // 4}I", data[self._at(s) : self._at(s) + self.sector].ljust(self.sector, b"\xff"))
        raw = self.chain(mini)
        self.mini = list(struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4]))
        tree = self.chain(root)
        self.entries = [tree[k : k + 128] for k in range(0, len(tree) - 127, 128)]
        start, size = struct.unpack_from("<IQ", self.entries[0], 116)
        self.smalls = self.chain(start)[:size] if start < END else b""

    def _at(self, sector: int) -> int:
        return (sector + 1) * self.sector

    def chain(self, sector: int) -> bytes:
        out, seen = [], set()
        while sector < END and sector not in seen and sector < len(self.fat) + (not self.fat):
            seen.add(sector)
            out.append(self.data[self._at(sector) : self._at(sector) + self.sector])
            sector = self.fat[sector]
        return b"".join(out)

    def stream(self, start: int, size: int) -> bytes:
        if size >= self.cut:
            return self.chain(start)[:size]
        out, seen = [], set()
        while start < END and start not in seen and start < len(self.mini):
            seen.add(start)
            out.append(self.smalls[start * self.small : (start + 1) * self.small])
            start = self.mini[start]
        return b"".join(out)[:size]

    def streams(self) -> Iterator[tuple[str, bytes]]:
        """Paths and contents of all streams, storages in the order of their trees."""
        todo, seen = [("", struct.unpack_from("<I", self.entries[0], 76)[0])], set()
        while todo:
            path, n = todo.pop(0)
            if n >= len(self.entries) or n in seen:
                continue
            seen.add(n)
            e = self.entries[n]
            left, right, child = struct.unpack_from("<III", e, 68)
            name = e[: max(0, struct.unpack_from("<H", e, 64)[0] - 2)].decode("utf-16-le", "replace")
            todo[:0] = [(path, left)]
            todo += [(path, right)]
            if e[66] == 1:
                todo.append((f"{path}{name}/", child))
            elif e[66] == 2:
                yield path + name, self.stream(*struct.unpack_from("<IQ", e, 116))


def vba_decompressed(data: bytes, limit: int = 1 << 26) -> bytes:
    """The container of macro sources: chunks of flagged plain bytes and copies."""
    if data[:1] != b"\x01":
        raise ValueError("not a container of macros")
    out, at = bytearray(), 1
    while at + 2 <= len(data) and len(out) < limit:
        head = struct.unpack_from("<H", data, at)[0]
        end, begin = min(len(data), at + (head & 0xFFF) + 3), len(out)
        at += 2
        if not head & 0x8000:
            out += data[at:end]
            at = end
            continue
        while at < end:
            flags, at = data[at], at + 1
            if not flags:
                out += data[at : min(at + 8, end)]
                at = min(at + 8, end)
                continue
            for bit in range(8):
                if at >= end:
                    break
                if not flags >> bit & 1:
                    out.append(data[at])
                    at += 1
                    continue
                token = struct.unpack_from("<H", data, at)[0]
                at += 2
                width = max(4, (len(out) - begin - 1).bit_length())
                distance, n = (token >> 16 - width) + 1, (token & 0xFFFF >> width) + 3
                if distance > len(out):
                    raise IndexError("a copy from before the start")
                copied(out, distance, n)
    return bytes(out)


def macros(streams: dict[str, bytes]) -> Iterator[tuple[str, bytes]]:
    """Names and sources of the modules that the directory stream of each project lists."""
    for path, raw in streams.items():
        if path.rsplit("/", 1)[-1].lower() != "dir":
            continue
        try:
            listing = vba_decompressed(raw)
        except ValueError:
            continue
        folder, at, name, stream = path[: -len("dir")], 0, None, None
        while at + 6 <= len(listing):
            kind, size = struct.unpack_from("<HI", listing, at)
            body = listing[at + 6 : at + 6 + size]
            at += 6 + size
            if kind == 0x09:  # the version has two bytes that its length doesn't count
                at += 2
            elif kind == 0x19:
                name = body.decode("latin-1")
            elif kind == 0x1A:
                stream = body.decode("latin-1")
            elif kind == 0x31 and stream is not None:
                source = streams.get(folder + stream)
                if source is not None:
                    yield name or stream, vba_decompressed(source[struct.unpack("<I", body)[0] :])
                name = stream = None


def compound(data: bytes, limit: int) -> Iterator[Row]:
    """Streams of a compound file, then the sources of its macros; encrypted packages raise an alert."""
    streams = dict(Compound(data).streams())
    hidden = any(p.rsplit("/", 1)[-1] == "EncryptedPackage" for p in streams)
    k = 0
    for path, body in streams.items():
        k += 1
        yield path, len(body), len(body), False, k, body[:limit], "Heuristics.Encrypted.Doc" if hidden and k == 1 else None
    for name, source in macros(streams):
        k += 1
        yield f"{name}.vba", len(source), len(source), False, k, source[:limit], None


def rich_text(data: bytes, limit: int) -> Iterator[Row]:
    """Objects embedded in rich text: hexadecimal digits, with the native data of an object where its head tells it."""
    for k, m in enumerate(re.finditer(rb"\\objdata\b((?:[^{}\\]|\\[a-z]+-?\d* ?|\\'[0-9a-f]{2})*)", data)):
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", re.sub(rb"\\'[0-9a-f]{2}|\\[a-z]+-?\d* ?", b"", m[1]))
        raw = bytes.fromhex(digits[: len(digits) // 2 * 2].decode())
        name, body = None, raw
        try:
            at = 8
            for _ in range(3):
                n = struct.unpack_from("<I", raw, at)[0]
                name = name or raw[at + 4 : at + 4 + n].rstrip(b"\0").decode("latin-1")
                at += 4 + n
            size = struct.unpack_from("<I", raw, at)[0]
            if struct.unpack_from("<I", raw, 4)[0] == 2 and at + 4 + size <= len(raw):
                body = raw[at + 4 : at + 4 + size]
        except (struct.error, IndexError):
            pass
        yield name, len(m[1]), len(body), False, k + 1, body[:limit], None


def office_xml(data: bytes, limit: int) -> Iterator[Row]:
    """Binary data in base64 of the XML forms of office documents; a packed one is unpacked."""
    form = rb"<(?:\w+:)?(binData|docSuppData|Data)\b([^>]*)>([A-Za-z0-9+/=\s]*)</"
    for k, m in enumerate(re.finditer(form, data)):
        raw = base64.b64decode(re.sub(rb"\s", b"", m[3]) + b"==")
        named = re.search(rb'name="([^"]*)"', m[2])
        name = named[1].decode("utf-8", "replace") if named else m[1].decode()
        if raw[:10] == b"ActiveMime" and len(raw) > 50:
            raw = zlib.decompressobj().decompress(raw[raw.find(b"\x78", 40) :], limit)
        yield name, len(m[3]), len(raw), False, k + 1, raw[:limit], None


_STORE = bytes.fromhex("e716e3bd65261145a4c48d4d0b7a9eac")


def notebook(data: bytes, limit: int) -> Iterator[Row]:
    """Files embedded in a notebook: each follows its mark, with its length before it."""
    at, k = data.find(_STORE), 0
    while at >= 0:
        n = struct.unpack_from("<Q", data, at + 16)[0]
        if at + 36 + n <= len(data):
            k += 1
            yield None, n, n, False, k, data[at + 36 : at + 36 + min(n, limit)], None
        at = data.find(_STORE, at + 16 + (n if at + 36 + n <= len(data) else 0))


def korean(data: bytes, limit: int) -> Iterator[Row]:
    """The body of an older Korean document, unpacked where its head says so."""
    packed, hidden, n_info = data[30 + 124], struct.unpack_from("<H", data, 30 + 96)[0], struct.unpack_from("<H", data, 30 + 126)[0]
    at = 30 + 128 + 1008 + n_info
    if hidden:
        yield None, len(data), None, True, 1, None, "Heuristics.Encrypted.HWP"
        return
    body = zlib.decompressobj(-15).decompress(data[at:], limit) if packed else data[at : at + limit]
    yield None, len(data), len(body), False, 1, body, None


for _kind, _decoder in {"MSOLE2": compound, "RTF": rich_text, "XML_WORD": office_xml, "XML_XL": office_xml, "ONENOTE": notebook, "HWP3": korean}.items():
    members.register(_kind, _decoder)

"""Decoders of archives and disk images, from their published layouts: bytes and a limit to rows of members."""

from __future__ import annotations

import bz2
import lzma
import plistlib
import re
import struct
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Iterator

from . import members, packed
from .members import Row


def _row(name: str | None, packed_size: int | None, size: int | None, place: int, body: bytes | None, *, hidden: bool = False, alert: str | None = None) -> Row:
    return name, packed_size, size, hidden, place, body, alert


def _text(raw: bytes, coding: str = "utf-8") -> str:
    return raw.decode(coding, "replace")


def zip_member(data: bytes, limit: int, at: int = 0, password: bytes | None = None) -> Row:
    """The one member whose local header stands at ``at``, without a central directory."""
    if data[at : at + 4] != b"PK\x03\x04":
        raise ValueError("no local header")
    flags, method = struct.unpack_from("<HH", data, at + 6)
    n_packed, size, n_name, n_extra = struct.unpack_from("<IIHH", data, at + 18)
    body_at = at + 30 + n_name + n_extra
    body = data[body_at : body_at + n_packed] if n_packed or not flags & 8 else data[body_at:]
    name = _text(data[at + 30 : at + 30 + n_name])
    if flags & 1:
        return _row(name, n_packed, size, 1, None, hidden=True, alert="Heuristics.Encrypted.Zip")
    return _row(name, n_packed, size, 1, packed.zip_body(method, body, size, flags, limit))


def cabinet(data: bytes, limit: int) -> Iterator[Row]:
    """Files of a cabinet whose folders are stored or in blocks of deflate; other methods give rows without content."""
    first, n_folders, n_files, flags = struct.unpack_from("<I", data, 16)[0], *struct.unpack_from("<HHH", data, 26)
    at, head, per_folder, per_block = 36, 0, 0, 0
    if flags & 4:
        head, per_folder, per_block = struct.unpack_from("<HBB", data, at)
        at += 4 + head
    for bit in (1, 2):
        if flags & bit:  # names of the cabinet before or after, and of their disks
            for _ in range(2):
                at = data.index(b"\0", at) + 1
    folders = []
    for _ in range(n_folders):
        folders.append(struct.unpack_from("<IHH", data, at))
        at += 8 + per_folder
    bodies: dict[int, bytes | None] = {}
    at = first
    for k in range(n_files):
        size, start, folder, _, _, attributes = struct.unpack_from("<IIHHHH", data, at)
        end = data.index(b"\0", at + 16)
        name = _text(data[at + 16 : end], "utf-8" if attributes & 0x80 else "latin-1")
        at = end + 1
        index = {0xFFFD: 0, 0xFFFE: n_folders - 1, 0xFFFF: 0}.get(folder, folder)
        if index not in bodies:
            bodies[index] = packed.cabinet_folder(data, *folders[index], per_block, limit * 16) if index < n_folders else None
        whole = bodies[index]
        body = None if whole is None or start + size > len(whole) else whole[start : start + min(size, limit)]
        yield _row(name, None, size, k + 1, body)


def iso(data: bytes, limit: int) -> Iterator[Row]:
    """Files of an ISO 9660 image in order of its directories; Joliet names go before plain ones."""
    root, wide, sector = None, False, 2048
    at = 16 * sector
    while at + sector <= len(data) and data[at + 1 : at + 6] == b"CD001" and data[at] != 255:
        joliet = data[at] == 2 and data[at + 88 : at + 91] in (b"%/@", b"%/C", b"%/E")
        if data[at] == 1 and root is None or joliet:
            sector = struct.unpack_from("<H", data, at + 128)[0] or 2048
            root, wide = (struct.unpack_from("<I", data, at + 158)[0], struct.unpack_from("<I", data, at + 166)[0]), joliet
        at += 2048
    if root is None:
        raise ValueError("no volume descriptor")
    todo, seen, k = [("", *root)], set(), 0
    while todo:
        path, block, size = todo.pop(0)
        if block in seen:
            continue
        seen.add(block)
        begin, at = block * sector, block * sector
        while at < min(begin + size, len(data)):
            n = data[at]
            if n == 0:  # records don't cross sectors
                at = (at // sector + 1) * sector
                continue
            where, length = struct.unpack_from("<I", data, at + 2)[0], struct.unpack_from("<I", data, at + 10)[0]
            raw = data[at + 33 : at + 33 + data[at + 32]]
            flags = data[at + 25]
            at += n
            if raw in (b"\0", b"\1"):
                continue
            name = path + re.sub(r";\d+\Z", "", _text(raw, "utf-16-be" if wide else "latin-1"))
            if flags & 2:
                todo.append((name + "/", where, length))
            else:
                k += 1
                yield _row(name, length, length, k, data[where * sector : where * sector + min(length, limit)])


def _number7(data: bytes, at: int) -> tuple[int, int]:
    first, extra, value = data[at], 0, 0
    while extra < 8 and first & (0x80 >> extra):
        value |= data[at + 1 + extra] << (8 * extra)
        extra += 1
    return value | (first & (0x7F >> extra)) << (8 * extra) if extra < 8 else value, at + 1 + extra


class _Seven:
    """The header of a 7z archive, read property by property."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def byte(self) -> int:
        self.at += 1
        return self.data[self.at - 1]

    def number(self) -> int:
        value, self.at = _number7(self.data, self.at)
        return value

    def take(self, n: int) -> bytes:
        self.at += n
        return self.data[self.at - n : self.at]

    def bits(self, n: int, all_given: bool = False) -> list[bool]:
        if all_given and self.byte():
            return [True] * n
        raw = self.take((n + 7) // 8)
        return [bool(raw[k // 8] & 0x80 >> k % 8) for k in range(n)]

    def digests(self, n: int) -> list[int | None]:
        return [struct.unpack("<I", self.take(4))[0] if given else None for given in self.bits(n, True)]

    def streams(self) -> dict:
        out: dict = {"at": 0, "packs": [], "folders": [], "counts": None, "sizes": [], "crcs": []}
        while (kind := self.byte()) != 0:
            if kind == 6:
                out["at"], n = self.number(), self.number()
                while (kind := self.byte()) != 0:
                    if kind == 9:
                        out["packs"] = [self.number() for _ in range(n)]
                    elif kind == 10:
                        self.digests(n)
            elif kind == 7:
                self.folders(out)
            elif kind == 8:
                self.substreams(out)
        if out["counts"] is None:
            out["counts"] = [1] * len(out["folders"])
            out["sizes"] = [f["sizes"][f["main"]] for f in out["folders"]]
        return out

    def folders(self, out: dict) -> None:
        while (kind := self.byte()) != 0:
            if kind == 11:
                n = self.number()
                if self.byte():
                    raise ValueError("folders in another stream")
                out["folders"] = [self.folder() for _ in range(n)]
            elif kind == 12:
                for f in out["folders"]:
                    f["sizes"] = [self.number() for _ in range(f["outs"])]
            elif kind == 10:
                self.digests(len(out["folders"]))

    def folder(self) -> dict:
        coders, ins, outs = [], 0, 0
        for _ in range(self.number()):
            flags = self.byte()
            method, n_in, n_out = self.take(flags & 15), 1, 1
            if flags & 16:
                n_in, n_out = self.number(), self.number()
            coders.append((method, self.take(self.number()) if flags & 32 else b"", n_in, n_out))
            ins, outs = ins + n_in, outs + n_out
        pairs = [(self.number(), self.number()) for _ in range(outs - 1)]
        n_packed = ins - len(pairs)
        if n_packed > 1:
            for _ in range(n_packed):
                self.number()
        bound = {o for _, o in pairs}
        return {"coders": coders, "outs": outs, "pairs": pairs, "packs": n_packed, "main": next(k for k in range(outs) if k not in bound), "sizes": []}

    def substreams(self, out: dict) -> None:
        folders = out["folders"]
        out["counts"], kind = [1] * len(folders), self.byte()
        if kind == 13:
            out["counts"], kind = [self.number() for _ in folders], self.byte()
        for f, n in zip(folders, out["counts"], strict=True):
            own = [self.number() for _ in range(n - 1)] if kind == 9 and n else []
            if n:
                out["sizes"] += [*own, f["sizes"][f["main"]] - sum(own)]
        if kind == 9:
            kind = self.byte()
        while kind != 0:
            if kind == 10:
                self.digests(sum(out["counts"]))
            kind = self.byte()

    def files(self) -> list[dict]:
        n = self.number()
        found: list[dict] = [{"name": None, "empty": False, "folder": False} for _ in range(n)]
        while (kind := self.byte()) != 0:
            size = self.number()
            end = self.at + size
            if kind == 17:
                self.byte()
                for f, name in zip(found, self.data[self.at : end].decode("utf-16-le").split("\0"), strict=False):
                    f["name"] = name
            elif kind == 14:
                for f, e in zip(found, self.bits(n), strict=True):
                    f["empty"] = e
            elif kind == 15:
                empty = [f for f in found if f["empty"]]
                for f, is_file in zip(empty, self.bits(len(empty)), strict=True):
                    f["file"] = is_file
            self.at = end
        return found


def _filters7(method: bytes, properties: bytes, size: int) -> list[dict] | None:
    """The lzma module's filter of a coder, None for one that it doesn't have. No distance goes further back than the output's ``size``, so no larger window is held."""
    most = max(4096, size)
    if method == b"\x21":
        bits = properties[0]
        return [{"id": lzma.FILTER_LZMA2, "dict_size": min(0xFFFFFFFF, most, (2 | bits & 1) << bits // 2 + 11) if bits < 40 else min(0xFFFFFFFF, most)}]
    if method == b"\x03\x01\x01":
        b = properties[0]
        return [{"id": lzma.FILTER_LZMA1, "lc": b % 9, "lp": b // 9 % 5, "pb": b // 45, "dict_size": min(most, max(4096, struct.unpack("<I", properties[1:5])[0]))}]
    return None


def _folder7(data: bytes, folder: dict, starts: list[tuple[int, int]], limit: int) -> bytes | None:
    """A folder's content, where its coders form a chain from one packed stream; None for other methods."""
    if any(i != 1 or o != 1 for _, _, i, o in folder["coders"]) or len(starts) != 1:
        return None
    source = {i: o for i, o in folder["pairs"]}
    chain, now = [], folder["main"]
    while True:
        chain.append(now)
        if now not in source:
            break
        now = source[now]
    body = data[starts[0][0] : starts[0][0] + starts[0][1]]
    for k in reversed(chain):
        method, properties, _, _ = folder["coders"][k]
        size = min(folder["sizes"][k], limit)
        if filters := _filters7(method, properties, folder["sizes"][k]):
            body = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=filters).decompress(body, size)
        elif method == b"\x04\x01\x08":
            body = zlib.decompressobj(-15).decompress(body, size)
        elif method == b"\x04\x01\x09":
            body = packed.inflate64(body, size)
        elif method == b"\x04\x02\x02":
            body = bz2.BZ2Decompressor().decompress(body, size)
        elif method == b"\x03":
            step, out = (properties[0] if properties else 0) + 1, bytearray(body)
            for j in range(step, len(out)):
                out[j] = out[j] + out[j - step] & 255
            body = bytes(out)
        elif method in (b"\x03\x03\x01\x03", b"\x04"):
            body = packed.jumps_made_relative(body)
        elif method != b"\0":
            return None
    return body[: folder["sizes"][folder["main"]]]


def seven(data: bytes, limit: int) -> Iterator[Row]:
    """Files of a 7z archive: stored, LZMA, LZMA2, deflate, deflate64, bzip2, with difference or jump filters. Encrypted ones have no content."""
    at, size = struct.unpack_from("<QQ", data, 12)
    if not size:
        return
    head = _Seven(data[32 + at : 32 + at + size])
    kind = head.byte()
    while kind == 23:  # the header itself is packed
        streams = head.streams()
        (folder,) = streams["folders"]
        body = _folder7(data, folder, [(32 + streams["at"], streams["packs"][0])], 64 << 20)
        if body is None:
            yield _row(None, size, None, 1, None, hidden=True, alert="Heuristics.Encrypted.7Zip")
            return
        head = _Seven(body)
        kind = head.byte()
    streams, files = {"at": 0, "packs": [], "folders": [], "counts": [], "sizes": []}, []
    while (kind := head.byte()) != 0:
        if kind == 4:
            streams = head.streams()
        elif kind == 5:
            files = head.files()
        elif kind == 2:
            while head.byte():
                head.take(head.number())
    places, now = [], 32 + streams["at"]
    for n in streams["packs"]:
        places.append((now, n))
        now += n
    bodies, p = [], 0
    sizes = iter(streams["sizes"])
    for folder, count in zip(streams["folders"], streams["counts"], strict=True):
        own = [next(sizes) for _ in range(count)]
        starts = places[p : p + folder["packs"]]
        p += folder["packs"]
        hidden = any(m[:3] == b"\x06\xf1\x07" for m, *_ in folder["coders"])
        whole = None if hidden else _folder7(data, folder, starts, max(limit * 16, 1 << 26))
        a = 0
        for n in own:
            bodies.append((n, None if whole is None or a + n > len(whole) else whole[a : a + min(n, limit)], hidden))
            a += n
    found = iter(bodies)
    for k, f in enumerate(files):
        if f["empty"]:
            if f.get("file"):
                yield _row(f["name"], 0, 0, k + 1, b"")
            continue
        n, body, hidden = next(found)
        yield _row(f["name"], None, n, k + 1, body, hidden=hidden, alert="Heuristics.Encrypted.7Zip" if hidden else None)


def rar(data: bytes, limit: int) -> Iterator[Row]:
    """Members of both RAR layouts; only stored ones have content."""
    k = 0
    if data[:8] == b"Rar!\x1a\x07\x01\x00":
        at = 8

        def vint(at: int) -> tuple[int, int]:
            value = shift = 0
            while True:
                b = data[at]
                value |= (b & 127) << shift
                at, shift = at + 1, shift + 7
                if not b & 128:
                    return value, at

        while at + 7 < len(data):
            size, body = vint(at + 4)
            end = body + size
            kind, p = vint(body)
            flags, p = vint(p)
            extra, p = vint(p) if flags & 1 else (0, p)
            n, p = vint(p) if flags & 2 else (0, p)
            if kind == 4:
                yield _row(None, None, None, k + 1, None, hidden=True, alert="Heuristics.Encrypted.RAR")
                return
            if kind == 2:
                own, p = vint(p)
                real, p = vint(p)
                _, p = vint(p)
                p += (4 if own & 2 else 0) + (4 if own & 4 else 0)
                method, p = vint(p)
                _, p = vint(p)
                length, p = vint(p)
                name = _text(data[p : p + length])
                hidden = any(t == 1 for t in _extras(data, end - extra, end, vint))
                if not own & 1:
                    k += 1
                    stored = not method >> 7 & 7 and not hidden
                    yield _row(name, n, real, k, data[end : end + min(n, limit)] if stored else None, hidden=hidden, alert="Heuristics.Encrypted.RAR" if hidden else None)
            if kind == 5:
                return
            at = end + n
        return
    at = 7
    while at + 7 <= len(data):
        _, kind, flags, size = struct.unpack_from("<HBHH", data, at)
        if size < 7 or kind == 0x7B:
            return
        more = struct.unpack_from("<I", data, at + 7)[0] if flags & 0x8000 or kind == 0x74 else 0
        if kind == 0x73 and flags & 0x80:
            yield _row(None, None, None, 1, None, hidden=True, alert="Heuristics.Encrypted.RAR")
            return
        if kind == 0x74:
            real, _, _, _, _, method, n_name, _ = struct.unpack_from("<IBIIBBHI", data, at + 11)
            p = at + 32
            if flags & 0x100:
                more |= struct.unpack_from("<I", data, p)[0] << 32
                p += 8
            name = _text(data[p : p + n_name].split(b"\0")[0])
            hidden = bool(flags & 4)
            if flags & 0xE0 != 0xE0:
                k += 1
                body = data[at + size : at + size + min(more, limit)] if method == 0x30 and not hidden else None
                yield _row(name, more, real, k, body, hidden=hidden, alert="Heuristics.Encrypted.RAR" if hidden else None)
        at += size + more


def _extras(data: bytes, at: int, end: int, vint) -> Iterator[int]:
    while at < end:
        size, body = vint(at)
        yield vint(body)[0]
        at = body + size


def arj(data: bytes, limit: int) -> Iterator[Row]:
    """Members of an ARJ archive: stored and the Huffman methods 1 to 3; others have no content."""
    at, k, main = 0, 0, True
    while data[at : at + 2] == b"\x60\xea":
        n = struct.unpack_from("<H", data, at + 2)[0]
        if not n:
            return
        head = data[at + 4 : at + 4 + n]
        at += 4 + n + 4
        while (extra := struct.unpack_from("<H", data, at)[0]) != 0:
            at += 2 + extra + 4
        at += 2
        if main:
            main = False
            continue
        flags, method, kind = head[4], head[5], head[6]
        n_packed, size = struct.unpack_from("<II", head, 12)
        name = _text(head[head[0] :].split(b"\0")[0])
        raw, hidden = data[at : at + n_packed], bool(flags & 1)
        at += n_packed
        if kind == 3:
            continue
        body = None
        if not hidden and method == 0:
            body = raw[:limit]
        elif not hidden and method in (1, 2, 3):
            body = packed.lzh(raw, min(size, limit), 17, 5)
        k += 1
        yield _row(name, n_packed, size, k, body, hidden=hidden, alert="Heuristics.Encrypted.ARJ" if hidden else None)


def lha(data: bytes, limit: int) -> Iterator[Row]:
    """Members of LZH archives with heads of level 0 to 2: stored and lh4 to lh7; others have no content."""
    at, k = 0, 0
    while at + 22 < len(data) and data[at] and re.match(rb"-l[hz][0-9ds]-", data[at + 2 : at + 7]):
        method, level = data[at + 2 : at + 7], data[at + 20]
        n_packed, size = struct.unpack_from("<II", data, at + 7)
        name, folder = "", ""
        if level < 2:
            n = data[at + 21]
            name = _text(data[at + 22 : at + 22 + n], "latin-1")
            end = at + data[at] + 2
            p = end - 2
        else:
            end = at + struct.unpack_from("<H", data, at)[0]
            p = at + 24
        if level:
            while (extra := struct.unpack_from("<H", data, p)[0]) != 0:
                kind, body = data[p + 2], data[p + 3 : p + extra]
                if kind == 1:
                    name = _text(body, "latin-1")
                elif kind == 2:
                    folder = _text(body.replace(b"\xff", b"/"), "latin-1")
                p += extra
                if level == 1:
                    n_packed -= extra
            if level == 1:
                end = p + 2
        raw = data[end : end + n_packed]
        at = end + n_packed
        if method == b"-lhd-":
            continue
        k += 1
        body = None
        if method in (b"-lh0-", b"-lz4-"):
            body = raw[:limit]
        elif method in (b"-lh4-", b"-lh5-", b"-lh6-", b"-lh7-"):
            body = packed.lzh(raw, min(size, limit), *{b"4": (14, 4), b"5": (14, 4), b"6": (16, 5), b"7": (17, 5)}[method[3:4]])
        yield _row(folder + name, n_packed, size, k, body)


def alz(data: bytes, limit: int) -> Iterator[Row]:
    """Members of an ALZ archive: stored, bzip2 or deflate."""
    at, k = 8, 0
    while data[at : at + 4] == b"BLZ\x01":
        n_name, _, _, flags, _ = struct.unpack_from("<HBIBB", data, at + 4)
        width, p = flags >> 4, at + 13
        method = n_packed = size = 0
        if width:
            method, p = data[p], p + 6
            n_packed, size = (int.from_bytes(data[p + j * width : p + (j + 1) * width], "little") for j in (0, 1))
            p += 2 * width
        name = _text(data[p : p + n_name], "cp949")
        p += n_name
        hidden = bool(flags & 1)
        p += 12 if hidden else 0
        raw = data[p : p + n_packed]
        at, k = p + n_packed, k + 1
        body = None
        if not hidden:
            body = raw[:limit] if method == 0 else bz2.BZ2Decompressor().decompress(raw, limit) if method == 1 else zlib.decompressobj(-15).decompress(raw, limit) if method == 2 else None
        yield _row(name, n_packed, size, k, body, hidden=hidden, alert="Heuristics.Encrypted.ALZ" if hidden else None)


def egg(data: bytes, limit: int) -> Iterator[Row]:
    """Members of an EGG archive: blocks stored, or in deflate, bzip2 or LZMA, one after another."""
    at, k = 14, 0
    name, size, parts, hidden, seen = None, 0, [], False, False

    def done() -> Row:
        body = None if hidden or any(p is None for p in parts) else b"".join(parts)[:limit]
        return _row(name, None, size, k, body, hidden=hidden, alert="Heuristics.Encrypted.EGG" if hidden else None)

    while at + 4 <= len(data):
        magic = struct.unpack_from("<I", data, at)[0]
        if magic == 0x0A8590E3:
            if seen:
                yield done()
            size, name, parts, hidden, seen, k = struct.unpack_from("<Q", data, at + 8)[0], None, [], False, True, k + 1
            at += 16
        elif magic == 0x02B50C13:
            method, _, real, n_packed, _ = struct.unpack_from("<BBIII", data, at + 4)
            raw = data[at + 22 : at + 22 + n_packed]
            if method == 0:
                parts.append(raw)
            elif method == 1:
                parts.append(zlib.decompressobj(-15).decompress(raw, limit))
            elif method == 2:
                parts.append(bz2.BZ2Decompressor().decompress(raw, limit))
            elif method == 4:
                b = raw[4]
                filters = [{"id": lzma.FILTER_LZMA1, "lc": b % 9, "lp": b // 9 % 5, "pb": b // 45, "dict_size": max(4096, struct.unpack("<I", raw[5:9])[0])}]
                parts.append(lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=filters).decompress(raw[9:], min(real, limit)))
            else:
                parts.append(None)
            at += 22 + n_packed
        elif magic == 0x08E28222:
            at += 4
        else:  # a field of a length of its own
            wide = data[at + 4] & 1
            n = struct.unpack_from("<I" if wide else "<H", data, at + 5)[0]
            body = data[at + (9 if wide else 7) : at + (9 if wide else 7) + n]
            if magic == 0x0A8591AC:
                name = _text(body)
            elif magic == 0x08D1470F:
                hidden = True
            at += (9 if wide else 7) + n
    if seen:
        yield done()


def xar(data: bytes, limit: int) -> Iterator[Row]:
    """Files that the table of contents of a XAR archive lists: stored, zlib, bzip2 or xz."""
    head, packed_size, size = struct.unpack_from(">H", data, 4)[0], *struct.unpack_from(">QQ", data, 8)
    toc = ET.fromstring(zlib.decompressobj().decompress(data[head : head + packed_size], min(size, 64 << 20)))
    heap = head + packed_size
    todo, k = [("", f) for f in toc.iter("toc")], 0
    while todo:
        path, node = todo.pop(0)
        for f in node.findall("file"):
            name = path + (f.findtext("name") or "")
            todo.append((name + "/", f))
            part = f.find("data")
            if part is None:
                continue
            k += 1
            at, n, real = (int(part.findtext(x) or 0) for x in ("offset", "length", "size"))
            raw, kind = data[heap + at : heap + at + n], (part.find("encoding").get("style") if part.find("encoding") is not None else "")
            if "gzip" in kind:
                body = zlib.decompressobj().decompress(raw, limit)
            elif "bzip2" in kind:
                body = bz2.BZ2Decompressor().decompress(raw, limit)
            elif "lzma" in kind or "xz" in kind:
                body = lzma.LZMADecompressor().decompress(raw, limit)
            else:
                body = raw[:limit]
            yield _row(name, n, real, k, body)


def dmg(data: bytes, limit: int) -> Iterator[Row]:
    """Partitions of a disk image: each block table of its property list, blocks raw, zero, ADC, zlib, bzip2 or LZMA."""
    koly = data.rfind(b"koly", max(0, len(data) - 512))
    if koly < 0:
        raise ValueError("no trailer")
    fork, at, n = struct.unpack_from(">Q", data, koly + 24)[0], *struct.unpack_from(">QQ", data, koly + 216)
    for k, entry in enumerate(plistlib.loads(data[at : at + n]).get("resource-fork", {}).get("blkx", [])):
        table = entry["Data"]
        start, count = struct.unpack_from(">Q", table, 24)[0], struct.unpack_from(">I", table, 200)[0]
        out, size = [], 0
        for j in range(count):
            kind, _, _, sectors, where, length = struct.unpack_from(">IIQQQQ", table, 204 + 40 * j)
            raw, room = data[fork + start + where : fork + start + where + length], limit - size
            if kind == 0xFFFFFFFF or room <= 0:
                break
            if kind in (0, 2):
                part = b"\0" * min(sectors * 512, room)
            elif kind == 1:
                part = raw[:room]
            elif kind == 0x80000004:
                part = packed.adc(raw, min(sectors * 512, room))
            elif kind == 0x80000005:
                part = zlib.decompressobj().decompress(raw, room)
            elif kind == 0x80000006:
                part = bz2.BZ2Decompressor().decompress(raw, room)
            elif kind == 0x80000008:
                part = lzma.LZMADecompressor().decompress(raw, room)
            else:
                continue
            out.append(part)
            size += len(part)
        body = b"".join(out)
        yield _row(entry.get("Name") or entry.get("CFName"), len(data), len(body), k + 1, body)


def hfs(data: bytes, limit: int) -> Iterator[Row]:
    """Files of an HFS+ volume by its catalog tree; the first eight extents of each fork are read."""
    block = struct.unpack_from(">I", data, 1024 + 40)[0]

    def fork(at: int, buffer: bytes) -> bytes:
        size = struct.unpack_from(">Q", buffer, at)[0]
        extents = [struct.unpack_from(">II", buffer, at + 16 + 8 * j) for j in range(8)]
        return b"".join(data[a * block : (a + n) * block] for a, n in extents)[:size]

    tree = fork(1024 + 272, data)
    node_size, node = struct.unpack_from(">H", tree, 14 + 18)[0], struct.unpack_from(">I", tree, 14 + 10)[0]
    names, files, seen = {1: ""}, [], set()
    while node and node not in seen:
        seen.add(node)
        at = node * node_size
        follow, count = struct.unpack_from(">I", tree, at)[0], struct.unpack_from(">H", tree, at + 10)[0]
        for j in range(count):
            p = at + struct.unpack_from(">H", tree, at + node_size - 2 * (j + 1))[0]
            n_key, parent, n_name = struct.unpack_from(">HIH", tree, p)
            name = tree[p + 8 : p + 8 + 2 * n_name].decode("utf-16-be", "replace")
            body = p + 2 + n_key
            body += body & 1
            kind = struct.unpack_from(">H", tree, body)[0]
            if kind == 1:
                names[struct.unpack_from(">I", tree, body + 8)[0]] = (parent, name)
            elif kind == 2:
                files.append((parent, name, body))
        node = follow

    def path(folder: int, depth: int = 0) -> str:
        known = names.get(folder)
        return "" if not isinstance(known, tuple) or known[0] == 1 or depth > 64 else path(known[0], depth + 1) + known[1] + "/"

    for k, (parent, name, at) in enumerate(files):
        body = fork(at + 88, tree)
        yield _row(path(parent) + name, len(body), len(body), k + 1, body[:limit])


def udf(data: bytes, limit: int) -> Iterator[Row]:
    """Files of a UDF volume: anchor, partition, file set, then directories by their file entries."""
    tag = lambda at: struct.unpack_from("<H", data, at)[0]
    anchor = 256 * 2048
    if tag(anchor) != 2:
        raise ValueError("no anchor")
    size, first = struct.unpack_from("<II", data, anchor + 16)
    start, root_set = 0, None
    for at in range(first * 2048, first * 2048 + size, 2048):
        if tag(at) == 5:
            start = struct.unpack_from("<I", data, at + 188)[0]
        elif tag(at) == 6:
            root_set = struct.unpack_from("<I", data, at + 248 + 4)[0]
        elif tag(at) == 8:
            break
    if root_set is None:
        raise ValueError("no logical volume")
    place = lambda n: (start + n) * 2048

    def content(at: int, most: int) -> bytes:
        wide = tag(at) == 266
        flags, size = struct.unpack_from("<H", data, at + 34)[0], struct.unpack_from("<Q", data, at + 56)[0]
        n_extra, n_alloc = struct.unpack_from("<II", data, at + (208 if wide else 168))
        p = at + (216 if wide else 176) + n_extra
        if flags & 7 == 3:
            return data[p : p + min(size, n_alloc, most)]
        out, step = b"", 8 if flags & 7 == 0 else 16
        for q in range(p, p + n_alloc, step):
            n, block = struct.unpack_from("<II", data, q)
            if not n & 0x3FFFFFFF or len(out) >= most:
                break
            out += data[place(block) : place(block) + (n & 0x3FFFFFFF)]
        return out[: min(size, most)]

    todo, k, seen = [("", place(struct.unpack_from("<I", data, place(root_set) + 400 + 4)[0]))], 0, set()
    while todo:
        path, at = todo.pop(0)
        if at in seen or tag(at) not in (261, 266):
            continue
        seen.add(at)
        listing, p = content(at, 1 << 26), 0
        while p + 38 <= len(listing):
            flags, n_name, block, n_use = listing[p + 18], listing[p + 19], struct.unpack_from("<I", listing, p + 24)[0], struct.unpack_from("<H", listing, p + 36)[0]
            raw = listing[p + 38 + n_use : p + 38 + n_use + n_name]
            p += (38 + n_use + n_name + 3) // 4 * 4
            if flags & 12 or not raw:
                continue
            name = path + _text(raw[1:], "utf-16-be" if raw[0] == 16 else "latin-1")
            if flags & 2:
                todo.append((name + "/", place(block)))
            else:
                k += 1
                body = content(place(block), limit)
                yield _row(name, len(body), struct.unpack_from("<Q", data, place(block) + 56)[0], k, body)


def expanded(data: bytes, limit: int) -> Iterator[Row]:
    """The plain form of a file that COMPRESS.EXE made."""
    body = packed.szdd(data, limit)
    yield _row(None, len(data), len(body), 1, body)


def inverted(data: bytes, limit: int) -> Iterator[Row]:
    """A file whose bytes after the head of sixteen are inverted."""
    body = bytes(b ^ 255 for b in data[16 : 16 + limit])
    yield _row(None, len(data), len(body), 1, body)


for _kind, _decoder in {
    "MSCAB": cabinet, "CABSFX": cabinet, "ISO9660": iso, "7Z": seven, "7ZSFX": seven, "RAR": rar, "RARSFX": rar, "ARJ": arj, "LHA_LZH": lha, "ALZ": alz, "EGG": egg,
    "XAR": xar, "DMG": dmg, "HFSPLUS": hfs, "UDF": udf, "MSSZDD": expanded, "CRYPTFF": inverted,
}.items():
    members.register(_kind, _decoder)

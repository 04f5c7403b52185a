"""Containers of one member each, written to hold a table's texts for round trips through the decoders."""

from __future__ import annotations

import base64
import bz2
import gzip
import io
import lzma
import plistlib
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Callable

import numpy as np


def zipped(name: str, body: bytes) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo(name), body)
    return out.getvalue()


def locked_zip(name: str, body: bytes, password: bytes = b"infected") -> bytes:
    """A stored member under the traditional cipher."""
    from .packed import _crc_table

    table, keys = _crc_table(), [0x12345678, 0x23456789, 0x34567890]

    def update(b: int) -> None:
        keys[0] = keys[0] >> 8 ^ table[(keys[0] ^ b) & 255]
        keys[1] = (keys[1] + (keys[0] & 255)) * 134775813 + 1 & 0xFFFFFFFF
        keys[2] = keys[2] >> 8 ^ table[(keys[2] ^ keys[1] >> 24) & 255]

    for b in password:
        update(b)
    crc, made = zlib.crc32(body), bytearray()
    for b in bytes(11) + bytes([crc >> 24]) + body:
        t = keys[2] | 2
        made.append(b ^ (t * (t ^ 1) >> 8 & 255))
        update(b)
    n = name.encode()
    fields = struct.pack("<HHHHHIIIHH", 20, 1, 0, 0, 33, crc, len(made), len(body), len(n), 0)
    local = b"PK\x03\x04" + fields + n + bytes(made)
    central = b"PK\x01\x02" + struct.pack("<H", 20) + fields + struct.pack("<HHHII", 0, 0, 0, 0, 0) + n
    return local + central + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 1, 1, len(central), len(local), 0)


def tarred(name: str, body: bytes) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as t:
        info = tarfile.TarInfo(name)
        info.size = len(body)
        t.addfile(info, io.BytesIO(body))
    return out.getvalue()


def zstd(name: str, body: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor().compress(body)


def cpio(name: str, body: bytes) -> bytes:
    def entry(n: str, b: bytes) -> bytes:
        raw = n.encode() + b"\0"
        return b"070707" + b"".join(b"%06o" % x for x in (0, 1, 0o100644, 0, 0, 1, 0)) + b"%011o%06o%011o" % (0, len(raw), len(b)) + raw + b

    return entry(name, body) + entry("TRAILER!!!", b"")


def new_cpio(name: str, body: bytes) -> bytes:
    def entry(n: str, b: bytes) -> bytes:
        raw = n.encode() + b"\0"
        head = b"070701" + b"".join(b"%08x" % x for x in (1, 0o100644, 0, 0, 1, 0, len(b), 0, 0, 0, 0, len(raw), 0)) + raw
        return head + bytes(-len(head) % 4) + b + bytes(-len(b) % 4)

    return entry(name, body) + entry("TRAILER!!!", b"")


def mail(name: str, body: bytes) -> bytes:
    lines = base64.encodebytes(body)
    head = f'MIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary="edge"\r\n\r\n--edge\r\nContent-Type: application/octet-stream; name="{name}"\r\n'
    return (head + f'Content-Disposition: attachment; filename="{name}"\r\nContent-Transfer-Encoding: base64\r\n\r\n').encode() + lines + b"\r\n--edge--\r\n"


def uuencoded(name: str, body: bytes) -> bytes:
    import binascii

    lines = b"".join(binascii.b2a_uu(body[k : k + 45]) for k in range(0, len(body), 45))
    return f"begin 644 {name}\n".encode() + lines + b"`\nend\n"


def pdf(name: str, body: bytes) -> bytes:
    packed = zlib.compress(body)
    return b"%PDF-1.4\n7 0 obj\n<< /Filter /FlateDecode /Length " + str(len(packed)).encode() + b" >>\nstream\n" + packed + b"\nendstream\nendobj\n"


def lzw_pdf(name: str, body: bytes) -> bytes:
    """Plain codes only, the table cleared before they grow wider than nine bits."""
    codes = np.full(len(body) + -(-len(body) // 250) + 1, 257, np.uint16)
    codes[:-1:251] = 256
    codes[:-1][np.arange(len(codes) - 1) % 251 > 0] = np.frombuffer(body, np.uint8)
    packed = np.packbits(low_bits(codes, 9)).tobytes()
    return b"%PDF-1.4\n7 0 obj\n<< /Filter [/ASCIIHexDecode /LZWDecode] >>\nstream\n" + packed.hex().encode() + b">\nendstream\nendobj\n"


def xdp(name: str, body: bytes) -> bytes:
    return b"<?xml version='1.0'?><xdp:xdp><pdf><document><chunk>" + base64.b64encode(body) + b"</chunk></document></pdf></xdp:xdp>"


def cabinet(name: str, body: bytes, stored: bool = False) -> bytes:
    blocks, done = b"", b""
    parts = [body[k : k + 32768] for k in range(0, len(body), 32768)] or [b""]
    for part in parts:
        if stored:
            raw = part
        else:
            deflate = zlib.compressobj(9, zlib.DEFLATED, -15, zdict=done[-32768:]) if done else zlib.compressobj(9, zlib.DEFLATED, -15)
            raw = b"CK" + deflate.compress(part) + deflate.flush()
        blocks += struct.pack("<IHH", 0, len(raw), len(part)) + raw
        done += part
    entry = struct.pack("<IIHHHH", len(body), 0, 0, 0, 0, 0x20) + name.encode("latin-1") + b"\0"
    files = 36 + 8
    folder = struct.pack("<IHH", files + len(entry), len(parts), 0 if stored else 1)
    size = files + len(entry) + len(blocks)
    return b"MSCF" + struct.pack("<IIIIIBBHHHHH", 0, size, 0, files, 0, 3, 1, 1, 1, 0, 0, 0) + folder + entry + blocks


def iso(name: str, body: bytes) -> bytes:
    both = lambda x: struct.pack("<I", x) + struct.pack(">I", x)

    def record(raw: bytes, block: int, size: int, flags: int) -> bytes:
        n = 33 + len(raw) + (len(raw) + 1) % 2
        return (bytes([n, 0]) + both(block) + both(size) + bytes(7) + bytes([flags, 0, 0]) + struct.pack("<H", 1) + struct.pack(">H", 1) + bytes([len(raw)]) + raw).ljust(n, b"\0")

    root = record(b"\0", 18, 2048, 2)
    volume = (b"\x01CD001\x01\0".ljust(80, b" ") + both(20)).ljust(128, b"\0") + struct.pack("<H", 2048) + struct.pack(">H", 2048)
    volume = volume.ljust(156, b"\0") + root
    listing = root + record(b"\1", 18, 2048, 2) + record((name + ";1").encode("latin-1"), 19, len(body), 0)
    return bytes(16 * 2048) + volume.ljust(2048, b"\0") + b"\xffCD001\x01".ljust(2048, b"\0") + listing.ljust(2048, b"\0") + body + bytes(-len(body) % 2048)


#: The longest gap between two sectors of a UDF volume.
_ZEROS = memoryview(bytes(256 * 2048))


def udf(name: str, body: bytes) -> bytes:
    sectors: dict[int, bytes] = {}
    tag = lambda kind: struct.pack("<H", kind) + bytes(14)
    sectors[16], sectors[17] = b"\0BEA01\x01", b"\0NSR02\x01"
    sectors[32] = tag(5).ljust(188, b"\0") + struct.pack("<II", 260, 100)
    sectors[33] = tag(6).ljust(248, b"\0") + struct.pack("<IIH", 2048, 0, 0)
    sectors[34] = tag(8)
    sectors[256] = tag(2) + struct.pack("<II", 3 * 2048, 32)
    sectors[260] = tag(256).ljust(400, b"\0") + struct.pack("<IIH", 2048, 1, 0)

    def entry(kind: int, content: bytes | None, size: int, block: int = 0) -> bytes:
        head = (tag(261) + bytes(11) + bytes([kind])).ljust(34, b"\0") + struct.pack("<H", 3 if content is not None else 0)
        alloc = content if content is not None else b"".join(
            struct.pack("<II", min(1 << 29, size - a), block + a // 2048) for a in range(0, size, 1 << 29)
        )
        return (head.ljust(56, b"\0") + struct.pack("<Q", size)).ljust(168, b"\0") + struct.pack("<II", 0, len(alloc)) + alloc

    raw = b"\x08" + name.encode("latin-1")
    fid = (tag(257) + struct.pack("<HBB", 1, 0, len(raw)) + struct.pack("<II", 2048, 2) + bytes(8) + struct.pack("<H", 0) + raw)
    fid += bytes(-len(fid) % 4)
    sectors[261] = entry(4, fid, len(fid))
    sectors[262] = entry(5, None, len(body), 3)
    parts, at = [], 0
    for k, s in sectors.items():
        parts += [_ZEROS[: k * 2048 - at], s]
        at = k * 2048 + len(s)
    return b"".join([*parts, bytes(263 * 2048 - at), body, bytes(-len(body) % 2048)])


def _number7(n: int) -> bytes:
    return b"\xff" + struct.pack("<Q", n) if n > 127 else bytes([n])


def seven(name: str, body: bytes) -> bytes:
    size = next((k for k in range(17) if 4096 << k // 2 >= len(body) and not k % 2), 16)  # the window is no larger than the text
    packed = lzma.compress(body, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "preset": 1, "dict_size": 4096 << size // 2}])
    v = _number7
    streams = b"\x06" + v(0) + v(1) + b"\x09" + v(len(packed)) + b"\0" + b"\x07\x0b" + v(1) + b"\0" + v(1) + b"\x21\x21\x01" + bytes([size]) + b"\x0c" + v(len(body)) + b"\0" + b"\0"
    names = b"\0" + name.encode("utf-16-le") + b"\0\0"
    head = b"\x01\x04" + streams + b"\x05" + v(1) + b"\x11" + v(len(names)) + names + b"\0\0"
    start = struct.pack("<QQI", len(packed), len(head), zlib.crc32(head))
    return b"7z\xbc\xaf\x27\x1c\0\x04" + struct.pack("<I", zlib.crc32(start)) + start + packed + head


def rar(name: str, body: bytes) -> bytes:
    raw = name.encode()
    head = struct.pack("<BHHIIBIIBBHI", 0x74, 0x8000, 32 + len(raw), len(body), len(body), 0, zlib.crc32(body), 0, 20, 0x30, len(raw), 0) + raw
    main = struct.pack("<BHHHI", 0x73, 0, 13, 0, 0)
    return b"Rar!\x1a\x07\x00" + struct.pack("<H", zlib.crc32(main) & 0xFFFF) + main + struct.pack("<H", zlib.crc32(head) & 0xFFFF) + head + body


def _vint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def rar5(name: str, body: bytes) -> bytes:
    raw = name.encode()

    def block(content: bytes, data: bytes = b"") -> bytes:
        sized = _vint(len(content)) + content
        return struct.pack("<I", zlib.crc32(sized)) + sized + data

    main = block(_vint(1) + _vint(0) + _vint(0))
    file = block(_vint(2) + _vint(2) + _vint(len(body)) + _vint(0) + _vint(len(body)) + _vint(0) + _vint(0) + _vint(0) + _vint(len(raw)) + raw, body)
    return b"Rar!\x1a\x07\x01\x00" + main + file + block(_vint(5) + _vint(0) + _vint(0))


def repeats(body: bytes) -> list[tuple[int, int]]:
    """Starts and lengths of all runs of one byte, four times or more."""
    raw = np.frombuffer(body, np.uint8)
    edges = np.concatenate(([0], np.flatnonzero(raw[1:] != raw[:-1]) + 1, [len(raw)]))
    sizes = np.diff(edges)
    return list(zip(edges[:-1][sizes > 3].tolist(), sizes[sizes > 3].tolist(), strict=True))


def bit_array(digits: str) -> np.ndarray:
    return np.frombuffer(digits.encode(), np.uint8) - 48


def low_bits(numbers: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` lowest bits of 16-bit numbers one after another, highest first."""
    return np.unpackbits(numbers.astype(">u2").view(np.uint8).reshape(-1, 2), axis=1)[:, 16 - width :].ravel()


def lzh_block(body: bytes, width: int) -> bytes:
    """Codes of nine bits for plain bytes and for repeats of the byte before, in blocks."""
    parts, at, plain = [], 0, np.frombuffer(body, np.uint8).astype(np.uint16)
    for start, n in repeats(body):
        copies = [256] * ((n - 1) // 256) + [(n - 1) % 256] * ((n - 1) % 256 >= 3)
        parts += [plain[at : start + 1], np.array(copies, np.uint16) + 253]
        at = start + 1 + sum(copies)
    symbols = np.concatenate([*parts, plain[at:]])
    bits = []
    for k in range(0, len(symbols), 60000):
        part = symbols[k : k + 60000]
        bits.append(bit_array(f"{len(part):016b}" + "00000" + f"{11:05b}" + f"{510:09b}" + "0" * width + f"{0:0{width}b}"))
        bits.append(low_bits(part, 9))
    return np.packbits(np.concatenate(bits)).tobytes() if bits else b""


def arj(name: str, body: bytes) -> bytes:
    def head(kind: int, method: int, packed: int, size: int, file: str) -> bytes:
        content = bytes([30, 11, 1, 0, 0, method, kind, 0]) + struct.pack("<IIIIHHH", 0, packed, size, zlib.crc32(body), 0, 0, 0) + file.encode() + b"\0\0"
        return b"\x60\xea" + struct.pack("<H", len(content)) + content + struct.pack("<IH", zlib.crc32(content), 0)

    raw = lzh_block(body, 5)
    return head(2, 0, 0, 0, "made.arj") + head(0, 1, len(raw), len(body), name) + raw + b"\x60\xea\0\0"


def lha(name: str, body: bytes) -> bytes:
    raw, n = lzh_block(body, 4), name.encode("latin-1")
    content = b"-lh5-" + struct.pack("<IIIBB", len(raw), len(body), 0, 0x20, 0) + bytes([len(n)]) + n + struct.pack("<H", 0)
    return bytes([len(content), sum(content) & 255]) + content + raw + b"\0"


def alz(name: str, body: bytes) -> bytes:
    deflate, n = zlib.compressobj(6, zlib.DEFLATED, -15), name.encode("cp949")
    raw = deflate.compress(body) + deflate.flush()
    return b"ALZ\x01" + struct.pack("<I", 10) + b"BLZ\x01" + struct.pack("<HBIBB", len(n), 32, 0, 0x40, 0) + struct.pack("<BBIII", 2, 0, zlib.crc32(body), len(raw), len(body)) + n + raw + b"CLZ\x01"


def egg(name: str, body: bytes) -> bytes:
    deflate, n = zlib.compressobj(6, zlib.DEFLATED, -15), name.encode()
    raw, end = deflate.compress(body) + deflate.flush(), struct.pack("<I", 0x08E28222)
    field = struct.pack("<IBH", 0x0A8591AC, 0, len(n)) + n
    block = struct.pack("<IBBIII", 0x02B50C13, 1, 0, len(body), len(raw), zlib.crc32(body)) + end + raw
    return b"EGGA" + struct.pack("<HII", 0x100, 1, 0) + end + struct.pack("<IIQ", 0x0A8590E3, 1, len(body)) + field + end + block + end


def xar(name: str, body: bytes) -> bytes:
    raw = zlib.compress(body)
    toc = f'<?xml version="1.0"?><xar><toc><file id="1"><name>{name}</name><type>file</type><data><length>{len(raw)}</length><offset>0</offset><size>{len(body)}</size><encoding style="application/x-gzip"/></data></file></toc></xar>'
    packed = zlib.compress(toc.encode())
    return b"xar!" + struct.pack(">HHQQI", 28, 1, len(packed), len(toc), 0) + packed + raw


def adc_literals(body: bytes) -> bytes:
    return b"".join(bytes([0x80 | len(p) - 1]) + p for p in (body[k : k + 128] for k in range(0, len(body), 128)))


def dmg(name: str, body: bytes) -> bytes:
    """Three kinds of block: half of the bytes zlib, half ADC, and zeros behind, as blocks are of whole sectors."""
    whole = body + bytes(-len(body) % 512)
    half = len(whole) // 1024 * 512
    parts = [(0x80000005, zlib.compress(whole[:half]), half // 512), (0x80000004, adc_literals(whole[half:]), (len(whole) - half) // 512), (0, b"", 1)]
    data, runs, sector = b"", b"", 0
    for kind, raw, n in parts:
        runs += struct.pack(">IIQQQQ", kind, 0, sector, n, len(data), len(raw))
        data, sector = data + raw, sector + n
    runs += struct.pack(">IIQQQQ", 0xFFFFFFFF, 0, sector, 0, len(data), 0)
    table = (b"mish" + struct.pack(">IQQQII", 1, 0, sector, 0, 0, 0)).ljust(200, b"\0") + struct.pack(">I", 4) + runs
    listing = plistlib.dumps({"resource-fork": {"blkx": [{"Name": name, "Data": table, "ID": "0", "Attributes": "0x50"}]}})
    trailer = (b"koly" + struct.pack(">III", 4, 512, 1) + struct.pack(">QQQ", 0, 0, len(data))).ljust(216, b"\0") + struct.pack(">QQ", len(data), len(listing))
    return data + listing + trailer.ljust(512, b"\0")


def hfs(name: str, body: bytes) -> bytes:
    block, node = 512, 512
    fork = lambda size, at: struct.pack(">QII", size, 0, -(-size // block)) + struct.pack(">II", at, -(-size // block)) + bytes(56)
    raw = name.encode("utf-16-be")
    key = struct.pack(">IH", 2, len(name)) + raw
    record = struct.pack(">H", len(key)) + key + (struct.pack(">HHII", 2, 0, 0, 16)).ljust(88, b"\0") + fork(len(body), 6) + fork(0, 0)
    leaf = (struct.pack(">IIBBHH", 0, 0, 255, 1, 1, 0) + record).ljust(node - 4, b"\0") + struct.pack(">HH", 14 + len(record), 14)
    header = (struct.pack(">IIBBHH", 0, 0, 1, 0, 3, 0) + struct.pack(">HIIIIHHII", 1, 1, 1, 1, 1, node, 516, 2, 0)).ljust(node, b"\0")
    volume = (b"H+" + struct.pack(">H", 4)).ljust(40, b"\0") + struct.pack(">I", block)
    volume = volume.ljust(272, b"\0") + fork(2 * node, 4)
    return bytes(1024) + volume.ljust(1024, b"\0") + header + leaf + body + bytes(-len(body) % block)


def threes(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places of the tokens of a text, and which of them are copies of three bytes like the one before; the others are plain bytes."""
    kept, copies = np.ones(len(body), bool), np.zeros(len(body), bool)
    for start, n in repeats(body):
        firsts = start + 1 + 3 * np.arange((n - 1) // 3)
        copies[firsts] = True
        kept[firsts + 1] = kept[firsts + 2] = False
    places = np.flatnonzero(kept)
    return places, copies[places]


def flagged(body: bytes, places: np.ndarray, copies: np.ndarray, words: np.ndarray | int, plain: bool) -> bytes:
    """Tokens in groups of eight behind a byte of flags, the lowest first: plain bytes, and copies as 16-bit words. ``plain`` is the flag of plain bytes."""
    n = len(places)
    flags = np.packbits(copies ^ plain, bitorder="little")
    sizes = 1 + copies
    at = np.cumsum(sizes) - sizes + np.arange(n) // 8 + 1
    out = np.zeros(int(sizes.sum()) + len(flags), np.uint8)
    out[at] = np.where(copies, words & 255, np.frombuffer(body, np.uint8)[places])
    out[at[copies] + 1] = np.broadcast_to(words, n)[copies] >> 8
    out[at[::8] - 1] = flags
    return out.tobytes()


def szdd(name: str, body: bytes) -> bytes:
    """Plain bytes, and a copy of three bytes wherever a byte comes four times in a row."""
    places, copies = threes(body)
    where = places + 4079 & 4095
    return b"SZDD\x88\xf0\x27\x33A\0" + struct.pack("<I", len(body)) + flagged(body, places, copies, where & 255 | (where >> 4 & 0xF0) << 8, True)


def vba_container(source: bytes) -> bytes:
    """Chunks of 4096 bytes; a byte that comes four times in a row is copied."""
    out = bytearray(b"\x01")
    for k in range(0, len(source), 3600):
        chunk = source[k : k + 3600]
        part = flagged(chunk, *threes(chunk), 0, False)
        out += struct.pack("<H", 0xB000 | len(part) - 1) + part
    return bytes(out)


def compound(streams: dict[str, bytes]) -> bytes:
    """A compound file of sectors of 512 bytes; names with a slash lie in a storage."""
    storages = sorted({p.split("/")[0] for p in streams if "/" in p})
    entries, sectors, fat, mini, small = [["Root Entry", 5, None, b""]], [], [], [], b""
    for s in storages:
        entries.append([s, 1, None, b""])
    for p, b in streams.items():
        entries.append([p.split("/")[-1], 2, p.split("/")[0] if "/" in p else None, b])

    def place(body: bytes) -> int:
        n, first = -(-len(body) // 512), len(sectors)
        if not n:
            return 0xFFFFFFFE
        sectors.extend(body[k * 512 : (k + 1) * 512].ljust(512, b"\0") for k in range(n))
        fat.extend([*range(first + 1, first + n), 0xFFFFFFFE])
        return first

    starts = [0xFFFFFFFE] * len(entries)
    for k, (_, kind, _, body) in enumerate(entries):
        if kind == 2 and len(body) < 4096 and body:
            n = -(-len(body) // 64)
            starts[k] = len(mini)
            mini += [*range(len(mini) + 1, len(mini) + n), 0xFFFFFFFE]
            small += body.ljust(n * 64, b"\0")
        elif kind == 2:
            starts[k] = place(body)
    starts[0] = place(small)
    mini_first = place(b"".join(struct.pack("<I", x) for x in mini))
    none = 0xFFFFFFFF
    above = lambda e: e[2]

    def siblings(folder: str | None) -> list[int]:
        return [k for k, e in enumerate(entries) if k and (above(e) == folder if e[1] == 2 else folder is None)]

    right, child = {}, {}
    for folder, owner in [(None, 0)] + [(s, 1 + i) for i, s in enumerate(storages)]:
        own = siblings(folder)
        child[owner] = own[0] if own else none
        right |= dict(zip(own, [*own[1:], none], strict=False))
    tree = b""
    for k, (name, kind, _, body) in enumerate(entries):
        raw = name.encode("utf-16-le") + b"\0\0"
        size = len(small) if k == 0 else len(body)
        tree += raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw), kind, 1, none, right.get(k, none), child.get(k, none)) + bytes(36) + struct.pack("<IQ", starts[k], size)
    root = place(tree)
    n_fat = 1
    while (len(fat) + n_fat + max(0, -(-(n_fat - 109) // 127))) > n_fat * 128:
        n_fat += 1
    first, extra = len(fat), max(0, -(-(n_fat - 109) // 127))
    fat += [0xFFFFFFFD] * n_fat + [0xFFFFFFFC] * extra
    fat += [none] * (n_fat * 128 - len(fat))
    table, listed = struct.pack(f"<{len(fat)}I", *fat), [first + k for k in range(n_fat)]
    more = b""
    for k in range(extra):
        part = listed[109 + 127 * k : 109 + 127 * (k + 1)]
        part += [none] * (127 - len(part)) + [first + n_fat + k + 1 if k + 1 < extra else 0xFFFFFFFE]
        more += struct.pack("<128I", *part)
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(16) + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + bytes(10)
    head += struct.pack("<8I", n_fat, root, 0, 4096, mini_first, -(-len(mini) // 128), first + n_fat if extra else 0xFFFFFFFE, extra)
    head += struct.pack("<109I", *(listed[:109] + [none] * (109 - len(listed[:109]))))
    return head + b"".join(sectors) + table + more


def document(name: str, body: bytes) -> bytes:
    """A compound file with the text as a stream."""
    return compound({name: body})


def macro_document(name: str, body: bytes) -> bytes:
    """A compound file with the text as the source of a macro module."""
    r = lambda kind, content: struct.pack("<HI", kind, len(content)) + content
    listing = r(1, struct.pack("<I", 1)) + struct.pack("<HI", 9, 4) + bytes(6) + r(0x19, name.encode()) + r(0x1A, b"Module1") + r(0x31, struct.pack("<I", 5)) + r(0x2B, b"")
    return compound({"VBA/dir": vba_container(listing), "VBA/Module1": b"cache" + vba_container(body)})


def rich_text(name: str, body: bytes) -> bytes:
    counted = lambda b: struct.pack("<I", len(b)) + b
    native = struct.pack("<II", 0x501, 2) + counted(name.encode() + b"\0") + counted(b"") + counted(b"") + counted(body)
    digits = native.hex()
    lines = "\n".join(digits[k : k + 128] for k in range(0, len(digits), 128))
    return ("{\\rtf1\\ansi{\\object\\objemb{\\*\\objdata " + lines + "}}}").encode()


def word_xml(name: str, body: bytes) -> bytes:
    return f'<?xml version="1.0"?>\n<?mso-application progid="Word.Document"?>\n<w:wordDocument><w:binData w:name="{name}">'.encode() + base64.encodebytes(body) + b"</w:binData></w:wordDocument>"


def notebook(name: str, body: bytes) -> bytes:
    mark = bytes.fromhex("e4525c7b8cd8a74daeb1537 8d02996d3".replace(" ", ""))
    return mark + bytes(64) + bytes.fromhex("e716e3bd65261145a4c48d4d0b7a9eac") + struct.pack("<Q", len(body)) + bytes(12) + body + bytes(8)


def korean(name: str, body: bytes) -> bytes:
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    info = bytearray(128)
    info[124] = 1
    return b"HWP Document File V3.00 \x1a\1\2\3\4\5".ljust(30, b"\0")[:30] + bytes(info) + bytes(1008) + deflate.compress(body) + deflate.flush()


def inverted(name: str, body: bytes) -> bytes:
    return b"\xb6\xb9\xac\xae\xfe\xff\xff\xff".ljust(16, b"\0") + bytes(b ^ 255 for b in body)


def partitioned(name: str, body: bytes) -> bytes:
    """A disk with a boot record and one partition of whole sectors, the text's length before it."""
    n = -(-(len(body) + 8) // 512)
    entry = bytes([0, 0, 0, 0, 0x83, 0, 0, 0]) + struct.pack("<II", 1, n)
    return bytes(446) + entry + bytes(48) + b"\x55\xaa" + (struct.pack("<Q", len(body)) + body).ljust(n * 512, b"\0")


#: What :mod:`scanfold.plans.member_queries` writes of each kind; the flag tells whether the member's name is kept.
WRITERS: dict[str, tuple[str, Callable[[str, bytes], bytes], bool]] = {
    "zip": ("ZIP", zipped, True), "zip_locked": ("ZIP", locked_zip, True), "tar": ("POSIX_TAR", tarred, True), "gzip": ("GZ", lambda n, b: gzip.compress(b, 1), False),
    "bzip2": ("BZ", lambda n, b: bz2.compress(b, 1), False), "xz": ("XZ", lambda n, b: lzma.compress(b, preset=0), False), "zstd": ("ZSTD", zstd, False), "cpio": ("CPIO_ODC", cpio, True),
    "cpio_new": ("CPIO_NEWC", new_cpio, True), "mail": ("MAIL", mail, True), "uuencode": ("UUENCODED", uuencoded, True), "pdf": ("PDF", pdf, False), "pdf_lzw": ("PDF", lzw_pdf, False),
    "cabinet": ("MSCAB", cabinet, True), "iso": ("ISO9660", iso, True), "udf": ("UDF", udf, True), "seven": ("7Z", seven, True), "rar": ("RAR", rar, True), "rar5": ("RAR", rar5, True),
    "arj": ("ARJ", arj, True), "lha": ("LHA_LZH", lha, True), "alz": ("ALZ", alz, True), "egg": ("EGG", egg, True), "xar": ("XAR", xar, True), "hfs": ("HFSPLUS", hfs, True), "szdd": ("MSSZDD", szdd, False),
    "compound": ("MSOLE2", document, True), "rtf": ("RTF", rich_text, True), "word_xml": ("XML_WORD", word_xml, True), "notebook": ("ONENOTE", notebook, False), "hwp": ("HWP3", korean, False),
    "inverted": ("CRYPTFF", inverted, False),
}


def program(name: str, body: bytes) -> bytes:
    """A PE file whose first section is the text, entered at its start; the second one imports a function of the member's name and an ordinal."""
    second, at = 0x2000 + len(body) // 0x1000 * 0x1000, 512 + len(body)
    function = name.rsplit(".", 1)[0].upper().encode() + b"\0"
    imports = struct.pack("<5I", second + 40, 0, 0, second + 54 + len(function), second + 40) + bytes(20)
    imports += struct.pack("<III", second + 52, 1 << 31 | 7, 0) + bytes(2) + function + b"KERNEL32.dll\0"
    optional = bytearray(224)
    struct.pack_into("<H", optional, 0, 0x10B)
    struct.pack_into("<I", optional, 16, 0x1000)
    struct.pack_into("<II", optional, 104, second, len(imports))
    head = b"MZ".ljust(60, b"\0") + struct.pack("<I", 64) + b"PE\0\0" + struct.pack("<HHIIIHH", 0x14C, 2, 0, 0, 0, 224, 0x102) + bytes(optional)
    for label, size, rva, raw in ((b".text", len(body), 0x1000, 512), (b".idata", len(imports), second, at)):
        head += label.ljust(8, b"\0") + struct.pack("<IIII", size, rva, size, raw) + bytes(16)
    return head.ljust(512, b"\0") + body + imports

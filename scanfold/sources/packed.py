"""Byte-level codecs that the standard library lacks: LZSS, static Huffman LZ, deflate64, implode, ADC, stream ciphers."""

from __future__ import annotations

import bz2
import functools
import lzma
import struct
import zlib

import numpy as np


class Bits:
    """Bits of a byte string, lowest first or highest first; zeros follow its end."""

    def __init__(self, data: bytes, low_first: bool = False):
        self.data, self.low_first = data, low_first
        self.at = self.held = self.count = 0

    def _fill(self, n: int) -> None:
        while self.count < n:
            b = self.data[self.at] if self.at < len(self.data) else 0
            if self.at > len(self.data) + 64:
                raise ValueError("the packed data ends early")
            self.at += 1
            self.held = self.held | b << self.count if self.low_first else (self.held << 8 | b)
            self.count += 8

    def peek(self, n: int) -> int:
        self._fill(n)
        return self.held & (1 << n) - 1 if self.low_first else self.held >> (self.count - n)

    def skip(self, n: int) -> None:
        self._fill(n)
        self.count -= n
        self.held = self.held >> n if self.low_first else self.held & (1 << self.count) - 1

    def take(self, n: int) -> int:
        value = self.peek(n) if n else 0
        self.skip(n)
        return value

    def seek(self, place: int) -> None:
        """Go to a bit of the data, counted from its start; highest bits first."""
        self.at = -(-place // 8)
        self.count = self.at * 8 - place
        self.held = self.data[self.at - 1] & (1 << self.count) - 1 if self.count else 0


#: In tables of symbols, what no code stands for.
NONE = 1 << 16


class Huffman:
    """A canonical code by the lengths of its symbols, read bit by bit."""

    def __init__(self, lengths: list[int]):
        self.codes: dict[tuple[int, int], int] = {}
        self.only, self.table = None, None
        code = before = 0
        for n, symbol in sorted((own, symbol) for symbol, own in enumerate(lengths) if own):
            code <<= n - before
            self.codes[n, code] = symbol
            code, before = code + 1, n
        self.most = max(lengths, default=0)

    def _table(self, low_first: bool) -> list[tuple[int, int] | None]:
        """For each run of as many bits as the longest code has, the symbol it begins with and the length of its code."""
        table: list[tuple[int, int] | None] = [None] * (1 << self.most)
        for (n, code), symbol in self.codes.items():
            if low_first:
                first = int(f"{code:0{n}b}"[::-1], 2)
                for k in range(1 << self.most - n):
                    table[first | k << n] = symbol, n
            else:
                first = code << self.most - n
                table[first : first + (1 << self.most - n)] = [(symbol, n)] * (1 << self.most - n)
        return table

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        if self.table is None:
            self.table = self._table(bits.low_first)
        if (found := self.table[bits.peek(self.most)]) is None:
            raise ValueError("no such code")
        bits.skip(found[1])
        return found[0]

    @functools.cached_property
    def entries(self) -> list[tuple[int, int]]:
        """The table for highest bits first; runs that no code begins have NONE and no length."""
        return [(NONE, 0) if e is None else e for e in self._table(False)] if self.only is None else [(self.only, 0)]

    @functools.cached_property
    def flat(self) -> np.ndarray | None:
        """Symbols by code, NONE for those that aren't given, where all codes have one length of 16 bits at most."""
        if not self.codes or self.most > 16 or min(n for n, _ in self.codes) < self.most:
            return None
        return np.array([s for s, _ in self.entries], np.int32)

    @classmethod
    def single(cls, symbol: int) -> Huffman:
        out = cls([])
        out.only = symbol
        return out


def copied(out: bytearray, distance: int, n: int) -> None:
    """``n`` bytes again from ``distance`` back; what lies before the start is zero."""
    if distance > len(out):
        zeros = min(n, distance - len(out))
        out += bytes(zeros)
        n -= zeros
    if n > 0:
        piece = bytes(out[len(out) - distance : len(out) - distance + n])
        out += piece if len(piece) == n else (piece * (n // distance + 1))[:n]


def szdd(data: bytes, limit: int) -> bytes:
    """LZSS with a ring of 4096 blanks; a flag's set bit is a plain byte."""
    size = struct.unpack_from("<I", data, 10)[0]
    out, at = bytearray(b" " * 4096), 14  # the ring before its start, of which place 4080 is written first
    most = min(size, limit) + 4096
    while at < len(data) and len(out) < most:
        flags, at = data[at], at + 1
        if flags == 255:
            out += data[at : at + min(8, most - len(out))]
            at += 8
            continue
        for bit in range(8):
            if at >= len(data) or len(out) >= most:
                break
            if flags >> bit & 1:
                out.append(data[at])
                at += 1
                continue
            if at + 1 >= len(data):
                break
            where, n = data[at] | (data[at + 1] & 0xF0) << 4, (data[at + 1] & 15) + 3
            at += 2
            copied(out, (len(out) - 16 - where - 1 & 4095) + 1, n)
    return bytes(out[4096:most])


def _lengths(bits: Bits, n: int, width: int, gap: int | None) -> Huffman:
    count = bits.take(width)
    if not count:
        return Huffman.single(bits.take(width))
    found: list[int] = []
    while len(found) < count:
        size = bits.take(3)
        if size == 7:
            while bits.take(1):
                size += 1
        found.append(size)
        if gap is not None and len(found) == gap:
            found += [0] * bits.take(2)
    return _code(tuple(found[:n]))


def _code(lengths: tuple[int, ...]) -> Huffman:
    """Codes of blocks one after another are often the same; only those of small tables are kept."""
    return _kept(lengths) if max(lengths, default=0) <= 16 else Huffman(list(lengths))


@functools.lru_cache(8)
def _kept(lengths: tuple[int, ...]) -> Huffman:
    return Huffman(list(lengths))


def _flat_symbols(bits: Bits, out: bytearray, most: int, left: int, codes: Huffman) -> int:
    """Symbols of codes of one length, copies being of the byte before, all at once: how many were read."""
    n, p = codes.most, bits.at * 8 - bits.count
    m = min(left, most - len(out), (len(bits.data) * 8 - p) // n, 1 << 16)
    if m <= 0:
        return 0
    symbols = codes.flat[_codes(bits, m, n)]
    if symbols.max() < 256:
        out += symbols.astype(np.uint8).tobytes()
    else:
        plain, sizes = symbols < 256, np.where(symbols < 256, 1, symbols - 253)
        bad = np.flatnonzero(symbols == NONE)
        m = min(m, int(np.searchsorted(np.cumsum(sizes), most - len(out))) + 1, int(bad[0]) if len(bad) else m)
        own = np.maximum.accumulate(np.where(plain[:m], np.arange(m), -1))
        values = np.where(own < 0, out[-1] if out else 0, symbols[own])
        out += np.repeat(values.astype(np.uint8), sizes[:m]).tobytes()
    bits.seek(p + n * m)
    return m


def _symbols(bits: Bits, out: bytearray, most: int, left: int, codes: Huffman, places: Huffman) -> int:
    """At most ``left`` symbols, as long as four more bytes of data follow: how many were read."""
    if places.only == 0 and codes.flat is not None:
        return _flat_symbols(bits, out, most, left, codes)
    data, end, table, width, append, done = bits.data, len(bits.data) - 4, codes.entries, codes.most, out.append, 0
    mask = (1 << width) - 1
    while done < left and len(out) < most:
        at, held, count, before, c = bits.at, bits.held, bits.count, len(out), 0
        for _ in range(min(left - done, most - before)):
            if count < 16:
                if at > end:
                    break
                held = (held & (1 << count) - 1) << 32 | int.from_bytes(data[at : at + 4], "big")
                at, count = at + 4, count + 32
            c, n = table[held >> count - width & mask]
            count -= n
            if c > 255:
                break
            append(c)
        bits.at, bits.held, bits.count = at, held & (1 << count) - 1, count
        done += len(out) - before
        if c < 256:
            break
        if c == NONE:
            raise ValueError("no such code")
        _copy(bits, out, c, places)
        done += 1
    return done


def _copy(bits: Bits, out: bytearray, c: int, places: Huffman) -> None:
    p = places.read(bits)
    copied(out, 1 if p == 0 else (1 << p - 1) + bits.take(p - 1) + 1, c - 253)


def lzh(data: bytes, size: int, distances: int, width: int) -> bytes:
    """Blocks of static Huffman codes over plain bytes and copies, as LZH and ARJ archives have them."""
    bits, out, left = Bits(data), bytearray(), 0
    codes = places = None
    while len(out) < size:
        if not left:
            left = bits.take(16)
            helper = _lengths(bits, 19, 5, 3)
            count = bits.take(9)
            if not count:
                codes = Huffman.single(bits.take(9))
            else:
                found: list[int] = [helper.only - 2] * count if helper.only is not None and helper.only > 2 else []
                while len(found) < count:
                    c = helper.read(bits)
                    found += [0] * (1, bits.take(4) + 3 if c == 1 else 0, bits.take(9) + 20 if c == 2 else 0)[c] if c < 3 else [c - 2]
                codes = _code(tuple(found[:510]))
            places = _lengths(bits, distances, width, None)
            if not left:
                raise ValueError("an empty block")
        left -= _symbols(bits, out, size, left, codes, places)
        if not left or len(out) >= size:
            continue
        left -= 1
        c = codes.read(bits)
        if c < 256:
            out.append(c)
        else:
            _copy(bits, out, c, places)
    return bytes(out[:size])


_FIXED = [8] * 144 + [9] * 112 + [7] * 24 + [8] * 8
_ORDER = (16, 17, 18, 0, 8, 7, 9, 6, 10, 5, 11, 4, 12, 3, 13, 2, 14, 1, 15)


def inflate64(data: bytes, limit: int) -> bytes:
    """Deflate with a window of 64 kB and lengths up to 65538."""
    bits, out, last = Bits(data, True), bytearray(), 0
    while not last and len(out) < limit:
        last, kind = bits.take(1), bits.take(2)
        if kind == 0:
            bits.skip(bits.count & 7)
            n = bits.take(16)
            bits.take(16)
            out += bytes(bits.take(8) for _ in range(n))
            continue
        if kind == 3:
            raise ValueError("no such block")
        if kind == 1:
            codes, places = Huffman(_FIXED), Huffman([5] * 32)
        else:
            n, m, h = bits.take(5) + 257, bits.take(5) + 1, bits.take(4) + 4
            small = [0] * 19
            for k in _ORDER[:h]:
                small[k] = bits.take(3)
            helper, found = Huffman(small), []
            while len(found) < n + m:
                c = helper.read(bits)
                if c < 16:
                    found.append(c)
                elif c == 16:
                    found += [found[-1]] * (3 + bits.take(2))
                else:
                    found += [0] * (3 + bits.take(3) if c == 17 else 11 + bits.take(7))
            codes, places = Huffman(found[:n]), Huffman(found[n:])
        while len(out) < limit:
            c = codes.read(bits)
            if c < 256:
                out.append(c)
                continue
            if c == 256:
                break
            if c < 265:
                n = c - 254
            elif c == 285:
                n = 3 + bits.take(16)
            else:
                extra = (c - 261) // 4
                n = (4 + (c - 265) % 4 << extra) + 3 + bits.take(extra)
            d = places.read(bits)
            distance = d + 1 if d < 4 else (2 + d % 2 << d // 2 - 1) + 1 + bits.take(d // 2 - 1)
            copied(out, distance, n)
    return bytes(out[:limit])


def implode_trees(bits: Bits, n: int) -> Huffman:
    """Code lengths of an imploded member: pairs of a count and a length."""
    found: list[int] = []
    for _ in range(bits.take(8) + 1):
        b = bits.take(8)
        found += [(b & 15) + 1] * ((b >> 4) + 1)
    if len(found) != n:
        raise ValueError("a tree of another size")
    return Huffman(found)


def _complement(tree: Huffman) -> Huffman:
    """The same lengths with codes given from the longest up, as imploding does."""
    lengths = {symbol: n for (n, _), symbol in tree.codes.items()}
    order = sorted(lengths, key=lambda s: (lengths[s], s), reverse=True)
    tree.codes, code, step, before = {}, 0, 0, 0
    for symbol in order:
        n = lengths[symbol]
        code += step
        if n != before:
            before, step = n, 1 << 16 - n
        tree.codes[n, code >> 16 - n] = symbol
    return tree


def explode(data: bytes, size: int, flags: int) -> bytes:
    """An imploded zip member; ``flags`` tell the window's size and whether plain bytes are coded."""
    bits, literal = Bits(data, True), None
    if flags & 4:
        literal = _complement(implode_trees(bits, 256))
    lengths, places = _complement(implode_trees(bits, 64)), _complement(implode_trees(bits, 64))
    low, least, out = 7 if flags & 2 else 6, 3 if flags & 4 else 2, bytearray()
    while len(out) < size:
        if bits.take(1):
            out.append(literal.read(bits) if literal else bits.take(8))
            continue
        distance = bits.take(low)
        distance += (places.read(bits) << low) + 1
        n = lengths.read(bits)
        n += least + (bits.take(8) if n == 63 else 0)
        copied(out, distance, n)
    return bytes(out[:size])


def zip_body(method: int, body: bytes, size: int, flags: int, limit: int) -> bytes | None:
    """A zip member's content by its method; None for one that isn't known."""
    most = min(size, limit) if size else limit
    if method == 0:
        return body[:most]
    if method == 8:
        return zlib.decompressobj(-15).decompress(body, most)
    if method == 9:
        return inflate64(body, most)
    if method == 6:
        return explode(body, most, flags)
    if method == 12:
        return bz2.BZ2Decompressor().decompress(body, most)
    if method == 14:
        b = body[4]
        filters = [{"id": lzma.FILTER_LZMA1, "lc": b % 9, "lp": b // 9 % 5, "pb": b // 45, "dict_size": max(4096, struct.unpack("<I", body[5:9])[0])}]
        return lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=filters).decompress(body[9:], most)
    return None


def cabinet_folder(data: bytes, at: int, blocks: int, kind: int, reserve: int, limit: int) -> bytes | None:
    """All blocks of a cabinet's folder, stored or deflated with the blocks before as their history."""
    out = bytearray()
    if kind & 15 > 1:
        return None
    for _ in range(blocks):
        _, n, _ = struct.unpack_from("<IHH", data, at)
        raw = data[at + 8 + reserve : at + 8 + reserve + n]
        at += 8 + reserve + n
        if kind & 15 == 0:
            out += raw
        else:
            if raw[:2] != b"CK":
                raise ValueError("a block without its mark")
            out += zlib.decompressobj(-15, zdict=bytes(out[-32768:])).decompress(raw[2:], 32768)
        if len(out) > limit:
            break
    return bytes(out)


def adc(data: bytes, size: int) -> bytes:
    """Apple's data compression: plain runs, and copies of two or three bytes' head."""
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        b = data[at]
        if b & 0x80:
            n = (b & 0x7F) + 1
            out += data[at + 1 : at + 1 + n]
            at += 1 + n
        elif b & 0x40:
            copied(out, (data[at + 1] << 8 | data[at + 2]) + 1, (b & 0x3F) + 4)
            at += 3
        else:
            copied(out, ((b & 3) << 8 | data[at + 1]) + 1, (b >> 2 & 15) + 3)
            at += 2
    return bytes(out[:size])


def rc4(data: bytes, key: bytes) -> bytes:
    """The stream cipher; it is its own inverse."""
    s, j = list(range(256)), 0
    for i in range(256):
        j = j + s[i] + key[i % len(key)] & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(), 0, 0
    for b in data:
        i = i + 1 & 255
        j = j + s[i] & 255
        s[i], s[j] = s[j], s[i]
        out.append(b ^ s[s[i] + s[j] & 255])
    return bytes(out)


def zip_decrypted(data: bytes, password: bytes) -> bytes:
    """A member under the traditional zip cipher, without its twelve bytes of head."""
    table = _crc_table()
    k0, k1, k2 = 0x12345678, 0x23456789, 0x34567890

    def update(b: int) -> None:
        nonlocal k0, k1, k2
        k0 = k0 >> 8 ^ table[(k0 ^ b) & 255]
        k1 = (k1 + (k0 & 255)) * 134775813 + 1 & 0xFFFFFFFF
        k2 = k2 >> 8 ^ table[(k2 ^ k1 >> 24) & 255]

    for b in password:
        update(b)
    out = bytearray()
    for b in data:
        t = k2 | 2
        c = b ^ (t * (t ^ 1) >> 8 & 255)
        update(c)
        out.append(c)
    return bytes(out[12:])


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


def jumps_made_relative(data: bytes) -> bytes:
    """Undo the x86 jump filter, by the library's own."""
    made = lzma.LZMACompressor(lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "preset": 0}])
    plain = made.compress(data) + made.flush()
    return lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_X86}, {"id": lzma.FILTER_LZMA2, "preset": 0}]).decompress(plain)


_SINGLE = [bytes([k]) for k in range(256)] + [b"", b""]


def _codes(bits: Bits, n: int, width: int) -> np.ndarray:
    """The next ``n`` codes of the data, which aren't taken yet."""
    p = bits.at * 8 - bits.count
    first, last = p >> 3, p + n * width + 7 >> 3
    raw = np.zeros(last - first + 2, np.uint32)
    raw[:-2] = np.frombuffer(bits.data, np.uint8, last - first, first)
    at = (p & 7) + width * np.arange(n)
    return (raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:])[at >> 3] >> (24 - width - (at & 7)).astype(np.uint32) & (1 << width) - 1


def _plain_codes(bits: Bits, out: bytearray, limit: int) -> bool:
    """Take runs of codes that are all single bytes up to a clearing of the table or the end, as the entries made of them are never read. Was it the end?

    A table that was just cleared is followed by no more than 254 codes of nine bits; where it isn't cleared by then, or another code comes before, nothing is taken.
    """
    step = 1 << 9
    while (n := min(step, (len(bits.data) * 8 - bits.at * 8 + bits.count) // 9)) > 0:
        codes = _codes(bits, n, 9)
        marks = np.flatnonzero(codes > 255)
        stop = np.flatnonzero((np.diff(marks, prepend=-1) > 254) | (codes[marks] > 257))
        marks = marks[: stop[0]] if len(stop) else marks
        ends = np.flatnonzero(codes[marks] == 257)
        marks = marks[: ends[0] + 1] if len(ends) else marks
        if not len(marks):
            return False
        taken = codes[: int(marks[-1]) + 1]
        part = taken[taken < 256]
        if len(out) + len(part) >= limit:
            return False
        out += part.astype(np.uint8).tobytes()
        bits.seek(bits.at * 8 - bits.count + 9 * len(taken))
        if len(ends):
            return True
        step = min(step * 4, 1 << 15)
    return False


def lzw(data: bytes, limit: int, early: int = 1) -> bytes:
    """LZW codes of 9 to 12 bits, highest bit first, as PDF streams have them."""
    bits, out = Bits(data), bytearray()
    table: list[bytes] = []
    width, before = 9, None
    while len(out) < limit and bits.at < len(data) + 2:
        if width == 9 and before is None and early == 1 and _plain_codes(bits, out, limit):
            break
        code = bits.take(width)
        if code == 256 or not table:
            table, width, before = _SINGLE[:], 9, None
            if code == 256:
                continue
        if code == 257:
            break
        if code < len(table):
            entry = table[code]
        elif before is not None and code == len(table):
            entry = before + before[:1]
        else:
            break
        out += entry
        if before is not None and len(table) < 4096:
            table.append(before + entry[:1])
        before = entry
        width = 12 if len(table) + early >= 2048 else 11 if len(table) + early >= 1024 else 10 if len(table) + early >= 512 else 9
    return bytes(out[:limit])


def run_lengths(data: bytes, limit: int) -> bytes:
    """Runs of a length byte: up to 127 plain bytes follow, from 129 one is repeated, 128 ends."""
    out, at = bytearray(), 0
    while at < len(data) and data[at] != 128 and len(out) < limit:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
    return bytes(out[:limit])

"""Codecs and decoders on known vectors, odd forms and damaged input; the automaton against expressions; scans in order."""

import hashlib
import random
import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanfold.functions import pictures, similar, tables
from scanfold.operators import automaton, match, reader, rollup
from scanfold.plans import scan
from scanfold.sources import archives, members, office, packed, writers
from scanfold.sources import signatures as sigs
from scanfold.streaming import scan as streams

WORDS = b"the quick brown fox jumps over the lazy dog aaaaaaaaaaaaaaaa "


def texts():
    r = random.Random(2)
    return [b"", b"a", WORDS * 40, bytes(r.randrange(256) for _ in range(3000)), b"\0" * 5000, b"ab" * 40000]


def test_every_writer_is_undone():
    for kind, (type_, write, named) in writers.WRITERS.items():
        for body in texts():
            decode = members.DECODERS[type_]
            rows = list(decode(write("d1.txt", body), 1 << 30, (b"infected",)) if kind == "zip_locked" else decode(write("d1.txt", body), 1 << 30))
            assert [r[5] for r in rows] == [body], (kind, len(body))
            assert not named or rows[0][0] == "d1.txt", kind
    for body in texts():
        found = dict(office.macros(dict(office.Compound(writers.macro_document("M", body)).streams())))
        assert found == {"M": body}
    stored = writers.cabinet("x", WORDS, stored=True)
    assert [r[5] for r in archives.cabinet(stored, 999)] == [WORDS]


def test_damaged_containers_end():
    r = random.Random(5)
    for kind, (type_, write, _) in writers.WRITERS.items():
        if kind == "udf":
            continue
        whole = write("d1.txt", WORDS * 20)
        for _ in range(12):
            cut = bytearray(whole[: r.randrange(len(whole) + 1)])
            for _ in range(3):
                if cut:
                    cut[r.randrange(len(cut))] = r.randrange(256)
            try:
                for _, _row in zip(range(1000), members.DECODERS[type_](bytes(cut), 1 << 20), strict=False):
                    pass
            except members.ERRORS:
                pass


def test_codecs():
    assert packed.rc4(b"Plaintext", b"Key").hex() == "bbf316e8d940af0ad3"
    for body in (WORDS * 3, bytes(range(256)) + bytes(range(100)), b""):
        for strategy in (zlib.Z_HUFFMAN_ONLY, zlib.Z_FIXED, zlib.Z_DEFAULT_STRATEGY):
            c = zlib.compressobj(6, zlib.DEFLATED, -15, 9, strategy)
            assert packed.inflate64(c.compress(body) + c.flush(), 1 << 20) == body
    c = zlib.compressobj(0, zlib.DEFLATED, -15)
    assert packed.inflate64(c.compress(WORDS) + c.flush(), 1 << 20) == WORDS
    assert packed.run_lengths(b"\x02abc\xfdx\x80zz", 99) == b"abcxxxx" and packed.adc(bytes([0x82]) + b"abc" + bytes([0x04, 2]), 99) == b"abcabca"
    # imploded: plain bytes uncoded, lengths and places in trees of equal codes of six bits
    trees = bytes([3]) + bytes([0xF5] * 4)
    bits = "".join(f"1{b:08b}"[:1] + f"{b:08b}"[::-1] for b in b"abc") + "0" + "000010"[::-1] + f"{63 - 0:06b}" + f"{63 - 1:06b}"
    bits += "0" * (-len(bits) % 8)
    coded = bytes(int(bits[k : k + 8][::-1], 2) for k in range(0, len(bits), 8))
    assert packed.explode(trees + trees + coded, 6, 0) == b"abcabc"


def seconds(kind):
    """CPU seconds for a megabyte, written and read back."""
    type_, write, _ = writers.WRITERS[kind]
    r, began = random.Random(4), None
    bodies = [bytes(r.choices(range(32, 127), k=4000)) for _ in range(250)]
    began = time.process_time()
    for body in bodies:
        made = write("d1.txt", body)
        rows = list(members.DECODERS[type_](made, 1 << 30, (b"infected",)) if kind == "zip_locked" else members.DECODERS[type_](made, 1 << 30))
        assert rows[0][5] == body
    return time.process_time() - began


def test_lzh_codes_of_several_lengths_and_copies():
    r = random.Random(6)
    lengths = [8 if k < 128 else 9 if k < 256 else 10 if k < 510 else 0 for k in range(510)]
    codes, code = {}, 0
    for n in (8, 9, 10):
        for symbol in (k for k in range(510) if lengths[k] == n):
            codes[symbol] = f"{code:0{n}b}"
            code += 1
        code <<= 1
    symbols, want, bits = [], bytearray(), []
    while len(want) < 30000:
        c, p = r.choice((r.randrange(256), r.randrange(510))), r.randrange(14)
        symbols.append(codes[c] + (f"{p:04b}" + (f"{0:0{p - 1}b}" if p > 1 else "") if c > 255 else ""))
        if c < 256:
            want.append(c)
        else:
            distance = 1 if p == 0 else (1 << p - 1) + 1
            for _ in range(c - 253):
                want.append(want[-distance] if distance <= len(want) else 0)
    for k in range(0, len(symbols), 2000):
        part = symbols[k : k + 2000]
        helper = f"{19:05b}" + "101" * 3 + "00" + "101" * 16
        bits.append(f"{len(part):016b}" + helper + f"{510:09b}" + "".join(f"{n + 2:05b}" for n in lengths) + f"{14:04b}" + "100" * 14 + "".join(part))
    text = "".join(bits)
    raw = int(text + "0" * (-len(text) % 8), 2).to_bytes(-(-len(text) // 8), "big")
    assert packed.lzh(raw, len(want), 14, 4) == bytes(want) and packed.lzh(raw, 12345, 14, 4) == bytes(want[:12345])
    with pytest.raises(ValueError, match="ends early"):
        packed.lzh(raw[:100], len(want), 14, 4)


@pytest.mark.parametrize("kind", ["lha", "arj", "szdd", "pdf_lzw"])
def test_bulk_codecs_keep_up(kind):
    assert seconds(kind) < 1.0


def test_seven_holds_no_window_larger_than_the_text():
    for n in (0, 1, 4096, 4097, 70000, (1 << 20) + 1):
        body = (bytes(random.Random(n).choices(range(256), k=50000)) * (n // 50000 + 1))[:n]
        assert [r[5] for r in archives.seven(writers.seven("a", body), 1 << 30)] == [body]
    assert archives._filters7(b"\x21", b"\x18", 5000)[0]["dict_size"] == 5000 and archives._filters7(b"\x21", b"\x18", 1 << 30)[0]["dict_size"] == 1 << 24


def test_flagged_tokens_at_any_place():
    r = random.Random(7)
    for n in (*range(40), 3599, 3600, 3601, 3607, 4095, 4096, 4097, 7205, 9001):
        for body in (bytes(r.choices(range(256), k=n)), bytes(r.choices(b"ab", [9, 1], k=n))):
            assert packed.szdd(writers.szdd("x", body), 1 << 20) == body and packed.szdd(writers.szdd("x", body), n // 2) == body[: n // 2]
            assert office.vba_decompressed(writers.vba_container(body)) == body
    began = time.process_time()
    body = bytes(r.choices(range(256), k=4_000_000))
    assert office.vba_decompressed(writers.vba_container(body)) == body
    assert time.process_time() - began < 2


def lzw_packed(body, clear):
    """Codes as they are defined, the table cleared after each ``clear`` of them."""
    bits, at = "", 0
    while at < len(body):
        bits += f"{256:0{9 if not bits else width}b}"  # noqa: F821
        table, width, n, before = {bytes([k]): k for k in range(256)}, 9, 258, None
        for _ in range(clear):
            size = next((k for k in range(1, len(body) - at + 1) if body[at : at + k] not in table), len(body) - at + 1) - 1
            if not size:
                break
            bits += f"{table[body[at : at + size]]:0{width}b}"
            if before is not None and n < 4096:
                n += 1
            before, at = size, at + size
            if n < 4095 and at < len(body):
                table[body[at - size : at + 1]] = n
            width = 12 if n >= 2047 else 11 if n >= 1023 else 10 if n >= 511 else 9
    bits += f"{257:0{width}b}"
    return int(bits + "0" * (-len(bits) % 8), 2).to_bytes(-(-len(bits) // 8), "big")


def test_lzw_cleared_at_any_place():
    r = random.Random(8)
    for alphabet in (range(256), b"ab"):
        body = bytes(r.choices(alphabet, k=5000))
        for clear in (1, 2, 252, 253, 254, 255, 256, 600, 3000):
            raw = lzw_packed(body, clear)
            assert packed.lzw(raw, 1 << 20) == body and packed.lzw(raw, 777) == body[:777] and packed.lzw(raw, len(body)) == body, clear


def test_zip_members_by_local_header():
    made = writers.zipped("a.txt", WORDS)
    assert archives.zip_member(made, 999)[5] == WORDS
    hidden = archives.zip_member(writers.locked_zip("a.txt", WORDS), 999)
    assert hidden[3] and hidden[6] == "Heuristics.Encrypted.Zip"


def test_limits_passwords_and_time(spark):
    rows = [(1, "ZIP", bytearray(writers.zipped("a", WORDS))), (2, "ZIP", bytearray(writers.locked_zip("b", b"secret"))), (3, "ZIP", bytearray(b"PK junk")), (4, "ZIP", None)]
    df = spark.createDataFrame(rows, "object_id long, type string, content binary")
    got = {r["parent_id"]: (bytes(r["content"]) if r["content"] is not None else None, r["alert"]) for r in members.children(df, limit=10, passwords=(b"no", b"infected")).collect()}
    assert got[1] == (WORDS[:10], members.OVER_SIZE) and got[2] == (b"secret", None) and got[3][1].startswith("Unreadable") and got[4][1].startswith("Unreadable")
    locked = members.children(df.where("object_id = 2")).collect()
    assert [(r["content"], r["alert"], r["encrypted"]) for r in locked] == [(None, "Heuristics.Encrypted.Zip", True)]
    late = members.children(df.where("object_id = 1"), seconds=-1.0).collect()
    assert [r["alert"] for r in late] == [None, members.OVER_TIME]


def nested(depth):
    body = b"EVIL at the bottom"
    for k in range(depth):
        body = writers.tarred(f"l{k}", body)
    return body


def test_scans_go_down_and_in_order(spark):
    objects = spark.createDataFrame([(1, "deep", bytearray(nested(20))), (2, "two", bytearray(writers.tarred("x", b"SECOND") + b"")), (3, "plain", bytearray(b"FIRST then SECOND"))], "object_id long, name string, content binary")
    seen = []
    found = scan.Signatures(bodies=[("Z.First", 0, "*", "4649525354"), ("A.Second", 0, "*", "5345434f4e44"), ("Evil", 0, "*", "4556494c206174")])
    config = scan.ScanConfig(max_depth=30, normalize=False, progress=lambda level, n: seen.append((level, n)))
    tree = tables.written(scan.tree(objects, config), "tree")
    assert tree.where("root_id = 1").count() == 21 and seen[0] == (1, 2) and seen[-1][1] == 0
    assert rollup.ancestors(tree).where("object_id <> ancestor_id").count() == 20 * 21 // 2 + 1
    got = scan.indicators(tree, found, config)
    deep = got.where("root_id = 1 and name = 'Evil'").select(F.max(F.size("seq.place"))).first()[0]
    assert deep == 20
    first = {r["root_id"]: r["name"] for r in rollup.first_matches(got).collect()}
    assert first == {1: "Evil", 2: "A.Second", 3: "A.Second"}  # all of one place and source, so by name
    shallow = spark.createDataFrame([(1, bytearray(nested(2))), (2, bytearray(nested(1)))], "object_id long, content binary")
    trust = spark.createDataFrame([("sha256", hashlib.sha256(nested(2)).hexdigest(), None, "ok")], "algo string, digest string, size long, name string")
    held = scan.scan(shallow, scan.Signatures(bodies=found.bodies, trust=trust), config)
    assert {r["root_id"]: r["verdict"] for r in held.collect()} == {1: "NOTHING_FOUND", 2: "STRONG_INDICATOR"}
    with pytest.raises(ValueError, match="in itself"):
        rollup.ancestors(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "object_id long, parent_id long"))


def test_typing_reads_the_content_once(spark):
    objects = spark.createDataFrame([(1, bytearray(writers.udf("a", b"x"))), (2, bytearray(b"<html>")), (3, None), (4, bytearray(writers.dmg("a", WORDS))), (5, bytearray(writers.partitioned("a", b"x")))], "object_id long, content binary")
    objects = objects.repartition(1)
    typed = scan.typed(objects).select("object_id", "type", scan.volume_type("content").alias("volume"))
    assert typed._jdf.queryExecution().optimizedPlan().toString().count("array(content#") == 2
    assert typed._jdf.queryExecution().optimizedPlan().toString().count("content#") < 8
    assert {r[0]: (r[1], r[2]) for r in typed.collect()} == {1: ("UDF", "UDF"), 2: ("HTML", None), 3: ("BINARY_DATA", None), 4: ("DMG", None), 5: ("MBR", None)}


def test_scan_parts(spark):
    pixels = np.random.default_rng(1).integers(0, 256, (40, 30, 3), dtype=np.uint8)
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 30, 40, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    bmp_rows = b"".join(row[:, ::-1].tobytes() + bytes(-90 % 4) for row in pixels[::-1])
    bmp = b"BM" + struct.pack("<IIIIiiHHIIiiII", 54 + len(bmp_rows), 0, 54, 40, 30, 40, 1, 24, 0, 0, 0, 0, 0, 0) + bmp_rows
    digest = similar.picture_hash(pixels)
    assert pictures.file_hash(png) == pictures.file_hash(bmp) == digest and pictures.file_hash(png[:60]) is None and pictures.file_hash(None) is None
    html = b'<html><a href="http://evil.example.org/x">http://bank.com/login</a> <a href="http://partner.org/">http://bank.com/</a></html>'
    given = scan.given(spark, [png, html, writers.program("d7.txt", b"code"), writers.zipped("odd.exe", b"x"), writers.locked_zip("k", b"y"), b"PASS"], list("abcdef"))
    found = scan.Signatures(
        images=spark.createDataFrame([(digest, "Image")], "digest string, name string"), protected=spark.createDataFrame([("bank.com",)], "pattern string"), allowed=spark.createDataFrame([("partner.org", "bank.com")], "pattern string, display string"),
        sections=spark.createDataFrame([("md5", hashlib.md5(b"code").hexdigest(), 4, "Section")], "algo string, digest string, size long, name string"),
        containers=sigs.parse(spark.createDataFrame([("Odd:ZIP:*:\\.exe$:*:*:*:*:*:*",)], "value string"), "cdb"),
        bodies=spark.createDataFrame([("Pass", 0, "0", "50415353", None), ("TextOnly", 7, "*", "504153", None), ("ExeOnly", 1, "*", "504153", None)], "name string, target int, off string, hex string, options string"),
    )
    names = {}
    for r in scan.indicators(scan.tree(given), found).collect():
        names.setdefault(r["root_id"], set()).add(r["name"])
    assert names == {0: {"Image"}, 1: {"Heuristics.Phishing.Email.SpoofedDomain"}, 2: {"Section"}, 3: {"Odd"}, 4: {"Heuristics.Encrypted.Zip"}, 5: {"Pass", "TextOnly"}}
    nothing = match.magic_matches(given, spark.createDataFrame([], "seq long, off int, magic binary, type string"))
    assert nothing.count() == 0 and streams.activity(spark)["failed"] == 0


def test_automaton_by_brute_force(spark):
    import regex

    from scanfold.operators import patterns

    r = random.Random(3)
    data = [bytes(r.choice(b"abcAB\n ") for _ in range(r.randrange(60))) for _ in range(60)]
    forms = ["6162", "61??62", "6161{1-3}62", "(6162|6263)61", "!(61|62)6163", "61[1-2]6263", "6161*6262", "(B)6162", "6162(L)"]
    table = [(f"s{k}{o}{w}", w, h, o) for k, h in enumerate(forms) for o in ("", "i") for w in ("*", "3", "2,4", "EOF-5")]
    made = automaton.Matcher(table)
    for text in data:
        want = []
        for name, off, code, options in table:
            lo, hi = patterns.parse_offset(off).span(len(text)) or (1, 0)
            form = regex.compile(patterns.compile_hex(code, options).regex.replace(r"\z", r"\Z").encode("latin-1"), regex.S)
            at = [m.start() for m in form.finditer(text, overlapped=True) if lo <= m.start() <= hi]
            if at:
                want.append((name, sorted(set(at))))
        assert sorted(made.run(text)) == sorted(want), text
    assert automaton.anchor("61??6263{2-4}64656667*68") == "64656667" and automaton.anchor("6?7?") == "" and automaton.anchor("(6162|6364)65") == ""
    few = spark.createDataFrame([(1, bytearray(b"xxabab")), (2, None)], "object_id long, content binary")
    bodies = spark.createDataFrame([(f"n{k}", "*", "6162") for k in range(40)], "name string, off string, hex string")
    assert automaton.matches(few, bodies, part=100).count() == 40 and automaton.matches(few, bodies.limit(0)).count() == 0


def test_reader():
    r = reader.Reader(b"head" + zlib.compress(b"body") + b"7 0 obj <</A 1>> endobj 7 0 obj <</A 2>> endobj")
    assert r.read(4) == b"head" and r.inflated(12) == b"body" and r.seek(99999) == -1 and r.seek(0) == 0 and r.find(b"obj") > 0
    r.add("seen", 5)
    r.put("m", b"k", b"v")
    assert r.contains("seen", 5) and not r.contains("seen", 6) and r.value("m", b"k") == b"v" and r.value("x", b"k") is None
    assert r.pdf_object(7) == b" <</A 2>> " and r.pdf_object(8) is None
    j = reader.Reader(b'{"a": {"b": [1, {"c": "x"}]}}')
    assert j.json_value("a.b.1.c") == "x" and j.json_value("a.z") is None and reader.Reader(b"{").json_value("a") is None
    assert "document.write" in reader.Reader(b"var q = 1; document.write(unescape('%41'));").script(99)

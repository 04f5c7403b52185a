"""Similarity, scripts, structure checks, embedded objects, hooks, updates."""

import gzip
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from scanfold.functions import raw, scripts, similar
from scanfold.operators import hooks
from scanfold.operators.logic import Logical
from scanfold.plans import scan, versions
from scanfold.sources import members, structures

from test_tables import tarred, zipped


def test_resemblance():
    assert [similar.resemblance(*p) for p in (("same", "SAME"), ("abc", "xyz"), ("", "a"), ("text/html", "text/htlm"))] == [100, 0, 0, 88]
    assert similar.resemblance("x" * 60, "y") is None


def test_picture_hash(spark):
    g = np.random.default_rng(3)
    small = g.integers(0, 256, (32, 32), dtype=np.uint8)
    big = np.kron(small, np.ones((4, 4), np.uint8))
    a, b = (int(similar.picture_hash(x), 16) for x in (small, big))
    assert bin(a ^ b).count("1") <= 4
    row = spark.createDataFrame([(bytearray(small.tobytes()), 32), (bytearray(b"odd"), 32), (None, 1)], "p binary, w int").select(similar.image_hash("p", "w").alias("h")).collect()
    assert [r["h"] for r in row] == [f"{a:016x}", None, None]


def test_regex_suffixes():
    assert similar.regex_suffixes(r".+\.example\.com$") == [".example.com"] and similar.regex_suffixes(r"www\.bank\.(com|net)") == ["www.bank.com", "www.bank.net"] and similar.regex_suffixes(".*") == []


def test_scripts(spark):
    assert scripts.normalize_script("var a = 'x'+'y' /* c */ ; b(a)") == 'var n000="xy";n001(n000)'
    assert scripts.normalize_script("eval(unescape('%61lert(1)'))") == "n000(1)"
    packed = "eval(function(p,a,c,k,e,d){return p}('0 1=2;',3,3,'var|x|7'.split('|'),0,{}))"
    assert scripts.normalize_script(packed) == "var n000=7;"
    rows = spark.createDataFrame([("f('a')",), (None,), ("",)], "s string").select(scripts.normalized("s").alias("n")).collect()
    assert [r["n"] for r in rows] == ['n000("a")', None, ""]


def test_structures():
    jpeg = b"\xff\xd8\xff\xe0\x00\x10JFIF\0" + bytes(9) + b"\xff\xda\x00\x03\x01data\xff\xd9"
    assert [r[0] for r in structures.jpeg(jpeg, 99)] == ["ffe0", "ffda"]
    assert list(structures.jpeg(b"\xff\xd8\xff\xe0\x00", 9))[-1][-1].endswith("CantReadSegmentSize") and list(structures.jpeg(b"\xff\xd8\xff\xd9", 9))[-1][-1].endswith("NoImages")
    tiff = b"II*\0" + struct.pack("<IHHHIII", 8, 1, 256, 3, 1, 5, 0)
    assert [r[0] for r in structures.tiff(tiff, 9)] == ["tag256"] and list(structures.tiff(b"II*\0\xff\0\0\0", 9))[0][-1].endswith("InvalidIFDOffset")
    riff = b"RIFF" + struct.pack("<I", 99) + b"ACON" + b"anih" + struct.pack("<I", 40) + bytes(40)
    assert list(structures.riff(riff, 9))[0][-1].endswith("MS05-002")
    sector = lambda first, n, name: (b"PM\0\0" + struct.pack(">III", 2, first, n) + name.ljust(32, b"\0") + b"Apple_HFS".ljust(32, b"\0")).ljust(512, b"\0")
    apm = b"ER\x02\0".ljust(512, b"\0") + sector(4, 4, b"one") + sector(6, 4, b"two") + bytes(512 * 20)
    assert [(r[0], r[-1]) for r in structures.apple_map(apm, 9)] == [("one", "Heuristics.APMPartitionIntersection"), ("two", None)]
    tnef = b"\x78\x9f\x3e\x22\0\0" + b"".join(struct.pack("<BII", 2, t, len(b)) + b + b"\0\0" for t, b in ((0x00018010, b"f.txt\0"), (0x0006800F, b"body")))
    assert [(r[0], r[5]) for r in structures.tnef(tnef, 99)] == [("f.txt", b"body")]
    body = bytes([1]) + b"n\0" + b"TEXTtest\0\0" + struct.pack(">II", 3, 0) + b"\0\0" + b"abc\0\0"
    table = "!\"#$%&'()*+,-012345689@ABCDEFGHIJKLMNPQRSTUVXYZ[`abcdefhijklmpqr"
    bits = "".join(f"{b:08b}" for b in body)
    coded = "".join(table[int(bits[k : k + 6].ljust(6, "0"), 2)] for k in range(0, len(bits), 6))
    assert [(r[0], r[5]) for r in structures.binhex(b"(This file)\n:" + coded.encode() + b":", 99)] == [("n", b"abc")]
    assert {"JPEG", "TIFF", "APM", "TNEF", "BINHEX", "RIFF"} <= set(members.DECODERS)


def test_embedded_objects_are_scanned(spark):
    data = b"prefix " + zipped(x=b"hidden EVIL " + b"pad " * 50)
    df = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(b"")), (3, bytearray(b"PK\x03\x04"))], "object_id long, content binary")
    got = structures.embedded(df).collect()
    assert [(r["parent_id"], r["offset"], r["type"]) for r in got] == [(1, 7, "ZIPSFX")]
    sigs = scan.Signatures(bodies=[("Evil", 0, "*", "4556494c")])
    on, off = ({r["root_id"]: r["verdict"] for r in scan.scan(df, sigs, scan.ScanConfig(embedded=e)).collect()} for e in (True, False))
    assert on[1] == "STRONG_INDICATOR" and off[1] == "NOTHING_FOUND"


def test_signature_archives(spark):
    body = tarred(**{"a.ndb": b"X:0:*:6161\n"})
    df = spark.createDataFrame([(1, bytearray(b"H".ljust(512) + body)), (2, bytearray(b"H".ljust(512) + gzip.compress(body)))], "object_id long, content binary")
    assert sorted((r["fname"], bytes(r["content"])) for r in structures.archive_tables(df).collect()) == [("a.ndb", b"X:0:*:6161\n")] * 2


def test_hooks(spark):
    h = hooks.Hooks()
    seen = []

    def shout(s: pd.Series) -> pd.Series:
        return s.str.upper()

    h.add("loud", pandas_udf(shout, "string"), ("text",), Logical.parse("T;Target:0;0;676f"))
    h.on("alert", lambda t: seen.append(1) or t.where("id > 0"))
    df = spark.createDataFrame([(0, "go"), (1, "no"), (2, None)], "id int, text string")
    assert [r["loud"] for r in h.run(df, raw.byte_text("text")).orderBy("id").collect()] == ["GO", None, None]
    assert h.at("alert", df).count() == 2 and h.at("pre_scan", df).count() == 3 and seen
    with pytest.raises(ValueError, match="no point"):
        h.on("never", lambda t: t)
    assert "sub 0: Body" in hooks.explained("T;Target:0;0;676f")
    got = spark.range(1).select(hooks.ilog2(F.lit(8), F.lit(1)).alias("a"), hooks.ipow(F.lit(2), F.lit(3), F.lit(10)).alias("b")).first()
    assert tuple(got) == (3 << 26, 80)


def test_updates(spark):
    table = spark.createDataFrame([("a", 1, "ONE")], "db string, line_no long, line string")
    one = versions.script(spark.createDataFrame([(0, "OPEN a"), (1, "ADD TWO"), (2, "CLOSE")], "seq long, value string")).withColumn("version", F.lit(2))
    got, v = versions.updated(table, one, 1, 2)
    assert v == 2 and got.count() == 2
    full = spark.createDataFrame([("a", 1, "FULL")], "db string, line_no long, line string")
    got, v = versions.updated(table, one, 1, 5, full)
    assert v == 5 and got.first()["line"] == "FULL"
    got, v = versions.updated(table, one, 1, 5)
    assert v == 2 and got.count() == 2
    assert versions.announced("1.2:62:27:1700000000:1:90:x:335") == {"engine": "1.2", "main": 62, "daily": 27, "time": 1700000000, "warn": 1, "level": 90, "bytecode": 335}
    head, counts = versions.built({"ndb": table}, 7, "me", 1)
    assert len(head) == 512 and counts == {"ndb": 1}


def small_exe():
    """A PE file with one section and an import of two functions."""
    sec = bytearray(512)
    sec[0:20] = struct.pack("<5I", 0x1040, 0, 0, 0x1080, 0x1060)
    for base in (0x40, 0x60):
        sec[base : base + 12] = struct.pack("<III", 0x1090, 0x80000007, 0)
    sec[0x80:0x8D] = b"KERNEL32.DLL\0"
    sec[0x90:0x9D] = b"\0\0LoadThing\0\0"
    head = bytearray(512)
    head[0:2], head[60:64] = b"MZ", struct.pack("<I", 64)
    head[64:88] = b"PE\0\0" + struct.pack("<HHIIIHH", 0x14C, 1, 0, 0, 0, 224, 0)
    head[88:90] = struct.pack("<H", 0x10B)
    head[104:108] = struct.pack("<I", 0x1000)
    head[88 + 104 : 88 + 112] = struct.pack("<II", 0x1000, 40)
    head[88 + 224 : 88 + 264] = b".text\0\0\0" + struct.pack("<4I", 512, 0x1000, 512, 512) + bytes(16)
    return bytes(head + sec)


def test_executables(spark):
    import hashlib

    from scanfold.operators import match

    exe = small_exe()
    assert members.exe_info(exe)[:2] == (512, 1) and members.import_list(exe) == "kernel32.loadthing,kernel32.ord7" and members.import_list(b"MZ") is None
    df = spark.createDataFrame([(1, bytearray(exe)), (2, bytearray(b"MZ no")), (3, bytearray(b"text")), (4, None)], "object_id long, content binary")
    listed = members.import_list(exe)
    sigs = spark.createDataFrame([("md5", hashlib.md5(listed.encode()).hexdigest(), len(listed), "Imp"), ("sha256", hashlib.sha256(listed.encode()).hexdigest(), None, "ImpAny")], "algo string, digest string, size long, name string")
    assert sorted(map(tuple, match.import_matches(df, sigs).collect())) == [(1, "Imp"), (1, "ImpAny")]
    with_exe = members.with_exe(df)
    assert {r["object_id"]: r["exe"] and r["exe"]["nsections"] for r in with_exe.collect()} == {1: 1, 2: None, 3: None, 4: None}
    sec = spark.createDataFrame([("md5", hashlib.md5(exe[512:1024]).hexdigest(), 512, "Sec")], "algo string, digest string, size long, name string")
    assert [tuple(r) for r in match.section_matches(with_exe, sec).collect()] == [(1, 0, "Sec")]
    sig = Logical.parse("E;Target:1,EntryPoint:512,NumberOfSections:1-2;0;EP+144:00004c6f6164")
    assert [tuple(r) for r in match.logical_matches(with_exe, [sig]).collect()] == [(1, "E")]


def test_event_streams(spark, tmp_path):
    from scanfold.streaming import scan as streams

    rows = [(1, 1, "read", 0), (2, 1, "read", 60), (3, 2, "write", 3700), (4, 3, "read", 3800)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    df.write.parquet(str(tmp_path / "in"))
    events = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))

    def run(stream, name, mode="append"):
        q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    kept = run(streams.first_seen(streams.admitted(events(), exclude_users=(3,)), keys=["user_id", "event_type"]), "firsts")
    assert sorted((r["user_id"], r["event_type"]) for r in kept) == [(1, "read"), (2, "write")]
    counts = run(streams.windowed(events()), "counts", "complete")
    assert sorted((r["event_type"], r["n"]) for r in counts) == [("read", 1), ("read", 2), ("write", 1)]
    sigs = spark.createDataFrame([("write", "W")], "event_type string, name string")
    assert [r["name"] for r in run(streams.matched(events(), sigs, "event_type"), "matches")] == ["W"]

"""Signature tables, versions, roll-ups, containers, whole scans and streams."""

import bz2
import gzip
import io
import lzma
import tarfile
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from scanfold.operators import match, rollup
from scanfold.operators.logic import Logical
from scanfold.plans import scan, versions
from scanfold.sources import members, signatures
from scanfold.streaming import scan as streams


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_tables_parse_and_refuse(spark):
    md5 = "0" * 32
    rows = signatures.parse(lines(spark, f"{md5}:12:A.B", f"{md5}:*:Wild:73", "# remark", "", "broken"), "hdb", on_error="quarantine").collect()
    assert [(r["name"], r["size"], r["malformed"]) for r in rows] == [("A.B", 12, False), ("Wild", None, False), (None, None, True)]
    with pytest.raises(Exception, match="malformed"):
        signatures.parse(lines(spark, f"{md5}:*:Wild:1"), "hdb").collect()
    assert signatures.parse(lines(spark, "Sig:0:EOF-10:6162{2}63:51:255"), "ndb").first()["off"] == "EOF-10"
    ldb = signatures.parse(lines(spark, "L;Engine:51-255,Target:0;0&1;6162;0/a;b/i"), "ldb").first()
    assert ldb["subs"] == ["6162", "0/a;b/i"] and (ldb["min_fl"], ldb["max_fl"]) == (51, 255)
    assert signatures.parse(lines(spark, "S:P:4d8bef53", "H:key.com", "R:.*x:y"), "pdb").where("is_prefix").count() == 1
    for kind, line in {"wdb": "X:a:b", "ftm": "0:0:504b0304:ZIP:ANY:ZIP", "cdb": "N:ZIP:*:x:1-5:*:1:*:*:*", "ign2": "Name", "pwdb": "n;Target:0;0;pw", "crb": "n;1;s;2;3;4;1;0", "idb": "n:a:b:0", "info": "x:1:2", "mdb": f"12:{md5}:S", "imp": f"{md5}:12:I", "db": "N=6162", "zmd": "n:1:x:1:2:3:4:5:6"}.items():
        assert signatures.parse(lines(spark, line), kind).count() == 1, kind


def test_files_and_folders(spark, tmp_path):
    (tmp_path / "a.hdb").write_text("0" * 32 + ":1:One\n")
    with gzip.open(tmp_path / "b.ndb.gz", "wt") as f:
        f.write("Two:0:*:616263\n")
    assert signatures.load(spark, str(tmp_path / "b.ndb.gz")).first()["name"] == "Two"
    before = spark.createDataFrame(signatures.snapshot(spark, str(tmp_path)).collect())
    (tmp_path / "c.hdb").write_text("1" * 32 + ":1:Three\n")
    assert [tuple(r) for r in signatures.changed(before, signatures.snapshot(spark, str(tmp_path))).collect()] == [("c.hdb", "added")]
    assert set(signatures.load_folder(spark, str(tmp_path))) == {"hash"}
    head = b"Tables-VDB:01 Jan 2024:27:1000:90:" + b"a" * 32 + b":sig:me:1700000000"
    row = spark.createDataFrame([(bytearray(head.ljust(512)),), (bytearray(b"x"),)], "c binary").select(signatures.archive_header("c").alias("h")).collect()
    assert row[0]["h"]["version"] == 27 and row[1]["h"] is None


def test_patches(spark):
    table = spark.createDataFrame([("a", 1, "HEAD"), ("a", 2, "ONE"), ("a", 3, "TWO"), ("b", 1, "B1")], "db string, line_no long, line string")
    edit = lambda *x: versions.script(spark.createDataFrame(list(enumerate(x)), "seq long, value string"))
    state = lambda df: [tuple(r) for r in df.orderBy("db", "line_no").collect()]
    got = versions.patched(table, edit("OPEN a", "XCHG 2 ON UNO", "DEL 3 TW", "ADD LAST", "CLOSE", "UNLINK b", "OPEN c", "ADD NEW", "CLOSE"))
    assert state(got) == [("a", 1, "HEAD"), ("a", 2, "UNO"), ("a", 3, "LAST"), ("c", 1, "NEW")]
    for bad in (("OPEN a", "DEL 9 X", "CLOSE"), ("OPEN a", "XCHG 2 TWO X", "CLOSE"), ("MOVE a b 2 ONE 3 WRONG",)):
        with pytest.raises(ValueError, match="no such line"):
            versions.patched(table, edit(*bad)).collect()
    with pytest.raises(Exception, match="refused"):
        edit("OPEN ../a").collect()
    old, new = table.where("db = 'a'").drop("db"), spark.createDataFrame([(1, "HEAD"), (2, "DOS"), (3, "TWO"), (4, "MORE")], "line_no long, line string")
    changes = versions.diff(old, new).withColumn("db", F.lit("a")).withColumns({c: F.lit(None).cast(t) for c, t in (("dst", "string"), ("last_no", "long"), ("last_prefix", "string"))})
    assert [r[2] for r in state(versions.patched(table.where("db = 'a'"), changes))] == ["HEAD", "DOS", "TWO", "MORE"]


def test_limits_and_verdicts(spark):
    rows = spark.createDataFrame([(1, 1, 50, 0), (1, 2, 500, 1), (1, 3, 60, 1), (1, 4, 5, 2), (1, 5, 1, 99)], "root_id long, object_id long, size long, level int")
    got = rollup.limited(rows, max_file=100, max_scan=110, max_files=3)
    assert [r["limit"] for r in got.orderBy("object_id").collect()] == [None, "MaxFileSize", None, "MaxScanSize", "MaxScanSize"]
    assert rollup.limited(rows, max_file=0, max_scan=0, max_files=0, max_depth=0).where("`limit` is not null").count() == 0
    assert rollup.limit_alerts(got).count() == 1
    ind = spark.createDataFrame([(1, 1, "W", "weak", 1), (2, 2, "P", "pua", 1), (2, 2, "S", "strong", 2), (2, 2, "P2", "pua", 3)], "root_id long, object_id long, name string, kind string, seq long")
    assert {r["root_id"]: tuple(r)[1:] for r in rollup.verdicts(ind).collect()} == {1: ("NOTHING_FOUND", None, 0), 2: ("STRONG_INDICATOR", "S", 3)}
    assert sorted(r["name"] for r in rollup.first_matches(ind).collect()) == ["P", "S", "W"]
    assert [r[0] for r in ind.select(rollup.indicator_kind(F.lit("Heuristics.X"), True)).limit(1).collect()] == ["strong"]


def zipped(**files):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
        for k, v in files.items():
            z.writestr(k, v)
    return b.getvalue()


def tarred(**files):
    b = io.BytesIO()
    with tarfile.open(fileobj=b, mode="w", format=tarfile.USTAR_FORMAT) as t:
        for k, v in files.items():
            i = tarfile.TarInfo(k)
            i.size = len(v)
            t.addfile(i, io.BytesIO(v))
    return b.getvalue()


def test_decoders(spark):
    mail = b"From: a@b.org\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=X\n\n--X\nContent-Type: text/plain\n\nhi\n--X\nContent-Type: application/x\nContent-Transfer-Encoding: base64\n\naGVsbG8=\n--X--\n"
    pdf = b"%PDF-1.4\n1 0 obj <</Filter /FlateDecode>> stream\n" + __import__("zlib").compress(b"inside") + b"\nendstream"
    cpio = b"070701" + b"".join(b"%08x" % x for x in (1, 0, 0, 0, 1, 0, 3, 0, 0, 0, 0, 2, 0)) + b"f\0" + b"abc\0" + b"070701" + b"".join(b"%08x" % x for x in (0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0, 11, 0)) + b"TRAILER!!!\0\0\0\0"
    data = [
        ("ZIP", zipped(a=b"one", b=b"two"), [b"one", b"two"]), ("POSIX_TAR", tarred(x=b"tar"), [b"tar"]), ("GZ", gzip.compress(b"gz"), [b"gz"]), ("BZ", bz2.compress(b"bz"), [b"bz"]), ("XZ", lzma.compress(b"xz"), [b"xz"]),
        ("MAIL", mail, [b"hi", b"hello"]), ("PDF", pdf, [b"inside"]), ("CPIO_NEWC", cpio, [b"abc"]), ("UUENCODED", b"begin 644 f\n#8V%T\n`\nend\n", [b"cat"]), ("ZIP", b"PK\x03\x04broken", [None]), ("ZSTD", __import__("zstandard").compress(b"zs"), [b"zs"]),
    ]
    df = spark.createDataFrame([(k, t, bytearray(c)) for k, (t, c, _) in enumerate(data)], "object_id long, type string, content binary")
    got = {}
    for r in members.children(df).orderBy("parent_id", "ordinal").collect():
        got.setdefault(r["parent_id"], []).append(r["content"] and bytes(r["content"]))
    assert got == {k: want for k, (_, _, want) in enumerate(data)}
    assert members.children(df.limit(0)).count() == 0


def test_media_and_partitions():
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\x01IHDRx"
    assert list(members.chunks_of_png(png, 99))[0][-1].endswith("EOFReadingChunkCRC")
    assert list(members.segments_of_gif(b"GIF89a", 9))[0][-1].endswith("TruncatedScreenDescriptor")
    mbr = bytearray(512)
    mbr[510:512] = b"\x55\xaa"
    for k, (a, n) in enumerate(((1, 10), (5, 10))):
        mbr[446 + 16 * k + 4] = 7
        mbr[446 + 16 * k + 8 : 446 + 16 * k + 16] = a.to_bytes(4, "little") + n.to_bytes(4, "little")
    assert list(members.partitions(bytes(mbr), 9))[0][-1] == "Heuristics.MBRPartitionnIntersect"
    elf = b"\x7fELF\x02\x01" + bytes(10) + bytes(8) + (0x1010).to_bytes(8, "little") + (64).to_bytes(8, "little") + bytes(14) + (56).to_bytes(2, "little") + (1).to_bytes(2, "little")
    elf = elf.ljust(64, b"\0") + (1).to_bytes(4, "little") + bytes(4) + (0).to_bytes(8, "little") + (0x1000).to_bytes(8, "little") + bytes(8) + (256).to_bytes(8, "little") * 2 + bytes(8)
    assert members.exe_info(elf)[:2] == (0x10, 1) and members.exe_info(b"no") is None and members.exe_info(b"MZ") is None


def test_headers(spark):
    got = spark.createDataFrame([("Subject: a\r\n b\nX-Y:  z\nsubject: second\n\nBody: no",)], "m string").select(members.mail_headers("m").alias("h")).first()["h"]
    assert got == {"subject": "a b", "x-y": "z"}


def test_whole_scan(spark):
    inner = zipped(deep=b"xx EVIL yy " + b"pad " * 99)
    objects = spark.createDataFrame([(1, "a.zip", bytearray(zipped(n=inner))), (2, "t.txt", bytearray(b"Plain EVIL text")), (3, "c.txt", bytearray(b"clean")), (4, "h.html", bytearray(b"<html><!-- x --><b>EV</b>IL word</html>")), (5, "d.txt", bytearray(b"4111111111111111 5500000000000004 378282246310005"))], "object_id long, name string, content binary")
    sigs = scan.Signatures(bodies=[("Evil.Body", 0, "*", "4556494c"), ("Norm", 7, "*", "6576696c")], logical=[Logical.parse("InZip;Target:0,Container:ZIP;0;4556494c")])
    got = {r["root_id"]: (r["verdict"], r["alerts"]) for r in scan.scan(objects, sigs, scan.ScanConfig(structured=True)).collect()}
    assert got[1] == ("STRONG_INDICATOR", 3) and got[2] == ("STRONG_INDICATOR", 2) and got[3] == ("NOTHING_FOUND", 0) and got[4] == ("NOTHING_FOUND", 0) and got[5] == ("POTENTIALLY_UNWANTED", 1)
    trust = spark.createDataFrame([("md5", __import__("hashlib").md5(inner).hexdigest(), None, "ok")], "algo string, digest string, size long, name string")
    sigs.trust = trust
    got = {r["root_id"]: r["verdict"] for r in scan.scan(objects, sigs).collect()}
    assert got[1] == "NOTHING_FOUND" and got[2] == "STRONG_INDICATOR"
    assert scan.scan(objects.limit(0), sigs).count() == 0
    shallow = {r["root_id"]: r["verdict"] for r in scan.scan(objects, scan.Signatures(bodies=sigs.bodies), scan.ScanConfig(unpack=False)).collect()}
    assert shallow[1] in ("NOTHING_FOUND", "STRONG_INDICATOR") and shallow[2] == "STRONG_INDICATOR"


def test_hash_joins_stay_equi_joins(spark):
    objects = spark.createDataFrame([(1, bytearray(b"x"))], "object_id long, content binary")
    sigs = spark.createDataFrame([("md5", __import__("hashlib").md5(b"x").hexdigest(), 1, "S"), ("md5", __import__("hashlib").md5(b"x").hexdigest(), None, "W")], "algo string, digest string, size long, name string")
    df = match.hash_matches(objects, sigs)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert sorted(r["name"] for r in df.collect()) == ["S", "W"]


def test_container_rules(spark):
    rules = signatures.parse(lines(spark, "Pic:ZIP:*:\\.png$:1-9:*:*:*:*:*", "Enc:*:*:*:*:*:1:*:*:*"), "cdb")
    m = spark.createDataFrame([(1, "ZIP", "a.png", 5, False), (2, "ZIP", "a.png", 50, True), (3, "ZIP", None, 5, None)], "object_id long, container_type string, fname string, fsizec long, encrypted boolean")
    assert sorted(map(tuple, match.container_matches(m, rules).collect())) == [(1, "Pic"), (2, "Enc")]


def test_streams(spark, tmp_path):
    chunks = spark.createDataFrame([("a", 0, bytearray(b"he")), ("a", 1, bytearray(b"llo")), ("a", 2, bytearray(b"")), ("b", 0, bytearray(b"open"))], "stream string, seq int, content binary")
    assert [(r["stream"], bytes(r["content"])) for r in streams.joined_chunks(chunks).collect()] == [("a", b"hello")]
    log = spark.createDataFrame([(1, "add", "/a"), (2, "add", "/a/b"), (3, "remove", "/a/b"), (4, "add", "/c/d"), (5, "remove", "/c"), (6, "add", "/c/e")], "seq long, op string, path string")
    assert sorted(r["path"] for r in streams.watched_tree(log).collect()) == ["/a", "/c/e"]
    source, out = tmp_path / "in", tmp_path / "out"
    rows = [("m1", 2, 2, bytearray(b"B"), 1), ("m1", 1, 2, bytearray(b"A"), 2), ("m2", 1, 3, bytearray(b"X"), 3)]
    spark.createDataFrame(rows, "id string, number int, total int, content binary, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s").write.parquet(str(source))
    parts = spark.readStream.schema(streams.PART).parquet(str(source))
    q = streams.reassembled(parts).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["id"], bytes(r["content"]), r["parts"]) for r in spark.read.parquet(str(out)).collect()] == [("m1", b"AB", 2)]


def test_reloading_between_batches(spark, tmp_path):
    (tmp_path / "a.hdb").write_text("0" * 32 + ":1:One\n")
    seen = []
    step = streams.Reloading(str(tmp_path), lambda df, sigs: df.withColumn("n", F.lit(sigs["hash"].count())), lambda df, k: seen.append(df.first()["n"]))
    df = spark.range(1)
    step(df, 0)
    time.sleep(1)
    (tmp_path / "a.hdb").write_text("0" * 32 + ":1:One\n" + "1" * 32 + ":1:Two\n")
    step(df, 1)
    assert seen == [1, 2]

"""WARC archives as a Python data source, and pages stored in them with repeated payloads as revisits."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from . import common

FORMAT = "scanfold_warc"
SCHEMA = "record_type string, record_id string, target_uri string, warc_date string, payload_digest string, refers_to string, profile string, content_type string, payload_length string, content_length long, payload binary"
#: Columns that are read from a named header, and may be filtered by it before a payload is decoded.
HEADERS = {
    "record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "warc_date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to",
    "profile": "warc-profile", "content_type": "content-type", "payload_length": "x-payload-length",
}
#: How each column's header is written.
WRITTEN_AS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "warc_date": "WARC-Date", "target_uri": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To",
    "profile": "WARC-Profile", "content_type": "Content-Type", "payload_length": "X-Payload-Length",
}
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "_manifest"
SPLIT = 64 << 20
#: A task begins another file when one has so many bytes, so that no file is one reader's burden.
ROLL = 256 << 20


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def record(headers: dict[str, str], payload: bytes) -> bytes:
    """One record as a gzip member; its extra field ``sl`` tells both lengths, so a reader can skip the member unread."""
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items() if v is not None)
    top = f"WARC/1.1\r\n{head}Content-Length: {len(payload)}\r\n\r\n".encode()
    # headers and payload are flushed apart, so that headers can be read without inflating the payload
    deflate = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = deflate.compress(top) + deflate.flush(zlib.Z_FULL_FLUSH) + deflate.compress(payload + b"\r\n\r\n") + deflate.flush()
    size = len(top) + len(payload) + 4
    total = 12 + 12 + len(body) + 8
    check = zlib.crc32(b"\r\n\r\n", zlib.crc32(payload, zlib.crc32(top)))
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, total, size & 0xFFFFFFFF) + body + struct.pack("<II", check, size & 0xFFFFFFFF)


def parse_headers(top: bytes) -> dict[str, str]:
    """Header names in lower case; a line that begins with white space continues the one before."""
    found: dict[str, str] = {}
    name = None
    for line in top.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            found[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            found[name] = value.strip()
    return found


def read_member(data: memoryview, at: int, wanted) -> tuple[int, dict[str, str], bytes | None]:
    """The end of the gzip member at ``at``, its headers, and the payload where ``wanted(headers)``.

    The payload of a record that isn't wanted is inflated only where the member doesn't tell its length.
    """
    flags = data[at + 3]
    start, end = at + 10, None
    if flags & 4:
        n = struct.unpack_from("<H", data, start)[0]
        extra, start = bytes(data[start + 2 : start + 2 + n]), start + 2 + n
        while len(extra) >= 4:
            size = struct.unpack_from("<H", extra, 2)[0]
            if extra[:2] == b"sl" and size == 8:
                end = at + struct.unpack_from("<I", extra, 4)[0]
            extra = extra[4 + size :]
    for bit in (8, 16):
        if flags & bit:
            start = data.obj.find(b"\0", start) + 1
    inflate = zlib.decompressobj(-15)
    text, rest = b"", data[start:end] if end else data[start:]
    while (cut := text.find(b"\r\n\r\n")) < 0 and not inflate.eof:
        more = inflate.decompress(rest, 4096)
        if not more and not inflate.unconsumed_tail:
            raise ValueError("a record's headers don't end")
        text, rest = text + more, inflate.unconsumed_tail
    if cut < 0:
        raise ValueError("a record without headers")
    headers = parse_headers(text[:cut])
    if not wanted(headers):
        if end is None:
            while not inflate.eof:
                if not inflate.decompress(rest, 1 << 20) and not inflate.unconsumed_tail:
                    raise ValueError("the archive ends within a record")
                rest = inflate.unconsumed_tail
            end = len(data) - len(inflate.unused_data) + 8
        return end, headers, None
    body = text[cut + 4 :] + (inflate.decompress(rest) if not inflate.eof else b"")
    if not inflate.eof:
        raise ValueError("the archive ends within a record")
    tail = (end or len(data)) - len(inflate.unused_data)
    check, size = struct.unpack_from("<II", data, tail)
    whole = text[: cut + 4] + body
    if check != zlib.crc32(whole) or size != len(whole) & 0xFFFFFFFF:
        raise ValueError("bad checksum of a record")
    return tail + 8, headers, body[: int(headers.get("content-length", len(body)))]


def read_plain(data: memoryview, at: int, wanted) -> tuple[int, dict[str, str], bytes | None]:
    """The same for a record of an archive that isn't compressed: the payload is passed over by its length."""
    cut = data.obj.find(b"\r\n\r\n", at)
    if cut < 0:
        raise ValueError("a record's headers don't end")
    headers = parse_headers(bytes(data[at:cut]))
    n = int(headers["content-length"])
    if not wanted(headers):
        return cut + 4 + n + 4, headers, None
    if cut + 4 + n > len(data):
        raise ValueError("the archive ends within a record")
    return cut + 4 + n + 4, headers, bytes(data[cut + 4 : cut + 4 + n])


def records(f, size: int, one, wanted, window: int = 1 << 20, least: int = 1 << 16) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Headers and payloads of an open archive. Memory holds a window of the file, or the largest wanted record; what is skipped isn't read.

    The window is filled again when fewer than ``least`` bytes are left in it, or when a record goes beyond it.
    """
    base, data, at, need = 0, b"", 0, least
    while at < size:
        if at > base + len(data):
            base, data = at, b""
        have = base + len(data) - at
        if have < min(need, size - at):
            data, base = data[at - base :], at
            f.seek(base + have)
            data += f.read(min(max(window, need - have), size - base - have))
        try:
            end, headers, payload = one(memoryview(data), at - base, wanted)
        except (ValueError, struct.error, IndexError):
            if base + len(data) >= size:
                raise
            need = 2 * (base + len(data) - at)
            continue
        at, need = base + end, least
        yield headers, payload


@dataclass
class FilePart(InputPartition):
    """Some whole archive files; small files share a partition."""

    paths: tuple[str, ...]


@dataclass
class Written(WriterCommitMessage):
    files: tuple[tuple[str, int], ...]


def _manifests(fs: pafs.FileSystem, root: str) -> list[str]:
    """The manifests of a folder, one of each write that was committed."""
    found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    return sorted(i.path for i in found if i.type == pafs.FileType.File and i.base_name.startswith(MANIFEST))


def _listed(fs: pafs.FileSystem, root: str, manifests: list[str]) -> dict[str, int]:
    found = {}
    for m in manifests:
        with fs.open_input_stream(m) as f:
            found |= {f"{root}/{n}": int(s) for s, n in (x.split(" ", 1) for x in f.read().decode().splitlines())}
    return found


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema) -> None:
        self.path, self.names = options["path"], [f.name for f in schema.fields]
        self.tests: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality and membership tests of record type and other headers are applied to headers alone."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute[0] in HEADERS:
                self.tests.append((f.attribute[0], frozenset([f.value])))
            elif isinstance(f, In) and f.attribute[0] in HEADERS:
                self.tests.append((f.attribute[0], frozenset(f.value)))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        fs, root = _fs(self.path)
        manifests = _manifests(fs, root)
        if manifests:  # the writer's archives: what its writes committed, and nothing of failed tasks
            listed = _listed(fs, root, manifests)
        else:
            listed = {i.path: i.size for i in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if i.type == pafs.FileType.File}
        parts, held, size = [], [], 0
        for p, n in sorted(listed.items()):
            if not p.endswith((".warc", ".warc.gz")):
                continue
            if held and size + n > SPLIT:
                parts.append(FilePart(tuple(held)))
                held, size = [], 0
            held.append(p)
            size += n
        return [*parts, FilePart(tuple(held))]

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        fs, _ = _fs(self.path)

        def wanted(headers: dict[str, str]) -> bool:
            return all(headers.get(HEADERS[c]) in values for c, values in self.tests)

        kinds = {"content_length": pa.int64(), "payload": pa.binary()}
        held, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in held], kinds.get(n, pa.string())) for n in self.names], names=self.names)

        for path in partition.paths:
            one = read_member if path.endswith(".gz") else read_plain
            with fs.open_input_file(path) as f:
                for headers, payload in records(f, f.size(), one, wanted if "payload" in self.names else lambda h: False):
                    if not wanted(headers):
                        continue
                    row = {c: headers.get(h) for c, h in HEADERS.items()}
                    held.append(row | {"content_length": int(headers.get("content-length", 0)), "payload": payload})
                    size += len(payload or b"") + 200
                    if size > 4 << 20:
                        yield batch()
                        held, size = [], 0
        if held:
            yield batch()


class WarcWriter(DataSourceArrowWriter):
    """Each task attempt writes files of its own names; a commit lists those of the attempts that count in a manifest of its own.

    An append adds a manifest beside the earlier ones; an overwrite removes those, and then the files they list.
    """

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite, self.roll = options["path"], overwrite, int(options.get("roll", ROLL))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = _fs(self.path)
        fs.create_dir(root, recursive=True)
        files: list[tuple[str, int]] = []
        out, name = None, ""
        try:
            for batch in iterator:
                names = batch.schema.names
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    r = dict(zip(names, row, strict=True))
                    headers = {h: r[c].replace("\r", " ").replace("\n", " ") for c, h in WRITTEN_AS.items() if r.get(c)}
                    if out is None:
                        name = f"part-{uuid.uuid4().hex}.warc.gz"
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(record(headers, r.get("payload") or b""))
                    if out.tell() >= self.roll:
                        files.append((name, out.tell()))
                        out.close()
                        out = None
            if out is not None:
                files.append((name, out.tell()))
        finally:
            if out is not None:
                out.close()
        return Written(tuple(files))

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _fs(self.path)
        fs.create_dir(root, recursive=True)
        before = _manifests(fs, root) if self.overwrite else []
        with fs.open_output_stream(f"{root}/{MANIFEST}-{uuid.uuid4().hex}", compression=None) as out:
            out.write("".join(f"{size} {name}\n" for m in messages if m for name, size in m.files).encode())
        gone = _listed(fs, root, before)
        for path in [*before, *gone]:
            fs.delete_file(path)

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = _fs(self.path)
        for m in messages:
            for name, _ in m.files if m else ():
                fs.delete_file(f"{root}/{name}")


class WarcSource(DataSource):
    """``spark.read.format("scanfold_warc").load(path)``: a row per record of the ``.warc`` and ``.warc.gz`` files of a folder.

    Headers are parsed first. Tests of record type and headers are pushed down, and a payload is decoded only for
    rows that pass them and only if the read schema has ``payload``. A damaged record raises.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options), schema)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def archive(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100, most: int = 300_000, salts: int = 16) -> None:
    """Write a record for each page to ``path``, beside what is there.

    Of payloads of at least ``least`` bytes that occur more than once, the page with the smallest id is the
    response and the others revisits of it; a revisit stores the full payload's digest and length, not its bytes
    again. Digests are aggregated without payloads, and only repeating ones are kept. While those are ``most`` at
    most (some 40 MB), they are broadcast, so no payload is shuffled; beyond that they are joined by shuffle, salted,
    so that a payload that many pages share burdens no task. Null and empty payloads, repeated rows and very long
    texts are records like others; ids that repeat get record ids of their own, but for a response that revisits name.
    """
    payload = F.coalesce(F.encode(F.col(html_col).cast("string"), "UTF-8"), F.lit(b""))
    url = F.col(url_col).cast("string") if url_col in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), url.alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    many = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    many = common.written(many.select("digest", "first"), "repeats")
    if many.limit(most + 1).count() <= most:
        joined = rows.join(F.broadcast(many), "digest", "left")
    else:
        salted = many.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).join(salted, ["digest", "salt"], "left")
    revisit = F.col("first").isNotNull() & F.col("id").isNotNull() & (F.col("id") != F.col("first"))
    named = F.col("first").isNotNull() & (F.col("id") == F.col("first"))
    own = F.when(named, F.lit("")).otherwise(F.concat(F.lit(":"), F.monotonically_increasing_id()))
    out = joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.concat(F.lit("<urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("")), own, F.lit(">")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("warc_date"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        F.when(revisit, F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">"))).alias("refers_to"),
        F.when(revisit, IDENTICAL).alias("profile"),
        F.lit("text/html").alias("content_type"),
        F.octet_length("payload").cast("string").alias("payload_length"),
        F.lit(None).cast("long").alias("content_length"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )
    pages.sparkSession.dataSource.register(WarcSource)
    out.write.format(FORMAT).mode("append").save(path)
    common.dropped(many)


def read_archive(spark, path: str) -> DataFrame:
    """All records of a folder of archives. Pushing filters into Python sources is off by default; it is switched on for the session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format(FORMAT).load(path)


def pages_through_archive(pages: DataFrame, *, id_col: str = "page_id", least: int = 100) -> DataFrame:
    """Write pages to a new archive in the shared folder and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Lengths and digests of responses are those of the payloads read back; revisits tell those of the full payload.
    A null or empty html is an empty payload; repeated rows are records of their own, and rows that share the
    smallest id are all responses; a row without an id is a response with a null page_id; an empty table gives no rows.
    """
    path = common.new_path(pages.sparkSession, "warc")
    archive(pages, path, id_col=id_col, least=least)
    r = read_archive(pages.sparkSession, path)
    page = lambda c: F.regexp_extract(c, r"page:(-?\d+)[:>]", 1).try_cast("long")
    full = F.col("record_type") == "revisit"
    return r.select(
        page(F.col("record_id")).alias("page_id"), F.when(full, F.col("payload_length").cast("long")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(full, F.substring_index("payload_digest", ":", -1)).otherwise(F.sha2("payload", 256)).alias("payload_digest"), "record_type", page(F.col("refers_to")).alias("refers_to"),
    )


"""Every document wrapped in a container of each kind, typed and unpacked again: digests of what the decoders give back."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import members, writers
from . import scan
from .queries import ORACLES, QUERIES, t


#: Bytes of containers after which a batch of them is given away.
BATCH = 2 << 20


def _batch(ids: list[int], made: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(made, pa.binary())], names=["object_id", "content"])


def wrapped(objects: DataFrame, kind: str) -> DataFrame:
    """(object_id, content): each text as the only member, named after its id, of a container."""
    write = writers.WRITERS[kind][1] if kind in writers.WRITERS else getattr(writers, kind)
    rows = objects.select(F.col("doc_id").cast("long").alias("object_id"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, made, size = [], [], 0
            for own, body in zip(batch.column("object_id").to_pylist(), batch.column("content"), strict=True):
                ids.append(own)
                made.append(write(f"d{own}.txt", body.as_py()))
                size += len(made[-1])
                if size > BATCH:
                    yield _batch(ids, made)
                    ids, made, size = [], [], 0
            if ids:
                yield _batch(ids, made)

    return rows.mapInArrow(run, "object_id long, content binary")


def _register(kind: str, type_: str, named: bool) -> None:
    def run(s, d):
        typed = scan.typed(wrapped(t(s, d, "documents"), kind)).where(F.col("type") == type_)
        kids = members.children(typed, passwords=(b"wrong", b"infected"))
        columns = [F.col("parent_id").alias("doc_id"), F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("size"), "alert"]
        return kids.select(*columns, *(["fname"] if named else []))

    name = ", 'd' || doc_id || '.txt' AS fname" if named else ""
    QUERIES[f"members_{kind}"] = run
    ORACLES[f"members_{kind}"] = f"SELECT doc_id, sha256(coalesce(text, '')) AS sha256, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size, CAST(NULL AS VARCHAR) AS alert{name} FROM documents"


for _kind, (_type, _, _named) in writers.WRITERS.items():
    _register(_kind, _type, _named)


def members_macros(s, d):
    """Sources of macro modules, beside the streams that hold them."""
    kids = members.children(scan.typed(wrapped(t(s, d, "documents"), "macro_document")))
    return kids.where("fname like '%.vba'").select(F.col("parent_id").alias("doc_id"), "fname", F.sha2("content", 256).alias("sha256"))


def members_disk_image(s, d):
    """The partition of a disk image: the text, zeros up to whole sectors and a sector of zeros."""
    kids = members.children(scan.typed(wrapped(t(s, d, "documents"), "dmg")).where("type = 'DMG'"))
    size = F.regexp_extract(F.hex("content"), "^((?:..)*?)(?:00)*$", 1)
    return kids.select(F.col("parent_id").alias("doc_id"), "fname", (F.length(size) / 2).cast("long").alias("size"), F.sha2(F.unhex(size), 256).alias("sha256"))


def members_partition(s, d):
    """The partition of a boot record."""
    kids = members.children(scan.typed(wrapped(t(s, d, "documents"), "partitioned")).where("type = 'MBR'"))
    size = F.conv(F.concat(*(F.hex(F.substring("content", k, 1)) for k in range(8, 0, -1))), 16, 10).cast("int")
    return kids.select(F.col("parent_id").alias("doc_id"), "fname", F.sha2(F.substring(F.col("content"), F.lit(9), size), 256).alias("sha256"))


def nested_scan(s, d):
    """Texts in gzip in tar in zip: the whole scan finds a body four levels down, and a container rule the member's name."""
    from ..operators.logic import Logical
    from ..sources import signatures as sigs

    x = t(s, d, "documents")
    inner = wrapped(x, "gzip")
    middle = wrapped(inner.select(F.col("object_id").alias("doc_id"), F.col("content").alias("text")), "tar")
    outer = wrapped(middle.select(F.col("object_id").alias("doc_id"), F.col("content").alias("text")), "zip")
    lines = s.createDataFrame([("Odd.Member:POSIX_TAR:*:^d[0-9]*[13579]\\.txt$:*:*:*:*:*:*",)], "value string")
    rules = scan.Signatures(bodies=[("Deep.Password", 0, "*", "70617373776f7264")], logical=[Logical.parse("Deep.The;Target:0,Container:GZ;0;746865")], containers=sigs.parse(lines, "cdb"))
    nested = scan.tree(outer, scan.ScanConfig(normalize=False))
    found = scan.indicators(nested, rules, scan.ScanConfig(normalize=False))
    return found.select(F.col("root_id").alias("doc_id"), "name", F.size("seq.place").alias("depth"))


QUERIES |= {f.__name__: f for f in (members_macros, members_disk_image, members_partition, nested_scan)}
ORACLES |= {
    "members_macros": "SELECT doc_id, 'd' || doc_id || '.txt.vba' AS fname, sha256(coalesce(text, '')) AS sha256 FROM documents",
    "members_disk_image": "SELECT doc_id, 'd' || doc_id || '.txt' AS fname, CAST(strlen(rtrim(text, chr(0))) AS BIGINT) AS size, sha256(rtrim(text, chr(0))) AS sha256 FROM documents",
    "members_partition": "SELECT doc_id, 'partition1' AS fname, sha256(coalesce(text, '')) AS sha256 FROM documents",
    "nested_scan": """
SELECT doc_id, 'Deep.Password' AS name, 3 AS depth FROM documents WHERE contains(text, 'password') UNION ALL SELECT doc_id, 'Deep.The', 3 FROM documents WHERE contains(text, 'the')
UNION ALL SELECT doc_id, 'Odd.Member', 2 FROM documents WHERE doc_id % 2 = 1""",
}

"""Signature files as typed tables: one schema per kind, malformed lines refused or set apart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx

LEVEL = 240
#: Tables whose names carry a mark of their own: unofficial, unwanted-application and the like share a layout.
KINDS = {
    "db": "plain", "ndb": "body", "ndu": "body", "sdb": "body", "ldb": "logical", "ldu": "logical", "hdb": "hash", "hsb": "hash", "hdu": "hash", "hsu": "hash", "fp": "hash", "sfp": "hash",
    "mdb": "section", "msb": "section", "mdu": "section", "msu": "section", "imp": "import", "cdb": "container", "zmd": "archive", "rmd": "archive", "ftm": "magic", "ign": "ignore", "ign2": "ignore",
    "pdb": "protect", "gdb": "protect", "wdb": "allow", "idb": "icon", "crb": "certificate", "cat": "catalog", "info": "info", "pwdb": "password", "yar": "rule", "yara": "rule", "ioc": "indicator", "cfg": "config",
}
PURPOSE = {"fp": "trust", "sfp": "trust"}


class Layout:
    """How a kind's lines become columns."""

    def __init__(self, mark: str, least: int, most: int, columns: Callable[[Column], dict[str, Column]], valid: Callable[[Column], Column] | None = None):
        self.mark, self.least, self.most, self.columns, self.valid = mark, least, most, columns, valid


def _get(p: Column, k: int) -> Column:
    x = F.get(p, F.lit(k))
    return F.when(x != "", x)


def _int(p: Column, k: int) -> Column:
    return _get(p, k).try_cast("int")


def _levels(p: Column, k: int) -> dict[str, Column]:
    return {"min_fl": _int(p, k), "max_fl": _int(p, k + 1)}


def _range(x: Column) -> tuple[Column, Column]:
    """``a-b``, ``a`` or ``*`` as low and high. Of different ends a zero second one is open."""
    lo = F.regexp_extract(x, r"\A(\d+)", 1).try_cast("long")
    hi = F.coalesce(F.regexp_extract(x, r"\A\d+-(\d+)\z", 1).try_cast("long"), lo)
    return lo, F.when((hi == 0) & (lo > 0), F.lit(2**62)).otherwise(hi)


def _hash(p: Column, digest: int, size: int) -> dict[str, Column]:
    d = F.lower(F.get(p, F.lit(digest)))
    algorithm = F.when(F.length(d) == 32, "md5").when(F.length(d) == 40, "sha1").when(F.length(d) == 64, "sha256")
    return {"algo": algorithm, "digest": d, "size": F.get(p, F.lit(size)).try_cast("long"), "name": F.get(p, F.lit(2)), **_levels(p, 3)}


def _hash_ok(p: Column, digest: int = 0, size: int = 1, wild_level: int = 73) -> Column:
    s = F.get(p, F.lit(size))
    return F.get(p, F.lit(digest)).rlike(r"\A(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64})\z") & (s.rlike(r"\A\d+\z") | ((s == "*") & (F.coalesce(_int(p, 3), F.lit(0)) >= wild_level)))


def _container(p: Column) -> dict[str, Column]:
    out = {"name": F.get(p, F.lit(0)), "ctype": F.when(_get(p, 1) != "*", _get(p, 1))}
    for k, c in ((2, "csize"), (4, "fsizec"), (5, "fsizer"), (7, "filepos"), (8, "res1")):
        out[f"{c}_lo"], out[f"{c}_hi"] = _range(F.get(p, F.lit(k)))
    return out | {"name_re": F.when(_get(p, 3) != "*", _get(p, 3)), "encrypted": F.when(_get(p, 6) == "1", True).when(_get(p, 6) == "0", False), **_levels(p, 10)}


LAYOUTS = {
    "plain": Layout("=", 2, 2, lambda p: {"name": F.get(p, F.lit(0)), "target": F.lit(0), "off": F.lit("*"), "hex": F.get(p, F.lit(1))}),
    "body": Layout(":", 4, 6, lambda p: {"name": F.get(p, F.lit(0)), "target": _int(p, 1), "off": _get(p, 2), "hex": F.get(p, F.lit(3)), **_levels(p, 4)}, lambda p: F.get(p, F.lit(1)).rlike(r"\A(?:\d+|\*)\z")),
    "hash": Layout(":", 3, 5, lambda p: _hash(p, 0, 1), _hash_ok),
    "section": Layout(":", 3, 5, lambda p: _hash(p, 1, 0), lambda p: _hash_ok(p, 1, 0)),
    "import": Layout(":", 3, 5, lambda p: _hash(p, 0, 1), lambda p: _hash_ok(p, 0, 1, 0)),
    "container": Layout(":", 10, 12, _container),
    "archive": Layout(":", 9, 11, lambda p: {"name": F.get(p, F.lit(0)), "encrypted": _get(p, 1) == "1", "name_re": F.when(_get(p, 2) != "*", _get(p, 2)), "fsizer": _int(p, 3), "fsizec": _int(p, 4), "crc32": _get(p, 5), "method": _get(p, 6), "filepos": _int(p, 7), "depth": _int(p, 8), **_levels(p, 9)}),
    "magic": Layout(":", 6, 8, lambda p: {"mode": _int(p, 0), "off": F.when(_get(p, 1) == "*", None).otherwise(_int(p, 1)), "magic": F.unhex(F.when(F.get(p, F.lit(0)).isin("0", "4"), F.get(p, F.lit(2)))), "hex": F.get(p, F.lit(2)), "descr": F.get(p, F.lit(3)), "rtype": F.get(p, F.lit(4)), "type": F.get(p, F.lit(5)), **_levels(p, 6)}),
    "ignore": Layout(":", 1, 3, lambda p: {"name": F.when(F.size(p) == 3, F.get(p, F.lit(2))).otherwise(F.get(p, F.lit(0))), "entry_md5": F.when(F.size(p) == 2, F.lower(F.get(p, F.lit(1))))}),
    "protect": Layout(":", 2, 5, lambda p: {"kind": F.get(p, F.lit(0)), "pattern": F.when(F.get(p, F.lit(0)) == "S", F.get(p, F.lit(2))).otherwise(F.get(p, F.lit(1))), "display": F.when(F.get(p, F.lit(0)) != "S", _get(p, 2)), "is_prefix": F.get(p, F.lit(1)) == "P"}, lambda p: F.get(p, F.lit(0)).isin("R", "H", "S")),
    "allow": Layout(":", 2, 5, lambda p: {"kind": F.get(p, F.lit(0)), "pattern": F.when(F.get(p, F.lit(0)) == "S", F.get(p, F.lit(2))).otherwise(F.get(p, F.lit(1))), "display": _get(p, 2)}, lambda p: F.get(p, F.lit(0)).isin("X", "Y", "M") | ((F.get(p, F.lit(0)) == "S") & (F.get(p, F.lit(1)) == "W"))),
    "icon": Layout(":", 4, 4, lambda p: {"name": F.get(p, F.lit(0)), "group1": F.get(p, F.lit(1)), "group2": F.get(p, F.lit(2)), "metrics": F.get(p, F.lit(3))}),
    "certificate": Layout(";", 8, 12, lambda p: {"name": F.get(p, F.lit(0)), "trusted": F.get(p, F.lit(1)) == "1", "subject": F.get(p, F.lit(2)), "serial": F.get(p, F.lit(3)), "pubkey": F.get(p, F.lit(4)), "exponent": F.get(p, F.lit(5)), "code_sign": F.get(p, F.lit(6)), "time_sign": F.get(p, F.lit(7))}),
    "info": Layout(":", 3, 3, lambda p: {"name": F.get(p, F.lit(0)), "size": F.get(p, F.lit(1)).try_cast("long"), "digest": F.get(p, F.lit(2))}),
    "password": Layout(";", 4, 6, lambda p: {"name": F.get(p, F.lit(0)), "tdb": F.get(p, F.lit(1)), "pwtype": _int(p, 2), "password": F.get(p, F.lit(3))}),
    "logical": Layout(";", 4, 67, lambda p: {"name": F.get(p, F.lit(0)), "tdb": F.str_to_map(F.get(p, F.lit(1)), F.lit(","), F.lit(":")), "logic": F.get(p, F.lit(2)), "subs": F.slice(p, F.lit(4), F.size(p)), **{k: F.regexp_extract(F.get(p, F.lit(1)), r"Engine:(\d+)-?(\d*)", g).try_cast("int") for k, g in (("min_fl", 1), ("max_fl", 2))}}, lambda p: F.get(p, F.lit(1)).rlike(r"(?:\A|,)Target:\d+")),
}


def parse(lines: DataFrame, kind: str, *, value_col: str = "value", on_error: str = "fail") -> DataFrame:
    """Lines of a signature table as its columns, with the line itself as ``entry``.

    A malformed line fails the query, as a whole table is refused; with ``on_error="quarantine"`` it stays, with a
    true ``malformed``. Empty lines and remarks are passed over.
    """
    layout = LAYOUTS[KINDS.get(kind, kind)]
    line = F.regexp_replace(F.col(value_col), r"[\r\n]+\z", "")
    rest = [c for c in lines.columns if c != value_col]
    rows = lines.select(*rest, line.alias("entry")).where(~F.col("entry").rlike(r"\A(?:#.*)?\z"))
    # the mark may stand in /pattern/ fields of logical signatures
    mark = r"(?<!\\);(?=(?:[^/]*/[^/]*/)*[^/]*\z)" if layout is LAYOUTS["logical"] else f"\\Q{layout.mark}\\E"
    rows = rows.withColumn("p", F.split("entry", mark, -1))
    ok = F.size("p").between(layout.least, layout.most)
    if layout.valid:
        ok = ok & F.coalesce(layout.valid(F.col("p")), F.lit(False))
    columns = layout.columns(F.col("p"))
    out = rows.select(*rest, "entry", (~ok).alias("malformed"), *(x.alias(c) for c, x in columns.items()))
    if on_error == "quarantine":
        return out
    return out.where(F.when(F.col("malformed"), F.raise_error(F.concat(F.lit(f"malformed {kind} line: "), F.col("entry"))).cast("boolean")).otherwise(True)).drop("malformed")


def load(spark: SparkSession, path: str, kind: str | None = None, **options: str) -> DataFrame:
    """A signature file or folder; gzip files are read as well. The kind comes from the name unless it is given."""
    kind = kind or path.removesuffix(".gz").rsplit(".", 1)[-1]
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"))
    return parse(lines, kind, **options)


def load_folder(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a folder by kind. Of two snapshots of the daily table only the newer is read; see :func:`load_order`."""
    names = [r["file"] for r in spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_name").alias("file")).collect()]
    found: dict[str, DataFrame] = {}
    for name in sorted(names):
        kind = KINDS.get(name.rsplit(".", 1)[-1])
        if kind in LAYOUTS:
            table = load(spark, f"{path}/{name}", name.rsplit(".", 1)[-1]).withColumn("purpose", F.lit(PURPOSE.get(name.rsplit(".", 1)[-1], "detect")))
            found[kind] = found[kind].unionByName(table, allowMissingColumns=True) if kind in found else table
    return found


def load_order(files: DataFrame) -> DataFrame:
    """Files (file, version) with the priority they load in, and which are left out: of the two daily snapshots the older, or the compressed one of equal version."""
    name = F.col("file")
    rank = (
        F.when(name.rlike(r"\.ign2?\z"), 0).when(name == "daily.cld", 1).when(name == "daily.cvd", 2).when(name == "local.gdb", 3)
        .when(name == "daily.cfg", 4).when(name.endswith(".crb"), 5).otherwise(6)
    )
    daily = name.isin("daily.cld", "daily.cvd")
    newest = F.max(F.when(daily, F.struct("version", name == "daily.cld"))).over(Window.partitionBy(F.when(daily, F.lit("")).otherwise(name)))
    loads = ~daily | (F.struct(F.col("version"), (name == "daily.cld")) == newest)
    return files.select("file", "version", rank.alias("priority"), loads.alias("loads"))


def active(signatures: DataFrame, level: int = LEVEL) -> DataFrame:
    """Signatures whose levels admit this engine's."""
    return signatures.where((F.coalesce("min_fl", F.lit(0)) <= level) & (F.coalesce("max_fl", F.lit(2**31 - 1)) >= level))


def without_ignored(signatures: DataFrame, ignored: DataFrame) -> DataFrame:
    """Signatures that no ignore entry names; an entry with a digest only drops the line it was made of."""
    norm = tx.signature_norm("name")
    s = signatures.withColumn("_norm", norm).withColumn("_md5", F.md5(F.col("entry").cast("binary")))
    i = ignored.select(tx.signature_norm("name").alias("_norm"), F.col("entry_md5").alias("_entry"))
    s = s.join(i.where("_entry is null").select("_norm"), "_norm", "left_anti")
    return s.join(i.where("_entry is not null").select("_norm", F.col("_entry").alias("_md5")), ["_norm", "_md5"], "left_anti").drop("_norm", "_md5")


def category(name: Column | str) -> Column:
    """The category of an unwanted-application signature's name, else null."""
    n = F.col(name) if isinstance(name, str) else name
    return F.when(n.startswith("PUA."), F.get(F.split(n, r"\."), F.lit(1)))


def unwanted(signatures: DataFrame, *, detect: bool = True, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Unwanted-application signatures stay if they are asked for, and their category is included or not excluded."""
    c = category("name")
    keep = F.lit(detect)
    if include is not None:
        keep = keep & c.isin(*include)
    if exclude is not None:
        keep = keep & ~c.isin(*exclude)
    return signatures.where(c.isNull() | keep)


def counted(tables: dict[str, DataFrame], official: set[str] | None = None) -> DataFrame:
    """(kind, official, n) of loaded tables."""
    parts = [t.select(F.lit(k).alias("kind"), F.lit(k in (official or set())).alias("official")) for k, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("kind", "official").agg(F.count("*").alias("n"))


def find(signatures: DataFrame, pattern: str) -> DataFrame:
    """Signatures whose names match a regular expression."""
    return signatures.where(F.col("name").rlike(pattern))


def hash_lines(objects: DataFrame, *, algorithm: str = "md5", content: str = "content", name: str = "name") -> DataFrame:
    """Hash signatures of objects as lines."""
    return objects.select(F.concat_ws(":", tx.digest(content, algorithm), F.octet_length(F.col(content).cast("binary")), name).alias("line"))


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """(file, modified, size) of a folder of tables."""
    return spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_name").alias("file"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files that are new, gone or different between two snapshots."""
    a, b = before.alias("a"), after.alias("b")
    how = F.when(F.col("a.file").isNull(), "added").when(F.col("b.file").isNull(), "removed").when((F.col("a.modified") != F.col("b.modified")) | (F.col("a.size") != F.col("b.size")), "changed")
    return a.join(b, F.col("a.file") == F.col("b.file"), "full").select(F.coalesce("a.file", "b.file").alias("file"), how.alias("change")).where("change is not null")


def archive_header(content: Column | str) -> Column:
    """The 512-byte head of a signature archive as a struct; null unless it has the mark and its nine fields."""
    head = F.decode(F.substring(F.col(content) if isinstance(content, str) else content, 1, 512), "ISO-8859-1")
    p = F.split(F.rtrim(head), ":", -1)
    at = lambda k: F.get(p, F.lit(k))
    fields = F.struct(
        at(1).alias("built"), at(2).try_cast("int").alias("version"), at(3).try_cast("int").alias("signatures"), at(4).try_cast("int").alias("level"), at(5).alias("md5"), at(6).alias("signed"), at(7).alias("builder"),
        F.timestamp_seconds(at(8).try_cast("long")).alias("time"),
    )
    return F.when((F.size(p) >= 8) & at(0).rlike(r"-VDB\z"), fields)


def module_switches(lines: DataFrame, level: int = LEVEL) -> DataFrame:
    """(module, mask): on and off bits of scan modules from lines ``NAME:0xMASK:MinFL:MaxFL`` that admit this engine's level."""
    p = F.split(F.col("value"), ":", -1)
    at = lambda k: F.get(p, F.lit(k))
    ok = (F.coalesce(at(2).try_cast("int"), F.lit(0)) <= level) & (F.coalesce(at(3).try_cast("int"), F.lit(2**31 - 1)) >= level)
    return lines.where(ok & at(1).rlike(r"\A0x[0-9A-Fa-f]{1,8}\z")).select(at(0).alias("module"), F.conv(F.substring(at(1), 3, 8), 16, 10).cast("long").alias("mask"))

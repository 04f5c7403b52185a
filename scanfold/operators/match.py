"""Matches of objects with signature tables: digests, container metadata, magics, image hashes, bodies."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import raw
from ..functions import text as tx
from . import automaton, patterns
from .logic import Logical

#: A signature table is broadcast only while it has so many rows and bytes; a larger one is joined by shuffle.
SMALL, SMALL_BYTES = 200_000, 32 << 20


def small(table: DataFrame, limit: int = SMALL, most: int = SMALL_BYTES) -> DataFrame:
    """``table`` with a hint to broadcast it, if it has ``limit`` rows and ``most`` bytes at most; strings and binaries are counted by length."""
    wide = [F.octet_length(c) for c, kind in table.dtypes if kind in ("string", "binary")]
    width = sum((F.coalesce(w, F.lit(0)) for w in wide), F.lit(16 * len(table.columns))).cast("long")
    n, size = table.limit(limit + 1).agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(table) if n <= limit and size <= most else table


def hash_matches(objects: DataFrame, signatures: DataFrame, *, id_col: str = "object_id", content: str = "content") -> DataFrame:
    """(object, algo, name): whole digests, with their size or any size.

    Two joins, since an or of the two conditions would compare every object with every signature. Only the kinds of
    digest that the table has are computed, each once for both joins.
    """
    kinds = [r[0] for r in signatures.select("algo").distinct().collect()]
    size = F.octet_length(F.col(content).cast("binary")).cast("long")
    base = objects.select(F.col(id_col), size.alias("size"), F.explode(F.array(*(F.struct(F.lit(a).alias("algo"), tx.digest(content, a).alias("digest")) for a in kinds)) if kinds else F.array().cast("array<struct<algo:string,digest:string>>")).alias("d")).select(id_col, "size", "d.*")
    sized = base.join(small(signatures.where("size is not null").select("algo", "digest", "size", "name")), ["algo", "digest", "size"])
    wild = base.join(small(signatures.where("size is null").select("algo", "digest", "name")), ["algo", "digest"])
    return sized.select(id_col, "algo", "name").unionByName(wild.select(id_col, "algo", "name"))


def trusted(objects: DataFrame, trust: DataFrame, **names: str) -> DataFrame:
    """Ids of the objects whose digest a trust table has."""
    return hash_matches(objects, trust, **names).select(names.get("id_col", "object_id")).distinct()


def section_matches(objects: DataFrame, signatures: DataFrame, *, id_col: str = "object_id", content: str = "content", exe: str = "exe") -> DataFrame:
    """(object, section, name): digests of the sections of executables, by their raw size."""
    s = F.col("s")
    body = raw.window(content, s["raw"].cast("int"), s["rsz"].cast("int"))
    rows = objects.select(id_col, content, F.posexplode(F.col(f"{exe}.sections")).alias("section", "s")).select(id_col, "section", s["rsz"].alias("size"), *(tx.digest(body, a).alias(a) for a in ("md5", "sha1", "sha256")))
    each = rows.select(id_col, "section", "size", F.explode(F.create_map(*(x for a in ("md5", "sha1", "sha256") for x in (F.lit(a), F.col(a))))).alias("algo", "digest"))
    return each.join(small(signatures.select("algo", "digest", "size", "name")), ["algo", "digest", "size"]).select(id_col, "section", "name")


def container_matches(members: DataFrame, rules: DataFrame, *, id_col: str = "object_id") -> DataFrame:
    """(object, name): members of containers under metadata rules. All given fields must hold; a name rule fails a member without a name.

    Rules that name a container's type are joined on it; those for any type are put to each type that the members have, so both
    are equi-joins, broadcast while small. What holds no range is any.
    """
    kinds = members.select(F.col("container_type").alias("kind")).distinct()
    every = rules.where("ctype is null").crossJoin(kinds) if kinds.limit(1001).count() <= 1000 else None
    if every is None:
        raise ValueError("more than 1000 types of containers")
    rules = rules.where("ctype is not null").withColumn("kind", F.col("ctype")).unionByName(every.select(*rules.columns, "kind"))
    m, r = members.alias("m"), small(rules).alias("r")
    ok = F.col("r.kind").eqNullSafe(F.col("m.container_type"))
    for c in ("csize", "fsizec", "fsizer", "filepos", "res1"):
        if c in members.columns and f"{c}_lo" in rules.columns:
            ok = ok & (F.col(f"r.{c}_lo").isNull() | F.col(f"m.{c}").between(F.col(f"r.{c}_lo"), F.col(f"r.{c}_hi")))
    ok = ok & (F.col("r.encrypted").isNull() | (F.col("r.encrypted") == F.col("m.encrypted")))
    ok = ok & (F.col("r.name_re").isNull() | F.coalesce(F.expr("m.fname rlike r.name_re"), F.lit(False)))
    return m.join(r, ok).select(F.col(f"m.{id_col}"), F.col("r.name"))


def magic_type(content: Column, magics: Iterable[tuple[int, bytes, str]], otherwise: Column | None = None) -> Column:
    """The type of the last of ``magics`` (offset, bytes, type) that the content has, as later entries go before earlier; else the text type."""
    entries = list(reversed(list(magics)))

    def told(c: Column) -> Column:
        out = None
        for offset, magic, name in entries:
            here = F.substring(c, offset + 1, len(magic)) == F.lit(bytearray(magic))
            out = F.when(here, name) if out is None else out.when(here, name)
        other = tx.text_type(c) if otherwise is None else otherwise
        return other if out is None else out.otherwise(other)

    return raw.once(content, told)


def magic_matches(objects: DataFrame, magics: DataFrame, *, id_col: str = "object_id", content: str = "content") -> DataFrame:
    """(object, type) from a table of magics (seq, off, magic, type): an equi-join for each place and length; the latest entry wins."""
    places = [(r[0], r[1]) for r in magics.select("off", F.octet_length("magic")).distinct().collect()]
    none = magics.sparkSession.createDataFrame([], "seq long, type string")
    found = objects.limit(0).select(id_col).crossJoin(none)
    for off, n in places:
        here = magics.where((F.col("off") == off) & (F.octet_length("magic") == n)).select("seq", "magic", "type")
        one = objects.select(id_col, F.substring(content, off + 1, n).alias("magic")).join(small(here), "magic").select(id_col, F.col("seq").cast("long"), "type")
        found = found.unionByName(one)
    return found.groupBy(id_col).agg(F.max_by("type", "seq").alias("type"))


def image_matches(objects: DataFrame, signatures: DataFrame, *, id_col: str = "object_id", hash_col: str = "image_hash") -> DataFrame:
    """(object, name): exact look-up of perceptual image hashes."""
    return objects.join(small(signatures.select(F.col("digest").alias(hash_col), "name")), hash_col).select(id_col, "name")


def body_matches(objects: DataFrame, signatures: list[tuple[str, str, str, str]], *, id_col: str = "object_id", content: str = "content", exe: str | None = None) -> DataFrame:
    """(object, name, offsets) for a list of signatures (name, offset, hex, options): one pass over the objects, no shuffle.

    All go through one automaton, so the cost hardly grows with their number; see :func:`automaton.matches` for a table of them.
    """
    for _, off, code, options in signatures:  # a bad one is refused here, not in a worker
        patterns.compile_hex(code, options)
        patterns.parse_offset(off)
    return automaton.over(objects, sorted(signatures), id_col=id_col, content=content, exe=exe)


def logical_matches(objects: DataFrame, signatures: list[Logical], *, id_col: str = "object_id", content: str = "content") -> DataFrame:
    """(object, name) of the logical signatures that fire and whose description admits the object.

    ``objects`` may have ``exe`` and ``ancestor_types``; without them, rules that need them don't fire.
    """
    have = set(objects.columns)
    kind = "struct<ep:bigint,nsections:int,sections:array<struct<rva:bigint,vsz:bigint,raw:bigint,rsz:bigint>>>"
    exe = F.col("exe") if "exe" in have else F.lit(None).cast(kind)
    ancestors = F.col("ancestor_types") if "ancestor_types" in have else F.array().cast("array<string>")
    obj = F.struct(F.octet_length(F.col(content).cast("binary")).cast("long").alias("size"), exe.alias("exe"), ancestors.alias("ancestor_types"))
    rows = objects.select(id_col, raw.byte_text(content).alias("_t"), obj.alias("_o"))
    fired = [F.when(s.admits(F.col("_o")) & s.fires(F.col("_t"), exe=F.col("_o.exe")), F.lit(s.name)) for s in signatures]
    return rows.select(id_col, F.explode(F.filter(F.array(*fired), lambda n: n.isNotNull())).alias("name"))


def import_matches(objects: DataFrame, signatures: DataFrame, *, id_col: str = "object_id", content: str = "content") -> DataFrame:
    """(object, name): digests of import tables of executables, by the length of their list. Only executables go to Python."""
    from ..sources.members import imports

    rows = objects.where(F.hex(F.substring(content, 1, 2)) == "4D5A").select(id_col, imports(F.col(content)).alias("list")).where("list is not null")
    each = rows.select(id_col, F.length("list").cast("long").alias("size"), F.explode(F.create_map(*(x for a in ("md5", "sha1", "sha256") for x in (F.lit(a), tx.digest("list", a))))).alias("algo", "digest"))
    wild = signatures.where("size is null").select("algo", "digest", "name")
    sized = signatures.where("size is not null").select("algo", "digest", "size", "name")
    return each.join(small(sized), ["algo", "digest", "size"]).select(id_col, "name").unionByName(each.join(small(wild), ["algo", "digest"]).select(id_col, "name"))


def handler_types(objects: DataFrame, signatures: list[Logical], *, id_col: str = "object_id", content: str = "content") -> DataFrame:
    """(object, type): what signatures with a handler make of an object instead of raising an alert; it is then scanned as that type."""
    own = [s for s in signatures if "HandlerType" in s.tdb]
    types = F.create_map(*(F.lit(x) for s in own for x in (s.name, s.tdb["HandlerType"])))
    hit = logical_matches(objects, own, id_col=id_col, content=content)
    return hit.groupBy(id_col).agg(F.min("name").alias("name")).select(id_col, F.element_at(types, F.col("name")).alias("type"))

"""Whole scans: objects and signature tables in, indicators and verdicts out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dlp, html, raw, tables, url
from ..functions import text as tx
from ..operators import match, rollup
from ..operators.logic import Logical
from ..operators.rules import Rule
from ..operators.rules import matches as rule_matches
from ..sources import archives as _archives  # noqa: F401  registers its decoders
from ..sources import members, structures
from ..sources import office as _office  # noqa: F401  registers its decoders

NORMALIZED, DECRYPTED, RETYPED, EMBEDDED = 1, 2, 4, 8
#: Object types of each target of a signature; 0 is any.
TARGETS = {1: ("MSEXE",), 2: ("MSOLE2",), 3: ("HTML", "HTML_UTF16"), 4: ("MAIL",), 5: ("GRAPHICS", "PNG", "GIF", "JPEG", "TIFF"), 6: ("ELF",), 7: ("TEXT_ASCII", "TEXT_UTF8", "SCRIPT"), 9: ("MACHO", "MACHO_UNIBIN"), 10: ("PDF",), 11: ("SWF",), 12: ("JAVA",), 13: ("INTERNAL",)}
#: Magics in load order: the last that fits wins.
MAGICS = (
    (0, b"MZ", "MSEXE"), (0, b"\x7fELF", "ELF"), (0, b"\xfe\xed\xfa\xce", "MACHO"), (0, b"\xce\xfa\xed\xfe", "MACHO"), (0, b"\xfe\xed\xfa\xcf", "MACHO"), (0, b"\xcf\xfa\xed\xfe", "MACHO"), (0, b"\xca\xfe\xba\xbe", "JAVA"),
    (0, b"PK\x03\x04", "ZIP"), (0, b"\x1f\x8b", "GZ"), (0, b"BZh", "BZ"), (0, b"\xfd7zXZ\0", "XZ"), (0, b"\x28\xb5\x2f\xfd", "ZSTD"), (0, b"Rar!\x1a\x07", "RAR"), (0, b"7z\xbc\xaf\x27\x1c", "7Z"), (0, b"MSCF", "MSCAB"), (0, b"ITSF", "MSCHM"),
    (0, b"\x60\xea", "ARJ"), (0, b"SZDD\x88\xf0\x27\x33", "MSSZDD"), (0, b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "MSOLE2"), (257, b"ustar", "POSIX_TAR"), (0, b"070707", "CPIO_ODC"), (0, b"070701", "CPIO_NEWC"), (0, b"070702", "CPIO_CRC"), (0, b"\xc7\x71", "CPIO_OLD"),
    (0, b"\x89PNG\r\n\x1a\n", "PNG"), (0, b"GIF8", "GIF"), (0, b"\xff\xd8\xff", "JPEG"), (0, b"II*\0", "TIFF"), (0, b"MM\0*", "TIFF"), (0, b"RIFF", "RIFF"), (0, b"%PDF-", "PDF"), (0, b"{\\rtf", "RTF"), (0, b"FWS", "SWF"), (0, b"CWS", "SWF"), (0, b"ZWS", "SWF"),
    (0, b"begin ", "UUENCODED"), (0, b"From ", "MAIL"), (0, b"Received: ", "MAIL"), (0, b"Return-Path: ", "MAIL"), (0, b"Message-ID: ", "MAIL"), (0, b"MIME-Version: ", "MAIL"), (0, b"\x78\x9f\x3e\x22", "TNEF"), (512, b"EFI PART", "GPT"),
    (32769, b"CD001", "ISO9660"), (32769, b"BEA01", "UDF"), (2, b"-lh", "LHA_LZH"), (0, b"ALZ\x01", "ALZ"), (0, b"EGGA", "EGG"), (0, b"xar!", "XAR"), (1024, b"H+\0\x04", "HFSPLUS"), (1024, b"HX\0\x05", "HFSPLUS"),
    (0, b"\xb6\xb9\xac\xae\xfe\xff\xff\xff", "CRYPTFF"), (0, b"\xe4\x52\x5c\x7b\x8c\xd8\xa7\x4d\xae\xb1\x53\x78\xd0\x29\x96\xd3", "ONENOTE"), (0, b"HWP Document File V3.00", "HWP3"),
)
#: Magics of what a partition or a disk image holds.
VOLUMES = ((1024, b"H+\0\x04", "HFSPLUS"), (1024, b"HX\0\x05", "HFSPLUS"), (32769, b"CD001", "ISO9660"), (32769, b"BEA01", "UDF"), (3, b"NTFS    ", "NTFS"), (54, b"FAT", "FAT"), (82, b"FAT32", "FAT"), (1080, b"\x53\xef", "EXT"))


@dataclass
class Signatures:
    """What a scan looks for. Each part may be absent."""

    hashes: DataFrame | None = None
    trust: DataFrame | None = None
    bodies: list[tuple[str, int, str, str]] | DataFrame = field(default_factory=list)  # name, target, offset, hex; a table goes through one automaton
    logical: list[Logical] = field(default_factory=list)
    rules: list[Rule] = field(default_factory=list)
    containers: DataFrame | None = None  # rules on members' metadata
    sections: DataFrame | None = None  # digests of executables' sections
    imports: DataFrame | None = None  # digests of import lists
    images: DataFrame | None = None  # perceptual hashes: digest, name
    protected: DataFrame | None = None  # hosts that links must not imitate: pattern
    allowed: DataFrame | None = None  # pairs of hosts that may: pattern, display
    passwords: tuple[bytes, ...] = ()


@dataclass
class ScanConfig:
    """Options of a scan."""

    all_match: bool = True
    heuristic_first: bool = False
    structured: bool = False
    min_cards: int = 3
    min_ssns: int = 3
    normalize: bool = True
    unpack: bool = True
    embedded: bool = False
    max_depth: int = 17
    max_file: int = 100 << 20
    max_scan: int = 400 << 20
    max_files: int = 10_000
    max_seconds: float | None = None  # for one container
    alert_limits: bool = False
    alert_members: bool = True  # alerts of decoders: encrypted, overlapping, cut short
    inspect: Callable[[DataFrame], DataFrame] | None = None  # called with the indicators before trust and verdicts
    progress: Callable[[int, int], None] | None = None  # called with each level and its number of objects


def typed(objects: DataFrame, content: str = "content") -> DataFrame:
    """Objects with their type: a magic, HTML by its tags anywhere in a text, else a kind of text."""
    def of_text(t: Column, text: Column) -> Column:
        looks = F.coalesce(text.rlike(r"<(?:!doctype html|html|head|body|title|script|table|iframe|a href)\b"), F.lit(False))
        forms = F.coalesce(text.rlike(r"progid=\"(?:word|excel)\.(?:document|sheet)\""), F.lit(False))
        return F.when(forms, "XML_WORD").when(looks, "HTML").otherwise(t)

    def of_magic(c: Column, t: Column) -> Column:
        mbr = (t == "BINARY_DATA") & (F.hex(F.substring(c, 511, 2)) == "55AA")
        image = F.substring(c, -512, 4) == F.lit(bytearray(b"koly"))
        texts = raw.once(F.lower(F.decode(c, "ISO-8859-1")), lambda text: of_text(t, text))
        return F.when(image & (t != "ZIP"), "DMG").when(t.isin("TEXT_ASCII", "TEXT_UTF8"), texts).when(mbr, "MBR").otherwise(t)

    return objects.withColumn("type", raw.once(F.col(content), lambda c: raw.once(match.magic_type(c, MAGICS), lambda t: of_magic(c, t))))


def volume_type(content: Column | str) -> Column:
    """What a partition holds, null where no magic tells."""
    c = F.col(content) if isinstance(content, str) else content
    return match.magic_type(c, VOLUMES, otherwise=F.lit(None).cast("string"))


def given(spark: SparkSession, contents: list[bytes], names: list[str] | None = None) -> DataFrame:
    """Root objects from bytes in the driver's hands, such as its standard input."""
    rows = [(k, (names or [])[k] if names else None, bytearray(c)) for k, c in enumerate(contents)]
    return spark.createDataFrame(rows, "object_id long, name string, content binary")


def sources(spark: SparkSession, path: str, *, include: str | None = None, exclude: str | None = None, recursive: bool = True) -> DataFrame:
    """Files of a folder as root objects."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    if include:
        files = files.where(F.col("path").rlike(include))
    if exclude:
        files = files.where(~F.col("path").rlike(exclude))
    return files.select(F.xxhash64("path").alias("object_id"), "path", tx.basename("path").alias("name"), "content")


META = ("container_type", "csize", "fsizec", "fsizer", "encrypted", "filepos")


def tree(objects: DataFrame, config: ScanConfig = ScanConfig(), passwords: tuple[bytes, ...] = ()) -> DataFrame:
    """Roots (object_id, name, content) and everything in them: root_id, parent_id, level, place, type, ancestor_types, attrs, size, alert and a member's metadata.

    ``place`` is the path of ordinals from the root, so it orders a root's objects as they are unpacked. Levels are unpacked one
    after another until none has members, ``max_depth`` at most; each is written to the shared folder, so none is decoded twice.
    """
    null = lambda kind: F.lit(None).cast(kind)
    name = F.col("name") if "name" in objects.columns else null("string")
    rows = typed(objects.select("object_id", name.alias("name"), F.col("content").cast("binary").alias("content")))
    rows = rows.select(
        "object_id", F.col("object_id").alias("root_id"), null("long").alias("parent_id"), F.lit(0).alias("level"), F.array().cast("array<int>").alias("place"), "name", "type",
        F.array().cast("array<string>").alias("ancestor_types"), F.lit(0).alias("attrs"), F.octet_length("content").cast("long").alias("size"), null("string").alias("alert"),
        null("string").alias("container_type"), *(null("long").alias(c) for c in META[1:4]), null("boolean").alias("encrypted"), null("long").alias("filepos"), "content",
    )
    out, columns = rows, rows.columns
    for level in range(1, config.max_depth + 1) if config.unpack else ():
        packed = rows.where(F.col("type").isin(*members.DECODERS))
        kids = members.children(packed, limit=config.max_file, passwords=passwords, seconds=config.max_seconds)
        if config.embedded:
            inside = structures.embedded(rows.where(~F.col("type").isin(*members.DECODERS)))
            inside = inside.withColumn("ordinal", (F.col("offset") + 1_000_000).cast("int"))
            kids = kids.unionByName(inside.select("parent_id", "ordinal", "content"), allowMissingColumns=True)
        above = rows.select(F.col("object_id").alias("parent_id"), "root_id", "attrs", F.col("place").alias("above"), F.concat("ancestor_types", F.array("type")).alias("ancestor_types"))
        kids = kids.join(above, "parent_id").withColumn("object_id", F.xxhash64("parent_id", "ordinal"))
        kids = typed(kids).withColumns({
            "level": F.lit(level), "place": F.concat("above", F.array("ordinal")), "name": F.col("fname"), "type": F.when(F.col("content").isNull(), "UNREAD").when(
                F.col("container_type").isin("MBR", "GPT", "APM", "DMG"), F.coalesce(volume_type("content"), F.col("type"))).otherwise(F.col("type")),
            "attrs": F.col("attrs").bitwiseAND(DECRYPTED), "size": F.octet_length("content").cast("long"),
        })
        rows = tables.written(kids.select(*columns), f"level-{level}")
        if config.progress:
            config.progress(level, rows.count())
        if rows.isEmpty():
            break
        out = out.unionByName(rows)
    return out


def views(objects: DataFrame) -> DataFrame:
    """Each object and its normalised forms: text in lower case, HTML without comments, without tags, its scripts."""
    is_text, is_html = F.col("type").isin("TEXT_ASCII", "TEXT_UTF8", "SCRIPT"), F.col("type").isin("HTML", "HTML_UTF16")
    source = F.when(F.col("type") == "HTML_UTF16", F.decode("content", "UTF-16")).otherwise(tx.lenient_utf8("content"))
    one = lambda name, c, attr: F.struct(F.lit(name).alias("view"), c.cast("binary").alias("content"), F.lit(attr).alias("mark"))
    none = F.array().cast("array<struct<view:string,content:binary,mark:int>>")
    made = F.concat(
        F.array(one("raw", F.col("content"), 0)),
        F.when(is_text, F.array(one("text", tx.normalize_text("content"), NORMALIZED))).otherwise(none),
        F.when(is_html, F.array(one("nocomment", html.no_comment(source), NORMALIZED), one("notags", html.no_tags(source), NORMALIZED), one("script", F.array_join(html.scripts(source), "\n"), NORMALIZED))).otherwise(none),
    )
    rest = [c for c in objects.columns if c not in ("content", "attrs")]
    return objects.select(*rest, "attrs", F.explode(made).alias("v")).select(*rest, F.col("attrs").bitwiseOR(F.col("v.mark")).alias("attrs"), F.col("v.view").alias("view"), F.col("v.content").alias("content"))


def _aimed(rows: DataFrame, target: int) -> DataFrame:
    return rows if target == 0 else rows.where(F.col("type").isin(*TARGETS.get(target, ("",))))


def links_found(objects: DataFrame, signatures: Signatures) -> DataFrame:
    """(root_id, object_id, place, name) of links whose text names another, protected host."""
    pages = objects.where(F.col("type").isin("HTML", "MAIL"))
    each = pages.select("root_id", "object_id", "place", F.explode(html.links(tx.lenient_utf8("content"))).alias("l"))
    each = each.where("l.tag = 'href'").select("root_id", "object_id", "place", F.col("l.target").alias("real"), F.col("l.text").alias("display"))
    each = each.withColumn("shown", F.lower(url.host(url.shown("display")))).withColumn("aimed", F.lower(url.host(url.cleaned("real"))))
    listed = match.small(signatures.protected.select(F.lower("pattern").alias("suffix"), F.lit(True).alias("listed")).distinct())
    labels = F.split("shown", r"\.", -1)
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    key = ["root_id", "object_id", "place", "real", "display", "shown", "aimed"]
    each = each.withColumn("suffix", F.explode(tails)).join(listed, "suffix").select(*key).distinct()
    if signatures.allowed is not None:
        pairs = signatures.allowed.select(F.lower("pattern").alias("aimed"), F.lower("display").alias("shown")).distinct()
        each = each.join(match.small(pairs), ["aimed", "shown"], "left_anti")
    verdict = url.link_verdict(F.col("real"), F.col("display"), listed=F.lit(True), allowed=F.lit(False))
    return each.select("root_id", "object_id", "place", url.alert(verdict).alias("name")).where("name is not null")


def indicators(objects: DataFrame, signatures: Signatures, config: ScanConfig = ScanConfig()) -> DataFrame:
    """(root_id, object_id, name, kind, seq) of all matches of a tree of objects, each name once for an object.

    ``seq`` orders a root's indicators: by the object's place in the tree, then by the kind of signature, then by name.
    """
    place = F.col("place") if "place" in objects.columns else F.array().cast("array<int>")
    objects = members.with_exe(objects.withColumn("place", place))
    seen = views(objects) if config.normalize else objects.withColumn("view", F.lit("raw"))
    numbered = seen.withColumn("_k", F.struct("root_id", "object_id", "place"))
    plain = numbered.where("view = 'raw'")
    found: list[DataFrame] = []

    def add(matches: DataFrame) -> None:
        found.append(matches.select("_k", "name", F.lit(len(found)).alias("source")))

    if config.alert_members and "alert" in objects.columns:
        add(plain.where("alert like 'Heuristics.%' and alert not like 'Heuristics.Limits.%'").select("_k", F.col("alert").alias("name")))
    if signatures.hashes is not None:
        add(match.hash_matches(plain, signatures.hashes, id_col="_k"))
    if signatures.sections is not None:
        add(match.section_matches(plain.where("exe is not null"), signatures.sections, id_col="_k"))
    if signatures.imports is not None:
        add(match.import_matches(plain, signatures.imports, id_col="_k"))
    if signatures.containers is not None and "container_type" in objects.columns:
        named = plain.where("container_type is not null").select("_k", *META, F.col("name").alias("fname"))
        add(match.container_matches(named, signatures.containers, id_col="_k"))
    if signatures.images is not None:
        from ..functions import pictures

        add(match.image_matches(pictures.hashed(plain, id_col="_k"), signatures.images, id_col="_k"))
    if signatures.protected is not None:
        add(links_found(objects, signatures).select(F.struct("root_id", "object_id", "place").alias("_k"), "name"))
    if isinstance(signatures.bodies, DataFrame):
        from ..operators import automaton

        aims = F.create_map(*(F.lit(x) for t, kinds in TARGETS.items() for x in (t, ",".join(kinds))))
        hit = automaton.matches(numbered.withColumn("_k", F.struct("_k", "view", "type")), signatures.bodies, id_col="_k")
        hit = hit.join(match.small(signatures.bodies.select("name", "target").distinct()), "name")
        add(hit.where((F.col("target") == 0) | F.array_contains(F.split(F.element_at(aims, F.col("target").cast("int")), ","), F.col("_k.type"))).select(F.col("_k._k").alias("_k"), "name"))
    else:
        for target in sorted({t for _, t, _, _ in signatures.bodies}):
            own = [(n, o, h, "") for n, t, o, h in signatures.bodies if t == target]
            add(match.body_matches(_aimed(numbered, target), own, id_col="_k", exe="exe"))
    for target in sorted({s.tdb["Target"] for s in signatures.logical}):
        own = [s for s in signatures.logical if s.tdb["Target"] == target]
        add(match.logical_matches(_aimed(numbered, target), own, id_col="_k"))
    if signatures.rules:
        add(rule_matches(numbered, signatures.rules, id_col="_k"))
    if config.structured:
        rows = plain.where(F.col("type").isin("TEXT_ASCII", "TEXT_UTF8"))
        add(rows.select("_k", F.explode(dlp.alerts("content", config.min_cards, config.min_ssns)).alias("name")))
    if not found:
        return objects.limit(0).select("root_id", "object_id", F.lit("").alias("name"), F.lit("").alias("kind"), F.struct("place", F.lit(0).alias("source"), F.lit("").alias("name")).alias("seq"))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    out = every.groupBy("_k", "name").agg(F.min("source").alias("source"))
    return out.select("_k.root_id", "_k.object_id", "name", rollup.indicator_kind("name", config.heuristic_first).alias("kind"), F.struct("_k.place", "source", "name").alias("seq"))


def scan(objects: DataFrame, signatures: Signatures, config: ScanConfig = ScanConfig()) -> DataFrame:
    """(root_id, verdict, last_alert, alerts) for every root."""
    nested = tree(objects, config, signatures.passwords)
    limited = rollup.limited(nested, max_file=config.max_file, max_scan=config.max_scan, max_files=config.max_files, max_depth=config.max_depth, order="place")
    scanned = limited.where("`limit` is null").drop("limit")
    found = indicators(scanned, signatures, config)
    if config.alert_limits:
        last = F.struct(F.array(F.lit(2**31 - 1)).alias("place"), F.lit(0).alias("source"), F.lit("").alias("name"))
        over = rollup.limit_alerts(limited, order="place").select("root_id", F.col("root_id").alias("object_id"), "name", F.lit("pua").alias("kind"), last.alias("seq"))
        cut = nested.where("alert like 'Heuristics.Limits.%'").select("root_id", F.col("root_id").alias("object_id"), F.col("alert").alias("name"), F.lit("pua").alias("kind"), last.alias("seq")).distinct()
        found = found.unionByName(over).unionByName(cut)
    if config.inspect:
        found = config.inspect(found)
    if signatures.trust is not None:
        found = rollup.distrusted(found, match.trusted(nested, signatures.trust), rollup.ancestors(nested))
    if not config.all_match:
        found = rollup.first_matches(found)
    roots = objects.select(F.col("object_id").alias("root_id"))
    v = rollup.verdicts(found)
    return roots.join(v, "root_id", "left").select("root_id", F.coalesce("verdict", F.lit("NOTHING_FOUND")).alias("verdict"), "last_alert", F.coalesce("alerts", F.lit(0)).alias("alerts"))


def action(verdict: Column | str, policy: dict[str, str] | None = None) -> Column:
    """What is to be done with an object, as a column; nothing is moved or deleted here."""
    policy = policy or {"STRONG_INDICATOR": "quarantine", "POTENTIALLY_UNWANTED": "report", "TRUSTED": "pass", "NOTHING_FOUND": "pass"}
    c = F.col(verdict) if isinstance(verdict, str) else verdict
    return F.element_at(F.create_map(*(F.lit(x) for kv in policy.items() for x in kv)), c)

"""Secret scans: candidate spans by pattern, judged by how many owners share them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .native import sums_before

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Kind, pattern, least characters. A run that a shorter pattern would match and then drop is simply not matched, where that can't change later matches.
KINDS = ("assign", "access", "hex", "owned")
BASE = 3
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
OWNED = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _spans(text: Column, found: Column, pattern: str, order: int, value: object, keep: object) -> Column:
    """Structs of start, order of kind, end and value of the matches ``found``, from the text between them."""
    between = F.split(text, pattern, -1)
    lengths = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda m, p: (F.length(m) + F.length(p)).cast("long"))
    ends = F.zip_with(sums_before(lengths), lengths, lambda a, n: a + n)
    spans = F.zip_with(ends, found, lambda e, m: F.struct((e - F.length(m)).alias("start"), F.lit(order).alias("kind"), e.alias("end"), value(m).alias("value")))
    return F.when(F.size(found) > 0, F.filter(spans, lambda s: keep(s["value"]))).otherwise(F.array().cast("array<struct<start:bigint,kind:int,end:bigint,value:string>>"))


def candidates(docs: DataFrame, *, owner: Column, repository: Column, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep``, with row, owner, repository and found: all candidate spans with a hash of what each holds.

    The table is written to the shared folder, so texts are searched once.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    work = docs.select(*(F.col(c).alias(f"own_{c}") for c in keep), owner.alias("owner"), repository.alias("repository"), text.alias("scanned"))
    t = F.col("scanned")
    work = work.withColumns({"m_assign": _matches(t, ASSIGN), "m_access": F.when(t.contains("AKIA"), _matches(t, ACCESS)).otherwise(F.array().cast("array<string>")), "m_hex": _matches(t, HEX), "m_owned": _matches(t, OWNED)})
    whole = lambda m: m
    always = lambda v: F.lit(True)
    mixed = lambda v: v.rlike("[0-9]") & v.rlike("[A-Z]") & v.rlike("[a-z]")
    work = work.withColumns(
        {
            "s_assign": _spans(t, F.col("m_assign"), ASSIGN, 0, lambda m: F.regexp_extract(m, ASSIGN, 2), lambda v: F.length(v) >= 12),
            "s_access": _spans(t, F.col("m_access"), ACCESS, 1, whole, always),
            "s_hex": _spans(t, F.col("m_hex"), HEX, 2, whole, always),
            "s_owned": _spans(t, F.col("m_owned"), OWNED, 3, whole, mixed),
        }
    )
    found = F.array_sort(F.concat("s_assign", "s_access", "s_hex", "s_owned"))
    hashed = F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.unhex(F.sha2(s["value"].cast("binary"), 256)).alias("hash")))
    return common.written(work.select(*(F.col(f"own_{c}") for c in keep), F.monotonically_increasing_id().alias("row"), "owner", "repository", hashed.alias("found")), "candidates")


def ownership(table: DataFrame) -> DataFrame:
    """(hash, n_owners, n_repositories, n): in how many owners' and repositories' texts each candidate stands, and how often.

    Rows are first made distinct, then counted for each owner, so a secret that every document holds is no task's burden.
    """
    held = table.where(F.size("found") > 0).select("owner", "repository", F.explode("found.hash").alias("hash"))
    by_owner = held.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n")).groupBy("hash", "owner").agg(F.count("*").alias("r"), F.sum("n").alias("n"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("r").alias("n_repositories"), F.sum("n").alias("n"))


def judged(table: DataFrame, *, max_owners: int, max_repositories: int | None) -> DataFrame:
    """(row, spans): the base spans of each row that has candidates, and the added ones; each says whether it looks live.

    A candidate is live if at most ``max_owners`` owners hold it, in however many of their documents, and, where a number is given,
    at most ``max_repositories`` repositories; what more of them share is an example. Long tokens of mixed letters and digits that no base kind needs are added only where live.
    """
    each = table.where(F.size("found") > 0).select("row", F.explode("found").alias("s")).select("row", "s.*")
    live = F.col("n_owners") <= max_owners
    if max_repositories is not None:
        live &= F.col("n_repositories") <= max_repositories
    owners = common.written(ownership(table), "owners")
    known = common.joined_on_hot(each, owners, ["hash"]).withColumn("live", live).where(F.col("live") | (F.col("kind") < BASE))
    return known.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "live"))).alias("spans"))


def _named(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"], s["end"])), ",")


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str | None = None, max_owners: int = 2, max_repositories: int | None = None) -> DataFrame:
    """Secrets of every whole text: id, spans as structs of start, kind, end and live, ordered by start and kind.

    Base kinds: ``assign``, ``access``, ``hex``; what the method adds has the kind ``owned``. Offsets are code points.
    The repository is the row's id unless a column names it, and ``source`` is
    the owner: stand-ins, where the corpus doesn't tell them. Null or empty texts have no spans; null owners and
    repositories count as one each; repeated rows are scanned row by row; very long texts are searched whole; other
    columns are ignored, whatever their names; an empty table gives no rows.
    """
    table = candidates(docs, owner=F.col(owner_col).cast("string"), repository=F.col(repository_col or id_col).cast("string"), text_col=text_col, keep=(id_col,))
    spans = judged(table, max_owners=max_owners, max_repositories=max_repositories)
    none = F.array().cast(spans.schema["spans"].dataType)
    return table.select(F.col(f"own_{id_col}").alias(id_col), "row").join(spans, "row", "left").select(id_col, F.coalesce("spans", none).alias("spans"))


def digests(scanned: DataFrame) -> DataFrame:
    """Counts of the base kinds, their digest, and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"] < BASE)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return scanned.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_named(base).cast("binary"), 256).alias("base_sha256"), _named(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
    )


def redacted(docs: DataFrame, *, text_col: str = "text", owner_col: str = "source", repository_col: str = "doc_id", mask: str = "<SECRET>", max_owners: int = 2, max_repositories: int | None = None) -> DataFrame:
    """The rows and columns of ``docs``, each live-looking credential replaced by ``mask``; examples that many share stay.

    Every row stays, repeated ones, null and empty texts and rows without an id or an owner too; very long texts are searched
    whole; columns are carried along whatever their names; an empty table stays empty.
    """
    names = tuple(docs.columns)
    table = candidates(docs, owner=F.col(owner_col).cast("string"), repository=F.col(repository_col).cast("string"), text_col=text_col, keep=names)
    own = [F.col(f"own_{c}").alias(c) for c in names]
    live = judged(table, max_owners=max_owners, max_repositories=max_repositories).select("row", F.filter("spans", lambda s: s["live"]).alias("spans")).where(F.size("spans") > 0)
    text = F.col(f"own_{text_col}").cast("string")

    def step(acc: Column, s: Column) -> Column:
        inside = s["end"] < acc["at"]
        covered = s["start"] + 1 < acc["at"]
        piece = F.when(covered, F.lit("")).otherwise(F.concat(F.substring(text, acc["at"], (s["start"] + 1 - acc["at"]).cast("int")), F.lit(mask)))
        return F.struct(F.when(inside, acc["at"]).otherwise((s["end"] + 1).cast("int")).alias("at"), F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], piece)).alias("out"))

    cut = F.aggregate("spans", F.struct(F.lit(1).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"], F.length(text))))
    masked = F.when(F.col("spans").isNull(), text).otherwise(cut).alias(text_col)
    with_any = table.where(F.size("found") > 0).join(live, "row", "left").select(*(masked if c == text_col else F.col(f"own_{c}").alias(c) for c in names))
    return table.where(F.size("found") == 0).select(*own).unionByName(with_any)

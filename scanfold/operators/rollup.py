"""From matches to verdicts: counts, indicators, trust through ancestors, limits, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tables

RANK = {"weak": 0, "pua": 1, "strong": 2}


def kind_rank(kind: Column | str) -> Column:
    c = F.col(kind) if isinstance(kind, str) else kind
    return F.when(c == "strong", 2).when(c == "pua", 1).otherwise(0)


def indicator_kind(name: Column | str, heuristic_first: bool = False) -> Column:
    """Heuristics are possibly unwanted, unless they take precedence; all else is strong."""
    n = F.col(name) if isinstance(name, str) else name
    return F.when(n.startswith("Heuristics.") & F.lit(not heuristic_first), "pua").when(n.startswith("PUA."), "pua").otherwise("strong")


def verdicts(indicators: DataFrame, *, by: str = "root_id") -> DataFrame:
    """(root, verdict, last_alert, alerts): strong before unwanted; weak indicators never alert.

    The last alert is the last strong one, else the last unwanted one. Partial aggregates, one shuffle on the root.
    """
    r = kind_rank("kind")
    alert = F.when(r > 0, F.struct(r.alias("rank"), F.col("seq")))
    out = indicators.groupBy(by).agg(F.max(r).alias("top"), F.max_by("name", alert).alias("last_alert"), F.count_if(r > 0).alias("alerts"))
    verdict = F.when(F.col("top") == 2, "STRONG_INDICATOR").when(F.col("top") == 1, "POTENTIALLY_UNWANTED").otherwise("NOTHING_FOUND")
    return out.select(by, verdict.alias("verdict"), F.when(F.col("alerts") > 0, F.col("last_alert")).alias("last_alert"), "alerts")


def first_matches(indicators: DataFrame, *, by: str = "root_id") -> DataFrame:
    """Without all-match: per root the first strong indicator and what came before it."""
    w = Window.partitionBy(by).orderBy("seq")
    seen = F.coalesce(F.sum(F.when(F.col("kind") == "strong", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return indicators.withColumn("_n", seen).where("_n = 0").drop("_n")


def depth(level: Column, normalized_layers: Column) -> Column:
    """An indicator's depth under its root; a normalised view is as deep as what it was made of."""
    return level - normalized_layers


def distrusted(indicators: DataFrame, trusted_objects: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Indicators that no trusted layer covers: an object's trust holds for all that lies inside.

    ``ancestors`` has (object_id, ancestor_id), each object being its own ancestor too.
    """
    covered = ancestors.join(trusted_objects.select(F.col("object_id").alias("ancestor_id")), "ancestor_id").select("object_id").distinct()
    return indicators.join(covered, "object_id", "left_anti")


def ancestors(tree: DataFrame) -> DataFrame:
    """(object_id, ancestor_id) of a tree (object_id, parent_id), self included, however deep it is.

    Distances double: a round joins the ancestors known so far with those as far away as all of them, so a tree of depth d takes
    log d rounds, each written to the shared folder. A cycle is an error.
    """
    jump = tables.written(tree.where("parent_id is not null").select(F.col("object_id").alias("node"), F.col("parent_id").alias("above")).distinct(), "jumps")
    out = tables.written(tree.select("object_id", F.col("object_id").alias("ancestor_id")).distinct(), "ancestors")
    while not jump.isEmpty():
        found = out.join(jump, out["ancestor_id"] == jump["node"]).select("object_id", F.col("above").alias("ancestor_id"))
        found = tables.written(found, "ancestors")
        if not found.where("object_id = ancestor_id").isEmpty():
            raise ValueError("an object lies in itself")
        far = jump.select(F.col("node").alias("middle"), F.col("above").alias("far"))
        jump = tables.written(jump.join(far, jump["above"] == far["middle"]).select("node", F.col("far").alias("above")), "jumps")
        out = out.unionByName(found)
    return out


def limited(objects: DataFrame, *, max_file: int = 100 << 20, max_scan: int = 400 << 20, max_files: int = 10_000, max_depth: int = 17, by: str = "root_id", order: str = "object_id") -> DataFrame:
    """Objects with ``limit``: the first limit that keeps each from being scanned, or null. A limit of 0 is none.

    What an object adds to its root's scanned bytes and files counts only for those after it.
    """
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    fits = (F.col("size") <= max_file) if max_file else F.lit(True)
    size = F.when(fits, F.col("size")).otherwise(0)
    before = F.coalesce(F.sum(size).over(w), F.lit(0))
    files = F.coalesce(F.sum(F.when(fits, 1).otherwise(0)).over(w), F.lit(0))
    limit = F.when(~fits, "MaxFileSize")
    if max_scan:
        limit = limit.when(before + F.col("size") > max_scan, "MaxScanSize")
    if max_files:
        limit = limit.when(files >= max_files, "MaxFiles")
    if max_depth and "level" in objects.columns:
        limit = limit.when(F.col("level") > max_depth, "MaxRecursion")
    return objects.withColumn("limit", limit)


def limit_alerts(limited_objects: DataFrame, *, by: str = "root_id", order: str = "object_id") -> DataFrame:
    """One alert per root and scan, if limits are to alert."""
    return limited_objects.where("`limit` is not null").groupBy(by).agg(F.concat(F.lit("Heuristics.Limits.Exceeded."), F.min_by("limit", order)).alias("name"))


def cached(objects: DataFrame, *, content: str = "content") -> tuple[DataFrame, DataFrame]:
    """(one object of each content, all ids with their content's key): scan the first, join results back by the second.

    Only for signatures that don't look at an object's surroundings.
    """
    keyed = objects.withColumn("_key", F.concat_ws(":", F.sha2(F.col(content).cast("binary"), 256), F.octet_length(F.col(content).cast("binary"))))
    return keyed.dropDuplicates(["_key"]), keyed.select("object_id", "_key")


def unique_names(names: DataFrame, *, name: str = "name", cap: int | None = None) -> DataFrame:
    """(digest, name, count): distinct names by MD5 with their counts; with ``cap`` counts stop there."""
    n = F.count("*")
    return names.groupBy(F.md5(F.col(name).cast("binary")).alias("digest"), name).agg((F.least(n, F.lit(cap)) if cap else n).alias("count"))


def summary(objects: DataFrame, found: DataFrame, signatures: DataFrame | None = None) -> DataFrame:
    """One row: scanned files and bytes, infected files, known signatures."""
    one = objects.agg(F.count("*").alias("scanned_files"), F.sum("size").alias("scanned_bytes"))
    two = found.where("verdict <> 'NOTHING_FOUND'").agg(F.count("*").alias("infected_files"))
    out = one.join(two)
    return out.join(signatures.agg(F.count("*").alias("known_signatures"))) if signatures is not None else out


def overlaps(spans: DataFrame, *, by: str, start: str = "start", size: str = "size") -> DataFrame:
    """(by, n): intervals of each group that begin before an earlier one ends. A running maximum finds them in one sort."""
    w = Window.partitionBy(by).orderBy(start, size).rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("_end", F.max(F.col(start) + F.col(size)).over(w)).groupBy(by).agg(F.count_if(F.col(start) < F.col("_end")).alias("n"))


def rule_costs(runs: DataFrame) -> DataFrame:
    """Matches and time of each rule, the dearest first."""
    return runs.groupBy("name").agg(F.sum("matches").alias("matches"), F.sum("micros").alias("micros"), F.count("*").alias("runs")).orderBy(F.desc("micros"), "name")


def metadata(**fields: Column) -> Column:
    """A layer's metadata as JSON."""
    return F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())))

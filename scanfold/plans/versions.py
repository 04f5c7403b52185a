"""Versions of line tables: diffs and patches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NAME = r"\A[A-Za-z0-9._]+\z"


def script(lines: DataFrame) -> DataFrame:
    """Patch lines (seq, value) as columns: seq, db, op, line_no, old_prefix, new_line, and a move's dst, last_no and last_prefix.

    OPEN and CLOSE bracket the edits of a table; a name with more than letters, digits, dots and lines is refused.
    """
    v = F.col("value")
    op = F.regexp_extract(v, r"\A(\w+)", 1)
    word = lambda n: F.get(F.split(v, " ", n + 2), F.lit(n))
    rest = lambda n: F.get(F.split(v, " ", n + 1), F.lit(n))
    rows = lines.select("seq", "value", op.alias("op"))
    opened = F.last(F.when(F.col("op") == "OPEN", rest(1)), True).over(Window.orderBy("seq"))
    rows = rows.withColumn("db", F.when(F.col("op").isin("MOVE", "UNLINK"), word(1)).otherwise(opened))
    bad = ~F.col("op").isin("OPEN", "ADD", "DEL", "XCHG", "MOVE", "CLOSE", "UNLINK") | ~F.coalesce(F.col("db"), F.lit("")).rlike(NAME)
    rows = rows.where(F.when(bad, F.raise_error(F.concat(F.lit("patch line refused: "), v)).cast("boolean")).otherwise(True))
    o = F.col("op")
    return rows.where(~o.isin("OPEN", "CLOSE")).select(
        "seq", "db", "op",
        F.when(o.isin("DEL", "XCHG"), word(1)).when(o == "MOVE", word(3)).try_cast("long").alias("line_no"),
        F.when(o == "DEL", rest(2)).when(o == "XCHG", word(2)).when(o == "MOVE", word(4)).alias("old_prefix"),
        F.when(o == "ADD", rest(1)).when(o == "XCHG", rest(3)).alias("new_line"),
        F.when(o == "MOVE", word(2)).alias("dst"), F.when(o == "MOVE", word(5)).try_cast("long").alias("last_no"), F.when(o == "MOVE", rest(6)).alias("last_prefix"),
    )


def patched(tables: DataFrame, edits: DataFrame, *, check: bool = True) -> DataFrame:
    """Tables (db, line_no, line) after edits (as :func:`script` gives them); lines are numbered anew from 1.

    Numbers name lines as they were before. DEL and XCHG need the line to begin with their prefix, MOVE checks its
    first and last line; an edit that finds no such line fails the query. ADDed lines come last, in order, and
    make a table that isn't there; UNLINK drops a table. Each step is a join on (db, line_no).
    """
    edit = edits.where(F.col("op").isin("DEL", "XCHG")).select("db", "line_no", "op", "old_prefix", "new_line")
    moves = edits.where("op = 'MOVE'").select("db", "dst", F.col("line_no").alias("first_no"), F.col("old_prefix").alias("first_prefix"), "last_no", "last_prefix", F.col("seq").alias("move_seq"))
    gone = edits.where("op = 'UNLINK'").select("db").distinct()
    base = tables.select("db", "line_no", "line")
    if check:
        lost = edit.alias("e").join(base.alias("b"), ["db", "line_no"], "left").where(F.col("b.line").isNull() | ~F.col("b.line").startswith(F.col("e.old_prefix"))).select("db", "line_no")
        ends = moves.select("db", F.col("first_no").alias("line_no"), F.col("first_prefix").alias("p")).unionByName(moves.select("db", F.col("last_no").alias("line_no"), F.col("last_prefix").alias("p")))
        lost = lost.unionByName(ends.join(base, ["db", "line_no"], "left").where(F.col("line").isNull() | ~F.col("line").startswith(F.col("p"))).select("db", "line_no"))
        if not lost.isEmpty():
            raise ValueError(f"an edit found no such line: {lost.first().asDict()}")
    spans = moves.select("db", "dst", "move_seq", F.explode(F.sequence("first_no", "last_no")).alias("line_no"))
    now = base.join(edit, ["db", "line_no"], "left").where("op is null or op <> 'DEL'").select("db", "line_no", F.coalesce("new_line", "line").alias("line"))
    kept = now.join(spans.select("db", "line_no"), ["db", "line_no"], "left_anti").select("db", F.lit(0).alias("part"), F.lit(0).cast("long").alias("s"), F.col("line_no").alias("n"), "line")
    moved = now.join(spans, ["db", "line_no"]).select(F.col("dst").alias("db"), F.lit(1).alias("part"), F.col("move_seq").cast("long").alias("s"), F.col("line_no").alias("n"), "line")
    added = edits.where("op = 'ADD'").select("db", F.lit(2).alias("part"), F.lit(0).cast("long").alias("s"), F.col("seq").cast("long").alias("n"), F.col("new_line").alias("line"))
    every = kept.unionByName(moved).unionByName(added).join(gone, "db", "left_anti")
    return every.select("db", F.row_number().over(Window.partitionBy("db").orderBy("part", "s", "n")).cast("long").alias("line_no"), "line")


def walked(tables: DataFrame, log: DataFrame, local: int, remote: int) -> DataFrame:
    """Tables brought from version ``local`` to ``remote``, a patch after another; the log has a version column besides."""
    for version in range(local + 1, remote + 1):
        tables = patched(tables, log.where(F.col("version") == version))
    return tables


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edits that turn a line table (line_no, line) into another: a line at its place exchanged, lines at the end deleted or added."""
    o, n = old.select("line_no", F.col("line").alias("a")), new.select("line_no", F.col("line").alias("b"))
    both = o.join(n, "line_no", "full").where("a is null or b is null or a <> b")
    op = F.when(F.col("a").isNull(), "ADD").when(F.col("b").isNull(), "DEL").otherwise("XCHG")
    return both.select(F.col("line_no").alias("seq"), op.alias("op"), F.when(op != "ADD", F.col("line_no")).alias("line_no"), F.col("a").alias("old_prefix"), F.col("b").alias("new_line"))


def set_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(op, line): lines that came and went, repeated ones counted."""
    return new.select("line").exceptAll(old.select("line")).select(F.lit("ADD").alias("op"), "line").unionByName(old.select("line").exceptAll(new.select("line")).select(F.lit("DEL").alias("op"), "line"))


def pruned(files: DataFrame, listed: DataFrame) -> DataFrame:
    """Files that no list names."""
    return files.join(listed, "file", "left_anti")


def announced(record: str) -> dict[str, int]:
    """Versions of a colon-separated announcement: engine, main, daily, time, level, bytecode."""
    parts = record.split(":")
    names = ("main", "daily", "time", "warn", "level", None, "bytecode")
    return {"engine": parts[0]} | {n: int(p) for n, p in zip(names, parts[1:], strict=False) if n and p.lstrip("-").isdigit()}


def updated(tables: DataFrame, log: DataFrame, local: int, remote: int, full: DataFrame | None = None, most: int = 100) -> tuple[DataFrame, int]:
    """Tables and the version reached: patch by patch, at most ``most``; where a patch fails or there are more, the full snapshot if there is one."""
    if remote - local > most and full is not None:
        return full, remote
    for version in range(local + 1, min(remote, local + most) + 1):
        edits = log.where(F.col("version") == version)
        try:
            if edits.isEmpty():
                raise ValueError(f"no patch for version {version}")
            tables = patched(tables, edits)
        except ValueError:
            return (full, remote) if full is not None else (tables, version - 1)
    return tables, min(remote, local + most)


def built(tables: dict[str, DataFrame], version: int, builder: str, time: int, level: int = 1) -> tuple[str, dict[str, int]]:
    """The head line of an archive of tables, and the number of signatures of each."""
    counts = {k: t.count() for k, t in tables.items()}
    return f"Tables-VDB:{time}:{version}:{sum(counts.values())}:{level}:X:X:{builder}:{time}".ljust(512), counts

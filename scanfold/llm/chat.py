"""Chat formatting: turn-aligned windows under a token budget, with a loss mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .native import sums_before

START, END = "<|im_start|>", "<|im_end|>\n"
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"
BLOCK = 256


def escaped(c: Column) -> Column:
    """No control string is left: each backslash is doubled, and one goes between ``<`` and a following bar."""
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(c: Column) -> Column:
    """The reverse of :func:`escaped`, also of an escaped line feed."""
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def header(role: Column) -> Column:
    """A turn's start; a line feed in the role is escaped as well, so the first bare one ends the role."""
    return F.concat(F.lit(START), F.replace(escaped(role), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))


def _starts(turns: Column, cap: Column, first_cap: Column) -> Column:
    """Where spans begin: of ``turns``, structs of n and tokens in order, each goes into the span before it if that stays within ``cap``."""
    none = F.array().cast("array<int>")

    def step(acc: Column, x: Column) -> Column:
        n = F.size(acc["starts"])
        fits = (n > 0) & ((acc["used"] == 0) | (acc["used"] + x["tokens"] <= F.when(n == 1, first_cap).otherwise(cap)))
        return F.struct(
            F.when(fits, acc["used"] + x["tokens"]).otherwise(x["tokens"]).alias("used"), F.when(fits, acc["starts"]).otherwise(F.concat(acc["starts"], F.array(x["n"]))).alias("starts")
        )

    return F.aggregate(turns, F.struct(F.lit(0).cast("long").alias("used"), none.alias("starts")), step, lambda acc: acc["starts"])


def windows(
    turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", budget: int = 2048, history: int = 256, target: str = "assistant"
) -> DataFrame:
    """Training windows of conversations: conv_id, window, formatted, loss (spans of code points, end exclusive), n_repeated, n_tokens, over_budget.

    Turns are ordered by ``turn`` (null first), then role and text. Spans of whole turns are chosen by running sums of turn tokens:
    a span ends where the next turn would take it, with the system turn and ``history`` tokens before it, over ``budget``. A
    window has the conversation's first system turn, the turns before its span that fit into ``history`` tokens and into what
    the span leaves of the budget, and the span itself; its number is that of the span's first turn. Each turn lies in one span;
    only there is a ``target`` turn's text under the loss mask. ``over_budget`` marks windows that one turn and the system
    turn make too long, as turns are never cut.

    Null roles and texts are empty; rows without a conversation are one conversation with a null id; repeated rows are turns
    of their own; very long turns are windows of their own; an empty table gives no rows; other columns are ignored, whatever
    their names. Running sums are taken in blocks of turn numbers, cut after each 256 turns, and then over the blocks, so a
    conversation of any length is spread over tasks; a span doesn't go beyond such a cut.
    """
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (text_col, role_col))
    rows = turns.select(
        F.coalesce(F.col(conv_col).cast("long"), F.lit(0)).alias("c"), F.col(conv_col).isNull().alias("none"), F.coalesce(F.col(turn_col).cast("long"), F.lit(-(2**63))).alias("t"), role.alias("role"),
        header(role).alias("head"), F.concat(header(role), escaped(text), F.lit(END)).alias("body"), text.alias("text"),
    ).withColumn("block", F.floor(F.col("t") / BLOCK).cast("long")).withColumn("tokens", F.regexp_count("body", F.lit(TOKEN)).cast("long"))
    key = ["c", "none"]
    order = Window.partitionBy(*key, "block").orderBy("t", "role", "text")
    rows = rows.withColumn("n", F.row_number().over(order)).withColumn("upto", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("text")
    rows = rows.withColumn("cut", F.floor((F.col("n") - 1) / BLOCK).cast("int"))
    system = F.col("role") == "system"
    blocks = rows.groupBy(*key, "block").agg(
        F.count("*").alias("size"), F.sum("tokens").alias("sum"), F.min(F.when(system, F.col("n"))).alias("sys_n"), F.min_by(F.when(system, F.col("tokens")), F.when(system, F.col("n"))).alias("sys_tokens"),
    )
    by = Window.partitionBy(*key).orderBy("block")
    before, whole = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*key)
    blocks = blocks.select(
        *key, "block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("sum0"),
        F.coalesce(F.first("sys_tokens", True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(0)).alias("sys"),
        (F.col("sys_n").isNotNull() & (F.count("sys_n").over(by.rowsBetween(Window.unboundedPreceding, 0)) == 1)).alias("holds_system"), "sys_n",
        (F.floor(F.sum("size").over(whole) / 4096) + 1).cast("int").alias("salts"),
    )
    is_system = F.col("holds_system") & (F.col("n") == F.col("sys_n"))
    ordered = rows.groupBy(*key, "block", "cut").agg(F.array_sort(F.collect_list(F.struct("n", "tokens"))).alias("ts")).join(blocks, [*key, "block"])
    counted = F.transform("ts", lambda x: F.struct(x["n"].alias("n"), F.when(F.col("holds_system") & (x["n"] == F.col("sys_n")), F.lit(0).cast("long")).otherwise(x["tokens"]).alias("tokens")))
    room = F.lit(budget) - F.col("sys")
    cap = F.greatest(F.lit(1).cast("long"), room - history)
    first_cap = F.when((F.col("n0") == 0) & (F.col("cut") == 0), F.greatest(F.lit(1).cast("long"), room)).otherwise(cap)
    cuts = ordered.withColumn("starts", _starts(counted, cap, first_cap)).drop("ts")
    begin = F.array_max(F.filter("starts", lambda s: s <= F.col("n")))
    rows = rows.join(cuts, [*key, "block", "cut"]).select(
        *key, (F.col("n0") + F.col("n")).alias("idx"), (F.col("sum0") + F.col("upto") - F.col("tokens")).alias("pre"), (F.col("n0") + begin).alias("w"),
        is_system.alias("is_system"), "role", "body", F.length("head").alias("head"), "tokens", "sys", "salts",
    )
    rows = common.written(rows, "turns")  # four branches read it
    own = F.col("is_system")
    spans = rows.groupBy(*key, "w").agg(
        F.min("pre").alias("first"), F.max(F.when(own, F.lit(1)).otherwise(0)).alias("own"), F.max("salts").alias("salts"),
        F.greatest(F.lit(0).cast("long"), F.least(F.lit(history).cast("long"), F.lit(budget) - F.max("sys") - F.sum(F.when(own, F.lit(0)).otherwise(F.col("tokens"))))).alias("allowed"),
    )
    parts = ["kind", "idx", "body", "head", "tokens", "loss"]
    new = rows.select(*key, "w", F.lit(2).alias("kind"), "idx", "body", "head", "tokens", (F.col("role") == target).alias("loss"))
    cell = F.lit(max(1, history))
    near = spans.select(*key, F.col("w").alias("to"), "first", "allowed", F.explode(F.array(F.floor(F.col("first") / cell), F.floor(F.col("first") / cell) - 1)).alias("cell"))
    past = rows.where(~own).withColumn("cell", F.floor(F.col("pre") / cell)).join(near, [*key, "cell"]).where((F.col("pre") < F.col("first")) & (F.col("first") - F.col("pre") <= F.col("allowed")))
    past = past.select(*key, F.col("to").alias("w"), F.lit(1).alias("kind"), "idx", "body", "head", "tokens", F.lit(False).alias("loss"))
    # a giant conversation's windows get its system turn from several tasks
    once = rows.where("is_system").select(*key, F.col("w").alias("sw"), "idx", "body", "head", "tokens", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    kept = once.join(spans.where("own = 0").select(*key, "w", F.pmod(F.xxhash64("w"), F.col("salts")).cast("int").alias("salt")), [*key, "salt"]).where("w <> sw")
    kept = kept.select(*key, "w", F.lit(0).alias("kind"), "idx", "body", "head", "tokens", F.lit(False).alias("loss"))
    grouped = new.unionByName(past).unionByName(kept).groupBy(*key, "w").agg(F.array_sort(F.collect_list(F.struct("kind", "idx", *parts[2:]))).alias("parts"))
    grouped = grouped.withColumn("at", sums_before(F.transform("parts", lambda p: F.length(p["body"]).cast("long"))))
    spanned = F.zip_with("parts", "at", lambda p, a: F.struct((a + p["head"]).alias("start"), (a + F.length(p["body"]) - len(END)).alias("end"), p["loss"].alias("loss")))
    masked = F.filter(spanned, lambda s: s["loss"])
    total = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["tokens"])
    return grouped.select(
        F.when(~F.col("none"), F.col("c")).alias("conv_id"), F.col("w").alias("window"), F.array_join(F.transform("parts", lambda p: p["body"]), "").alias("formatted"),
        F.transform(masked, lambda s: F.struct(s["start"], s["end"])).alias("loss"), F.size(F.filter("parts", lambda p: p["kind"] < 2)).alias("n_repeated"), total.alias("n_tokens"), (total > budget).alias("over_budget"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """From each window's output alone: conv_id, window, its new turns as structs of role and text, the text under its loss mask, its characters."""
    bodies = F.regexp_extract_all("formatted", F.lit(r"(?s)<\|im_start\|>(.*?)<\|im_end\|>\n"), F.lit(1))
    form = r"(?s)\A([^\\\n]*+(?:\\.[^\\\n]*+)*+)\n(.*)\z"
    turn = lambda b: F.struct(unescaped(F.regexp_extract(b, form, 1)).alias("role"), unescaped(F.regexp_extract(b, form, 2)).alias("text"))
    loss = F.transform("loss", lambda s: unescaped(F.substring("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return formatted.withColumn("bodies", bodies).select("conv_id", "window", F.transform(F.slice("bodies", F.col("n_repeated") + 1, F.size("bodies")), turn).alias("turns"), F.array_join(loss, "").alias("loss_text"), F.length("formatted").cast("long").alias("chars"))


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    each = read_back(formatted).select("conv_id", F.struct("window", lines.alias("lines"), "loss_text").alias("w"), F.size("turns").cast("long").alias("n"), "chars")
    by = each.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.array_sort(F.collect_list("w")).alias("ws"), F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_windows"))
    joined = lambda f: F.array_join(F.transform("ws", lambda w: w[f]), "")
    return by.select("conv_id", "n_turns", joined("lines").alias("all"), joined("loss_text").alias("loss"), "formatted_chars", "n_windows").select(
        "conv_id", "n_turns", F.sha2(F.col("all").cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars", "n_windows",
    )

"""User functions: hooks that logical signatures trigger, and callbacks at fixed points of a scan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .logic import Logical

POINTS = ("pre_hash", "pre_scan", "post_scan", "alert", "file_type")


@dataclass
class Hooks:
    """Functions by name, run only on rows where their trigger holds; callbacks by point, each a function of a table."""

    functions: dict[str, tuple[Logical | None, Callable[..., Column], tuple[str, ...]]] = field(default_factory=dict)
    callbacks: dict[str, list[Callable[[DataFrame], DataFrame]]] = field(default_factory=dict)

    def add(self, name: str, function: Callable[..., Column], columns: tuple[str, ...], trigger: Logical | None = None) -> None:
        """``function`` makes a column of ``columns``: an expression, or a vectorised user function."""
        self.functions[name] = (trigger, function, columns)

    def on(self, point: str, callback: Callable[[DataFrame], DataFrame]) -> None:
        if point not in POINTS:
            raise ValueError(f"no point {point!r}; there are {', '.join(POINTS)}")
        self.callbacks.setdefault(point, []).append(callback)

    def at(self, point: str, table: DataFrame) -> DataFrame:
        for c in self.callbacks.get(point, ()):
            table = c(table)
        return table

    def run(self, objects: DataFrame, text: Column) -> DataFrame:
        """``objects`` with a column for each function, null where its trigger doesn't hold. Triggers are tested before a row goes to Python."""
        out = objects
        for name, (trigger, function, columns) in self.functions.items():
            ok = F.lit(True) if trigger is None else trigger.fires(text)
            out = out.withColumn(f"_ok_{name}", ok).withColumn(name, F.when(F.col(f"_ok_{name}"), function(*(F.when(F.col(f"_ok_{name}"), F.col(c)) for c in columns)))).drop(f"_ok_{name}")
        return out


def ilog2(a: Column, b: Column) -> Column:
    """The integer nearest below 2 ** 26 times the binary logarithm of a / b."""
    return F.floor(F.log2(a / b) * (1 << 26)).cast("int")


def ipow(a: Column, b: Column, c: Column) -> Column:
    return F.floor(F.pow(a, b) * c).cast("long")


def iexp(a: Column, b: Column, c: Column) -> Column:
    return F.floor(F.exp(a / b) * c).cast("long")


def isin(a: Column, b: Column, c: Column) -> Column:
    return F.floor(F.sin(a / b) * c).cast("long")


def icos(a: Column, b: Column, c: Column) -> Column:
    return F.floor(F.cos(a / b) * c).cast("long")


def explained(line: str) -> str:
    """A logical signature in words: name, attributes, expression and each sub-signature's kind and regular expression."""
    s = Logical.parse(line)
    rows = [f"name: {s.name}", "attributes: " + ", ".join(f"{k}={v}" for k, v in s.tdb.items())]
    for k, sub in enumerate(s.subs):
        detail = getattr(getattr(sub, "pattern", None), "regex", None) or getattr(sub, "regex", None) or sub
        rows.append(f"sub {k}: {type(sub).__name__} {detail}")
    return "\n".join(rows)

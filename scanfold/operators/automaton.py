"""Many body signatures at once: one automaton over literal anchors, full patterns only where an anchor stands."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import patterns

#: Bytes of signatures that one pass takes; a larger table is cut in parts, each of which is a pass over the objects.
PART = 64 << 20
_built: dict[str, Matcher] = {}


def anchor(code: str) -> str:
    """The longest run of plain bytes of a hexadecimal pattern that every match must hold, as hexadecimal digits; empty without one of two bytes."""
    text, depth, plain = code.lower(), 0, []
    for c in re.sub(r"\{[^}]*\}|\[[^\]]*\]|!?\([blw]\)", "|", text):
        depth += c == "("
        plain.append(" " if depth or c in "()!|*" else c)
        depth -= c == ")"
    runs: list[str] = []
    for run in "".join(plain).split():
        pairs, now = [run[k : k + 2] for k in range(0, len(run), 2)], ""
        for p in [*pairs, "??"]:
            if "?" in p or len(p) < 2:
                runs.append(now)
                now = ""
            else:
                now += p
    best = max(runs, key=len, default="")
    return best if len(best) >= 4 else ""


class Matcher:
    """Signatures (name, offset, hex, options) over byte strings."""

    def __init__(self, signatures: list[tuple[str, str, str, str]]):
        import ahocorasick
        import regex

        self.plain, self.folded, self.always = ahocorasick.Automaton(), ahocorasick.Automaton(), []
        self.signatures = []
        by_anchor: tuple[dict[str, list[int]], dict[str, list[int]]] = ({}, {})
        for k, (name, off, code, options) in enumerate(signatures):
            options = options or ""
            found, where = patterns.compile_hex(code, options), patterns.parse_offset(off)
            made = None
            if found.literal is None:
                made = regex.compile(found.regex.replace(r"\z", r"\Z").encode("latin-1"), regex.S)
            self.signatures.append((name, where, made))
            # two-byte characters or whole words change what is looked for; there only the regular expression tells
            literal = "" if "w" in options else anchor(code)
            if not literal:
                if made is None:
                    made = regex.compile(regex.escape(bytes.fromhex(found.literal)))
                    self.signatures[-1] = (name, where, made)
                self.always.append(k)
                continue
            word = bytes.fromhex(literal).decode("latin-1")
            fold = "i" in options
            by_anchor[fold].setdefault(word.lower() if fold else word, []).append(k)
        for automaton, words in zip((self.plain, self.folded), by_anchor, strict=True):
            for w, ks in words.items():
                automaton.add_word(w, (len(w), tuple(ks)))
            if len(automaton):
                automaton.make_automaton()

    def run(self, data: bytes, exe: dict | None = None) -> list[tuple[str, list[int]]]:
        """(name, ascending offsets) of each signature that matches."""
        text = data.decode("latin-1")
        literal: dict[int, set[int]] = {}
        complex_ = set(self.always)
        for automaton, own in ((self.plain, text), (self.folded, None)):
            if not len(automaton):
                continue
            for end, (n, ks) in automaton.iter(own if own is not None else text.lower()):
                for k in ks:
                    if self.signatures[k][2] is None:
                        literal.setdefault(k, set()).add(end + 1 - n)
                    else:
                        complex_.add(k)
        out = []
        for k in sorted({*literal, *complex_}):
            name, where, made = self.signatures[k]
            bounds = where.span(len(data), exe)
            if bounds is None:
                continue
            lo, hi = bounds
            at = sorted(literal[k]) if made is None else [m.start() for m in made.finditer(data, overlapped=True)]
            at = sorted({a for a in at if lo <= a <= hi})
            if at:
                out.append((name, at))
        return out


def matches(objects: DataFrame, bodies: DataFrame, *, id_col: str = "object_id", content: str = "content", exe: str | None = None, part: int = PART) -> DataFrame:
    """(object, name, offsets) of a table of body signatures (name, off, hex, and options where there are any).

    Each object is read once by one automaton over the signatures' anchors, so the cost hardly grows with their number; a pattern
    that isn't plain bytes is tried only on objects that hold its anchor. The table goes to the workers in parts of ``part``
    bytes at most, and each part is one pass over the objects. A null content matches nothing; an empty table gives no rows.
    """
    options = F.coalesce(F.col("options"), F.lit("")) if "options" in bodies.columns else F.lit("")
    rows = bodies.select("name", F.coalesce(F.col("off"), F.lit("*")).alias("off"), "hex", options.alias("options")).where("hex is not null").distinct()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("hex") + F.octet_length("name") + 64), F.lit(0))).first()[0]
    parts = max(1, -(-size // part))
    found = None
    for k in range(parts):
        own = rows.where(F.pmod(F.xxhash64("name", "hex"), F.lit(parts)) == k).collect()  # of a proven size
        one = over(objects, sorted(tuple(r) for r in own), id_col=id_col, content=content, exe=exe)
        found = one if found is None else found.unionByName(one)
    return found


def over(objects: DataFrame, table: list[tuple[str, str, str, str]], *, id_col: str = "object_id", content: str = "content", exe: str | None = None) -> DataFrame:
    """(object, name, offsets) of one automaton's signatures (name, off, hex, options)."""
    work = objects.select(F.col(id_col).alias("id"), F.col(content).cast("binary").alias("content"), *([F.col(exe).alias("exe")] if exe else []))
    schema = f"id {work.schema['id'].dataType.simpleString()}, name string, offsets array<bigint>"
    return work.mapInArrow(_runner(table, exe is not None), schema).withColumnRenamed("id", id_col)


def _runner(table: list[tuple], with_exe: bool):
    key = hashlib.sha256(repr(table).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _built:
            _built.clear()
            _built[key] = Matcher(table)
        matcher = _built[key]
        for batch in batches:
            at, names, offsets = [], [], []
            for k in range(batch.num_rows):
                data = batch.column("content")[k].as_py()
                if data is None:
                    continue
                for name, where in matcher.run(data, batch.column("exe")[k].as_py() if with_exe else None):
                    at.append(k)
                    names.append(name)
                    offsets.append(where)
            ids = batch.column("id").take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(names, pa.string()), pa.array(offsets, pa.list_(pa.int64()))], names=["id", "name", "offsets"])

    return run

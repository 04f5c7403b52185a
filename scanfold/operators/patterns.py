"""Byte patterns with gaps, nibbles, alternates and edges, compiled to regular expressions over byte strings; and their offset rules."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import raw

LETTERS = "A-Za-z0-9"
#: Bytes that bound a name on its left or right.
BEFORE, AFTER = r"\x0a\x0d\x20\x22\x27\x2d\x2f\x3d\x3e\x5f", r"\x0a\x0d\x20\x22\x27\x2d-\x2f\x3c-\x3e\x40\x5f"
MIN_BYTES = 2


class PatternError(ValueError):
    """A pattern that the grammar or a limit refuses."""


def _byte(pair: str) -> str:
    hi, lo = pair
    if pair == "??":
        return "."
    if hi == "?":
        return "[" + "".join(f"\\x{h:x}{lo}" for h in range(16)) + "]"
    if lo == "?":
        return f"[\\x{hi}0-\\x{hi}f]"
    return f"\\x{hi}{lo}"


_TOKEN = re.compile(r"(?P<byte>[0-9a-f?]{2})|(?P<any>\*)|\{(?P<gap>[0-9]*-?[0-9]*)\}|\[(?P<near>[0-9]+(?:-[0-9]+)?)\]|(?P<neg>!?)\((?P<cls>[BLWblw])\)|(?P<open>!?\()")


@dataclass(frozen=True)
class Compiled:
    """A pattern's regular expression, and the least number of bytes that it matches."""

    regex: str
    least: int
    literal: str | None  # hex of a pattern that is plain bytes


def _bounds(text: str, what: str) -> tuple[int, int | None]:
    lo, dash, hi = text.partition("-")
    if not dash:
        if not lo:
            raise PatternError(f"an empty {what}")
        return int(lo), int(lo)
    a, b = int(lo or 0), int(hi) if hi else None
    if b is not None and b < a:
        raise PatternError(f"a {what} from {a} to {b}")
    return a, b


def _repeat(a: int, b: int | None) -> str:
    return f".{{{a}}}" if a == b else f".{{{a},{'' if b is None else b}}}?"


def _alternates(body: str, negated: bool) -> tuple[str, int]:
    """An alternation in brackets; its parts may nest, but hold no gaps."""
    parts, depth, now = [], 0, ""
    for c in body:
        depth += (c == "(") - (c == ")")
        if c == "|" and depth == 0:
            parts.append(now)
            now = ""
        else:
            now += c
    parts.append(now)
    done = [_sequence(p, inner=True) for p in parts]
    sizes = {least for _, least in done}
    joined = "(?:" + "|".join(r for r, _ in done) + ")"
    if not negated:
        return joined, min(sizes)
    if len(sizes) > 1 or "(" in body:
        raise PatternError("alternates of different lengths can't be negated")
    n = sizes.pop()
    return f"(?!{joined}).{{{n}}}", n


def _sequence(text: str, inner: bool = False) -> tuple[str, int]:
    out, least, at, n = "", 0, 0, len(text)
    while at < n:
        m = _TOKEN.match(text, at)
        if not m:
            raise PatternError(f"unexpected {text[at : at + 8]!r}")
        at, k = m.end(), m.lastgroup
        if m["byte"] is not None:
            out, least = out + _byte(m["byte"]), least + 1
        elif m["open"]:
            depth, end = 1, at
            while end < n and depth:
                depth += (text[end] == "(") - (text[end] == ")")
                end += 1
            if depth:
                raise PatternError("a bracket that doesn't close")
            r, size = _alternates(text[at : end - 1], m["open"][0] == "!")
            out, least, at = out + r, least + size, end
        elif m["cls"]:
            r, size = _edge(m["cls"].upper(), bool(m["neg"]), m.start() == 0 and not inner, at == n and not inner)
            out, least = out + r, least + size
        elif inner:
            raise PatternError("gaps can't stand in alternates")
        elif m["any"]:
            out += ".*?"
        elif m["gap"] is not None:
            a, b = _bounds(m["gap"], "gap")
            out, least = out + _repeat(a, b), least + a
        elif m["near"]:
            a, b = _bounds(m["near"], "anchor")
            if b > 32:
                raise PatternError("an anchored byte is at most 32 bytes away")
            out, least = out + _repeat(a, b), least + a
        else:
            raise PatternError(k or "?")
    return out, least


def _edge(kind: str, negated: bool, left: bool, right: bool) -> tuple[str, int]:
    """Boundary, line or word marks: without width at an edge, where the start or end of the object counts too; else they take their bytes."""
    if left:
        yes = {"B": rf"(?<![^{BEFORE}])", "L": r"(?<![^\x0a])", "W": rf"(?<![{LETTERS}])"}[kind]
        no = {"B": rf"(?<=[^{BEFORE}])", "L": r"(?<=[^\x0a])", "W": rf"(?<=[{LETTERS}])"}[kind]
        return (no if negated else yes), 0
    if right:
        yes = {"B": rf"(?![^{AFTER}])", "L": r"(?=\x0d?\x0a|\z)", "W": rf"(?![{LETTERS}])"}[kind]
        no = {"B": rf"(?=[^{AFTER}])", "L": r"(?!\x0d?\x0a|\z)", "W": rf"(?=[{LETTERS}])"}[kind]
        return (no if negated else yes), 0
    yes = {"B": f"[{AFTER}]", "L": r"(?:\x0d\x0a|\x0a)", "W": f"[^{LETTERS}]"}[kind]
    no = {"B": f"[^{AFTER}]", "L": r"[^\x0a]", "W": f"[{LETTERS}]"}[kind]
    return (no if negated else yes), 1


def _wide(text: str) -> str:
    """A zero byte after each byte."""
    return re.sub(r"[0-9a-f?]{2}", lambda m: m[0] + "00", text)


def compile_hex(pattern: str, options: str = "") -> Compiled:
    """``options``: i without regard to case, f whole word, w two-byte characters, a plain as well as wide.

    A hit begins where the first part begins. Gaps have no cap on how many earlier hits of a part are kept in mind.
    """
    text = pattern.strip().lower().replace("(b)", "(B)").replace("(l)", "(L)").replace("(w)", "(W)")
    if not text or re.search(r"(^|[*}])(\*|\{)|[*}]$", text):
        raise PatternError("a gap needs bytes on both sides")
    forms = [text] if "w" not in options or "a" in options else []
    if "w" in options:
        forms.append(_wide(text))
    if "f" in options:
        forms = [f"(W){t}(W)" for t in forms]
    done = [_sequence(t) for t in forms]
    least = min(size for _, size in done)
    if least < MIN_BYTES:
        raise PatternError(f"a pattern has {MIN_BYTES} bytes at least")
    regex = done[0][0] if len(done) == 1 else "(?:" + "|".join(r for r, _ in done) + ")"
    plain = re.fullmatch(r"(?:[0-9a-f]{2})+", text) and not set(options) & set("ifw")
    return Compiled(f"(?i:{regex})" if "i" in options else regex, least, text if plain else None)


@dataclass(frozen=True)
class Offset:
    """Where a match may begin: kind any, abs, eof, ep, section, last, whole (a section) or info; a start and a window's width."""

    kind: str
    start: int = 0
    width: int = 0
    section: int = 0

    def bounds(self, size: Column, exe: Column | None = None) -> tuple[Column, Column] | None:
        """First and last admitted offset. Null where the object has no such place: then nothing matches. None: anywhere."""
        if self.kind == "any":
            return None
        null = F.lit(None).cast("long")
        if self.kind == "abs":
            at = F.lit(self.start).cast("long")
        elif self.kind == "eof":
            at = F.when(size >= self.start, size - self.start)
        elif exe is None or self.kind == "info":
            return null, null
        elif self.kind == "ep":
            at = exe["ep"] + self.start
        else:
            n = F.size(exe["sections"])
            s = F.get(exe["sections"], n - 1 if self.kind == "last" else F.lit(self.section))
            at = s["raw"] + (0 if self.kind == "whole" else self.start)
            if self.kind == "whole":
                return at, at + s["rsz"] + self.width
        return at, at + self.width


    def span(self, size: int, exe: dict | None = None) -> tuple[int, int] | None:
        """The same for one object of ``size`` bytes in Python; None where it has no such place."""
        if self.kind == "any":
            return 0, size
        if self.kind == "abs":
            at = self.start
        elif self.kind == "eof":
            at = size - self.start
        elif exe is None or self.kind == "info":
            return None
        elif self.kind == "ep":
            at = None if exe["ep"] is None else exe["ep"] + self.start
        else:
            sections = exe["sections"] or []
            k = len(sections) - 1 if self.kind == "last" else self.section
            if not 0 <= k < len(sections):
                return None
            at = sections[k]["raw"] + (0 if self.kind == "whole" else self.start)
            if self.kind == "whole":
                return at, at + sections[k]["rsz"] + self.width
        return None if at is None or at < 0 else (at, at + self.width)


def parse_offset(text: str | None) -> Offset:
    """``*``, ``n``, ``EOF-n``, ``EP+n``, ``EP-n``, ``Sx+n``, ``SL+n``, ``SEx``, ``VI``; all but ``*`` take ``,width``."""
    spec = (text or "*").strip()
    if spec == "*":
        return Offset("any")
    spec, _, width = spec.partition(",")
    if width and not width.isdigit():
        raise PatternError(f"offset {text!r}")
    found = Offset("any", width=int(width or 0))
    for form, kind in ((r"([0-9]+)", "abs"), (r"EOF-([0-9]+)", "eof"), (r"EP([+-][0-9]+)", "ep"), (r"SL([+-][0-9]+)", "last"), (r"VI", "info")):
        if m := re.fullmatch(form, spec):
            return replace(found, kind=kind, start=int(m[1]) if m.groups() else 0)
    if m := re.fullmatch(r"S([0-9]+)([+-][0-9]+)", spec):
        return replace(found, kind="section", section=int(m[1]), start=int(m[2]))
    if m := re.fullmatch(r"SE([0-9]+)", spec):
        return replace(found, kind="whole", section=int(m[1]))
    raise PatternError(f"offset {text!r}")


def hits(text: Column, pattern: Compiled, offset: Offset = Offset("any"), size: Column | None = None, exe: Column | None = None) -> Column:
    """Ascending offsets of a byte string where the pattern begins and the offset rule admits it.

    A pattern of plain bytes at one fixed place is probed there, without a search.
    """
    size = F.length(text) if size is None else size
    bounds = offset.bounds(size, exe)
    none = F.array().cast("array<bigint>")
    if bounds is None:
        return raw.match_offsets(text, pattern.regex)
    lo, hi = bounds
    if offset.width == 0 and offset.kind != "whole":
        there = F.substring(text, (lo + 1).cast("int"), 2147483647) if pattern.literal is None else F.substring(text, (lo + 1).cast("int"), F.lit(len(pattern.literal) // 2))
        looks = there.rlike(rf"(?s)\A(?:{pattern.regex})")
        if re.match(r"\(\?<", pattern.regex):  # the edge looks at what lies before
            return F.filter(raw.match_offsets(text, pattern.regex), lambda o: o == lo)
        return F.when((lo >= 0) & (lo < size) & looks, F.array(lo.cast("long"))).otherwise(none)
    if pattern.literal is not None and offset.kind != "whole":  # only the window is searched
        part = F.substring(text, (lo + 1).cast("int"), F.lit(offset.width + len(pattern.literal) // 2))
        return F.coalesce(F.when(lo >= 0, F.transform(raw.match_offsets(part, pattern.regex), lambda o: o + lo)), none)
    return F.coalesce(F.filter(raw.match_offsets(text, pattern.regex), lambda o: o.between(lo, hi)), none)


def count(text: Column, pattern: Compiled) -> Column:
    """At how many offsets the pattern matches. Plain bytes that can't overlap themselves are counted by what is left without them."""
    code = pattern.literal
    if code is not None and not any(code.startswith(code[k:]) for k in range(2, len(code), 2)):
        needle = bytes.fromhex(code).decode("latin-1")
        return (F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)
    return raw.match_count(text, pattern.regex)


def occurs(text: Column, pattern: Compiled) -> Column:
    """Does the pattern match anywhere? Plain bytes need no regular expression."""
    if pattern.literal is not None:
        return text.contains(F.lit(bytes.fromhex(pattern.literal).decode("latin-1")))
    return text.rlike(f"(?s){pattern.regex}")

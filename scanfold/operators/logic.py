"""Logical signatures: expressions over counts of sub-signatures, byte comparisons, triggered regular expressions, macros."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import fields_outside_slashes
from . import patterns

MAX_SUBS = 64
_OPS = {"=": lambda a, b: a == b, "<": lambda a, b: a < b, ">": lambda a, b: a > b}


@dataclass(frozen=True)
class Node:
    """A term: a sub-signature's id or a block, with its test; or two nodes and the operator between them."""

    op: str
    kids: tuple = ()
    ident: int = -1
    test: str = ""
    value: int = 0
    distinct: int = 0


def parse(text: str) -> Node:
    """``&`` and ``|`` have no order of precedence: the first at top level splits, so both are right-associative."""
    at = 0

    def expression() -> Node:
        nonlocal at
        left = term()
        if at < len(text) and text[at] in "&|":
            op = text[at]
            at += 1
            return Node(op, (left, expression()))
        return left

    def term() -> Node:
        nonlocal at
        if at < len(text) and text[at] == "(":
            at += 1
            inner = expression()
            if at >= len(text) or text[at] != ")":
                raise patterns.PatternError(f"a bracket that doesn't close in {text!r}")
            at += 1
            return modified(Node("block", (inner,)), True)
        m = re.match(r"\d+", text[at:])
        if not m:
            raise patterns.PatternError(f"unexpected end or sign in {text!r} at {at}")
        at += m.end()
        return modified(Node("id", ident=int(m[0])), False)

    def modified(node: Node, block: bool) -> Node:
        nonlocal at
        m = re.match(r"([=<>])(\d+)(?:,(\d+))?", text[at:])
        if not m:
            return node
        if m[3] and not block:
            raise patterns.PatternError(f"a count of distinct ids belongs to a block: {text!r}")
        at += m.end()
        return Node(node.op, node.kids, node.ident, m[1], int(m[2]), int(m[3] or 0))

    done = expression()
    if at != len(text):
        raise patterns.PatternError(f"unexpected {text[at:]!r} in {text!r}")
    return done


def ids(node: Node) -> set[int]:
    return {node.ident} if node.op == "id" else set().union(*map(ids, node.kids))


def _eval(node: Node, counts: list[Column]) -> tuple[Column, Column, Column]:
    """Truth, count, and a bit set of distinct ids; what is false has none of the last two."""
    zero = F.lit(0).cast("long")
    only = lambda ok, x: F.when(ok, x).otherwise(zero)
    if node.op == "id":
        n = counts[node.ident]
        ok = _OPS[node.test](n, node.value) if node.test else n > 0
        return ok, only(ok, n), only(ok & (n > 0), F.lit(1 << node.ident if node.ident < 63 else -(1 << 63)).cast("long"))
    if node.op == "block":
        ok, n, bits = _eval(node.kids[0], counts)
        if not node.test:
            return ok, n, bits
        ok = _OPS[node.test](n, node.value) & (F.bit_count(bits) >= node.distinct)
        return ok, only(ok, n), zero  # past a counted block the ids are forgotten
    (a, n, x), (b, m, y) = (_eval(k, counts) for k in node.kids)
    ok = a & b if node.op == "&" else a | b
    return ok, only(ok, n + m), only(ok, x.bitwiseOR(y))


def to_column(node: Node, counts: list[Column]) -> Column:
    """The expression over a count column for each sub-signature."""
    return _eval(node, counts)[0]


@dataclass(frozen=True)
class ByteCompare:
    """``ref(off#opts len#comparisons)``: a number read near the last hit of another sub-signature."""

    ref: int
    shift: int
    base: str
    little: bool
    exact: bool
    length: int
    tests: tuple[tuple[str, int], ...]

    @classmethod
    def parse(cls, text: str) -> ByteCompare:
        m = re.fullmatch(r"(\d+)\(((?:>>|<<)?)(0x[0-9a-fA-F]+|\d*)#([hdia])([lb]?)(e?)(\d+)#([<>=](?:0x[0-9a-fA-F]+|\d+)(?:,[<>=](?:0x[0-9a-fA-F]+|\d+))?)\)", text)
        if not m:
            raise patterns.PatternError(f"byte comparison {text!r}")
        number = lambda s: int(s, 0) if not re.fullmatch("0[0-7]+", s) else int(s, 8)
        n = number(m[3]) if m[3] else 0
        base, length = m[4], int(m[7])
        if base == "i" and 8 % length if length else True:
            raise patterns.PatternError("a binary number has 1, 2, 4 or 8 bytes")
        return cls(int(m[1]), -n if m[2] == "<<" else n, base, m[5] == "l" and base != "d", bool(m[6]), length, tuple((t[0], number(t[1:])) for t in m[8].split(",")))

    def column(self, text: Column, last: Column) -> Column:
        """True where all comparisons hold; the place must lie after the first byte and the number within the object."""
        at = last + self.shift
        part = F.substring(text, (at + 1).cast("int"), F.lit(self.length))
        if self.base == "i":
            pairs = F.hex(F.encode(part, "ISO-8859-1"))
            if self.little:
                pairs = F.array_join(F.reverse(F.regexp_extract_all(pairs, F.lit("(..)"), F.lit(1))), "")
            value = F.conv(pairs, 16, 10).cast("decimal(20,0)")
        else:
            trimmed = F.trim(F.regexp_replace(part, r"[\x00\s]+\z", ""))
            hexa = F.regexp_replace(trimmed, r"(?i)\A0x|h\z", "")
            if self.little:
                hexa = F.array_join(F.reverse(F.regexp_extract_all(hexa, F.lit("(..)"), F.lit(1))), "")
            as_hex = F.when(hexa.rlike(r"\A[0-9A-Fa-f]{1,16}"), F.conv(F.regexp_extract(hexa, r"\A([0-9A-Fa-f]{1,16})", 1), 16, 10).cast("decimal(20,0)"))
            as_dec = F.when(trimmed.rlike(r"\A[0-9]{1,19}"), F.regexp_extract(trimmed, r"\A([0-9]{1,19})", 1).cast("decimal(20,0)"))
            value = {"h": as_hex, "d": as_dec, "a": F.when(trimmed.rlike("(?i)\\A0x"), as_hex).otherwise(as_dec)}[self.base]
            if self.exact:
                whole = {"h": r"(?i)\A[0-9a-f]+\z", "d": r"\A[0-9]+\z", "a": r"(?i)\A(?:0x[0-9a-f]+|[0-9]+)\z"}[self.base]
                value = F.when((F.length(trimmed) == self.length) & trimmed.rlike(whole), value)
        ok = (at > 0) & (at + self.length <= F.length(text))
        for op, n in self.tests:
            ok = ok & _OPS[op](value, F.lit(n).cast("decimal(20,0)"))
        return F.coalesce(ok, F.lit(False))


@dataclass(frozen=True)
class Triggered:
    """``[offset:]trigger/regex/flags``: searched only where the trigger, over earlier sub-signatures, holds."""

    trigger: Node
    regex: str
    flags: str
    offset: patterns.Offset

    def body(self) -> str:
        """The expression with its flags, as Java has it."""
        inline = "".join(f for f in self.flags if f in "ismx")
        body = re.sub(r"(?<!\\)((?:\\\\)*)\$", lambda m: m[1] + (r"\z" if "E" in self.flags else r"(?=\n?\z)"), self.regex) if "m" not in self.flags else self.regex
        if "U" in self.flags:
            body = re.sub(r"(?<!\\)([*+?}])(?![?+*])", r"\1?", body)
        body = f"(?{inline}:{body})" if inline else f"(?:{body})"
        return body

    def count(self, text: Column, counts: list[Column], exe: Column | None = None) -> Column:
        """How many hits count; without an offset rule they aren't located."""
        if self.offset.kind != "any" or "A" in self.flags:
            return F.size(self.offsets(text, counts, exe))
        n = F.regexp_count(text, F.lit(self.body())) if "g" in self.flags else F.when(text.rlike(self.body()), 1).otherwise(0)
        return F.coalesce(F.when(to_column(self.trigger, counts), n), F.lit(0))

    def offsets(self, text: Column, counts: list[Column], exe: Column | None = None) -> Column:
        """Offsets of hits. With g all that follow one another without overlap, else the first.

        At an exact offset the regex is anchored unless r; with a window hits must begin in it, and with e they must end in it as well.
        """
        body = self.body()
        none = F.array().cast("array<bigint>")
        bounds = self.offset.bounds(F.length(text), exe)
        lo = F.lit(0).cast("long") if bounds is None else bounds[0]
        width = self.offset.width
        anchored = "A" in self.flags or (bounds is not None and "r" not in self.flags and not width)
        rest = F.substring(text, (lo + 1).cast("int"), F.lit(width) if width and "e" in self.flags else F.lit(2147483647))
        if anchored:
            found = F.when(rest.rlike(rf"\A{body}"), F.array(lo)).otherwise(none)
        else:
            parts = F.split(rest, body, -1)
            matched = F.regexp_extract_all(rest, F.lit(body), F.lit(0))
            steps = F.zip_with(parts, matched, lambda p, m: (F.length(p) + F.coalesce(F.length(m), F.lit(0))).cast("long"))
            from ..functions.raw import sums_before

            starts = F.zip_with(sums_before(steps), parts, lambda s, p: s + F.length(p) + lo)
            found = F.when(F.size(matched) > 0, F.slice(starts, F.lit(1), F.size(matched) if "g" in self.flags else F.least(F.size(matched), F.lit(1)))).otherwise(none)
            if width and "e" not in self.flags:
                found = F.filter(found, lambda o: o <= lo + width)
        return F.coalesce(F.when(to_column(self.trigger, counts), found), none)


@dataclass(frozen=True)
class Macro:
    """``${min-max}group$``: the sub-signature before must be followed by the group's last hit at that distance."""

    least: int
    most: int
    group: int


@dataclass(frozen=True)
class Body:
    pattern: patterns.Compiled
    offset: patterns.Offset


@dataclass(frozen=True)
class Fuzzy:
    digest: str


def parse_sub(text: str, own: int, default_offset: str = "*"):
    """A sub-signature: macro, regular expression, byte comparison, image hash or bytes, tried in this order."""
    if m := re.fullmatch(r"\$\{(\d+)-(\d+)\}(\d+)\$", text):
        if int(m[3]) >= 32:
            raise patterns.PatternError("macro groups go from 0 to 31")
        return Macro(int(m[1]), int(m[2]), int(m[3]))
    if m := re.fullmatch(r"(?s)(?:([^/]*?):)?([^:/]*)/(.*)/([a-zA-Z]*)", text):
        trigger = parse(m[2])
        if any(i >= own for i in ids(trigger)):
            raise patterns.PatternError("a trigger looks at earlier sub-signatures only")
        if bad := set(m[4]) - set("gresimxAEU"):
            raise patterns.PatternError(f"flags {bad}")
        return Triggered(trigger, m[3], m[4], patterns.parse_offset(m[1]))
    if re.match(r"\d+\(", text):
        return ByteCompare.parse(text)
    if text.startswith("fuzzy_img#"):
        m = re.fullmatch(r"fuzzy_img#([0-9a-fA-F]{16})(?:#(\d+))?", text)
        if not m or int(m[2] or 0):
            raise patterns.PatternError("image hashes have 16 digits and a distance of 0")
        return Fuzzy(m[1].lower())
    text, _, options = text.partition("::")
    offset, colon, body = text.rpartition(":")
    return Body(patterns.compile_hex(body, options), patterns.parse_offset(offset if colon else default_offset))


ATTRIBUTES = {"Engine": "range", "Target": "int", "FileSize": "range", "EntryPoint": "range", "NumberOfSections": "range", "IconGroup1": "str", "IconGroup2": "str", "Container": "str", "HandlerType": "str", "Intermediates": "list"}


@dataclass(frozen=True)
class Logical:
    """A logical signature: name, description block, expression, sub-signatures."""

    name: str
    tdb: dict = field(hash=False)
    logic: Node
    subs: tuple

    @classmethod
    def parse(cls, line: str) -> Logical:
        parts = fields_outside_slashes(line.rstrip("\r\n"), ";", 3)
        if len(parts) < 4:
            raise patterns.PatternError("a name, a description, an expression and a sub-signature are needed")
        name, tdb, logic, subs = parts[0], parse_tdb(parts[1]), parse(parts[2]), parts[3:]
        if len(subs) > MAX_SUBS:
            raise patterns.PatternError(f"more than {MAX_SUBS} sub-signatures")
        if max(ids(logic)) + 1 != len(subs):
            raise patterns.PatternError("the greatest id of the expression doesn't fit the number of sub-signatures")
        return cls(name, tdb, logic, tuple(parse_sub(s, k) for k, s in enumerate(subs)))

    def offsets(self, text: Column, exe: Column | None = None, image_hash: Column | None = None, groups: dict[int, Column] | None = None) -> list[Column]:
        """For each sub-signature the offsets that count. Byte comparisons and image hashes count once, without one."""
        found: list[Column] = []
        counts: list[Column] = []
        none = F.array().cast("array<bigint>")
        for k, sub in enumerate(self.subs):
            if isinstance(sub, Body):
                now = patterns.hits(text, sub.pattern, sub.offset, exe=exe)
            elif isinstance(sub, Triggered):
                now = sub.offsets(text, counts, exe)
            elif isinstance(sub, ByteCompare):
                now = F.when(sub.column(text, F.try_element_at(found[sub.ref], F.lit(-1)) if sub.ref < k else F.lit(None).cast("long")), F.array(F.lit(-1).cast("long"))).otherwise(none)
            elif isinstance(sub, Fuzzy):
                now = F.when(image_hash == sub.digest, F.array(F.lit(-1).cast("long"))).otherwise(none) if image_hash is not None else none
            else:
                last = F.try_element_at(found[k - 1], F.lit(-1)) if k else F.lit(None).cast("long")
                mark = F.try_element_at((groups or {}).get(sub.group, none), F.lit(-1))
                ok = F.coalesce(mark.between(last + sub.least, last + sub.most), F.lit(False))
                now = F.when(ok, F.array(mark)).otherwise(none)
                if k:
                    found[k - 1] = F.when(ok, found[k - 1]).otherwise(none)
                    counts[k - 1] = F.size(found[k - 1]).cast("long")
            found.append(now)
            counts.append(F.size(now).cast("long"))
        return found

    def fires(self, text: Column, **where: object) -> Column:
        """The expression over the counts of all sub-signatures. What only has to occur is not counted, and what nothing refers to is counted without being located."""
        if all(isinstance(s, Body) and s.offset.kind == "any" for s in self.subs) and not _counted(self.logic):
            counts = [F.when(patterns.occurs(text, s.pattern), F.lit(1)).otherwise(0).cast("long") for s in self.subs]
        elif any(isinstance(s, (ByteCompare, Macro)) for s in self.subs):
            counts = [F.size(o).cast("long") for o in self.offsets(text, **where)]
        else:
            counts, exe, image = [], where.get("exe"), where.get("image_hash")
            for s in self.subs:
                if isinstance(s, Body):
                    n = patterns.count(text, s.pattern) if s.offset.kind == "any" else F.size(patterns.hits(text, s.pattern, s.offset, exe=exe))
                elif isinstance(s, Triggered):
                    n = s.count(text, counts, exe)
                else:
                    n = F.when(image == s.digest, 1).otherwise(0) if image is not None else F.lit(0)
                counts.append(n.cast("long"))
        return F.coalesce(to_column(self.logic, counts), F.lit(False))

    def admits(self, obj: Column) -> Column:
        """The description block against an object's size, exe header, container and ancestors."""
        ok = F.lit(True)
        ranges = (("FileSize", lambda: obj["size"]), ("EntryPoint", lambda: obj["exe"]["ep"]), ("NumberOfSections", lambda: obj["exe"]["nsections"]))
        for key, value in ranges:
            if key in self.tdb:
                ok = ok & F.coalesce(value().between(*self.tdb[key]), F.lit(False))
        if "Container" in self.tdb:
            ok = ok & (F.coalesce(F.try_element_at(obj["ancestor_types"], F.lit(-1)), F.lit("")) == self.tdb["Container"])
        if "Intermediates" in self.tdb:
            ok = ok & intermediates(obj["ancestor_types"], self.tdb["Intermediates"])
        return ok


def _counted(node: Node) -> bool:
    return bool(node.test) and (node.test, node.value) not in (("=", 0), (">", 0)) or any(map(_counted, node.kids)) or (node.op == "block" and bool(node.test))


def intermediates(ancestors: Column, wanted: list[str]) -> Column:
    """The layers around an object, from the outermost: they must begin with the named types. ANY asks for nothing and takes no layer."""
    names = [w for w in wanted if w != "ANY"]
    return F.slice(F.coalesce(ancestors, F.array().cast("array<string>")), F.lit(1), F.lit(len(names))) == F.array(*map(F.lit, names)) if names else F.lit(True)


def parse_tdb(text: str) -> dict:
    """Attributes ``key:value`` or ``key:low-high``, comma-separated. Target is mandatory and Engine comes first; an unknown one is refused."""
    out: dict = {}
    for k, item in enumerate(text.split(",")):
        key, _, value = item.partition(":")
        kind = ATTRIBUTES.get(key)
        if not kind or (key == "Engine" and k):
            raise patterns.PatternError(f"attribute {item!r}")
        if kind == "range":
            lo, _, hi = value.partition("-")
            out[key] = (int(lo), int(hi or lo))
        elif kind == "int":
            out[key] = int(value)
        else:
            out[key] = value.split(">") if kind == "list" else value
    if "Target" not in out:
        raise patterns.PatternError("Target is missing")
    if "IconGroup1" in out and out["Target"] != 1:
        raise patterns.PatternError("icon groups are for executables")
    return out

"""Text rules: strings and a condition, compiled to a column. A subset of the rule language with tags, modifiers, offsets, counts and loops."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import raw
from .patterns import PatternError, compile_hex

TOKEN = re.compile(r"\s+|//[^\n]*|/\*.*?\*/|(?P<num>0x[0-9a-fA-F]+|\d+(?:KB|MB)?)|(?P<str>[$#@]\w*\*?)|(?P<word>[A-Za-z_]\w*)|(?P<quote>\"(?:\\.|[^\"\\])*\")|(?P<re>/(?:\\.|[^/\\\n])+/[ismx]*)|(?P<op>\.\.|<<|>>|<=|>=|==|!=|[-+*\\%&|^~<>(),:.\[\]])", re.S)
READ = {f"{s}int{b}{e}": (s == "", b // 8, e == "be") for s in ("", "u") for b in (8, 16, 32) for e in ("", "be")}


@dataclass(frozen=True)
class Rule:
    name: str
    tags: tuple[str, ...]
    meta: dict
    strings: dict  # id -> regex
    condition: str


def _text_regex(text: str, mods: set[str]) -> str:
    data = re.sub(rb"\\(x[0-9a-fA-F]{2}|.)", lambda m: bytes([int(m[1][1:], 16)]) if m[1][:1] == b"x" and len(m[1]) == 3 else {b"n": b"\n", b"t": b"\t", b"r": b"\r"}.get(m[1], m[1]), text.encode("utf-8"))
    forms = []
    if "wide" not in mods or "ascii" in mods:
        forms.append("".join(f"\\x{b:02x}" for b in data))
    if "wide" in mods:
        forms.append("".join(f"\\x{b:02x}\\x00" for b in data))
    out = forms[0] if len(forms) == 1 else "(?:" + "|".join(forms) + ")"
    if "fullword" in mods:
        out = rf"(?<![A-Za-z0-9]){out}(?![A-Za-z0-9])"
    return f"(?i:{out})" if "nocase" in mods else out


def _braced(source: str, at: int) -> str:
    """What lies between an opening bracket and its closing one; those in quoted strings don't count."""
    depth, k, quoted = 1, at, False
    while k < len(source) and depth:
        c = source[k]
        if c == "\\":
            k += 1
        elif c == '"':
            quoted = not quoted
        elif not quoted:
            depth += (c == "{") - (c == "}")
        k += 1
    if depth:
        raise PatternError("a rule that doesn't end")
    return source[at : k - 1]


def parse_rules(source: str) -> list[Rule]:
    """All rules of a text. Private and global are read and ignored; imports, includes and modules are refused."""
    source = re.sub(r"/\*.*?\*/", " ", source, flags=re.S)
    out = []
    if re.search(r"^\s*(import|include)\b", source, re.M):
        raise PatternError("imports aren't supported")
    for m in re.finditer(r"\brule\s+(\w+)\s*(?::\s*([\w\s]+?))?\s*\{", source):
        name, tags, body = m[1], m[2], _braced(source, m.end())
        cut = re.search(r"\bcondition\s*:", body)
        if not cut:
            raise PatternError(f"rule {name} has no condition")
        head, condition = body[: cut.start()], body[cut.end() :].strip()
        meta_part, _, strings_part = head.partition("strings:") if "strings:" in head else (head, "", "")
        meta = {k: v.strip('"') for k, v in re.findall(r"^\s*(\w+)\s*=\s*(\"[^\"]*\"|\w+)\s*$", meta_part, re.M)}
        strings: dict = {}
        for s in re.finditer(r"(\$\w*)\s*=\s*(?:\"((?:\\.|[^\"\\])*)\"|/((?:\\.|[^/\\\n])+)/([ismx]*)|\{([^}]*)\})((?:\s+(?:nocase|wide|ascii|fullword|private))*)", strings_part):
            key = s[1] if s[1] != "$" else f"${len(strings)}"
            mods = set(s[6].split())
            if s[2] is not None:
                if len(s[2]) < 2:
                    raise PatternError(f"{name}: string {key} is too short")
                strings[key] = _text_regex(s[2], mods)
            elif s[3] is not None:
                flags = s[4] + ("i" if "nocase" in mods and "i" not in s[4] else "")
                body_re = f"(?{flags}:{s[3]})" if flags else f"(?:{s[3]})"
                strings[key] = rf"(?<![A-Za-z0-9]){body_re}(?![A-Za-z0-9])" if "fullword" in mods else body_re
            else:
                code = re.sub(r"\s+", "", s[5]).replace("[", "{").replace("]", "}")
                strings[key] = compile_hex(code).regex
        out.append(Rule(name, tuple((tags or "").split()), meta, strings, condition))
    return out


class _Condition:
    """Recursive descent over a condition; undefined values are null, and a rule's null is false."""

    def __init__(self, rule: Rule, text: Column, offsets: dict[str, Column], exe: Column | None, others: dict[str, Column]):
        self.rule, self.text, self.offsets, self.exe, self.others = rule, text, offsets, exe, others
        self.tokens = [(m.lastgroup, m[0]) for m in TOKEN.finditer(rule.condition) if m.lastgroup]
        self.at, self.vars, self.current = 0, {}, None

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else None

    def take(self, want: str | None = None) -> str:
        if self.at >= len(self.tokens) or (want is not None and self.tokens[self.at][1] != want):
            raise PatternError(f"rule {self.rule.name}: expected {want!r}, found {self.peek()!r}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self) -> Column:
        out = self.either()
        if self.peek() is not None:
            raise PatternError(f"rule {self.rule.name}: unexpected {self.peek()!r}")
        return F.coalesce(out, F.lit(False))

    def either(self) -> Column:
        out = self.both()
        while self.peek() == "or":
            self.take()
            out = F.coalesce(out, F.lit(False)) | F.coalesce(self.both(), F.lit(False))
        return out

    def both(self) -> Column:
        out = self.no()
        while self.peek() == "and":
            self.take()
            out = F.coalesce(out, F.lit(False)) & F.coalesce(self.no(), F.lit(False))
        return out

    def no(self) -> Column:
        if self.peek() == "not":
            self.take()
            return ~F.coalesce(self.no(), F.lit(False))
        return self.compared()

    def compared(self) -> Column:
        start = self.at
        if self.peek() in ("all", "any", "none", "for") or (self.at + 1 < len(self.tokens) and self.tokens[self.at][0] == "num" and self.tokens[self.at + 1][1] == "of"):
            return self.some()
        if self.peek() == "(":
            try:
                return self._relation(self.sum())
            except PatternError:
                self.at = start
            self.take("(")
            out = self.either()
            self.take(")")
            return out
        kind, word = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        if kind == "str" and word[0] == "$":
            self.take()
            found = self._offsets(word)
            if self.peek() == "at":
                self.take()
                return F.array_contains(found, self.sum().cast("long"))
            if self.peek() == "in":
                self.take()
                lo, hi = self.span()
                return F.exists(found, lambda o: o.between(lo, hi))
            return F.size(found) > 0
        if word in ("true", "false"):
            self.take()
            return F.lit(word == "true")
        if kind == "word" and word in self.others:
            self.take()
            return self.others[word]
        return self._relation(self.sum())

    def _relation(self, left: Column) -> Column:
        op = self.peek()
        if op in ("<", ">", "<=", ">=", "==", "!="):
            self.take()
            right = self.sum()
            return {"<": left < right, ">": left > right, "<=": left <= right, ">=": left >= right, "==": left == right, "!=": left != right}[op]
        if op in ("contains", "matches"):
            raise PatternError("modules have no fields here")
        return left != 0

    def span(self) -> tuple[Column, Column]:
        self.take("(")
        lo = self.sum()
        self.take("..")
        hi = self.sum()
        self.take(")")
        return lo, hi

    def _offsets(self, word: str) -> Column:
        if word == "$" and self.current is not None:
            return self.current
        if word not in self.offsets:
            raise PatternError(f"rule {self.rule.name}: no string {word}")
        return self.offsets[word]

    def set_of(self) -> list[Column]:
        if self.peek() == "them":
            self.take()
            return list(self.offsets.values())
        self.take("(")
        out = []
        while True:
            w = self.take()
            out += [o for k, o in self.offsets.items() if k.startswith(w[:-1])] if w.endswith("*") else [self._offsets(w)]
            if self.peek() != ",":
                break
            self.take()
        self.take(")")
        return out

    def _enough(self, quantity, truths: list[Column]) -> Column:
        n = sum((F.when(F.coalesce(t, F.lit(False)), 1).otherwise(0) for t in truths), F.lit(0))
        return {"all": n == len(truths), "any": n >= 1, "none": n == 0}[quantity] if isinstance(quantity, str) else n >= quantity

    def some(self) -> Column:
        loop = self.peek() == "for"
        if loop:
            self.take()
        q = self.take() if self.peek() in ("all", "any", "none") else self.sum()
        if loop and self.peek() != "of":
            name = self.take()
            self.take("in")
            lo, hi = self.span()
            self.take(":")
            self.take("(")
            begin = self.at
            items = F.sequence(lo.cast("long"), hi.cast("long"))

            def body(x: Column) -> Column:
                self.at = begin
                self.vars[name] = x
                out = F.coalesce(self.either(), F.lit(False))
                del self.vars[name]
                return out

            hits = F.size(F.filter(items, body))
            self.take(")")
            return {"all": hits == F.size(items), "any": hits >= 1, "none": hits == 0}[q] if isinstance(q, str) else hits >= q
        self.take("of")
        sets = self.set_of()
        if loop:
            self.take(":")
            self.take("(")
            begin, truths = self.at, []
            for s in sets:
                self.at, self.current = begin, s
                truths.append(self.either())
            self.current = None
            self.take(")")
            return self._enough(q, truths)
        return self._enough(q, [F.size(s) > 0 for s in sets])

    def sum(self) -> Column:
        out = self.term()
        while self.peek() in ("+", "-", "<<", ">>", "&", "|", "^"):
            op, right = self.take(), self.term()
            if op in ("<<", ">>"):
                out = F.call_function("shiftleft" if op == "<<" else "shiftright", out.cast("long"), right.cast("int"))
            else:
                out = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "&": lambda a, b: a.bitwiseAND(b), "|": lambda a, b: a.bitwiseOR(b), "^": lambda a, b: a.bitwiseXOR(b)}[op](out, right)
        return out

    def term(self) -> Column:
        out = self.atom()
        while self.peek() in ("*", "\\", "%"):
            op, right = self.take(), self.atom()
            out = out * right if op == "*" else F.when(right != 0, F.floor(out / right) if op == "\\" else out % right)
        return out

    def atom(self) -> Column:
        kind, word = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        if word == "(":
            self.take()
            out = self.sum()
            self.take(")")
            return out
        if word == "-":
            self.take()
            return -self.atom()
        if kind == "num":
            self.take()
            n = int(word, 16) if word.startswith("0x") else int(re.match(r"\d+", word)[0]) << {"KB": 10, "MB": 20}.get(word[-2:], 0)
            return F.lit(n).cast("long")
        if word == "filesize":
            self.take()
            return F.length(self.text).cast("long")
        if word == "entrypoint":
            self.take()
            return self.exe["ep"] if self.exe is not None else F.lit(None).cast("long")
        if kind == "str" and word[0] == "#":
            self.take()
            return F.size(self._offsets("$" + word[1:])).cast("long")
        if kind == "str" and word[0] == "@":
            self.take()
            k = F.lit(1)
            if self.peek() == "[":
                self.take()
                k = self.sum().cast("int")
                self.take("]")
            return F.get(self._offsets("$" + word[1:]), k - 1)
        if word in READ:
            self.take()
            self.take("(")
            at = self.sum()
            self.take(")")
            signed, size, big = READ[word]
            h = F.hex(F.encode(F.substring(self.text, (at + 1).cast("int"), F.lit(size)), "ISO-8859-1"))
            if not big:
                h = F.array_join(F.reverse(F.regexp_extract_all(h, F.lit("(..)"), F.lit(1))), "")
            v = F.when((at >= 0) & (F.length(h) == 2 * size), F.conv(h, 16, 10).cast("long"))
            return F.when(v >= 1 << (8 * size - 1), v - (1 << (8 * size))).otherwise(v) if signed else v
        if kind == "word" and word in self.vars:
            self.take()
            return self.vars[word]
        raise PatternError(f"rule {self.rule.name}: unexpected {word!r}")


def matches(objects: DataFrame, rules: list[Rule], *, id_col: str = "object_id", content: str = "content") -> DataFrame:
    """(object, name) of the rules that hold. Every string's offsets are a column; rules may name those before them."""
    rows = objects.select(id_col, raw.byte_text(content).alias("_t"), *(["exe"] if "exe" in objects.columns else []))
    exe = F.col("exe") if "exe" in objects.columns else None
    done: dict[str, Column] = {}
    for r in rules:
        offsets = {k: raw.match_offsets("_t", v) for k, v in r.strings.items()}
        done[r.name] = _Condition(r, F.col("_t"), offsets, exe, dict(done)).whole()
    fired = [F.when(c, F.lit(n)) for n, c in done.items()]
    return rows.select(id_col, F.explode(F.filter(F.array(*fired), lambda n: n.isNotNull())).alias("name"))

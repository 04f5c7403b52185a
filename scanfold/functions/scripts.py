"""Script text: tokens, folded strings, unpacked code, in Arrow batches."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

from .raw import col

_TOKEN = re.compile(r"//[^\n]*|/\*.*?\*/|(?P<s>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')|(?P<w>[A-Za-z_$][\w$]*)|(?P<n>\d[\w.]*)|(?P<p>\S)|\s+", re.S)
_KEYWORDS = frozenset("break case catch const continue debugger default delete do else false finally for function if in instanceof let new null return switch this throw true try typeof undefined var void while with".split())
_KNOWN = frozenset("document window eval unescape escape String Array Math Date RegExp parseInt parseFloat fromCharCode charAt charCodeAt substring substr replace split join length write writeln location".split())


def _value(literal: str) -> str:
    def one(m: re.Match) -> str:
        x = m[1]
        if x[0] in "xu" and len(x) > 1:
            return chr(int(x[1:], 16))
        return {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0"}.get(x, x)

    return re.sub(r"\\(x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|.)", one, literal[1:-1], flags=re.S)


def _unescaped(text: str) -> str:
    return re.sub(r"%(?:u([0-9a-fA-F]{4})|([0-9a-fA-F]{2}))", lambda m: chr(int(m[1] or m[2], 16)), text)


def _quoted(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'


def unpacked(packed: str, base: int, count: int, words: list[str]) -> str:
    """The plain code of a packer that numbers words in a base up to 62."""
    digits = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def number(token: str) -> int:
        n = 0
        for c in token:
            d = digits.find(c)
            if d < 0 or d >= base:
                return -1
            n = n * base + d
        return n

    return re.sub(r"\b\w+\b", lambda m: words[k] if 0 <= (k := number(m[0])) < min(count, len(words)) and words[k] else m[0], packed)


_PACKER = re.compile(r"eval\(function\(p,a,c,k,e,[dr]\)\{.*?\}\(\s*('(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")\s*,\s*(\d+)\s*,\s*(\d+)\s*,\s*('(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")\.split\(['\"]\|['\"]\).*?\)\)", re.S)


def normalize_script(text: str, depth: int = 16) -> str:
    """Comments and needless blanks out, strings in double quotes and folded over ``+``, unescape of a literal resolved, packed and evaluated literals inlined, own names numbered in order."""
    if depth:
        text = _PACKER.sub(lambda m: normalize_script(unpacked(_value(m[1]), int(m[2]), int(m[3]), _value(m[4]).split("|")), depth - 1), text)
    out: list[tuple[str, str]] = []
    for m in _TOKEN.finditer(text):
        if m.lastgroup == "s":
            out.append(("s", _value(m[0])))
        elif m.lastgroup:
            out.append((m.lastgroup, m[0]))
        while len(out) >= 3 and out[-3][0] == "s" and out[-2][1] == "+" and out[-1][0] == "s":
            out[-3:] = [("s", out[-3][1] + out[-1][1])]
        if len(out) >= 4 and out[-1][1] == ")" and out[-2][0] == "s" and out[-3][1] == "(":
            if out[-4][1] == "unescape":
                out[-4:] = [("s", _unescaped(out[-2][1]))]
            elif out[-4][1] == "eval" and depth:
                out[-4:] = [("raw", normalize_script(out[-2][1], depth - 1))]
    names: dict[str, str] = {}
    shown: list[str] = []
    last = ""
    for k, (kind, value) in enumerate(out):
        if kind == "w" and value not in _KEYWORDS and value not in _KNOWN and not (k and out[k - 1][1] == "."):
            value = names.setdefault(value, f"n{len(names):03d}")
        piece = _quoted(value) if kind == "s" else value
        if shown and re.match(r"[\w$]", piece) and re.search(r"[\w$]\Z", last):
            shown.append(" ")
        shown.append(piece)
        last = piece
    return "".join(shown)


def _normal(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else normalize_script(t) for t in text], dtype=object)


def normalized(text: Column | str) -> Column:
    return pandas_udf(_normal, "string")(col(text))

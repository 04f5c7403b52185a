"""String, hash, encoding and number functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .raw import byte_text, col, once

DIGESTS = {"md5": F.md5, "sha1": F.sha1, "sha256": lambda c: F.sha2(c, 256), "sha384": lambda c: F.sha2(c, 384), "sha512": lambda c: F.sha2(c, 512)}
ALGORITHM = {32: "md5", 40: "sha1", 64: "sha256"}


def digest(content: Column | str, algorithm: str = "sha256") -> Column:
    return DIGESTS[algorithm](col(content).cast("binary"))


def normalize_text(content: Column | str) -> Column:
    """Lower-case ASCII with white space runs as single blanks; other controls and bytes from 0x80 on are dropped, 0x7f stays out as well."""
    kept = F.regexp_replace(byte_text(content), r"[^\x09-\x0d\x20-\x7e]", "")
    return F.translate(F.regexp_replace(kept, r"[\x09-\x0d\x20]+", " "), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_type(content: Column | str) -> Column:
    """ASCII, then UTF-8, then UTF-16 either way, else binary data; control characters that text doesn't hold decide."""
    utf16 = lambda low: rf"(?s)\A(?:{low})+.?\z"
    plain = r"[\x07-\x0d\x1b\x20-\x7e]"
    return once(byte_text(content), lambda b: (
        F.when(b.rlike(rf"(?s)\A{plain}*\z"), "TEXT_ASCII")
        .when(~b.rlike(r"[\x00-\x06\x0e-\x1a\x1c-\x1f\x7f]") & b.rlike(r"(?s)\A(?:[\x00-\x7f]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})*+\z"), "TEXT_UTF8")
        .when(b.rlike(utf16(rf"{plain}\x00|\xff\xfe")), "TEXT_UTF16LE")
        .when(b.rlike(utf16(rf"\x00{plain}|\xfe\xff")), "TEXT_UTF16BE")
        .otherwise("BINARY_DATA")
    ))


def bom(content: Column | str) -> Column:
    """The encoding that the first bytes announce."""
    h = F.hex(F.substring(col(content).cast("binary"), 1, 4))
    return (
        F.when(h.isin("0000FEFF", "0000003C"), "UCS-4BE").when(h.isin("FFFE0000", "3C000000"), "UCS-4LE")
        .when(h.startswith("FEFF") | h.startswith("003C003F"), "UTF-16BE").when(h.startswith("FFFE") | h.startswith("3C003F00"), "UTF-16LE")
        .when(h.startswith("EFBBBF"), "UTF-8").when(h.startswith("4C6FA794"), "EBCDIC")
    )


def to_utf8(content: Column | str, charset: str) -> Column:
    """Text of a code page, of UTF-16 with ``UTF-16LE`` or ``UTF-16BE``, as a string."""
    return F.decode(col(content).cast("binary"), charset)


def lenient_utf8(content: Column | str) -> Column:
    """Bytes as text, what isn't UTF-8 replaced."""
    return F.make_valid_utf8(col(content).cast("binary").cast("string"))


def utf16_ascii(content: Column | str) -> Column:
    """The lower bytes of UTF-16LE text."""
    return F.regexp_replace(byte_text(content), r"(?s)(.)(.)", "$1")


def field(line: Column | str, number: int, mark: str) -> Column:
    """Field ``number``, from 0; null beyond the last."""
    parts = F.split(col(line), f"\\Q{mark}\\E", -1)
    return F.get(parts, F.lit(number))


def fields_outside_slashes(line: str, mark: str, skip: int = 0) -> list[str]:
    """Split where ``mark`` doesn't stand in a /pattern/; that is looked for after ``skip`` fields. A slash after a backslash is no delimiter."""
    out, now, inside = [], "", False
    for k, c in enumerate(line):
        if c == "/" and len(out) >= skip and (k == 0 or line[k - 1] != "\\"):
            inside = not inside
        if c == mark and not inside:
            out.append(now)
            now = ""
        else:
            now += c
    return [*out, now]


def ends_with_nocase(text: Column | str, suffix: str) -> Column:
    return F.lower(col(text)).endswith(suffix.lower())


def chomp(text: Column | str) -> Column:
    return F.regexp_replace(col(text), r"[\r\n]+\z", "")


def is_number(text: Column | str) -> Column:
    return col(text).rlike(r"\A[0-9]+\z")


def hex_number(text: Column | str) -> Column:
    """The value of up to 15 hexadecimal digits, else null."""
    return F.when(col(text).rlike(r"\A[0-9A-Fa-f]{1,15}\z"), F.conv(col(text), 16, 10).cast("long"))


def basename(path: Column | str) -> Column:
    """What follows the last slash, or backslash; null when nothing does."""
    name = F.regexp_extract(col(path), r"([^/\\]*)\z", 1)
    return F.when(name != "", name)


def sanitized_path(path: Column | str) -> Column:
    """A relative path without empty, ``.`` and ``..`` components."""
    parts = F.filter(F.split(F.replace(col(path), F.lit("\\"), F.lit("/")), "/", -1), lambda p: ~p.isin("", ".", ".."))
    return F.array_join(parts, "/")


def unescape(text: Column | str) -> Column:
    """``%xx`` and ``%uxxxx`` as characters; an incomplete one stays, and a zero becomes 1.

    The text is cut before each sign; only pieces that begin with a whole escape change.
    """
    def one(p: Column) -> Column:
        wide, narrow = p.rlike(r"(?s)\A%u[0-9A-Fa-f]{4}"), p.rlike(r"(?s)\A%[0-9A-Fa-f]{2}")
        code = F.conv(F.when(wide, F.substring(p, 3, 4)).otherwise(F.substring(p, 2, 2)), 16, 10).cast("int")
        code = F.when(code == 0, 1).otherwise(code)
        return F.when(wide, F.concat(_character(code), F.substring(p, 7, 2147483647))).when(narrow, F.concat(_character(code), F.substring(p, 4, 2147483647))).otherwise(p)

    return F.array_join(F.transform(F.split(col(text), "(?=%)", -1), one), "")


def _character(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")


def normalize_escapes(text: Column | str) -> Column:
    """Backslash escapes of C strings: b f n r t v, quotes, slash and the backslash itself."""
    out = F.regexp_replace(col(text), r"\\([\"'/\\])", "$1")
    for sign, to in (("b", "\b"), ("f", "\f"), ("n", "\n"), ("r", "\r"), ("t", "\t"), ("v", "\v")):
        out = F.regexp_replace(out, rf"\\{sign}", to)
    return out


ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "nbsp": "\u00a0", "copy": "\u00a9", "reg": "\u00ae", "euro": "\u20ac", "hellip": "\u2026", "mdash": "\u2014", "ndash": "\u2013", "eacute": "\u00e9", "agrave": "\u00e0", "uuml": "\u00fc", "ouml": "\u00f6", "auml": "\u00e4", "szlig": "\u00df", "ntilde": "\u00f1", "ccedil": "\u00e7"}


def entities(text: Column | str) -> Column:
    """Named, decimal and hexadecimal character references as characters; unknown names stay, in lower case."""
    table = F.create_map(*(F.lit(x) for kv in ENTITIES.items() for x in kv))

    def one(p: Column) -> Column:
        name, rest = F.lower(F.regexp_extract(p, r"(?s)\A&([^;&\s]{1,32});(.*)\z", 1)), F.regexp_extract(p, r"(?s)\A&([^;&\s]{1,32});(.*)\z", 2)
        hexa, deci = name.rlike(r"\A#x[0-9a-f]{1,4}\z"), name.rlike(r"\A#[0-9]{1,5}\z")
        code = F.when(hexa, F.conv(F.substring(name, 3, 9), 16, 10).cast("int")).when(deci, F.substring(name, 2, 9).cast("int"))
        known = F.coalesce(F.when((code > 0) & (code < 65536), _character(code)), F.element_at(table, name), F.concat(F.lit("&"), name, F.lit(";")))
        return F.when(name == "", p).otherwise(F.concat(known, rest))

    return F.array_join(F.transform(F.split(col(text), "(?=&)", -1), one), "")


def version_key(version: Column | str) -> Column:
    """A dotted version as an array of longs, which compares as versions do; what isn't a digit ends a number."""
    return F.transform(F.split(col(version), r"\.", -1), lambda p: F.coalesce(F.regexp_extract(p, r"\A(\d{1,15})", 1).try_cast("long"), F.lit(0).cast("long")))


def version_compare(a: Column | str, b: Column | str) -> Column:
    """-1, 0 or 1. Missing numbers count as 0."""
    x, y = version_key(a), version_key(b)
    n = F.greatest(F.size(x), F.size(y))
    padded = lambda v: F.concat(v, F.array_repeat(F.lit(0).cast("long"), n - F.size(v)))
    signs = F.filter(F.zip_with(padded(x), padded(y), lambda p, q: F.signum(p - q).cast("int")), lambda s: s != 0)
    return F.coalesce(F.get(signs, F.lit(0)), F.lit(0))


def signature_norm(name: Column | str) -> Column:
    """A signature's name without the mark of an unofficial table or a trailing clause in braces."""
    return F.regexp_replace(col(name), r"(?:\.UNOFFICIAL|\.\{[^}]*\})\z", "")


def published_name(name: Column | str, official: Column | bool) -> Column:
    """The name as it is reported: cut at a bracketed remark, and marked when its table isn't official."""
    cut = F.regexp_replace(col(name), r" \([^)]*\).*\z", "")
    return F.when(F.lit(official) if isinstance(official, bool) else official, cut).otherwise(F.concat(cut, F.lit(".UNOFFICIAL")))


def hash32(key: Column | str) -> Column:
    """A mix of 32-bit keys by shifts and sums, as a long from 0 on."""
    low = lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF))
    k = low(F.bitwise_not(col(key).cast("long")) + F.shiftleft(col(key).cast("long"), 15))
    k = k.bitwiseXOR(F.shiftright(k, 12))
    k = low(k + F.shiftleft(k, 2))
    k = k.bitwiseXOR(F.shiftright(k, 4))
    k = low(k * 2057)
    return k.bitwiseXOR(F.shiftright(k, 16))

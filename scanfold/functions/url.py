"""Links: host, domain, canonical form, host suffixes and path prefixes, and the ordered check of a link's two faces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .raw import col
from .text import unescape

#: Generic and country top-level names that tests and defaults use; both sets are parameters.
GENERIC = ("com", "net", "org", "edu", "gov", "mil", "int", "info", "biz", "name", "pro", "aero", "coop", "museum", "arpa", "co", "ac", "app", "dev", "online", "shop", "site", "xyz")
COUNTRY = ("ac", "at", "au", "be", "br", "ca", "ch", "cl", "cn", "co", "cz", "de", "dk", "es", "eu", "fi", "fr", "gr", "hk", "hu", "ie", "il", "in", "io", "it", "jp", "kr", "mx", "nl", "no", "nz", "pl", "pt", "ro", "ru", "se", "sg", "tr", "tw", "ua", "uk", "us", "za")
PROTOCOL = r"(?:https?|ftp|mailto)"
COMPONENTS = 5


def protocol_free(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, 2147483647)).otherwise(F.regexp_replace(url, r"\Amailto:", ""))


def host(url: Column | str) -> Column:
    """What lies between the protocol and the first colon, slash or question mark, after the last user name."""
    head = F.regexp_extract(protocol_free(col(url)), r"\A((?:[^:/?@]*@)*[^:/?]*)", 1)
    return F.substring_index(head, "@", -1)


def has_user(url: Column | str, tlds: tuple[str, ...] = GENERIC + COUNTRY) -> Column:
    """Does a name with a top-level domain stand before an @ in the host part?"""
    head = F.regexp_extract(protocol_free(col(url)), r"\A((?:[^:/?@]*@)+)[^:/?]*", 1)
    return (head != "") & F.lower(F.substring_index(F.regexp_extract(protocol_free(col(url)), r"\A([^/?]*)", 1), ".", -1)).isin(*tlds)


def domain(host_name: Column | str, generic: tuple[str, ...] = GENERIC, country: tuple[str, ...] = COUNTRY) -> Column:
    """The registrable part: two labels, or three below a country whose second label is a generic name."""
    labels = F.split(col(host_name), r"\.", -1)
    n = F.size(labels)
    last, second = F.try_element_at(labels, F.lit(-1)), F.try_element_at(labels, F.lit(-2))
    two, three = F.array_join(F.slice(labels, -2, 2), "."), F.when(n >= 3, F.array_join(F.slice(labels, -3, 3), ".")).otherwise(col(host_name))
    return F.when(n < 2, col(host_name)).when(last.isin(*country) & second.isin(*generic), three).otherwise(two)


def is_numeric(host_name: Column | str) -> Column:
    """Four numbers from 0 to 256, as the rule this follows has it."""
    parts = F.split(col(host_name), r"\.", -1)
    ok = col(host_name).rlike(r"\A\d{1,3}(?:\.\d{1,3}){3}\z")
    return F.when(ok, F.forall(parts, lambda p: p.try_cast("int") <= 256)).otherwise(False)


def is_ssl(url: Column | str) -> Column:
    return col(url).startswith("https:")


def is_url(text: Column | str, tlds: tuple[str, ...] = GENERIC + COUNTRY, any_protocol: bool = False) -> Column:
    """A known protocol, or any if so asked, with something behind it; or a dotted name under a known top-level domain."""
    proto = r"[A-Za-z][A-Za-z0-9+.-]*" if any_protocol else PROTOCOL
    known = F.lower(F.regexp_extract(col(text), r"(?i)\A\s*(?:[A-Za-z0-9_%@-]+\.)+([A-Za-z]{2,})(?:[:/?][^\s]*)?\s*\z", 1)).isin(*tlds)
    return col(text).rlike(rf"(?i)\A\s*{proto}:(?://)?[^\s/]+") | known


def is_numeric_url(text: Column | str) -> Column:
    return col(text).rlike(r"(?i)\A *(?:https?:(?://)?)?[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?:[:/?].*)?\z")


def cleaned(url: Column | str) -> Column:
    """Protocol and host alone: blanks out, backslashes turned, the host in lower case, brackets, quotes and escapes resolved."""
    u = F.trim(F.replace(F.regexp_replace(col(url), r"[\u0080-￿]", ""), F.lit("\\"), F.lit("/")))
    head = F.regexp_extract(u, r"\A([^:]*:/*)?", 1)
    name = F.lower(F.regexp_extract(F.substring(u, F.length(head) + 1, 2147483647), r"\A([^:/?]*)", 1))
    plain = F.regexp_replace(F.regexp_replace(F.concat(head, name), "[<>\";]", " "), "(?i)&[lg]t", "")
    return F.regexp_replace(unescape(plain), r"\s+", "")


def shown(url: Column | str) -> Column:
    """A link's text, cleaned, without what isn't a letter or digit around it."""
    return F.regexp_replace(cleaned(url), r"\A[^A-Za-z0-9]+|[^A-Za-z0-9/]+\z", "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once and named, so that the expression doesn't grow with its uses."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated(text: Column, rounds: Column, step: Callable[[Column], Column]) -> Column:
    """``step`` so many times over; none leaves the text as it is."""
    return F.when(rounds > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(rounds, F.lit(1))), text, lambda acc, _: step(acc))).otherwise(text)


def _printable(t: Column) -> Column:
    """Every byte that isn't printable as its escape; a text is cut into single bytes only where there is any."""
    bytes_ = F.regexp_extract_all(F.hex(F.encode(t, "UTF-8")), F.lit("(..)"), F.lit(1))
    escaped = F.array_join(F.transform(bytes_, lambda h: F.when((h <= "20") | (h >= "7F") | h.isin("25", "23"), F.concat(F.lit("%"), h)).otherwise(F.decode(F.unhex(h), "UTF-8"))), "")
    return F.when(t.rlike(r"[^\x21-\x7e]|[%#]"), escaped).otherwise(t)


def canonical(url: Column | str) -> Column:
    """(host, path): escapes resolved repeatedly, dot components folded, what isn't printable escaped again, no fragment, the host in lower case.

    Null without a protocol. Unescaping is repeated as often as the text has signs or sums that could hide another escape, and
    folding as often as it has double dots, so both end in a stable form; each stage is named, so the plan stays small.
    """
    u = col(url)
    rest = F.regexp_replace(F.regexp_extract(u, r"(?s)\A[^:]*:/*(.*)\z", 1), r"\A[^:/?@]*@", "")
    fold = lambda t: F.regexp_replace(F.regexp_replace(t, r"/(?:\./)+", "/"), r"(?<=/)(?!\.\./)[^/?]+/\.\.(?:/|\z)", "")
    signs = lambda t: F.when(t.contains("%"), F.regexp_count(t, F.lit("%|25"))).otherwise(F.lit(0))
    dots = lambda t: F.when(t.contains("/."), F.regexp_count(t, F.lit(r"/\.\.")) + 1).otherwise(F.lit(0))

    def parts(t: Column) -> Column:
        h = F.lower(F.regexp_extract(t, r"\A([^:/?]*)", 1))
        path = F.regexp_replace(F.substring(t, F.length(h) + 1, 2147483647), r"\A:[0-9]*", "")
        return F.struct(F.concat(h, F.lit("/")).alias("host"), F.regexp_replace(path, r"\A/", "").alias("path"))

    plain = _let(F.regexp_replace(rest, "#.*", ""), lambda t: F.regexp_replace(_repeated(t, signs(t), unescape), r"\A[/.]+", ""))
    return F.when(u.contains(":"), _let(_let(_let(plain, lambda t: _repeated(t, dots(t), fold)), _printable), parts))


def lookups(url: Column | str) -> Column:
    """All strings whose digests a URL is looked up by: up to five host suffixes and the host, with up to six prefixes of the path."""

    def found(c: Column) -> Column:
        labels = F.split(F.regexp_replace(c["host"], r"/\z", ""), r"\.", -1)
        bare = F.substring_index(c["path"], "?", 1)

        def hosts(own: Column) -> Column:
            n = F.size(own)
            from_ = F.greatest(F.lit(2), F.least(n, F.lit(COMPONENTS)))
            tails = F.transform(F.sequence(F.lit(2), from_), lambda k: F.array_join(F.slice(own, F.greatest(n - k + 1, F.lit(1)), k), "."))
            return F.array_distinct(F.concat(F.array(F.array_join(own, ".")), F.when(n >= 2, tails).otherwise(F.array().cast("array<string>"))))

        def paths(parts: Column) -> Column:
            heads = F.transform(F.sequence(F.lit(0), F.least(F.size(parts) - 1, F.lit(COMPONENTS - 1))), lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), k), "/"), F.lit("/"))))
            return F.array_distinct(F.concat(F.array(c["path"], bare), heads))

        every = _let(F.split(bare, "/", -1), paths)
        return _let(every, lambda ps: F.flatten(F.transform(_let(labels, hosts), lambda h: F.transform(ps, lambda p: F.concat(h, F.lit("/"), p)))))

    return _let(canonical(url), lambda c: F.when(c.isNotNull(), found(c)))


def text_links(text: Column | str) -> Column:
    """Links in plain text: from the protocol to a blank or line end, at most 1023 characters."""
    return F.regexp_extract_all(col(text), F.lit(r"((?:https?|ftp):[^ \n\t]{1,1017})"), F.lit(1))


def under(host_name: Column | str, suffix: Column | str) -> Column:
    """Is the host this name, or below it at a label's boundary?"""
    h, s = col(host_name), col(suffix)
    return (h == s) | h.endswith(F.concat(F.lit("."), s))


def link_verdict(real: Column, display: Column, *, listed: Column, allowed: Column, listed_host: Column | None = None, blocked: Column | None = None, is_image: Column | None = None, check_always: bool = False) -> Column:
    """An ordered list of rules over a link's target and its text.

    ``listed`` protected by a target rule, ``listed_host`` by a host rule, ``allowed`` by an allow list, ``blocked`` the
    verdict of the digest list, ``is_image`` leaves images out.
    """
    r, d = cleaned(real), shown(display)
    rh, dh = F.lower(host(r)), F.lower(host(d))
    on_list = listed | (F.lit(False) if listed_host is None else listed_host) | F.lit(check_always)
    clean = F.lit("CLEAN")
    return (
        F.when(real.isNull() | (real == "") | ~(is_url(real) | is_numeric_url(real)), clean)
        .when((F.lit(None).cast("string") if blocked is None else blocked).isNotNull(), F.lit("") if blocked is None else blocked)
        .when((real == display) | display.isNull() | (d == "") | (r == d), clean)
        .when(~is_url(d) & ~is_numeric_url(d), clean)
        .when(allowed, clean)
        .when(rh == dh, F.when(on_list & is_ssl(d) & ~is_ssl(r), "SSL_SPOOF").otherwise(clean))
        .when(F.lit(False) if is_image is None else is_image, clean)
        .when(real.contains("%00") | real.contains("%01"), "CLOAKED_NULL")
        .when(on_list & is_ssl(d) & ~is_ssl(r), "SSL_SPOOF")
        .when(~on_list, clean)
        .when(domain(rh) == domain(dh), clean)
        .when(has_user(real), "CLOAKED_USERNAME")
        .when(is_numeric(rh), "CLOAKED_NUMERIC_IP")
        .otherwise("SPOOFED_DOMAIN")
    )


ALERTS = {"CLOAKED_NULL": "Heuristics.Phishing.Email.Cloaked.Null", "SSL_SPOOF": "Heuristics.Phishing.Email.SSL-Spoof", "CLOAKED_USERNAME": "Heuristics.Phishing.Email.Cloaked.Username", "CLOAKED_NUMERIC_IP": "Heuristics.Phishing.Email.Cloaked.NumericIP", "SPOOFED_DOMAIN": "Heuristics.Phishing.Email.SpoofedDomain", "BLOCKED": "Heuristics.Phishing.URL.Blocked"}


def alert(verdict: Column | str) -> Column:
    """The alert's name of a verdict, null for a clean one."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in ALERTS.items() for x in kv)), col(verdict))

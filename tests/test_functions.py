"""Scalar functions against Python."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from scanfold.functions import dlp, html, raw, url
from scanfold.functions import text as tx


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f("x").alias("y")).first()["y"]


def test_digests_and_entropy(spark):
    data = b"hello \x00\xff" * 9
    import hashlib

    for a in ("md5", "sha1", "sha256", "sha384", "sha512"):
        assert one(spark, bytearray(data), lambda c, a=a: tx.digest(c, a), "binary") == hashlib.new(a, data).hexdigest()
    n = Counter(data)
    want = -sum(k / len(data) * math.log2(k / len(data)) for k in n.values())
    assert abs(one(spark, bytearray(data), raw.entropy, "binary") - want) < 1e-9
    assert one(spark, bytearray(b""), raw.entropy, "binary") is None and one(spark, None, raw.entropy, "binary") is None


def test_text(spark):
    assert one(spark, bytearray(b"A\t\n B\x7f\x01\xe9c"), tx.normalize_text, "binary") == "a bc"
    kinds = {b"plain": "TEXT_ASCII", "é".encode(): "TEXT_UTF8", "hi".encode("utf-16-le"): "TEXT_UTF16LE", "hi".encode("utf-16-be"): "TEXT_UTF16BE", b"\x00\x01\xff": "BINARY_DATA", b"": "TEXT_ASCII", b"\x00\x00\xc3": "BINARY_DATA"}
    for data, kind in kinds.items():
        assert one(spark, bytearray(data), tx.text_type, "binary") == kind, data
    assert one(spark, bytearray(b"\xef\xbb\xbfx"), tx.bom, "binary") == "UTF-8"
    assert one(spark, bytearray("hé".encode("utf-16-le")), lambda c: tx.to_utf8(c, "UTF-16LE"), "binary") == "hé"
    assert one(spark, "a%41%u0042%zz%00", tx.unescape) == "aAB%zz\x01"
    assert one(spark, "x &amp;&#65;&#x42; &Nope; &", tx.entities) == "x &AB &nope; &"
    assert one(spark, r"a\n\"b\/", tx.normalize_escapes) == 'a\n"b/'
    assert one(spark, "a:b::c", lambda c: tx.field(c, 3, ":")) == "c" and one(spark, "a", lambda c: tx.field(c, 3, ":")) is None
    assert tx.fields_outside_slashes("a;b;/c;d/;e", ";", 2) == ["a", "b", "/c;d/", "e"]
    assert one(spark, "7f", tx.hex_number) == 127 and one(spark, "zz", tx.hex_number) is None
    assert one(spark, "line\r\n", tx.chomp) == "line" and one(spark, "Sig.A.UNOFFICIAL", tx.signature_norm) == "Sig.A" and one(spark, "Sig (x) y", lambda c: tx.published_name(c, False)) == "Sig.UNOFFICIAL"


def luhn(d):
    s = 0
    for k, c in enumerate(reversed(d)):
        v = int(c) * (2 if k % 2 else 1)
        s += v - 9 if v > 9 else v
    return s % 10 == 0


def test_cards(spark):
    assert luhn("4111111111111111")
    text = "a 4111 1111 1111 1111, 4111111111111112 x5500-0000-0000-0004; 94111111111111111 378282246310005 and 5000000000000009"
    assert one(spark, text, dlp.cards) == [c for c in ("4111111111111111", "5500000000000004", "378282246310005", "5000000000000009") if luhn(c)]
    assert "5000000000000009" not in one(spark, text, lambda c: dlp.cards(c, True))
    assert one(spark, "", dlp.cards) == [] and one(spark, "4111111111111111 " * 2000, lambda c: F.size(dlp.cards(c))) == 2000


def cards_read(b):
    """The rule as a loop: from every digit after none, up to the issuer's greatest length; after a card 16 bytes on."""
    out, i = [], 0
    while i < len(b):
        if b[i].isdigit() and not b[i - 1 : i].isdigit():
            d, breaks, j, own = "", 0, i, None
            while j < len(b) and not (own and len(d) >= own[3]) and not (len(d) == 6 and not own):
                if b[j].isdigit():
                    d += b[j]
                    own = next((r for r in dlp.ISSUERS if r[0] <= int(d) <= r[1]), None) if len(d) == 6 else own
                elif b[j] in " -" and breaks < 8:
                    breaks += 1
                else:
                    break
                j += 1
            if b[i] <= "6" and own and len(d) >= own[2] and not b[j : j + 1].isdigit() and luhn(d):
                out.append(d)
                i += 15
        i += 1
    return out


def test_cards_beside_other_numbers(spark):
    card = "4111111111111111"
    for text in (f"{card} 12/27", "4111 1111 1111 1111 123", "1 4111-1111-1111-1111", f"7 {card}", f"{card}-{card}"):
        assert set(one(spark, text, dlp.cards)) == {card}, text
    assert one(spark, f"{card}1 9{card} 4 1 1 1 1 1 1 1 1 1 111111", dlp.cards) == []
    r = random.Random(8)
    known = [card, "5500000000000004", "378282246310005", "30569309025904"]
    for _ in range(4):
        text = "".join(r.choice([*known, *known, " ", " ", "-", "  ", "/", "x", "12", "7", "4111 1111 1111 1111", "3782-822463-10005", "4-1-1-1-1-1-1-1-1111 1111", "é"]) for _ in range(600))
        assert one(spark, text, dlp.cards) == cards_read(text.encode().decode("latin-1").replace("\xb2", "x")), text


def test_numbers(spark):
    assert one(spark, "123-45-6789 666-12-3456 000-11-1111 773-11-1111 x123456789", lambda c: dlp.ssns(c, True, True)) == ["123-45-6789", "123456789"]
    assert one(spark, "1 123-45-6789 123-45-6780 123-45-6781", dlp.alerts) == ["Heuristics.Structured.SSN"]
    for v, f, want in (("12345-003", dlp.valid_transit, True), ("12345-005", dlp.valid_transit, False), ("000312345", dlp.valid_transfer, True), ("011000015", dlp.valid_micr, True), ("011000016", dlp.valid_micr, False), ("x", dlp.valid_micr, False)):
        assert one(spark, v, f) is want, v


def test_links(spark):
    assert one(spark, "http://user@Host.example.com:80/x?y", url.host) == "Host.example.com" and one(spark, "mailto:a@b.org", url.host) == "b.org"
    assert one(spark, "a.b.co.uk", url.domain) == "b.co.uk" and one(spark, "b.uk", url.domain) == "b.uk"
    assert one(spark, " HTTP://EX.com\\a;b ", url.cleaned) == "HTTP://ex.com"
    got = one(spark, "http://a.b.c.d.e.f.g/1/2.html?param=1", url.lookups)
    assert {"a.b.c.d.e.f.g/1/2.html?param=1", "f.g/", "c.d.e.f.g/1/", "a.b.c.d.e.f.g/1/2.html"} <= set(got) and len(got) == len(set(got))
    assert one(spark, "see http://x.org/a and https://y.org\tend", url.text_links) == ["http://x.org/a", "https://y.org"]


def test_html(spark):
    page = "<!DOCTYPE html><A HREF='http://x.org/?a&amp;b'>Go <b>there</b><img src=p.png></a><!-- c --><script>var X='1';</script><form action=/f><iframe src=\"i.htm\"></form>T&eacute;xt"
    assert one(spark, page, html.no_tags) == "go there t xt"
    assert "<!--" not in one(spark, page, html.no_comment) and "<a href=" in one(spark, page, html.no_comment) and "téxt" in one(spark, page, html.no_comment)
    found = {(r["tag"], r["target"]): r["text"] for r in one(spark, page, html.links)}
    assert found == {("href", "http://x.org/?a&b"): "Go there", ("img", "p.png"): "http://x.org/?a&amp;b", ("src", "p.png"): "", ("iframe", "i.htm"): "", ("form", "/f"): ""}
    assert one(spark, "a{background:url('data:image/gif;base64,R0lG')}", html.css_images) == [bytearray(b"GIF")]
    assert one(spark, None, html.links) is None or one(spark, "", html.links) == []

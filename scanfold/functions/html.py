"""Views of HTML: without comments, without tags, scripts, links, embedded data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .raw import col
from .text import entities


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def no_comment(html: Column | str) -> Column:
    """Lower-case text and tags; declarations and comments go up to the first closing bracket; white space runs are one blank; references are resolved."""
    t = F.regexp_replace(F.regexp_replace(col(html), r"\r", ""), r"<!-*[^>]*>", "")
    return entities(F.regexp_replace(_lower(t), r"[\x00-\x20]+", " "))


def no_tags(html: Column | str) -> Column:
    """The text alone, in lower case: scripts and styles go, a tag or reference becomes a blank, controls too."""
    t = F.regexp_replace(col(html), r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?s)<[^>]*>", " "), r"&[#\w]{0,32};?", " ")
    return _lower(F.trim(F.regexp_replace(t, r"[\x00-\x20]+", " ")))


def scripts(html: Column | str) -> Column:
    """Bodies of script elements."""
    return F.regexp_extract_all(col(html), F.lit(r"(?is)<script\b[^>]*>(.*?)</script\s*>"), F.lit(1))


def styles(html: Column | str) -> Column:
    return F.regexp_extract_all(col(html), F.lit(r"(?is)<style\b[^>]*>(.*?)</style\s*>"), F.lit(1))


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value in a start tag, with or without quotes; empty when it isn't there."""
    quoted = F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*\"([^\"]*)\"", 1)
    single = F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*'([^']*)'", 1)
    bare = F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*([^\s\"'>]+)", 1)
    return F.when(quoted != "", quoted).when(single != "", single).otherwise(bare)


def links(html: Column | str) -> Column:
    """Structs of tag, target and text: anchors with their text, images, frames, areas and forms.

    An image inside an anchor has the anchor's target as its text.
    """
    h = col(html)
    anchors = F.regexp_extract_all(h, F.lit(r"(?is)(<a\b[^>]*>.*?)(?=</a\s*>|<a\b|\z)"), F.lit(1))
    one = lambda tag, target, text: F.struct(F.lit(tag).alias("tag"), entities(target).alias("target"), text.alias("text"))
    start = lambda a: F.regexp_extract(a, r"(?is)\A(<[^>]*>)", 1)
    hrefs = F.transform(anchors, lambda a: one("href", attribute(start(a), "href"), F.trim(entities(F.regexp_replace(F.regexp_replace(a, r"(?s)\A<[^>]*>", ""), r"(?s)<[^>]*>", "")))))
    titles = F.transform(anchors, lambda a: one("href_title", attribute(start(a), "title"), attribute(start(a), "href")))
    inner = F.flatten(F.transform(anchors, lambda a: F.transform(F.regexp_extract_all(a, F.lit(r"(?is)(<img\b[^>]*>)"), F.lit(1)), lambda i: one("img", attribute(i, "src"), attribute(start(a), "href")))))
    others = []
    for tag, name, label in (("img", "src", "src"), ("img", "dynsrc", "dynsrc"), ("iframe", "src", "iframe"), ("area", "href", "area"), ("form", "action", "form")):
        found = F.regexp_extract_all(h, F.lit(rf"(?is)(<{tag}\b[^>]*>)"), F.lit(1))
        others.append(_each(found, name, label))
    return F.filter(F.concat(hrefs, titles, inner, *others), lambda s: s["target"] != "")


def _each(tags: Column, name: str, label: str) -> Column:
    return F.transform(tags, lambda t: F.struct(F.lit(label).alias("tag"), entities(attribute(t, name)).alias("target"), F.lit("").alias("text")))


def data_uris(html: Column | str) -> Column:
    """Embedded objects of data URIs: type, encoded body."""
    found = F.regexp_extract_all(col(html), F.lit(r"(?i)(data:[^,\"')\s]*,[^\"')\s>]*)"), F.lit(1))
    return F.transform(found, lambda d: F.struct(F.regexp_extract(d, r"(?i)\Adata:([^;,]*)", 1).alias("type"), d.rlike(r"(?i)\Adata:[^,]*;base64,").alias("base64"), F.regexp_extract(d, r"(?s)\A[^,]*,(.*)\z", 1).alias("body")))


def css_images(css: Column | str) -> Column:
    """Decoded base64 images of url(...) in style sheets."""
    found = F.regexp_extract_all(col(css), F.lit(r"(?is)url\(\s*[\"']?data:image/[a-z0-9.+-]+;base64,([A-Za-z0-9+/=\s]*)[\"']?\s*\)"), F.lit(1))
    return F.transform(found, lambda b: F.try_to_binary(F.regexp_replace(b, r"\s", ""), F.lit("base64")))


def full_stops(text: Column | str) -> Column:
    """Full stops of other scripts as plain dots."""
    return F.translate(col(text), "。．﹒", "...")

"""Logical signatures and text rules."""

import itertools

import pytest
from pyspark.sql import functions as F

from scanfold.functions import raw
from scanfold.operators import logic, match, patterns, rules


def fires(spark, line, data, **kw):
    df = spark.createDataFrame([(bytearray(data),)], "content binary")
    return df.select(logic.Logical.parse(line).fires(raw.byte_text("content"), **kw).alias("x")).first()["x"]


def brute(node, counts):
    ops = {"=": lambda a, b: a == b, "<": lambda a, b: a < b, ">": lambda a, b: a > b}
    if node.op == "id":
        n = counts[node.ident]
        ok = ops[node.test](n, node.value) if node.test else n > 0
        return ok, n if ok else 0, {node.ident} if ok and n else set()
    if node.op == "block":
        ok, n, found = brute(node.kids[0], counts)
        if not node.test:
            return ok, n, found
        ok = ops[node.test](n, node.value) and len(found) >= node.distinct
        return ok, n if ok else 0, set()
    a, b = (brute(k, counts) for k in node.kids)
    ok = (a[0] and b[0]) if node.op == "&" else (a[0] or b[0])
    return ok, a[1] + b[1] if ok else 0, a[2] | b[2] if ok else set()


@pytest.mark.parametrize("text", ["0&1", "0|1&2", "0=0&1", "(0|1|2)>2,2", "(0&1)=2|2", "0>1&(1|2)<3", "((0|1)>1,2)&2=0", "(0|1)=0", "0<2&1"])
def test_expressions_against_brute_force(spark, text):
    node = logic.parse(text)
    table = list(itertools.product(range(4), repeat=3))
    df = spark.createDataFrame(table, "a bigint, b bigint, c bigint")
    got = [r[0] for r in df.select(logic.to_column(node, [F.col(x) for x in "abc"])).collect()]
    assert got == [brute(node, list(row))[0] for row in table]


@pytest.mark.parametrize("bad", ["", "0&", "(0", "0)", "a", "0>1,2", "0&&1"])
def test_malformed_expressions(bad):
    with pytest.raises(patterns.PatternError):
        logic.parse(bad)


@pytest.mark.parametrize(
    ("line", "data", "expected"),
    [
        ("A;Target:0;0&1;6161;6262", b"aa bb", True), ("A;Target:0;0&1;6161;6262", b"aa", False), ("A;Target:0;0=2;6161", b"aaa", True), ("A;Target:0;0>2;6161", b"aaa", False),
        ("A;Target:0;0&1;3a3a;0/x=\\d+;y/", b":: x=12;y", True), ("A;Target:0;0&1;3a3a;0/x=\\d+;y/", b"x=12;y", False), ("A;Target:0;0&1;3a3a;4:0/beef/", b"::::beef", True), ("A;Target:0;0&1;3a3a;5:0/beef/", b"::::beef", False),
        ("A;Target:0;0&1;3a3a;2:0/beef/r", b"::::beef", True), ("A;Target:0;0&1>1;3a3a;0/ab/g", b":: ab ab", True), ("A;Target:0;0&1;3a3a;1,2:0/beef/e", b"::::beef", False), ("A;Target:0;0&1;3a3a;0/BEEF/i", b"::beef", True),
        ("A;Target:0;0&1;6e3d;0(>>2#de3#>99)", b"n=123", True), ("A;Target:0;0&1;6e3d;0(>>2#de3#>99,<110)", b"n=123", False), ("A;Target:0;0&1;6e3d;0(>>2#il2#=513)", b"..n=\x01\x02", True), ("A;Target:0;0&1;6e3d;0(<<2#ib1#=7)", b"zz\x07.n=", True),
        ("A;Target:0;0&1;6e3d;0(>>2#h4#=0xff)", b"n=0xff", True), ("A;Target:0;0&1;6e3d;0(>>9#d3#>0)", b"n=123", False), ("A;Target:0;0;4:6161", b"....aa", True), ("A;Target:0;0;6161::i", b"AA", True),
    ],
)
def test_signatures(spark, line, data, expected):
    assert fires(spark, line, data) is expected


@pytest.mark.parametrize("bad", ["A;Engine:1-2;0;6161", "A;Target:0;0&1;6161", "A;Target:0,What:1;0;6161", "A;Target:0;0&1;6161;1/x/", "A;Target:0;0;fuzzy_img#00#0", "A;Target:0;0;fuzzy_img#0011223344556677#2", "A;Target:0;0", "A;Target:0,IconGroup1:x;0;6161"])
def test_malformed_signatures(bad):
    with pytest.raises(patterns.PatternError):
        logic.Logical.parse(bad)


def test_macro_and_image(spark):
    line = "M;Target:0;0&1;6161;${1-6}3$"
    groups = {3: F.array(F.lit(5).cast("long"))}
    assert fires(spark, line, b"aa...zz", groups=groups) is True
    assert fires(spark, line, b".......aa", groups=groups) is False
    assert fires(spark, "I;Target:0;0;fuzzy_img#00112233445566aa", b"", image_hash=F.lit("00112233445566aa")) is True


def test_description_block(spark):
    kind = "object_id int, content binary, ancestor_types array<string>"
    df = spark.createDataFrame([(1, bytearray(b"aaaa"), ["ZIP"]), (2, bytearray(b"aaaa"), ["ZIP", "7Z"]), (3, bytearray(b"aa"), None)], kind)
    sigs = ["Zip;Target:0,Container:ZIP;0;6161", "Mid;Target:0,Intermediates:ZIP>7Z;0;6161", "Any;Target:0,Intermediates:ANY>ZIP;0;6161", "Size;Target:0,FileSize:2-3;0;6161"]
    got = match.logical_matches(df, [logic.Logical.parse(s) for s in sigs])
    assert sorted(map(tuple, got.collect())) == [(1, "Any"), (1, "Zip"), (2, "Any"), (2, "Mid"), (3, "Size")]


RULES = """
rule counts : tag1 { meta: who = "me" strings: $a = "ab" $b = /c+d/ condition: #a >= 2 and $b }
rule places { strings: $a = "ab" condition: $a at 0 or $a in (3..6) }
rule sets { strings: $x1 = "one" $x2 = "two" $y = "six" condition: 2 of ($x*) or all of them }
rule number { condition: uint16(0) == 0x6261 and filesize < 1KB and uint8be(1) == 98 }
rule loops { strings: $a = "ab" condition: for any i in (1..#a) : ( @a[i] > 3 ) }
rule each { strings: $p = "q1" $q = "q2" condition: for all of them : ( # > 0 ) or none of them }
rule later { condition: counts and not sets }
rule hexed { strings: $h = { 61 ?? 63 } $w = "ab" wide condition: $h or $w }
"""


def test_text_rules(spark):
    RULES_ = RULES.replace("( # > 0 )", "( $ )")
    df = spark.createDataFrame([(1, bytearray(b"ab..ab.ccd")), (2, bytearray(b"one two")), (3, bytearray(b"aXc")), (4, bytearray(b"a\0b\0")), (5, bytearray(b""))], "object_id int, content binary")
    got = {}
    for r in rules.matches(df, rules.parse_rules(RULES_)).collect():
        got.setdefault(r["object_id"], set()).add(r["name"])
    assert got == {1: {"counts", "places", "number", "loops", "each", "later"}, 2: {"sets", "each"}, 3: {"hexed", "each"}, 4: {"hexed", "each"}, 5: {"each"}}
    with pytest.raises(patterns.PatternError):
        rules.matches(df, rules.parse_rules('rule x { condition: $nope }'))

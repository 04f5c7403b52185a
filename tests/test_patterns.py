"""Byte patterns, offsets and counts."""

import pytest
from pyspark.sql import functions as F

from scanfold.functions import raw
from scanfold.operators import patterns

CASES = [
    (b"hello world", "68656c6c6f", "", [0]), (b"aXbXc", "61??62", "", [0]), (b"aaaa", "6161", "", [0, 1, 2]), (b"start....end", "7374617274{4}656e64", "", [0]), (b"start.end", "7374617274{2-6}656e64", "", []),
    (b"key=1;then val", "6b6579*76616c", "", [0]), (b"cat cot cut", "63(61|6f)74", "", [0, 4]), (b"cat cot cut", "63!(61|6f)74", "", [8]), (b"\x4a\x5b\x4c", "4?5?", "", [0]), (b"\x4a\x5b\x4c", "?a?b", "", [0]),
    (b"ABC abc", "616263", "i", [0, 4]), (b"word wordy word", "776f7264", "f", [0, 11]), (b"h\0i\0", "6869", "w", [0]), (b"hi h\0i\0", "6869", "wa", [0, 3]), (b"Q..xy", "51[1-3]7879", "", [0]),
    (b"one\ntwo", "(L)74776f", "", [4]), (b"one two", "(W)74776f(W)", "", [4]), (b"xtwo", "(W)74776f", "", []), (b"say \"go\"", "(B)676f(B)", "", [5]), (b"a{nested}", "61(7b(6e|6d)|78)65", "", [0]),
]


def test_patterns_find_all_offsets(spark):
    for data, code, options, expected in CASES:
        df = spark.createDataFrame([(bytearray(data),)], "content binary")
        got = df.select(raw.match_offsets(raw.byte_text("content"), patterns.compile_hex(code, options).regex).alias("o"), patterns.occurs(raw.byte_text("content"), patterns.compile_hex(code, options)).alias("any")).first()
        assert (got["o"], got["any"]) == (expected, bool(expected)), (data, code, options)


@pytest.mark.parametrize(("offset", "expected"), [("*", [0, 4, 8]), ("4", [4]), ("3", []), ("2,3", [4]), ("EOF-4", [8]), ("EOF-4,3", [8]), ("EOF-99", []), ("EP+0", []), ("S0+0", [])])
def test_offsets_limit_hits(spark, offset, expected):
    df = spark.createDataFrame([(bytearray(b"ab..ab..ab.."),)], "content binary")
    got = df.select(patterns.hits(raw.byte_text("content"), patterns.compile_hex("6162"), patterns.parse_offset(offset)).alias("o")).first()["o"]
    assert got == expected


def test_executable_offsets(spark):
    kind = "content binary, exe struct<ep:bigint,nsections:int,sections:array<struct<rva:bigint,vsz:bigint,raw:bigint,rsz:bigint>>>"
    df = spark.createDataFrame([(bytearray(b"..ab..ab"), (6, 2, [(0, 4, 0, 4), (4, 4, 4, 4)]))], kind)
    at = lambda o: df.select(patterns.hits(raw.byte_text("content"), patterns.compile_hex("6162"), patterns.parse_offset(o), exe=F.col("exe")).alias("o")).first()["o"]
    assert (at("EP+0"), at("EP-4"), at("S1+2"), at("SL+2"), at("SE1"), at("S0+0"), at("S7+0")) == ([6], [2], [6], [6], [6], [], [])


@pytest.mark.parametrize("bad", ["", "61", "6162{", "*6162", "6162*", "616", "zz11", "61[1-40]6263", "!(61|6263)6465", "(61{2}62|63)64", "6162{4-2}63"])
def test_malformed_patterns_are_refused(bad):
    with pytest.raises(patterns.PatternError):
        patterns.compile_hex(bad)


def test_bytes_of_any_value_and_long_texts(spark):
    df = spark.createDataFrame([(bytearray(range(256)),), (bytearray(b""),), (None,), (bytearray(b"ab" * 50000),)], "content binary")
    got = [r[0] for r in df.select(patterns.hits(raw.byte_text("content"), patterns.compile_hex("feff")).alias("o")).collect()]
    assert got[:2] == [[254], []] and got[3] == [] and not got[2]
    assert df.select(raw.match_count(raw.byte_text("content"), "abab").alias("n")).collect()[3]["n"] == 49999


def test_prefix_sums(spark):
    data = list(range(1000))
    df = spark.createDataFrame([(data,), ([],), ([7],)], "x array<bigint>")
    got = [r[0] for r in df.select(raw.sums_before(F.col("x"))).collect()]
    assert got == [[sum(data[:k]) for k in range(1000)], [], [0]]

"""Queries over the test tables, an entry for each operator, with the same in DuckDB SQL beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dlp, html, raw, scripts, similar, url
from ..functions import text as tx
from ..operators import logic, match, patterns, rollup, rules
from ..sources import signatures as sigs
from ..sources import structures
from ..streaming import scan as streams
from . import versions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def docs(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select(F.col("doc_id").alias("object_id"), F.col("text").alias("content"))


def rows(spark: SparkSession, schema: str, data: list[tuple]) -> DataFrame:
    return spark.createDataFrame(data, schema)


# Digests and scalar functions


@query("SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def hashes(s, d):
    x = t(s, d, "documents")
    return x.select("doc_id", *(tx.digest("text", a).alias(a) for a in ("md5", "sha1", "sha256")))


@query("SELECT doc_id, md5(lower(hex(encode(text)))) AS hexed, sha256(text) AS back, md5(to_base64(encode(text))) AS b64, sha256(text) AS again FROM documents")
def hex_base64(s, d):
    """Whole texts there and back; the long forms as digests."""
    x = t(s, d, "documents").select("doc_id", raw.to_hex("text").alias("h"), raw.to_base64("text").alias("b"))
    return x.select("doc_id", F.md5(F.col("h").cast("binary")).alias("hexed"), F.sha2(raw.from_hex("h"), 256).alias("back"), F.md5(F.col("b").cast("binary")).alias("b64"), F.sha2(raw.from_base64("b"), 256).alias("again"))


@query(r"""
SELECT doc_id, regexp_replace(translate(regexp_replace(text, '[^\x09-\x0d\x20-\x7e]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0d\x20]+', ' ', 'g') AS normal FROM documents""")
def text_normalize(s, d):
    return t(s, d, "documents").select("doc_id", tx.normalize_text("text").alias("normal"))


@query(r"""
SELECT doc_id, CASE WHEN regexp_full_match(text, '[\x07-\x0d\x1b\x20-\x7e]*') THEN 'TEXT_ASCII' WHEN NOT regexp_matches(text, '[\x00-\x06\x0e-\x1a\x1c-\x1f\x7f]') THEN 'TEXT_UTF8' ELSE 'BINARY_DATA' END AS type FROM documents""")
def text_type(s, d):
    return t(s, d, "documents").select("doc_id", tx.text_type("text").alias("type"))


@query("""
WITH c AS (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS b FROM documents),
h AS (SELECT doc_id, b, count(*) AS n FROM c GROUP BY ALL), t AS (SELECT doc_id, sum(n) AS total FROM h GROUP BY doc_id)
SELECT doc_id, round(-sum(n / total * log2(n / total)), 6) AS entropy FROM h JOIN t USING (doc_id) GROUP BY doc_id""")
def entropy(s, d):
    return t(s, d, "documents").select("doc_id", F.round(raw.entropy("text"), 6).alias("entropy")).where("entropy is not null")


@query("SELECT user_id, event_id, split_part(event_type, '_', 1) AS head, CASE WHEN len(string_split(event_type, '_')) > 1 THEN split_part(event_type, '_', 2) END AS second FROM events")
def strtok(s, d):
    return t(s, d, "events").select("user_id", "event_id", tx.field("event_type", 0, "_").alias("head"), tx.field("event_type", 1, "_").alias("second"))


@query("SELECT p_partkey, regexp_extract(p_name, '([^ ]*)$', 1) AS last, lower(p_name) LIKE '%e' AS ends, regexp_full_match(CAST(p_size AS VARCHAR), '[0-9]+') AS number FROM part")
def string_tests(s, d):
    return t(s, d, "part").select("p_partkey", F.regexp_extract("p_name", r"([^ ]*)\z", 1).alias("last"), tx.ends_with_nocase("p_name", "E").alias("ends"), tx.is_number(F.col("p_size").cast("string")).alias("number"))


VERSIONS = [("1.2.3", "1.2.10"), ("1.10", "1.9.9"), ("2.0", "2"), ("0.103.2", "0.103.2"), ("1.4.0-rc", "1.4"), ("3", "10")]


@query("SELECT * FROM (VALUES ('1.2.3', '1.2.10', -1), ('1.10', '1.9.9', 1), ('2.0', '2', 0), ('0.103.2', '0.103.2', 0), ('1.4.0-rc', '1.4', 0), ('3', '10', -1)) v(a, b, sign)")
def version_compare(s, d):
    return rows(s, "a string, b string", VERSIONS).select("a", "b", tx.version_compare("a", "b").alias("sign"))


ESCAPES = [("%5a",), ("%b5%8",), ("%00x",), ("a%41%4g%u0042",), ("100%",)]


@query("SELECT * FROM (VALUES ('%5a', 'Z'), ('%b5%8', 'µ%8'), ('%00x', chr(1) || 'x'), ('a%41%4g%u0042', 'aA%4gB'), ('100%', '100%')) v(a, b)")
def unescape(s, d):
    return rows(s, "a string", ESCAPES).select("a", tx.unescape("a").alias("b"))


@query("SELECT * FROM (VALUES ('../a/./b\\..\\c.txt', 'a/b/c.txt', 'c.txt'), ('/etc//passwd', 'etc/passwd', 'passwd'), ('dir/', 'dir', NULL)) v(p, safe, base)")
def paths(s, d):
    return rows(s, "p string", [("../a/./b\\..\\c.txt",), ("/etc//passwd",), ("dir/",)]).select("p", tx.sanitized_path("p").alias("safe"), tx.basename("p").alias("base"))


# Digest signatures


@query("""
WITH k AS (SELECT sha256(text) AS digest, CAST(strlen(text) AS BIGINT) AS size, 'Known.' || min(doc_id) AS name FROM documents JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY 1, 2)
SELECT d.doc_id, k.name FROM documents d JOIN k ON sha256(d.text) = k.digest AND strlen(d.text) = k.size""")
def hash_sig_sized(s, d):
    x = t(s, d, "documents")
    known = x.join(t(s, d, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi").groupBy(tx.digest("text").alias("digest"), F.octet_length("text").cast("long").alias("size")).agg(F.concat(F.lit("Known."), F.min("doc_id")).alias("name")).withColumn("algo", F.lit("sha256"))
    return match.hash_matches(x, known, id_col="doc_id", content="text").select("doc_id", "name")


@query("""
WITH k AS (SELECT md5(text) AS digest, 'Any.' || min(item_id) AS name FROM benchmark GROUP BY 1), w AS (SELECT sha1(text) AS digest, 'Doc.' || min(doc_id) AS name FROM documents WHERE contains(text, 'token') GROUP BY 1)
SELECT doc_id, name FROM documents JOIN k ON md5(text) = digest UNION ALL SELECT doc_id, name FROM documents JOIN w ON sha1(text) = digest""")
def hash_sig_wild(s, d):
    x = t(s, d, "documents")
    none = F.lit(None).cast("long").alias("size")
    k = t(s, d, "benchmark").groupBy(tx.digest("text", "md5").alias("digest")).agg(F.concat(F.lit("Any."), F.min("item_id")).alias("name")).select(F.lit("md5").alias("algo"), "digest", none, "name")
    w = x.where(F.col("text").contains("token")).groupBy(tx.digest("text", "sha1").alias("digest")).agg(F.concat(F.lit("Doc."), F.min("doc_id")).alias("name")).select(F.lit("sha1").alias("algo"), "digest", none, "name")
    return match.hash_matches(x, k.unionByName(w), id_col="doc_id", content="text").select("doc_id", "name")


@query("SELECT sha256(text) || ':' || strlen(text) AS key, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1")
def hash_dedup_cache(s, d):
    one, ids = rollup.cached(docs(s, d))
    return ids.join(one.select("_key").distinct(), "_key").groupBy(F.col("_key").alias("key")).agg(F.count("*").alias("n"), F.min("object_id").alias("first"))


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents k JOIN labels l ON k.doc_id = l.doc_id WHERE l.quality = 1 AND sha256(k.text) = sha256(d.text))")
def fp_anti_join(s, d):
    x = docs(s, d)
    good = t(s, d, "labels").where("quality = 1").select(F.col("doc_id").alias("object_id"))
    trust = x.join(good, "object_id", "left_semi").select(F.lit("sha256").alias("algo"), tx.digest("content").alias("digest"), F.lit(None).cast("long").alias("size"), F.lit("trust").alias("name")).distinct()
    return x.join(match.trusted(x, trust), "object_id", "left_anti").select(F.col("object_id").alias("doc_id"))


@query("SELECT md5(encode(text)) || ':' || strlen(text) || ':Doc.' || doc_id AS line FROM documents")
def hash_lines(s, d):
    return sigs.hash_lines(docs(s, d).withColumn("name", F.concat(F.lit("Doc."), "object_id")))


# Body patterns


def _bodies(s, d, *signatures):
    return match.body_matches(docs(s, d), list(signatures)).select(F.col("object_id").alias("doc_id"), "name", F.size("offsets").cast("long").alias("hits"))


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def body_contains(s, d):
    return t(s, d, "documents").join(match.small(t(s, d, "benchmark").select("item_id", F.col("text").alias("needle"))), F.col("text").contains(F.col("needle"))).select("doc_id", "item_id")


@query("SELECT doc_id, 'Lit' AS name, CAST((length(text) - length(replace(text, 'the', ''))) // 3 AS BIGINT) AS hits FROM documents WHERE contains(text, 'the')")
def body_literal(s, d):
    return _bodies(s, d, ("Lit", "*", "746865", ""))


@query(r"SELECT doc_id, regexp_matches(text, '(?s)th.t') AS wild, regexp_matches(text, '(?s)the.{2,6}and') AS gap, regexp_matches(text, '(?s)the.*password') AS far, regexp_matches(text, '(?s)(?:and|ing|ou)er') AS alt, regexp_matches(text, '(?s)[p-\x7f]he') AS nib, regexp_matches(text, '(?s)th[^aei]') AS neg FROM documents")
def body_patterns(s, d):
    b = raw.byte_text("text")
    occurs = lambda p: patterns.occurs(b, patterns.compile_hex(p))
    return t(s, d, "documents").select("doc_id", *(occurs(p).alias(n) for n, p in (("wild", "7468??74"), ("gap", "746865{2-6}616e64"), ("far", "746865*70617373776f7264"), ("alt", "(616e64|696e67|6f75)6572"), ("nib", "7?6865"), ("neg", "7468!(61|65|69)"))))


@query("""
SELECT doc_id, hex(encode(text))[1:4] = '5468' AS at0, hex(encode(text))[9:12] = '6520' AS at4, hex(encode(text))[-2:] = '2E' AS eof,
  coalesce(list_contains(list_transform(range(2, 13), lambda k: hex(encode(text))[2 * k + 1:2 * k + 4]), '7468'), false) AS near FROM documents""")
def body_offsets(s, d):
    b = raw.byte_text("text")
    hit = lambda code, off: F.size(patterns.hits(b, patterns.compile_hex(code), patterns.parse_offset(off))) > 0
    one = F.size(patterns.hits(b, patterns.Compiled(r"\x2e", 1, "2e"), patterns.parse_offset("EOF-1"))) > 0
    return t(s, d, "documents").select("doc_id", hit("5468", "0").alias("at0"), hit("6520", "4").alias("at4"), one.alias("eof"), hit("7468", "2,10").alias("near"))


@query("SELECT doc_id, regexp_matches(text, '(?i)PASSWORD') AS nocase, regexp_matches(text, '(^|[^A-Za-z0-9])the($|[^A-Za-z0-9])') AS whole, false AS wide FROM documents")
def body_options(s, d):
    b = raw.byte_text("text")
    occurs = lambda p, o: patterns.occurs(b, patterns.compile_hex(p, o))
    return t(s, d, "documents").select("doc_id", occurs("50617373776f7264", "i").alias("nocase"), occurs("746865", "f").alias("whole"), occurs("746865", "w").alias("wide"))


#: A text in which each character stands for as many bytes as it has, so that characters count as bytes.
BYTES = r"regexp_replace(regexp_replace(regexp_replace(text, '[\x{80}-\x{7ff}]', '##', 'g'), '[\x{800}-\x{ffff}]', '###', 'g'), '[\x{10000}-\x{10ffff}]', '####', 'g')"


@query(f"""
WITH b AS (SELECT doc_id, string_split({BYTES}, '') AS c FROM documents)
SELECT doc_id, CAST(len(list_filter(range(1, len(c) - 2), lambda i: c[i] = c[i + 2] AND c[i + 1] = c[i + 3] AND c[i] || c[i + 1] IN ('th', 'er'))) AS BIGINT) AS n,
  list_filter(range(0, len(c) - 3), lambda i: c[i + 1] || c[i + 2] || c[i + 3] || c[i + 4] = 'thth')[1] AS first FROM b""")
def subsig_count_overlap(s, d):
    b = raw.byte_text("text")
    return t(s, d, "documents").select("doc_id", raw.match_count(b, r"(?:thth|erer)").cast("long").alias("n"), F.get(raw.match_offsets(b, "thth"), F.lit(0)).alias("first"))


# Logical signatures

#: None of these words overlaps itself.
COUNT = "CAST((length(text) - length(replace(text, '{s}', ''))) // {n} AS BIGINT)"
_C = [COUNT.format(n=len(x), s=x) for x in ("the", "and", "password", "que")]


@query(f"""
WITH c AS (SELECT doc_id, strlen(text) AS size, {_C[0]} AS a, {_C[1]} AS b, {_C[2]} AS p, {_C[3]} AS q FROM documents)
SELECT doc_id, 'And' AS name FROM c WHERE a > 0 AND b > 0 UNION ALL SELECT doc_id, 'Not' FROM c WHERE a > 0 AND q = 0
UNION ALL SELECT doc_id, 'Many' FROM c WHERE a > 20 AND b < 5 UNION ALL SELECT doc_id, 'Block' FROM c WHERE a + b + p > 30 AND CAST(a > 0 AS INT) + CAST(b > 0 AS INT) + CAST(p > 0 AS INT) >= 2
UNION ALL SELECT doc_id, 'Split' FROM c WHERE a > 0 AND (p > 0 OR q > 0) UNION ALL SELECT doc_id, 'Size' FROM c WHERE a > 0 AND size BETWEEN 500 AND 2000""")
def logical_signatures(s, d):
    subs = "746865;616e64;70617373776f7264;717565"
    lines = [
        "And;Engine:51-255,Target:0;0&1;746865;616e64", "Not;Engine:51-255,Target:0;0&1=0;746865;717565", "Many;Engine:51-255,Target:0;0>20&1<5;746865;616e64",
        "Block;Engine:51-255,Target:0;(0|1|2)>30,2;" + subs.rsplit(";", 1)[0], "Split;Engine:51-255,Target:0;0&1|2;746865;70617373776f7264;717565", "Size;Engine:51-255,Target:0,FileSize:500-2000;0;746865",
    ]
    return match.logical_matches(docs(s, d), [logic.Logical.parse(x) for x in lines]).select(F.col("object_id").alias("doc_id"), "name")


@query(r"""
WITH n AS (SELECT * FROM (VALUES (1, 'x=0123;'), (2, 'len=512 end'), (3, 'len=0x1F end'), (4, 'len=99'), (5, 'nothing'), (6, 'z len=700 len=100 q')) v(id, s))
SELECT id, coalesce(try_cast(regexp_extract(s, '.*len=([0-9]{3})', 1) AS INT) > 200, false) AS over, regexp_matches(s, 'len=0x1F') AS hexed FROM n""")
def byte_compare(s, d):
    x = rows(s, "id int, s string", [(1, "x=0123;"), (2, "len=512 end"), (3, "len=0x1F end"), (4, "len=99"), (5, "nothing"), (6, "z len=700 len=100 q")])
    b = raw.byte_text("s")
    over, hexed = logic.Logical.parse("Over;Target:0;0&1;6c656e3d;0(>>4#de3#>200)"), logic.Logical.parse("Hex;Target:0;0&1;6c656e3d;0(>>4#h4#=0x1f)")
    return x.select("id", over.fires(b).alias("over"), hexed.fires(b).alias("hexed"))


@query(r"""
SELECT doc_id, contains(text, 'the') AND regexp_matches(text, '[a-z]+ing of') AS trig, contains(text, 'the') AND len(regexp_extract_all(text, 'of [a-z]+')) > 5 AS glob, regexp_matches(text, '^[A-Z][a-z]+ ') AND contains(text, 'the') AS anch FROM documents""")
def pcre_trigger(s, d):
    b = raw.byte_text("text")
    fire = lambda line: logic.Logical.parse(line).fires(b)
    return t(s, d, "documents").select("doc_id", fire("T;Target:0;0&1;746865;0/[a-z]+ing of/").alias("trig"), fire("G;Target:0;0&1>5;746865;0/of [a-z]+/g").alias("glob"), fire("A;Target:0;0&1;746865;0:0/[A-Z][a-z]+ /").alias("anch"))


@query("""
WITH c AS (SELECT doc_id, regexp_matches(text, '(?i)password') AS p, CAST((length(text) - length(replace(text, 'the', ''))) // 3 AS BIGINT) AS n, strlen(text) AS size FROM documents)
SELECT doc_id, 'creds' AS name FROM c WHERE p AND size > 100 UNION ALL SELECT doc_id, 'thes' FROM c WHERE n > 10 AND NOT p""")
def text_rules(s, d):
    source = """
rule creds { strings: $a = "password" nocase condition: $a and filesize > 100 }
rule thes { strings: $t = "the" $p = "PassWord" nocase condition: #t > 10 and not $p }
"""
    return rules.matches(docs(s, d), rules.parse_rules(source)).select(F.col("object_id").alias("doc_id"), "name")


# Data loss


def _luhn_sql(x: str) -> str:
    return f"list_sum(list_transform(range(1, length({x}) + 1), lambda k: CASE WHEN (length({x}) - k) % 2 = 0 THEN CAST({x}[k] AS INT) WHEN CAST({x}[k] AS INT) > 4 THEN 2 * CAST({x}[k] AS INT) - 9 ELSE 2 * CAST({x}[k] AS INT) END)) % 10 = 0"


_ISSUERS = " UNION ALL ".join(f"SELECT {a} AS lo, {b} AS hi, {c} AS least, {e} AS most" for a, b, c, e, _ in dlp.ISSUERS)


@query(f"""
WITH i AS ({_ISSUERS}), r AS (SELECT doc_id, regexp_replace(unnest(regexp_extract_all(regexp_replace(regexp_replace(text, '[^0-9 -]', '##', 'g'), '([ -])', '\\1\\1', 'g'), '(?:^|[^0-9])([0-6](?:[ -]{{0,8}}[0-9]){{12,18}})(?:$|[^0-9])', 1)), '[ -]', '', 'g') AS digits FROM documents)
SELECT doc_id, digits FROM r JOIN i ON CAST(digits[1:6] AS INT) BETWEEN lo AND hi AND length(digits) BETWEEN least AND most WHERE {_luhn_sql("digits")}""")
def dlp_cards(s, d):
    return t(s, d, "documents").select("doc_id", F.explode(dlp.cards("text")).alias("digits"))


NUMBERS = "('123-45-6789'), ('000-12-3456'), ('666-12-3456'), ('773-10-1000'), ('772-99-0001'), ('123456789'), ('12345-003'), ('12345-005'), ('000312345'), ('011000015'), ('011000016'), ('x')"


@query(f"""
WITH n AS (SELECT * FROM (VALUES {NUMBERS}) v(x)), s AS (SELECT x, regexp_replace(x, '-', '', 'g') AS g FROM n),
p AS (SELECT *, try_cast(g[1:3] AS INT) AS area, try_cast(g[4:5] AS INT) AS grp, try_cast(g[6:9] AS INT) AS ser FROM s)
SELECT x, coalesce(regexp_full_match(x, '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}') AND area BETWEEN 1 AND 772 AND area <> 666 AND grp > 0 AND ser > 0, false) AS ssn,
  x IN ('12345-003') AS transit, x = '000312345' AS transfer,
  coalesce(regexp_full_match(x, '[0-9]{{9}}') AND (7 * (x[1]::INT + x[4]::INT + x[7]::INT) + 3 * (x[2]::INT + x[5]::INT + x[8]::INT) + 9 * (x[3]::INT + x[6]::INT)) % 10 = x[9]::INT, false) AS micr
FROM (SELECT p.*, CASE WHEN regexp_full_match(x, '[0-9]{{9}}') THEN x END AS y FROM p) q""".replace("x[", "y["))
def dlp_numbers(s, d):
    x = rows(s, "x string", [(v.strip("(' )"),) for v in NUMBERS.split(",")])
    return x.select("x", (F.size(dlp.ssns("x")) > 0).alias("ssn"), dlp.valid_transit("x").alias("transit"), dlp.valid_transfer("x").alias("transfer"), dlp.valid_micr("x").alias("micr"))


@query(f"""
WITH i AS ({_ISSUERS}), r AS (SELECT doc_id, regexp_replace(unnest(regexp_extract_all(regexp_replace(regexp_replace(text, '[^0-9 -]', '##', 'g'), '([ -])', '\\1\\1', 'g'), '(?:^|[^0-9])([0-6](?:[ -]{{0,8}}[0-9]){{12,18}})(?:$|[^0-9])', 1)), '[ -]', '', 'g') AS digits FROM documents)
SELECT doc_id, 'Heuristics.Structured.CreditCardNumber' AS alert FROM r JOIN i ON CAST(digits[1:6] AS INT) BETWEEN lo AND hi AND length(digits) BETWEEN least AND most WHERE {_luhn_sql("digits")} GROUP BY doc_id HAVING count(*) >= 1""")
def dlp_threshold(s, d):
    return t(s, d, "documents").select("doc_id", F.explode(dlp.alerts("text", min_cards=1)).alias("alert"))


# Container metadata, limits, intervals


@query("""
SELECT l_orderkey, l_linenumber, r.name FROM lineitem JOIN (VALUES ('Small', 1, 10, NULL, NULL), ('Rail', NULL, NULL, 'R', NULL), ('Both', 20, 30, 'A', 'F')) r(name, lo, hi, flag, st)
ON (lo IS NULL OR l_quantity BETWEEN lo AND hi) AND (flag IS NULL OR l_returnflag = flag) AND (st IS NULL OR l_linestatus = st)""")
def container_rules(s, d):
    members_ = t(s, d, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("object_id"), F.col("l_linestatus").alias("container_type"), F.col("l_returnflag").alias("fname"), F.col("l_quantity").cast("long").alias("fsizer"), F.lit(None).cast("boolean").alias("encrypted"))
    lines = s.createDataFrame([("Small:*:*:*:*:1-10:*:*:*:*",), ("Rail:*:*:^R$:*:*:*:*:*:*",), ("Both:F:*:^A$:*:20-30:*:*:*:*",)], "value string")
    rules_ = sigs.parse(lines, "cdb")
    return match.container_matches(members_, rules_).select("object_id.*", "name")


@query("""
WITH e AS (SELECT l_suppkey, CAST(l_linenumber AS BIGINT) * 100 AS start, CAST(l_quantity AS BIGINT) * 5 AS size FROM lineitem),
m AS (SELECT *, max(start + size) OVER (PARTITION BY l_suppkey ORDER BY start, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM e)
SELECT l_suppkey, count_if(start < e) AS n FROM m GROUP BY l_suppkey""")
def partition_overlap(s, d):
    x = t(s, d, "lineitem").select("l_suppkey", (F.col("l_linenumber").cast("long") * 100).alias("start"), (F.col("l_quantity").cast("long") * 5).alias("size"))
    return rollup.overlaps(x, by="l_suppkey")


@query("""
WITH b AS (SELECT doc_id, source, strlen(text) AS size FROM documents), w AS (
  SELECT *, coalesce(sum(CASE WHEN size <= 20000 THEN size ELSE 0 END) OVER p, 0) AS before, coalesce(sum(CASE WHEN size <= 20000 THEN 1 ELSE 0 END) OVER p, 0) AS files FROM b WINDOW p AS (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT doc_id, CASE WHEN size > 20000 THEN 'MaxFileSize' WHEN before + size > 100000 THEN 'MaxScanSize' WHEN files >= 50 THEN 'MaxFiles' END AS "limit" FROM w""")
def limits_running(s, d):
    x = t(s, d, "documents").select(F.col("doc_id").alias("object_id"), F.col("source").alias("root_id"), F.octet_length("text").cast("long").alias("size"))
    return rollup.limited(x, max_file=20000, max_scan=100000, max_files=50).select(F.col("object_id").alias("doc_id"), "limit")


# Verdicts

_IND = "SELECT conv_id AS root_id, turn AS seq, CASE WHEN contains(text, 'password') THEN 'Creds' WHEN role = 'system' THEN 'PUA.Sys.A' WHEN length(text) > 400 THEN 'Heuristics.Long' ELSE 'W' END AS name, CASE WHEN contains(text, 'password') THEN 'strong' WHEN role = 'system' OR length(text) > 400 THEN 'pua' ELSE 'weak' END AS kind FROM conversations"


def _indicators(s, d):
    x = t(s, d, "conversations")
    name = F.when(F.col("text").contains("password"), "Creds").when(F.col("role") == "system", "PUA.Sys.A").when(F.length("text") > 400, "Heuristics.Long").otherwise("W")
    return x.select(F.col("conv_id").alias("root_id"), F.col("turn").alias("seq"), name.alias("name")).withColumn("kind", F.when(F.col("name") == "W", "weak").otherwise(rollup.indicator_kind("name")))


@query(f"""
WITH i AS ({_IND}), r AS (SELECT *, CASE kind WHEN 'strong' THEN 2 WHEN 'pua' THEN 1 ELSE 0 END AS k FROM i)
SELECT root_id, CASE max(k) WHEN 2 THEN 'STRONG_INDICATOR' WHEN 1 THEN 'POTENTIALLY_UNWANTED' ELSE 'NOTHING_FOUND' END AS verdict, arg_max(name, k * 100000 + seq) FILTER (k > 0) AS last_alert, count_if(k > 0) AS alerts FROM r GROUP BY root_id""")
def verdict_rollup(s, d):
    return rollup.verdicts(_indicators(s, d))


@query(f"""
WITH i AS ({_IND}), f AS (SELECT *, coalesce(sum(CASE WHEN kind = 'strong' THEN 1 ELSE 0 END) OVER (PARTITION BY root_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM i)
SELECT root_id, seq, name, kind FROM f WHERE n = 0""")
def first_match(s, d):
    return rollup.first_matches(_indicators(s, d))


@query("""
WITH RECURSIVE t AS (SELECT conv_id * 1000000 + turn AS object_id, CASE WHEN turn > 0 THEN conv_id * 1000000 + turn - 1 END AS parent_id, text FROM conversations),
a(object_id, ancestor_id) AS (SELECT object_id, object_id FROM t UNION ALL SELECT a.object_id, t.parent_id FROM a JOIN t ON a.ancestor_id = t.object_id WHERE t.parent_id IS NOT NULL)
SELECT object_id FROM t WHERE object_id NOT IN (SELECT a.object_id FROM a JOIN t u ON a.ancestor_id = u.object_id WHERE length(u.text) % 13 = 0)""")
def fp_ancestor_trust(s, d):
    place = F.col("conv_id") * 1_000_000 + F.col("turn")
    x = t(s, d, "conversations").select(place.alias("object_id"), F.when(F.col("turn") > 0, place - 1).alias("parent_id"), "text")
    held = x.where(F.length("text") % 13 == 0).select("object_id")
    return rollup.distrusted(x.select("object_id"), held, rollup.ancestors(x))


@query("WITH l AS (SELECT quality, toxic, CASE WHEN toxic = 1 THEN 'STRONG_INDICATOR' ELSE 'NOTHING_FOUND' END AS verdict, strlen(text) AS size FROM labels JOIN documents USING (doc_id)) SELECT count(*) AS scanned_files, CAST(sum(size) AS BIGINT) AS scanned_bytes, count_if(toxic = 1) AS infected_files FROM l")
def scan_summary(s, d):
    x = t(s, d, "labels").join(t(s, d, "documents"), "doc_id").select("toxic", F.octet_length("text").cast("long").alias("size"))
    return rollup.summary(x, x.select(F.when(F.col("toxic") == 1, "STRONG_INDICATOR").otherwise("NOTHING_FOUND").alias("verdict")))


@query("SELECT md5(source) AS digest, source AS name, count(*) AS count FROM documents GROUP BY source")
def unique_names(s, d):
    return rollup.unique_names(t(s, d, "documents").select(F.col("source").alias("name")))


# Signature tables

SIGS = [("PUA.Win.Tool-1", 60, 255), ("PUA.Unix.Miner-2", None, None), ("Eicar-Test", 1, 90), ("Old.Sig.UNOFFICIAL", 10, 239), ("New.Sig", 241, None), ("Trojan.X-9.{7}", 200, 300)]


def _sigs(s):
    return rows(s, "name string, min_fl int, max_fl int", SIGS).withColumn("entry", F.concat("name", F.lit(":0:*:6162")))


_SIGS = "(VALUES ('PUA.Win.Tool-1', 60, 255), ('PUA.Unix.Miner-2', NULL, NULL), ('Eicar-Test', 1, 90), ('Old.Sig.UNOFFICIAL', 10, 239), ('New.Sig', 241, NULL), ('Trojan.X-9.{7}', 200, 300)) v(name, min_fl, max_fl)"


@query(f"SELECT name FROM {_SIGS} WHERE coalesce(min_fl, 0) <= 240 AND coalesce(max_fl, 99999) >= 240")
def level_filter(s, d):
    return sigs.active(_sigs(s)).select("name")


@query(f"SELECT name FROM {_SIGS} WHERE name NOT LIKE 'PUA.%' OR split_part(name, '.', 2) = 'Win'")
def pua_filter(s, d):
    return sigs.unwanted(_sigs(s), include=["Win"]).select("name")


@query(f"SELECT name FROM {_SIGS} WHERE regexp_replace(name, '(\\.UNOFFICIAL|\\.\\{{[^}}]*\\}})$', '') NOT IN ('Old.Sig', 'Trojan.X-9') AND md5(name || ':0:*:6162') <> md5('Eicar-Test:0:*:6162')")
def ignore_list(s, d):
    lines = s.createDataFrame([("Old.Sig",), ("Trojan.X-9",), ("Eicar-Test:" + __import__("hashlib").md5(b"Eicar-Test:0:*:6162").hexdigest(),)], "value string")
    return sigs.without_ignored(_sigs(s), sigs.parse(lines, "ign2")).select("name")


@query("SELECT * FROM (VALUES ('a.ign2', 1, 0, true), ('daily.cld', 7, 1, true), ('daily.cvd', 7, 2, false), ('local.gdb', 1, 3, true), ('daily.cfg', 1, 4, true), ('x.crb', 1, 5, true), ('main.ndb', 62, 6, true)) v(file, version, priority, loads)")
def load_priority(s, d):
    return sigs.load_order(rows(s, "file string, version int", [("main.ndb", 62), ("daily.cvd", 7), ("daily.cld", 7), ("a.ign2", 1), ("local.gdb", 1), ("daily.cfg", 1), ("x.crb", 1)]))


@query(f"SELECT 'ndb' AS kind, false AS official, count(*) AS n FROM {_SIGS}")
def db_count(s, d):
    return sigs.counted({"ndb": _sigs(s)})


@query(f"SELECT name FROM {_SIGS} WHERE regexp_matches(name, '^(PUA|Troj)')")
def find_sigs(s, d):
    return sigs.find(_sigs(s), "^(PUA|Troj)").select("name")


@query("SELECT n_name AS name, md5(n_name) AS digest, CAST(n_regionkey + 10 AS BIGINT) AS size, 'md5' AS algo FROM nation")
def hash_table_parse(s, d):
    lines = t(s, d, "nation").select(F.concat_ws(":", F.md5(F.col("n_name").cast("binary")), (F.col("n_regionkey") + 10).cast("string"), "n_name").alias("value"))
    return sigs.parse(lines, "hdb").select("name", "digest", "size", "algo")


@query("SELECT * FROM (VALUES ('PNG'), ('ZIP'), ('TEXT_ASCII'), ('PDF'), ('BINARY_DATA')) v(type)")
def magic_types(s, d):
    x = s.createDataFrame([(bytearray(b"\x89PNG\r\n\x1a\n..."),), (bytearray(b"PK\x03\x04abc"),), (bytearray(b"plain words"),), (bytearray(b"%PDF-1.4"),), (bytearray(b"\x00\x01\x02\xff"),)], "content binary")
    return x.select(match.magic_type(F.col("content"), ((0, b"PK\x03\x04", "ZIP"), (0, b"%PDF-", "PDF"), (0, b"\x89PNG\r\n\x1a\n", "PNG"))).alias("type"))


# Versions

_OLD = "SELECT CAST(row_number() OVER (ORDER BY n_nationkey) AS BIGINT) AS line_no, n_name AS line FROM nation"


def _lines(s, d):
    from pyspark.sql import Window

    x = t(s, d, "nation")
    return x.select(F.lit("a.db").alias("db"), F.row_number().over(Window.orderBy("n_nationkey")).cast("long").alias("line_no"), F.col("n_name").alias("line"))


def _script(s, d):
    first = [r["line"] for r in _lines(s, d).where("line_no in (2, 3, 5)").orderBy("line_no").collect()]
    lines = ["OPEN a.db", "ADD ZULU", f"DEL 2 {first[0][:3]}", f"XCHG 3 {first[1]} ATLANTIS", "CLOSE"]
    return s.createDataFrame(list(enumerate(lines)), "seq long, value string")


@query(f"WITH o AS ({_OLD}), e AS (SELECT line_no, CASE WHEN line_no = 3 THEN 'ATLANTIS' ELSE line END AS line FROM o WHERE line_no <> 2 UNION ALL SELECT 1000, 'ZULU') SELECT 'a.db' AS db, CAST(row_number() OVER (ORDER BY line_no) AS BIGINT) AS line_no, line FROM e")
def patch_apply(s, d):
    return versions.patched(_lines(s, d), versions.script(_script(s, d)))


@query(f"WITH o AS ({_OLD}), e AS (SELECT CASE WHEN line_no BETWEEN 4 AND 6 THEN 'b.db' ELSE 'a.db' END AS db, line_no, line FROM o) SELECT db, CAST(row_number() OVER (PARTITION BY db ORDER BY line_no) AS BIGINT) AS line_no, line FROM e")
def patch_move(s, d):
    names = {r["line_no"]: r["line"] for r in _lines(s, d).where("line_no in (4, 6)").collect()}
    move = s.createDataFrame([(0, f"MOVE a.db b.db 4 {names[4]} 6 {names[6]}")], "seq long, value string")
    return versions.patched(_lines(s, d), versions.script(move))


@query(f"WITH o AS ({_OLD}) SELECT 'a.db' AS db, CAST(row_number() OVER (ORDER BY line_no) AS BIGINT) AS line_no, line FROM (SELECT line_no, line FROM o WHERE line_no > 2 UNION ALL SELECT 1001, 'V1' UNION ALL SELECT 1002, 'V2')")
def patch_walk(s, d):
    names = {r["line_no"]: r["line"] for r in _lines(s, d).where("line_no in (1, 2)").collect()}
    log = [(6, 0, "OPEN a.db"), (6, 1, f"DEL 1 {names[1]}"), (6, 2, "ADD V1"), (6, 3, "CLOSE"), (7, 0, "OPEN a.db"), (7, 1, f"DEL 1 {names[2]}"), (7, 2, "ADD V2"), (7, 3, "CLOSE")]
    every = None
    for v in (6, 7):
        one = versions.script(s.createDataFrame([(b, c) for a, b, c in log if a == v], "seq long, value string")).withColumn("version", F.lit(v))
        every = one if every is None else every.unionByName(one)
    return versions.walked(_lines(s, d), every, 5, 7)


@query("""
WITH a AS (SELECT s_name AS line FROM supplier WHERE s_suppkey % 3 <> 0), b AS (SELECT s_name AS line FROM supplier WHERE s_suppkey % 4 <> 0)
SELECT 'ADD' AS op, line FROM (SELECT line FROM b EXCEPT ALL SELECT line FROM a) UNION ALL SELECT 'DEL', line FROM (SELECT line FROM a EXCEPT ALL SELECT line FROM b)""")
def db_diff(s, d):
    x = t(s, d, "supplier").select("s_suppkey", F.col("s_name").alias("line"))
    return versions.set_diff(x.where("s_suppkey % 3 <> 0"), x.where("s_suppkey % 4 <> 0"))


@query(f"WITH o AS ({_OLD}), n AS (SELECT line_no, CASE WHEN line_no % 5 = 0 THEN lower(line) ELSE line END AS line FROM o WHERE line_no < 20) SELECT o.line_no AS seq, CASE WHEN n.line IS NULL THEN 'DEL' ELSE 'XCHG' END AS op, o.line_no, o.line AS old_prefix, n.line AS new_line FROM o LEFT JOIN n USING (line_no) WHERE n.line IS NULL OR n.line <> o.line")
def line_diff(s, d):
    old = _lines(s, d).drop("db")
    new = old.where("line_no < 20").withColumn("line", F.when(F.col("line_no") % 5 == 0, F.lower("line")).otherwise(F.col("line")))
    return versions.diff(old, new)


# Links and HTML


@query("""
SELECT page_id, regexp_extract(url, '^[a-z]+://([^:/?]*)', 1) AS host, array_to_string(string_split(regexp_extract(url, '^[a-z]+://([^:/?]*)', 1), '.')[-2:], '.') AS domain, false AS numeric, starts_with(url, 'https:') AS ssl FROM pages""")
def url_parts(s, d):
    h = url.host("url")
    return t(s, d, "pages").select("page_id", h.alias("host"), url.domain(h).alias("domain"), url.is_numeric(h).alias("numeric"), url.is_ssl("url").alias("ssl"))


HOSTS = "('1.2.3.4', true, '3.4'), ('256.1.1.1', true, '1.1'), ('257.1.1.1', false, '1.1'), ('www.bank.co.uk', false, 'bank.co.uk'), ('a.b.example.com', false, 'example.com'), ('localhost', false, 'localhost')"


@query(f"SELECT * FROM (VALUES {HOSTS}) v(h, numeric, domain)")
def url_numeric(s, d):
    return rows(s, "h string", [("1.2.3.4",), ("256.1.1.1",), ("257.1.1.1",), ("www.bank.co.uk",), ("a.b.example.com",), ("localhost",)]).select("h", url.is_numeric("h").alias("numeric"), url.domain("h").alias("domain"))


@query("SELECT * FROM (VALUES ('http://Host.example.org/a/./b/../c?q#f', 'host.example.org/', 'a/c?q'), ('http://u@Example.org:80/%2541', 'example.org/', 'A'), ('ftp://x.org', 'x.org/', ''), ('http://x.org/a b', 'x.org/', 'a%20b')) v(u, host, path)")
def url_canon(s, d):
    x = rows(s, "u string", [("http://Host.example.org/a/./b/../c?q#f",), ("http://u@Example.org:80/%2541",), ("ftp://x.org",), ("http://x.org/a b",)])
    return x.select("u", url.canonical("u").alias("c")).select("u", "c.host", "c.path")


@query("""
WITH p AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^:/?#]*)', 1)) AS h, regexp_replace(regexp_replace(url, '#.*', ''), '^[a-z]+://[^/]*/?', '') AS path FROM pages),
n AS (SELECT *, string_split(h, '.') AS l, split_part(path, '?', 1) AS bare FROM p),
hs AS (SELECT page_id, path, bare, unnest(list_distinct(list_concat([h], list_transform(range(2, greatest(2, least(len(l), 5)) + 1), lambda k: array_to_string(l[greatest(len(l) - k + 1, 1):], '.'))))) AS host FROM n),
ps AS (SELECT host, page_id, unnest(list_distinct(list_concat([path, bare], list_transform(range(0, least(len(string_split(bare, '/')) - 1, 4) + 1), lambda k: CASE WHEN k = 0 THEN '' ELSE array_to_string(string_split(bare, '/')[1:k], '/') || '/' END)))) AS path FROM hs)
SELECT page_id, sha256(host || '/' || path) AS digest FROM ps""")
def url_hash_lookups(s, d):
    return t(s, d, "pages").select("page_id", F.explode(url.lookups("url")).alias("x")).select("page_id", F.sha2("x", 256).alias("digest"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^:/?]*)', 1) AS host, p.name FROM pages JOIN (VALUES ('example.net', 'N'), ('blog.tionble.example.com', 'B')) p(suffix, name) ON regexp_extract(url, '^[a-z]+://([^:/?]*)', 1) = suffix OR ends_with(regexp_extract(url, '^[a-z]+://([^:/?]*)', 1), '.' || suffix)")
def url_lists(s, d):
    p = rows(s, "suffix string, name string", [("example.net", "N"), ("blog.tionble.example.com", "B")])
    x = t(s, d, "pages").select("page_id", url.host("url").alias("host"))
    labels = F.split("host", r"\.", -1)
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    return x.select("page_id", "host", F.explode(tails).alias("suffix")).join(match.small(p), "suffix").select("page_id", "host", "name")


@query(r"""
SELECT page_id, lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&[#0-9A-Za-z_]{0,32};?', ' ', 'g'), '[\x00-\x20]+', ' ', 'g'))) AS body FROM pages""")
def html_notags(s, d):
    return t(s, d, "pages").select("page_id", F.lower(html.no_tags("html")).alias("body"))


@query(r"SELECT page_id, contains(html, '<!--') AS had, false AS has, len(regexp_extract_all(html, '(?is)<script\b[^>]*>')) AS scripts FROM pages")
def html_nocomment(s, d):
    return t(s, d, "pages").select("page_id", F.col("html").contains("<!--").alias("had"), html.no_comment("html").contains("<!--").alias("has"), F.size(html.scripts("html")).cast("long").alias("scripts"))


@query(r"""SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*\shref\s*=\s*"([^"]+)"', 1)) AS target FROM pages""")
def html_links(s, d):
    return t(s, d, "pages").select("page_id", F.explode(html.links("html")).alias("l")).where("l.tag = 'href'").select("page_id", "l.target")


@query("SELECT * FROM (VALUES ('a &amp; b', 'a & b'), ('&#65;&#x42;&euro;', 'AB€'), ('&Unknown; &', '&unknown; &'), ('no', 'no')) v(a, b)")
def html_entities(s, d):
    return rows(s, "a string", [("a &amp; b",), ("&#65;&#x42;&euro;",), ("&Unknown; &",), ("no",)]).select("a", tx.entities("a").alias("b"))


@query("SELECT * FROM (VALUES (1, 'image/png', 'hello')) v(id, type, body)")
def data_uris(s, d):
    x = rows(s, "id int, h string", [(1, '<img src="data:image/png;base64,aGVsbG8=">'), (2, "<img src='x.png'>")])
    return x.select("id", F.explode(html.data_uris("h")).alias("u")).select("id", "u.type", F.decode(F.unbase64("u.body"), "UTF-8").alias("body"))


LINKS = [
    (1, "http://evil.example.org/x", "http://bank.com/login", True), (2, "http://bank.com/a", "https://bank.com", True), (3, "http://1.2.3.4/x", "http://bank.com", True), (4, "http://bank.com@evil.example.org/", "bank.com", True),
    (5, "http://evil.example.org", "click here", True), (6, "http://www.bank.com", "bank.com", True), (7, "http://evil.example.org", "http://bank.com", False), (8, "http://same.com", "http://same.com", True), (9, "not a link", "http://bank.com", True),
]


@query("SELECT * FROM (VALUES (1, 'SPOOFED_DOMAIN'), (2, 'SSL_SPOOF'), (3, 'CLOAKED_NUMERIC_IP'), (4, 'CLOAKED_USERNAME'), (5, 'CLEAN'), (6, 'CLEAN'), (7, 'CLEAN'), (8, 'CLEAN'), (9, 'CLEAN')) v(id, verdict)")
def phish_case(s, d):
    return rows(s, "id int, real string, display string, listed boolean", LINKS).select("id", url.link_verdict(F.col("real"), F.col("display"), listed=F.col("listed"), allowed=F.lit(False)).alias("verdict"))


# Events


@query("SELECT event_id FROM events WHERE user_id NOT IN (1, 2, 3)")
def stream_exclude_users(s, d):
    return streams.admitted(t(s, d, "events"), exclude_users=(1, 2, 3)).select("event_id")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(s, d):
    return streams.first_seen(t(s, d, "events"), keys=["user_id", "event_type"]).select("user_id", "event_type")


@query("SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(s, d):
    return streams.windowed(t(s, d, "events"))


@query("SELECT conv_id AS id, encode(string_agg(text, '' ORDER BY turn)) AS content, CAST(count(*) AS INT) AS parts FROM conversations GROUP BY conv_id")
def partial_messages(s, d):
    x = t(s, d, "conversations")
    total = x.groupBy("conv_id").agg(F.count("*").cast("int").alias("total"))
    p = x.join(total, "conv_id").select(F.col("conv_id").alias("id"), (F.col("turn") + 1).cast("int").alias("number"), "total", F.col("text").cast("binary").alias("content"), F.lit(None).cast("timestamp").alias("ts"))
    return streams.reassembled_batch(p.withColumn("ts", F.timestamp_seconds(F.lit(0))))


@query("SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first FROM events WHERE props IS NOT NULL AND len(json_keys(props)) > 0")
def metadata_json(s, d):
    x = t(s, d, "events").where("props is not null").withColumn("k", F.json_object_keys("props")).where("size(k) > 0")
    return x.select("event_id", F.expr("get_json_object(props, concat('$.', k[0]))").alias("first"))


@query("""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS signs FROM embeddings UNION ALL SELECT vec_id + 1000000000, list_transform(embedding, lambda x: x > 0) FROM embeddings)
SELECT a.vec_id, b.vec_id AS other FROM e a JOIN e b ON a.vec_id <> b.vec_id AND a.signs = b.signs""")
def fuzzy_exact(s, d):
    """All signs of each vector, and a planted copy of it."""
    bits = F.array_join(F.transform("embedding", lambda x: F.when(x > 0, "1").otherwise("0")), "")
    x = t(s, d, "embeddings").select("vec_id", bits.alias("image_hash"))
    x = x.unionByName(x.withColumn("vec_id", F.col("vec_id") + 1_000_000_000))
    known = x.select(F.col("image_hash").alias("digest"), F.col("vec_id").alias("name"))
    return match.image_matches(x, known, id_col="vec_id").where("vec_id <> name").select("vec_id", F.col("name").alias("other"))


# Similarity, scripts, embedded objects, hooks


@query("SELECT * FROM (VALUES ('text/plain', 'text/plian', 90), ('base64', 'BASE64', 100), ('quoted', 'printable', 26), ('abc', 'xyz', 0)) v(a, b, percent)")
def string_similarity(s, d):
    return rows(s, "a string, b string", [("text/plain", "text/plian"), ("base64", "BASE64"), ("quoted", "printable"), ("abc", "xyz")]).select("a", "b", similar.similarity("a", "b").alias("percent"))


@query("""SELECT * FROM (VALUES (1, 'var n000="ab";document.write("AB");'), (2, 'n000(1)')) v(id, code)""")
def script_normalize(s, d):
    x = rows(s, "id int, js string", [(1, "var foo = 'a' + \"b\"; // note\ndocument.write(unescape('%41%42'));"), (2, "eval('alert' + '(1)')")])
    return x.select("id", scripts.normalized("js").alias("code"))


@query(f"""
WITH b AS (SELECT doc_id, string_split({BYTES}, '') AS c FROM documents)
SELECT doc_id, unnest(list_filter(range(1, len(c) - 4), lambda i: c[i + 1] = 't' AND c[i + 2] || c[i + 3] || c[i + 4] || c[i + 5] = 'oken')) AS offset, 'X' AS type FROM b""")
def embedded_objects(s, d):
    x = t(s, d, "documents").select(F.col("doc_id").alias("object_id"), F.col("text").cast("binary").alias("content"))
    return structures.embedded(x, ((b"token", "X"),), most=None).select(F.col("parent_id").alias("doc_id"), "offset", "type")


@query("SELECT * FROM (VALUES ('md5', 'd41d8cd98f00b204e9800998ecf8427e'), ('sha1', 'da39a3ee5e6b4b0d3255bfef95601890afd80709')) v(algo, digest)")
def indicator_documents(s, d):
    item = '<IndicatorItem id="1"><Context document="FileItem"/><Content type="{}">{}</Content></IndicatorItem>'
    text = "<ioc>" + item.format("md5", "D41D8CD98F00B204E9800998ECF8427E") + item.format("sha1", "da39a3ee5e6b4b0d3255bfef95601890afd80709") + item.format("string", "x") + "</ioc>"
    return rows(s, "x string", [(text,)]).select(F.explode(structures.indicators_of_compromise("x")).alias("i")).select("i.*")


@query("SELECT conv_id, turn, contains(text, 'the') AS hit, CASE WHEN contains(text, 'the') THEN length(text) END AS size FROM conversations")
def triggered_hook(s, d):
    from ..operators.hooks import Hooks

    h = Hooks()
    h.add("size", lambda c: F.length(c), ("text",), logic.Logical.parse("T;Target:0;0;746865"))
    return h.run(t(s, d, "conversations"), raw.byte_text("text")).select("conv_id", "turn", F.col("text").contains("the").alias("hit"), "size")


@query("SELECT user_id, count(*) AS n FROM events WHERE event_type IN (SELECT event_type FROM events GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 2) GROUP BY user_id")
def stream_signature_join(s, d):
    e = t(s, d, "events")
    top = e.groupBy("event_type").agg(F.count("*").alias("k")).orderBy(F.desc("k"), "event_type").limit(2).select("event_type")
    return streams.matched(e, top, "event_type").groupBy("user_id").agg(F.count("*").alias("n"))


@query("""
SELECT doc_id AS root_id, CASE WHEN contains(text, 'password') THEN 'STRONG_INDICATOR' ELSE 'NOTHING_FOUND' END AS verdict, CASE WHEN contains(text, 'password') THEN 'Creds.UNOFFICIAL' END AS last_alert, CAST(CASE WHEN contains(text, 'password') THEN 1 ELSE 0 END AS BIGINT) AS alerts FROM documents""")
def whole_scan(s, d):
    from . import scan

    x = t(s, d, "documents").select(F.col("doc_id").alias("object_id"), F.col("text").cast("binary").alias("content"))
    return scan.scan(x, scan.Signatures(bodies=[("Creds.UNOFFICIAL", 0, "*", "70617373776f7264")]), scan.ScanConfig(unpack=False, normalize=False))


@query("SELECT * FROM (VALUES ('ARCHIVE', 4294967295), ('PHISHING', 3)) v(module, mask)")
def module_switches(s, d):
    return sigs.module_switches(s.createDataFrame([("ARCHIVE:0xFFFFFFFF:1:255",), ("PHISHING:0x3:70:",), ("OLD:0x1:1:100",), ("BAD:x:1:2",)], "value string"))


@query("SELECT conv_id, turn, 'MAIL' AS type FROM conversations WHERE contains(text, 'the') AND NOT contains(text, 'and')")
def handler_types(s, d):
    x = t(s, d, "conversations").select(F.struct("conv_id", "turn").alias("object_id"), F.col("text").cast("binary").alias("content"))
    return match.handler_types(x, [logic.Logical.parse("H;Target:0,HandlerType:MAIL;0&1=0;746865;616e64")]).select("object_id.*", "type")

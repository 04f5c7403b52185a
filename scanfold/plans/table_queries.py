"""Further queries over whole tables: signature lines of each kind, executables, texts in other encodings, links, tables of bodies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dlp, html, raw, scripts, tables, url
from ..functions import text as tx
from ..operators import automaton, logic, match, rollup
from ..sources import members
from ..sources import signatures as sigs
from ..streaming import scan as streams
from . import versions
from .member_queries import wrapped
from .queries import docs, query, t

# Lines of each kind of signature table, made of parts


def _lines(s, d, line: str):
    return t(s, d, "part").select(F.expr(line).alias("value"))


@query("SELECT 'P.' || p_partkey AS name, p_size % 13 AS target, CASE WHEN p_partkey % 2 = 0 THEN '*' ELSE 'EOF-' || p_size END AS off, lower(hex(encode(p_name))) AS hex, 10 AS min_fl FROM part")
def sig_bodies(s, d):
    lines = _lines(s, d, "concat_ws(':', concat('P.', p_partkey), p_size % 13, if(p_partkey % 2 = 0, '*', concat('EOF-', p_size)), lower(hex(p_name)), '10')")
    return sigs.parse(lines, "ndb").select("name", "target", "off", "hex", "min_fl")


@query("SELECT 'Worm-' || p_partkey AS name, lower(hex(encode(p_name))) AS hex, 0 AS target, '*' AS off FROM part")
def sig_plain(s, d):
    return sigs.parse(_lines(s, d, "concat('Worm-', p_partkey, '=', lower(hex(p_name)))"), "db").select("name", "hex", "target", "off")


@query("SELECT 'L.' || p_partkey AS name, '0&1>' || p_size AS logic, lower(hex(encode(p_name))) AS first, '0/' || p_brand || ';x/i' AS second, 51 AS min_fl, 255 AS max_fl FROM part")
def sig_logical(s, d):
    lines = _lines(s, d, "concat_ws(';', concat('L.', p_partkey), 'Engine:51-255,Target:0', concat('0&1>', p_size), lower(hex(p_name)), concat('0/', p_brand, ';x/i'))")
    return sigs.parse(lines, "ldb").select("name", "logic", F.get("subs", F.lit(0)).alias("first"), F.get("subs", F.lit(1)).alias("second"), "min_fl", "max_fl")


@query("SELECT md5(p_name) AS digest, 'md5' AS algo, CAST(p_size + 1 AS BIGINT) AS size, 'S.' || p_partkey AS name FROM part")
def sig_sections(s, d):
    return sigs.parse(_lines(s, d, "concat_ws(':', p_size + 1, upper(md5(p_name)), concat('S.', p_partkey))"), "mdb").select("digest", "algo", "size", "name")


@query("SELECT sha256(p_name) AS digest, 'sha256' AS algo, CAST(p_size + 1 AS BIGINT) AS size, 'I.' || p_partkey AS name FROM part")
def sig_imports(s, d):
    return sigs.parse(_lines(s, d, "concat_ws(':', sha2(p_name, 256), p_size + 1, concat('I.', p_partkey))"), "imp").select("digest", "algo", "size", "name")


@query("SELECT 0 AS mode, p_size AS off, lower(hex(encode(p_name))) AS hex, p_brand AS descr, 'CL_TYPE_ANY' AS rtype, 'T' || p_partkey AS type FROM part")
def sig_magics(s, d):
    lines = _lines(s, d, "concat_ws(':', '0', p_size, lower(hex(p_name)), p_brand, 'CL_TYPE_ANY', concat('T', p_partkey))")
    return sigs.parse(lines, "ftm").select("mode", "off", "hex", "descr", "rtype", "type")


@query("SELECT CASE WHEN p_partkey % 2 = 0 THEN 'H' ELSE 'R' END AS kind, replace(p_name, ' ', '.') AS pattern, CASE WHEN p_partkey % 2 = 1 THEN 'shown.' || p_partkey END AS display FROM part")
def sig_protected(s, d):
    lines = _lines(s, d, "concat_ws(':', if(p_partkey % 2 = 0, 'H', 'R'), replace(p_name, ' ', '.'), if(p_partkey % 2 = 1, concat('shown.', p_partkey), null))")
    return sigs.parse(lines, "pdb").select("kind", "pattern", "display")


@query("SELECT CASE WHEN p_partkey % 2 = 0 THEN 'M' ELSE 'X' END AS kind, replace(p_name, ' ', '.') AS pattern, p_brand AS display FROM part")
def sig_allowed(s, d):
    return sigs.parse(_lines(s, d, "concat_ws(':', if(p_partkey % 2 = 0, 'M', 'X'), replace(p_name, ' ', '.'), p_brand)"), "wdb").select("kind", "pattern", "display")


@query("SELECT 'Icon-' || p_partkey AS name, p_brand AS group1, p_type AS group2, md5(p_name) AS metrics FROM part")
def sig_icons(s, d):
    return sigs.parse(_lines(s, d, "concat_ws(':', concat('Icon-', p_partkey), p_brand, p_type, md5(p_name))"), "idb").select("name", "group1", "group2", "metrics")


@query("SELECT 'C' || p_partkey AS name, p_partkey % 2 = 1 AS trusted, sha1(p_name) AS subject, md5(p_name) AS serial, 'ab' AS pubkey, '010001' AS exponent FROM part")
def sig_certificates(s, d):
    lines = _lines(s, d, "concat_ws(';', concat('C', p_partkey), p_partkey % 2, sha(p_name), md5(p_name), 'ab', '010001', '1', '0')")
    return sigs.parse(lines, "crb").select("name", "trusted", "subject", "serial", "pubkey", "exponent")


@query("SELECT p_brand AS name, CAST(p_partkey AS BIGINT) AS size, sha256(p_name) AS digest FROM part")
def sig_info(s, d):
    return sigs.parse(_lines(s, d, "concat_ws(':', p_brand, p_partkey, sha2(p_name, 256))"), "info").select("name", "size", "digest")


@query("SELECT 'W' || p_partkey AS name, p_size % 2 AS pwtype, p_name AS password FROM part")
def sig_passwords(s, d):
    return sigs.parse(_lines(s, d, "concat_ws(';', concat('W', p_partkey), 'Engine:81-255,Target:0', p_size % 2, p_name)"), "pwdb").select("name", "pwtype", "password")


@query("SELECT p_size % 13 AS target, count(*) AS n FROM part GROUP BY 1")
def db_load(s, d):
    """A table written as a file, loaded by its name."""
    where = f"{tables.shared_dir(s)}/load-{s.sparkContext.applicationId}.ndb"
    _lines(s, d, "concat_ws(':', concat('P.', p_partkey), p_size % 13, '*', lower(hex(p_name)))").write.mode("overwrite").text(where)
    return sigs.load(s, where, "ndb").groupBy("target").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'PUA.Win.Tool-' WHEN p_partkey % 3 = 1 THEN 'PUA.Unix.Miner-' ELSE 'Eicar-' END || p_partkey AS name FROM part WHERE p_size * 10 <= 240 AND p_size * 10 + p_partkey % 400 >= 240 AND p_partkey % 3 <> 1 AND p_partkey % 7 <> 3")
def sig_filters(s, d):
    """Feature levels, unwanted categories and an ignore list over a table of signatures, one after another."""
    name = F.concat(F.when(F.col("p_partkey") % 3 == 0, "PUA.Win.Tool-").when(F.col("p_partkey") % 3 == 1, "PUA.Unix.Miner-").otherwise("Eicar-"), "p_partkey")
    x = t(s, d, "part").select("p_partkey", name.alias("name"), (F.col("p_size") * 10).alias("min_fl"), (F.col("p_size") * 10 + F.col("p_partkey") % 400).cast("int").alias("max_fl"), F.concat(name, F.lit(":0:*:6162")).alias("entry"))
    ignored = sigs.parse(x.where("p_partkey % 7 = 3").select(F.col("name").alias("value")), "ign2")
    return sigs.without_ignored(sigs.unwanted(sigs.active(x, 240), include=["Win"]), ignored).select("p_partkey", "name")


# Tables of bodies, magics, executables


@query("""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{5,}')) AS w FROM benchmark)
SELECT doc_id, w AS name FROM documents JOIN w ON contains(text, w)""")
def body_table(s, d):
    """Every longer word of the benchmark as a body signature, beside 50,000 bodies that don't occur, through one automaton."""
    words = t(s, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]{5,}"), F.lit(0))).alias("name")).distinct()
    table = words.select("name", F.lit("*").alias("off"), F.lower(F.hex("name")).alias("hex"))
    absent = s.range(50_000).select(F.concat(F.lit("absent"), "id").alias("name"), F.lit("*").alias("off"), F.concat(F.lit("0001"), F.lpad(F.lower(F.hex("id")), 6, "0"), F.lit("ff")).alias("hex"))
    return automaton.matches(docs(s, d), table.unionByName(absent)).select(F.col("object_id").alias("doc_id"), "name")


@query(r"""
SELECT doc_id, 'Gap' AS name, CAST(NULL AS BIGINT) AS first FROM documents WHERE regexp_matches(text, '(?s)the.{2,6}and') UNION ALL SELECT doc_id, 'Alt', NULL FROM documents WHERE regexp_matches(text, '(?s)(?:and|ing|ou)er')
UNION ALL SELECT doc_id, 'NoCase', NULL FROM documents WHERE regexp_matches(text, '(?i)TOKEN') UNION ALL SELECT doc_id, 'Start', 0 FROM documents WHERE text LIKE 'The%' UNION ALL SELECT doc_id, 'End', strlen(text) - 1 FROM documents WHERE text LIKE '%.'""")
def body_table_forms(s, d):
    """Gaps, alternates, case and places in a table of bodies."""
    lines = [("Gap", "*", "746865{2-6}616e64", ""), ("Alt", "*", "(616e64|696e67|6f75)6572", ""), ("NoCase", "*", "544f4b454e", "i"), ("Start", "0", "546865", ""), ("End2", "EOF-2", "??2e", ""), ("Never", "EP+0", "546865", "")]
    hit = automaton.matches(docs(s, d), s.createDataFrame(lines, "name string, off string, hex string, options string"))
    first = F.when(F.col("name") == "Start", F.get("offsets", F.lit(0))).when(F.col("name") == "End2", F.get("offsets", F.lit(0)) + 1)
    return hit.select(F.col("object_id").alias("doc_id"), F.when(F.col("name") == "End2", "End").otherwise(F.col("name")).alias("name"), first.alias("first"))


@query("""
WITH m AS (SELECT doc_id, CASE WHEN substring(text, 2, 3) = 'he ' THEN 3 WHEN text LIKE 'The%' THEN 2 WHEN text LIKE 'T%' THEN 1 END AS k FROM documents)
SELECT doc_id, ['ONE', 'TWO', 'THREE'][k] AS type FROM m WHERE k IS NOT NULL""")
def magic_table(s, d):
    magics = s.createDataFrame([(1, 0, bytearray(b"T"), "ONE"), (2, 0, bytearray(b"The"), "TWO"), (3, 1, bytearray(b"he "), "THREE")], "seq long, off int, magic binary, type string")
    x = docs(s, d).withColumn("content", F.col("content").cast("binary"))
    return match.magic_matches(x, magics).select(F.col("object_id").alias("doc_id"), "type")


@query("SELECT doc_id, CASE WHEN strlen(text) > 0 THEN CAST(512 AS BIGINT) END AS ep, 2 AS nsections, CAST(strlen(text) AS BIGINT) AS size, md5(text) AS digest FROM documents")
def exe_sections(s, d):
    x = members.with_exe(wrapped(t(s, d, "documents"), "program"))
    first = F.get("exe.sections", F.lit(0))
    body = raw.window("content", first["raw"].cast("int"), first["rsz"].cast("int"))
    return x.select(F.col("object_id").alias("doc_id"), "exe.ep", "exe.nsections", first["rsz"].alias("size"), F.md5(body).alias("digest"))


@query("""
WITH k AS (SELECT md5(text) AS digest, 'Section.' || min(doc_id) AS name FROM documents JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY 1)
SELECT doc_id, name FROM documents JOIN k ON md5(text) = digest""")
def section_hashes(s, d):
    x = t(s, d, "documents")
    good = x.join(t(s, d, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")
    known = good.groupBy(F.md5(F.col("text").cast("binary")).alias("digest"), F.octet_length("text").cast("long").alias("size")).agg(F.concat(F.lit("Section."), F.min("doc_id")).alias("name")).withColumn("algo", F.lit("md5"))
    return match.section_matches(members.with_exe(wrapped(x, "program")), known).where("section = 0").select(F.col("object_id").alias("doc_id"), "name")


@query("SELECT doc_id, 'Import.' || doc_id AS name FROM documents JOIN labels USING (doc_id) WHERE quality = 1")
def import_hashes(s, d):
    x = t(s, d, "documents")
    key = F.concat(F.lit("kernel32.d"), "doc_id", F.lit(",kernel32.ord7"))
    known = t(s, d, "labels").where("quality = 1").select(F.lit("md5").alias("algo"), F.md5(key.cast("binary")).alias("digest"), F.length(key).cast("long").alias("size"), F.concat(F.lit("Import."), "doc_id").alias("name"))
    wild = known.where("length(name) % 2 = 0").withColumn("size", F.lit(None).cast("long"))
    return match.import_matches(wrapped(x, "program"), known.where("length(name) % 2 = 1").unionByName(wild)).select(F.col("object_id").alias("doc_id"), "name")


@query("SELECT doc_id, 'Entry' AS name FROM documents WHERE text LIKE 'The%'")
def entry_points(s, d):
    """A body at the entry point of programs."""
    x = members.with_exe(wrapped(t(s, d, "documents"), "program"))
    return match.body_matches(x, [("Entry", "EP+0", "546865", "")], exe="exe").select(F.col("object_id").alias("doc_id"), "name")


# Texts in other forms


@query("SELECT doc_id, sha256(text) AS wide, sha256(text) AS big, 'UTF-16LE' AS bom, sha256(regexp_replace(text, '[^\\x00-\\x{ff}]', '', 'g')) AS page FROM documents")
def text_encodings(s, d):
    """UTF-16 of either order back to text, the announced encoding, and a code page."""
    x = t(s, d, "documents").select("doc_id", "text", F.encode("text", "UTF-16LE").alias("le"), F.encode("text", "UTF-16BE").alias("be"))
    latin = F.encode(F.regexp_replace("text", r"[^\x00-\xff]", ""), "ISO-8859-1")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return x.select("doc_id", digest(tx.to_utf8("le", "UTF-16LE")).alias("wide"), digest(tx.to_utf8("be", "UTF-16BE")).alias("big"), tx.bom(F.concat(F.lit(bytearray(b"\xff\xfe")), "le")).alias("bom"), digest(tx.to_utf8(latin, "ISO-8859-1")).alias("page"))


@query("SELECT p_partkey, CAST(p_partkey AS BIGINT) AS number, p_name AS line, p_name AS ascii, p_type || '/' || p_name AS safe, p_name AS plain, p_brand AS field FROM part")
def string_tools(s, d):
    """Hexadecimal numbers, line ends, wide characters, paths, escapes and fields, all undone."""
    x = t(s, d, "part")
    escaped = F.regexp_replace(F.hex("p_name"), "(..)", "%$1")
    return x.select(
        "p_partkey", tx.hex_number(F.lower(F.hex("p_partkey"))).alias("number"), tx.chomp(F.concat("p_name", F.lit("\r\n\n"))).alias("line"), tx.utf16_ascii(F.encode("p_name", "UTF-16LE")).alias("ascii"),
        tx.sanitized_path(F.concat(F.lit("../"), "p_type", F.lit("//./..\\"), "p_name")).alias("safe"), tx.unescape(escaped).alias("plain"), tx.field(F.concat_ws(":", "p_name", "p_brand", "p_type"), 1, ":").alias("field"),
    )


@query("SELECT a.p_partkey AS a, b.p_partkey AS b, CASE WHEN a.p_size < b.p_size THEN -1 WHEN a.p_size > b.p_size THEN 1 WHEN a.p_partkey < b.p_partkey THEN -1 WHEN a.p_partkey > b.p_partkey THEN 1 ELSE 0 END AS sign FROM part a JOIN part b ON b.p_partkey = a.p_partkey * 7 % 100")
def version_pairs(s, d):
    a = t(s, d, "part").select(F.col("p_partkey").alias("a"), F.concat_ws(".", "p_size", "p_partkey").alias("u"))
    b = t(s, d, "part").select(F.col("p_partkey").alias("b"), F.concat_ws(".", "p_size", "p_partkey").alias("v"))
    return a.join(b, b["b"] == a["a"] * 7 % 100).select("a", "b", tx.version_compare("u", "v").alias("sign"))


@query("SELECT p_partkey, p_partkey % 1000 > 200 AS over FROM part")
def byte_compare_table(s, d):
    x = t(s, d, "part").select("p_partkey", raw.byte_text(F.concat(F.lit("x len="), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0"), F.lit(" end"))).alias("b"))
    return x.select("p_partkey", logic.Logical.parse("Over;Target:0;0&1;6c656e3d;0(>>4#de3#>200)").fires(F.col("b")).alias("over"))


@query("""
WITH n AS (SELECT c_custkey, lpad(CAST((c_custkey * 7919 + 11000015) % 1000000000 AS VARCHAR), 9, '0') AS x FROM customer), g AS (SELECT *, list_transform(string_split(x, ''), lambda c: CAST(c AS INT)) AS y FROM n)
SELECT c_custkey, (7 * (y[1] + y[4] + y[7]) + 3 * (y[2] + y[5] + y[8]) + 9 * (y[3] + y[6])) % 10 = y[9] AS micr,
  CAST(x[1:3] AS INT) BETWEEN 1 AND 772 AND x[1:3] <> '666' AND x[4:5] <> '00' AND x[6:9] <> '0000' AS ssn FROM g""")
def dlp_table(s, d):
    """Routing and identity numbers made of all customers' keys."""
    x = t(s, d, "customer").select("c_custkey", F.lpad(((F.col("c_custkey") * 7919 + 11_000_015) % 1_000_000_000).cast("string"), 9, "0").alias("x"))
    dashed = F.concat_ws("-", F.substring("x", 1, 3), F.substring("x", 4, 2), F.substring("x", 6, 4))
    return x.select("c_custkey", dlp.valid_micr("x").alias("micr"), (F.size(dlp.ssns(dashed)) > 0).alias("ssn"))


# Pages and their links


@query("SELECT page_id, sha256(html) AS plain FROM pages")
def page_entities(s, d):
    """Every ampersand of a page escaped, and one level of escapes undone."""
    plain = tx.entities(F.replace("html", F.lit("&"), F.lit("&amp;")))
    return t(s, d, "pages").select("page_id", F.sha2(plain.cast("binary"), 256).alias("plain"))


@query("SELECT page_id, 'image/png' AS type, url AS body FROM pages")
def page_data_uris(s, d):
    planted = F.concat("html", F.lit('<img src="data:image/png;base64,'), raw.to_base64("url"), F.lit('">'))
    return t(s, d, "pages").select("page_id", F.explode(html.data_uris(planted)).alias("u")).select("page_id", "u.type", F.decode(F.unbase64("u.body"), "UTF-8").alias("body"))


@query("""
SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^:/?#]*)', 1)) || '/' AS host, regexp_replace(regexp_replace(url, '#.*', ''), '^[a-z]+://[^/]*/', '') AS path FROM pages""")
def page_canonical(s, d):
    """Each page's address, with dot components, an escaped letter and a fragment planted."""
    odd = F.regexp_replace(F.regexp_replace("url", "#.*", ""), r"\A([a-z]+://[^/]*)/", "$1/./x%2e/../y/%2e%2E/")
    return t(s, d, "pages").select("page_id", url.canonical(F.concat(odd, F.lit("#part"))).alias("c")).select("page_id", "c.host", "c.path")


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'CLEAN' WHEN page_id % 3 = 1 THEN 'SPOOFED_DOMAIN' ELSE 'CLEAN' END AS verdict FROM pages")
def page_links_judged(s, d):
    """Links to all pages, shown as a protected bank's, as an unprotected one's, or as themselves."""
    k = F.col("page_id") % 3
    shown = F.when(k == 2, F.col("url")).otherwise("http://bank.com/login")
    return t(s, d, "pages").select("page_id", url.link_verdict(F.col("url"), shown, listed=k == 1, allowed=F.lit(False)).alias("verdict"))


@query("SELECT page_id, regexp_extract(url, '^([a-z]+://[^:/?]*)', 1) AS cleaned, url AS found FROM pages")
def page_links_cleaned(s, d):
    """Protocol and host alone, and the link found again in running text."""
    return t(s, d, "pages").select("page_id", url.cleaned("url").alias("cleaned"), F.get(url.text_links(F.concat(F.lit("see "), "url", F.lit(" or "))), F.lit(0)).alias("found"))


@query("""SELECT page_id, 'var n000="a' || page_id || '";document.write("AB");' AS code FROM pages""")
def page_scripts(s, d):
    code = F.concat(F.lit("var foo = 'a' + \""), "page_id", F.lit("\"; // note\ndocument.write(unescape('%41%42'));"))
    return t(s, d, "pages").select("page_id", scripts.normalized(code).alias("code"))


# Roll-ups, streams, versions


@query("SELECT l_returnflag AS name, CAST(sum(l_linenumber) AS BIGINT) AS matches, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS micros, count(*) AS runs FROM lineitem GROUP BY 1")
def rule_costs(s, d):
    return rollup.rule_costs(t(s, d, "lineitem").select(F.col("l_returnflag").alias("name"), F.col("l_linenumber").cast("long").alias("matches"), F.col("l_quantity").cast("long").alias("micros")))


@query("SELECT conv_id AS stream, sha256(string_agg(text, '' ORDER BY turn)) AS digest, false AS refused FROM conversations GROUP BY conv_id")
def stream_chunks(s, d):
    x = t(s, d, "conversations").select(F.col("conv_id").alias("stream"), F.col("turn").alias("seq"), F.col("text").cast("binary").alias("content"))
    ends = x.groupBy("stream").agg((F.max("seq") + 1).alias("seq")).withColumn("content", F.lit(bytearray()))
    joined = streams.joined_chunks(x.where("octet_length(content) > 0").unionByName(ends))
    return joined.select("stream", F.sha2("content", 256).alias("digest"), "refused")


@query("SELECT '/p/' || p_size || '/' || p_partkey AS path FROM part WHERE p_size % 5 <> 0 AND p_partkey % 2 = 0")
def stream_watched(s, d):
    """Folders added, some of them removed again by themselves, others with the folder above."""
    x = t(s, d, "part")
    path = F.concat(F.lit("/p/"), "p_size", F.lit("/"), "p_partkey")
    added = x.select(F.col("p_partkey").cast("long").alias("seq"), F.lit("add").alias("op"), path.alias("path"))
    gone = x.where("p_partkey % 2 = 1").select((F.col("p_partkey") + 10**9).cast("long").alias("seq"), F.lit("remove").alias("op"), path.alias("path"))
    above = x.where("p_size % 5 = 0").select(F.lit(2 * 10**9).cast("long").alias("seq"), F.lit("remove").alias("op"), F.concat(F.lit("/p/"), "p_size").alias("path")).distinct()
    return streams.watched_tree(added.unionByName(gone).unionByName(above))


@query("SELECT p_name || p_partkey AS file FROM part WHERE p_partkey % 3 = 0")
def db_pruned(s, d):
    x = t(s, d, "part").select(F.concat("p_name", "p_partkey").alias("file"), "p_partkey")
    return versions.pruned(x, x.where("p_partkey % 3 <> 0").select("file")).select("file")


@query("SELECT c_custkey AS object_id, k AS ancestor_id FROM (SELECT c_custkey, unnest(range(greatest(0, c_custkey // 40 * 40), c_custkey + 1)) AS k FROM customer) WHERE k >= 1 OR c_custkey = 0")
def deep_ancestors(s, d):
    """Chains of forty objects: trust goes down through all levels."""
    key = F.col("c_custkey")
    x = t(s, d, "customer").select(key.alias("object_id"), F.when((key % 40 != 0) & (key > 1), key - 1).alias("parent_id"))
    return rollup.ancestors(x)


@query("""
WITH a AS (SELECT c_custkey, ((4294967295 - c_custkey) + c_custkey * 32768) & 4294967295 AS k FROM customer), b AS (SELECT c_custkey, xor(k, k >> 12) AS k FROM a), c AS (SELECT c_custkey, (k + k * 4) & 4294967295 AS k FROM b),
d AS (SELECT c_custkey, xor(k, k >> 4) AS k FROM c), e AS (SELECT c_custkey, (k * 2057) & 4294967295 AS k FROM d) SELECT c_custkey, CAST(xor(k, k >> 16) AS BIGINT) AS hash FROM e""")
def hash_mix(s, d):
    return t(s, d, "customer").select("c_custkey", tx.hash32("c_custkey").alias("hash"))


@query("SELECT doc_id, k AS kind, k AS type FROM documents, (VALUES ('HFSPLUS'), ('ISO9660'), ('UDF')) v(k)")
def volume_types(s, d):
    """What partitions hold, told by magics at their places."""
    from . import scan

    every = None
    for kind, name in (("hfs", "HFSPLUS"), ("iso", "ISO9660"), ("udf", "UDF")):
        one = wrapped(t(s, d, "documents"), kind).select(F.col("object_id").alias("doc_id"), F.lit(name).alias("kind"), scan.volume_type("content").alias("type"))
        every = one if every is None else every.unionByName(one)
    return every


@query("SELECT doc_id, 'words:' || len(regexp_extract_all(text, 'the')) AS name FROM documents WHERE contains(text, 'the')")
def user_inspection(s, d):
    """A user's function over each object's bytes."""
    from ..operators import reader

    def look(r):
        n = 0
        while (at := r.find(b"the")) >= 0:
            n += 1
            r.seek(at + 3)
        return f"words:{n}" if n else None

    return reader.inspected(docs(s, d), look).select(F.col("object_id").alias("doc_id"), "name")


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def windows_of_objects(s, d):
    """A nested view of each object, of all its bytes."""
    return docs(s, d).select(F.col("object_id").alias("doc_id"), F.sha2(raw.window("content", 0, F.octet_length("content")), 256).alias("digest"))

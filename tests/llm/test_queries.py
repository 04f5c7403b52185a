"""Registered queries and the pipeline on small tables, against SQL and brute force."""

import os
import random

import duckdb
import pytest

import corpus_pipeline
from scanfold.llm import counts, langid, neardup, queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = queries.queries()[name](spark, FOLDER)
    rel = con.sql(queries.oracle_sql()[name])
    order = sorted(df.columns)
    assert order == sorted(rel.columns)
    key = lambda rows, columns: sorted(tuple(str(r[columns.index(c)]) for c in order) for r in rows)
    assert key([tuple(r) for r in df.collect()], df.columns) == key(rel.fetchall(), rel.columns)


def test_contract_columns(spark):
    want = {
        "op3_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op4_sentencepiece": "doc_id n_tokens ids_sha256 decoded_sha256", "op6_language": "doc_id held_out lang_pred score",
        "op8_media": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature", "op9_token_counts": "doc_id n_tokens score",
    }
    n = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    for name, columns in want.items():
        df = queries.queries()[name](spark, FOLDER)
        assert df.columns == columns.split()
        assert df.select("doc_id").distinct().count() == n


def test_held_out_accuracy(spark):
    df = queries.op6_language(spark, FOLDER).where("held_out").join(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = df.collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.95


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs
        if name != "packing":
            assert docs.columns == columns
    text = lambda df: {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}
    start = text(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    one, two, three = (text(seen[k]) for k in ("language", "near_duplicates", "secrets"))
    assert all(start[d] == x for d, x in one.items()) and len(one) >= 0.98 * len(start)
    kept = {r["doc_id"] for r in neardup.near_duplicates(seen["language"], words=5, percent=80).where("kept").collect()}
    assert set(two) == kept and set(three) == set(two)
    for d, x in three.items():
        if x != two[d]:
            assert "<SECRET>" in x
    packed = seen["packing"].groupBy("doc_id").sum("length").collect()
    assert {r["doc_id"] for r in packed} == set(three)
    assert corpus_pipeline.run(spark, FOLDER).count() == seen["packing"].count() and corpus_pipeline.ORACLE_SQL is None


def test_language_stage_drops_unlearned_texts(spark):
    r = random.Random(11)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    words = "minä sinä hän olen talo järvi kaunis päivä yö metsä ihminen kirja lukea kirjoittaa sataa lumi syksy kevät tänään huomenna ystävä koulu työ ja mutta sillä koska vaikka kun niin kuin myös".split()
    planted = [" ".join(r.choices(words, k=n)) for n in (40, 80, 200) * 10]
    planted += ["".join(r.choice(letters) for _ in range(n)) for letters in ("αβγδεζηθικλμνξοπρστυφχψω   ", "abcdefghijklmnopqrstuvwxyz   ") for n in (200, 600, 3000) * 10]
    extra = spark.createDataFrame([(10**6 + k, x, None, "s", len(x)) for k, x in enumerate(planted)], docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    kept = corpus_pipeline.language(spark, docs.unionByName(extra), FOLDER)
    assert kept.where("doc_id >= 1000000").count() == 0
    assert kept.count() >= 0.98 * docs.count()
    spanish = docs.where("lang = 'es'")
    model = langid.LanguageModel.fit(docs.where("lang <> 'es'"), limits=True)
    assert model.kept(spanish, least=None).count() <= 0.1 * spanish.count()


def test_language_stage_learns_from_every_row(spark):
    """Prototypes, least scores and what the stage keeps, once more over all labelled rows; a sample of each label has others."""
    import numpy as np

    r = random.Random(3)
    words = {"aa": "the and ing tion of to with from".split(), "bb": "der die und sch ein ich mit von".split()}
    line = lambda lang, n: " ".join("".join(r.choices(words[lang], k=2)) if r.random() < 0.9 else "".join(r.choices("klmnopq", k=5)) for _ in range(n))
    rows = [(k, line(lang, r.choice([2, 5, 12])), lang) for k in range(7000) for lang in ["aa" if k % 7 < 5 else "bb"]]
    noisy = lambda share, n: " ".join("".join(r.choices(words["bb"], k=2)) if r.random() < share else "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(n))
    rows += [(10**4 + k, noisy(k / 1000, 12), None) for k in range(1000)] + [(None, "123 ...", "aa"), (2 * 10**4, None, "bb"), (None, line("aa", 5), "aa")]
    rows += rows[:50]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    bundles, has, size = langid.Profiler().profile([x[1] for x in rows])
    units = bundles / np.maximum(np.linalg.norm(bundles, axis=1, keepdims=True), 1e-9)
    own = np.array([x[2] for x in rows], object)
    labels, one = ["aa", "bb"], lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    totals = np.stack([units[has & (own == x)].astype(float).sum(axis=0) for x in labels])
    model = langid.LanguageModel.fit(df, limits=True)
    assert model.labels == labels and np.abs(model.prototypes - one(totals)).max() < 1e-5
    least = {}
    for k, x in enumerate(labels):
        mine = has & (own == x)
        score = (units[mine] * one(totals[k] - units[mine])).sum(axis=1)
        for c in set(size[mine]):
            least[k, c] = max(3 / 32, 0.75 * np.percentile(score[size[mine] == c], 1))
            assert abs(model.limits[k, c] - least[k, c]) < 1e-5
    cosines = units @ one(totals).T
    best = cosines.argmax(axis=1)
    above = np.array([cosines[i, b] - next((least[b, c] for c in range(size[i], -1, -1) if (b, c) in least), 9.0) if has[i] else -9.0 for i, b in enumerate(best)])
    assert min((above > 1e-4).sum(), (above < -1e-4).sum()) > 100
    kept = {x["text"] for x in corpus_pipeline.language(spark, df, FOLDER).collect()}
    assert {x[1] for x, a in zip(rows, above, strict=True) if a > 1e-4} <= kept
    assert not kept & {x[1] for x, a in zip(rows, above, strict=True) if a < -1e-4}


def test_language_predictions_by_brute_force(spark):
    """op6 once more: letter by letter, in plain loops over the n-grams of each text."""
    from collections import Counter

    import numpy as np
    from zlib import crc32

    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    vector = langid.Profiler()._vector
    bound = {}

    def unit(text):
        letters = [c if c.isalpha() else "" for c in (text or "").lower()]
        line = [""]
        for c in [*letters, ""]:
            if c or line[-1]:
                line.append(c)
        grams = Counter(g for g in zip(line, line[1:], line[2:]) if g[1])
        total = np.zeros(1024)
        for g, n in grams.items():
            if g not in bound:
                a, b, c = (vector(ord(x) if x else 0).astype(int) for x in g)
                bound[g] = np.roll(a, 2) * np.roll(b, 1) * c
            total += n * bound[g]
        return total / max(np.linalg.norm(total), 1e-9), any(letters)

    units = {r["doc_id"]: unit(r["text"]) for r in rows}
    sums = {}
    for r in rows:
        u, ok = units[r["doc_id"]]
        if ok and r["lang"] is not None and crc32(str(r["doc_id"]).encode()) % 4 != 2:
            sums[r["lang"]] = sums.get(r["lang"], 0) + u
    sums = {k: v / np.linalg.norm(v) for k, v in sums.items()}
    for r in queries.op6_language(spark, FOLDER).collect():
        u, ok = units[r["doc_id"]]
        if not ok:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        cosines = {k: float(u @ v) for k, v in sums.items()}
        assert abs(r["score"] - max(0.0, *cosines.values())) < 1e-4 and cosines[r["lang_pred"]] >= max(cosines.values()) - 1e-5


def test_token_counts_of_the_query_equal_the_library(spark):
    lib = counts.library_tokenizer(queries.tokenizer_path("piece_bpe_32k.model"))
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = {r["doc_id"]: r["n_tokens"] for r in queries.op9_token_counts(spark, FOLDER).collect()}
    assert got == {d: len(lib.encode(x, add_special_tokens=False).ids) for d, x in texts.items()}


def test_pipeline_on_hard_rows(spark, tmp_path):
    """Every stage, by brute force, over nulls, repeated ids and rows, empty and long texts, clashing names and no rows."""
    from tests.llm.test_operators import near_brute

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    base = {r["doc_id"]: r for r in docs.collect()}
    english = [r["text"] for r in base.values() if r["lang"] == "en" and 200 < len(r["text"]) < 2000][:4]
    key = "token=z9Y8z9Y8z9Y8z9Y8"
    hard = [
        (None, english[0], "en", "s"), (1, None, None, None), (2, "", "en", "s"), (3, " \n", "en", "s"), (4, english[1], "en", "s"), (9, english[1], "en", "s"), (9, english[2], "en", None), (9, english[2], "en", "s"),
        (10, english[3] + " " + key, "en", "s"), (11, english[3].upper() + " " + key, "en", "s"), (12, english[0] * 300, "en", "s"), (13, "12345 ...", "en", "s"),
    ]
    clash = ["row", "rep", "key", "spans", "first", "kept", "ids", "score", "_scanfold"]
    extra = spark.createDataFrame([(*r, len(r[1] or "")) for r in hard], docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    learned = docs.where("doc_id >= 100").select("doc_id", "text", "lang", "source", "n_chars")
    table = extra.unionByName(learned.withColumn("doc_id", learned["doc_id"] + 10**6))
    from pyspark.sql import functions as F

    table = table.withColumns({c: F.lit(f"own {c}") for c in clash})
    now, seen = table, {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, FOLDER)
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = now
        assert name == "packing" or now.columns == table.columns
    pairs = lambda df: sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in df.select("doc_id", "text").collect()), key=str)
    small = lambda df: [x for x in pairs(df) if x[1] < 10**6]
    assert sorted(x[1] for x in small(seen["language"])) == [0, 4, 9, 9, 9, 10, 11, 12]
    order = sorted(((None if n else d, t) for n, d, t in pairs(seen["language"])), key=lambda r: (r[0] is None, r[0] or 0))
    brute = near_brute([(k, t) for k, (_, t) in enumerate(order)], 5, 80)
    roots = {b[3] for b, (d, _) in zip(brute, order, strict=True) if d is not None}
    want = sorted(((d is None, d or 0, t) for k, (d, t) in enumerate(order) if d is None or k in roots), key=str)
    assert sorted(x[1] for x in pairs(seen["near_duplicates"])) == sorted(x[1] for x in want)
    assert sorted(x[1] for x in small(seen["near_duplicates"]) if not x[0]) == [4, 9, 10, 12]
    masked = {x[1]: x[2] for x in small(seen["secrets"]) if not x[0]}
    assert masked[10] == english[3] + " <SECRET>" and masked[4] == english[1]
    assert seen["packing"].where("doc_id is null or doc_id < 1000000").select("doc_id").distinct().count() == 5
    now = table.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, FOLDER)
        assert now.count() == 0


def test_digests_against_libraries(spark):
    import hashlib
    import struct
    import zlib

    import sentencepiece
    from tokenizers import Tokenizer

    from scanfold.llm import media

    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    bpe, sp = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json")), sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    for r in queries.op3_packing(spark, FOLDER).collect():
        ids = [*bpe.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 2]
        part = ids[r["start"] : r["start"] + r["length"]]
        assert (r["doc_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))
    h = lambda b: hashlib.sha256(b).hexdigest()
    for r in queries.op4_sentencepiece(spark, FOLDER).collect():
        ids = [*sp.encode(texts[r["doc_id"]]), 2]
        assert tuple(r)[1:] == (len(ids), h(" ".join(map(str, ids)).encode()), h(sp.decode(ids).encode()))
    for r in queries.op8_media(spark, FOLDER).collect():
        data = texts[r["doc_id"]].encode()
        padded = data + bytes(-len(data) % 64 if data else 64)
        assert tuple(r)[1:5] == (len(data), len(padded), h(padded), zlib.crc32(padded[-64:])) and len(r["feature"]) == 16
        import numpy as np

        png = media.encode_png(np.frombuffer(padded, np.uint8).reshape(-1, 64))
        assert png[8 + 25 + 8] == 0x78 and zlib.decompress(png[8 + 25 + 8 : -16])[:: 65] == b"\x02" * (len(padded) // 64)  # rows under filter 2
        assert (r["media_bytes"], r["media_sha256"]) == (len(png), h(png))

"""Cases that once went wrong, and the plumbing that keeps hot keys from filling a task."""

import random
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strataweave.llm import ann, common, langid, line_dedup, minhash, mixing, packing, pii, queries, warc
from strataweave.llm.common import new_path


def test_pii_long_zero_runs_and_words_after_an_iban():
    kinds = lambda t: [s["kind"] for s in pii.find_spans(t)]
    assert kinds("0" * 5000 + ".1.1.1") == ["ip"] and kinds("0" * 5000 + "256.1.1.1") == []
    spans = pii.find_spans("IBAN GB82 WEST 1234 5698 7654 32 AND MORE WORDS GB82 WEST 1234 5698 7654 32")
    assert [(s["kind"], s["start"], s["end"]) for s in spans] == [("iban", 5, 32), ("iban", 48, 75)]
    assert kinds("lessn 078-05-1120") == [] and kinds("my ssn: 078-05-1120") == ["ssn"]
    plain = pii.find_spans("ship 10.0.0.1")[0]["score"]
    assert pii.find_spans("host 10.0.0.1")[0]["score"] > plain == pii.find_spans("chip 10.0.0.1")[0]["score"]


def test_pii_secrets_need_spread_and_context():
    kinds = lambda t: [s["kind"] for s in pii.find_spans(t)]
    key = "11acdfb36bb72224148e6160f674b4be45601bff"
    assert kinds(f'token = "{key}"') == ["secret"] and kinds(f"see {key}") == []
    assert kinds("token = " + "a" * 40) == [] and kinds("password: " + "ab12" * 8) == []


def test_pii_columns_and_repeats(spark):
    rows = [(1, "a@b.de token aB3dE5fG7hJ9kL1mN3pQ"), (1, "a@b.de token aB3dE5fG7hJ9kL1mN3pQ")]
    got = pii.digest_columns(pii.detect(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got.columns[:7] == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    assert [(r.n_email, r.n_secret, r.n_private) for r in got.collect()] == [(1, 1, 2)] * 2


def test_line_dedup_carriage_returns_names_and_salts(spark, monkeypatch):
    rows = [(i, "h", f"menu\r\n\r\nline {i}\r\n\t\r\nend {i}", 7, 8, "x", "y") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, host string, text string, n_lines long, n_dropped int, bad string, row string")
    want = {i: (f"\r\nline {i}\r\n\t\r\nend {i}", 5, 1, "x", "y") for i in range(30)}
    for limit in (line_dedup.BROADCAST_ROWS, 0):
        monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", limit)
        got = line_dedup.drop_lines(df, "host")
        assert sorted(got.columns) == sorted(df.columns)
        assert {r.doc_id: (r.text, r.n_lines, r.n_dropped, r.bad, r.row) for r in got.collect()} == want
    few = line_dedup.drop_lines(df.limit(4), "host").collect()
    assert all(r.n_dropped == 0 for r in few)  # a site of less than MIN_PAGES pages


def test_warc_repeated_and_null_ids(spark):
    rows = [(1, "u", "a"), (1, "u", "bbb"), (2, "u", "a"), (None, "u", "a"), (None, None, "zz"), (-1, "u", "q"), (3, "u", "bbb"), (None, "u", "zz")]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"), new_path(spark, "warc")).collect()
    seen = sorted(((r.page_id is None, r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in got), key=repr)
    want = [(False, -1, 1, "response", None), (False, 1, 1, "response", None), (False, 1, 3, "response", None), (False, 2, 1, "revisit", 1), (False, 3, 3, "revisit", 1), (True, 0, 1, "revisit", 1), (True, 0, 2, "response", None), (True, 0, 2, "response", None)]
    assert seen == sorted(want, key=repr)
    assert all(r.payload_digest == warc.digest({1: b"a", 3: b"bbb", 2: b"zz"}[r.payload_bytes]) for r in got if r.page_id != -1)


def test_warc_least_bytes_and_a_third_copies(spark):
    rows = [(i, "u", "same text" if i % 3 == 0 else f"page {i}") for i in range(300)] + [(1000, "u", "x"), (1001, "u", "x")]
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5), new_path(spark, "warc"), least_bytes=2).collect()}
    assert got[0][:2] == ("response", None) and all(got[i] == ("revisit", 0, 9) for i in range(3, 300, 3))
    assert got[1000] == got[1001] == ("response", None, 1) and len(got) == 302


def test_mixing_names_and_both_ways_to_rounding(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("abc"), rng.choice(["en", "de", None]), rng.choice(["t", "u"]), float(rng.randrange(1, 900)), 5.0, "p") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, topic string, tokens double, weight double, probability string")
    near, far = (mixing.weigh(df, driver_cells=n).toPandas().sort_values("doc_id") for n in (10**6, 0))
    assert list(near.columns) == ["doc_id", "source", "lang", "topic", "tokens", "weight", "probability"]
    assert np.allclose(near.weight, far.weight, rtol=1e-9) and np.allclose(near.probability, far.probability, rtol=1e-9)


def test_mixing_query_columns_by_hand(spark):
    got = {r.doc_id: r for r in queries.op10_mixing(spark, "/root/testdata/sf0.001").collect()}
    for d in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        n, r = len(d.text or ""), got[d.doc_id]
        topic = "table" if " | " in (d.text or "") else "note" if n < 600 else "article" if n < 4000 else "book"
        seed = xxhash.xxh64_intdigest(struct.pack("<i", mixing.SEED), 42)
        draw = xxhash.xxh64_intdigest(struct.pack("<q", d.doc_id), seed)
        draw = (draw - 2**64 if draw >= 2**63 else draw) % 2**53 / 2**53
        wanted = r.weight * mixing.BUDGET
        assert (r.topic, r.tokens, r.selected, r["copies"]) == (topic, -(-n // 4), draw < r.probability, int(wanted) + (draw < wanted % 1))


def test_near_duplicate_losses_are_bounded():
    assert minhash.lost_to_forest() < 4e-7 and minhash.lost_to_margin() < 1e-8
    assert minhash.lost_to_forest(0.9) < 1e-12 and minhash.lost_to_margin(0.9) < 1e-12


def test_near_duplicates_with_clashing_ids(spark):
    a, b, c = (" ".join(f"{p}{i}" for i in range(60)) for p in "abc")
    rows = [(5, a), (5, b), (3, b), (4, c), (7, a + " x"), (5, a)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = {(5, a): 5, (5, b): 3, (3, b): 3, (4, c): 4, (7, a + " x"): 5}
    hashed = {(r.doc_id, r.text_hash): r.component_id for r in got}
    want = spark.createDataFrame([(i, t, k) for (i, t), k in texts.items()], "doc_id long, text string, k long").withColumn("h", minhash.text_hash(F.col("text"))).collect()
    assert len(got) == 6 and hashed == {(r.doc_id, r.h): r.k for r in want}


def test_key_join_with_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "LEAST_HOT", 20)
    rows = spark.createDataFrame([(f"k{min(i, 40) % 41}", i) for i in range(400)] + [(None, -1)], "k string, v int")
    keys = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("least"))
    got = common.key_join(rows, keys, "k", "n", 401).select("k", "v", "least")
    assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(keys, "k").select("k", "v", "least").collect()))


def test_thinned_never_loses_a_key(spark):
    wanted = spark.range(0, 3000, 7).select(F.col("id").alias("k"))
    marked, may = common.thinned(spark.range(3000).select(F.col("id").alias("k")), ["k"], wanted, wanted.count())
    passed = {r.k for r in marked.filter(may).select("k").collect()}
    assert set(range(0, 3000, 7)) <= passed and len(passed) < 700
    none, may = common.thinned(spark.range(10).select(F.col("id").alias("k")), ["k"], wanted.filter("false"), 0)
    assert none.filter(may).count() == 0


def test_language_training_rows_and_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    part = lambda i: zlib.crc32(str(i).encode()) % 4
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    assert {r.doc_id for r in queries.training_rows(docs).collect()} == {i for i in ids if part(i) != 2}
    got = queries.op5_language(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: r.held_out for r in got} == {i: part(i) == 2 for i in ids}
    model = langid.train(queries.training_rows(docs), "doc_id", "text", "lang")
    df = docs.limit(3).withColumn("score", F.lit("s")).withColumn("lang_pred", F.lit(1))
    assert langid.predict(df, model, keep=("score", "lang_pred", "lang")).columns == ["doc_id", "lang", "lang_pred", "score"]


def test_nearest_null_ids_take_no_part(spark):
    rows = [(None, [1.0, 0.0]), (5, [1.0, 0.0]), (6, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.nearest(df, F.col("vec_id") % 5 == 0, k=3).collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(5, 6)]


def test_packing_repeated_rows_and_extra_columns(spark):
    rows = [(1, "some words here", 0, "u"), (1, "some words here", 0, "u"), (None, "x", 1, "v"), (2, None, 2, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start long, unit string")
    got = packing.pack(df, queries.tokenizer_path()).collect()
    assert sorted((r.doc_id or 0, r.length) for r in got) == [(0, 2), (1, 4), (1, 4), (2, 1)]
    assert len({r.sequence_id for r in got}) == 1 and sorted(r.offset for r in got) == [0, 4, 8, 10]


@pytest.mark.parametrize("name", ["op1_pii", "op3_line_dedup"])
def test_queries_pass_extra_columns(spark, name, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("spans", F.lit(1)).withColumn("line", F.lit(2))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.queries()[name](spark, str(tmp_path)).count() == docs.count()

"""The queries of the training-data operators over the driver's tables, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, fingerprint, langid, line_dedup, minhash, mixing, packing, pii, substring, warc
from .common import drop_path, new_path, read

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest_columns(pii.detect(read(spark, sf_dir, "documents")))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_lines(docs, "source").drop("source")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(read(spark, sf_dir, "documents"), words=4, percent=80)
    return found.drop("text_hash").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(training_rows(docs), "doc_id", "text", "lang")
    held = docs.select("doc_id", "text", (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2).alias("held_out"))
    return langid.predict(held, model, keep=("held_out",))


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return fingerprint.edited_comparison(docs, fingerprint.lexicon(docs))


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_spans(read(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path())


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    got = warc.round_trip(read(spark, sf_dir, "pages"), path)
    drop_path(spark, path)  # the result no longer reads the archives
    return got


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    docs = docs.select("doc_id", "source", "lang", mixing.topic(F.col("text")).alias("topic"), mixing.tokens(F.col("text")).alias("tokens"))
    return mixing.weigh(docs).withColumn("selected", mixing.drawn("doc_id") < F.col("probability")).withColumn("copies", mixing.copies(F.col("weight"), "doc_id"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_pii, op2_nearest, op3_line_dedup, op4_near_dedup, op5_language, op6_fingerprint, op7_substring, op8_packing, op9_warc, op10_mixing)}


_OP3_SQL = rf"""
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
total AS (SELECT source, count(*) AS n FROM d GROUP BY source),
seen AS (SELECT source, x, count(*) AS pages FROM (SELECT source, unnest(list_distinct(lines)) AS x FROM d) WHERE regexp_matches(x, '[^ \t\n\x0B\f\r]') GROUP BY source, x),
bad AS (SELECT s.source, list(s.x) AS xs FROM seen s JOIN total t ON s.source = t.source WHERE s.pages >= {line_dedup.MIN_PAGES} AND s.pages > {line_dedup.RATIO} * t.n GROUP BY s.source),
kept AS (SELECT d.doc_id, d.text, d.lines, CASE WHEN bad.xs IS NULL THEN d.lines ELSE list_filter(d.lines, lambda x: NOT list_contains(bad.xs, x)) END AS k FROM d LEFT JOIN bad ON d.source = bad.source)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE array_to_string(k, chr(10)) END AS text,
       CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(lines), 0) - coalesce(len(k), 0) AS BIGINT) AS n_dropped
FROM kept
"""

#: The whole self join of shingles, and reachability over its links: for small tables.
_OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS sh FROM d),
c AS (SELECT doc_id, sh, min(doc_id) OVER (PARTITION BY list_sort(sh)) AS rep FROM s WHERE len(sh) > 0),
x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS sh FROM c WHERE doc_id = rep),
link AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM c WHERE doc_id = rep UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.b),
least AS (SELECT a, min(b) AS component FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(least.component, s.doc_id) AS component_id, coalesce(least.component, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON c.doc_id = s.doc_id LEFT JOIN least ON least.a = c.rep
"""

_OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
first AS (SELECT html, min(page_id) AS first FROM p GROUP BY html),
x AS (SELECT p.page_id, p.html, first.first, sha1(p.html) AS h FROM p JOIN first ON p.html = first.html)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(((CAST('0x' || substr(h, CAST((i // 4) * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to
FROM x
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": _OP3_SQL, "op4_near_dedup": _OP4_SQL, "op9_warc": _OP9_SQL}

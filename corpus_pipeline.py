"""A training-corpus pipeline: five stages, each one operator, each written as Parquet and read back as the next one's documents.

Defined results: language ID drops texts that are null, empty or without a letter, so later stages see none from documents, but take them
(line dedup can empty a text; an empty text is no near duplicate, weighs nothing in mixing and is one closing token in packing);
null languages are filled, null sources are one source; a null id is kept throughout; rows equal in id and text become one; documents may
have other columns, which are ignored; an empty table passes all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.llm import langid, line_dedup, minhash, mixing, packing
from strataweave.llm.common import read, table, thinned
from strataweave.llm.queries import tokenizer_path, training_rows

#: Language ID rejects texts without letters and those whose best one-versus-rest value is below this.
LEAST_SCORE = 0.2
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language it recognises; a missing lang is filled with the one found."""
    docs = _documents(docs)
    model = langid.train(training_rows(docs), "doc_id", "text", "lang")
    got = langid.predict(docs, model, keep=("text", "lang", "source", "n_chars"))
    kept = got.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return _documents(kept.withColumn("lang", F.coalesce("lang", "lang_pred")))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops each source's boilerplate lines from the texts; n_chars follows."""
    got = line_dedup.drop_lines(_documents(docs), "source", n_lines=None, n_dropped=None)
    return _documents(got.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of every group of near duplicates (five-word shingles, similarity 0.8).

    Of rows that share id and text one stays, the least of them; rows that share an id only are documents of their own; rows with a null
    id are in no group and all stay.
    """
    on = ["doc_id", "text_hash"]
    docs = _documents(docs).withColumn("text_hash", minhash.text_hash(F.col("text")))
    found = minhash.near_duplicates(docs).filter("doc_id is not null")
    gone = found.filter("doc_id <> component_id").select(*on).distinct()
    # Rows that no bitmap takes for a lost one stay where they are.
    marked, may = thinned(docs, on, gone, gone.count())
    kept = marked.filter(~may).select(*COLUMNS, "text_hash").unionByName(marked.filter(may).select(*COLUMNS, "text_hash").join(gone, on, "left_anti"))
    again = table(found.groupBy(*on).agg(F.count("*").alias("n")).filter("n > 1").select(*on), "repeated")
    if not again.isEmpty():
        one = kept.join(again, on, "left_semi").groupBy(*on).agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*", "text_hash")
        kept = kept.join(again, on, "left_anti").unionByName(one)
    return _documents(kept)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents by probabilities calibrated to the raked marginals."""
    docs = _documents(docs)
    rows = docs.withColumn("topic", mixing.topic(F.col("text"))).withColumn("tokens", mixing.tokens(F.col("text")))
    return _documents(mixing.weigh(rows).filter(mixing.drawn("doc_id") < F.col("probability")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [("language_id", language_id), ("line_dedup", line_dedup_stage), ("near_dedup", near_dedup), ("mixing", mix), ("packing", pack)]

#: Kernel ridge regression and the linear program have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

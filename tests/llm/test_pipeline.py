"""Each stage on what its predecessor kept, against brute force."""

import corpus_pipeline as pipeline
from test_ops import brute_components, check_packing

from strataweave.llm import mixing
from strataweave.llm.common import table
from strataweave.llm.queries import tokenizer_path


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    seen = {"documents": docs.collect()}
    for name, stage in pipeline.STAGES[:-1]:
        docs = table(stage(spark, docs, small), f"test_{name}")
        assert docs.columns == list(pipeline.COLUMNS)
        seen[name] = docs.collect()
    kept = {r.doc_id for r in seen["language_id"]}
    assert all(r.doc_id in kept for r in seen["documents"] if r.lang and sum(c.isalpha() for c in r.text) > 200)
    assert all(r.n_chars == len(r.text) for r in seen["line_dedup"]) and {r.doc_id for r in seen["line_dedup"]} == kept
    component = brute_components([(r.doc_id, r.text) for r in seen["line_dedup"]], 5, 80)
    assert {r.doc_id for r in seen["near_dedup"]} == {i for i, (_, c) in component.items() if i == c}
    chosen = {r.doc_id for r in seen["mixing"]}
    assert chosen < {r.doc_id for r in seen["near_dedup"]}
    share = sum(r.n_chars for r in seen["mixing"]) / sum(r.n_chars for r in seen["near_dedup"])
    assert abs(share - mixing.BUDGET) < 0.2
    got = pipeline.STAGES[-1][1](spark, docs, small).collect()
    check_packing([(r.doc_id, r.text) for r in seen["mixing"]], got, tokenizer_path())


def test_near_dedup_keeps_every_row_without_id(spark):
    words = [f"w{i}" for i in range(40)]
    rows = [(None, " ".join(words), "en", "s", 1), (None, "another text", None, None, None), (None, None, "en", "s", 0)]
    rows += [(i, " ".join(words), "en", "s", 1) for i in (9, 4, 4)]
    rows += [(7, None, None, None, None), (8, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = pipeline.near_dedup(spark, docs, "").collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == [4, 7, 8]
    assert sorted(r.text or "" for r in got if r.doc_id is None) == ["", "another text", " ".join(words)]

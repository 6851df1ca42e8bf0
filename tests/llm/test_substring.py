"""No repeated passage of fifty words is lost, and spans reach its exact ends."""

import random

from strataweave.llm import substring


def test_every_planted_passage_is_found_to_its_ends(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß語") for _ in range(rng.randrange(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    texts, planted = {}, {}
    for i in range(400):
        passage = prose(51 + i % 10)
        texts[2 * i] = f"{prose(40)} [{passage}] {prose(i % 50)}"
        texts[2 * i + 1] = f"{prose(i % 70)} ({passage}) {prose(30)}"
        planted[2 * i + 1] = passage
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = substring.repeated_spans(df).collect()
    assert {r.doc_id: (texts[r.doc_id][r.start : r.end], r.first_doc_id) for r in got} == {d: (p, d - 1) for d, p in planted.items()} and len(got) == len(planted)


def test_periods_edits_and_repeated_ids(spark):
    rng = random.Random(4)
    base = " ".join(str(rng.randrange(10**6)) for _ in range(300))
    edited = base[:900] + "#" + base[901:]
    rows = [(1, base), (2, edited), (2, edited), (3, "x " * 3000), (4, "x " * 2000 + "y"), (5, base[:99] + "#"), (6, base[:100] + "#"), (None, base)]
    got = substring.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.start, r.end) for r in got) == [(2, 0, 900), (2, 901, len(base)), (4, 0, 4000), (6, 0, 100)]

"""Large groups of copies and texts without lexicon terms have near-duplicate fingerprints too."""

import random

import numpy as np

from strataweave.llm import fingerprint


def prose(rng, n):
    return " ".join(f"w{rng.randrange(3000)}" for _ in range(n))


def test_copies_of_a_third_of_the_rows_keep_their_fingerprint(spark):
    rng = random.Random(3)
    hot = prose(rng, 300)
    rows = [(i, hot if i % 3 == 0 else prose(rng, 300)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    lex = fingerprint.lexicon(docs)
    once = spark.createDataFrame([(0, hot), *[r for r in rows if r[0] % 3]], "doc_id long, text string")
    assert np.array_equal(lex, fingerprint.lexicon(once))
    near = [r.near_edited for r in fingerprint.edited_comparison(docs, lex).collect() if r.doc_id % 3 == 0]
    assert len(near) == 100 and min(near) > 0 and np.mean(near) > 0.2


def test_texts_of_terms_outside_the_band(spark):
    rng = random.Random(5)
    fp = fingerprint.Fingerprinter(np.zeros(0, np.uint64))
    text = prose(rng, 300)
    edited = text[: len(text) * 2 // 3] + prose(rng, 100)
    assert fingerprint.likeness(fp(text), fp(edited)) > 0.1 > fingerprint.likeness(fp(text), fp(prose(rng, 300)))
    assert fp(text) == fp(text) != fp(edited) and fingerprint.likeness(fp(""), fp("?")) == 0 and fp("?").startswith("whole:")

"""Versions that share no code with the operators: fingerprints, repeated passages, and every pipeline stage."""

import base64
import hashlib
import random
import re
from collections import Counter

import corpus_pipeline as pipeline
import xxhash

from strataweave.llm import fingerprint, line_dedup, mixing, substring
from strataweave.llm.queries import training_rows

M64 = 2**64 - 1


def term_hash(t):
    return xxhash.xxh3_64_intdigest(t.encode())


def in_subset(h, j):
    """The subset test of one term, in plain integers."""
    x = ((h ^ int(fingerprint._SEED[j])) * 0x9E3779B97F4A7C15) & M64
    x = ((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9) & M64
    return x >> (64 - fingerprint.RATES[j // fingerprint.SUBSETS]) == 0


def imatch(text, lexicon):
    terms = sorted({term_hash(t) for t in re.findall(r"[^\W_]+", (text or "").lower())})
    own = [t for t in terms if t in lexicon]
    pack = lambda ts: b"".join(t.to_bytes(8, "little") for t in ts)
    if not terms:
        return "whole:" + hashlib.sha256((text or "").encode()).hexdigest()
    whole = xxhash.xxh3_64_hexdigest(pack(own)) if own else hashlib.sha256(text.encode()).hexdigest()
    out = b""
    for j in range(len(fingerprint.RATES) * fingerprint.SUBSETS):
        part = [t for t in own or terms if in_subset(t, j)]
        out += (xxhash.xxh3_64_intdigest(pack(part), seed=j) % 0xFFFFFF + 1).to_bytes(3, "little") if part else b"\0\0\0"
    return f"{whole}:{base64.b64encode(out).decode()}"


def alike(x, y):
    if x == y:
        return 1.0
    if "whole" in (x[:5], y[:5]):
        return 0.0
    a, b = (base64.b64decode(s.split(":")[1]) for s in (x, y))
    best = 0.0
    for r in range(len(fingerprint.RATES)):
        cells = [(a[i : i + 3], b[i : i + 3]) for i in range(3 * r * fingerprint.SUBSETS, 3 * (r + 1) * fingerprint.SUBSETS, 3)]
        used = sum(p != b"\0\0\0" or q != b"\0\0\0" for p, q in cells)
        best = max(best, sum(p == q != b"\0\0\0" for p, q in cells) / max(used, fingerprint.FEW))
    return best


def test_fingerprints_against_plain_integers(spark):
    rng = random.Random(8)
    rows = [(i, None if i == 9 else " ".join(f"w{int(rng.paretovariate(0.6)) % 900}" for _ in range(rng.randrange(0, 120)))) for i in range(80)]
    rows += [(200, "é Ü ß"), (201, "!?"), (202, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    df = Counter(t for _, x in rows for t in {term_hash(w) for w in re.findall(r"[^\W_]+", (x or "").lower())})
    n = len(rows)
    lexicon = {t for t, d in df.items() if max(2, fingerprint.LOW * n) <= d <= max(2, fingerprint.HIGH * n)}
    lex = fingerprint.lexicon(docs)
    assert set(lex.tolist()) == lexicon
    ordered = sorted(((i, t or "") for i, t in rows), reverse=True)
    got = {r.doc_id: r for r in fingerprint.edited_comparison(docs, lex).collect()}
    for (i, t), (_, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        k = len(t) // 3
        edited = t[: len(t) - k] + after[:k]
        want = (imatch(t, lexicon), imatch(edited, lexicon))
        assert (got[i].fingerprint, got[i].edited_fingerprint) == want
        assert abs(got[i].near_edited - alike(*want)) < 1e-12 and abs(got[i].near_next - alike(want[0], imatch(after, lexicon))) < 1e-12


def shared_characters(texts, least):
    """By document, the characters within a run of `least` characters that a smaller document holds too."""
    out, seen = {}, set()
    for i in sorted(texts):
        t, hit = texts[i] or "", set()
        for p in range(len(t) - least + 1):
            if t[p : p + least] in seen:
                hit.update(range(p, p + least))
        out[i] = hit
        seen |= {t[p : p + least] for p in range(len(t) - least + 1)}
    return out


def test_repeated_spans_against_all_substrings(spark):
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(rng.randrange(52, 90)) for _ in range(25)]
    # Each piece ends in a character of its own: a later document that shares more by chance isn't the one a span is told by.
    ends = map(chr, range(0xE000, 0xF000))
    texts = {i: "".join(next(ends) + rng.choice([prose(20), prose(35), rng.choice(passages), "and so on"]) for _ in range(rng.randrange(1, 6))) + next(ends) for i in range(120)}
    texts |= {500: "", 501: None, 502: texts[0]}
    got = substring.repeated_spans(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)).collect()
    found = {i: set() for i in texts}
    for r in got:
        found[r.doc_id] |= set(range(r.start, r.end))
    surely, truly = shared_characters(texts, 280), shared_characters(texts, substring.MIN_CHARS)
    assert any(surely.values())
    for i in texts:
        assert surely[i] <= found[i] <= truly[i], i


def test_every_stage_on_what_its_predecessor_kept(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    stage = dict(pipeline.STAGES)
    named = stage["language_id"](spark, docs, small).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.text == texts[r.doc_id] and r.lang for r in named)
    assert not [r for r in named if not any(c.isalpha() for c in r.text)]
    assert set(training_rows(docs).columns) == set(docs.columns)

    rows = [(i, t, "en", "s" if i % 2 else None, len(t)) for i, t in ((i, f"menu\nline {i}\n\nother {i % 7}\r\n") for i in range(60))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    pages = Counter((r[3], x) for r in rows for x in set(r[1].split("\n")))
    total = Counter(r[3] for r in rows)
    keep = lambda s, x: not x.strip() or not (pages[s, x] >= line_dedup.MIN_PAGES and pages[s, x] > line_dedup.RATIO * total[s])
    want = {i: "\n".join(x for x in t.split("\n") if keep(s, x)) for i, t, _, s, _ in rows}
    assert {r.doc_id: (r.text, r.n_chars) for r in stage["line_dedup"](spark, df, "").collect()} == {i: (t, len(t)) for i, t in want.items()}

    chosen = {r.doc_id for r in stage["mixing"](spark, docs, small).collect()}
    weighed = mixing.weigh(docs.withColumn("topic", mixing.topic(docs.text)).withColumn("tokens", mixing.tokens(docs.text))).withColumn("draw", mixing.drawn("doc_id")).collect()
    assert chosen == {r.doc_id for r in weighed if r.draw < r.probability}


def test_pipeline_of_an_empty_table_and_of_repeats(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra string"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert pipeline.run(spark, f"{tmp_path}/none").count() == 0
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text, "en", "b", 1, "x"), (1, text, "en", "a", 1, "y"), (1, "quite another text " + text[::-1], "en", "a", 1, None), (2, text, "en", "a", 1, None)]
    got = sorted(tuple(r) for r in pipeline.near_dedup(spark, spark.createDataFrame(rows, schema), "").collect())
    assert got == sorted([(1, text, "en", "a", 1), (1, rows[2][1], "en", "a", 1)])

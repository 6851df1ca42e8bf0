"""Each operator against a brute-force version on small cases, with nulls, empties, ties, repeats, long texts and clashing names."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataweave.llm import ann, fingerprint, langid, line_dedup, minhash, mixing, packing, pii, queries, substring, warc
from strataweave.llm.common import new_path
from strataweave.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed=1):
    rng = random.Random(seed)
    texts = [" ".join(words(rng, rng.randrange(3, 90))) for _ in range(60)]
    for i in range(25):
        w = texts[rng.randrange(12)].split()
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(len(w))] = "x" + str(rng.random())
        texts.append(" ".join(w))
    texts += ["", None, "  \n\t ", "a", "a b c", "A b c", "a b c", "é ü", "x " * 30_000, " ".join(words(rng, 20_000, 10**6))]
    return [(i, t, ("en", "de", None)[i % 3], ("s0", "s1", None)[i % 5 % 3], len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# 1. PII


def brute_base(text):
    text = text or ""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        s = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d)))
        if 16 <= len(d) <= 19 and s % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in out)


def test_pii_base_spans_match_brute_force(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab@.-+1234 567890%()é\n") for _ in range(rng.randrange(120))) for _ in range(3000)]
    texts += [None, "", "4111 1111 1111 1111 and 4111111111111112", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "+1 (017) 555-7713 x@mail.example.com", "1" * 5000, "a." * 3000 + "@", "999.1.1.1 0000255.1.1.1"]
    got = pii.digest_columns(pii.detect(spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, spans int"))).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (texts[r.doc_id], want, r.spans)
        assert r.spans.startswith(want) and r.n_email == want.count("email:")


def test_pii_checksums_and_context():
    kinds = lambda t: [s["kind"] for s in pii.find_spans(t)]
    assert kinds("IBAN GB82 WEST 1234 5698 7654 32") == ["iban"]
    assert kinds("IBAN GB82 WEST 1234 5698 7654 33") == []
    assert kinds("ssn 078-05-1120") == ["ssn"] and kinds("part 078-05-1120") == []
    assert pii.find_spans("my card 4111111111111111")[0]["score"] > pii.find_spans("xx 4111111111111111")[0]["score"]


def test_pii_redact_and_empty(spark, empty):
    df = spark.createDataFrame([(1, "mail a@b.de now"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in pii.redact(df).collect()} == {1: "mail <EMAIL> now", 2: None}
    assert pii.digest_columns(pii.detect(empty)).count() == 0


# 2. Nearest neighbours


def brute_nearest(rows, asks, k):
    ok = [(i, np.array(v, float)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in ok:
        if asks(i):
            s = sorted(((-float((q * v).sum()), j) for j, v in ok if j != i and len(v) == len(q)))[:k]
            out[i] = [(j, -x) for x, j in s]
    return out


def run_nearest(spark, rows, k=5, div=5):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % div == 0, k=k).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return got


def test_ann_is_exact_on_few_and_handles_odd_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=16).astype("f4").tolist()) for i in range(4)] + [(5, None), (10, [0.0] * 16), (15, [float("nan")] + [1.0] * 15), (20, [None] * 16), (25, [1.0, 2.0]), (30, [])]
    rows += [(40 + i, rows[0][1]) for i in range(12)]
    got, want = run_nearest(spark, rows), brute_nearest(rows, lambda i: i % 5 == 0, 5)
    want = {q: v for q, v in want.items() if v}
    assert {q: [j for j, _ in v] for q, v in got.items()} == {q: [j for j, _ in v] for q, v in want.items()}
    for q in want:
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=1e-12)


@pytest.mark.parametrize("spread", [0.0, 1.0])
def test_ann_recall(spark, spread):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x *= np.exp(spread * rng.normal(size=(1500, 1)))
    rows = [(i, v.astype("f4").tolist()) for i, v in enumerate(x)]
    got, want = run_nearest(spark, rows, 20, 20), brute_nearest(rows, lambda i: i % 20 == 0, 20)
    assert np.mean([len({j for j, _ in got[q]} & {j for j, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_ann_empty(spark):
    assert run_nearest(spark, []) == {} and run_nearest(spark, [(5, [1.0, 0.0])]) == {}


# 3. Line dedup


def test_line_dedup_matches_brute_force(spark, empty):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        lines = [rng.choice(["home", "log in", "", "terms"]) if rng.random() < 0.3 else f"line {rng.random()}" for _ in range(rng.randrange(6))]
        rows.append((i, None if i == 7 else "\n".join(lines), "en", ("a", "b", None)[i % 3], i))
    rows.append(rows[0])
    got = sorted(tuple(r) for r in line_dedup.drop_lines(spark.createDataFrame(rows, DOCS).select("doc_id", "source", "text"), "source").collect())
    total, pages = {}, {}
    for _, t, _, s, _ in rows:
        total[s] = total.get(s, 0) + 1
        for x in set((t or "").split("\n")):
            pages[s, x] = pages.get((s, x), 0) + 1
    bad = {k for k, n in pages.items() if k[1].strip() and n >= line_dedup.MIN_PAGES and n > line_dedup.RATIO * total[k[0]]}
    want = []
    for i, t, _, s, _ in rows:
        kept = None if t is None else [x for x in t.split("\n") if (s, x) not in bad]
        want.append((i, s, None if t is None else "\n".join(kept), 0 if t is None else len(t.split("\n")), 0 if t is None else len(t.split("\n")) - len(kept)))
    assert bad and got == sorted(want, key=lambda r: (r[0], r[1] or ""))
    assert line_dedup.drop_lines(empty, "source").count() == 0


# 4. Near duplicates


def brute_components(rows, n, percent):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        k = min(n, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                same = len(sets[a] & sets[b])
                if 100 * same >= percent * (len(sets[a]) + len(sets[b]) - same):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def near(df, **kw):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, **kw).collect()}


@pytest.mark.parametrize("n", [4, 5])
def test_near_duplicates_match_brute_force(docs, n):
    assert near(docs, words=n) == brute_components(corpus(), n, 80)


def test_near_duplicates_chains_in_one_dense_region(spark, monkeypatch):
    """Copies of one text, each with edits of its own: many meet the threshold only with some of the others."""
    rng = random.Random(9)
    base = words(rng, 120, 10**6)
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = f"e{rng.random()}"
        rows.append((i, " ".join(w), "en", "s", 1))
    rows += [(1000 + i, " ".join(words(rng, 60)), "en", "s", 1) for i in range(30)]
    assert near(spark.createDataFrame(rows, DOCS), words=4) == brute_components(rows, 4, 80)


def test_near_duplicates_crossing_blocks(spark):
    """A region in which no link is known yet: blocks must find all components by themselves."""
    rng = random.Random(2)
    base = words(rng, 60, 10**6)
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = f"e{rng.random()}"
        rows.append((i, " ".join(w)))
    seeds = minhash._seeds(minhash.TREES * minhash.DEPTH)
    data = [(0, len(rows), i, i, minhash.signature(minhash.shingles(t, 4), seeds).tobytes(), t) for i, t in rows]
    df = spark.createDataFrame(data, "key long, n long, node long, label long, sig binary, text string")
    got = {r.node: r.component for r in components(minhash._crossing(df, 0.6, 4, 80)).collect()}
    want = {i: c for i, (_, c) in brute_components(rows, 4, 80).items()}
    assert {i: got.get(i, i) for i in want} == want


def test_near_duplicates_empty(empty):
    assert near(empty) == {}


def test_components_against_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(250)] + [(500 + i, 501 + i) for i in range(60)] + [(None, 3), (9, 9)]
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root(i) for i in parent}


# 5. Language


def test_language_held_out_accuracy(spark, small):
    got = queries.op5_language(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.98


def test_language_kernel_equals_explicit_kernel():
    """The folded matrix gives what kernel values with the landmarks would."""
    rng = random.Random(1)
    samples = [(lang, langid.ngrams("".join(rng.choice(letters) for _ in range(80)))) for lang, letters in (("x", "abcd "), ("y", "cdef ")) for _ in range(12)]
    model = langid.fit(samples, landmarks=24, ridge=1e-6)
    k = lambda a, b: len(np.intersect1d(a, b)) / np.sqrt(len(a) * len(b))
    ordered = sorted(samples, key=lambda s: s[0])
    k_nn = np.array([[k(a, b) for _, b in ordered] for _, a in ordered])
    y = np.array([[s[0] == "x", s[0] == "y"] for s in ordered], float)
    w = 1 / 12
    alpha = np.linalg.solve(k_nn * w @ k_nn + 1e-6 * k_nn + 1e-9 * np.eye(24), k_nn @ (y * w))
    probe = langid.ngrams("abca dabc")
    want = np.array([k(probe, s) for _, s in ordered]) @ alpha
    assert np.allclose(model.scores([probe])[0], want, atol=1e-5)


def test_language_edges(spark, docs, empty):
    model = langid.train(docs, "doc_id", "text", "lang")
    df = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !"), (4, "word")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(df, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] in ("en", "de") and 0 <= got[4][1] <= 1
    none = langid.train(empty, "doc_id", "text", "lang")
    assert {r.lang_pred for r in langid.predict(df, none).collect()} == {"und"}
    assert langid.predict(empty, model).count() == 0


# 6. Fingerprints


def test_fingerprint_matches_sequential_version(spark, docs):
    lex = fingerprint.lexicon(docs)
    df = {}
    for _, t, *_ in corpus():
        for x in set(re.findall(r"[^\W_]+", (t or "").lower())):
            df[x] = df.get(x, 0) + 1
    n = len(corpus())
    import xxhash

    assert set(lex.tolist()) == {xxhash.xxh3_64_intdigest(x) for x, d in df.items() if max(2, fingerprint.LOW * n) <= d <= max(2, fingerprint.HIGH * n)}
    fp = fingerprint.Fingerprinter(lex)
    rows = sorted(((i, t or "") for i, t, *_ in corpus()), reverse=True)
    got = {r.doc_id: r for r in fingerprint.edited_comparison(docs, lex).collect()}
    assert len(got) == len(rows)
    for (i, t), (_, nxt) in zip(rows, rows[1:] + rows[:1], strict=True):
        k = len(t) // 3
        edited = t[: len(t) - k] + nxt[:k]
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), fp(t), fp(edited))
        assert r.near_edited == fingerprint.likeness(fp(t), fp(edited)) and r.near_next == fingerprint.likeness(fp(t), fp(nxt))


def test_fingerprint_tells_edits_from_strangers(spark):
    got = queries.op6_fingerprint(spark, "/root/testdata/sf0.01").filter("n_chars > 1000").collect()
    assert np.mean([r.near_edited for r in got]) > 0.3 > 0.1 > np.mean([r.near_next for r in got])


def test_fingerprint_edges(spark, empty):
    one = spark.createDataFrame([(3, "only one text")], "doc_id long, text string")
    assert fingerprint.edited_comparison(one, fingerprint.lexicon(one)).count() == 1
    twice = spark.createDataFrame([(3, "x"), (3, "x"), (None, "y"), (1, None)], "doc_id long, text string")
    assert fingerprint.edited_comparison(twice, fingerprint.lexicon(twice)).count() == 4
    assert fingerprint.edited_comparison(empty, fingerprint.lexicon(empty)).count() == 0


# 7. Substrings


def test_chunks_tile_texts_and_follow_content():
    rng = random.Random(8)
    text = " ".join(words(rng, 3000, 10**6)) + "é" * 900
    raw = text.encode()
    ends = substring.cuts(raw).tolist()
    assert ends[-1] == len(raw) and all(b - a <= substring.MAX_CHUNK for a, b in zip([0, *ends], ends, strict=False))
    for e in ends:
        raw[:e].decode()
    shifted = (b"inserted words " + raw)[:]
    moved = {e - 15 for e in substring.cuts(shifted).tolist()}
    assert len(moved & set(ends)) > 0.95 * len(ends)
    h = 0
    for i, byte in enumerate(raw[:400]):
        h = ((h << 1) + int(substring._GEAR[byte])) & 0xFFFF
        assert h == substring.gear(np.frombuffer(raw[:400], np.uint8))[i] or i < 15


def test_repeated_passages_found_clean_left_alone(spark, empty):
    rng = random.Random(6)
    rows, planted = [], set()
    for i in range(200):
        passage = " ".join(words(rng, 55, 10**6))
        host = [" ".join(words(rng, 80, 10**6)) for _ in range(2)]
        rows.append((2 * i, f"{host[0]} {passage} tail" if i % 2 else host[0]))
        rows.append((2 * i + 1, f"head {passage} {host[1]}" if i % 2 else host[1]))
        if i % 2:
            planted.add(2 * i + 1)
    rows += [(9000, None), (9001, ""), (9002, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = substring.repeated_spans(df)
    got = spans.collect()
    found = {r.doc_id for r in got}
    assert len(planted - found) <= 4 and found <= planted | {9002}
    texts = dict(rows)
    for r in got:
        piece = texts[r.doc_id][r.start : r.end]
        assert piece in texts[r.first_doc_id]
    cut = {r.doc_id: r.text for r in substring.drop_spans(df, spans).collect()}
    assert cut[9002] == "" and cut[9000] is None and cut[0] == texts[0]
    assert substring.repeated_spans(empty).count() == 0


# 8. Packing


def check_packing(rows, got, path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in rows}
    for i in ids:
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        assert [r.start for r in own] == np.cumsum([0, *[r.length for r in own][:-1]]).tolist() and sum(r.length for r in own) == len(ids[i])
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[i][r.start : r.start + r.length], "<u4").tobytes()) and r.doc_tokens == len(ids[i])
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    return sum(map(len, ids.values())), len(seqs)


def test_packing_is_whole_gapless_and_tight(spark, docs):
    path = queries.tokenizer_path()
    odd = ["don't I'VE  it's", "ΑΣ σίγμα ς İstanbul", "naïve x y", "é ́a", "a<|endoftext|>b", "$$$ 12_34 \x1c\x1f", "日本語 текст"]
    rows = [(i, t) for i, t, *_ in corpus()] + [(2000 + i, t) for i, t in enumerate(odd)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = packing.pack(df, path).collect()
    tokens, n = check_packing(rows, got, path)
    assert n <= 1.03 * tokens / 2048 + 1


def test_packing_plan_meets_demand_near_the_bound():
    rng = np.random.default_rng(0)
    units, n = np.unique(rng.integers(1, 257, 20_000), return_counts=True)
    h = dict(zip(units.tolist(), n.tolist(), strict=True))
    claims, seqs = packing.plan(h, 256)
    room = np.zeros(seqs, int)
    for u in h:
        own = [c for c in claims if c[0] == u]
        for (_, lo, seq, per), nxt in zip(own, [*[c[1] for c in own[1:]], h[u]], strict=True):
            np.add.at(room, seq + np.arange(nxt - lo) // per, u)
    assert room.max() <= 256 and room.sum() == sum(u * k for u, k in h.items())
    assert seqs <= 1.005 * max(room.sum() / 256, 1)


def test_packing_empty(empty):
    assert packing.pack(empty, queries.tokenizer_path()).count() == 0


# 9. WARC


def test_warc_round_trip_with_magic_in_payloads(spark):
    fake = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:777>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    html = ["<p>a</p>", None, "", "<p>a</p>", fake, "x" + fake * 3 + "WARC/1.0\r\n", "WARC/1.0\r\n", "ü" * 70_000, "\r\n\r\n", "\r\n\r\nWARC/1.0\r\n\r\n", fake]
    rows = [(i, f"http://x/{i}\r\n", h, "clash") for i, h in enumerate(html)] + [(100 + i, None, f"page {i % 40} {fake if i % 3 else ''}", "c") for i in range(200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, sha string")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        got = {r.page_id: r for r in warc.round_trip(df.coalesce(2), new_path(spark, "warc")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == len(rows)
    first = {}
    for i, _, h, _ in sorted(rows):
        b = (h or "").encode()
        k = first.setdefault(b, i)
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if k == i else ("revisit", k))


def test_warc_stated_digests_and_empty(spark):
    path = new_path(spark, "warc")
    warc.write(spark.createDataFrame([(i, "u", f"p{i}") for i in range(20)], "page_id long, url string, html string"), path)
    got = warc.read(spark, path).collect()
    assert len(got) == 20 and all(r.stated_digest == "sha1:" + r.payload_digest for r in got)
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(none, new_path(spark, "warc")).count() == 0


# 10. Mixing


def mixed(rows):
    return rows.withColumn("topic", mixing.topic(F.col("text"))).withColumn("tokens", mixing.tokens(F.col("text")))


def test_rake_meets_marginals():
    rng = np.random.default_rng(2)
    w = rng.random(60)
    groups = [np.repeat(np.arange(3), 20), np.tile(np.arange(5), 12)]
    targets = [np.array([0.2, 0.3, 0.5]), np.full(5, 0.2)]
    fit = mixing.rake(w, groups, targets)
    for g, t in zip(groups, targets, strict=True):
        assert np.allclose(np.bincount(g, fit) / fit.sum(), t, atol=1e-7)
    p = mixing.calibrated(fit / w, w, 0.6)
    assert p.max() <= 1 and abs((w * p).sum() / w.sum() - 0.6) < 1e-9


def test_mixing_marginals_budget_and_both_ways(spark, docs, empty):
    rows = mixed(docs)
    got = mixing.weigh(rows).toPandas()
    assert len(got) == len(corpus())
    total = got.tokens.sum()
    assert abs((got.tokens * got.probability).sum() / total - mixing.BUDGET) < 1e-6
    for name in mixing.MARGINALS:
        actual = got.groupby(name, dropna=False).tokens.sum()
        fitted = (got.tokens * got.weight).groupby(got[name].fillna("?")).sum()
        want = mixing.smoothed(actual.to_numpy())
        assert np.allclose(fitted.to_numpy() / total, want[np.argsort(actual.index.fillna("?"))], atol=1e-4)
    far = mixing.weigh(rows, driver_cells=0).toPandas()
    both = got.merge(far, on="doc_id")
    assert np.allclose(both.weight_x, both.weight_y, rtol=1e-3) and np.allclose(both.probability_x, both.probability_y, rtol=1e-3)
    assert mixing.weigh(mixed(empty)).count() == 0


def test_mixing_given_targets(spark):
    df = spark.createDataFrame([(i, "x" * 400, "ab"[i % 4 == 0], "en", 400) for i in range(4000)], "doc_id long, text string, source string, lang string, n_chars long")
    got = mixing.weigh(mixed(df), targets={"source": {"a": 0.5, "b": 0.5}}, budget=0.4).withColumn("on", mixing.drawn("doc_id") < F.col("probability")).filter("on").groupBy("source").count().collect()
    n = {r.source: r["count"] for r in got}
    assert abs(n["a"] - 800) < 110 and abs(n["b"] - 800) < 110


def test_warc_chains_across_segments(spark, monkeypatch):
    monkeypatch.setattr(warc, "SEGMENT", 500)
    rows = [(i, f"http://x/{i}", f"<p>{i}</p>" + ("WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * (i % 40))) for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2)
    got = {r.page_id: (r.payload_bytes, r.payload_digest) for r in warc.round_trip(df, new_path(spark, "warc")).collect()}
    assert got == {i: (len(h), warc.digest(h.encode())) for i, _, h in rows}


def test_ann_repeated_ids_are_one_candidate_and_one_query(spark):
    rows = [(5, [1.0, 0.0]), (5, [1.0, 0.0]), (7, [3.0, 4.0]), (7, [4.0, 3.0]), (7, [4.0, 3.0]), (8, [0.0, 1.0])]
    assert run_nearest(spark, rows) == {5: [(7, 4.0), (8, 0.0)]}

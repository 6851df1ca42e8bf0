"""Near-duplicate documents by an LSH forest of MinHash signatures.

Documents with equal shingle sets first collapse into one representative (an aggregation, so copies cost nothing more).
Every representative has a signature of TREES * DEPTH minima; tree t orders documents by the signature rotated to start at
its own part. Documents that share a tree's first DEPTH minima form a region. In each region the documents link to its smallest
member; regions of more than REGION members are cut again at greater depths, so that each document also meets the smallest
of those it shares the longest common prefixes with. Candidates whose signatures agree by less than the threshold minus
MARGIN go (`lost_to_margin` bounds the chance for a pair at the threshold); the others are confirmed on their full shingle
sets. Components of confirmed links follow. Regions that still hold several components are then compared block by
block, signature against signature and then set against set, across components only; tasks emit no more than a spanning forest
of the links they confirm. So a link is lost only if its two documents share no region in any tree (`lost_to_forest`).

Hot regions and centres: what has more than a thousandth of the rows is joined by broadcast, which at most a thousand keys can need; a
centre's text goes once to every SPREAD of its members; blocks of a region are compared in tasks of their own.

Defined results: null, empty and wordless texts have the empty set and link with nothing; repeated rows share a class; rows that
share an id but not a text are documents of their own; rows with a null id are returned unlinked, with a null component; any other
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_table, key_join, prepare, table, thinned, tidy
from .components import components

TREES = 28
DEPTH = 4
DEEPER = (8, 16, 32)
REGION = 8
MARGIN = 0.25
BLOCK = 1024
SPREAD = 512
AT_ONCE = 2048

_M = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Word -> 64-bit hash; the first LIMIT words of a task are kept, the frequent ones among them."""

    LIMIT = 100_000

    def __missing__(self, w: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(w)
        if len(self) < self.LIMIT:
            self[w] = h
        return h


_WORDS = _Words()


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes. bytes.lower() folds A-Z only and bytes.split() cuts at \\x20 and \\x09-\\x0D only."""
    if not text:
        return np.zeros(0, np.uint64)
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, parts), np.uint64, len(parts))
    width = min(words, len(parts))
    n = len(parts) - width + 1
    acc = np.full(n, width, np.uint64)
    for i in range(width):
        acc = _mix(acc * _M + h[i : i + n])
    return np.unique(acc)


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    g = np.random.Generator(np.random.PCG64(20_240_501))
    return g.integers(0, 2**64, n, np.uint64) | np.uint64(1), g.integers(0, 2**64, n, np.uint64)


def signature(s: np.ndarray, seeds) -> np.ndarray:
    """The minima of all hash functions: of small sets in one go, of large ones function by function."""
    mult, xor = seeds
    if len(s) > AT_ONCE:
        least = np.array([((s ^ x) * m).min() for m, x in zip(mult, xor, strict=True)], np.uint64)
    else:
        h = s ^ xor[:, None]
        h *= mult[:, None]
        least = h.min(axis=1)
    return (least >> np.uint64(32)).astype(np.uint32)


def _same(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def lost_to_forest(similarity: float = 0.8) -> float:
    """The chance that a pair shares no region in any tree."""
    return (1 - similarity**DEPTH) ** TREES


def lost_to_margin(similarity: float = 0.8) -> float:
    """The chance that the signatures of a pair at the threshold agree in too few places: a binomial tail."""
    n = TREES * DEPTH
    most = math.ceil((similarity - MARGIN) * n) - 1
    return sum(math.comb(n, k) * similarity**k * (1 - similarity) ** (n - k) for k in range(most + 1))


def text_hash(text: Column) -> Column:
    """Tells the texts of rows that share an id apart."""
    return F.xxhash64(text.cast("string"))


def _signed(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, digest, sig) for every row of (doc_id, text, text_hash)."""

    def scan(batches):
        seeds = _seeds(TREES * DEPTH)
        for b in batches:
            n, digest, sig = [], [], []
            for t in b.column(1):
                s = shingles(t.as_py(), words)
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sig.append(signature(s, seeds).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "text_hash", "n_shingles", "digest", "sig"])
        _WORDS.clear()
        tidy()

    return docs.select("doc_id", "text", "text_hash").mapInArrow(scan, "doc_id long, text_hash long, n_shingles long, digest binary, sig binary")


def _representatives(signed: DataFrame) -> DataFrame:
    """(digest, copies, node, doc_id, text_hash, sig): one row for every distinct set. A node is its smallest id, or a hash where an id
    stands for several sets."""
    full = signed.filter("doc_id is not null and n_shingles > 0")
    reps = full.groupBy("digest").agg(F.count("*").alias("copies"), F.min_by(F.struct("doc_id", "text_hash", "sig"), F.struct("doc_id", "text_hash")).alias("r"))
    reps = table(reps.select("digest", "copies", F.col("r.doc_id").alias("node"), "r.*"), "reps")
    clash = reps.groupBy("doc_id").agg(F.count("*").alias("sets")).filter("sets > 1").select("doc_id")
    if clash.isEmpty():
        return reps
    apart = reps.join(clash.withColumn("clash", F.lit(True)), "doc_id", "left").withColumn("node", F.when(F.col("clash"), F.xxhash64("doc_id", "digest")).otherwise(F.col("doc_id")))
    out = table(apart.select(*reps.columns), "reps")
    drop_table(reps)
    return out


def _regions(sigs: DataFrame, depth: int) -> DataFrame:
    """(key, node): the region of every document in every tree at a depth; the key's last five bits are the tree."""

    def scan(batches):
        turn = (np.arange(TREES)[:, None] * DEPTH + np.arange(depth)[None, :]) % (TREES * DEPTH)
        for b in batches:
            m = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(-1, TREES * DEPTH)
            key = np.empty((len(m), TREES), np.uint64)
            for t in range(TREES):
                acc = np.full(len(m), t * 64 + depth, np.uint64)
                for i in turn[t]:
                    acc = _mix(acc * _M + m[:, i])
                key[:, t] = acc >> np.uint64(5) << np.uint64(5) | np.uint64(t)
            ids = np.repeat(b.column(0).to_numpy(zero_copy_only=False), TREES)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(ids)], ["key", "node"])

    return sigs.select("node", "sig").mapInArrow(scan, "key long, node long")


def _members(sigs: DataFrame, depth: int, n: int) -> DataFrame:
    """(key, node, a, n): the members of the regions of two documents and more, with the region's smallest and its size."""
    base = table(_regions(sigs, depth), "regions")
    stats = base.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("n")).filter("n > 1")
    stats = table(stats, "stats")
    out = table(key_join(base, stats, "key", "n", n * TREES), "members")
    drop_table(base, stats)
    return out


def _alike(pairs: DataFrame, sigs: DataFrame, least: float) -> DataFrame:
    """Pairs whose signatures agree in at least that share of places."""
    s = sigs.select("node", "sig")
    centres = pairs.groupBy("a").agg(F.count("*").alias("n")).join(s.withColumnsRenamed({"node": "a", "sig": "sa"}), "a")
    both = key_join(pairs, centres, "a", "n", pairs.count()).join(s.withColumnsRenamed({"node": "b", "sig": "sb"}), "b").select("a", "b", "sa", "sb")

    def scan(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint32).reshape(-1, TREES * DEPTH) for i in (2, 3))
            ok = pa.array((x == y).mean(1) >= least)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], ["a", "b"])

    return both.mapInArrow(scan, "a long, b long")


def _texts(wanted: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of the nodes in `wanted`; no other texts are shuffled but those a bitmap takes for one of them."""
    nodes = table(wanted.select("node").distinct().join(reps.select("node", "doc_id", "text_hash"), "node"), "wanted")
    marked, may = thinned(docs, ["doc_id", "text_hash"], nodes, nodes.count())
    out = table(marked.filter(may).select("doc_id", "text_hash", "text").join(nodes, ["doc_id", "text_hash"]).select("node", "text"), "texts")
    drop_table(nodes)
    return out


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= percent * union. Members stream past their centre, SPREAD to a task."""
    per = pairs.groupBy("a").agg(F.count("*").alias("n"))
    salts = F.ceil(F.col("n") / SPREAD).cast("int")
    members = key_join(pairs, per, "a", "n", pairs.count()).withColumn("salt", F.pmod(F.xxhash64("b"), salts).cast("int"))
    members = members.select("a", "salt", "b").join(texts.withColumnRenamed("node", "b"), "b").select("a", "salt", "b", "text")
    centres = texts.withColumnRenamed("node", "a").join(per, "a").select("a", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "text")

    def scan(batches):
        at, x = None, None
        for batch in batches:
            out = []
            for a, salt, b, text in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                if b is None:
                    if at != (a, salt):
                        at, x = (a, salt), shingles(text.as_py(), words)
                    continue
                y = shingles(text.as_py(), words)
                same = _same(x, y) if len(x) and len(y) else 0
                if same and 100 * same >= percent * (len(x) + len(y) - same):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])
        _WORDS.clear()
        tidy()

    dealt = centres.unionByName(members).repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))
    return dealt.mapInArrow(scan, "a long, b long").distinct()


def _crossing(rows: DataFrame, least: float, words: int, percent: int) -> DataFrame:
    """rows: (key, n, node, label, sig, text), the documents of regions of n. Confirmed links across labels, cut down in each pair of
    blocks to a spanning forest, so that a region gives no more rows than it has documents and blocks. A pair is looked at in the
    first tree that brings it together only.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    cut = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int"))
    # Block i meets block j <= i: each row goes to the tasks of its own row and column of the triangle.
    dealt = cut.select("key", "node", "label", "sig", "text", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.withColumn("hi", F.greatest("block", "other")).withColumn("lo", F.least("block", "other"))

    def compare(t: pa.Table) -> pa.Table:
        ids, label, block = (t.column(c).to_numpy() for c in ("node", "label", "block"))
        m = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(-1, TREES * DEPTH)
        tree, hi, lo = t.column("key")[0].as_py() & 31, t.column("hi")[0].as_py(), t.column("lo")[0].as_py()
        left, right = np.flatnonzero(block == hi), np.flatnonzero(block == lo)
        near, parent, sets, texts, out = m.reshape(len(m), TREES, DEPTH), {}, {}, t.column("text"), []

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        def of(i):
            if i not in sets:
                sets[i] = shingles(texts[int(i)].as_py(), words)
            return sets[i]

        for i in left:
            js = right[(label[right] != label[i]) & ((ids[right] < ids[i]) | (hi != lo))]
            alike = (m[js] == m[i]).mean(1) >= least
            js = js[alike]
            if len(js) and tree:
                js = js[~(near[js, :tree] == near[i, :tree]).all(2).any(1)]
            for j in js:
                if ids[j] == ids[i] or root(label[i]) == root(label[j]):
                    continue
                x, y = of(i), of(j)
                same = _same(x, y) if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) else 0
                if same and 100 * same >= percent * (len(x) + len(y) - same):
                    parent[root(label[i])] = root(label[j])
                    out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
        return pa.table({"a": pa.array([int(x) for x, _ in out], pa.int64()), "b": pa.array([int(y) for _, y in out], pa.int64())})

    # Dealt anew: the join left all of a region in one task, which would do for the grouping but not for the work.
    return dealt.repartition("key", "hi", "lo").groupBy("key", "hi", "lo").applyInArrow(compare, "a long, b long").distinct()


def _classes(reps: DataFrame, label: DataFrame) -> DataFrame:
    """(digest, copies, component_id): the smallest id reachable from each distinct set."""
    found = reps.join(label, "node", "left").select("digest", "copies", "node", "doc_id", F.coalesce("component", "node").alias("component"))
    if reps.filter("node <> doc_id").isEmpty():
        return found.select("digest", "copies", F.col("component").alias("component_id"))
    least = found.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return found.join(least, "component").select("digest", "copies", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, text_hash) for every row: component_id is the smallest id reachable over confirmed links."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("text_hash", text_hash(F.col("text")))
    least = percent / 100 - MARGIN
    signed = table(_signed(docs, words), "signed")
    reps = _representatives(signed)
    n = reps.count()

    first = _members(reps, DEPTH, n)
    deep, rows, pairs, made = reps, first, first.filter("node <> a").select("a", F.col("node").alias("b")), []
    for depth in DEEPER:
        dense = rows.filter(F.col("n") > REGION).select("node").distinct()
        deep = table(deep.select("node", "sig").join(dense, "node", "left_semi"), "dense")
        made.append(deep)
        if deep.isEmpty():
            break
        rows = _members(deep, depth, deep.count())
        made.append(rows)
        pairs = pairs.unionByName(rows.filter("node <> a").select("a", F.col("node").alias("b")))
    pairs = table(pairs.distinct(), "pairs")
    drop_table(*made)
    near = table(_alike(pairs, reps, least), "near")
    drop_table(pairs)
    texts = _texts(near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))), reps, docs)
    links = table(_confirmed(near, texts, words, percent), "links")
    drop_table(near, texts)
    label = components(links)

    # Regions of three and more that still hold several components: compare across them.
    member = first.filter("n > 2").join(label, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("label"))
    member = table(member, "labelled")
    drop_table(first)
    split = table(member.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("w")).filter("x <> y").select("key", "w"), "split")
    if not split.isEmpty():
        rest = table(key_join(member, split, "key", "w", member.count()).drop("w"), "rest")
        drop_table(member)
        texts = _texts(rest, reps, docs)
        more = table(_crossing(rest.join(reps.select("node", "sig"), "node").join(texts, "node"), least, words, percent), "crossing")
        drop_table(rest, texts)
        if not more.isEmpty():
            drop_table(label)
            label = components(links.unionByName(more))
        drop_table(more)
    drop_table(member, split, links)

    classes = table(_classes(reps, label), "classes")
    known = key_join(signed.filter("doc_id is not null and digest is not null"), classes, "digest", "copies", signed.count())
    alone = signed.filter("doc_id is null or digest is null").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "n_shingles", "component_id", "text_hash"]
    out = table(known.select(*columns).unionByName(alone.select(*columns)), "near_duplicates")
    drop_table(signed, reps, classes, label)
    return out

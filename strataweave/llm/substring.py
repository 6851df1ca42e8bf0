"""Substring dedup by content-defined chunks of a gear rolling hash, their runs extended to the exact ends of a repetition.

A text is cut after each byte where the gear state (16 bits, so it looks back 16 bytes) is the smallest of the RADIUS bytes to either side:
cuts depend on 56 bytes around them only, lie more than RADIUS bytes apart, and shift with insertions. Chunks of more than MAX_CHUNK
bytes, as in periodic texts, are cut again from their start. Chunks are deduplicated by digest: the smallest document that has one
keeps it. Neighbouring chunks that lie alike in a document and in its smaller one form a run; each run is extended left and
right by the characters that both texts share, up to CONTEXT on either side. Runs of `min_chars` characters and more are reported;
those that overlap or touch as one span, under the smallest of their first documents.

What is left to chance: two texts that share a passage share a chunk of it if two cuts lie inside, as they do in 300 bytes but for a few cases in
a million; passages of less than 100 bytes are often missed. Of a passage whose outer chunks were all seen in other, smaller documents,
more than CONTEXT characters deep, the ends are those of what these documents share.

Defined results: null and empty texts have no chunks; repetitions within one document are left alone; repeated rows with one
id count as one document; rows with a null id take no part; other columns are ignored, and returned as they are by `drop_spans`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, key_join, prepare, table

RADIUS = 20
MAX_CHUNK = 160
MIN_CHARS = 100
CONTEXT = 256

_GEAR = np.random.Generator(np.random.PCG64(11)).integers(0, 2**16, 256, np.uint16)
_TOP = np.uint16(0xFFFF)


def gear(data: np.ndarray) -> np.ndarray:
    """State of h = (h << 1) + G[byte] (16 bits) after every byte, by doubling the window."""
    h = _GEAR[data]
    step = 1
    while step < 16:
        if len(h) > step:
            h = np.concatenate((h[:step], h[step:] + (h[:-step] << np.uint16(step))))
        step *= 2
    return h


def _least_around(h: np.ndarray) -> np.ndarray:
    """The smallest state of the RADIUS bytes to either side of each, by doubling."""
    edge, n = np.full(RADIUS, _TOP), 2 * RADIUS + 1
    x, have = np.concatenate((edge, h, edge)), 1
    while have < n:
        step = min(have, n - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def cuts(raw: bytes) -> np.ndarray:
    """Offsets of the chunks of a text and of its end, always between characters."""
    n = len(raw)
    data = np.frombuffer(raw, np.uint8)
    h = gear(data)
    starts = None
    if not raw.isascii():
        starts = np.append((data & 0xC0) != 0x80, True)  # where a character starts, or the text ends
        h[~starts[1:]] = _TOP
    at = np.flatnonzero((h == _least_around(h)) & (h < _TOP)) + 1
    if len(at):
        at = at[np.append(True, np.diff(at) > RADIUS)]  # equal states: the first
    edges = np.unique(np.concatenate(([0], at, [n])))
    long = np.flatnonzero(np.diff(edges) > MAX_CHUNK)
    if len(long):
        more = np.concatenate([np.arange(edges[i] + MAX_CHUNK - 3, edges[i + 1], MAX_CHUNK - 3) for i in long])
        if starts is not None:
            while not starts[more].all():
                more = more - ~starts[more]
        edges = np.unique(np.concatenate((edges, more)))
    return edges


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id is not null and text <> ''")


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, seq, pos, size, digest): the chunks of every text, offsets and sizes in characters."""
    prepare(docs.sparkSession)

    def scan(batches):
        for b in batches:
            ids, seq, pos, size, digest = [], [], [], [], []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = text.as_buffer().to_pybytes()
                at = cuts(raw)
                ends = at.tolist()
                digest += [xxhash.xxh3_64_intdigest(raw[lo:hi]) for lo, hi in zip(ends, ends[1:], strict=False)]
                if not raw.isascii():
                    before = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80, dtype=np.int64)
                    at = np.append(0, before)[at]
                ids.append(np.full(len(at) - 1, doc_id, np.int64))
                seq.append(np.arange(len(at) - 1, dtype=np.int32))
                pos.append(at[:-1])
                size.append(np.diff(at))
            cat = lambda x, t: pa.array(np.concatenate([np.zeros(0, t), *x]).astype(t))
            digests = pa.array(np.array(digest, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([cat(ids, np.int64), cat(seq, np.int32), cat(pos, np.int32), cat(size, np.int32), digests], ["doc_id", "seq", "pos", "size", "digest"])

    return _source(docs, id_col, text_col).mapInArrow(scan, "doc_id long, seq int, pos int, size int, digest long")


def _contexts(wanted: DataFrame, source: DataFrame) -> DataFrame:
    """(doc_id, at, left, text): up to CONTEXT characters of a document before `at`, reversed, or after it. Each text travels once."""
    asked = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("at", "left")).alias("asked"))

    def scan(batches):
        for b in batches:
            ids, places, lefts, texts = [], [], [], []
            for doc_id, text, asked in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                text = text.as_py()
                for at, left in zip(asked.values.field(0).to_pylist(), asked.values.field(1).to_pylist(), strict=True):
                    ids.append(doc_id)
                    places.append(at)
                    lefts.append(left)
                    texts.append(text[max(0, at - CONTEXT) : at][::-1] if left else text[at : at + CONTEXT])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int32()), pa.array(lefts, pa.bool_()), pa.array(texts, pa.string())], ["doc_id", "at", "left", "text"])

    return source.join(asked, "doc_id").select("doc_id", "text", "asked").mapInArrow(scan, "doc_id long, at int, left boolean, text string")


def shared(a: Column, b: Column) -> Column:
    """How many leading characters two contexts of at most CONTEXT share, by halving steps."""
    n = F.least(F.length(a), F.length(b))
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(CONTEXT.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, k: at + F.when((at + k <= n) & (F.substring(a, at + 1, k) == F.substring(b, at + 1, k)), k).otherwise(F.lit(0)))


def _extended(runs: DataFrame, source: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(doc_id, run, start, end): runs with their ends moved outwards as far as both texts agree; and the tables this reads."""
    side = lambda left: runs.select("doc_id", "run", F.lit(left).alias("left"), F.col("start" if left else "end").alias("at"), "first_doc_id", (F.col("start") - F.col("start_shift") if left else F.col("end") - F.col("end_shift")).alias("first_at"))
    edges = side(True).unionByName(side(False))
    wanted = edges.select("doc_id", "at", "left").unionByName(edges.select(F.col("first_doc_id").alias("doc_id"), F.col("first_at").alias("at"), "left")).distinct()
    seen = table(_contexts(wanted, source), "contexts")
    # A place of a first document may be asked for by many others.
    firsts = edges.groupBy(F.struct(F.col("first_doc_id").alias("doc_id"), F.col("first_at").alias("at"), "left").alias("of")).agg(F.count("*").alias("rows"))
    firsts = firsts.join(seen.select(F.struct("doc_id", "at", "left").alias("of"), F.col("text").alias("b")).dropDuplicates(["of"]), "of")
    both = edges.join(seen.withColumnRenamed("text", "a"), ["doc_id", "at", "left"]).withColumn("of", F.struct(F.col("first_doc_id").alias("doc_id"), F.col("first_at").alias("at"), "left"))
    both = key_join(both, firsts, "of", "rows", 2 * runs.count())
    moved = both.select("doc_id", "run", "left", "at", shared(F.col("a"), F.col("b")).alias("more"))
    out = moved.groupBy("doc_id", "run").agg(F.min(F.when(F.col("left"), F.col("at") - F.col("more"))).alias("start"), F.max(F.when(~F.col("left"), F.col("at") + F.col("more"))).alias("end"))
    return out, [seen]


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, start, end, n_chunks, first_doc_id): spans that a smaller document has too, offsets in characters."""
    chunks = table(chunked(docs, id_col, text_col), "chunks")
    first = chunks.groupBy("digest").agg(F.min(F.struct("doc_id", "pos")).alias("f"), F.max("doc_id").alias("last"), F.count("*").alias("rows")).filter("last > f.doc_id")
    first = table(first.select("digest", "rows", F.col("f.doc_id").alias("first_doc_id"), F.col("f.pos").alias("first_pos")), "first")
    # A document's copies of a chunk at other places than the shared one are shared as well; the first document keeps all of its own.
    hit = key_join(chunks, first, "digest", "rows", chunks.count()).filter("doc_id > first_doc_id")
    hit = hit.select("doc_id", "seq", "pos", "size", "digest", "first_doc_id", (F.col("pos") - F.col("first_pos")).alias("shift")).distinct()
    order = Window.partitionBy("doc_id").orderBy("seq", "pos")
    last = lambda c: F.lag(c).over(order)
    follows = (last("seq") == F.col("seq") - 1) & (last("first_doc_id") == F.col("first_doc_id")) & ((last("shift") == F.col("shift")) | (last("digest") == F.col("digest")))
    run = hit.withColumn("new", F.when(follows, 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    runs = run.groupBy("doc_id", "run", "first_doc_id").agg(F.min("pos").alias("start"), F.max(F.col("pos") + F.col("size")).alias("end"), F.min_by("shift", "pos").alias("start_shift"), F.max_by("shift", "pos").alias("end_shift"), F.count("*").alias("n_chunks"))
    runs = table(runs, "runs")
    drop_table(chunks, first)
    spans, made = _extended(runs, _source(docs, id_col, text_col))
    spans = spans.filter(F.col("end") - F.col("start") >= min_chars).join(runs.select("doc_id", "run", "first_doc_id", "n_chunks"), ["doc_id", "run"])
    order = Window.partitionBy("doc_id").orderBy("start", "end", "run")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.when(F.col("start") <= reached, 0).otherwise(1)).withColumn("span", F.sum("new").over(order))
    spans = spans.groupBy("doc_id", "span").agg(F.min("start").cast("long").alias("start"), F.max("end").cast("long").alias("end"), F.sum("n_chunks").alias("n_chunks"), F.min("first_doc_id").alias("first_doc_id"))
    out = table(spans.select("doc_id", "start", "end", "n_chunks", "first_doc_id"), "spans")
    drop_table(runs, *made)
    return out


def drop_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the spans cut out of their texts. Spans belong to an id, so rows that repeat an id should have one text."""
    per = spans.groupBy(F.col("doc_id").alias(id_col)).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__spans"))
    joined = docs.join(per, id_col, "left")
    first = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    text = F.col(text_col)
    cut = F.aggregate("__spans", first, lambda a, s: F.struct(F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))).alias("out"), s["end"].alias("at")), lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))
    return joined.select(*[F.when(F.col("__spans").isNull(), text).otherwise(cut).alias(c) if c == text_col else F.col(c) for c in docs.columns])

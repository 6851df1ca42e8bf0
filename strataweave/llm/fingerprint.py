"""I-Match document fingerprints.

Terms are lower-cased runs of letters and digits. The lexicon holds the terms whose document share lies in [LOW, HIGH] (an
inverse-document-frequency band, document frequencies counted over the whole corpus; a text whose copies are more than a HEAVY share
of the rows, and in a small corpus HEAVY_ROWS or a twentieth of the rows, counts once, so that it alone takes no term out of the band). As shares of all documents sum to
the mean number of distinct terms, the lexicon has at most (mean distinct terms) / LOW entries, however large the
corpus; that bound allows its broadcast. A fingerprint hashes the sorted distinct lexicon terms of a text, and those
within SUBSETS randomised lexicon subsets at each of several keep rates (so that for short and long texts alike some
subsets hold a few terms, the regime in which a hash survives an edit).

Defined results: null texts count as empty; a text without lexicon terms is fingerprinted by its whole content and the
same subsets of the terms it has, one without terms by its content alone; equal texts have equal fingerprints; repeated ids are ordered by text.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, prepare

LOW = 0.0005
HIGH = 0.2
LEAST_DOCS = 2
HEAVY = 0.01
HEAVY_ROWS = 10
RATES = (2, 4, 6, 8)  # a subset keeps a term with chance 2**-rate
SUBSETS = 16
FEW = 4

_TERM = re.compile(r"[^\W_]+")
_N = len(RATES) * SUBSETS
_SEED = np.random.Generator(np.random.PCG64(7)).integers(0, 2**64, _N, np.uint64) | np.uint64(1)


class _Hashes(dict):
    def __missing__(self, term: str) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[term] = xxhash.xxh3_64_intdigest(term)
        return h


_HASHES = _Hashes()


def terms(text: str | None) -> np.ndarray:
    """Sorted distinct term hashes of a text."""
    found = set(_TERM.findall(text.lower())) if text else ()
    h = np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))
    h.sort()
    return np.unique(h) if (h[1:] == h[:-1]).any() else h


def _hashed(docs: DataFrame, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(text.alias("text"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))


def heavy_copies(docs: DataFrame, n: int, text_col: str = "text") -> dict:
    """(h1, h2) -> rows, of the texts that count once; 1 / HEAVY at most."""
    groups = _hashed(docs, text_col).filter("text <> ''").groupBy("h1", "h2").count()
    return {(g.h1, g.h2): g["count"] for g in groups.filter(F.col("count") > max(LEAST_DOCS, HEAVY * n, min(HEAVY_ROWS, n / 20))).collect()}


def document_frequencies(docs: DataFrame, text_col: str = "text", heavy: dict | None = None) -> DataFrame:
    """(term, df) over all documents, those of a heavy text together one; counts are summed within each batch before they leave Python."""
    heavy = heavy or {}

    def scan(batches):
        for b in batches:
            sets, copied = [], {}
            for t, *h in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if (h := tuple(h)) in heavy:
                    copied[h] = (t, copied[h][1] + 1 if h in copied else 1)
                else:
                    sets.append(terms(t.as_py()))
            keys, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)
            parts = [(keys, n)] + [(k := terms(t.as_py()), np.full(len(k), c / heavy[h])) for h, (t, c) in copied.items()]
            for k, n in parts:
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n.astype(np.float32))], ["term", "n"])

    return _hashed(docs, text_col).mapInArrow(scan, "term long, n float").groupBy("term").agg(F.round(F.sum("n")).cast("long").alias("df"))


def lexicon(docs: DataFrame, text_col: str = "text", low: float = LOW, high: float = HIGH) -> np.ndarray:
    """The sorted term hashes in the band; see the module for the bound on their number."""
    prepare(docs.sparkSession)
    n = docs.count()
    heavy = heavy_copies(docs, n, text_col)
    n -= sum(heavy.values()) - len(heavy)
    band = document_frequencies(docs, text_col, heavy).filter((F.col("df") >= max(LEAST_DOCS, low * n)) & (F.col("df") <= max(LEAST_DOCS, high * n)))
    return np.sort(np.array([r.term for r in band.select("term").collect()], np.int64).view(np.uint64))


class Fingerprinter:
    def __init__(self, lex: np.ndarray):
        self.lex = lex
        self.rows, self.cols = self.members(lex), None

    @staticmethod
    def members(lex: np.ndarray) -> np.ndarray:
        """The subsets of each term, as bits."""
        keep = np.empty((len(lex), _N), bool)
        for j in range(_N):
            mixed = (lex ^ _SEED[j]) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            keep[:, j] = (mixed >> np.uint64(64 - RATES[j // SUBSETS])) == 0
        return np.packbits(keep, axis=1)

    def __call__(self, text: str | None) -> str:
        found = terms(text)
        if len(self.lex):
            at = np.searchsorted(self.lex, found)
            at[at == len(self.lex)] = 0
            at = at[self.lex[at] == found]
        else:
            at = np.zeros(0, np.int64)
        if len(at):
            mine, rows = self.lex[at], self.rows[at]
            whole = xxhash.xxh3_64_hexdigest(mine.tobytes())
        else:
            whole = hashlib.sha256((text or "").encode("utf-8", "surrogatepass")).hexdigest()
            if not len(found):
                return "whole:" + whole
            mine, rows = found, self.members(found)
        # The terms of all subsets in one run of bytes, subset by subset, each in order.
        member = np.ascontiguousarray(np.unpackbits(rows, axis=1, count=_N).T).view(bool)
        run = memoryview(mine[np.flatnonzero(member) % len(mine)].tobytes())
        ends = (np.cumsum(np.count_nonzero(member, axis=1)) * 8).tolist()
        out, begin = bytearray(3 * _N), 0
        for j, end in enumerate(ends):
            if end > begin:
                out[3 * j : 3 * j + 3] = (xxhash.xxh3_64_intdigest(run[begin:end], seed=j) % 0xFFFFFF + 1).to_bytes(3, "little")
            begin = end
        return f"{whole}:{base64.b64encode(out).decode()}"


def likeness(x: str, y: str) -> float:
    """1 for equal fingerprints; else the best keep rate's share of agreeing subsets among those with terms."""
    if x == y:
        return 1.0
    if x.startswith("whole:") or y.startswith("whole:"):
        return 0.0
    a, b = (np.frombuffer(base64.b64decode(s.split(":")[1]), np.uint8).reshape(len(RATES), SUBSETS, 3) for s in (x, y))
    used = (a.any(2) | b.any(2)).sum(1)
    same = ((a == b).all(2) & a.any(2)).sum(1)
    return float((same / np.maximum(used, FEW)).max())


def fingerprints(docs: DataFrame, lex: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every row; narrow."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(lex)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def scan(batches):
        fp = Fingerprinter(shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fp(t.as_py()) for t in b.column(1)], pa.string())], ["id", "fingerprint"])

    return source.mapInArrow(scan, f"id {source.schema['id'].dataType.simpleString()}, fingerprint string").select(F.col("id").alias(id_col), "fingerprint")


def in_descending_order(docs: DataFrame) -> DataFrame:
    """(bucket, doc_id, text, ahead): rows dealt into ranges of ids, sorted downwards within each, the first rows of the next range
    repeated behind each with ahead = true (after the last range, those of the first). One shuffle of the texts; what reaches
    the driver is a quantile and an id for each range, whose number follows the number of partitions.
    """
    spark = docs.sparkSession
    n = partitions(spark) * 8
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)).cast("long"))
    cuts = docs.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 100 * n)).first()[0] or []
    cuts = np.unique(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        return pd.Series(len(cuts) - np.searchsorted(cuts, ids.to_numpy()), dtype="int32")

    dealt = docs.withColumn("key", key).withColumn("bucket", bucket("key"))
    firsts = sorted((r.bucket, r.first) for r in dealt.select("key", "bucket").groupBy("bucket").agg(F.max("key").alias("first")).collect())
    after = [(firsts[i - 1][0], firsts[i][1]) for i in range(len(firsts))]
    ahead = spark.createDataFrame(after, "bucket int, key long")
    again = docs.withColumn("key", key).join(F.broadcast(ahead), "key").select("bucket", "key", "doc_id", "text", F.lit(True).alias("ahead"))
    rows = dealt.select("bucket", "key", "doc_id", "text", F.lit(False).alias("ahead")).unionByName(again)
    return rows.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "ahead", F.desc("key"), "text")


def edited_comparison(docs: DataFrame, lex: np.ndarray) -> DataFrame:
    """Each document's fingerprint against that of its edited text and of the next document by descending id."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(lex)
    rows = in_descending_order(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))

    def scan(batches):
        fp = Fingerprinter(shared.value)
        held = None  # (bucket, doc_id, text, fingerprint) of the row that waits for its next one
        for b in batches:
            out = []
            for bucket, doc_id, text, ahead in zip(*(b.column(c).to_pylist() for c in ("bucket", "doc_id", "text", "ahead")), strict=True):
                if ahead and held is None:
                    continue
                print_ = fp(text)
                if held is not None:
                    _, last_id, last, last_print = held
                    k = len(last) // 3
                    edited = last[: len(last) - k] + text[:k]
                    edited_print = last_print if edited == last else fp(edited)
                    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((last_id, len(last), sha, last_print, edited_print, likeness(last_print, edited_print), likeness(last_print, print_)))
                held = None if ahead else (bucket, doc_id, text, print_)
            cols = list(zip(*out, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return rows.select("bucket", "doc_id", "text", "ahead").mapInArrow(scan, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")



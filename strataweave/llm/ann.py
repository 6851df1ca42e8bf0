"""Nearest neighbours by inner product with cross-polytope hashing.

Three rounds of random signs and a fast Hadamard transform rotate each unit vector; its hash in a table is the signed axis nearest to it.
Queries probe, in each of TABLES tables, the PROBED share of the axes they are nearest to. Where norms differ, vectors are
put into bands of norm and, within a band, completed by one coordinate to a common norm, which turns largest inner product
into nearest angle.

Buckets are packed into tasks of about equal row counts, large buckets cut over several. Each vector goes to one task a table and each query
once to every task that holds a bucket it probes. A task holds its vectors, streams its queries past them in blocks, scores only the
buckets each query probes by matrix products, and emits each query's k best, rescored exactly. Queries that find fewer than k probe
every bucket of one table.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part; vectors of different
lengths never meet; ties go to the smaller id; rows that repeat an id are one candidate and one query, with the largest of
their products.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, prepare, table

TABLES = 3
PROBED = 7 / 16
#: The completing coordinate makes angles wider, so banded queries probe this many times the share.
BANDED = 2
ROUNDS = 3
#: Vectors that one task holds, at most and at least; between them, all are dealt evenly over the shuffle partitions.
MOST_ROWS = 65_536
LEAST_ROWS = 512
#: Inner products computed at a time.
PRODUCTS = 4_000_000
FLAT = 1.001


def _hadamard(x: np.ndarray) -> np.ndarray:
    d, h = x.shape[1], 1
    while h < d:
        y = x.reshape(len(x), d // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), 2).reshape(len(x), d)
        h *= 2
    return x / np.sqrt(d)


def rotations(x: np.ndarray, number: int) -> np.ndarray:
    """Rows of x, padded to a power of two, under pseudo-rotation `number`."""
    d = 1 << max(1, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, d - x.shape[1])))
    g = np.random.Generator(np.random.PCG64([d, number]))
    for _ in range(ROUNDS):
        x = _hadamard(x * g.choice((-1.0, 1.0), d))
    return x


def axes(x: np.ndarray, number: int, probes: int) -> np.ndarray:
    """The nearest signed axes of each row, nearest first; axis i is 2 i, its opposite 2 i + 1."""
    y = rotations(x, number)
    both = np.stack((y, -y), 2).reshape(len(y), -1)
    if probes == 1:
        return both.argmax(1)[:, None]
    return np.argsort(-both, axis=1, kind="stable")[:, :probes]


def _stacks(vecs: pa.Array):
    """(dim, rows, matrix) for the vectors of each length in a batch."""
    lens = vecs.value_lengths().to_numpy()
    for dim in np.unique(lens).tolist():
        rows = np.flatnonzero(lens == dim)
        yield dim, rows, vecs.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), dim)


def _buckets(dim: int, norm: np.ndarray, x: np.ndarray, tops: dict[int, float], tables: int):
    """(band, table, rows, bucket): where index vectors lie."""
    x = x.astype(np.float64)
    if tops:
        exponent = np.floor(np.log2(norm)).astype(int)
        scaled = x / np.array([tops[e] for e in exponent.tolist()])[:, None]
        unit = np.hstack((scaled, np.sqrt(np.maximum(0, 1 - (scaled**2).sum(1)))[:, None]))
        bands = {e: np.flatnonzero(exponent == e) for e in np.unique(exponent).tolist()}
    else:
        unit, bands = x / norm[:, None], {0: np.arange(len(x))}
    for t in range(tables):
        near = axes(unit, t, 1)[:, 0]
        for e, at in bands.items():
            yield e, t, at, near[at]


def _counts(rows: DataFrame, tops: dict[int, float], tables: int) -> dict[tuple, int]:
    """Rows of each bucket. Its size is bounded: tables * bands * 4 * dim entries for vectors of one length."""

    def scan(batches):
        for b in batches:
            n = Counter()
            norm = b.column(1).to_numpy()
            for dim, own, x in _stacks(b.column(0)):
                for e, t, _, bucket in _buckets(dim, norm[own], x, tops, tables):
                    for k, c in zip(*np.unique(bucket, return_counts=True), strict=True):
                        n[dim, e, t, int(k)] += int(c)
            keys = list(zip(*n, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([*(pa.array(k, pa.int64()) for k in keys), pa.array(n.values(), pa.int64())], ["dim", "band", "t", "bucket", "n"])

    found = rows.select("vec", "norm").mapInArrow(scan, "dim long, band long, t long, bucket long, n long").groupBy("dim", "band", "t", "bucket").agg(F.sum("n").alias("n"))
    return {tuple(r)[:4]: r.n for r in found.collect()}


def _deal(counts: dict[tuple, int], target: int) -> tuple[dict[tuple, tuple[int, int]], int]:
    """Bucket -> (first task, number of tasks): neighbouring buckets of a table share a task until it is full."""
    place, task, filled, last = {}, -1, 0, None
    for key in sorted(counts):
        n = counts[key]
        if n > target:
            cuts = -(-n // target)
            place[key] = (task + 1, cuts)
            task, last = task + cuts, None
            continue
        if last != key[:3] or filled + n > target:
            task, filled, last = task + 1, 0, key[:3]
        filled += n
        place[key] = (task, 1)
    return place, task + 1


_DEALT = "task long, kind int, id long, bucket long, vec binary, probed array<long>"
_SCHEMA = pa.schema([("task", pa.int64()), ("kind", pa.int32()), ("id", pa.int64()), ("bucket", pa.int64()), ("vec", pa.binary()), ("probed", pa.list_(pa.int64()))])


def _batch(kind: int, task, ids, bucket, vec, probed) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((task, [kind] * len(task), ids, bucket, vec, probed), _SCHEMA, strict=True)], schema=_SCHEMA)


def _index_rows(rows: DataFrame, tops, tables: int, place) -> DataFrame:
    def scan(batches):
        for b in batches:
            ids, norm = b.column(0).to_numpy(), b.column(2).to_numpy()
            for dim, own, x in _stacks(b.column(1)):
                raw = [v.tobytes() for v in x]
                for e, t, at, bucket in _buckets(dim, norm[own], x, tops, tables):
                    where = [place[dim, e, t, k] for k in bucket.tolist()]
                    mine = ids[own[at]]
                    mixed = (mine.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
                    task = [first + int(h) % cuts for (first, cuts), h in zip(where, mixed, strict=True)]
                    yield _batch(0, task, mine, bucket, [raw[i] for i in at], [None] * len(task))

    return rows.select("id", "vec", "norm").mapInArrow(scan, _DEALT)


def _query_rows(rows: DataFrame, tops, tables: int, share: float, place) -> DataFrame:
    def scan(batches):
        for b in batches:
            ids, norm = b.column(0).to_numpy(), b.column(2).to_numpy()
            for dim, own, x in _stacks(b.column(1)):
                unit = x.astype(np.float64) / norm[own][:, None]
                if tops:
                    unit = np.hstack((unit, np.zeros((len(unit), 1))))
                probes = max(1, int(np.ceil((2 << max(1, (unit.shape[1] - 1).bit_length())) * share)))
                for t in range(tables):
                    near = axes(unit, t, probes)
                    task, mine, vec, probed = [], [], [], []
                    for i, r in enumerate(own.tolist()):
                        asked = defaultdict(list)
                        for e in tops or (0,):
                            for k in near[i].tolist():
                                first, cuts = place.get((dim, e, t, k), (0, 0))
                                for c in range(first, first + cuts):
                                    asked[c].append(k)
                        raw = x[i].tobytes()
                        for c, ks in asked.items():
                            task.append(c)
                            mine.append(ids[r])
                            vec.append(raw)
                            probed.append(ks)
                    yield _batch(1, task, mine, [None] * len(task), vec, probed)

    return rows.select("id", "vec", "norm").mapInArrow(scan, _DEALT)


def _best(ids, x, starts, qid, y, probed, k: int):
    """(q, c, score) lists: each query's k best among the rows of the buckets it probes; starts: bucket -> its rows."""
    products = np.full((len(y), len(x)), -np.inf)
    asking = defaultdict(list)
    for i, ks in enumerate(probed):
        for b in set(ks):
            asking[b].append(i)
    for b, at in asking.items():
        if b in starts:
            lo, hi = starts[b]
            products[at, lo:hi] = y[at] @ x[lo:hi].T
    products[qid[:, None] == ids[None, :]] = -np.inf
    keep = min(k, len(x))
    least = np.partition(products, len(x) - keep, axis=1)[:, len(x) - keep]
    for i in range(len(y)):
        floor = least[i] - 1e-9 * max(1.0, abs(least[i])) if np.isfinite(least[i]) else -np.inf
        js = np.flatnonzero((products[i] >= floor) & (products[i] > -np.inf))
        score = (y[i] * x[js]).sum(1)
        js = js[(top := np.lexsort((ids[js], -score))[:k])]
        yield np.full(len(js), qid[i]), ids[js], score[top]


def _best_of_tasks(dealt: DataFrame, k: int, width: type) -> DataFrame:
    """(q, c, score). dealt is partitioned by task and sorted, a task's vectors before its queries; queries stream."""

    def matrix(vecs) -> np.ndarray:
        return np.frombuffer(b"".join(vecs), width).reshape(len(vecs), -1).astype(np.float64)

    def scan(batches):
        now, held, ready = None, [], None
        for b in batches:
            task, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
            edges = np.flatnonzero(np.diff(task * 2 + kind)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(task)], strict=True):
                if lo == hi:
                    continue
                part = b.slice(lo, hi - lo)
                if task[lo] != now:
                    now, held, ready = task[lo], [], None
                if kind[lo] == 0:
                    held.append((part.column(2).to_numpy(), part.column(3).to_numpy(), matrix(part.column(4).to_pylist())))
                    continue
                if not held and ready is None:
                    continue
                if ready is None:
                    ids, bucket, x = (np.concatenate(c) for c in zip(*held, strict=True))
                    held, order = [], np.argsort(bucket, kind="stable")
                    names, at = np.unique(bucket[order], return_index=True)
                    ready = ids[order], x[order], dict(zip(names.tolist(), zip(at.tolist(), [*at.tolist()[1:], len(x)], strict=True), strict=True))
                qid, y, probed = part.column(2).to_numpy(), matrix(part.column(4).to_pylist()), part.column(5).to_pylist()
                step = max(1, PRODUCTS // len(ready[0]))
                for i in range(0, len(qid), step):
                    cut = slice(i, i + step)
                    q, c, s = (np.concatenate(z) for z in zip(*_best(*ready, qid[cut], y[cut], probed[cut], k), strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(c, pa.int64()), pa.array(s, pa.float64())], ["q", "c", "score"])

    return dealt.mapInArrow(scan, "q long, c long, score double")


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", tables: int = TABLES, probed: float = PROBED) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row, its k nearest found by inner product in double precision."""
    spark = vectors.sparkSession
    prepare(spark)
    single = dict(vectors.dtypes)[vec_col] == "array<float>"
    width = np.float32 if single else np.float64
    vec = F.col(vec_col) if single else F.transform(F.col(vec_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), vec.alias("vec")).filter("id is not null and vec is not null and size(vec) > 0")
    rows = rows.filter(~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).filter("norm > 0 and norm < double('Infinity')")
    asked = rows.filter("asks")

    low, high = rows.agg(F.min("norm"), F.max("norm")).first()
    flat = low is None or high <= FLAT * low
    tops = {} if flat else {r.band: r.top for r in rows.groupBy(F.floor(F.log2("norm")).cast("int").alias("band")).agg(F.max("norm").alias("top")).collect()}

    def found(queries: DataFrame, n_tables: int, share: float) -> DataFrame:
        counts = _counts(rows, tops, n_tables)
        place, tasks = _deal(counts, min(MOST_ROWS, max(LEAST_ROWS, sum(counts.values()) // partitions(spark))))
        dealt = _index_rows(rows, tops, n_tables, place).unionByName(_query_rows(queries, tops, n_tables, share, place))
        dealt = dealt.repartition(max(1, tasks), "task").sortWithinPartitions("task", "kind")
        # One exchange by query serves the merging of tasks and tables and the ranking.
        each = _best_of_tasks(dealt, k, width).repartition("q").groupBy("q", "c").agg(F.max("score").alias("score"))
        return each.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "c"))).filter(F.col("rank") <= k)

    first = table(found(asked, tables, min(1.0, probed if flat else probed * BANDED)), "found")
    short = asked.select("id").distinct().join(first.groupBy(F.col("q").alias("id")).agg(F.count("*").alias("n")), "id", "left").filter(F.coalesce("n", F.lit(0)) < k).select("id")
    short = table(short, "short")
    if not short.isEmpty():
        again = table(found(asked.join(short, "id", "left_semi"), 1, 1.0), "found")
        first = first.join(short.withColumnRenamed("id", "q"), "q", "left_anti").unionByName(again)
    return first.select(F.col("q").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("c").alias("vec_id"), "score")

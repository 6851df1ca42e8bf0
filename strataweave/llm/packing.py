"""Packing documents into sequences by cutting-stock column generation.

Documents are tokenized once; each is cut into full pieces of the sequence length and a remainder, so piece lengths come from a bounded
set whatever the corpus. Lengths round up to units of GRAIN tokens; the histogram over those units (at most length / GRAIN
numbers) is all that reaches the driver. There a linear program over packing patterns is solved by column generation: a revised simplex
whose columns an unbounded-knapsack dynamic program prices, stopped by Farley's bound. Pattern counts are rounded down, what remains is packed
best-fit, and patterns claim documents by their rank within a length. Ranks come from counts by task and length.

Defined results: null text counts as empty (one closing token); repeated rows are packed each for themselves; ties rank in the order of
the tasks' rows; an empty table has no pieces.
"""

from __future__ import annotations

import bisect
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, table, tidy

LENGTH = 2048
GRAIN = 8
END_ID = 1
GAP = 1e-3
MOST_PIVOTS = 20_000
PAYS = 1e-6
POOL_WORTH = 0.9
BROADCAST_ROWS = 200_000
#: Texts whose words are in memory at a time.
AT_ONCE = 256

_PLAIN = re.compile(r"[\x21-\x7e\xc0-\xff]+")
#: The split pattern of word_bpe_49k for plain chunks, where white space is gone.
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|[\W_]+")


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordTokenizer:
    """Ids of texts by a `tokenizers` file that drops white space, one look at each distinct chunk between ASCII white space in a batch.

    No id reaches across white space, so a text's ids are those of its chunks in turn. Plain chunks go through the file's own split rule
    and its BPE model word by word; all others go through the whole tokenizer. The first LIMIT chunks and words met are remembered, and
    those are the frequent ones; a full memory is kept.
    """

    LIMIT = 100_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.model._resize_cache(0)  # chunks and stems are the memory here
        self.spell = self.whole.model.tokenize
        self.letters = _byte_letters()
        self.stems = _Memory(self.stem, self.LIMIT)
        self.chunks = _Memory(self.chunk, self.LIMIT)

    def stem(self, w: str) -> bytes:
        spelled = w if w.isascii() else "".join(map(self.letters.__getitem__, w.encode()))
        return array("I", [t.id for t in self.spell(spelled)]).tobytes()

    def chunk(self, raw: bytes) -> bytes:
        if raw.isalpha():  # ASCII letters: one word
            return self.stems[raw.decode().lower()]
        s = raw.decode("utf-8", "replace")
        if _PLAIN.fullmatch(s) and "<|" not in s:
            return b"".join(map(self.stems.__getitem__, _SPLIT.findall(s.lower())))
        return array("I", self.whole.encode(s, add_special_tokens=False).ids).tobytes()

    def ids(self, texts: pa.Array) -> pa.Array:
        """Little-endian unsigned 32-bit ids of each text, without the closing one; a null text counts as empty."""
        words = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        flat = words.flatten().dictionary_encode()
        distinct = flat.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)
        found = pa.array(map(self.chunks.__getitem__, distinct), pa.large_binary())
        return pc.binary_join(pa.ListArray.from_arrays(words.offsets, found.take(flat.indices)), pa.scalar(b"", pa.large_binary()))


class _Memory(dict):
    """Values of make by key; the first `limit` short keys are kept."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        value = self.make(key)
        if len(self) < self.limit and len(key) <= 64:
            self[key] = value
        return value


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, unit, part, nth): part is the task, nth counts a task's pieces of one unit."""
    prepare(docs.sparkSession)

    def scan(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        tok, seen = tokenizer(path), {}
        end = array("I", [END_ID]).tobytes()
        for b in batches:
            out = []
            texts = (ids for lo in range(0, b.num_rows, AT_ONCE) for ids in tok.ids(b.column(1).slice(lo, AT_ONCE)))
            for doc_id, ids in zip(b.column(0).to_pylist(), texts, strict=True):
                ids = ids.as_py() + end
                total = len(ids) // 4
                for at in range(0, total, length):
                    own = ids[4 * at : 4 * (at + length)]
                    unit = -(-len(own) // (4 * GRAIN))
                    seen[unit] = nth = seen.get(unit, -1) + 1
                    out.append((doc_id, at, len(own) // 4, zlib.crc32(own), total, unit, part, nth))
            cols = list(zip(*out, strict=True)) or [()] * 8
            kinds = [pa.int64()] * 5 + [pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "unit", "part", "nth"])
        tidy()

    source = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return source.mapInArrow(scan, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, unit int, part int, nth long")


def _knapsack(y: np.ndarray, units: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack over units with values y: the best value of every room, and the unit it takes (-1: a smaller room's)."""
    value, choice = np.zeros(room + 1), np.full(room + 1, -1)
    upto = np.searchsorted(units, np.arange(room + 1), side="right")
    for c in range(1, room + 1):
        value[c] = value[c - 1]
        if k := upto[c]:
            gain = value[c - units[:k]] + y[:k]
            i = int(gain.argmax())
            if gain[i] > value[c] + 1e-12:
                value[c], choice[c] = gain[i], i
    return value, choice


def _pattern(choice: np.ndarray, units: np.ndarray, room: int) -> np.ndarray:
    pattern, c = np.zeros(len(units)), room
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            pattern[choice[c]] += 1
            c -= units[choice[c]]
    return pattern


def patterns(units: np.ndarray, demand: np.ndarray, room: int) -> list[tuple[np.ndarray, float]]:
    """(pattern, times) of a near-optimal fractional packing of the histogram.

    Each pricing yields the best pattern and, for every unit, the best one that holds it; those that pay join a pool, from which
    columns enter until none pays. Farley's bound (the sum over the dearest pattern's value) ends the search.
    """
    m = len(units)
    basis = np.diag((room // units).astype(float))
    inverse = np.diag(1.0 / np.diag(basis))
    # A trace of noise keeps pivots from stalling on ties.
    demand = demand * (1 + 1e-6 * np.random.Generator(np.random.PCG64(3)).random(m))
    x = inverse @ demand
    pool, cost = np.zeros((0, m)), np.ones(m)
    for turn in range(MOST_PIVOTS):
        y = cost @ inverse
        worth = pool @ y
        if y.min() < -PAYS:  # more than was asked for costs nothing
            column, price = np.zeros(m), 0.0
            column[int(y.argmin())] = -1
        elif not len(pool) or worth.max() <= 1 + PAYS:
            y = np.maximum(y, 0)
            value, choice = _knapsack(y, units, room)
            if value[room] <= 1 + PAYS or 1 - 1 / value[room] <= GAP:
                break
            held = y + value[room - units]
            pays = [i for i in np.argsort(-held) if held[i] > 1 + PAYS]
            fresh = [_pattern(choice, units, room)]
            for i in pays:
                p = _pattern(choice, units, int(room - units[i]))
                p[i] += 1
                fresh.append(p)
            pool = np.unique(np.vstack([pool[worth > POOL_WORTH], *fresh]), axis=0)
            continue
        else:
            column, price = pool[int(worth.argmax())], 1.0
        d = inverse @ column
        ratio = np.full(m, np.inf)
        np.divide(x, d, out=ratio, where=d > 1e-7)
        r = int(np.where(ratio <= ratio.min() * (1 + 1e-9) + 1e-12, d, -1).argmax())
        if not np.isfinite(ratio[r]):
            break
        basis[:, r], cost[r] = column, price
        step = ratio[r]
        x = x - step * d
        x[r] = step
        x = np.maximum(x, 0)
        if turn % 200 == 199:
            inverse = np.linalg.inv(basis)
            x = np.maximum(inverse @ demand, 0)
        else:
            row = inverse[r] / d[r]
            inverse -= np.outer(d, row)
            inverse[r] = row
    return [(basis[:, j].astype(np.int64), float(x[j])) for j in range(m) if cost[j] and x[j] > 1e-9]


def plan(histogram: dict[int, int], room: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Claims (unit, first rank, first sequence, pieces a sequence), for each unit by rising first rank; number of sequences."""
    units = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[int(u)] for u in units], np.int64)
    left, claims, given, sequences = demand.copy(), [], np.zeros(len(units), np.int64), 0

    def claim(pattern: np.ndarray, times: int) -> None:
        nonlocal sequences
        for i in np.flatnonzero(pattern):
            claims.append((int(units[i]), int(given[i]), sequences, int(pattern[i])))
            given[i] += pattern[i] * times
        sequences += times

    whole = units == room  # full pieces fill their sequences alone
    if whole.any():
        claim(whole.astype(np.int64), int(demand[whole][0]))
        left[whole] = 0
    open_ = np.flatnonzero(left)
    if len(open_):
        for p, times in sorted(patterns(units[open_], left[open_], room), key=lambda x: -x[1]):
            pattern = np.zeros(len(units), np.int64)
            pattern[open_] = p
            used = pattern > 0
            n = min(int(times + 1e-6), int((left[used] // pattern[used]).min()))
            if n > 0:
                claim(pattern, n)
                left = left - n * pattern
        # What rounding left, at most a few pieces for each pattern: best fit, longest first.
        bins: list[tuple[int, int]] = []
        content: list[np.ndarray] = []
        for i in np.flatnonzero(left)[::-1]:
            for _ in range(int(left[i])):
                at = bisect.bisect_left(bins, (int(units[i]), -1))
                if at < len(bins):
                    free, k = bins.pop(at)
                else:
                    free, k = room, len(content)
                    content.append(np.zeros(len(units), np.int64))
                content[k][i] += 1
                if free > units[i]:
                    bisect.insort(bins, (free - int(units[i]), k))
        for c in content:
            claim(c, 1)
    return sorted(claims, key=lambda c: (c[0], c[1])), sequences


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for every piece."""
    spark = docs.sparkSession
    cut = table(pieces(docs, path, id_col, text_col, length), "pieces")
    counts = cut.groupBy("unit", "part").agg(F.count("*").alias("n"))
    histogram = {r.unit: r.n for r in counts.groupBy("unit").agg(F.sum("n").alias("n")).collect()}
    claims, _ = plan(histogram, length // GRAIN)
    first = {}
    for c in claims:
        first.setdefault(c[0], []).append(c[1:])
    shared = spark.sparkContext.broadcast({u: np.array(v, np.int64) for u, v in first.items()})
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("unit").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    small = before.count() <= BROADCAST_ROWS
    ranked = cut.join(F.broadcast(before) if small else before, ["unit", "part"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "unit", (F.col("before") + F.col("nth")).alias("rank"))

    def assign(batches):
        for b in batches:
            unit, rank = b.column(5).to_numpy(), b.column(6).to_numpy()
            sequence = np.empty(len(unit), np.int64)
            for u in np.unique(unit):
                own, claim = np.flatnonzero(unit == u), shared.value[int(u)]
                at = np.searchsorted(claim[:, 0], rank[own], side="right") - 1
                sequence[own] = claim[at, 1] + (rank[own] - claim[at, 0]) // claim[at, 2]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence)], [*b.schema.names[:5], "sequence_id"])

    dealt = ranked.mapInArrow(assign, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long")
    ahead = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0).cast("long")))

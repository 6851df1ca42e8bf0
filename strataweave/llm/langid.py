"""Language identification with blended-spectrum presence kernels.

k(x, y) = |G(x) & G(y)| / sqrt(|G(x)| |G(y)|), where G is the set of letter n-grams of orders 1 to 3 of the lower-cased
text, runs of other characters being one space. A bounded, stratified sample of labelled rows (PER_LANGUAGE rows for
each language) trains one-versus-rest kernel ridge regression on Nystrom landmarks. As the kernel is a scalar product
of normalised presence vectors, landmarks and coefficients fold into one (n-gram x language) matrix, and documents
are scored in batches by a product of their presence rows with it.

Defined results: null texts and texts without a letter give `und` with score 0; ties go to the smaller language name; without
any labelled row every text gives `und`; repeated rows are scored each for themselves; columns that are kept give way to lang_pred and
score if they have these names.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, tidy

ORDERS = 3
PER_LANGUAGE = 200
LANDMARKS = 240
#: Sampling prefers rows of at most this many characters; longer ones serve, whole, where a language has no others.
PREFERRED_CHARS = 20_000
RIDGE = 1e-3
SCORED_AT_ONCE = 64

_FOLD: np.ndarray | None = None


def _fold() -> np.ndarray:
    """Code point -> lower-case letter, or 32 for all that is no letter."""
    global _FOLD
    if _FOLD is None:
        table = np.full(sys.maxunicode + 1, 32, np.uint32)
        for cp in range(sys.maxunicode + 1):
            ch = chr(cp)
            if ch.isalpha():
                low = ch.lower()
                table[cp] = ord(low) if len(low) == 1 else cp
        _FOLD = table
    return _FOLD


def ngrams(text: str | None) -> np.ndarray | None:
    """Sorted distinct n-gram keys of a text, None if it has no letter."""
    if not text:
        return None
    folded = _fold()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    letter = folded != 32
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    s = np.concatenate(([32], folded[keep], [32])).astype(np.uint64)
    two = (s[:-1] << np.uint64(21)) | s[1:]
    three = (two[:-1] << np.uint64(21)) | s[2:]
    return np.unique(np.concatenate((s, two, three)))


@dataclass
class Model:
    languages: list[str]
    keys: np.ndarray
    weights: np.ndarray

    def scores(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row of one-versus-rest values for each set of n-grams."""
        out = np.zeros((len(sets), len(self.languages)))
        if not len(self.keys):
            return out
        for lo in range(0, len(sets), SCORED_AT_ONCE):
            part = sets[lo : lo + SCORED_AT_ONCE]
            flat = np.concatenate(part)
            at = np.searchsorted(self.keys, flat)
            at[at == len(self.keys)] = 0
            hit = self.keys[at] == flat
            row = np.repeat(np.arange(len(part)), [len(p) for p in part])[hit]
            starts = np.searchsorted(row, np.arange(len(part) + 1))
            full = starts[1:] > starts[:-1]
            if full.any():
                sums = np.add.reduceat(self.weights[at[hit]], starts[:-1][full])
                out[lo : lo + len(part)][full] = sums
            out[lo : lo + len(part)] /= np.sqrt([[len(p)] for p in part])
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language and score of each text; the n-grams of SCORED_AT_ONCE texts are in memory at a time."""
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        for lo in range(0, len(texts) if self.languages else 0, SCORED_AT_ONCE):
            sets = [ngrams(t) for t in texts[lo : lo + SCORED_AT_ONCE]]
            known = [i for i, s in enumerate(sets) if s is not None]
            if not known:
                continue
            values = self.scores([sets[i] for i in known])
            for i, b, v in zip(known, values.argmax(1), values.max(1), strict=True):
                names[lo + i], scores[lo + i] = self.languages[b], float(min(1.0, max(0.0, v)))
        return names, scores


def fit(samples: list[tuple[str, np.ndarray]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Kernel ridge regression on landmarks; samples are (language, n-gram keys), in a fixed order."""
    languages = sorted({lang for lang, _ in samples})
    if not languages:
        return Model([], np.zeros(0, np.uint64), np.zeros((0, 0)))
    by = {lang: [s for name, s in samples if name == lang] for lang in languages}
    each = max(1, landmarks // len(languages))
    chosen = [s for lang in languages for s in by[lang][:each]]
    keys = np.unique(np.concatenate(chosen))
    presence = np.zeros((len(keys), len(chosen)), np.float32)
    for j, s in enumerate(chosen):
        presence[np.searchsorted(keys, s), j] = 1 / np.sqrt(len(s))

    def kernel(s: np.ndarray) -> np.ndarray:
        at = np.searchsorted(keys, s)
        at[at == len(keys)] = 0
        return presence[at[keys[at] == s]].sum(0, dtype=np.float64) / np.sqrt(len(s))

    k_nm = np.stack([kernel(s) for _, s in samples])
    k_mm = np.stack([kernel(s) for s in chosen])
    y = np.array([[float(lang == name) for name in languages] for lang, _ in samples])
    # Balanced: each language weighs the same, however many rows it has.
    w = 1.0 / (y @ y.sum(0))
    left = k_nm.T @ (k_nm * w[:, None]) + ridge * k_mm + 1e-9 * np.eye(len(chosen))
    alpha = np.linalg.solve(left, k_nm.T @ (y * w[:, None]))
    return Model(languages, keys, presence.astype(np.float64) @ alpha)


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = PER_LANGUAGE) -> Model:
    """Fit on at most per_language labelled rows of each language, chosen by a hash of the id.

    Texts stay on the executors: only their n-gram keys reach the driver, per_language sets for each language.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    order = Window.partitionBy("lang").orderBy(F.length("text") > PREFERRED_CHARS, F.xxhash64("id"), "id")
    picked = rows.select("id", "lang", "text").withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= per_language).drop("rn")

    def extract(batches):
        for b in batches:
            sets = [ngrams(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(1), pa.array([None if s is None else s.tobytes() for s in sets], pa.binary())], ["id", "lang", "grams"])

    got = picked.mapInArrow(extract, "id string, lang string, grams binary").collect()
    got = sorted(((r.lang, r.id, bytes(r.grams)) for r in got if r.grams), key=lambda r: (r[0], hash_order(r[1]), r[1], r[2]))
    return fit([(lang, np.frombuffer(g, np.uint64)) for lang, _, g in got])


def hash_order(s: str | None) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(s or "")


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, keep..., lang_pred, score) for every row; one narrow pass. The model (bounded by the sample) is broadcast."""
    spark = docs.sparkSession
    prepare(spark)
    keep = tuple(c for c in keep if c not in ("lang_pred", "score"))
    shared = spark.sparkContext.broadcast((model.languages, model.keys, model.weights))
    source = docs.select(F.col(text_col).cast("string").alias("__text"), F.col(id_col), *keep)

    def scan(batches):
        m = Model(*shared.value)
        for b in batches:
            names, scores = m.predict(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*b.schema.names[1:], "lang_pred", "score"])
        tidy()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[1:])
    return source.mapInArrow(scan, f"{fields}, lang_pred string, score double")

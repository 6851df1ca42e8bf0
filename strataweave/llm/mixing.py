"""Mixing sources to target weights by iterative proportional fitting.

The corpus is a contingency table of token weights over source, language and topic. Its cells are raked to target marginals: in turn,
each marginal's cells are scaled to its targets until all hold. A document's weight is its cell's fitted over its actual tokens, and
documents are sampled by calibrated probabilities min(1, s * weight), s chosen so that the expected tokens are the `budget` share of the
corpus. The draw hashes the id, so it repeats. Where s * weight exceeds 1 a document can't be chosen often enough, and the chosen miss the
targets; `copies` draws such documents several times, so that the expected tokens meet both the targets and the budget.

Tables of up to DRIVER_CELLS cells, counted first, are raked on the driver; larger ones by aggregations and joins, with the same steps
and the same rules to stop, so that the two differ by rounding only.

Defined results: null categories form a category of their own; null texts weigh nothing; cells without tokens get weight 1;
an empty table gives an empty one; rows that repeat an id share its draw; weight and probability take the place of columns with
their names, other columns are returned as they are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_table, table

MARGINALS = ("source", "lang", "topic")
SMOOTHING = 0.7
BUDGET = 0.75
ROUNDS = 200
EXACT = 1e-9
HALVINGS = 60
DRIVER_CELLS = 200_000
SEED = 17
CHARS_A_TOKEN = 4


def tokens(text: Column) -> Column:
    return F.ceil(F.coalesce(F.length(text), F.lit(0)) / CHARS_A_TOKEN).cast("double")


def topic(text: Column) -> Column:
    """A coarse kind of text: tables, and prose by length."""
    n = F.coalesce(F.length(text), F.lit(0))
    return F.when(F.contains(text, F.lit(" | ")), "table").when(n < 600, "note").when(n < 4000, "article").otherwise("book")


def smoothed(totals: np.ndarray) -> np.ndarray:
    """Target shares: actual shares to the power SMOOTHING, which lifts the small."""
    p = np.where(totals > 0, totals, 0.0) ** SMOOTHING * (totals > 0)
    return p / p.sum() if p.sum() else p


def rake(weights: np.ndarray, groups: list[np.ndarray], targets: list[np.ndarray], rounds: int = ROUNDS) -> np.ndarray:
    """Iterative proportional fitting: groups[m][cell] is the cell's category in marginal m, targets[m] the shares wanted."""
    w = weights.astype(float).copy()
    total = w.sum()
    for _ in range(rounds if total else 0):
        off = 0.0
        for g, t in zip(groups, targets, strict=True):
            now = np.bincount(g, w, len(t))
            off = max(off, float(np.abs(now / total - t).max()))
            w *= np.divide(t * total, now, out=np.ones(len(t)), where=now > 0)[g]
        if off < EXACT:
            break
    return w


def calibrated(ratio: np.ndarray, weights: np.ndarray, budget: float) -> np.ndarray:
    """min(1, s * ratio) with the weights' expected share equal to budget (1 for every cell if that can't be exceeded)."""
    total = weights.sum()
    positive = ratio[(ratio > 0) & (weights > 0)]
    if not total or not len(positive) or budget >= 1:
        return np.ones_like(ratio)
    low, high = 0.0, 1.0 / positive.min()
    for _ in range(HALVINGS):
        s = (low + high) / 2
        low, high = (s, high) if (weights * np.minimum(1, s * ratio)).sum() < budget * total else (low, s)
    return np.minimum(1, high * ratio)


def _cells(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return rows.groupBy(*names).agg(F.sum("tokens").alias("actual"))


def _fit_on_driver(cells: DataFrame, names: tuple[str, ...], targets: dict, budget: float) -> DataFrame:
    got = cells.toPandas().sort_values(list(names), na_position="first").reset_index(drop=True)
    actual = got["actual"].to_numpy(float)
    groups, wanted = [], []
    for name in names:
        codes, values = pd.factorize(got[name], use_na_sentinel=False)
        totals = np.bincount(codes, actual, len(values))
        asked = targets.get(name)
        share = smoothed(totals) if asked is None else np.array([asked.get(None if pd.isna(v) else v, 0.0) for v in values], float) * (totals > 0)
        groups.append(codes)
        wanted.append(share / share.sum() if share.sum() else share)
    fitted = rake(actual, groups, wanted)
    got["weight"] = np.divide(fitted, actual, out=np.ones(len(actual)), where=actual > 0)
    got["probability"] = calibrated(got["weight"].to_numpy(), actual, budget)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema.fields if f.name in names) + ", weight double, probability double"
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in got[[*names, "weight", "probability"]].itertuples(index=False)]
    return cells.sparkSession.createDataFrame(rows, schema)


def _fit_distributed(cells: DataFrame, names: tuple[str, ...], targets: dict, budget: float) -> DataFrame:
    """The same with one aggregation and join for each marginal and round; targets given as dictionaries become small frames."""
    spark = cells.sparkSession
    total = cells.agg(F.sum("actual")).first()[0] or 0.0
    wanted = {}
    for name in names:
        t = cells.groupBy(F.col(name).alias("c")).agg(F.sum("actual").alias("n"))
        if targets.get(name) is None:
            share = F.when(F.col("n") > 0, F.pow("n", F.lit(SMOOTHING))).otherwise(0.0)
        else:
            asked = spark.createDataFrame([(k, float(v)) for k, v in targets[name].items()], f"k {cells.schema[name].dataType.simpleString()}, asked double")
            t = t.join(asked, F.expr("c <=> k"), "left")
            share = F.when(F.col("n") > 0, F.coalesce("asked", F.lit(0.0))).otherwise(0.0)
        t = table(t.select("c", share.alias("share")), "targets")
        wanted[name] = t.withColumn("share", F.col("share") / (t.agg(F.sum("share")).first()[0] or 1.0))
    now = cells.withColumn("w", F.col("actual"))
    for _ in range(ROUNDS if total else 0):
        off = 0.0
        for name in names:
            have = now.groupBy(F.col(name).alias("h")).agg(F.sum("w").alias("have")).join(wanted[name], F.expr("h <=> c"))
            have = table(have.select("c", "have", "share"), "have")
            off = max(off, have.agg(F.max(F.abs(F.col("have") / total - F.col("share")))).first()[0])
            factor = have.select(F.col("c").alias("__c"), F.when(F.col("have") > 0, F.col("share") * total / F.col("have")).otherwise(1.0).alias("__f"))
            new = table(now.join(factor, now[name].eqNullSafe(factor["__c"])).select(*names, "actual", (F.col("w") * F.col("__f")).alias("w")), "raked")
            drop_table(now, have)
            now = new
        if off < EXACT:
            break
    fit = now.withColumn("weight", F.when(F.col("actual") > 0, F.col("w") / F.col("actual")).otherwise(1.0))
    least = fit.filter("weight > 0 and actual > 0").agg(F.min("weight")).first()[0]
    if not total or least is None or budget >= 1:
        return fit.select(*names, "weight", F.lit(1.0).alias("probability"))
    low, high = 0.0, 1.0 / least
    for _ in range(HALVINGS):
        s = (low + high) / 2
        kept = fit.agg(F.sum(F.col("actual") * F.least(F.lit(1.0), F.col("weight") * s))).first()[0] or 0.0
        low, high = (s, high) if kept < budget * total else (low, s)
    return fit.select(*names, "weight", F.least(F.lit(1.0), F.col("weight") * high).alias("probability"))


def weigh(docs: DataFrame, names: tuple[str, ...] = MARGINALS, tokens_col: str = "tokens", targets: dict | None = None, budget: float = BUDGET, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """docs plus weight and probability; docs must have the marginal columns and tokens_col."""
    rows = docs.select(*names, F.col(tokens_col).cast("double").alias("tokens"))
    cells = table(_cells(rows, names), "cells")
    small = cells.count() <= driver_cells
    fit = (_fit_on_driver if small else _fit_distributed)(cells, names, targets or {}, budget)
    fit = fit.withColumnsRenamed({n: f"__{n}" for n in names} | {"weight": "__weight", "probability": "__probability"})
    on = [docs[n].eqNullSafe(fit[f"__{n}"]) for n in names]
    kept = [docs[c] for c in docs.columns if c not in ("weight", "probability")]
    return docs.join(F.broadcast(fit) if small else fit, on, "left").select(*kept, fit["__weight"].alias("weight"), fit["__probability"].alias("probability"))


def drawn(id_col: str, seed: int = SEED) -> Column:
    """A number in [0, 1) for each id."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 53)) / F.lit(float(1 << 53))


def copies(weight: Column, id_col: str, budget: float = BUDGET, seed: int = SEED) -> Column:
    """How often to take a document: budget * weight in expectation, which meets the raked marginals."""
    wanted = F.coalesce(weight, F.lit(1.0)) * budget
    return (F.floor(wanted) + (drawn(id_col, seed) < wanted - F.floor(wanted)).cast("long")).cast("long")

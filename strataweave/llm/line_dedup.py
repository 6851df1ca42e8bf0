"""Site-relative line dedup, in DataFrame functions only.

For each host the pages that contain a line are divided by the host's pages; lines above `ratio` on at least `min_pages` pages are
boilerplate and go. Lines are told apart by two 64-bit hashes, so texts don't travel with the counts; the counts are
combined before the shuffle, so a hot host or line costs no more than others.

A host has at most (mean lines a page) / ratio boilerplate lines. The set is broadcast only if its rows are at most
BROADCAST_ROWS, counted first; beyond that it is joined by host, a host's pages dealt over SALTS tasks.

Defined results: null text stays null with 0 lines; lines of white space are never boilerplate, a carriage return being white space;
null hosts form one host; a row's repeated line counts once; a text of nothing but boilerplate becomes empty; hosts of less than
`min_pages` pages keep all lines; the counts take the place of columns with their names, other columns are returned as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

RATIO = 0.05
MIN_PAGES = 5
BROADCAST_ROWS = 100_000
SALTS = 32


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _hash(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"))


def _host(host: Column) -> Column:
    return F.struct(host.isNull().alias("none"), F.coalesce(host, F.lit("")).alias("name"))


def boilerplate(docs: DataFrame, host_col: str, text_col: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, line, pages, total): the lines to drop, by hash."""
    rows = docs.select(_host(F.col(host_col).cast("string")).alias("host"), F.col(text_col).cast("string").alias("text"))
    total = rows.groupBy("host").agg(F.count("*").alias("total"))
    lines = rows.select("host", F.explode(F.array_distinct(F.filter(_lines(F.col("text")), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]")))).alias("x"))
    pages = lines.select("host", _hash(F.col("x")).alias("line")).groupBy("host", "line").agg(F.count("*").alias("pages"))
    return pages.filter(F.col("pages") >= min_pages).join(total, "host").filter(F.col("pages") > F.lit(ratio) * F.col("total"))


def drop_lines(docs: DataFrame, host_col: str, text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, n_lines: str | None = "n_lines", n_dropped: str | None = "n_dropped") -> DataFrame:
    """docs with its boilerplate lines dropped from text_col; the counts are added under the given names, if any."""
    bad = table(boilerplate(docs, host_col, text_col, ratio, min_pages).select("host", "line"), "boilerplate")
    sets = bad.groupBy("host").agg(F.collect_set("line").alias("bad"))
    # The row travels as one column, so that no name of its own meets those used here.
    row = lambda c: F.col("row")[c]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.select("row", _host(row(host_col).cast("string")).alias("host"), _lines(row(text_col).cast("string")).alias("lines"))
    if bad.count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(sets), "host", "left")
    else:
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("lines"), F.lit(SALTS)))
        sets = sets.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        rows = rows.join(sets, ["host", "salt"], "left")
    rows = rows.withColumn("hit", F.when(F.col("bad").isNotNull(), F.array_intersect(F.transform("lines", _hash), F.col("bad"))))
    kept = F.when(F.size("hit") > 0, F.filter("lines", lambda x: ~F.array_contains("hit", _hash(x)))).otherwise(F.col("lines"))
    rows = rows.withColumn("kept", kept)
    count = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long")
    counts = {n_lines: count("lines"), n_dropped: count("lines") - count("kept")}
    out = [F.array_join("kept", "\n").alias(c) if c == text_col else row(c).alias(c) for c in docs.columns if c not in counts]
    return rows.select(*out, *[v.alias(c) for c, v in counts.items() if c])

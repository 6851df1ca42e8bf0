"""Connected components of an edge table by alternating large-star and small-star rounds, all on executors.

Each round is two aggregations and two joins whose hot keys adaptive execution can split; rounds are written to the shared
folder. Labels are the smallest id of each component. No edge list, label or component reaches the driver; only a row count and
a checksum do, to see when nothing changes any more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, table


def _round(edges: DataFrame) -> DataFrame:
    """edges: (u, v) with u > v. Returns the same kind after a large-star and a small-star step."""
    sym = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = sym.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    large = sym.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    small = large.groupBy("u").agg(F.min("v").alias("m"))
    moved = large.join(small, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(small.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Nulls and loops take no part; an empty table gives an empty one.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    now = table(e, "edges")
    before = _state(now)
    while before[0]:
        new = table(_round(now), "edges")
        drop_table(now)
        now, after = new, _state(new)
        if after == before:
            break
        before = after
    out = table(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
    drop_table(now)
    return out

"""Integrity rules of the canonical model as queries that must find nothing: (rule, by, key, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..errors import ModelValidationError
from ..functions import text as T
from . import resolve
from .resolve import with_optional

SEVERITIES = ("INFO", "WARNING", "ERROR")
VARIABLES = ["status_variable", "data_variable", "equipment_constant"]
#: Which types the roles may refer to; other roles say nothing.
ROLE_TYPES = {"format": ["variable_format"], "standards": ["standard_reference"], "set_event": ["collection_event"], "clear_event": ["collection_event"], "event": ["collection_event"], "variables": VARIABLES, "reports": ["default_report"]}


def check_types(df: DataFrame, schema: str | StructType) -> None:
    """Fails unless the columns are those of the schema, type by type; nothing is cast."""
    wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    for f in wanted:
        if have.get(f.name) != f.dataType.simpleString():
            raise ModelValidationError(f"{f.name} is {have.get(f.name, 'missing')}, not {f.dataType.simpleString()}")


def _rule(rows: DataFrame, by: list[str], rule: str, broken: Column, key: str, detail: Column) -> DataFrame:
    return rows.filter(F.coalesce(broken, F.lit(True))).select(F.lit(rule).alias("rule"), *by, F.col(key).alias("key"), detail.cast("string").alias("detail"))


def _in_place(rows: DataFrame, by: list[str], key: str) -> DataFrame:
    return _rule(rows, by, "a place has a line and a column from 1 on", (F.col("line") < 1) | (F.col("col") < 1) | F.col("path").isNull(), key, F.concat_ws(":", "line", "col"))


def subjects(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rules of single subjects and of all keys together."""
    rows = with_optional(rows, "wkn_value", "wkn_authority", "wkn_scope", "wkn_status")
    entities = rows.filter("key is not null")
    loose = T.blank(F.col("wkn_value")) | T.blank(F.col("wkn_authority")) | T.blank(F.col("wkn_scope"))
    twice = entities.groupBy(*by, "key").agg(F.count("*").alias("n"))
    return reduce(DataFrame.unionByName, [
        _rule(entities, by, "a key is not blank", T.blank(F.col("key")), "key", F.col("canonical_type")),
        _rule(twice, by, "a key stands once", F.col("n") > 1, "key", F.col("n")),
        _rule(rows, by, "a verified name has value, authority and scope", (F.lower(F.coalesce("wkn_status", F.lit(""))) == "verified") & loose, "key", F.col("wkn_value")),
        _in_place(rows, by, "key"),
    ])


def references(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rules of references before they are resolved."""
    allowed = F.array().cast("array<string>")
    for role, kinds in ROLE_TYPES.items():
        allowed = F.when(F.col("field") == role, F.array(*map(F.lit, kinds))).otherwise(allowed)
    beyond = (F.size(allowed) > 0) & (F.size(F.array_except("target_types", allowed)) > 0)
    return reduce(DataFrame.unionByName, [
        _rule(rows, by, "target types are distinct", F.size("target_types") > F.size(F.array_distinct("target_types")), "owner_key", F.col("role")),
        _rule(rows, by, "target types fit the role", beyond, "owner_key", F.col("role")),
        _in_place(rows, by, "owner_key"),
    ])


def relationships(rows: DataFrame, entities: DataFrame, by: list[str]) -> DataFrame:
    """Rules of outcomes: owners, targets, candidates and scopes are entities, of a type and within the scope that was asked for."""
    rows = with_optional(rows, "scope_key")
    known = with_optional(entities, "owner_key").select(*by, F.col("key").alias("end"), F.col("canonical_type").alias("end_type"), F.col("owner_key").alias("end_owner"))
    ends = rows.withColumn("end", F.explode(F.concat(F.when(F.col("target_key").isNotNull(), F.array("target_key")).otherwise(F.array().cast("array<string>")), "candidate_keys")))
    ends = ends.join(known, [*by, "end"], "left")
    typed = (F.size("target_types") > 0) & ~F.array_contains("target_types", F.col("end_type"))
    outside = F.col("scope_key").isNotNull() & (F.col("end_type") == "remote_command_parameter") & ~F.col("end_owner").eqNullSafe(F.col("scope_key"))
    lost = lambda column: rows.filter(F.col(column).isNotNull()).withColumn("end", F.col(column)).join(known, [*by, "end"], "left_anti")
    always = F.lit(True)
    return reduce(DataFrame.unionByName, [
        _rule(lost("owner_key"), by, "an owner is an entity", always, "owner_key", F.col("role")),
        _rule(lost("scope_key"), by, "a scope is an entity", always, "owner_key", F.col("role")),
        _rule(ends, by, "a target is an entity", F.col("end_type").isNull(), "owner_key", F.col("end")),
        _rule(ends.filter("end_type is not null"), by, "a target is of a type asked for", typed, "owner_key", F.col("end")),
        _rule(ends.filter("end_type is not null"), by, "a target lies within the scope", outside, "owner_key", F.col("end")),
        _rule(resolve.violations(rows), by, "an outcome doesn't contradict itself", always, "owner_key", F.col("role")),
    ])


def diagnostics(rows: DataFrame, by: list[str]) -> DataFrame:
    empty = (F.coalesce("code", F.lit("")) == "") | (F.coalesce("message", F.lit("")) == "")
    return _rule(rows, by, "a diagnostic has code, message and a known severity", empty | ~F.col("severity").isin(*SEVERITIES), "owner_key", F.col("code"))


def indexes(rows: DataFrame) -> DataFrame:
    """Index rows whose keys aren't distinct and in order, or are none."""
    return rows.filter((F.size("keys") == 0) | (F.array_sort(F.array_distinct("keys")) != F.col("keys")))

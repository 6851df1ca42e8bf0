"""Semantic differences between matched entities: properties, ordered lists and multisets, and how sure additions are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INTERFACE, DOCUMENTATION, UNKNOWN = "INTERFACE_CHANGE", "DOCUMENTATION_CHANGE", "UNKNOWN_CHANGE"

#: Kind and category of a changed field, whatever its entity type.
FIELD_KINDS = {
    "implementation_id": ("IMPLEMENTATION_ID_CHANGED", INTERFACE), "wkn": ("WELL_KNOWN_NAME_CHANGED", INTERFACE), "name": ("NAME_CHANGED", INTERFACE),
    "description": ("DESCRIPTION_CHANGED", DOCUMENTATION), "declared_source": ("DOCUMENTATION_CHANGED", DOCUMENTATION), "notes": ("DOCUMENTATION_CHANGED", DOCUMENTATION), "created_date": ("DOCUMENTATION_CHANGED", DOCUMENTATION),
    "data_type": ("DATA_TYPE_CHANGED", INTERFACE), "units": ("UNIT_CHANGED", INTERFACE), "minimum": ("RANGE_CHANGED", INTERFACE), "maximum": ("RANGE_CHANGED", INTERFACE), "default": ("DEFAULT_CHANGED", INTERFACE),
    "state_transition": ("STATE_TRANSITION_CHANGED", INTERFACE), "requirements.documentation": ("DOCUMENTATION_CHANGED", DOCUMENTATION), "unknown_extensions": ("UNKNOWN_CHANGE", UNKNOWN), "extension_metadata": ("UNKNOWN_CHANGE", UNKNOWN),
}
#: Kind of any other field, by entity type.
TYPE_KINDS = {
    "supported_message": "SUPPORTED_MESSAGE_CHANGED", "remote_command_parameter": "COMMAND_PARAMETER_CHANGED", "remote_command": "COMMAND_CHANGED",
    "standard_reference": "STANDARD_METADATA_CHANGED", "equipment_metadata": "EQUIPMENT_METADATA_CHANGED", "equipment_interface": "INTERFACE_METADATA_CHANGED", "alarm": "ALARM_CHANGED",
}
#: Prefixes of public change codes.
PREFIXES = {
    "status_variable": "SV", "data_variable": "DV", "equipment_constant": "EC", "collection_event": "CE", "alarm": "AL", "remote_command": "RC", "remote_command_parameter": "RCP",
    "supported_message": "SM", "variable_format": "VF", "default_report": "DR", "event_report_link": "ERL", "standard_reference": "STD", "equipment_metadata": "EQ", "equipment_interface": "EI",
}
#: Kind of a changed relationship by role, and by owner for other roles.
ROLE_KINDS = {"format": "FORMAT_CHANGED", "standards": "STANDARD_METADATA_CHANGED", "parameters": "COMMAND_PARAMETER_CHANGED"}
OWNER_KINDS = {"alarm": "ALARM_EVENT_LINK_CHANGED", "default_report": "REPORT_CONTENT_CHANGED", "event_report_link": "EVENT_REPORT_LINK_CHANGED"}
#: The further kind of an entity that is added or removed.
DOMAIN_KINDS = {
    "remote_command_parameter": "COMMAND_PARAMETER_CHANGED", "supported_message": "SUPPORTED_MESSAGE_CHANGED", "event_report_link": "EVENT_REPORT_LINK_CHANGED",
    "standard_reference": "STANDARD_METADATA_CHANGED", "default_report": "REPORT_CONTENT_CHANGED",
}
#: All kinds of changes.
KINDS = (
    "ENTITY_ADDED", "ENTITY_REMOVED", "ENTITY_MODIFIED", "IMPLEMENTATION_ID_CHANGED", "WELL_KNOWN_NAME_CHANGED", "NAME_CHANGED", "DESCRIPTION_CHANGED", "DATA_TYPE_CHANGED", "FORMAT_CHANGED", "UNIT_CHANGED",
    "RANGE_CHANGED", "DEFAULT_CHANGED", "RELATIONSHIP_ADDED", "RELATIONSHIP_REMOVED", "RELATIONSHIP_CHANGED", "REPORT_CONTENT_CHANGED", "EVENT_REPORT_LINK_CHANGED", "ALARM_EVENT_LINK_CHANGED",
    "COMMAND_PARAMETER_CHANGED", "COMMAND_CHANGED", "MESSAGE_STRUCTURE_CHANGED", "SUPPORTED_MESSAGE_CHANGED", "STANDARD_METADATA_CHANGED", "STATE_TRANSITION_CHANGED", "EQUIPMENT_METADATA_CHANGED",
    "INTERFACE_METADATA_CHANGED", "ALARM_CHANGED", "IDENTITY_EVIDENCE_CHANGED", "DOCUMENTATION_CHANGED", "UNKNOWN_CHANGE",
)


def properties(old: DataFrame, new: DataFrame, on: list[str], fields: list[str]) -> DataFrame:
    """(on, field, before, after): one row for every field that differs, NULL-safe; values as text.

    One join of the versions, then a stack of the fields: a tall self join would shuffle a row for each field.
    """
    a = old.select(*on, *[F.col(f).cast("string").alias(f"__o_{f}") for f in fields])
    b = new.select(*on, *[F.col(f).cast("string").alias(f"__n_{f}") for f in fields])
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"__o_{f}").alias("before"), F.col(f"__n_{f}").alias("after")) for f in fields])
    changed = a.join(b, on).select(*on, F.explode(F.filter(rows, lambda r: ~r["before"].eqNullSafe(r["after"]))).alias("r"))
    return changed.select(*on, "r.field", "r.before", "r.after")


def _lookup(c: Column, values: dict[str, str], default: Column) -> Column:
    out = default
    for k, v in reversed(values.items()):
        out = F.when(c == k, v).otherwise(out)
    return out


def classified(changes: DataFrame, type_col: str = "canonical_type") -> DataFrame:
    """changes plus kind and category; structure fields depend on their owner, other fields on their type."""
    by_type = _lookup(F.col(type_col), TYPE_KINDS, F.lit("UNKNOWN_CHANGE"))
    structure = F.when(F.col("field") == "structure", F.when(F.col(type_col) == "supported_message", "MESSAGE_STRUCTURE_CHANGED").when(F.col(type_col) == "variable_format", "FORMAT_CHANGED"))
    known = _lookup(F.col("field"), {f: k for f, (k, _) in FIELD_KINDS.items()}, F.coalesce(structure, by_type))
    kind = F.when(F.col("field").rlike(r"\.(extensions|metadata)$"), "UNKNOWN_CHANGE").when(F.col("field").rlike(r"\.documentation$") & (F.col("field") != "requirements.documentation"), "DESCRIPTION_CHANGED").otherwise(known)
    category = F.when(kind == "UNKNOWN_CHANGE", UNKNOWN).when(kind.isin("DESCRIPTION_CHANGED", "DOCUMENTATION_CHANGED"), DOCUMENTATION).otherwise(INTERFACE)
    return changes.withColumn("kind", kind).withColumn("category", category)


def change_code(type_col: Column, kind: Column) -> Column:
    """PREFIX_SUFFIX; unknown types and kinds fail."""
    prefix = _lookup(type_col, PREFIXES, F.raise_error(F.concat(F.lit("no prefix for "), type_col)).cast("string"))
    known = F.when(kind.isin(*KINDS), kind).otherwise(F.raise_error(F.concat(F.lit("no change of kind "), kind)).cast("string"))
    return F.concat(prefix, F.lit("_"), F.regexp_replace(known, "^ENTITY_", ""))


def role_kind(role: Column, type_col: Column, before: Column, after: Column) -> Column:
    """Kind of a changed role; a role that says nothing more is one added or removed if the other side is empty. before, after: sizes."""
    kind = _lookup(role, ROLE_KINDS, _lookup(type_col, OWNER_KINDS, F.lit("RELATIONSHIP_CHANGED")))
    return F.when(kind != "RELATIONSHIP_CHANGED", kind).when((before == 0) & (after > 0), "RELATIONSHIP_ADDED").when((after == 0) & (before > 0), "RELATIONSHIP_REMOVED").otherwise(kind)


def multisets(old: DataFrame, new: DataFrame, on: list[str], item: str, order: str) -> DataFrame:
    """(on, added, removed, order_changed): members gained and lost with multiplicity, joined in order of value; NULL where a side
    is missing altogether counts as empty, with presence_changed."""
    count = lambda df, name: df.groupBy(*on, item).agg(F.count("*").alias(name))
    delta = count(old, "o").join(count(new, "n"), [*on, item], "full").withColumn("d", F.coalesce("n", F.lit(0)) - F.coalesce("o", F.lit(0)))
    repeat = lambda c: F.array_join(F.flatten(F.array_sort(F.collect_list(F.when(c > 0, F.array_repeat(F.col(item), c.cast("int")))))), ",")
    moved = delta.groupBy(*on).agg(repeat(F.col("d")).alias("added"), repeat(-F.col("d")).alias("removed"))
    seq = lambda df, name: df.groupBy(*on).agg(F.array_sort(F.collect_list(F.struct(order, item))).alias(name))
    lists = seq(old, "os").join(seq(new, "ns"), on, "full")
    values = lambda c: F.transform(F.col(c), lambda s: s[item])
    flags = lists.select(*on, F.coalesce((F.array_sort(values("os")) == F.array_sort(values("ns"))) & (values("os") != values("ns")), F.lit(False)).alias("order_changed"), (F.col("os").isNull() | F.col("ns").isNull()).alias("presence_changed"))
    return moved.join(flags, on)


def certain(unmatched: DataFrame, uncertain_types: DataFrame, by: list[str] | None = None) -> DataFrame:
    """unmatched (by, side, key, canonical_type, reason) plus kind: ENTITY_ADDED and ENTITY_REMOVED only if no entity of the type is uncertain
    on the other side; else INSUFFICIENT_IDENTITY. uncertain_types: (by, side, canonical_type) of ambiguous entities. Entities that wait for
    another one (dependency_key) are as certain as that is.
    """
    by = by or []
    shaky = unmatched.filter("reason <> 'NO_COUNTERPART'").select(*by, "side", "canonical_type").unionByName(uncertain_types.select(*by, "side", "canonical_type")).distinct()
    other = shaky.select(*by, F.when(F.col("side") == "old", "new").otherwise("old").alias("side"), "canonical_type", F.lit(True).alias("shaky"))
    sure = unmatched.join(other, [*by, "side", "canonical_type"], "left").withColumn("sure", F.col("shaky").isNull() & (F.col("reason") == "NO_COUNTERPART"))
    if "dependency_key" in unmatched.columns:
        parent = sure.filter("sure").select(*by, "side", F.col("key").alias("dependency_key"), F.lit(True).alias("follows"))
        sure = sure.join(parent, [*by, "side", "dependency_key"], "left").withColumn("sure", F.col("sure") | F.coalesce("follows", F.lit(False))).drop("follows")
    kind = F.when(F.col("sure") & (F.col("side") == "old"), "ENTITY_REMOVED").when(F.col("sure"), "ENTITY_ADDED").otherwise("INSUFFICIENT_IDENTITY")
    return sure.withColumn("kind", kind).drop("shaky", "sure")


def tree_deltas(old: DataFrame, new: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, path, old, new): where two node tables differ by place alone, the baseline that knows no identities. Indentation between elements
    says nothing; attributes have no order.
    """
    by = by or []

    def flat(nodes: DataFrame, name: str) -> DataFrame:
        text = F.when((F.col("n_children") == 0) | (F.btrim("text", F.lit(" \t\r\n")) != ""), F.col("text"))
        value = F.to_json(F.struct("ns", "local", F.array_sort(F.map_entries("attrs")).alias("attrs"), text.alias("text")))
        return nodes.select(*by, "path", value.alias(name))

    return flat(old, "old").join(flat(new, "new"), [*by, "path"], "full").filter(~F.col("old").eqNullSafe(F.col("new")))


def summary(changes: DataFrame) -> DataFrame:
    """One row of counts and flags over classified changes."""
    n = lambda c: F.count_if(c)
    return changes.agg(
        F.count("*").alias("changes"), n(F.col("category") == INTERFACE).alias("interface"), n(F.col("category") == DOCUMENTATION).alias("documentation"), n(F.col("category") == UNKNOWN).alias("unknown"),
        n(F.col("kind") == "ENTITY_ADDED").alias("added"), n(F.col("kind") == "ENTITY_REMOVED").alias("removed"),
        (n(F.col("category") == UNKNOWN) == 0).alias("is_complete"),
    )

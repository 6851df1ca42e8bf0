"""Semantic comparison of two versions: what was added, removed and changed, and what can't be told.

Subjects are entities with their `fields` (JSON texts by name), `roles` (sizes of reference lists, -1 for single references) and `opaque`
fields; the equipment and the interface are subjects without a key. All frames carry the `by` columns of a pair and a `side`, so many
pairs are compared at once. Uncertainty is a result: every endpoint and every addition says whether it is sure.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import cut
from . import diff, graph
from .match import Matching, match_interfaces
from .resolve import RESOLVED, with_optional

OPAQUE = "opaque content can't be shown to mean the same"
OPAQUE_SHAPE = "a data shape holds opaque extensions"
OPAQUE_REFERENCE = "a reference holds opaque metadata"
UNSURE_TARGET = "the target has no confirmed counterpart"
NO_TARGET = "the reference names no single target"
OTHER_UNSURE = "entities of this type are uncertain in the other version"


def _union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _wkn(prefix: str = "") -> Column:
    c = lambda name: F.col(f"{prefix}wkn_{name}")
    return F.when(c("value").isNotNull(), T.json_object(value=T.json_text(c("value")), authority=T.json_text(c("authority")), scope=T.json_text(c("scope")), authority_status=T.json_text(F.lower(c("status")))))


def identities(subjects: DataFrame, matching: Matching, unmatched: DataFrame) -> DataFrame:
    """(by, side, key, canonical_type, identity, known): each entity as the end of a reference: its match, a sure addition or removal, or only
    what it says of itself."""
    by = matching.by
    sure = unmatched.filter("kind <> 'INSUFFICIENT_IDENTITY'").select(*by, "side", "key", F.lit(True).alias("sure"))
    e = subjects.filter("key is not null").join(matching.sides(), [*by, "side", "key"], "left").join(sure, [*by, "side", "key"], "left")
    kind = T.json_text(F.col("canonical_type"))
    matched = T.json_object(state=F.lit('"matched"'), entity_type=kind, old_key=T.json_text(F.col("old_key")), new_key=T.json_text(F.col("new_key")))
    alone = T.json_object(state=F.lit('"unmatched"'), side=T.json_text(F.col("side")), entity_type=kind, key=T.json_text(F.col("key")))
    unsure = T.json_object(state=F.lit('"uncertain"'), entity_type=kind, implementation_id=T.json_text(F.col("implementation_id")), name=T.json_text(F.col("name")), wkn=_wkn())
    known = F.col("old_key").isNotNull() | F.col("sure").isNotNull()
    return e.select(*by, "side", "key", "canonical_type", F.when(F.col("old_key").isNotNull(), matched).when(F.col("sure"), alone).otherwise(unsure).alias("identity"), known.alias("known"))


def role_items(subjects: DataFrame, relationships: DataFrame, matching: Matching, idents: DataFrame) -> DataFrame:
    """(by, old_key, new_key, canonical_type, side, owner_key, field, idx, role, item, known, resolved, opaque): the ends of matched owners'
    roles, and one row without an end (idx NULL, size) for each role that is there."""
    by = matching.by
    owners = matching.sides().withColumnRenamed("key", "owner_key").join(subjects.select(*by, "side", F.col("key").alias("owner_key"), "canonical_type"), [*by, "side", "owner_key"])
    own = [*by, "old_key", "new_key", "canonical_type", "side", "owner_key"]
    end = lambda name: idents.select(*by, "side", F.col("key").alias(f"{name}_key"), F.col("identity").alias(name), F.col("known").alias(f"{name}_known"))
    r = with_optional(relationships, "scope_key", "wkn_value", "wkn_authority", "wkn_scope", "wkn_status", "json").drop("canonical_type").join(owners, [*by, "side", "owner_key"])
    r = r.join(end("target"), [*by, "side", "target_key"], "left").join(end("scope"), [*by, "side", "scope_key"], "left")
    types = T.json_list(F.transform(F.array_sort("target_types"), lambda t: T.json_text(t)))
    loose = T.json_object(state=T.json_text(F.lower("state")), reason=T.json_text(F.lower(F.coalesce("reason", F.lit("NOT_ATTEMPTED")))), target_types=types, implementation_id=T.json_text(F.col("implementation_id")), name=T.json_text(F.col("name")), wkn=_wkn(), scope=F.col("scope"))
    solid = F.col("state") == RESOLVED
    known = F.when(solid, F.coalesce("target_known", F.lit(False))).otherwise(F.lit(False))
    unsure = F.when(solid, ~known).otherwise(F.coalesce(~F.col("scope_known"), F.lit(False)))
    refs = r.select(*own, "field", F.coalesce("idx", F.lit(0)).alias("idx"), "role", F.when(solid, F.col("target")).otherwise(loose).alias("item"), known.alias("known"), unsure.alias("unsure"), F.col("json").alias("opaque"), F.lit(None).cast("int").alias("size"))
    inside = subjects.filter("canonical_type = 'remote_command_parameter'").select(*by, "side", "owner_key", F.col("idx").alias("idx"), F.col("key").alias("target_key"))
    inside = inside.join(owners, [*by, "side", "owner_key"]).join(end("target"), [*by, "side", "target_key"])
    inside = inside.select(*own, F.lit("parameters").alias("field"), "idx", F.concat(F.lit("parameters["), F.col("idx").cast("string"), F.lit("]")).alias("role"), F.col("target").alias("item"), F.col("target_known").alias("known"), (~F.col("target_known")).alias("unsure"), F.lit(None).cast("string").alias("opaque"), F.lit(None).cast("int").alias("size"))
    there = subjects.filter("key is not null").select(*by, "side", F.col("key").alias("owner_key"), F.explode("roles").alias("field", "size")).join(owners, [*by, "side", "owner_key"])
    there = there.select(*own, "field", F.lit(None).cast("int").alias("idx"), F.col("field").alias("role"), F.lit(None).cast("string").alias("item"), F.lit(True).alias("known"), F.lit(False).alias("unsure"), F.lit(None).cast("string").alias("opaque"), "size")
    return _union(refs, inside, there)


def role_changes(items: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Relationship changes: (by, old_key, new_key, canonical_type, field, kind, category, before, after, added, removed, order_changed,
    presence_changed), lists in their order but for standards, added and removed with multiplicity; and property changes of the metadata of
    references: (by, old_key, new_key, canonical_type, field, before, after)."""
    role = [*by, "old_key", "new_key", "canonical_type", "field"]
    side = lambda s: F.col("side") == s
    place = F.when(F.col("field") == "standards", 0).otherwise(F.col("idx"))
    ends = lambda s: F.transform(F.array_sort(F.collect_list(F.when(side(s) & F.col("idx").isNotNull(), F.struct(place, F.col("item").alias("item"))))), lambda x: x["item"]).alias(f"{s}_items")
    position = F.when(F.col("field") == "standards", F.col("item")).otherwise(F.col("idx").cast("string"))
    note = T.json_object(position=position, extensions=F.col("opaque"), metadata=F.lit("{}"))
    notes = lambda s: T.json_list(F.transform(F.array_sort(F.collect_list(F.when(side(s) & F.col("opaque").isNotNull(), F.struct(place, note.alias("note"))))), lambda x: x["note"])).alias(f"{s}_notes")
    size = lambda s: F.max(F.when(side(s) & F.col("idx").isNull(), F.col("size"))).alias(f"{s}_size")
    g = items.groupBy(*role).agg(ends("old"), ends("new"), notes("old"), notes("new"), size("old"), size("new"), F.bool_and("known").alias("certain"))
    value = lambda s: F.when(F.col(f"{s}_size").isNull() & (F.size(f"{s}_items") == 0), None).when(F.coalesce(f"{s}_size", F.lit(0)) < 0, F.get(F.col(f"{s}_items"), F.lit(0))).otherwise(T.json_list(F.col(f"{s}_items")))
    g = g.withColumn("before", value("old")).withColumn("after", value("new"))
    same = F.array_sort("old_items").eqNullSafe(F.array_sort("new_items"))
    changed = g.filter(~F.col("before").eqNullSafe(F.col("after"))).withColumn("order_changed", same & (F.col("old_items") != F.col("new_items"))).withColumn("presence_changed", F.col("before").isNull() != F.col("after").isNull())
    kind = diff.role_kind(F.col("field"), F.col("canonical_type"), F.size("old_items"), F.size("new_items"))
    changed = changed.withColumn("kind", kind).withColumn("category", F.when(F.col("certain"), diff.INTERFACE).otherwise(diff.UNKNOWN))
    # Multiset differences by counting each end, so that long lists cost no more than their length.
    count = changed.select(*role, F.explode(F.concat(F.transform("old_items", lambda x: F.struct(x.alias("item"), F.lit(-1).alias("n"))), F.transform("new_items", lambda x: F.struct(x.alias("item"), F.lit(1).alias("n"))))).alias("x"))
    count = count.groupBy(*role, F.col("x.item").alias("item")).agg(F.sum("x.n").cast("int").alias("n"))
    more = lambda n: F.flatten(F.transform(F.array_sort(F.collect_list(F.when(n > 0, F.struct("item", n.alias("n"))))), lambda x: F.array_repeat(x["item"], x["n"])))
    delta = count.groupBy(*role).agg(more(F.col("n")).alias("added"), more(-F.col("n")).alias("removed"))
    columns = [*role, "kind", "category", "before", "after", "added", "removed", "order_changed", "presence_changed"]
    empty = F.array().cast("array<string>")
    changed = changed.join(delta, role, "left").withColumn("added", F.coalesce("added", empty)).withColumn("removed", F.coalesce("removed", empty)).select(*columns)
    metadata = g.filter("old_notes <> new_notes").select(*role[:-1], F.concat("field", F.lit(".metadata")).alias("field"), F.col("old_notes").alias("before"), F.col("new_notes").alias("after"))
    return changed, metadata


def property_changes(subjects: DataFrame, matching: Matching, metadata: DataFrame) -> DataFrame:
    """(by, old_key, new_key, canonical_type, field, kind, category, before, after): fields whose JSON differs."""
    by = matching.by
    wkn = F.struct("wkn_value", "wkn_authority", "wkn_scope", "wkn_status")
    half = lambda s: subjects.filter(F.col("side") == s).select(*by, F.col("key").alias(f"{s}_key"), F.col("canonical_type").alias(f"{s}_type"), F.col("fields").alias(f"{s}_fields"), wkn.alias(f"{s}_wkn"))
    old, new = half("old"), half("new")
    pairs = matching.matches.select(*by, "old_key", "new_key").join(old, [*by, "old_key"]).join(new, [*by, "new_key"])
    alone = old.filter("old_key is null").withColumnRenamed("old_type", "type").join(new.filter("new_key is null").withColumnRenamed("new_type", "type"), [*by, "type"])
    alone = alone.withColumn("old_type", F.col("type")).withColumn("new_type", F.col("type")).select(*pairs.columns)
    both = pairs.unionByName(alone)
    names = F.array_sort(F.array_union(F.map_keys("old_fields"), F.map_keys("new_fields")))
    differing = F.filter(names, lambda n: ~F.col("old_fields")[n].eqNullSafe(F.col("new_fields")[n]))
    rows = both.select(*by, "old_key", "new_key", F.col("new_type").alias("canonical_type"), "old_fields", "new_fields", "old_wkn", "new_wkn", F.explode(differing).alias("field"))
    o, n = F.col("old_wkn"), F.col("new_wkn")
    trust = (F.col("field") == "wkn") & o["wkn_value"].isNotNull() & (o["wkn_value"] == n["wkn_value"]) & o["wkn_authority"].eqNullSafe(n["wkn_authority"]) & o["wkn_scope"].eqNullSafe(n["wkn_scope"]) & ~o["wkn_status"].eqNullSafe(n["wkn_status"])
    rows = rows.select(*by, "old_key", "new_key", "canonical_type", "field", F.col("old_fields")[F.col("field")].alias("before"), F.col("new_fields")[F.col("field")].alias("after"), F.coalesce(trust, F.lit(False)).alias("trust"))
    rows = diff.classified(rows.unionByName(metadata.withColumn("trust", F.lit(False))))
    rows = rows.withColumn("kind", F.when(F.col("trust"), "IDENTITY_EVIDENCE_CHANGED").otherwise(F.col("kind"))).withColumn("category", F.when(F.col("trust"), diff.UNKNOWN).otherwise(F.col("category")))
    return rows.select(*by, "old_key", "new_key", "canonical_type", "field", "kind", "category", "before", "after")


def issues(subjects: DataFrame, relationships: DataFrame, matching: Matching, unmatched: DataFrame, items: DataFrame) -> DataFrame:
    """(by, side, kind, canonical_type, key, field, detail): all that keeps a comparison from being complete, on every owner, changed or not."""
    by, none = matching.by, F.lit(None).cast("string")

    def issue(rows: DataFrame, kind: str, key, field, detail) -> DataFrame:
        return rows.select(*by, "side", F.lit(kind).alias("kind"), "canonical_type", key.alias("key"), field.alias("field"), detail.alias("detail"))

    unsure = unmatched.filter("kind = 'INSUFFICIENT_IDENTITY'").withColumn("detail", F.when(F.col("reason") == "NO_COUNTERPART", OTHER_UNSURE).otherwise(F.col("reason")))
    dark = subjects.select(*by, "side", "canonical_type", "key", F.explode("opaque").alias("name"))
    shapes = dark.filter(F.col("name").isin("structure", "value_format")).join(matching.sides().select(*by, "side", "key"), [*by, "side", "key"], "left_semi")
    owners = subjects.filter("key is not null").select(*by, "side", F.col("key").alias("owner_key"), F.col("canonical_type").alias("canonical_type"))
    owned = with_optional(relationships, "json").drop("canonical_type").join(owners, [*by, "side", "owner_key"])
    return _union(
        issue(items.filter("unsure"), "UNCERTAIN_TARGET_IDENTITY", F.col("owner_key"), F.col("role"), F.lit(UNSURE_TARGET)),
        issue(unsure, "INSUFFICIENT_IDENTITY", F.col("key"), none, F.col("detail")),
        issue(matching.members.filter("outcome = 'ambiguous'"), "AMBIGUOUS_IDENTITY", F.col("key"), none, F.array_join("reasons", ",")),
        issue(dark, "UNKNOWN_CONTENT", F.col("key"), F.col("name"), F.lit(OPAQUE)),
        issue(shapes, "UNKNOWN_CONTENT", F.col("key"), F.col("name"), F.lit(OPAQUE_SHAPE)),
        issue(owned.filter("json is not null"), "UNKNOWN_CONTENT", F.col("owner_key"), F.col("role"), F.lit(OPAQUE_REFERENCE)),
        issue(owned.filter(F.col("state") != RESOLVED), "UNRESOLVED_REFERENCE", F.col("owner_key"), F.col("role"), F.lit(NO_TARGET)),
    ).distinct()


@dataclass
class ChangeSet:
    """All tables of a comparison; `by` tells the pairs apart. unmatched has the kind of each: added, removed, or not to be told."""

    by: list[str]
    subjects: DataFrame
    relationships: DataFrame
    matching: Matching
    unmatched: DataFrame
    properties: DataFrame
    roles: DataFrame
    issues: DataFrame

    @cached_property
    def entity_changes(self) -> DataFrame:
        """(by, kind, canonical_type, old_key, new_key, kinds, categories): one row for every changed entity."""
        ends, by = ["canonical_type", "old_key", "new_key"], self.by
        none = F.array().cast("array<string>")
        extra = F.when(F.col("category") == diff.INTERFACE, F.concat(F.when(F.size("added") > 0, F.array(F.lit("RELATIONSHIP_ADDED"))).otherwise(none), F.when(F.size("removed") > 0, F.array(F.lit("RELATIONSHIP_REMOVED"))).otherwise(none))).otherwise(none)
        parts = self.properties.select(*by, *ends, F.array("kind").alias("kinds"), "category").unionByName(self.roles.select(*by, *ends, F.concat(F.array("kind"), extra).alias("kinds"), "category"))
        told = lambda c: F.array_sort(F.array_distinct(c))
        changed = parts.groupBy(*by, *ends).agg(told(F.concat(F.array(F.lit("ENTITY_MODIFIED")), F.flatten(F.collect_set("kinds")))).alias("kinds"), F.array_sort(F.collect_set("category")).alias("categories"))
        gone = self.unmatched.filter("kind <> 'INSUFFICIENT_IDENTITY'")
        domain = diff._lookup(F.col("canonical_type"), diff.DOMAIN_KINDS, F.col("kind"))
        at = lambda s: F.when(F.col("side") == s, F.col("key")).alias(f"{s}_key")
        gone = gone.select(*by, "kind", "canonical_type", at("old"), at("new"), told(F.array("kind", domain)).alias("kinds"), F.array(F.lit(diff.INTERFACE)).alias("categories"))
        return changed.withColumn("kind", F.lit("ENTITY_MODIFIED")).select(*gone.columns).unionByName(gone)

    @cached_property
    def summary(self) -> DataFrame:
        """One row a pair: matched, changed_entities, added, removed, changes, interface_changes, documentation_changes, unknown_changes,
        unresolved, is_complete, has_interface_changes, has_documentation_changes."""
        rows = _union(
            self.subjects.select(*self.by).distinct().withColumn("what", F.lit("pair")),
            self.matching.matches.select(*self.by, F.lit("matched").alias("what")),
            self.entity_changes.select(*self.by, F.concat(F.lit("changed "), F.col("kind")).alias("what")),
            _union(*[t.select(*self.by, "category") for t in (self.properties, self.roles)]).select(*self.by, F.col("category").alias("what")),
            self.issues.select(*self.by, F.lit("issue").alias("what")),
        )
        n = lambda c: F.count_if(c)
        what = F.col("what")
        definite = what.isin("changed ENTITY_ADDED", "changed ENTITY_REMOVED")
        return rows.groupBy(*self.by).agg(
            n(what == "matched").alias("matched"), n(what.startswith("changed ")).alias("changed_entities"), n(what == "changed ENTITY_ADDED").alias("added"), n(what == "changed ENTITY_REMOVED").alias("removed"),
            n(what.endswith("_CHANGE") | definite).alias("changes"), n((what == diff.INTERFACE) | definite).alias("interface_changes"), n(what == diff.DOCUMENTATION).alias("documentation_changes"),
            n(what == diff.UNKNOWN).alias("unknown_changes"), n(what == "issue").alias("unresolved"), ((n(what == "issue") == 0) & (n(what == diff.UNKNOWN) == 0)).alias("is_complete"),
            (n((what == diff.INTERFACE) | definite) > 0).alias("has_interface_changes"), (n(what == diff.DOCUMENTATION) > 0).alias("has_documentation_changes"),
        )

    def proofs(self) -> DataFrame:
        """Dependency proofs of the changed entities, for each side on its own graph."""
        side = lambda s: self.entity_changes.filter(F.col(f"{s}_key").isNotNull()).select(*self.by, F.lit(s).alias("side"), F.col(f"{s}_key").alias("subject"))
        subjects = side("old").unionByName(side("new")).distinct()
        return graph.dependencies(self.relationships, self.subjects.filter("key is not null"), [*self.by, "side"], subjects)

    def contexts(self) -> DataFrame:
        """(by, side, subject, statements, dependencies): what depends on each changed entity, in words and with evidence."""
        by = [*self.by, "side"]
        proofs = cut(self.proofs(), "proofs")
        graph.check_paths(proofs, by)
        one = F.struct("kind", "entity_key", "entity_type", "evidence")
        listed = graph.contexts(proofs, by).groupBy(*by, "subject").agg(F.array_sort(F.collect_list(one)).alias("dependencies"))
        side = lambda s: self.entity_changes.select(*self.by, F.lit(s).alias("side"), F.col(f"{s}_key").alias("subject"), "canonical_type", "kind").filter(F.col("subject").isNotNull())
        named = side("old").unionByName(side("new")).drop("kind").distinct()
        said = named.join(graph.statements(proofs, by), [*by, "subject"], "left").join(listed, [*by, "subject"], "left")
        words = F.coalesce("statements", F.array(F.lit(graph.NO_DEPENDENCIES)))
        return said.withColumn("statements", words)


def compare_interfaces(subjects: DataFrame, relationships: DataFrame, by: list[str]) -> ChangeSet:
    """subjects and resolved relationships of both versions, with `by` and `side` (old or new)."""
    subjects = with_optional(subjects, "implementation_id", "name", "designation", "stream", "function", "wkn_value", "wkn_authority", "wkn_scope", "wkn_status", "owner_key")
    if "idx" not in subjects.columns:
        subjects = subjects.withColumn("idx", F.lit(None).cast("int"))
    entities = subjects.filter("key is not null")
    matching = match_interfaces(entities, relationships, by)
    unmatched = cut(diff.certain(matching.unmatched, matching.members.filter("outcome = 'ambiguous'"), by), "certain")
    idents = cut(identities(subjects, matching, unmatched), "identities")
    items = cut(role_items(subjects, relationships, matching, idents), "items")
    roles, metadata = role_changes(items, by)
    roles = cut(roles, "roles")
    properties = cut(property_changes(subjects, matching, metadata), "properties")
    return ChangeSet(by, subjects, relationships, matching, unmatched, properties, roles, cut(issues(subjects, relationships, matching, unmatched, items), "issues"))


def broken_rules(c: ChangeSet) -> DataFrame:
    """(rule, detail) of change records that contradict themselves; must be empty."""
    text = lambda rows, rule: rows.select(F.lit(rule).alias("rule"), F.to_json(F.struct("*")).alias("detail"))
    equal = F.col("before").eqNullSafe(F.col("after"))
    e = c.entity_changes
    presence = F.when(F.col("kind") == "ENTITY_ADDED", F.col("old_key").isNull() & F.col("new_key").isNotNull()).when(F.col("kind") == "ENTITY_REMOVED", F.col("old_key").isNotNull() & F.col("new_key").isNull())
    presence = presence.otherwise((F.col("kind") == "ENTITY_MODIFIED") & (F.col("old_key").isNull() == F.col("new_key").isNull()))
    m = c.matching.matches
    own = F.forall("evidence", lambda x: (x["old_keys"] == F.array("old_key")) & (x["new_keys"] == F.array("new_key")) | (F.size(x["old_keys"]) + F.size(x["new_keys"]) < 2))
    return _union(
        text(c.properties.filter(equal | (F.col("field") == "")), "property values are distinct"), text(c.roles.filter(equal | (F.col("field") == "")), "role values are distinct"),
        text(e.filter(~presence), "presence fits the kind"), text(m.filter(F.col("strategy").isNull() | (F.size("evidence") == 0) | ~own), "evidence is the pair's own"),
        text(c.matching.ambiguous.filter((F.size("old_keys") + F.size("new_keys") < 2) | (F.size("reasons") == 0)), "ambiguity has members and reasons"),
    )

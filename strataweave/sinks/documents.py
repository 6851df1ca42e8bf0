"""Documents made of a comparison or an interface: canonical JSON, the report (schema 2.0), views for people.

Rows become JSON texts on the executors and are put in order there. A document is one text and has a ceiling of characters, which an
aggregation checks before anything reaches the driver; beyond it the document fails and is never cut.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..engine import Interface
from ..errors import ReportError, ResourceLimitError
from ..functions import text as T
from ..operators import diff
from ..operators.compare import ChangeSet, _wkn
from ..operators.resolve import with_optional
from ..sources.dictionary import TYPES
from ..storage import cut, drop
from . import reports

VERSION = "0.2.0"
REPORT_SCHEMA, CHANGE_SCHEMA, MODEL_SCHEMA, COMPARISON_SCHEMA, EXPLORATION_SCHEMA, INSPECTION_SCHEMA = "2.0", "1.0", "1.0", "2.0", "1.0", "2.0"
PENDING = "REFERENCE_RESOLUTION_PENDING"


def _texts(rows: DataFrame, column: str = "json", order: Iterable[Column] = ()) -> list[str]:
    """The JSON texts of a column in order (of `order`, then of themselves), after the check of their size."""
    texts = cut(rows.select(F.struct(F.lit(0), *order).alias("o"), F.col(column).alias("t")), "texts")
    size = texts.agg(F.coalesce(F.sum(F.length("t") + 1), F.lit(0))).first()[0]
    if size > reports.CEILING:
        raise ResourceLimitError(f"the rows have {size} characters, more than {reports.CEILING}")
    out = [r.t for r in texts.orderBy("o", "t").select("t").collect()]
    drop(texts)
    return out


def bounded(text: str) -> str:
    if len(text) > reports.CEILING:
        raise ResourceLimitError(f"the document has {len(text)} characters, more than {reports.CEILING}")
    return text


def dump(value) -> str:
    return bounded(json.dumps(value, sort_keys=True, ensure_ascii=False, allow_nan=False, separators=(",", ":")))


def _strings(items: Column) -> Column:
    return T.json_list(F.transform(items, lambda x: T.json_text(x)))


def _text(name: str) -> Column:
    return T.json_text(F.col(name))


def _place(identifier: Column) -> Column:
    """Provenance of a row, as a list of one."""
    at = T.json_object(source_document=_text("doc_id"), source_path=_text("path"), path_kind=F.lit('"expanded_name_path"'), source_identifier=T.json_text(identifier), line=F.col("line").cast("string"), column=F.col("col").cast("string"))
    return F.concat(F.lit("["), at, F.lit("]"))


def entity_rows(subjects: DataFrame, relationships: DataFrame, by: list[str]) -> DataFrame:
    """(by, canonical_type, key, json): each subject with all its fields, references and provenance."""
    r = with_optional(relationships, "scope_key", "wkn_value", "wkn_authority", "wkn_scope", "wkn_status", "json")
    one = T.json_object(canonical_type=F.lit('"entity_reference"'), implementation_id=_text("implementation_id"), name=_text("name"), wkn=_wkn(), scope_key=_text("scope_key"), target_key=_text("target_key"), target_types=_strings(F.array_sort("target_types")), unknown_extensions=F.coalesce("json", F.lit("[]")), provenance=_place(F.col("implementation_id")))
    lists = r.groupBy(*by, F.col("owner_key").alias("key"), "field").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("idx", F.lit(0)).alias("idx"), one.alias("json")))), lambda x: x["json"]).alias("items"))
    maps = lists.groupBy(*by, "key").agg(F.map_from_entries(F.collect_list(F.struct("field", "items"))).alias("ends"))
    s = subjects.join(maps, [*by, "key"], "left")
    none = F.array().cast("array<string>")
    items = lambda field: F.coalesce(F.col("ends")[field], none)
    roles = F.transform(F.map_entries("roles"), lambda e: F.struct(e["key"].alias("key"), F.when(e["value"] < 0, F.get(items(e["key"]), F.lit(0))).otherwise(T.json_list(items(e["key"]))).alias("value")))
    roles = F.filter(roles, lambda e: e["key"] != "parameters")
    own = F.map_from_entries(F.array(F.struct(F.lit("canonical_type"), _text("canonical_type")), F.struct(F.lit("key"), _text("key")), F.struct(F.lit("owner_key"), _text("owner_key")), F.struct(F.lit("provenance"), _place(F.col("implementation_id")))))
    whole = F.map_concat(F.map_filter("fields", lambda k, _: ~k.isin("canonical_type", "key", "owner_key", "provenance")), own, F.map_from_entries(roles))
    return s.select(*by, "canonical_type", "key", T.json_members(whole).alias("json"))


def canonical_json(interface: Interface, doc_id: str) -> str:
    """One document's model: every subject, inventories in order of their JSON text, the ledger of unresolved references. No final newline."""
    rows = entity_rows(interface.subjects.filter(F.col("doc_id") == doc_id), interface.relationships.filter(F.col("doc_id") == doc_id), ["doc_id"])
    ledger = relationship_rows(interface.unresolved.filter(F.col("doc_id") == doc_id))
    entities = [json.loads(t) for t in _texts(rows)]
    kinds = {t: [e for e in entities if e["canonical_type"] == t] for t in ("equipment_metadata", "equipment_interface", *TYPES)}
    whole = {"model_schema_version": MODEL_SCHEMA, "equipment": kinds.pop("equipment_metadata")[0], "interface": kinds.pop("equipment_interface")[0], "entities": kinds, "unresolved_references": [json.loads(t) for t in _texts(ledger)]}
    return dump(whole)


def relationship_rows(relationships: DataFrame, *extra: str) -> DataFrame:
    """relationships plus json: outcome and selector of each."""
    r = with_optional(relationships, "scope_key", "wkn_value", "wkn_authority", "wkn_scope", "wkn_status", "json").withColumn("__opaque", F.col("json"))
    selector = T.json_object(implementation_id=_text("implementation_id"), name=_text("name"), wkn=_wkn(), scope_key=_text("scope_key"), target_types=_strings(F.array_sort("target_types")), unknown_extensions=F.coalesce("__opaque", F.lit("[]")), provenance=_place(F.col("implementation_id")))
    members = {"owner_key": _text("owner_key"), "role": _text("role"), "state": T.json_text(F.lower("state")), "reason": T.json_text(F.lower("reason")), "target_key": _text("target_key"), "candidate_keys": _strings(F.col("candidate_keys")), "selector": selector}
    members |= {name: F.col(name) for name in extra}
    return r.withColumn("json", T.json_object(**members)).drop("__opaque")


def diagnostic_rows(diagnostics: DataFrame) -> DataFrame:
    """diagnostics plus json, without what is provisional."""
    d = diagnostics.filter(F.col("code") != PENDING)
    about = T.json_object(canonical_type=_text("canonical_type"), key=_text("owner_key"))
    where = T.json_object(source_document=_text("doc_id"), source_path=_text("path"), line=F.col("line").cast("string"), column=F.col("col").cast("string"))
    return d.withColumn("json", T.json_object(code=_text("code"), message=_text("message"), severity=_text("severity"), provenance=where, source=_text("doc_id"), source_line=F.col("line").cast("string"), entity_context=about))


class Report:
    """The texts of one pair's comparison, each section a list of JSON texts in order."""

    def __init__(self, changes: ChangeSet, pair: str = "0"):
        self.all, self.by = changes, changes.by
        self.pair = pair
        self.subjects = self._own(changes.subjects)

    def _own(self, rows: DataFrame) -> DataFrame:
        return rows.filter(F.col("pair") == self.pair)

    def _identity(self, side: str) -> DataFrame:
        known = T.json_object(key=_text("key"), implementation_id=_text("implementation_id"), name=_text("name"), wkn=_wkn())
        return self.subjects.filter(F.col("side") == side).select("canonical_type", F.coalesce("key", F.lit("")).alias(f"{side}_id"), known.alias(f"source_{side}"), F.col("implementation_id").alias(f"{side}_native"), F.col("name").alias(f"{side}_name"))

    def with_subject(self, rows: DataFrame, absent: Column | None = None) -> DataFrame:
        """rows of (canonical_type, old_key, new_key) plus subject, the JSON of both sides' identities; a side that is absent is null."""
        gone = F.lit(False) if absent is None else absent
        rows = rows.withColumn("__alone", gone)
        for side in ("old", "new"):
            rows = rows.withColumn(f"{side}_id", F.when(F.col("__alone") & F.col(f"{side}_key").isNull(), None).otherwise(F.coalesce(f"{side}_key", F.lit("")))).join(self._identity(side), ["canonical_type", f"{side}_id"], "left")
        return rows.withColumn("subject", T.json_object(entity_type=_text("canonical_type"), source_a=F.col("source_old"), source_b=F.col("source_new"))).drop("__alone", "old_id", "new_id")

    @staticmethod
    def _evidence() -> Column:
        return T.json_list(F.transform("evidence", lambda e: T.json_object(strategy=T.json_text(e["strategy"]), entity_type=T.json_text(e["entity_type"]), identity=e["identity"], source_a_keys=_strings(e["old_keys"]), source_b_keys=_strings(e["new_keys"]))))

    def matches(self) -> DataFrame:
        m = self.with_subject(self._own(self.all.matching.matches))
        return m.withColumn("json", T.json_object(subject=F.col("subject"), strategy=_text("strategy"), confidence=_text("confidence"), evidence=self._evidence()))

    def _definite(self) -> DataFrame:
        changed = self._own(self.all.entity_changes).filter("kind <> 'ENTITY_MODIFIED'")
        whole = entity_rows(self.subjects, self._own(self.all.relationships), [*self.by, "side"])
        side = F.when(F.col("kind") == "ENTITY_REMOVED", "old").otherwise("new")
        found = changed.withColumn("side", side).withColumn("key", F.coalesce("old_key", "new_key")).join(whole.select("side", "key", "json"), ["side", "key"])
        return self.with_subject(found, F.lit(True))

    def changes(self) -> DataFrame:
        """One row a change: code, category, scope, subject, field, before, after, and what a role gained and lost."""
        code = diff.change_code(F.col("canonical_type"), F.col("kind"))

        def row(rows: DataFrame, scope: str, field: Column, before: Column, after: Column, delta: Column) -> DataFrame:
            members = T.json_object(change_id=T.json_text(code), category=_text("category"), scope=F.lit(f'"{scope}"'), subject=F.col("subject"), field=field, before=before, after=after, relationship_delta=delta)
            return rows.select(members.alias("json"), "category", "canonical_type", "old_key", "new_key")

        none = F.lit("null")
        gone = self._definite().withColumn("category", F.lit(diff.INTERFACE))
        at = lambda kind: F.when(F.col("kind") == kind, F.col("json")).otherwise("null")
        delta = T.json_object(added=T.json_list(F.col("added")), removed=T.json_list(F.col("removed")), order_changed=F.col("order_changed").cast("string"), presence_changed=F.col("presence_changed").cast("string"))
        both = (row(self.with_subject(self._own(rows)), scope, _text("field"), F.col("before"), F.col("after"), d) for rows, scope, d in ((self.all.properties, "property", none), (self.all.roles, "relationship", delta)))
        return reduce(DataFrame.unionByName, both, row(gone, "entity", none, at("ENTITY_REMOVED"), at("ENTITY_ADDED"), none))

    def context_json(self) -> DataFrame:
        """(side, subject_key, context) of every changed entity, and the words for changes outside the graph."""
        edge = lambda e: T.json_object(owner_key=T.json_text(e["owner_key"]), role=T.json_text(e["role"]), target_key=T.json_text(e["target_key"]))
        proof = lambda edges: T.json_object(edges=T.json_list(F.transform(edges, edge)))
        one = lambda d: T.json_object(kind=T.json_text(d["kind"]), entity_key=T.json_text(d["entity_key"]), entity_type=T.json_text(d["entity_type"]), evidence=T.json_list(F.transform(d["evidence"], proof)))
        excluded = self._own(self.all.relationships).groupBy("side").agg(F.count_if(F.col("state") != "RESOLVED").cast("string").alias("excluded"))
        c = self._own(self.all.contexts()).join(F.broadcast(excluded), "side", "left")
        listed = F.coalesce(T.json_list(F.transform("dependencies", one)), F.lit("[]"))
        context = T.json_object(subject_key=_text("subject"), subject_type=_text("canonical_type"), statements=_strings(F.col("statements")), dependencies=listed, excluded_unresolved_graph_relationships=F.coalesce("excluded", F.lit("0")))
        return c.select("side", F.col("subject").alias("subject_key"), context.alias("context"))

    def contexts(self) -> DataFrame:
        e = self.with_subject(self._own(self.all.entity_changes), F.col("kind") != "ENTITY_MODIFIED")
        found = self.context_json()
        from ..operators.graph import NOT_IN_GRAPH

        outside = T.json_object(subject_key=F.lit("null"), subject_type=_text("canonical_type"), statements=F.lit(dump([NOT_IN_GRAPH])), dependencies=F.lit("[]"), excluded_unresolved_graph_relationships=F.lit("0"))
        for side in ("old", "new"):
            own = found.filter(F.col("side") == side).select(F.col("subject_key").alias(f"{side}_key"), F.col("context").alias(f"{side}_context"))
            e = e.join(own, f"{side}_key", "left")
            e = e.withColumn(f"{side}_context", F.when(F.col("old_key").isNull() & F.col("new_key").isNull(), outside).otherwise(F.col(f"{side}_context")))
        return e.withColumn("json", T.json_object(subject=F.col("subject"), source_a=F.col("old_context"), source_b=F.col("new_context")))

    def unresolved(self) -> DataFrame:
        groups = self._own(self.all.matching.ambiguous)
        detail = T.json_object(reasons=_strings(F.col("reasons")), evidence=self._evidence(), source_a_keys=_strings(F.col("old_keys")), source_b_keys=_strings(F.col("new_keys")))
        sides = [groups.select(F.lit(s).alias("side"), F.explode(f"{s}_keys").alias("key"), detail.alias("identity")) for s in ("old", "new")]
        rows = self._own(self.all.issues).join(reduce(DataFrame.unionByName, sides), ["side", "key"], "left")
        source = F.when(F.col("side") == "old", '"a"').otherwise('"b"')
        return rows.withColumn("json", T.json_object(issue_code=_text("kind"), source=source, entity_type=_text("canonical_type"), entity_key=_text("key"), field=_text("field"), detail=_text("detail"), identity_ambiguity=F.col("identity")))

    def summary(self) -> dict:
        row = self._own(self.all.summary).first()
        if row is None:
            raise ReportError(f"there is no pair {self.pair!r}")
        return {k: v for k, v in row.asDict().items() if k != "pair"}


def source(path: str, revision: str) -> dict:
    if not path or not revision:
        raise ReportError("a source has a path and a revision")
    return {"path": path, "revision": revision}


def report(changes: ChangeSet, source_a: dict, source_b: dict, diagnostics_a: DataFrame | None = None, diagnostics_b: DataFrame | None = None, pair: str = "0") -> dict:
    """The report document, schema 2.0."""
    r = Report(changes, pair)
    parsed = lambda rows: [json.loads(t) for t in _texts(rows)]
    found = []
    for side, rows, src in (("a", diagnostics_a, source_a), ("b", diagnostics_b, source_b)):
        for d in [] if rows is None else parsed(diagnostic_rows(rows)):
            found.append({"source": side, "code": d["code"], "severity": d["severity"].upper(), "message": d["message"], "provenance": d["provenance"], "source_path": d["source"] or src["path"], "source_line": d["source_line"], "entity_context": d["entity_context"]})
    s = r.summary()
    kept = ("is_complete", "matched", "changed_entities", "added", "removed", "changes", "interface_changes", "documentation_changes", "unknown_changes", "unresolved")
    return {
        "report_schema_version": REPORT_SCHEMA, "tool_version": VERSION, "source_a": source(**source_a), "source_b": source(**source_b), "summary": {k: s[k] for k in kept} | {"diagnostics": len(found)},
        "matches": parsed(r.matches()), "changes": parsed(r.changes()), "dependency_context": parsed(r.contexts()), "unresolved": parsed(r.unresolved()), "diagnostics": sorted(found, key=dump),
    }


def report_json(document: dict) -> str:
    return dump(document) + "\n"


def change_set(changes: ChangeSet, pair: str = "0") -> dict:
    """The comparison as data, schema 1.0, with what each kind and category of change says."""
    r = Report(changes, pair)
    s = r.summary()
    whole = {"entity_changes": [json.loads(t) for t in _texts(changed_rows(r), order=_by_subject())], "matches": [json.loads(t) for t in _texts(r.matches())], "issues": [json.loads(t) for t in _texts(r.unresolved())]}
    return {"change_schema_version": CHANGE_SCHEMA, "is_complete": s["is_complete"], "has_interface_changes": s["has_interface_changes"], "has_documentation_changes": s["has_documentation_changes"], "change_set": whole}


def _by_subject() -> list[Column]:
    return [F.col("canonical_type"), F.coalesce("old_key", F.lit("")), F.coalesce("new_key", F.lit("")), F.col("kind")]


def changed_rows(r: Report, include_documentation: bool = True) -> DataFrame:
    """Changed entities with their property and role changes as one JSON text; entities of which nothing is left are left out."""
    ends = ["canonical_type", "old_key", "new_key"]
    value = {"field": _text("field"), "kind": _text("kind"), "category": _text("category"), "old_value": F.col("before"), "new_value": F.col("after")}
    delta = {"added": T.json_list(F.col("added")), "removed": T.json_list(F.col("removed")), "order_changed": F.col("order_changed").cast("string"), "presence_changed": F.col("presence_changed").cast("string")}
    shown = F.lit(True) if include_documentation else F.col("category") != diff.DOCUMENTATION

    def listed(rows: DataFrame, name: str, **members: Column) -> DataFrame:
        one = rows.filter(shown).select(*[F.coalesce(c, F.lit("")).alias(c) for c in ends], "field", T.json_object(**members).alias("json"))
        return one.groupBy(*ends).agg(T.json_list(F.transform(F.array_sort(F.collect_list(F.struct("field", "json"))), lambda x: x["json"])).alias(name))

    changed = r.with_subject(r._own(r.all.entity_changes), F.col("kind") != "ENTITY_MODIFIED")
    keyed = changed.withColumns({f"__{c}": F.col(c) for c in ends}).withColumns({c: F.coalesce(c, F.lit("")) for c in ends})
    keyed = keyed.join(listed(r._own(r.all.properties), "properties", **value), ends, "left").join(listed(r._own(r.all.roles), "relationships", **value, **delta), ends, "left")
    keyed = keyed.withColumns({c: F.col(f"__{c}") for c in ends}).drop(*[f"__{c}" for c in ends])
    keyed = keyed.filter((F.col("kind") != "ENTITY_MODIFIED") | F.col("properties").isNotNull() | F.col("relationships").isNotNull())
    # Without documentation the categories are those of what is left.
    categories = F.col("categories") if include_documentation else F.filter("categories", lambda c: (F.col("kind") != "ENTITY_MODIFIED") | (c != diff.DOCUMENTATION))
    whole = T.json_object(entity_type=_text("canonical_type"), kind=_text("kind"), subject=F.col("subject"), change_kinds=_strings(F.col("kinds")), categories=_strings(categories), properties=F.coalesce("properties", F.lit("[]")), relationships=F.coalesce("relationships", F.lit("[]")))
    return keyed.withColumn("categories", categories).withColumn("json", whole)


def report_schema() -> dict:
    """The JSON Schema of the report, built from its parts."""
    text, number, flag, anything = {"type": "string"}, {"type": "integer", "minimum": 0}, {"type": "boolean"}, {}
    named = {"type": "string", "minLength": 1}
    maybe = lambda s: {"anyOf": [s, {"type": "null"}]}
    listed = lambda s: {"type": "array", "items": s}
    record = lambda **p: {"type": "object", "additionalProperties": False, "required": sorted(p), "properties": p}
    ref = lambda name: {"$ref": f"#/$defs/{name}"}
    kinds = {"enum": ["equipment_interface", "equipment_metadata", *TYPES]}
    counts = ("matched", "changed_entities", "added", "removed", "changes", "interface_changes", "documentation_changes", "unknown_changes", "unresolved", "diagnostics")
    defs = {
        "source": record(path=named, revision=named),
        "summary": record(is_complete=flag, **dict.fromkeys(counts, number)),
        "wkn": record(value=maybe(text), authority=maybe(text), scope=maybe(text), authority_status={"enum": ["verified", "unverified"]}),
        "identity": record(key=maybe(text), implementation_id=maybe(text), name=maybe(text), wkn=maybe(ref("wkn"))),
        "subject": record(entity_type=kinds, source_a=maybe(ref("identity")), source_b=maybe(ref("identity"))),
        "evidence": record(strategy=text, entity_type=kinds, identity=listed(text), source_a_keys=listed(text), source_b_keys=listed(text)),
        "match": record(subject=ref("subject"), strategy=text, confidence={"enum": ["CORROBORATED", "VERIFIED_WKN", "EXACT_IDENTITY"]}, evidence=listed(ref("evidence"))),
        "delta": record(added=listed(anything), removed=listed(anything), order_changed=flag, presence_changed=flag),
        "change": record(change_id={"type": "string", "pattern": "^(" + "|".join(diff.PREFIXES.values()) + ")_[A-Z_]+$"}, category={"enum": [diff.INTERFACE, diff.DOCUMENTATION, diff.UNKNOWN]}, scope={"enum": ["entity", "property", "relationship"]}, subject=ref("subject"), field=maybe(text), before=anything, after=anything, relationship_delta=maybe(ref("delta"))),
        "context": record(subject_key=maybe(text), subject_type=kinds, statements=listed(text), dependencies=listed({"type": "object"}), excluded_unresolved_graph_relationships=number),
        "context_entry": record(subject=ref("subject"), source_a=maybe(ref("context")), source_b=maybe(ref("context"))),
        "unresolved_entry": record(issue_code=text, source={"enum": ["a", "b"]}, entity_type=maybe(kinds), entity_key=maybe(text), field=maybe(text), detail=text, identity_ambiguity=maybe({"type": "object"})),
        "diagnostic": record(source={"enum": ["a", "b"]}, code=named, severity={"enum": ["INFO", "WARNING", "ERROR"]}, message=text, provenance=maybe({"type": "object"}), source_path=text, source_line=maybe(number), entity_context=maybe({"type": "object"})),
    }
    top = record(report_schema_version={"const": REPORT_SCHEMA}, tool_version=named, source_a=ref("source"), source_b=ref("source"), summary=ref("summary"), matches=listed(ref("match")), changes=listed(ref("change")), dependency_context=listed(ref("context_entry")), unresolved=listed(ref("unresolved_entry")), diagnostics=listed(ref("diagnostic")))
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "title": "semantic comparison report 2.0", **top, "$defs": defs}

"""Comparisons of documents: one change at a time, noise that says nothing, uncertainty, and laws that hold for all."""

import random
import re

import pytest
from model import machine
from pyspark.sql import functions as F

from strataweave import engine
from strataweave.errors import AdapterRegistrationError, AmbiguousRevisionError, InputError, ModelValidationError, ResourceLimitError, UnsupportedRevisionError
from strataweave.operators import compare, graph, match, resolve, rules
from strataweave.plans.synthetic import document, element, measured, text
from strataweave.sources import paths, xml
from strataweave.sources.dictionary import DictionaryAdapter
from strataweave.sources.registry import Registry, check_support

EDITS = {
    "name": ({"name": "P2"}, {("status_variable", "NAME_CHANGED", "INTERFACE_CHANGE")}),
    "note": ({"note": "other"}, {("status_variable", "DESCRIPTION_CHANGED", "DOCUMENTATION_CHANGE")}),
    "unit": ({"unit": "kPa"}, {("status_variable", "UNIT_CHANGED", "INTERFACE_CHANGE")}),
    "low": ({"low": " 0"}, {("status_variable", "RANGE_CHANGED", "INTERFACE_CHANGE")}),
    "default": ({"default": "6"}, {("equipment_constant", "DEFAULT_CHANGED", "INTERFACE_CHANGE")}),
    "report": ({"report": ("1", "2")}, {("default_report", "REPORT_CONTENT_CHANGED", "INTERFACE_CHANGE")}),
    "order": ({"report": ("2", "1", "1")}, {("default_report", "REPORT_CONTENT_CHANGED", "INTERFACE_CHANGE")}),
    "alarm": ({"clear": "10"}, {("alarm", "ALARM_EVENT_LINK_CHANGED", "INTERFACE_CHANGE")}),
    "required": ({"required": "Conditional"}, {("remote_command_parameter", "COMMAND_PARAMETER_CHANGED", "INTERFACE_CHANGE")}),
    "items": ({"items": "<m:ASC/>"}, {("supported_message", "MESSAGE_STRUCTURE_CHANGED", "INTERFACE_CHANGE")}),
    "described": ({"items": "<m:ASC/><m:UI4 description='d'/>"}, {("supported_message", "DESCRIPTION_CHANGED", "DOCUMENTATION_CHANGE")}),
    "group note": ({"group_note": "later"}, {("standard_reference", "DOCUMENTATION_CHANGED", "DOCUMENTATION_CHANGE")}),
    "opaque": ({"extra": "<Odd/>"}, {("equipment_interface", "UNKNOWN_CHANGE", "UNKNOWN_CHANGE")}),
    "lost target": ({"clear": "12"}, {("alarm", "ALARM_EVENT_LINK_CHANGED", "UNKNOWN_CHANGE")}),
}


def shuffled(raw: bytes, seed: int) -> bytes:
    """The same document with its inventories in another order and indentation between sections."""
    rng = random.Random(seed)
    body = raw.decode()
    for section in ("CollectionEvents", "AssociatedParameters"):
        inner = re.search(rf"<{section}>(.*)</{section}>", body)[1]
        items = re.findall(r"<CollectionEvent>.*?</CollectionEvent>", inner) if section == "CollectionEvents" else []
        if items:
            rng.shuffle(items)
            body = body.replace(inner, "\n  ".join(items))
    return re.sub(r"(<(?:StatusVariables|Alarms|SECSMessages)>)", r"\n\t\1\n ", body).encode()


@pytest.fixture(scope="module")
def compared(spark):
    """All pairs in one comparison, forth and back."""
    docs = {"base": machine(), "noise": shuffled(machine(), 3), "link": machine(event="11"), "standard": machine(revision="E98"), "twice": machine().replace(b"<SVID>1</SVID>", b"<SVID>1</SVID>").replace(b"<VID>2</VID>", b"<VID>2</VID>", 1)}
    twin = element("DataVariable", text("VID", "2"), text("DVVALNAME", "Again"), text("Description", "Lot id"))
    docs["twice"] = machine().replace(b"</DataVariables>", twin.encode() + b"</DataVariables>")
    docs |= {name: machine(**change) for name, (change, _) in EDITS.items()}
    i = engine.from_files(spark.createDataFrame([(k, bytearray(v)) for k, v in docs.items()], "doc_id string, content binary").repartition(3))
    pairs = [(k, "base", k) for k in docs] + [("back " + k, k, "base") for k in docs]
    return engine.compare(i, i, spark.createDataFrame(pairs, "pair string, old_doc string, new_doc string"))


@pytest.fixture(scope="module")
def rows(compared):
    got = {}
    for table in ("properties", "roles"):
        for r in getattr(compared, table).collect():
            got.setdefault(r.pair, []).append(r)
    return got


def test_each_edit_is_one_change(rows):
    for name, (_, want) in EDITS.items():
        assert {(r.canonical_type, r.kind, r.category) for r in rows[name]} == want and len(rows[name]) == 1, name
        assert {(r.canonical_type, r.kind, r.category) for r in rows["back " + name]} == want, name
    assert [(r.order_changed, r.added, r.removed) for r in rows["order"]] == [(True, [], [])]
    assert [(r.order_changed, len(r.added), len(r.removed)) for r in rows["report"]] == [(False, 0, 1)]


def test_noise_says_nothing_and_summaries_agree(compared, rows):
    s = {r.pair: r for r in compared.summary.collect()}
    assert not rows.get("noise") and not rows.get("base") and s["noise"].is_complete and s["noise"].matched == 14 and s["noise"].changed_entities == 0
    for name in EDITS:
        a, b = s[name], s["back " + name]
        assert a.changes == b.changes == 1 and (a.interface_changes, a.documentation_changes, a.unknown_changes) == (b.interface_changes, b.documentation_changes, b.unknown_changes)
        assert a.is_complete == (name not in ("opaque", "lost target"))
    assert (s["link"].added, s["link"].removed, s["link"].is_complete) == (1, 1, True)
    assert (s["standard"].added, s["standard"].removed) == (1, 1)


def test_collisions_leave_a_type_uncertain(compared):
    members = {(r.side, r.canonical_type) for r in compared.matching.members.filter("pair = 'twice' and outcome = 'ambiguous'").collect()}
    assert members == {("old", "data_variable"), ("new", "data_variable")}
    group = compared.matching.ambiguous.filter("pair = 'twice'").first()
    assert group.reasons == ["IDENTITY_COLLISION"] and (len(group.old_keys), len(group.new_keys)) == (1, 2)
    issues = {(r.side, r.kind) for r in compared.issues.filter("pair = 'twice'").collect()}
    assert {("old", "AMBIGUOUS_IDENTITY"), ("new", "AMBIGUOUS_IDENTITY"), ("old", "UNCERTAIN_TARGET_IDENTITY"), ("new", "UNRESOLVED_REFERENCE")} <= issues


def test_kinds_of_whole_entities(compared):
    e = {(r.pair, r.kind, r.canonical_type): r for r in compared.entity_changes.filter("kind <> 'ENTITY_MODIFIED'").collect()}
    assert e["link", "ENTITY_ADDED", "event_report_link"].kinds == ["ENTITY_ADDED", "EVENT_REPORT_LINK_CHANGED"]
    assert e["standard", "ENTITY_REMOVED", "standard_reference"].categories == ["INTERFACE_CHANGE"]


def test_rules_hold_and_every_entity_has_an_outcome(compared):
    assert compare.broken_rules(compared).collect() == []
    assert match.uncovered(compared.subjects.filter("key is not null"), compared.matching).count() == 0
    assert resolve.violations(compared.relationships).count() == 0


def test_contexts_of_changes(compared):
    got = {(r.pair, r.side): r for r in compared.contexts().filter("pair = 'name'").collect()}
    assert got["name", "old"].statements == ["Referenced by 1 default report.", "Linked through containing reports to 1 collection event."]
    kinds = [(d.kind, d.entity_type, len(d.evidence), len(d.evidence[0])) for d in got["name", "new"].dependencies]
    assert kinds == [("EVENT_VIA_REPORT", "collection_event", 2, 3), ("REFERENCED_BY", "default_report", 2, 1)]


def test_verified_names_match_over_other_ids(spark):
    old, new = (engine.from_files(spark.createDataFrame([(n, bytearray(raw))], "doc_id string, content binary")) for n, raw in (("a", machine()), ("b", machine().replace(b"<SVID>1</SVID>", b"<SVID>77</SVID>"))))
    known = spark.createDataFrame([("status_variable", "ChamberPressure", "registry", "demo")], "canonical_type string, value string, authority string, scope string")
    sure = engine.compare(engine.verify_names(old, known), engine.verify_names(new, known)).matching.matches.filter("canonical_type = 'status_variable'").collect()
    assert [(m.strategy, m.confidence) for m in sure] == [("WELL_KNOWN_NAME", "VERIFIED_WKN")]
    half = engine.compare(old, engine.verify_names(new, known)).matching.unmatched.filter("canonical_type = 'status_variable'").count()
    assert half == 2
    with pytest.raises(ModelValidationError):
        engine.verify_names(old, known.unionByName(known.withColumn("scope", F.lit("x"))))


def files(spark, **docs):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in docs.items()], "doc_id string, content binary")


def test_whole_document_is_mapped(spark):
    i = engine.from_files(files(spark, m=machine()))
    assert i.violations().count() == 0 and {r.reason for r in i.pending.collect()} == {"NOT_ATTEMPTED"}
    rules.check_types(i.entities, "key string, canonical_type string, idx int, fields map<string,string>")
    assert rules.indexes(resolve.indexes(i.entities, ["doc_id"])).count() == 0
    with pytest.raises(ModelValidationError):
        rules.check_types(i.entities, "key long")
    assert i.extensions.count() == 0 and i.diagnostics.filter("severity <> 'INFO'").count() == 0 and i.unresolved.count() == 0
    assert {r.canonical_type: r.n for r in i.counts().collect()} == dict.fromkeys((r.canonical_type for r in i.counts().collect()), 1) | {"collection_event": 2, "remote_command_parameter": 2}
    f = {(r.canonical_type, r.implementation_id): r.fields for r in i.subjects.collect()}
    message = f["supported_message", None]
    assert (message["stream"], message["direction"], message["reply_bit"], message["blocking"], message["exceptions"]) == ("1", '"host_to_equipment"', "true", '"S"', '["none"]')
    assert message["structure"] == '[{"attributes":{},"children":[{"attributes":{"dataItemName":"X"},"children":[{"attributes":{},"children":[],"kind":"asc","name":null,"value":""},{"attributes":{},"children":[],"kind":"ui4","name":null,"value":""}],"kind":"list","name":null,"value":null}],"kind":"sequence","name":null,"value":null}]'
    assert message["structure.documentation"] == '[{"path":"/0/children/0","value":{"attribute_description":"inner","description":"inner"}}]'
    assert (f["alarm", "7"]["code"], f["remote_command", None]["use_s2f41"], f["remote_command", None]["use_s2f21"]) == ("-3", "true", "false")
    assert f["collection_event", "10"]["state_transition"] == '{"new_state":"busy","previous_state":"idle","state_model":"run","transition_id":"1"}'
    assert '"compliant":"Yes"' in f["standard_reference", None]["requirements"] and '"as shipped"' in f["standard_reference", None]["requirements.documentation"]
    assert (f["equipment_interface", None]["reports_can_be_deleted"], f["equipment_interface", None]["event_report_links_can_be_deleted"]) == ("true", "false") and f["equipment_metadata", "eq"]["model"] == '"M"'


def test_what_is_not_mapped_is_kept(spark):
    odd = element("Alarm", text("ALID", "1"), text("AlarmName", "a"), text("ALCD", "1_0"), "loose", element("Deep", "x", element("y", "z"), "w"))
    raw = document({"Alarms": odd + element("q:StatusVariable", **{"xmlns:q": "urn:q"}), "StatusVariables": element("StatusVariable", element("SVID", element("b")), text("SVNAME", "n"), **{"a": "1"})}, extra="<RecipeVariableParameters/><SEMIStandards i:nil='true' xmlns:i='http://www.w3.org/2001/XMLSchema-instance'/>")
    i = engine.from_files(files(spark, m=raw))
    kept = {(r.name, r.reason) for r in i.extensions.collect()}
    assert {("Alarm", "unmapped_mixed_content"), ("StatusVariable", "unmapped_content"), ("SVID", "structured_scalar"), ("StatusVariable", "unmapped_attributes"), ("RecipeVariableParameters", "unmapped_content"), ("SEMIStandards", "unmapped_content")} <= kept
    mixed = i.extensions.filter("reason = 'unmapped_mixed_content' and name = 'Alarm'").first().json
    assert '"content":["x",{"attributes":{},"content":["z"],"name":"y","namespace":null,"reason":"unmapped_mixed_content"},"w"]' in mixed
    codes = {r.code for r in i.diagnostics.collect()}
    assert {"INVALID_FIELD", "UNSUPPORTED_FIELD_SHAPE", "NIL_CONTENT", "UNKNOWN_ELEMENT", "UNSUPPORTED_EXTENSION", "MISSING_OPTIONAL_METADATA"} <= codes
    assert i.entities.filter("canonical_type = 'status_variable'").count() == 1 and i.entities.filter("canonical_type = 'alarm'").first().fields.get("code") is None


def test_routing(spark):
    class Other(DictionaryAdapter):
        revision = "other"

    some = files(spark, good=machine(), silent=document(location=None), foreign=b"<a/>", wrong=document(location="E172-0999-SEDD-Schema.xsd"))
    with pytest.raises(UnsupportedRevisionError):
        engine.from_files(some)
    lax = engine.from_files(some, strict=False)
    assert {r.doc_id: (r.status, r.revision) for r in lax.documents.collect()} == {"good": ("supported", "E172-0225"), "silent": ("indeterminate", None), "foreign": ("unsupported", None), "wrong": ("unsupported", None)}
    asked = engine.from_files(some, revision="E172-0225", strict=False)
    assert {r.doc_id for r in asked.entities.unionByName(asked.subjects).select("doc_id").distinct().collect()} == {"good", "silent"}
    assert {r.code for r in asked.adapter_diagnostics.filter("doc_id = 'silent'").collect()} >= {"MISSING_SCHEMA_HINT", "EXPLICIT_REVISION_SELECTION"}
    two = Registry((DictionaryAdapter(), Other()))
    with pytest.raises(AmbiguousRevisionError):
        engine.from_files(files(spark, good=machine()), registry=two)
    assert engine.from_files(files(spark, good=machine()), registry=two, revision="other", strict=False).documents.first().revision == "other" and two.revisions == ("E172-0225", "other")
    for bad in ((), (DictionaryAdapter(), DictionaryAdapter()), (object(),)):
        with pytest.raises(AdapterRegistrationError):
            Registry(bad)
    with pytest.raises(AdapterRegistrationError):
        check_support("maybe")
    with pytest.raises(InputError):
        engine.compare(asked, asked)


def test_limits_and_paths(spark, tmp_path):
    parse = lambda raw, **k: xml.parse("d", raw, xml.Limits(**k))
    for raw, limits in ((b"<a><b/></a>", {"depth": 1}), (b"<a><b/><c/></a>", {"elements": 2}), (b"<a x='1' y='2'/>", {"attributes": 1}), (b"<a xmlns:p='u' xmlns:q='v' x='1'/>", {"attributes": 2}), (b"<" + b"a" * 1025 + b"/>", {}), (b"<aa/>", {"bytes": 3})):
        with pytest.raises(InputError):
            parse(raw, **limits)
    with pytest.raises(ValueError):
        xml.Limits(depth=65)
    root = parse(b"<a>x<b>1</b>y<b z='2'/></a>")
    assert root.content[0] == "x" and root.content[2] == "y" and [c.path for c in root.children] == ["/a[1]/b[1]", "/a[1]/b[2]"] and root.children[1].attribute("z") == "2"
    (tmp_path / "d.xml").write_bytes(b"<a/>")
    (tmp_path / "l").symlink_to(tmp_path)
    assert paths.read_regular(tmp_path / "d.xml", 10) == b"<a/>"
    for bad in (tmp_path / "l" / "d.xml", tmp_path, "http://x/y", "//host/x", "a\nb", ""):
        with pytest.raises(InputError):
            paths.read_regular(bad, 10)
    assert all(map(paths.windows_trap, ("C:x", "C:\\a\\nul.txt", "C:\\a:b", "C:\\a. "))) and not paths.windows_trap("C:\\a\\b.xml")


def test_budgets_fail_whole(spark, monkeypatch):
    i = engine.from_files(files(spark, m=measured(3, 40)))
    monkeypatch.setattr(graph, "PATH_BUDGET", 5)
    with pytest.raises(ResourceLimitError):
        graph.check_paths(graph.dependencies(i.relationships, i.entities, ["doc_id"]), ["doc_id"], 5)


def test_tree_deltas_know_no_identities(spark):
    from strataweave.operators import diff

    a, b = (xml.nodes(files(spark, d=raw)) for raw in (b"<a x='1' y='2'><b>t</b>\n<c/></a>", b"<a y='2' x='1'>  <b>u</b><c/><d/></a>"))
    assert sorted(r.path for r in diff.tree_deltas(a, b, ["doc_id"]).collect()) == ["/a[1]/b[1]", "/a[1]/d[1]"]

import json

import pytest
from model import machine

from strataweave import cli
from strataweave.sinks import documents


@pytest.fixture(scope="module")
def paths(tmp_path_factory):
    at = tmp_path_factory.mktemp("docs")
    (at / "old.xml").write_bytes(machine())
    (at / "new.xml").write_bytes(machine(name="<b>Druck", note="other", report=("2", "1", "1"), extra="<Odd/>"))
    return at


def run(spark, capsys, *args):
    assert cli.main([str(a) for a in args], spark) == 0
    return capsys.readouterr().out


def test_inspect(spark, paths, capsys):
    got = json.loads(run(spark, capsys, "inspect", paths / "old.xml", "--type", "status_variable", "--id", "1", "--json"))
    assert got["entity_counts"]["status_variable"] == 1 and got["entity_counts"]["remote_command_parameter"] == 2 and list(got["equipment"]["provenance"][0]) == sorted(got["equipment"]["provenance"][0])
    chosen = got["selection"]["entities"][0]
    assert got["selection"]["count"] == 1 and chosen["entity"]["units"] == ["Pa"] and chosen["entity"]["format"]["name"] == "F4"
    assert [(r["direction"], r["role"]) for r in chosen["immediate_relationships"]] == [("incoming", "variables[0]"), ("incoming", "variables[2]"), ("outgoing", "format"), ("outgoing", "standards[0]")]
    text = run(spark, capsys, "inspect", paths / "new.xml")
    assert "unsupported sections: 1" in text and "Odd [unmapped_content]" in text


def test_explore(spark, paths, capsys):
    got = json.loads(run(spark, capsys, "explore", paths / "old.xml", "event:10", "--depth", "2", "--json"))
    assert [(e["depth"], e["entity"]["canonical_type"]) for e in got["entities"]] == [(0, "collection_event"), (1, "alarm"), (1, "event_report_link"), (2, "collection_event"), (2, "default_report")]
    assert cli.main(["explore", str(paths / "old.xml"), "event:99"], spark) == 2 and cli.main(["explore", str(paths / "old.xml"), "event"], spark) == 2
    assert capsys.readouterr().err.count("error: ") == 2


def test_compare(spark, paths, capsys):
    got = json.loads(run(spark, capsys, "compare", paths / "old.xml", paths / "new.xml", "--json"))
    s = got["summary"]
    assert (s["is_complete"], s["matched"], s["property_changes"], s["relationship_changes"], s["hidden_documentation_only_changes"]) == (False, 14, 2, 1, 0)
    assert {p["change"]["kind"] for p in got["property_changes"]} == {"NAME_CHANGED", "UNKNOWN_CHANGE"} and got["relationship_changes"][0]["change"]["order_changed"] is True
    assert [i["issue_code"] for i in got["unresolved_items"]] == ["UNKNOWN_CONTENT"] and s["unchanged_matches_displayed"] == 12
    text = run(spark, capsys, "compare", paths / "old.xml", paths / "new.xml", "--type", "status_variable", "--only-changed", "--include-documentation", "--no-color")
    assert "Property changes (2)" in text and "Unchanged" not in text and "Referenced by 1 default report." in text and "\x1b" not in text


def test_report(spark, paths, capsys):
    out = paths / "out.html"
    run(spark, capsys, "report", paths / "old.xml", paths / "new.xml", "--html", out)
    page = out.read_text(encoding="utf-8")
    assert "&lt;b&gt;Druck" in page and "<b>Druck" not in page and "SV_NAME_CHANGED" in page and "script-src 'sha256-" in page and page.count("<script>") == 1
    run(spark, capsys, "report", paths / "new.xml", "--html", out)
    page = out.read_text(encoding="utf-8")
    assert "Well-known names" in page and "ChamberPressure" in page and "variables[1]" in page and "<b>Druck" not in page
    assert cli.main(["report", str(paths / "old.xml"), "--html", str(paths / "old.xml")], spark) == 2


def test_report_document_meets_its_schema(spark, paths):
    doc = cli.report_files(spark, str(paths / "old.xml"), str(paths / "new.xml"))
    schema = documents.report_schema()

    def check(value, s, at):
        if "$ref" in s:
            return check(value, schema["$defs"][s["$ref"].rsplit("/", 1)[1]], at)
        if "anyOf" in s:
            return None if value is None else check(value, s["anyOf"][0], at)
        if "const" in s or "enum" in s:
            assert value in s.get("enum", [s.get("const")]), at
        kinds = {"object": dict, "array": list, "string": str, "integer": int, "boolean": bool}
        if "type" in s:
            assert isinstance(value, kinds[s["type"]]), (at, value)
        if "properties" in s:
            assert sorted(value) == s["required"], (at, sorted(value))
            for k, v in value.items():
                check(v, s["properties"][k], f"{at}.{k}")
        for v in value if s.get("type") == "array" else ():
            check(v, s["items"], at)

    check(doc, schema, "report")
    assert doc["changes"] == sorted(doc["changes"], key=documents.dump) and documents.report_json(doc).endswith("}\n")


def test_errors_give_status_2(spark, tmp_path, capsys):
    assert cli.main(["inspect", str(tmp_path / "none.xml")], spark) == 2
    (tmp_path / "bad.xml").write_text("<a>")
    (tmp_path / "other.xml").write_text("<a/>")
    (tmp_path / "link.xml").symlink_to(tmp_path / "other.xml")
    for name in ("bad", "other", "link"):
        assert cli.main(["inspect", str(tmp_path / f"{name}.xml")], spark) == 2
    said = capsys.readouterr()
    assert said.out == "" and said.err.count("error: ") == 4 and "UNSUPPORTED_REVISION" in said.err and "no element found" in said.err

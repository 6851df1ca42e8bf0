import json
import os

import pytest

from strataweave.errors import ReportError, ResourceLimitError
from strataweave.operators import diff
from strataweave.sinks import reports


@pytest.fixture(scope="module")
def changes(spark):
    rows = [("2", "alarm", "name", "a<b", None), ("1", "status_variable", "units", "Pa\n\"x\"", "&"), ("1", "status_variable", "description", "", "é")]
    return diff.classified(spark.createDataFrame(rows, "key string, canonical_type string, field string, before string, after string"))


def test_json_is_ordered_whole_and_keeps_nulls(changes, tmp_path):
    path = str(tmp_path / "r.json")
    reports.write_json(changes, path)
    raw = open(path, encoding="utf-8").read()
    got = json.loads(raw)
    assert list(got) == ["changes", "schema_version", "summary"] and got["summary"]["changes"] == 3
    lines = [json.dumps(c, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for c in got["changes"]]
    assert lines == sorted(lines) and all(x in raw for x in lines)
    named = next(c for c in got["changes"] if c["field"] == "name")
    assert named["after"] is None and named["before"] == "a<b" and named["code"] == "AL_NAME_CHANGED"


def test_html_escapes_and_text_keeps_a_change_on_a_line(changes, tmp_path):
    reports.write_html(changes, str(tmp_path / "r.html"), title="<x>")
    page = (tmp_path / "r.html").read_text(encoding="utf-8")
    assert "a&lt;b" in page and "&quot;x&quot;" in page and "<title>&lt;x&gt;</title>" in page and "<script" not in page
    reports.write_text(changes, str(tmp_path / "r.txt"))
    lines = (tmp_path / "r.txt").read_text(encoding="utf-8").splitlines()
    assert sum("->" in x for x in lines) == 3 and any(x.endswith('"a<b" -> none') for x in lines)


def test_no_changes(changes, tmp_path):
    reports.write_json(changes.filter("false"), str(tmp_path / "e.json"))
    assert json.loads((tmp_path / "e.json").read_text())["changes"] == []


def test_too_large_fails_and_leaves_the_old_file(changes, tmp_path, monkeypatch):
    monkeypatch.setattr(reports, "CEILING", 10)
    (tmp_path / "r.json").write_text("old")
    with pytest.raises(ResourceLimitError):
        reports.write_json(changes, str(tmp_path / "r.json"))
    assert (tmp_path / "r.json").read_text() == "old" and os.listdir(tmp_path) == ["r.json"]


def test_an_input_is_never_overwritten(changes, tmp_path):
    (tmp_path / "in.xml").write_text("in")
    os.link(tmp_path / "in.xml", tmp_path / "out.html")
    with pytest.raises(ReportError):
        reports.write_html(changes, str(tmp_path / "out.html"), inputs=[str(tmp_path / "in.xml")])
    with pytest.raises(ReportError):
        reports.write_json(changes, str(tmp_path / "none" / "r.json"))

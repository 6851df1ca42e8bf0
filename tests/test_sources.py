import pytest
from pyspark.sql import functions as F

from strataweave import engine
from strataweave.errors import InputTooLargeError, InvalidXmlError, UnsafeXmlError
from strataweave.operators import graph, resolve
from strataweave.sources import xml

DOC = """<?xml version="1.0"?>
<s:DataDictionary xmlns:s="urn:semi-org:xsd.SEDD" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xsi:schemaLocation="urn:semi-org:xsd.SEDD http://x/E172-0225-SEDD-Schema.xsd">
 <StatusVariables><StatusVariable><SVID>007</SVID><SVNAME>Pressure</SVNAME><Format>F4</Format><UNITS>Pa</UNITS></StatusVariable>
  <StatusVariable><SVID> 7</SVID><SVNAME>A</SVNAME><SVNAME>B</SVNAME></StatusVariable></StatusVariables>
 <DataVariables/><EquipmentConstants/>
 <CollectionEvents><CollectionEvent><CEID>10</CEID><CENAME>Start</CENAME><VALIDDVS><VID>007</VID></VALIDDVS></CollectionEvent></CollectionEvents>
 <Alarms><Alarm><ALID>1</ALID><AlarmName>Hot</AlarmName><ALCD>300</ALCD><SetEvent>10</SetEvent><ClearEvent>11</ClearEvent></Alarm></Alarms>
 <VariableFormats><VariableFormat><FormatName>F4</FormatName></VariableFormat></VariableFormats>
 <RemoteCommands><RemoteCommand><Name>GO</Name><AssociatedParameters><Parameter IsRequired="Yes"><Name>P</Name></Parameter></AssociatedParameters></RemoteCommand></RemoteCommands>
 <DefaultReportDefinitions><DefaultReportDefinition><RPTID>5</RPTID><DefaultReportName>R</DefaultReportName><VIDList><VID>007</VID><VID>10</VID><VID>007</VID></VIDList></DefaultReportDefinition></DefaultReportDefinitions>
 <DefaultEventReportLinks><EventReportLink><CEID>10</CEID><RPTIDList><RPTID>5</RPTID></RPTIDList></EventReportLink></DefaultEventReportLinks>
</s:DataDictionary>""".encode()  # noqa: E501


@pytest.fixture(scope="module")
def doc(spark):
    return engine.from_files(spark.createDataFrame([("d1", bytearray(DOC))], "doc_id string, content binary"))


def test_entities_keep_exact_text(doc):
    got = {(r.canonical_type, r.implementation_id, r.name) for r in doc.entities.collect()}
    assert ("status_variable", "007", "Pressure") in got and ("status_variable", " 7", None) in got
    assert ("remote_command_parameter", None, "P") in got and len(got) == 9
    owner = doc.entities.filter("canonical_type = 'remote_command_parameter'").first()
    assert owner.owner_key.endswith("/RemoteCommand[1]") and owner.fields["requiredness"] == '"yes"'


def test_routing_and_diagnostics(doc):
    assert doc.documents.first().status == "supported"
    assert {(r.code, r.field) for r in doc.adapter_diagnostics.filter("severity = 'ERROR'").collect()} == {("AMBIGUOUS_FIELD", "SVNAME"), ("INVALID_FIELD", "ALCD"), ("MISSING_REQUIRED_STRUCTURE", "SEDDHeader")}


def test_references_resolve(doc):
    rel = resolve.resolve(doc.references, doc.entities, by=["doc_id"])
    got = {(r.role, r.state, r.reason) for r in rel.collect()}
    assert got == {("format", "RESOLVED", None), ("set_event", "RESOLVED", None), ("clear_event", "UNRESOLVED", "NOT_FOUND"), ("variables[0]", "RESOLVED", None), ("variables[1]", "UNRESOLVED", "WRONG_TYPE"), ("variables[2]", "RESOLVED", None), ("event", "RESOLVED", None), ("reports[0]", "RESOLVED", None), ("valid_data_variables[0]", "UNRESOLVED", "UNSUPPORTED")}  # noqa: E501
    assert resolve.violations(rel).count() == 0
    start = doc.entities.filter("canonical_type = 'collection_event'").select("key")
    near = {r.key.split("/")[-1]: r.depth for r in graph.bounded_distances(graph.traversable(rel, doc.entities), start, 3).collect()}
    assert near == {"CollectionEvent[1]": 0, "Alarm[1]": 1, "EventReportLink[1]": 1, "DefaultReportDefinition[1]": 2, "StatusVariable[1]": 3}


@pytest.mark.parametrize(
    ("raw", "error"),
    [(b'<!DOCTYPE a [<!ENTITY x "y">]><a>&x;</a>', UnsafeXmlError), (b'<!DOCTYPE a SYSTEM "http://x"><a/>', UnsafeXmlError), (b"<a><b></a>", InvalidXmlError), (b'<a x="1" x="2"/>', InvalidXmlError), (b"<p:a/>", InvalidXmlError), (b"<a>" * 70 + b"</a>" * 70, InputTooLargeError)],
)
def test_hostile_documents_fail(raw, error):
    with pytest.raises(error):
        xml.shred("d", raw)


def test_streamed_ingest_equals_batch(spark, tmp_path):
    from strataweave.streaming.ingest import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xml").write_bytes(DOC)
    ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == xml.load(spark, str(tmp_path / "in")).count() == len(xml.shred("d", DOC))


def test_ambiguous_candidates_are_kept(spark):
    e = spark.createDataFrame([("k1", "part", "1", "x"), ("k2", "part", "2", "x"), ("k3", "other", "9", "y")], "key string, canonical_type string, implementation_id string, name string")
    r = spark.createDataFrame([("o", "a", ["part"], None, "x"), ("o", "b", ["part"], "1", "x"), ("o", "c", ["part"], "1", "y"), ("o", "d", ["part"], None, None), ("o", "e", [], "1", None), ("o", "f", ["part"], "9", None), ("o", "g", ["part"], "", None)], "owner_key string, role string, target_types array<string>, implementation_id string, name string")
    got = {x.role: (x.state, x.reason, x.target_key, x.candidate_keys) for x in resolve.resolve(r, e).collect()}
    assert got["a"] == ("AMBIGUOUS", "AMBIGUOUS", None, ["k1", "k2"]) and got["b"][2] == "k1"
    assert [got[k][1] for k in "cdefg"] == ["NOT_FOUND", "MISSING_SELECTOR", "UNSUPPORTED", "WRONG_TYPE", "NOT_FOUND"]


def test_work_budget_raises(spark):
    from strataweave.errors import ResourceLimitError

    rel = spark.range(3).select(F.lit(300).alias("n_candidates"))
    with pytest.raises(ResourceLimitError):
        graph.check_fanout(rel, 1000)

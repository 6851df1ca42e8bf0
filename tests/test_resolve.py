"""The resolution queries leave no reference out, and references that ask the same share an answer."""

from collections import defaultdict

import pytest

from strataweave.errors import ResourceLimitError
from strataweave.operators import resolve
from strataweave.plans import queries as core


def test_every_reference_is_resolved(spark, small):
    names = defaultdict(list)
    parts = spark.read.parquet(f"{small}/part.parquet").select("p_partkey", "p_name").collect()
    for p in parts:
        names[p.p_name].append(f"part:{p.p_partkey}")
    got = {r.owner_key: (r.n_candidates, r.first_key) for r in core.queries()["resolve_by_name"](spark, small).collect()}
    assert got == {f"r:{p.p_partkey}": (len(names[p.p_name]) if len(names[p.p_name]) > 1 else 0, min(names[p.p_name])) for p in parts}
    first = {r.l_orderkey for r in spark.read.parquet(f"{small}/lineitem.parquet").filter("l_linenumber = 1").collect()}
    orders = [r.o_orderkey for r in spark.read.parquet(f"{small}/orders.parquet").collect()]
    got = {r.owner_key: r.target_key for r in core.queries()["resolve_scope"](spark, small).collect()}
    assert got == {f"o:{o}": f"{o}/1" if o in first else None for o in orders}


def test_scopes_bind_parameters_only(spark):
    rows = [("c1/p", "remote_command_parameter", None, "n", "c1"), ("c2/p", "remote_command_parameter", None, "n", "c2"), ("f", "variable_format", None, "n", None), ("c2/q", "remote_command_parameter", None, "q", "c2")]
    entities = spark.createDataFrame(rows, "key string, canonical_type string, implementation_id string, name string, owner_key string")
    both = ["remote_command_parameter", "variable_format"]
    asks = [("a", both[:1], "n", "c1"), ("b", both, "n", "c1"), ("c", both[:1], "n", None), ("d", both[:1], "q", "c1"), ("e", both[1:], "n", "c3"), ("g", both[1:], "q", "c2")]
    refs = spark.createDataFrame([(r, r, t, None, n, s) for r, t, n, s in asks], "owner_key string, role string, target_types array<string>, implementation_id string, name string, scope_key string")
    got = {r.role: (r.state, r.reason, r.target_key, r.candidate_keys) for r in resolve.resolve(refs, entities).collect()}
    assert got["a"] == ("RESOLVED", None, "c1/p", []) and got["b"] == ("AMBIGUOUS", "AMBIGUOUS", None, ["c1/p", "f"]) and got["c"][3] == ["c1/p", "c2/p"]
    assert got["d"][1] == "NOT_FOUND" and got["e"][2] == "f" and got["g"][1] == "WRONG_TYPE"


def test_same_question_keeps_owners_and_budget(spark, monkeypatch):
    entities = spark.createDataFrame([(f"e{i}", "part", None, "n") for i in range(3)], "key string, canonical_type string, implementation_id string, name string")
    refs = spark.createDataFrame([(f"o{i}", "r", ["part"], None, "n" if i < 4 else None) for i in range(5)], "owner_key string, role string, target_types array<string>, implementation_id string, name string")
    got = {r.owner_key: (r.state, r.candidate_keys) for r in resolve.resolve(refs, entities).collect()}
    assert got == {f"o{i}": ("AMBIGUOUS", ["e0", "e1", "e2"]) for i in range(4)} | {"o4": ("UNRESOLVED", [])}
    monkeypatch.setattr(resolve, "CANDIDATE_BUDGET", 11)
    with pytest.raises(ResourceLimitError):
        resolve.resolve(refs, entities, validate_budget=True)

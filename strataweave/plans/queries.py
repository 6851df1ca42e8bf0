"""The engine's operators over the driver's tables, each with the SQL that computes the same rows.

The old version of a table is the table itself; a new version is made by arithmetic on its keys, the same in both languages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import diff, graph, match, resolve
from ..sinks import reports
from ..sources import dictionary, xml
from . import versions


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(c: str):
    return F.col(c).cast("string")


def _entities(df: DataFrame, kind: str, key: str, ident: str | None, name: str | None, **more) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(F.concat(F.lit(f"{kind}:"), _text(key)).alias("key"), F.lit(kind).alias("canonical_type"), (_text(ident) if ident else none).alias("implementation_id"), (F.col(name) if name else none).alias("name"), *[v.alias(k) for k, v in more.items()])


TYPES = ("region", "nation", "customer", "supplier", "part", "order_line")


def entity_counts(spark, sf):
    """Count per type with zeros."""
    tables = (("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name"))
    counts = None
    for t, k, _ in tables:
        one = read(spark, sf, t).agg(F.count(k).alias("n")).select(F.lit(t).alias("canonical_type"), "n")
        counts = one if counts is None else counts.unionByName(one)
    kinds = spark.createDataFrame([(t,) for t in TYPES], "canonical_type string")
    return kinds.join(counts, "canonical_type", "left").select("canonical_type", F.coalesce("n", F.lit(0)).alias("n"))


def inspect_filter(spark, sf):
    """Conjunctive exact filter, pushed to the scan."""
    return read(spark, sf, "part").filter((F.col("p_size") == 15) & (F.col("p_type") >= "")).select("p_partkey", "p_name", "p_size")


def _event_refs(spark, sf):
    e = read(spark, sf, "events")
    return e.select(F.concat(F.lit("event:"), _text("event_id")).alias("owner_key"), F.lit("target").alias("role"), F.array(F.lit("supplier")).alias("target_types"), (F.col("user_id") * 40).cast("string").alias("implementation_id"), F.lit(None).cast("string").alias("name"))


def _event_relationships(spark, sf):
    entities = _entities(read(spark, sf, "supplier"), "supplier", "s_suppkey", "s_suppkey", "s_name").unionByName(_entities(read(spark, sf, "part"), "part", "p_partkey", "p_partkey", "p_name"))
    return resolve.resolve(_event_refs(spark, sf), entities)


def resolve_by_id(spark, sf):
    return _event_relationships(spark, sf).select("owner_key", "state", "reason", "target_key")


_RESOLVE_SQL = """
SELECT 'event:' || e.event_id AS owner_key, CASE WHEN s.s_suppkey IS NOT NULL THEN 'RESOLVED' ELSE 'UNRESOLVED' END AS state,
       CASE WHEN s.s_suppkey IS NOT NULL THEN NULL WHEN p.p_partkey IS NOT NULL THEN 'WRONG_TYPE' ELSE 'NOT_FOUND' END AS reason,
       'supplier:' || s.s_suppkey AS target_key
FROM events e LEFT JOIN supplier s ON s.s_suppkey = e.user_id * 40 LEFT JOIN part p ON p.p_partkey = e.user_id * 40
"""


def resolution_states(spark, sf):
    """How many references end in each state: the flagship."""
    return _event_relationships(spark, sf).groupBy("state", "reason").agg(F.count("*").alias("n"))


def unresolved_ledger(spark, sf):
    return resolve.diagnostics(_event_relationships(spark, sf)).select("owner_key", "code", "reason", "severity")


def resolve_by_name(spark, sf):
    """Names are shared by many parts: ambiguous, told by the number of candidates and the least of them."""
    part = read(spark, sf, "part")
    refs = part.select(F.concat(F.lit("r:"), _text("p_partkey")).alias("owner_key"), F.lit("part").alias("role"), F.array(F.lit("part")).alias("target_types"), F.lit(None).cast("string").alias("implementation_id"), F.col("p_name").alias("name"))
    found = resolve.resolve(refs, _entities(part, "part", "p_partkey", "p_partkey", "p_name"), candidates=False)
    return found.select("owner_key", "name", "state", "reason", "n_candidates", F.col("first_candidate").alias("first_key"))


def resolve_intersect(spark, sf):
    """Two selectors must agree: the name of one part, the id of another or of the same."""
    part = read(spark, sf, "part")
    refs = part.select(F.concat(F.lit("r:"), _text("p_partkey")).alias("owner_key"), F.lit("part").alias("role"), F.array(F.lit("part")).alias("target_types"), (F.col("p_partkey") - F.col("p_partkey") % 3).cast("string").alias("implementation_id"), F.col("p_name").alias("name"))
    out = resolve.resolve(refs, _entities(part, "part", "p_partkey", "p_partkey", "p_name"))
    return out.select("owner_key", "state", "reason", "target_key")


def resolve_scope(spark, sf):
    """Parameters resolve within their command only: line numbers within orders."""
    lines = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    entities = lines.select(F.concat_ws("/", F.col("l_orderkey"), F.col("l_linenumber")).alias("key"), F.lit("remote_command_parameter").alias("canonical_type"), F.lit(None).cast("string").alias("implementation_id"), _text("l_linenumber").alias("name"), _text("l_orderkey").alias("owner_key"))
    refs = read(spark, sf, "orders").select(F.concat(F.lit("o:"), _text("o_orderkey")).alias("owner_key"), F.lit("first").alias("role"), F.array(F.lit("remote_command_parameter")).alias("target_types"), F.lit(None).cast("string").alias("implementation_id"), F.lit("1").alias("name"), _text("o_orderkey").alias("scope_key"))
    return resolve.resolve(refs, entities, candidates=False).select("owner_key", "state", "reason", "target_key")


def adjacency_degree(spark, sf):
    """In and out degree of nations among their region, suppliers and customers."""
    rel = lambda df, owner, ok, target, tk: df.select(F.concat(F.lit(owner + ":"), _text(ok)).alias("owner_key"), F.lit(target).alias("role"), F.lit("RESOLVED").alias("state"), F.concat(F.lit(target + ":"), _text(tk)).alias("target_key"), F.array().cast("array<string>").alias("candidate_keys"))
    r = rel(read(spark, sf, "nation"), "nation", "n_nationkey", "region", "n_regionkey").unionByName(rel(read(spark, sf, "supplier"), "supplier", "s_suppkey", "nation", "s_nationkey")).unionByName(rel(read(spark, sf, "customer"), "customer", "c_custkey", "nation", "c_nationkey"))
    return graph.adjacency(r).filter(F.col("key").startswith("nation:")).groupBy("key").agg(F.count_if(F.col("direction") == "incoming").alias("n_in"), F.count_if(F.col("direction") == "outgoing").alias("n_out"))


def dep_referenced_by(spark, sf):
    edges = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("owner"), F.col("l_partkey").alias("target"))
    return graph.referenced_by(edges)


def dep_linked_report(spark, sf):
    """Two edges: customer to orders to parts."""
    orders = read(spark, sf, "orders").select(F.col("o_custkey").alias("start"), F.col("o_orderkey").alias("end"))
    lines = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("start"), F.col("l_partkey").alias("end"))
    return graph.dependents(graph.through(orders, lines))


def dep_event_via_report(spark, sf):
    """Three edges: part to line to order to customer."""
    lines = read(spark, sf, "lineitem").select(F.col("l_partkey").alias("start"), F.col("l_orderkey").alias("end"))
    orders = read(spark, sf, "orders").select(F.col("o_orderkey").alias("start"), F.col("o_custkey").alias("end"))
    customers = read(spark, sf, "customer").select(F.col("c_custkey").alias("start"), F.col("c_nationkey").alias("end"))
    return graph.dependents(graph.through(lines, orders, customers))


def explore_bfs(spark, sf):
    """Keys within three hops of a region over undirected edges."""
    n = read(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("a"), F.concat(F.lit("r"), "n_regionkey").alias("b"))
    s = read(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("a"), F.concat(F.lit("n"), "s_nationkey").alias("b"))
    e = n.unionByName(s)
    e = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    return graph.bounded_distances(e, spark.createDataFrame([("r0",)], "key string"), 3).select("key", F.col("depth").cast("long").alias("depth"))


def _versions(spark, sf):
    """Suppliers and a new version: keys ending in 9 lose their name, those divisible by 10 share one, others keep theirs."""
    s = read(spark, sf, "supplier")
    old = s.select(F.lit("old").alias("side"), _text("s_suppkey").alias("key"), "s_name")
    new_name = F.when(F.col("s_suppkey") % 10 == 9, None).when(F.col("s_suppkey") % 10 == 0, "shared").otherwise(F.col("s_name"))
    old = old.withColumn("s_name", F.when(F.col("key").cast("long") % 10 == 0, "shared").otherwise(F.col("s_name")))
    return old.unionByName(s.select(F.lit("new").alias("side"), _text("s_suppkey").alias("key"), new_name.alias("s_name")))


def _outcomes(spark, sf):
    v = _versions(spark, sf)
    tokens = v.filter("s_name is not null").select("side", "key", F.lit("WELL_KNOWN_NAME").alias("strategy"), F.col("s_name").alias("value"))
    return match.outcomes(v.select("side", "key"), tokens)


def match_outcome(spark, sf):
    return _outcomes(spark, sf).groupBy("outcome", "reason", "o", "n").agg(F.count("*").alias("components"))


def match_confidence(spark, sf):
    """Two kinds of tokens for the same pairs: corroborated matches."""
    v = _versions(spark, sf)
    names = v.filter("s_name is not null").select("side", "key", F.lit("WELL_KNOWN_NAME").alias("strategy"), F.col("s_name").alias("value"))
    ids = v.filter("key % 2 = 0").select("side", "key", F.lit("NATIVE_ID").alias("strategy"), F.col("key").alias("value"))
    return match.outcomes(v.select("side", "key"), names.unionByName(ids)).filter("outcome = 'match'").select("old_key", "new_key", "confidence", "strategy")


def match_collision(spark, sf):
    """Equal texts of even and odd documents as identities: repeated texts collide."""
    d = read(spark, sf, "documents").select(F.when(F.col("doc_id") % 2 == 0, "old").otherwise("new").alias("side"), _text("doc_id").alias("key"), F.sha2("text", 256).alias("value"))
    tokens = d.select("side", "key", F.lit("NATIVE_ID").alias("strategy"), "value")
    return match.outcomes(d.select("side", "key"), tokens).groupBy("outcome", "o", "n").agg(F.count("*").alias("components"))


def match_scoped(spark, sf):
    """Lines only of matched orders: those whose status is not changed in the new version."""
    o = read(spark, sf, "orders").filter("o_orderkey % 5 <> 0").select(_text("o_orderkey").alias("old_key"), _text("o_orderkey").alias("new_key"))
    lines = read(spark, sf, "lineitem").select(F.lit("old").alias("side"), _text("l_orderkey").alias("parent"), "l_linenumber")
    return match.scoped(lines, o).groupBy(F.col("parent").alias("order_key")).agg(F.count("*").alias("n"))


def _supplier_changes(spark, sf):
    s = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("units"), F.concat(F.lit("nation "), "s_nationkey").alias("description"))
    k = F.col("key")
    new = s.select("key", F.when(k % 4 == 0, F.concat("name", F.lit("!"))).otherwise(F.col("name")).alias("name"), F.when(k % 6 == 0, None).otherwise(F.col("units")).alias("units"), F.when(k % 5 == 0, "other").otherwise(F.col("description")).alias("description"))
    return diff.classified(diff.properties(s, new, ["key"], ["name", "units", "description"]).withColumn("canonical_type", F.lit("status_variable")))


def diff_properties(spark, sf):
    return _supplier_changes(spark, sf).select("key", "field", "before", "after")


def change_code(spark, sf):
    c = _supplier_changes(spark, sf)
    return c.select(diff.change_code(F.col("canonical_type"), F.col("kind")).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


def report_json(spark, sf):
    """Each change as canonical JSON under its public code."""
    return reports.change_rows(_supplier_changes(spark, sf).withColumn("key", F.col("key").cast("string")))


def report_html(spark, sf):
    """Each change as an escaped row of a page."""
    return reports.html_rows(_supplier_changes(spark, sf).withColumn("key", F.col("key").cast("string")))


def report_text(spark, sf):
    """Each change as one line of text."""
    return reports.text_rows(_supplier_changes(spark, sf).withColumn("key", F.col("key").cast("string")))


def check_relationships(spark, sf):
    """Outcomes that contradict themselves, by their state; some are spoilt on purpose."""
    part = read(spark, sf, "part")
    k = F.col("p_partkey")
    refs = part.select(k, F.concat(F.lit("r:"), _text("p_partkey")).alias("owner_key"), F.lit("part").alias("role"), F.array(F.lit("part")).alias("target_types"), F.when(k % 3 == 0, _text("p_partkey")).otherwise(F.concat(F.lit("no "), _text("p_partkey"))).alias("implementation_id"), F.lit(None).cast("string").alias("name"))
    found = resolve.resolve(refs, _entities(part, "part", "p_partkey", "p_partkey", "p_name"))
    spoilt = found.withColumn("target_key", F.when(k % 5 == 0, None).otherwise(F.col("target_key"))).withColumn("reason", F.when(k % 7 == 0, None).otherwise(F.col("reason")))
    spoilt = spoilt.withColumn("candidate_keys", F.when(k % 11 == 0, F.array(F.lit("a"), F.lit("a"))).otherwise(F.col("candidate_keys")))
    return resolve.violations(spoilt).groupBy("state").agg(F.count("*").alias("broken"))


def _turns(spark, sf):
    c = read(spark, sf, "conversations").select("conv_id", "turn", "role")
    new = c.filter("turn % 4 <> 3").select("conv_id", F.when(F.col("conv_id") % 3 == 0, -F.col("turn")).otherwise(F.col("turn")).alias("turn"), F.when((F.col("conv_id") % 5 == 0) & (F.col("turn") == 0), "system").otherwise(F.col("role")).alias("role"))
    return diff.multisets(c, new, ["conv_id"], "role", "turn")


def diff_multiset(spark, sf):
    return _turns(spark, sf).select("conv_id", "added", "removed")


def diff_order(spark, sf):
    return _turns(spark, sf).select("conv_id", "order_changed", "presence_changed")


def certain_add_remove(spark, sf):
    """Unmatched suppliers and nations; suppliers without identity make the other side's suppliers uncertain."""
    s = read(spark, sf, "supplier").select(F.when(F.col("s_suppkey") % 2 == 0, "old").otherwise("new").alias("side"), F.concat(F.lit("s"), "s_suppkey").alias("key"), F.lit("supplier").alias("canonical_type"), F.when(F.col("s_suppkey") == 3, "NO_USABLE_IDENTITY").otherwise("NO_COUNTERPART").alias("reason"))
    n = read(spark, sf, "nation").select(F.when(F.col("n_nationkey") % 2 == 0, "old").otherwise("new").alias("side"), F.concat(F.lit("n"), "n_nationkey").alias("key"), F.lit("nation").alias("canonical_type"), F.lit("NO_COUNTERPART").alias("reason"))
    u = s.unionByName(n)
    return diff.certain(u, u.filter("false").select("side", "canonical_type")).groupBy("kind", "side", "canonical_type").agg(F.count("*").alias("n"))


def revision_hint(spark, sf):
    """The label of schema locations: whole, encoded, of another namespace, several, odd, of another name, none."""
    p = read(spark, sf, "pages")
    year = F.lpad((F.col("page_id") % 10000).cast("string"), 4, "0")
    name = F.concat(F.lit("E172-"), year, F.lit("-SEDD-Schema.xsd"))
    kind = F.col("page_id") % 8
    at = F.when(kind == 0, F.concat(F.lit("urn:a  http://x/y/"), name, F.lit("?q#f"))).when(kind == 1, F.concat(F.lit("\turn:a http://x/y%2F"), F.replace(name, F.lit("-"), F.lit("%2D"))))
    at = at.when(kind == 2, F.concat(F.lit("urn:b "), name)).when(kind == 3, F.concat(F.lit("urn:a p/"), name, F.lit(" urn:a q/"), name)).when(kind == 4, F.concat(F.lit("urn:a "), name, F.lit(" urn:a")))
    at = at.when(kind == 5, F.concat(F.lit("urn:a x"), name)).when(kind == 6, F.concat(F.lit("urn:a "), name, F.lit(" urn:b other urn:a "), name))
    found = p.select("page_id", xml.hint(F.lit("urn:a"), at, F.lit(None).cast("string"), dictionary.REVISION_PATTERN, "E172-").alias("h"))
    return found.select("page_id", F.col("h.code").alias("code"), F.col("h.revision").alias("revision"))


def html_escape(spark, sf):
    return read(spark, sf, "pages").select("page_id", T.html_escape(F.col("html")).alias("escaped"))


def xml_bool_int(spark, sf):
    p = read(spark, sf, "part")
    raw = F.concat(F.lit("\t "), F.when(F.col("p_size") % 3 == 0, "true").when(F.col("p_size") % 3 == 1, "0").otherwise("TRUE"), F.lit("\n"))
    number = F.concat(F.when(F.col("p_size") % 5 == 0, " +").otherwise(""), _text("p_size"), F.when(F.col("p_size") % 7 == 0, "x").otherwise(" "))
    return p.select("p_partkey", T.lexical_boolean(raw).alias("flag"), T.lexical_integer(number, 1, 40).alias("number"))


def sibling_index(spark, sf):
    """Occurrence number among siblings of one tag."""
    from pyspark.sql import Window

    c = read(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn", "text")).cast("long").alias("nth"))


def sorted_inventory(spark, sf):
    """Number of each part within its brand in total order, NULL sorting as empty."""
    from pyspark.sql import Window

    p = read(spark, sf, "part")
    return p.select("p_partkey", "p_brand", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.coalesce("p_type", F.lit("")), F.coalesce("p_name", F.lit("")), "p_partkey")).cast("long").alias("n"))


def budget_fanout(spark, sf):
    n = read(spark, sf, "part").groupBy("p_name").agg(F.count("*").alias("n"))
    return graph.fanout(n, "n")


_CHANGES = """
WITH s AS (SELECT s_suppkey AS key, s_name AS name, CAST(s_nationkey AS VARCHAR) AS units, 'nation ' || s_nationkey AS description FROM supplier),
n AS (SELECT key, CASE WHEN key % 4 = 0 THEN name || '!' ELSE name END AS name, CASE WHEN key % 6 = 0 THEN NULL ELSE units END AS units, CASE WHEN key % 5 = 0 THEN 'other' ELSE description END AS description FROM s),
c AS (SELECT s.key, 'name' AS field, s.name AS before, n.name AS after FROM s JOIN n USING (key) WHERE s.name IS DISTINCT FROM n.name
  UNION ALL SELECT s.key, 'units', s.units, n.units FROM s JOIN n USING (key) WHERE s.units IS DISTINCT FROM n.units
  UNION ALL SELECT s.key, 'description', s.description, n.description FROM s JOIN n USING (key) WHERE s.description IS DISTINCT FROM n.description),
k AS (SELECT *, CASE field WHEN 'name' THEN 'NAME_CHANGED' WHEN 'units' THEN 'UNIT_CHANGED' ELSE 'DESCRIPTION_CHANGED' END AS kind, CASE field WHEN 'description' THEN 'DOCUMENTATION_CHANGE' ELSE 'INTERFACE_CHANGE' END AS category FROM c)
"""
_VERSIONS = """
WITH o AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 10 = 0 THEN 'shared' ELSE s_name END AS v FROM supplier),
n AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 10 = 9 THEN NULL WHEN s_suppkey % 10 = 0 THEN 'shared' ELSE s_name END AS v FROM supplier),
g AS (SELECT v, sum(o) AS o, sum(n) AS n FROM (SELECT v, 1 AS o, 0 AS n FROM o UNION ALL SELECT v, 0, 1 FROM n) WHERE v IS NOT NULL GROUP BY v)
"""
_TURNS = """
WITH o AS (SELECT conv_id, turn, role FROM conversations),
n AS (SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN -turn ELSE turn END AS turn, CASE WHEN conv_id % 5 = 0 AND turn = 0 THEN 'system' ELSE role END AS role FROM conversations WHERE turn % 4 <> 3),
d AS (SELECT conv_id, role, sum(s) AS d FROM (SELECT conv_id, role, -1 AS s FROM o UNION ALL SELECT conv_id, role, 1 FROM n) GROUP BY conv_id, role),
l AS (SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, a.xs AS a, b.xs AS b FROM (SELECT conv_id, list(role ORDER BY turn, role) AS xs FROM o GROUP BY conv_id) a FULL JOIN (SELECT conv_id, list(role ORDER BY turn, role) AS xs FROM n GROUP BY conv_id) b ON a.conv_id = b.conv_id)
"""

ORACLE = {
    "entity_counts": "SELECT 'region' AS canonical_type, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'order_line', 0",
    "inspect_filter": "SELECT p_partkey, p_name, p_size FROM part WHERE p_size = 15 AND p_type >= ''",
    "resolve_by_id": _RESOLVE_SQL,
    "resolution_states": f"SELECT state, reason, count(*) AS n FROM ({_RESOLVE_SQL}) GROUP BY state, reason",
    "unresolved_ledger": f"SELECT owner_key, 'UNRESOLVED_REFERENCE' AS code, reason, 'WARNING' AS severity FROM ({_RESOLVE_SQL}) WHERE state <> 'RESOLVED'",
    "resolve_by_name": "WITH g AS (SELECT p_name, count(*) AS n, min('part:' || p_partkey) AS k FROM part GROUP BY p_name) SELECT 'r:' || p.p_partkey AS owner_key, p.p_name AS name, CASE WHEN g.n = 1 THEN 'RESOLVED' ELSE 'AMBIGUOUS' END AS state, CASE WHEN g.n > 1 THEN 'AMBIGUOUS' END AS reason, CAST(CASE WHEN g.n = 1 THEN 0 ELSE g.n END AS BIGINT) AS n_candidates, g.k AS first_key FROM part p JOIN g ON p.p_name = g.p_name",
    "resolve_intersect": "SELECT 'r:' || p.p_partkey AS owner_key, CASE WHEN q.p_partkey IS NULL THEN 'UNRESOLVED' ELSE 'RESOLVED' END AS state, CASE WHEN q.p_partkey IS NULL THEN 'NOT_FOUND' END AS reason, 'part:' || q.p_partkey AS target_key FROM part p LEFT JOIN part q ON q.p_partkey = p.p_partkey - p.p_partkey % 3 AND q.p_name = p.p_name",
    "resolve_scope": "SELECT 'o:' || o_orderkey AS owner_key, CASE WHEN l.l_orderkey IS NULL THEN 'UNRESOLVED' ELSE 'RESOLVED' END AS state, CASE WHEN l.l_orderkey IS NULL THEN 'NOT_FOUND' END AS reason, l.l_orderkey || '/1' AS target_key FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linenumber = 1) l ON l.l_orderkey = o_orderkey",
    "adjacency_degree": "SELECT 'nation:' || n_nationkey AS key, CAST((SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) + (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS BIGINT) AS n_in, CAST(1 AS BIGINT) AS n_out FROM nation",
    "dep_referenced_by": "SELECT l_partkey AS subject, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY l_partkey",
    "dep_linked_report": "SELECT o_custkey AS subject, count(DISTINCT l_partkey) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey",
    "dep_event_via_report": "SELECT l_partkey AS subject, count(DISTINCT c_nationkey) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY l_partkey",
    "explore_bfs": """WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS a, 'r' || n_regionkey AS b FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
      u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), w(key, depth) AS (SELECT 'r0', 0 UNION SELECT u.b, depth + 1 FROM w JOIN u ON u.a = w.key WHERE depth < 3)
      SELECT key, CAST(min(depth) AS BIGINT) AS depth FROM w GROUP BY key""",
    "match_outcome": _VERSIONS + """SELECT outcome, reason, o, n, count(*) AS components FROM (
      SELECT CAST(o AS BIGINT) AS o, CAST(n AS BIGINT) AS n, CASE WHEN o = 1 AND n = 1 THEN 'match' WHEN o + n > 1 THEN 'ambiguous' ELSE 'unmatched' END AS outcome,
        CASE WHEN o = 1 AND n = 1 THEN NULL WHEN o + n > 1 THEN 'IDENTITY_COLLISION' ELSE 'NO_COUNTERPART' END AS reason FROM g
      UNION ALL SELECT 0, 1, 'unmatched', 'NO_USABLE_IDENTITY' FROM n WHERE v IS NULL) GROUP BY outcome, reason, o, n""",
    "match_confidence": """SELECT CAST(s_suppkey AS VARCHAR) AS old_key, CAST(s_suppkey AS VARCHAR) AS new_key, CASE WHEN s_suppkey % 2 = 0 THEN 'CORROBORATED' ELSE 'VERIFIED_WKN' END AS confidence,
      CASE WHEN s_suppkey % 2 = 0 THEN 'NATIVE_ID' ELSE 'WELL_KNOWN_NAME' END AS strategy FROM supplier WHERE s_suppkey % 10 NOT IN (0, 9)
      UNION ALL SELECT CAST(min(s_suppkey) AS VARCHAR), CAST(min(s_suppkey) AS VARCHAR), 'CORROBORATED', 'NATIVE_ID' FROM supplier WHERE s_suppkey % 10 = 0 HAVING count(*) = 1""",
    "match_collision": "SELECT CASE WHEN o = 1 AND n = 1 THEN 'match' WHEN o + n > 1 THEN 'ambiguous' ELSE 'unmatched' END AS outcome, o, n, count(*) AS components FROM (SELECT count(*) FILTER (doc_id % 2 = 0) AS o, count(*) FILTER (doc_id % 2 = 1) AS n FROM documents GROUP BY text) GROUP BY outcome, o, n",
    "match_scoped": "SELECT CAST(l_orderkey AS VARCHAR) AS order_key, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 <> 0) GROUP BY l_orderkey",
    "diff_properties": _CHANGES + "SELECT key, field, before, after FROM k",
    "change_code": _CHANGES + "SELECT 'SV_' || kind AS code, count(*) AS n FROM k GROUP BY kind",
    "report_json": _CHANGES + """SELECT 'SV_' || kind AS code, CAST(to_json({'after': after, 'before': before, 'canonical_type': 'status_variable', 'category': category, 'code': 'SV_' || kind, 'field': field, 'key': CAST(key AS VARCHAR), 'kind': kind}) AS VARCHAR) AS json FROM k""",
    "report_html": _CHANGES + """SELECT CAST(key AS VARCHAR) AS key, field, '<tr><td>SV_' || kind || '</td><td>status_variable ' || key || '</td><td>' || field || '</td><td>' || replace(coalesce(before, '—'), '&', '&amp;') || '</td><td>' || replace(coalesce(after, '—'), '&', '&amp;') || '</td></tr>' AS html FROM k""",
    "report_text": _CHANGES + """SELECT CAST(key AS VARCHAR) AS key, field, category || '  ' || kind || '  status_variable ' || key || '.' || field || ': ' || coalesce('"' || before || '"', 'none') || ' -> ' || coalesce('"' || after || '"', 'none') AS line FROM k""",
    "check_relationships": "WITH x AS (SELECT p_partkey AS k, p_partkey % 3 = 0 AS solid FROM part) SELECT CASE WHEN solid THEN 'RESOLVED' ELSE 'UNRESOLVED' END AS state, count(*) AS broken FROM x WHERE k % 11 = 0 OR (solid AND k % 5 = 0) OR (NOT solid AND k % 7 = 0) GROUP BY solid",
    "diff_multiset": _TURNS + "SELECT conv_id, coalesce(string_agg(CASE WHEN d > 0 THEN rtrim(repeat(role || ',', CAST(d AS BIGINT)), ',') END, ',' ORDER BY role), '') AS added, coalesce(string_agg(CASE WHEN d < 0 THEN rtrim(repeat(role || ',', CAST(-d AS BIGINT)), ',') END, ',' ORDER BY role), '') AS removed FROM d GROUP BY conv_id",
    "diff_order": _TURNS + "SELECT conv_id, coalesce(list_sort(a) = list_sort(b) AND a <> b, false) AS order_changed, (a IS NULL OR b IS NULL) AS presence_changed FROM l",
    "certain_add_remove": """WITH u AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'old' ELSE 'new' END AS side, 'supplier' AS canonical_type, CASE WHEN s_suppkey = 3 THEN 0 ELSE 1 END AS sure FROM supplier UNION ALL SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'old' ELSE 'new' END, 'nation', 1 FROM nation),
      x AS (SELECT u.side, u.canonical_type, CASE WHEN sure = 0 OR EXISTS (SELECT 1 FROM u v WHERE v.sure = 0 AND v.side <> u.side AND v.canonical_type = u.canonical_type) THEN 'INSUFFICIENT_IDENTITY' WHEN u.side = 'old' THEN 'ENTITY_REMOVED' ELSE 'ENTITY_ADDED' END AS kind FROM u)
      SELECT kind, side, canonical_type, count(*) AS n FROM x GROUP BY kind, side, canonical_type""",
    "revision_hint": "SELECT page_id, CASE page_id % 8 WHEN 2 THEN 'MISSING_SCHEMA_HINT' WHEN 3 THEN 'AMBIGUOUS_SCHEMA_HINT' WHEN 4 THEN 'MALFORMED_SCHEMA_HINT' WHEN 5 THEN 'UNRECOGNIZED_SCHEMA_HINT' WHEN 7 THEN 'MISSING_SCHEMA_HINT' END AS code, CASE WHEN page_id % 8 IN (0, 1, 6) THEN 'E172-' || lpad(CAST(page_id % 10000 AS VARCHAR), 4, '0') END AS revision FROM pages",
    "html_escape": "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped FROM pages",
    "xml_bool_int": "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN true WHEN 1 THEN false END AS flag, CASE WHEN p_size % 7 <> 0 AND p_size BETWEEN 1 AND 40 THEN CAST(p_size AS BIGINT) END AS number FROM part",
    "sibling_index": "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) AS nth FROM conversations",
    "sorted_inventory": "SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY coalesce(p_type, ''), coalesce(p_name, ''), p_partkey) AS n FROM part",
    "budget_fanout": "SELECT count(*) AS \"references\", CAST(sum(n) AS BIGINT) AS candidates, CAST(sum(n * n) AS BIGINT) AS work FROM (SELECT count(*) AS n FROM part GROUP BY p_name)",
}


def entry(spark: SparkSession) -> DataFrame:
    return resolution_states(spark, "/root/testdata/sf0.001")


def queries() -> dict:
    return {name: globals()[name] for name in ORACLE} | versions.queries()


def oracle_sql() -> dict[str, str]:
    return ORACLE | versions.ORACLE

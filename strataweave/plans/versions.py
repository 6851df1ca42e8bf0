"""Queries of matching, comparison, dependencies and document mapping over the driver's tables, each with its SQL.

Suppliers are status variables, nations their formats, regions events, customers reports; the new version is made by arithmetic on keys.
Two pairs go as one: `changed`, and `same`, whose new version is the old one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import engine
from ..functions import text as T
from ..operators import compare, diff, graph, match, resolve, rules
from ..sources.dictionary import NAMESPACE, TYPES
from ..storage import cut


def read(spark, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _s(c: str) -> Column:
    return F.col(c).cast("string")


def _union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _none(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def _map(**members: Column) -> Column:
    return F.map_from_entries(F.array(*[F.struct(F.lit(k), v) for k, v in members.items()]))


def _subject(df: DataFrame, side: str, kind: str, key: Column, native: Column, name: Column, roles: Column | None = None, opaque: Column | None = None, **fields: Column) -> DataFrame:
    own = _map(implementation_id=T.json_text(native), name=T.json_text(name), unknown_extensions=F.when(F.coalesce(F.size(opaque) > 0, F.lit(False)), F.lit('["?"]')).otherwise("[]") if opaque is not None else F.lit("[]"), **fields)
    sizes = roles if roles is not None else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))
    return df.select(F.lit(side).alias("side"), F.lit(kind).alias("canonical_type"), key.alias("key"), native.cast("string").alias("implementation_id"), name.alias("name"), own.alias("fields"), sizes.alias("roles"), (opaque if opaque is not None else F.array().cast("array<string>")).alias("opaque"))


def _reference(df: DataFrame, side: str, owner: Column, field: str, idx: Column, targets: str, native: Column, name: Column) -> DataFrame:
    role = F.when(idx.isNull(), F.lit(field)).otherwise(F.concat(F.lit(field + "["), idx.cast("string"), F.lit("]")))
    return df.select(F.lit(side).alias("side"), owner.alias("owner_key"), F.lit(field).alias("field"), idx.cast("int").alias("idx"), role.alias("role"), F.array(F.lit(targets)).alias("target_types"), native.alias("implementation_id"), name.alias("name"))


def _side(spark, sf: str, side: str, changed: bool) -> tuple[DataFrame, DataFrame]:
    """(subjects, references) of one version; `changed` is the arithmetic of the new one."""
    n = read(spark, sf, "nation").select(F.col("n_nationkey").alias("n"), F.col("n_name"), F.col("n_regionkey").alias("r"))
    k, c = F.col("s_suppkey"), F.col("c_custkey")
    s = read(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n")).join(n.select(((F.col("n") + 24) % 25).alias("before"), F.col("n_name").alias("next_name")), F.col("s_nationkey") == F.col("before"))
    when = lambda ok, new, old: F.when(ok, new).otherwise(old) if changed else old
    if changed:
        s = s.filter(k % 10 != 3)
    variables = _subject(s, side, "status_variable", F.concat(F.lit("s"), k), _s("s_suppkey"), when(k % 4 == 0, F.concat("s_name", F.lit("!")), F.col("s_name")), F.create_map(F.lit("format"), F.lit(-1)),
                         when(k % 9 == 0, F.array(F.lit("unknown_extensions")), F.array().cast("array<string>")), units=when(k % 6 == 0, F.lit("[]"), F.concat(F.lit('["'), _s("s_nationkey"), F.lit('"]'))), description=when(k % 5 == 0, F.lit('"other"'), F.concat(F.lit('"of '), F.col("n_name"), F.lit('"'))))
    more = read(spark, sf, "supplier").filter(k % 10 == 5) if changed else None
    formats = _subject(n, side, "variable_format", F.concat(F.lit("n"), F.col("n")), _none(), F.col("n_name"))
    events = _subject(read(spark, sf, "region"), side, "collection_event", F.concat(F.lit("r"), F.col("r_regionkey")), _s("r_regionkey"), F.col("r_name"))
    customers = read(spark, sf, "customer")
    reports = _subject(customers, side, "default_report", F.concat(F.lit("c"), c), _s("c_custkey"), F.col("c_name"), F.create_map(F.lit("variables"), F.lit(2)))
    itself = _subject(read(spark, sf, "region").filter("r_regionkey = 0"), side, "equipment_interface", _none(), _none(), _none(), reports_can_be_deleted=F.lit("false" if changed else "true"))
    subjects = [variables, formats, events, reports, itself]
    if more is not None:
        subjects.append(_subject(more, side, "status_variable", F.concat(F.lit("x"), k), (k + 1_000_000).cast("string"), F.col("s_name"), F.create_map(F.lit("format"), F.lit(-1))))
    wanted = when(k % 7 == 0, F.col("next_name"), when(k % 8 == 1, F.lit("nowhere"), F.col("n_name")))
    refs = [_reference(s, side, F.concat(F.lit("s"), k), "format", _none("int"), "variable_format", _none(), wanted)]
    if more is not None:
        named = more.join(n, F.col("s_nationkey") == F.col("n"))
        refs.append(_reference(named, side, F.concat(F.lit("x"), k), "format", _none("int"), "variable_format", _none(), F.col("n_name")))
    first, second = (c % 10 + 1).cast("string"), (c % 7 + 1).cast("string")
    swap = c % 3 == 0
    for i, (own, other) in enumerate(((first, second), (second, first))):
        refs.append(_reference(customers, side, F.concat(F.lit("c"), c), "variables", F.lit(i), "status_variable", when(swap, other, own), _none()))
    return _union(*subjects), _union(*refs)


def _changes(spark, sf: str) -> compare.ChangeSet:
    pair = lambda df, name: df.withColumn("pair", F.lit(name))
    old, new, again = _side(spark, sf, "old", False), _side(spark, sf, "new", True), _side(spark, sf, "new", False)
    subjects, references = (_union(pair(old[i], "changed"), pair(new[i], "changed"), pair(old[i], "same"), pair(again[i], "same")) for i in (0, 1))
    subjects = cut(subjects, "subjects")
    resolved = resolve.resolve(references, subjects.filter("key is not null"), by=["pair", "side"])
    return compare.compare_interfaces(subjects, cut(resolved, "resolved"), ["pair"])


def compare_properties(spark, sf):
    """Changed fields with their kinds; the interface itself among them."""
    return _changes(spark, sf).properties.select("pair", F.coalesce("old_key", F.lit("")).alias("key"), "field", "kind", "category", "before", "after")


def compare_entities(spark, sf):
    """Entities added, removed and modified, with all kinds of their changes."""
    e = _changes(spark, sf).entity_changes
    return e.select("pair", "kind", "canonical_type", F.coalesce("old_key", F.lit("")).alias("old_key"), F.coalesce("new_key", F.lit("")).alias("new_key"), F.array_join("kinds", ",").alias("kinds"), F.array_join("categories", ",").alias("categories"))


def relationship_change(spark, sf):
    """Roles whose ends changed through the matches, how sure that is, what they gained and lost, and whether only their order did."""
    r = _changes(spark, sf).roles
    return r.select("pair", F.col("old_key").alias("key"), "field", "kind", "category", F.size("added").cast("long").alias("n_added"), F.size("removed").cast("long").alias("n_removed"), "order_changed", "presence_changed")


def issue_sweep(spark, sf):
    """What keeps the comparisons from being complete."""
    return _changes(spark, sf).issues.groupBy("pair", "side", "kind", "canonical_type", "field").agg(F.count("*").alias("n")).withColumn("field", F.coalesce("field", F.lit("")))


def report_summary(spark, sf):
    return _changes(spark, sf).summary.select("pair", "matched", "changed_entities", "added", "removed", "changes", "interface_changes", "documentation_changes", "unknown_changes", "unresolved")


def completeness(spark, sf):
    """One pair that is complete and one that isn't."""
    return _changes(spark, sf).summary.select("pair", "is_complete", "has_interface_changes", "has_documentation_changes")


_PAIRS = """
WITH s AS (SELECT s_suppkey AS k, s_name AS name, n_name AS nation, s_nationkey AS n, s_suppkey % 10 = 3 AS gone FROM supplier JOIN nation ON n_nationkey = s_nationkey),
stay AS (SELECT * FROM s WHERE NOT gone),
p AS (
  SELECT 's' || k AS key, 'name' AS field, 'NAME_CHANGED' AS kind, 'INTERFACE_CHANGE' AS category, '"' || name || '"' AS before, '"' || name || '!"' AS after FROM stay WHERE k % 4 = 0
  UNION ALL SELECT 's' || k, 'units', 'UNIT_CHANGED', 'INTERFACE_CHANGE', '["' || n || '"]', '[]' FROM stay WHERE k % 6 = 0
  UNION ALL SELECT 's' || k, 'description', 'DESCRIPTION_CHANGED', 'DOCUMENTATION_CHANGE', '"of ' || nation || '"', '"other"' FROM stay WHERE k % 5 = 0
  UNION ALL SELECT 's' || k, 'unknown_extensions', 'UNKNOWN_CHANGE', 'UNKNOWN_CHANGE', '[]', '["?"]' FROM stay WHERE k % 9 = 0
  UNION ALL SELECT '', 'reports_can_be_deleted', 'INTERFACE_METADATA_CHANGED', 'INTERFACE_CHANGE', 'true', 'false'),
there AS (SELECT k FROM s),
ends AS (SELECT c_custkey AS c, c_custkey % 10 + 1 AS a, c_custkey % 7 + 1 AS b, c_custkey % 3 = 0 AS swap FROM customer),
tok AS (SELECT c, swap, a, b,
  CASE WHEN a NOT IN (SELECT k FROM there) THEN 'x' || a WHEN a % 10 = 3 THEN 'u' || a ELSE 'm' || a END AS oa, CASE WHEN b NOT IN (SELECT k FROM there) THEN 'x' || b WHEN b % 10 = 3 THEN 'u' || b ELSE 'm' || b END AS ob,
  CASE WHEN a NOT IN (SELECT k FROM stay) THEN 'x' || a ELSE 'm' || a END AS na, CASE WHEN b NOT IN (SELECT k FROM stay) THEN 'x' || b ELSE 'm' || b END AS nb FROM ends),
lists AS (SELECT c, [oa, ob] AS o, CASE WHEN swap THEN [nb, na] ELSE [na, nb] END AS n, (oa LIKE 'x%' OR ob LIKE 'x%' OR na LIKE 'x%' OR nb LIKE 'x%') AS unsure FROM tok),
items AS (SELECT c, x, sum(w) AS w FROM (SELECT c, unnest(n) AS x, 1 AS w FROM lists UNION ALL SELECT c, unnest(o), -1 FROM lists) GROUP BY c, x),
delta AS (SELECT c, sum(CASE WHEN w > 0 THEN w ELSE 0 END) AS up, sum(CASE WHEN w < 0 THEN -w ELSE 0 END) AS down FROM items GROUP BY c),
r AS (
  SELECT 's' || k AS key, 'status_variable' AS type, 'format' AS field, 'FORMAT_CHANGED' AS kind, CASE WHEN k % 7 <> 0 AND k % 8 = 1 THEN 'UNKNOWN_CHANGE' ELSE 'INTERFACE_CHANGE' END AS category, CAST(1 AS BIGINT) AS n_added, CAST(1 AS BIGINT) AS n_removed, false AS order_changed FROM stay WHERE k % 7 = 0 OR k % 8 = 1
  UNION ALL SELECT 'c' || c, 'default_report', 'variables', 'REPORT_CONTENT_CHANGED', CASE WHEN unsure THEN 'UNKNOWN_CHANGE' ELSE 'INTERFACE_CHANGE' END, CAST(up AS BIGINT), CAST(down AS BIGINT), up = 0 AND down = 0 FROM lists JOIN delta USING (c) WHERE o <> n),
parts AS (
  SELECT key, CASE WHEN key = '' THEN 'equipment_interface' ELSE 'status_variable' END AS type, kind, category FROM p
  UNION ALL SELECT key, type, kind, category FROM r
  UNION ALL SELECT key, type, 'RELATIONSHIP_ADDED', category FROM r WHERE category = 'INTERFACE_CHANGE' AND n_added > 0
  UNION ALL SELECT key, type, 'RELATIONSHIP_REMOVED', category FROM r WHERE category = 'INTERFACE_CHANGE' AND n_removed > 0
  UNION ALL SELECT DISTINCT key, type, 'ENTITY_MODIFIED', category FROM (SELECT key, CASE WHEN key = '' THEN 'equipment_interface' ELSE 'status_variable' END AS type, category FROM p UNION ALL SELECT key, type, category FROM r)),
e AS (
  SELECT 'ENTITY_MODIFIED' AS kind, type AS canonical_type, key AS old_key, key AS new_key, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM parts GROUP BY type, key
  UNION ALL SELECT 'ENTITY_REMOVED', 'status_variable', 's' || k, '', 'ENTITY_REMOVED', 'INTERFACE_CHANGE' FROM s WHERE gone
  UNION ALL SELECT 'ENTITY_ADDED', 'status_variable', '', 'x' || k, 'ENTITY_ADDED', 'INTERFACE_CHANGE' FROM s WHERE k % 10 = 5),
lost AS (SELECT c, 0 AS i, CASE WHEN swap THEN b ELSE a END AS k FROM ends UNION ALL SELECT c, 1, CASE WHEN swap THEN a ELSE b END FROM ends),
i AS (
  SELECT 'new' AS side, 'UNKNOWN_CONTENT' AS kind, 'status_variable' AS canonical_type, 'unknown_extensions' AS field FROM stay WHERE k % 9 = 0
  UNION ALL SELECT 'new', 'UNRESOLVED_REFERENCE', 'status_variable', 'format' FROM stay WHERE k % 7 <> 0 AND k % 8 = 1
  UNION ALL SELECT 'new', 'UNRESOLVED_REFERENCE', 'default_report', 'variables[' || i || ']' FROM lost WHERE k NOT IN (SELECT k FROM stay))
"""


def _entity_rows(spark, sf: str) -> DataFrame:
    """Both versions of suppliers as entities of four types; identities that are blank or unverified give no tokens."""
    s = read(spark, sf, "supplier")
    k = F.col("s_suppkey")
    kind = F.when(k % 4 == 0, "status_variable").when(k % 4 == 1, "remote_command").when(k % 4 == 2, "supported_message").otherwise("standard_reference")
    base = s.select(k, F.concat(F.lit("e"), k).alias("key"), kind.alias("canonical_type"), F.when(k % 8 == 0, F.lit("  ")).otherwise(_s("s_suppkey")).alias("implementation_id"), F.col("s_name").alias("name"), F.when(k % 3 != 0, F.concat(F.lit("d"), k)).alias("designation"),
                    (k % 100).cast("string").alias("stream"), F.when(k % 5 != 0, _s("s_nationkey")).alias("function"), F.concat(F.lit("w"), k).alias("wkn_value"), F.lit("reg").alias("wkn_authority"), F.lit("demo").alias("wkn_scope"), F.when(k % 6 == 0, "verified").otherwise("unverified").alias("wkn_status"))
    return base.withColumn("side", F.explode(F.array(F.lit("old"), F.lit("new"))))


def match_signals(spark, sf):
    """The tokens of entities by strategy."""
    return match.signals(_entity_rows(spark, sf)).filter("side = 'old'").select("key", "canonical_type", "strategy", "value")


def match_conflict(spark, sf):
    """Components whose tokens collide, conflict within a pair, or tie one entity to two."""
    s = read(spark, sf, "supplier")
    k = F.col("s_suppkey")
    token = lambda side, key, strategy, value, ok: s.filter(ok).select(F.lit(side).alias("side"), F.concat(F.lit("e"), key).alias("key"), F.lit(strategy).alias("strategy"), F.concat(F.lit("v"), value).alias("value"))
    kind = k % 5
    every = F.lit(True)
    # 0: id and name agree. 1: the id agrees, the names differ. 2: the name is the next entity's. 3: ids differ, names agree. 4: two old ones share an id.
    tokens = _union(
        token("old", k, "NATIVE_ID", F.when(kind == 4, F.lit(4)).otherwise(k).cast("string"), every), token("new", k, "NATIVE_ID", F.when(kind == 3, -k).otherwise(k).cast("string"), kind != 4),
        token("old", k, "WELL_KNOWN_NAME", k.cast("string"), kind != 4), token("new", k, "WELL_KNOWN_NAME", F.when(kind == 1, -k).when(kind == 2, k + 5).otherwise(k).cast("string"), kind != 4),
    )
    entities = tokens.select("side", "key").distinct()
    c = match.outcomes(entities, tokens)
    return c.groupBy("outcome", "reason", "confidence", "strategy", F.least("o", F.lit(2)).alias("o"), F.least("n", F.lit(2)).alias("n")).agg(F.sum(F.col("o") + F.col("n")).alias("entities"))


def _staged(spark, sf: str) -> match.Matching:
    """Suppliers as events and commands, a link and parts as parameters below them."""
    s, k = read(spark, sf, "supplier"), F.col("s_suppkey")
    n = s.count()
    moved = lambda side: F.when((k % 10 == 3) & (F.lit(side) == "new"), -k).otherwise(k).cast("string")
    columns = ["side", "key", "canonical_type", "implementation_id", "name", "owner_key"]
    entities, references = [], []
    for side in ("old", "new"):
        one = lambda kind, prefix, native, name, rows=s, side=side: rows.select(F.lit(side).alias("side"), F.concat(F.lit(prefix), k).alias("key"), F.lit(kind).alias("canonical_type"), native.alias("implementation_id"), name.alias("name"), _none().alias("owner_key"))
        entities += [one("collection_event", "e", moved(side), _none()), one("remote_command", "c", _none(), moved(side)), one("event_report_link", "l", _none(), _none())]
        references.append(s.select(F.lit(side).alias("side"), F.concat(F.lit("l"), k).alias("owner_key"), F.concat(F.lit("e"), k).alias("target_key")))
        if side == "old":
            twice = s.filter(k % 10 == 4)
            entities.append(one("event_report_link", "m", _none(), _none(), twice))
            references.append(twice.select(F.lit(side).alias("side"), F.concat(F.lit("m"), k).alias("owner_key"), F.concat(F.lit("e"), k).alias("target_key")))
        parts = read(spark, sf, "part").withColumn("of", F.col("p_partkey") % n + 1)
        name = F.when((F.col("p_partkey") % 9 == 0) & (F.lit(side) == "new"), F.lit("renamed")).otherwise(F.concat("p_name", F.lit(" "), "p_size"))
        entities.append(parts.select(F.lit(side).alias("side"), F.concat(F.lit("p"), F.col("p_partkey")).alias("key"), F.lit("remote_command_parameter").alias("canonical_type"), _none().alias("implementation_id"), name.alias("name"), F.concat(F.lit("c"), F.col("of")).alias("owner_key")))
    references = _union(*references).withColumn("role", F.lit("event")).withColumn("state", F.lit(resolve.RESOLVED))
    one = lambda df: df.withColumn("pair", F.lit(1))
    return match.match_interfaces(one(_union(*[e.select(*columns) for e in entities])), one(references), ["pair"])


def _outcomes(m: match.Matching, kind: str) -> DataFrame:
    rows = _union(
        m.matches.select("canonical_type", F.lit("match").alias("outcome"), F.col("strategy").alias("reason"), F.lit(2).alias("entities")),
        m.members.filter("outcome = 'ambiguous'").select("canonical_type", "outcome", F.array_join("reasons", ",").alias("reason"), F.lit(1).alias("entities")),
        m.unmatched.select("canonical_type", F.lit("unmatched").alias("outcome"), "reason", F.lit(1).alias("entities")),
    )
    return rows.filter(F.col("canonical_type") == kind).groupBy("outcome", "reason").agg(F.sum("entities").alias("entities"))


def match_links(spark, sf):
    """Links match by the match of their event: not where the event has none, not where two links share one."""
    return _outcomes(_staged(spark, sf), "event_report_link")


def match_parameters(spark, sf):
    """Parameters match by name within the match of their command, and wait where it has none."""
    return _outcomes(_staged(spark, sf), "remote_command_parameter")


def match_evidence(spark, sf):
    """Matches with the tokens that prove them."""
    m = _staged(spark, sf).matches.filter("canonical_type <> 'remote_command_parameter'")
    return m.select("old_key", "new_key", "strategy", "confidence", F.transform("evidence", lambda e: F.concat(e["strategy"], F.lit(" "), e["identity"]))[0].alias("proof"), F.size("evidence").cast("long").alias("n"))


#: Fields of the classification query, and the entity types in the order of the dialect.
FIELDS = ("implementation_id", "wkn", "name", "description", "declared_source", "notes", "created_date", "data_type", "units", "minimum", "maximum", "default", "state_transition", "state_transition.extensions", "structure", "structure.documentation", "structure.extensions", "value_format", "requirements", "requirements.documentation", "format.metadata", "unknown_extensions", "extension_metadata", "code", "header")


def _combinations(spark, sf: str) -> DataFrame:
    p = read(spark, sf, "part").select(F.col("p_partkey").alias("k"))
    kinds = ("equipment_interface", "equipment_metadata", *TYPES)
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))
    return p.select("k", pick(kinds, F.col("k")).alias("canonical_type"), pick(FIELDS, F.floor(F.col("k") / len(kinds))).alias("field"))


def diff_kinds(spark, sf):
    """Kind, category and public code of changed fields of every type."""
    c = diff.classified(_combinations(spark, sf))
    return c.select("k", "kind", "category", diff.change_code(F.col("canonical_type"), F.col("kind")).alias("code"))


def role_kinds(spark, sf):
    """Kind of changed roles by role, owner and which side is empty."""
    p = read(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_size"))
    k = F.col("k")
    role = F.element_at(F.array(*map(F.lit, ("format", "standards", "parameters", "set_event", "variables", "event", "valid_data_variables"))), (k % 7 + 1).cast("int"))
    owner = F.element_at(F.array(*map(F.lit, ("alarm", "default_report", "event_report_link", "collection_event"))), (F.floor(k / 7) % 4 + 1).cast("int"))
    return p.select("k", diff.role_kind(role, owner, k % 2, F.floor(k / 2) % 2).alias("kind"))


def _graph(spark, sf: str) -> tuple[DataFrame, DataFrame]:
    """(relationships, entities): customers as reports of two suppliers each, orders as links of a nation's event to their customer's report."""
    row = lambda df, owner, role, target: df.select(owner.alias("owner_key"), F.lit(role).alias("role"), F.lit(resolve.RESOLVED).alias("state"), target.alias("target_key"), F.lit(0).alias("doc"))
    c, o = read(spark, sf, "customer"), read(spark, sf, "orders")
    at = lambda p, col: F.concat(F.lit(p), col)
    events = o.join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    rel = _union(
        row(c, at("c", F.col("c_custkey")), "variables[0]", at("s", F.col("c_custkey") % 10 + 1)), row(c, at("c", F.col("c_custkey")), "variables[1]", at("s", F.col("c_custkey") % 7 + 1)),
        row(events, at("o", F.col("o_orderkey")), "reports[0]", at("c", F.col("o_custkey"))), row(events, at("o", F.col("o_orderkey")), "event", at("n", F.col("c_nationkey") % 5)),
    )
    entity = lambda name, p, key, kind: read(spark, sf, name).select(at(p, F.col(key)).alias("key"), F.lit(kind).alias("canonical_type"), F.lit(0).alias("doc"))
    return rel, _union(entity("supplier", "s", "s_suppkey", "status_variable"), entity("customer", "c", "c_custkey", "default_report"), entity("orders", "o", "o_orderkey", "event_report_link"), entity("nation", "n", "n_nationkey", "collection_event"))


def dep_contexts(spark, sf):
    """Distinct entities by subject and kind of dependency, and how many proofs each has."""
    rel, entities = _graph(spark, sf)
    ctx = graph.contexts(graph.dependencies(rel, entities, ["doc"]), ["doc"])
    return ctx.groupBy("subject", "kind").agg(F.count("*").alias("entities"), F.sum(F.size("evidence")).cast("long").alias("proofs"))


def dep_statements(spark, sf):
    """What is said of the suppliers and reports."""
    rel, entities = _graph(spark, sf)
    said = graph.statements(graph.dependencies(rel, entities, ["doc"]), ["doc"])
    return said.filter("subject not like 'n%'").select("subject", F.array_join("statements", " ").alias("said"))


_GRAPH = """
WITH c AS (SELECT c_custkey AS c, c_nationkey % 5 AS e, x.v AS s FROM customer, LATERAL (SELECT unnest([c_custkey % 10 + 1, c_custkey % 7 + 1]) AS v) x WHERE x.v IN (SELECT s_suppkey FROM supplier)),
slots AS (SELECT c, e, s, count(*) AS times FROM c GROUP BY c, e, s),
o AS (SELECT o_orderkey AS o, o_custkey AS c, c_nationkey % 5 AS e FROM orders JOIN customer ON c_custkey = o_custkey),
d AS (
  SELECT 's' || s AS subject, 'REFERENCED_BY' AS kind, 'c' || c AS entity, times AS proofs FROM slots
  UNION ALL SELECT 'c' || c, 'REFERENCED_BY', 'o' || o, 1 FROM o
  UNION ALL SELECT 'n' || e, 'REFERENCED_BY', 'o' || o, 1 FROM o
  UNION ALL SELECT 'n' || e, 'LINKED_REPORT', 'c' || c, count(*) FROM o GROUP BY e, c
  UNION ALL SELECT 'c' || c, 'LINKED_EVENT', 'n' || e, count(*) FROM o GROUP BY c, e
  UNION ALL SELECT 's' || s, 'EVENT_VIA_REPORT', 'n' || o.e, sum(times) FROM slots JOIN o ON o.c = slots.c GROUP BY s, o.e),
g AS (SELECT subject, kind, count(*) AS entities, CAST(sum(proofs) AS BIGINT) AS proofs FROM d GROUP BY subject, kind)
"""


def _documents(spark, sf: str, changed: bool = False) -> DataFrame:
    """(doc_id, content): a document a nation, with its suppliers as variables and a report on them all."""
    s, k = read(spark, sf, "supplier"), F.col("s_suppkey")
    el = lambda tag, *inner: F.concat(F.lit(f"<{tag}>"), *inner, F.lit(f"</{tag}>"))
    name = F.when((k % 3 == 0) & F.lit(changed), F.concat("s_name", F.lit(" new"))).otherwise(F.col("s_name"))
    odd = F.when(k % 5 == 0, F.lit("<Odd x='1'>kept</Odd>")).otherwise("")
    twice = F.when(k % 7 == 0, F.lit("<UNITS/><MinValue>1</MinValue><MinValue>2</MinValue>")).otherwise("<MinValue> 0</MinValue>")
    one = el("StatusVariable", el("SVID", _s("s_suppkey")), el("SVNAME", name), twice, odd)
    ids = F.when(k % 4 == 0, F.lit("<VID>none</VID>")).otherwise(el("VID", _s("s_suppkey")))
    lists = s.groupBy("s_nationkey").agg(*[F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), c.alias("x")))), lambda r: r["x"]), "").alias(n) for n, c in (("status", one), ("ids", ids))])
    report = el("DefaultReportDefinition", F.lit("<RPTID>1</RPTID><DefaultReportName>all</DefaultReportName><Description>d</Description>"), el("VIDList", F.col("ids")))
    empty = "".join(f"<{t}/>" for t in ("CollectionEvents", "DataVariables", "EquipmentConstants", "Alarms", "VariableFormats"))
    head = f'<s:DataDictionary xmlns:s="{NAMESPACE}" xmlns:i="http://www.w3.org/2001/XMLSchema-instance" i:schemaLocation="{NAMESPACE} E172-0225-SEDD-Schema.xsd"><SEDDHeader><MDLN>M</MDLN><SOFTREV>1</SOFTREV></SEDDHeader>{empty}'
    body = F.concat(F.lit(head), el("StatusVariables", F.col("status")), el("DefaultReportDefinitions", report), F.lit("</s:DataDictionary>"))
    return lists.select(F.concat(F.lit("new/" if changed else "old/"), _s("s_nationkey")).alias("doc_id"), body.cast("binary").alias("content"))


def xml_entities(spark, sf):
    """Entities of documents that are parsed and mapped on executors."""
    found = engine.from_files(_documents(spark, sf)).entities.filter("canonical_type = 'status_variable'")
    return found.select("doc_id", "implementation_id", "name", F.col("fields")["minimum"].alias("minimum"), F.col("fields")["units"].alias("units"), F.array_join("opaque", ",").alias("opaque"))


def xml_counts(spark, sf):
    """Entities by document and type, zeros included."""
    return engine.from_files(_documents(spark, sf)).counts()


def xml_references(spark, sf):
    """Outcomes of the references of documents, resolved within each."""
    r = engine.from_files(_documents(spark, sf)).relationships
    return r.groupBy("doc_id", "state", "reason").agg(F.count("*").alias("n"))


def xml_diagnostics(spark, sf):
    """Diagnostics of documents by code and severity, those of references among them."""
    return engine.from_files(_documents(spark, sf)).diagnostics.groupBy("doc_id", "code", "severity").agg(F.count("*").alias("n"))


def xml_extensions(spark, sf):
    """What no field names is kept whole."""
    return engine.from_files(_documents(spark, sf)).extensions.select("doc_id", "name", "reason", "json")


def xml_compare(spark, sf):
    """Every nation's document against its new version, all pairs at once."""
    old, new = engine.from_files(_documents(spark, sf)), engine.from_files(_documents(spark, sf, True))
    pairs = old.documents.select(F.substring_index("doc_id", "/", -1).alias("pair"), F.col("doc_id").alias("old_doc"), F.concat(F.lit("new/"), F.substring_index("doc_id", "/", -1)).alias("new_doc"))
    return engine.compare(old, new, pairs).summary.select("pair", "matched", "changed_entities", "interface_changes", "unresolved", "is_complete")


def reference_indexes(spark, sf):
    """Values under which parts and suppliers are known, with how many have each and the least key."""
    e = read(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("key"), F.lit("part").alias("canonical_type"), _s("p_partkey").alias("implementation_id"), F.col("p_name").alias("name"))
    e = e.unionByName(read(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("key"), F.lit("remote_command").alias("canonical_type"), _none().alias("implementation_id"), F.col("s_name").alias("name")))
    return resolve.indexes(e).select("index", "canonical_type", "value", F.size("keys").cast("long").alias("n"), F.col("keys")[0].alias("least"))


def resolve_by_wkn(spark, sf):
    """Well-known names with authority and scope, NULL being a value of its own."""
    s, k = read(spark, sf, "supplier"), F.col("s_suppkey")
    scope = lambda n: F.when(k % n == 0, None).otherwise(F.lit("demo"))
    e = s.select(F.concat(F.lit("s"), k).alias("key"), F.lit("alarm").alias("canonical_type"), _none().alias("implementation_id"), _none().alias("name"), F.concat(F.lit("w"), k).alias("wkn_value"), F.lit("reg").alias("wkn_authority"), scope(3).alias("wkn_scope"))
    r = s.select(F.concat(F.lit("r"), k).alias("owner_key"), F.lit("x").alias("role"), F.array(F.when(k % 7 == 0, "collection_event").otherwise("alarm")).alias("target_types"), _none().alias("implementation_id"), _none().alias("name"), F.concat(F.lit("w"), k).alias("wkn_value"), F.lit("reg").alias("wkn_authority"), scope(2).alias("wkn_scope"))
    return resolve.resolve(r, e).select("owner_key", "state", "reason", "target_key")


def resolve_union(spark, sf):
    """Names reach standards by name or by designation, and only where standards are asked for."""
    n = read(spark, sf, "nation")
    e = n.select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("key"), F.when(F.col("n_nationkey") % 2 == 0, "standard_reference").otherwise("variable_format").alias("canonical_type"), _none().alias("implementation_id"), F.col("n_name").alias("name"), F.concat(F.lit("d"), F.col("n_regionkey")).alias("designation"))
    s, k = read(spark, sf, "supplier"), F.col("s_suppkey")
    r = s.select(F.concat(F.lit("r"), k).alias("owner_key"), F.lit("x").alias("role"), F.array(F.when(k % 3 == 0, "variable_format").otherwise("standard_reference")).alias("target_types"), _none().alias("implementation_id"), F.concat(F.lit("d"), k % 6).alias("name"))
    return resolve.resolve(r, e).select("owner_key", "state", "reason", "n_candidates")


def check_rules(spark, sf):
    """Integrity rules over rows that are spoilt on purpose: how many rows break each."""
    s, k = read(spark, sf, "supplier"), F.col("s_suppkey")
    spoilt = lambda n: k % n == 0
    base = s.select(k, F.when(spoilt(11), F.lit(" \u2003")).otherwise(F.concat(F.lit("s"), k)).alias("key"), F.lit("remote_command_parameter").alias("canonical_type"), F.concat(F.lit("c"), k % 3).alias("owner_key"), F.lit("w").alias("wkn_value"),
                    F.when(~spoilt(7), F.lit("reg")).alias("wkn_authority"), F.lit("demo").alias("wkn_scope"), F.lit("verified").alias("wkn_status"), F.lit("/p").alias("path"), F.when(spoilt(5), 0).otherwise(3).alias("line"), F.lit(1).alias("col"), F.lit(0).alias("doc"))
    subjects = base.unionByName(base.filter(spoilt(13) & ~spoilt(11)))
    refs = s.filter(~spoilt(11)).select(k, F.lit(0).alias("doc"), F.when(spoilt(17), F.lit("nobody")).otherwise(F.concat(F.lit("s"), k)).alias("owner_key"), F.lit("format").alias("field"), F.lit("format").alias("role"),
                    F.when(spoilt(4), F.array(F.lit("alarm"), F.lit("alarm"))).otherwise(F.array(F.lit("remote_command_parameter"))).alias("target_types"), F.when(spoilt(9), F.lit("gone")).otherwise(F.concat(F.lit("s"), k)).alias("target_key"),
                    F.concat(F.lit("c"), F.when(spoilt(2), k % 3).otherwise((k + 1) % 3)).alias("scope_key"), F.array().cast("array<string>").alias("candidate_keys"), F.lit("RESOLVED").alias("state"), F.when(spoilt(19), "NOT_FOUND").alias("reason"), F.lit("/r").alias("path"), F.lit(1).alias("line"), F.lit(1).alias("col"))
    d = s.select(F.lit(0).alias("doc"), F.concat(F.lit("s"), k).alias("owner_key"), F.lit("CODE").alias("code"), F.when(spoilt(6), "").otherwise("said").alias("message"), F.when(spoilt(10), "FATAL").otherwise("INFO").alias("severity"))
    every = subjects.select("doc", "key", "canonical_type", "owner_key").unionByName(s.select(F.lit(0).alias("doc"), F.concat(F.lit("c"), k % 3).alias("key"), F.lit("remote_command").alias("canonical_type"), _none().alias("owner_key")).distinct())
    found = _union(rules.subjects(subjects, ["doc"]), rules.references(refs, ["doc"]), rules.relationships(refs, every.distinct(), ["doc"]), rules.diagnostics(d, ["doc"]))
    return found.groupBy("rule").agg(F.count("*").alias("n"))


_DOCS = "WITH s AS (SELECT s_suppkey AS k, s_name AS name, 'old/' || s_nationkey AS doc_id, CAST(s_nationkey AS VARCHAR) AS pair FROM supplier)"
_KIND_SQL = """CASE WHEN f IN ('state_transition.extensions', 'structure.extensions', 'format.metadata', 'unknown_extensions', 'extension_metadata') THEN 'UNKNOWN_CHANGE'
  WHEN f = 'structure.documentation' THEN 'DESCRIPTION_CHANGED' WHEN f = 'requirements.documentation' THEN 'DOCUMENTATION_CHANGED' WHEN f = 'implementation_id' THEN 'IMPLEMENTATION_ID_CHANGED' WHEN f = 'wkn' THEN 'WELL_KNOWN_NAME_CHANGED'
  WHEN f = 'name' THEN 'NAME_CHANGED' WHEN f = 'description' THEN 'DESCRIPTION_CHANGED' WHEN f IN ('declared_source', 'notes', 'created_date') THEN 'DOCUMENTATION_CHANGED' WHEN f = 'data_type' THEN 'DATA_TYPE_CHANGED' WHEN f = 'units' THEN 'UNIT_CHANGED'
  WHEN f IN ('minimum', 'maximum') THEN 'RANGE_CHANGED' WHEN f = 'default' THEN 'DEFAULT_CHANGED' WHEN f = 'state_transition' THEN 'STATE_TRANSITION_CHANGED' WHEN f = 'structure' AND t = 'supported_message' THEN 'MESSAGE_STRUCTURE_CHANGED'
  WHEN f = 'structure' AND t = 'variable_format' THEN 'FORMAT_CHANGED' WHEN t = 'supported_message' THEN 'SUPPORTED_MESSAGE_CHANGED' WHEN t = 'remote_command_parameter' THEN 'COMMAND_PARAMETER_CHANGED' WHEN t = 'remote_command' THEN 'COMMAND_CHANGED'
  WHEN t = 'standard_reference' THEN 'STANDARD_METADATA_CHANGED' WHEN t = 'equipment_metadata' THEN 'EQUIPMENT_METADATA_CHANGED' WHEN t = 'equipment_interface' THEN 'INTERFACE_METADATA_CHANGED' WHEN t = 'alarm' THEN 'ALARM_CHANGED' ELSE 'UNKNOWN_CHANGE' END"""
_TYPE_LIST = "['equipment_interface', 'equipment_metadata', 'status_variable', 'data_variable', 'equipment_constant', 'collection_event', 'alarm', 'remote_command', 'remote_command_parameter', 'supported_message', 'variable_format', 'default_report', 'event_report_link', 'standard_reference']"

ORACLE = {
    "compare_properties": _PAIRS + "SELECT 'changed' AS pair, * FROM p",
    "compare_entities": _PAIRS + "SELECT 'changed' AS pair, * FROM e",
    "relationship_change": _PAIRS + "SELECT 'changed' AS pair, key, field, kind, category, n_added, n_removed, order_changed, false AS presence_changed FROM r",
    "issue_sweep": _PAIRS + "SELECT 'changed' AS pair, side, kind, canonical_type, field, count(*) AS n FROM i GROUP BY side, kind, canonical_type, field",
    "report_summary": _PAIRS + """, every AS (SELECT (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) + (SELECT count(*) FROM customer) AS n)
      SELECT 'same' AS pair, n + (SELECT count(*) FROM s) AS matched, 0 AS changed_entities, 0 AS added, 0 AS removed, 0 AS changes, 0 AS interface_changes, 0 AS documentation_changes, 0 AS unknown_changes, 0 AS unresolved FROM every
      UNION ALL SELECT 'changed', n + (SELECT count(*) FROM stay), (SELECT count(*) FROM e), (SELECT count(*) FROM e WHERE kind = 'ENTITY_ADDED'), (SELECT count(*) FROM e WHERE kind = 'ENTITY_REMOVED'),
        (SELECT count(*) FROM p) + (SELECT count(*) FROM r) + (SELECT count(*) FROM e WHERE kind <> 'ENTITY_MODIFIED'), (SELECT count(*) FROM p WHERE category = 'INTERFACE_CHANGE') + (SELECT count(*) FROM r WHERE category = 'INTERFACE_CHANGE') + (SELECT count(*) FROM e WHERE kind <> 'ENTITY_MODIFIED'),
        (SELECT count(*) FROM p WHERE category = 'DOCUMENTATION_CHANGE'), (SELECT count(*) FROM p WHERE category = 'UNKNOWN_CHANGE') + (SELECT count(*) FROM r WHERE category = 'UNKNOWN_CHANGE'), (SELECT count(*) FROM i) FROM every""",
    "completeness": "SELECT 'same' AS pair, true AS is_complete, false AS has_interface_changes, false AS has_documentation_changes UNION ALL SELECT 'changed', false, true, true",
    "match_signals": """WITH s AS (SELECT s_suppkey AS k, s_name AS name, s_nationkey AS n, 'e' || s_suppkey AS key, CASE s_suppkey % 4 WHEN 0 THEN 'status_variable' WHEN 1 THEN 'remote_command' WHEN 2 THEN 'supported_message' ELSE 'standard_reference' END AS canonical_type FROM supplier)
      SELECT key, canonical_type, 'NATIVE_ID' AS strategy, '["' || k || '"]' AS value FROM s WHERE k % 4 = 0 AND k % 8 <> 0
      UNION ALL SELECT key, canonical_type, 'COMMAND_NAME', '["' || name || '"]' FROM s WHERE k % 4 = 1
      UNION ALL SELECT key, canonical_type, 'STREAM_FUNCTION', '["' || k % 100 || '","' || n || '"]' FROM s WHERE k % 4 = 2 AND k % 5 <> 0
      UNION ALL SELECT key, canonical_type, 'STANDARD_DESIGNATION', '["d' || k || '"]' FROM s WHERE k % 4 = 3 AND k % 3 <> 0
      UNION ALL SELECT key, canonical_type, 'WELL_KNOWN_NAME', '["reg","demo","w' || k || '"]' FROM s WHERE k % 6 = 0""",
    "match_conflict": """WITH s AS (SELECT s_suppkey AS k, s_suppkey % 5 AS kind FROM supplier), chain AS (SELECT count(*) AS n FROM s WHERE kind = 2), four AS (SELECT count(*) AS n FROM s WHERE kind = 4),
      x AS (SELECT 'match' AS outcome, NULL AS reason, 'CORROBORATED' AS confidence, 'NATIVE_ID' AS strategy, 1 AS o, 1 AS n, 2 AS entities FROM s WHERE kind = 0
        UNION ALL SELECT 'match', NULL, 'VERIFIED_WKN', 'WELL_KNOWN_NAME', 1, 1, 2 FROM s WHERE kind = 3
        UNION ALL SELECT 'ambiguous', 'CONFLICTING_SIGNALS', NULL, NULL, 1, 1, 2 FROM s WHERE kind = 1
        UNION ALL SELECT CASE WHEN n > 1 THEN 'ambiguous' ELSE 'ambiguous' END, 'CONFLICTING_SIGNALS', NULL, NULL, least(n, 2), least(n, 2), 2 * n FROM chain WHERE n > 0
        UNION ALL SELECT CASE WHEN n > 1 THEN 'ambiguous' ELSE 'unmatched' END, CASE WHEN n > 1 THEN 'IDENTITY_COLLISION' ELSE 'NO_COUNTERPART' END, NULL, NULL, least(n, 2), 0, n FROM four WHERE n > 0)
      SELECT outcome, reason, confidence, strategy, CAST(o AS BIGINT) AS o, CAST(n AS BIGINT) AS n, CAST(sum(entities) AS BIGINT) AS entities FROM x GROUP BY outcome, reason, confidence, strategy, o, n""",
    "match_links": """SELECT outcome, reason, CAST(sum(entities) AS BIGINT) AS entities FROM (SELECT CASE s_suppkey % 10 WHEN 3 THEN 'unmatched' WHEN 4 THEN 'ambiguous' ELSE 'match' END AS outcome,
      CASE s_suppkey % 10 WHEN 3 THEN 'NO_USABLE_IDENTITY' WHEN 4 THEN 'IDENTITY_COLLISION' ELSE 'EVENT_IDENTITY' END AS reason, CASE s_suppkey % 10 WHEN 4 THEN 3 ELSE 2 END AS entities FROM supplier) GROUP BY outcome, reason""",
    "match_parameters": """WITH p AS (SELECT p_partkey AS k, p_name || ' ' || p_size AS name, p_partkey % (SELECT count(*) FROM supplier) + 1 AS c FROM part), ok AS (SELECT s_suppkey AS c FROM supplier WHERE s_suppkey % 10 <> 3), lost AS (SELECT * FROM p WHERE c NOT IN (SELECT c FROM ok)),
      t AS (SELECT c, name, sum(o) AS o, sum(n) AS n FROM (SELECT c, name, 1 AS o, 0 AS n FROM p WHERE c IN (SELECT c FROM ok) UNION ALL SELECT c, CASE WHEN k % 9 = 0 THEN 'renamed' ELSE name END, 0, 1 FROM p WHERE c IN (SELECT c FROM ok)) GROUP BY c, name),
      x AS (SELECT CASE WHEN o = 1 AND n = 1 THEN 'match' WHEN o + n > 1 THEN 'ambiguous' ELSE 'unmatched' END AS outcome, CASE WHEN o = 1 AND n = 1 THEN 'PARAMETER_NAME' WHEN o + n > 1 THEN 'IDENTITY_COLLISION' ELSE 'NO_COUNTERPART' END AS reason, o + n AS entities FROM t
        UNION ALL SELECT 'unmatched', 'NO_CONFIRMED_COMMAND_SCOPE', 2 FROM lost)
      SELECT outcome, reason, CAST(sum(entities) AS BIGINT) AS entities FROM x GROUP BY outcome, reason""",
    "match_evidence": """WITH s AS (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 10 <> 3)
      SELECT 'e' || k AS old_key, 'e' || k AS new_key, 'NATIVE_ID' AS strategy, 'EXACT_IDENTITY' AS confidence, 'NATIVE_ID ["' || k || '"]' AS proof, CAST(1 AS BIGINT) AS n FROM s
      UNION ALL SELECT 'c' || k, 'c' || k, 'COMMAND_NAME', 'EXACT_IDENTITY', 'COMMAND_NAME ["' || k || '"]', 1 FROM s
      UNION ALL SELECT 'l' || k, 'l' || k, 'EVENT_IDENTITY', 'EXACT_IDENTITY', 'EVENT_IDENTITY ["e' || k || '","e' || k || '"]', 1 FROM s WHERE k % 10 <> 4""",
    "diff_kinds": f"""WITH x AS (SELECT p_partkey AS k, {_TYPE_LIST}[CAST(p_partkey % 14 + 1 AS INTEGER)] AS t, [{", ".join(f"'{f}'" for f in FIELDS)}][CAST((p_partkey // 14) % {len(FIELDS)} + 1 AS INTEGER)] AS f FROM part), y AS (SELECT k, t, {_KIND_SQL} AS kind FROM x)
      SELECT k, kind, CASE WHEN kind = 'UNKNOWN_CHANGE' THEN 'UNKNOWN_CHANGE' WHEN kind IN ('DESCRIPTION_CHANGED', 'DOCUMENTATION_CHANGED') THEN 'DOCUMENTATION_CHANGE' ELSE 'INTERFACE_CHANGE' END AS category,
        ['EI', 'EQ', 'SV', 'DV', 'EC', 'CE', 'AL', 'RC', 'RCP', 'SM', 'VF', 'DR', 'ERL', 'STD'][CAST(list_position({_TYPE_LIST}, t) AS INTEGER)] || '_' || kind AS code FROM y""",
    "role_kinds": """SELECT k, CASE r WHEN 0 THEN 'FORMAT_CHANGED' WHEN 1 THEN 'STANDARD_METADATA_CHANGED' WHEN 2 THEN 'COMMAND_PARAMETER_CHANGED' ELSE CASE o WHEN 0 THEN 'ALARM_EVENT_LINK_CHANGED' WHEN 1 THEN 'REPORT_CONTENT_CHANGED' WHEN 2 THEN 'EVENT_REPORT_LINK_CHANGED' ELSE
      CASE WHEN a = 0 AND b = 1 THEN 'RELATIONSHIP_ADDED' WHEN a = 1 AND b = 0 THEN 'RELATIONSHIP_REMOVED' ELSE 'RELATIONSHIP_CHANGED' END END END AS kind FROM (SELECT p_partkey AS k, p_partkey % 7 AS r, (p_partkey // 7) % 4 AS o, p_partkey % 2 AS a, (p_partkey // 2) % 2 AS b FROM part)""",
    "dep_contexts": _GRAPH + "SELECT * FROM g",
    "dep_statements": _GRAPH + """SELECT subject, string_agg(CASE kind WHEN 'REFERENCED_BY' THEN 'Referenced by ' WHEN 'LINKED_EVENT' THEN 'Linked from ' ELSE 'Linked through containing reports to ' END || entities || ' ' ||
      CASE WHEN kind <> 'REFERENCED_BY' THEN 'collection event' WHEN subject LIKE 's%' THEN 'default report' ELSE 'event/report link' END || CASE WHEN entities = 1 THEN '.' ELSE 's.' END, ' ' ORDER BY CASE kind WHEN 'REFERENCED_BY' THEN 0 ELSE 1 END) AS said FROM g WHERE subject NOT LIKE 'n%' GROUP BY subject""",
    "xml_entities": _DOCS + """ SELECT doc_id, CAST(k AS VARCHAR) AS implementation_id, name, CASE WHEN k % 7 = 0 THEN NULL ELSE '" 0"' END AS minimum, CASE WHEN k % 7 = 0 THEN '[""]' ELSE '[]' END AS units, CASE WHEN k % 7 = 0 OR k % 5 = 0 THEN 'unknown_extensions' ELSE '' END AS opaque FROM s""",
    "xml_counts": _DOCS + f""", t AS (SELECT unnest({_TYPE_LIST}[3:]) AS canonical_type), d AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id)
      SELECT doc_id, canonical_type, CASE canonical_type WHEN 'status_variable' THEN n WHEN 'default_report' THEN 1 ELSE 0 END AS n FROM d, t""",
    "xml_references": _DOCS + """ SELECT doc_id, CASE WHEN k % 4 = 0 THEN 'UNRESOLVED' ELSE 'RESOLVED' END AS state, CASE WHEN k % 4 = 0 THEN 'NOT_FOUND' END AS reason, count(*) AS n FROM s GROUP BY doc_id, k % 4 = 0""",
    "xml_diagnostics": _DOCS + """, x AS (SELECT DISTINCT doc_id, 'REVISION_HINT_ONLY' AS code, 'INFO' AS severity, 0 AS k FROM s UNION ALL SELECT doc_id, 'MISSING_OPTIONAL_METADATA', 'INFO', k FROM s UNION ALL SELECT doc_id, 'AMBIGUOUS_FIELD', 'ERROR', k FROM s WHERE k % 7 = 0
        UNION ALL SELECT doc_id, 'UNKNOWN_ELEMENT', 'WARNING', k FROM s WHERE k % 7 = 0 UNION ALL SELECT doc_id, 'UNKNOWN_ELEMENT', 'WARNING', k FROM s WHERE k % 7 = 0 UNION ALL SELECT doc_id, 'UNKNOWN_ELEMENT', 'WARNING', k FROM s WHERE k % 5 = 0
        UNION ALL SELECT doc_id, 'UNRESOLVED_REFERENCE', 'WARNING', k FROM s WHERE k % 4 = 0)
      SELECT doc_id, code, severity, count(*) AS n FROM x GROUP BY doc_id, code, severity""",
    "xml_extensions": _DOCS + """ SELECT doc_id, 'Odd' AS name, 'unmapped_content' AS reason, '{"attributes":{"x":"1"},"content":["kept"],"name":"Odd","namespace":null,"reason":"unmapped_content"}' AS json FROM s WHERE k % 5 = 0
      UNION ALL SELECT doc_id, 'MinValue', 'unmapped_content', '{"attributes":{},"content":["' || i || '"],"name":"MinValue","namespace":null,"reason":"unmapped_content"}' FROM s, (SELECT unnest([1, 2]) AS i) WHERE k % 7 = 0""",
    "xml_compare": _DOCS + """ SELECT pair, count(*) + 1 AS matched, count(*) FILTER (k % 3 = 0) AS changed_entities, count(*) FILTER (k % 3 = 0) AS interface_changes, 2 * (count(*) FILTER (k % 5 = 0 OR k % 7 = 0) + count(*) FILTER (k % 4 = 0)) AS unresolved, count(*) FILTER (k % 5 = 0 OR k % 7 = 0 OR k % 4 = 0) = 0 AS is_complete FROM s GROUP BY pair""",
    "reference_indexes": """SELECT 'by_native_identifier' AS index, 'part' AS canonical_type, CAST(p_partkey AS VARCHAR) AS value, CAST(1 AS BIGINT) AS n, 'p' || p_partkey AS least FROM part
      UNION ALL SELECT 'by_name', 'part', p_name, count(*), min('p' || p_partkey) FROM part GROUP BY p_name UNION ALL SELECT 'by_name', 'remote_command', s_name, count(*), min('s' || s_suppkey) FROM supplier GROUP BY s_name
      UNION ALL SELECT 'by_command_identity', 'remote_command', s_name, count(*), min('s' || s_suppkey) FROM supplier GROUP BY s_name
      UNION ALL SELECT 'by_type', 'part', '', count(*), min('p' || p_partkey) FROM part UNION ALL SELECT 'by_type', 'remote_command', '', count(*), min('s' || s_suppkey) FROM supplier""",
    "resolve_by_wkn": """SELECT 'r' || s_suppkey AS owner_key, CASE WHEN ok AND s_suppkey % 7 <> 0 THEN 'RESOLVED' ELSE 'UNRESOLVED' END AS state, CASE WHEN NOT ok THEN 'NOT_FOUND' WHEN s_suppkey % 7 = 0 THEN 'WRONG_TYPE' END AS reason, CASE WHEN ok AND s_suppkey % 7 <> 0 THEN 's' || s_suppkey END AS target_key
      FROM (SELECT s_suppkey, (s_suppkey % 3 = 0) = (s_suppkey % 2 = 0) AS ok FROM supplier)""",
    "check_rules": """WITH s AS (SELECT s_suppkey AS k FROM supplier), t AS (SELECT k FROM s UNION ALL SELECT k FROM s WHERE k % 13 = 0 AND k % 11 <> 0), r AS (SELECT * FROM s WHERE k % 11 <> 0),
      x AS (SELECT 'a key is not blank' AS rule, count(*) FILTER (k % 11 = 0) AS n FROM t UNION ALL SELECT 'a key stands once', count(*) FILTER (k % 13 = 0 AND k % 11 <> 0) + CASE WHEN count(*) FILTER (k % 11 = 0) > 1 THEN 1 ELSE 0 END FROM s
        UNION ALL SELECT 'a verified name has value, authority and scope', count(*) FILTER (k % 7 = 0) FROM t UNION ALL SELECT 'a place has a line and a column from 1 on', count(*) FILTER (k % 5 = 0) FROM t
        UNION ALL SELECT 'target types are distinct', count(*) FILTER (k % 4 = 0) FROM r UNION ALL SELECT 'target types fit the role', count(*) FROM r
        UNION ALL SELECT 'an owner is an entity', count(*) FILTER (k % 17 = 0) FROM r UNION ALL SELECT 'a target is an entity', count(*) FILTER (k % 9 = 0) FROM r
        UNION ALL SELECT 'a target is of a type asked for', count(*) FILTER (k % 4 = 0 AND k % 9 <> 0) FROM r UNION ALL SELECT 'a target lies within the scope', count(*) FILTER (k % 2 <> 0 AND k % 9 <> 0) FROM r
        UNION ALL SELECT 'an outcome doesn''t contradict itself', count(*) FILTER (k % 19 = 0) FROM r UNION ALL SELECT 'a diagnostic has code, message and a known severity', count(*) FILTER (k % 6 = 0 OR k % 10 = 0) FROM s)
      SELECT rule, n FROM x WHERE n > 0""",
    "resolve_union": """WITH d AS (SELECT 'd' || n_regionkey AS name, count(*) FILTER (n_nationkey % 2 = 0) AS n FROM nation GROUP BY n_regionkey), x AS (SELECT s_suppkey AS k, s_suppkey % 3 = 0 AS other, coalesce(d.n, 0) AS n FROM supplier LEFT JOIN d ON d.name = 'd' || s_suppkey % 6)
      SELECT 'r' || k AS owner_key, CASE WHEN NOT other AND n = 1 THEN 'RESOLVED' WHEN NOT other AND n > 1 THEN 'AMBIGUOUS' ELSE 'UNRESOLVED' END AS state, CASE WHEN n = 0 THEN 'NOT_FOUND' WHEN other THEN 'WRONG_TYPE' WHEN n > 1 THEN 'AMBIGUOUS' END AS reason, CAST(CASE WHEN NOT other AND n > 1 THEN n ELSE 0 END AS BIGINT) AS n_candidates FROM x""",
}


def queries() -> dict:
    return {name: globals()[name] for name in ORACLE}

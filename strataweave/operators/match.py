"""Matching the entities of two versions by identity tokens, never by guess.

Tokens tie entities of both sides into components. A component of one old and one new entity without a collision or conflict is a match;
other components of several entities are ambiguous; single entities are unmatched. `by` columns (a document pair, for instance) keep
comparisons apart, so that any number of them run as one.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import cut, drop
from .resolve import RESOLVED, with_optional

#: Strategies in order of priority, and the types whose native ids are identities.
STRATEGIES = ("NATIVE_ID", "WELL_KNOWN_NAME", "COMMAND_NAME", "PARAMETER_NAME", "FORMAT_NAME", "STANDARD_DESIGNATION", "EVENT_IDENTITY", "STREAM_FUNCTION")
NATIVE_TYPES = ("status_variable", "data_variable", "equipment_constant", "collection_event", "alarm", "default_report")
NAME_STRATEGIES = {"remote_command": "COMMAND_NAME", "remote_command_parameter": "PARAMETER_NAME", "variable_format": "FORMAT_NAME"}
_LATER = ("remote_command_parameter", "event_report_link")


def _token() -> Column:
    return F.to_json(F.array("strategy", "canonical_type", "value"))


def components(tokens: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, side, key, component) for every tokened entity.

    Entities with one token belong to it at once; only the tokens that entities with several tie together are spread least labels over,
    along groups and never pairs, with jumps to the label's label, so that long chains take few rounds.
    """
    by = by or []
    tokens = with_optional(tokens, "canonical_type")
    node = [*by, "side", "key"]
    links = cut(tokens.select(*node, _token().alias("token")).distinct(), "links")
    per = links.groupBy(*node).agg(F.min("token").alias("a"), F.count("*").alias("n"))
    ties = links.join(per.filter("n > 1"), node).filter("token <> a").select(*by, "a", F.col("token").alias("b")).distinct()
    ties = cut(ties, "ties")
    made = [links, ties]
    found = per.select(*node, F.col("a").alias("token"), F.col("a").alias("component"))
    if not ties.isEmpty():
        both = ties.unionByName(ties.select(*by, F.col("b").alias("a"), F.col("a").alias("b")))
        label = cut(both.select(*by, F.col("a").alias("token")).distinct().withColumn("label", F.col("token")), "label")
        while True:
            near = both.join(label.withColumnRenamed("token", "b"), [*by, "b"]).groupBy(*by, F.col("a").alias("token")).agg(F.min("label").alias("near"))
            step = label.join(near, [*by, "token"]).select(*by, "token", F.col("label").alias("was"), F.least("label", "near").alias("least"))
            jump = label.select(*by, F.col("token").alias("least"), F.col("label").alias("far"))
            new = cut(step.join(jump, [*by, "least"]).select(*by, "token", "was", F.least("least", "far").alias("label")), "label")
            moved = not new.filter("label <> was").isEmpty()
            drop(label)
            label = new.drop("was")
            label._strataweave_path = new._strataweave_path
            if not moved:
                break
        made.append(label)
        found = found.drop("component").join(label, [*by, "token"], "left").withColumn("component", F.coalesce("label", "token"))
    out = cut(found.select(*node, "component"), "components")
    drop(*made)
    return out


def staged(entities: DataFrame, tokens: DataFrame, by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(components with their outcome, members): see outcomes(); members are the entities with their component."""
    by = by or []
    tokens = with_optional(tokens, "canonical_type").distinct()
    comp = components(tokens, by)
    members = with_optional(entities, "canonical_type").select(*by, "side", "key", "canonical_type").join(comp, [*by, "side", "key"], "left")
    members = members.withColumn("component", F.coalesce("component", F.concat(F.lit("~"), "side", F.lit(":"), "key")))
    old, new, both = F.col("side") == "old", F.col("side") == "new", (F.col("o") > 0) & (F.col("n") > 0)
    size = members.groupBy(*by, "component").agg(F.min("canonical_type").alias("canonical_type"), F.count_if(old).alias("o"), F.count_if(new).alias("n"), F.min(F.when(old, F.col("key"))).alias("old_key"), F.min(F.when(new, F.col("key"))).alias("new_key"))
    # Who has a token is told by counts and sums of hashes, so that a token of many entities is no list.
    held = [F.sum(F.xxhash64(F.lit(i), "side", "key").cast("decimal(38,0)")).alias(f"h{i}") for i in (1, 2)]
    per = tokens.join(comp, [*by, "side", "key"]).groupBy(*by, "component", "strategy", "canonical_type", "value").agg(F.count_if(old).alias("o"), F.count_if(new).alias("n"), *held)
    holders, native = F.when(both, F.struct("o", "n", "h1", "h2")), F.col("strategy") == "NATIVE_ID"
    rules = per.groupBy(*by, "component").agg(
        F.bool_or((F.col("o") > 1) | (F.col("n") > 1)).alias("collision"),
        F.collect_set(F.when(both, F.col("strategy"))).alias("shared"),
        F.collect_set(F.when(~native & (F.col("o") > 0) & (F.col("n") == 0), F.col("strategy"))).alias("only_old"),
        F.collect_set(F.when(~native & (F.col("n") > 0) & (F.col("o") == 0), F.col("strategy"))).alias("only_new"),
        F.coalesce(F.min(holders) != F.max(holders), F.lit(False)).alias("competing"),
    )
    c = size.join(rules, [*by, "component"], "left")
    pair = (F.col("o") == 1) & (F.col("n") == 1)
    c = c.withColumn("collision", F.coalesce("collision", F.lit(False))).withColumn("conflict", F.coalesce(pair & F.arrays_overlap("only_old", "only_new"), F.lit(False)))
    many = F.col("o") + F.col("n") > 1
    c = c.withColumn("outcome", F.when(pair & ~F.col("collision") & ~F.col("conflict"), "match").when(many, "ambiguous").otherwise("unmatched"))
    competing = F.coalesce(F.col("competing") & (F.size("shared") > 1), F.lit(False))
    reasons = F.concat(F.when(F.col("collision"), F.array(F.lit("IDENTITY_COLLISION"))).otherwise(F.array().cast("array<string>")), F.when(F.col("conflict") | competing, F.array(F.lit("CONFLICTING_SIGNALS"))).otherwise(F.array().cast("array<string>")))
    c = c.withColumn("reasons", F.when(F.col("outcome") == "ambiguous", reasons))
    reason = F.when(F.col("outcome") == "ambiguous", F.array_join("reasons", ",")).when((F.col("outcome") == "unmatched") & F.col("shared").isNull(), "NO_USABLE_IDENTITY").when(F.col("outcome") == "unmatched", "NO_COUNTERPART")
    confidence = F.when(F.col("outcome") != "match", None).when(F.size("shared") > 1, "CORROBORATED").when(F.array_contains("shared", "WELL_KNOWN_NAME"), "VERIFIED_WKN").otherwise("EXACT_IDENTITY")
    primary = F.when(F.col("outcome") == "match", F.get(F.filter(F.array(*map(F.lit, STRATEGIES)), lambda s: F.array_contains("shared", s)), F.lit(0)))
    return c.withColumn("reason", reason).withColumn("confidence", confidence).withColumn("strategy", primary).drop("only_old", "only_new", "competing"), members


def outcomes(entities: DataFrame, tokens: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, component, canonical_type, o, n, collision, conflict, shared, strategy, old_key, new_key, outcome, reason, reasons, confidence).

    entities: (by, side, key, canonical_type) with side old or new; tokens: (by, side, key, canonical_type, strategy, value). An entity
    without tokens is a component of its own.
    """
    return staged(entities, tokens, by)[0]


def _identity(*parts: Column) -> Column:
    return F.to_json(F.array(*parts))


def signals(entities: DataFrame, by: list[str] | None = None, scope: list[str] | None = None) -> DataFrame:
    """(by, side, key, canonical_type, strategy, value): the tokens of entities, value being a JSON list that `scope` columns open.

    Native ids count for some types only, well-known names only if verified, and blank identities never.
    """
    by, scope = by or [], [F.col(c) for c in scope or []]
    e = with_optional(entities, "implementation_id", "name", "designation", "stream", "function", "wkn_value", "wkn_authority", "wkn_scope", "wkn_status")
    kind, some = F.col("canonical_type"), lambda c: ~T.blank(F.col(c))
    named = F.lit(None).cast("string")
    for t, s in NAME_STRATEGIES.items():
        named = F.when(kind == t, s).otherwise(named)
    verified = (F.lower("wkn_status") == "verified") & F.col("wkn_value").isNotNull() & F.col("wkn_authority").isNotNull() & F.col("wkn_scope").isNotNull()
    rows = [
        (F.lit("NATIVE_ID"), kind.isin(*NATIVE_TYPES) & some("implementation_id"), ["implementation_id"]),
        (F.lit("WELL_KNOWN_NAME"), verified, ["wkn_authority", "wkn_scope", "wkn_value"]),
        (named, named.isNotNull() & some("name"), ["name"]),
        (F.lit("STANDARD_DESIGNATION"), (kind == "standard_reference") & some("designation"), ["designation"]),
        (F.lit("STREAM_FUNCTION"), (kind == "supported_message") & F.col("stream").isNotNull() & F.col("function").isNotNull(), ["stream", "function"]),
    ]
    found = F.array(*[F.when(F.coalesce(ok, F.lit(False)), F.struct(s.alias("strategy"), _identity(*scope, *[F.col(c) for c in cols]).alias("value"))) for s, ok, cols in rows])
    found = e.select(*by, "side", "key", "canonical_type", F.explode(F.filter(found, lambda t: t.isNotNull())).alias("t"))
    return found.select(*by, "side", "key", "canonical_type", "t.strategy", "t.value")


def evidence(tokens: DataFrame, members: DataFrame, by: list[str]) -> DataFrame:
    """(by, component, evidence): every token of a component with the keys that have it on either side, by priority, type and value."""
    keys = lambda side: F.array_sort(F.collect_list(F.when(F.col("side") == side, F.col("key"))))
    per = tokens.distinct().join(members.select(*by, "side", "key", "component"), [*by, "side", "key"]).groupBy(*by, "component", "strategy", "canonical_type", "value").agg(keys("old").alias("old_keys"), keys("new").alias("new_keys"))
    rank = F.array_position(F.array(*map(F.lit, STRATEGIES)), F.col("strategy"))
    one = F.struct(rank.alias("rank"), F.col("canonical_type").alias("entity_type"), F.col("value").alias("identity"), "strategy", "old_keys", "new_keys")
    listed = per.groupBy(*by, "component").agg(F.array_sort(F.collect_list(one)).alias("evidence"))
    return listed.withColumn("evidence", F.transform("evidence", lambda x: x.dropFields("rank")))


def scoped(children: DataFrame, matches: DataFrame) -> DataFrame:
    """Children whose parents are matched, with the pair as their scope; children: (side, parent, ...), matches: (old_key, new_key)."""
    return children.join(_sides(matches, [], "parent").select("side", "parent", F.struct("old_key", "new_key").alias("scope")), ["side", "parent"])


def _sides(matches: DataFrame, by: list[str], name: str = "key") -> DataFrame:
    """(by, side, name, old_key, new_key): each match from both its sides."""
    side = lambda s: matches.select(*by, F.lit(s).alias("side"), F.col(f"{s}_key").alias(name), "old_key", "new_key")
    return side("old").unionByName(side("new"))


@dataclass
class Matching:
    """matches: (by, old_key, new_key, canonical_type, strategy, confidence, evidence). ambiguous: (by, component, canonical_type, reasons,
    old_keys, new_keys, evidence). members: (by, side, key, canonical_type, component, outcome, reasons). unmatched: (by, side, key,
    canonical_type, reason, dependency_key, evidence). Every entity stands in one of them, once."""

    by: list[str]
    matches: DataFrame
    ambiguous: DataFrame
    members: DataFrame
    unmatched: DataFrame

    def sides(self) -> DataFrame:
        return _sides(self.matches, self.by)


def match_interfaces(entities: DataFrame, relationships: DataFrame, by: list[str]) -> Matching:
    """Both versions' entities (with `side`) in two stages: parameters need the match of their command, and links that of their event."""
    later = F.col("canonical_type").isin(*_LATER)
    base = entities.filter(~later)
    base_tokens = signals(base, by)
    first, first_members = (cut(t, "matched") for t in staged(base, base_tokens, by))
    sure = _sides(first.filter((F.col("outcome") == "match") & F.col("canonical_type").isin("collection_event", "remote_command")), by)

    links = entities.filter(F.col("canonical_type") == "event_report_link")
    events = relationships.filter((F.col("role") == "event") & (F.col("state") == RESOLVED)).select(*by, "side", F.col("owner_key").alias("key"), F.col("target_key").alias("target"))
    events = events.join(links.select(*by, "side", "key", "canonical_type"), [*by, "side", "key"]).join(sure.withColumnRenamed("key", "target"), [*by, "side", "target"])
    events = events.select(*by, "side", "key", "canonical_type", F.lit("EVENT_IDENTITY").alias("strategy"), _identity(F.col("old_key"), F.col("new_key")).alias("value"))
    parameters = entities.filter(F.col("canonical_type") == "remote_command_parameter").join(sure.withColumnRenamed("key", "owner_key"), [*by, "side", "owner_key"], "left")
    inside, outside = parameters.filter("old_key is not null"), parameters.filter("old_key is null")
    next_tokens = reduce(DataFrame.unionByName, [signals(links, by), events, signals(inside, by, ["old_key", "new_key"])])
    ends = [*by, "side", "key", "canonical_type"]
    second, second_members = (cut(t, "matched") for t in staged(links.select(*ends).unionByName(inside.select(*ends)), next_tokens, by))

    found = first.unionByName(second)
    members = first_members.unionByName(second_members).join(found.select(*by, "component", "outcome", "reason", "reasons"), [*by, "component"])
    proof = cut(evidence(base_tokens.unionByName(next_tokens), members, by), "evidence")
    matches = found.filter("outcome = 'match'").select(*by, "component", "old_key", "new_key", "canonical_type", "strategy", "confidence").join(proof, [*by, "component"], "left").drop("component")
    keys = lambda side: F.array_sort(F.collect_list(F.when(F.col("side") == side, F.col("key")))).alias(f"{side}_keys")
    groups = members.filter("outcome = 'ambiguous'").groupBy(*by, "component").agg(F.min("canonical_type").alias("canonical_type"), F.first("reasons").alias("reasons"), keys("old"), keys("new"))
    alone = members.filter("outcome = 'unmatched'").join(proof, [*by, "component"], "left").select(*ends, "reason", F.lit(None).cast("string").alias("dependency_key"), "evidence")
    deferred = outside.select(*ends, F.lit("NO_CONFIRMED_COMMAND_SCOPE").alias("reason"), F.col("owner_key").alias("dependency_key"), F.lit(None).cast(alone.schema["evidence"].dataType).alias("evidence"))
    return Matching(by, cut(matches, "matches"), groups.join(proof, [*by, "component"]), members, cut(alone.unionByName(deferred), "unmatched"))


def uncovered(entities: DataFrame, m: Matching) -> DataFrame:
    """Entities that stand in no outcome, or in several; must be empty."""
    ends = [*m.by, "side", "key"]
    told = reduce(DataFrame.unionByName, [m.sides().select(*ends), m.members.filter("outcome = 'ambiguous'").select(*ends), m.unmatched.select(*ends)])
    told = told.groupBy(*ends).agg(F.count("*").alias("n"))
    return entities.select(*ends).join(told, ends, "full").filter("n is null or n <> 1")

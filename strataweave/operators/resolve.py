"""Reference resolution: exact evidence leads to a resolved, ambiguous or unresolved outcome.

entity:    key, canonical_type, implementation_id, name, and optionally designation, wkn_value, wkn_authority, wkn_scope, owner_key
reference: owner_key, role, target_types array<string>, implementation_id, name, and optionally wkn_*, scope_key, target_key
Both carry the `by` columns (a document id, for instance); references meet only entities equal in them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ResourceLimitError

RESOLVED, AMBIGUOUS, UNRESOLVED = "RESOLVED", "AMBIGUOUS", "UNRESOLVED"
MISSING_SELECTOR, UNSUPPORTED, NOT_FOUND, WRONG_TYPE = "MISSING_SELECTOR", "UNSUPPORTED", "NOT_FOUND", "WRONG_TYPE"
CANDIDATE_BUDGET = 250_000
#: Each selector has a bit; a candidate's bits must be those that were asked for.
SELECTORS = {"id": 1, "name": 2, "wkn": 4}


def with_optional(df: DataFrame, *names: str) -> DataFrame:
    for n in names:
        if n not in df.columns:
            df = df.withColumn(n, F.lit(None).cast("string"))
    return df


def _wkn(prefix: str = "") -> Column:
    """A NULL-safe text for the well-known name with its authority and scope."""
    return F.when(F.col(prefix + "wkn_value").isNotNull(), F.to_json(F.array("wkn_value", "wkn_authority", "wkn_scope")))


def selector_keys(entities: DataFrame, by: list[str]) -> DataFrame:
    """(by, selector, value, key, canonical_type, special, owner_key): all values under which an entity can be found.

    Commands answer to their names and standards to their designations; `special` names the type such a hit must have been asked for.
    """
    e = with_optional(entities, "designation", "wkn_value", "wkn_authority", "wkn_scope", "owner_key")
    base = [*by, "key", "canonical_type", "owner_key"]
    none = F.lit(None).cast("string")
    rows = [("id", "implementation_id", none), ("name", "name", none), ("name", "designation", F.lit("standard_reference")), ("wkn", _wkn(), none)]
    out = None
    for kind, value, special in rows:
        part = e.select(*base, F.lit(kind).alias("selector"), (F.col(value) if isinstance(value, str) else value).alias("value"), special.alias("special")).filter("value is not null")
        out = part if out is None else out.unionByName(part)
    return out


def resolve(references: DataFrame, entities: DataFrame, by: list[str] | None = None, validate_budget: bool = False, candidates: bool = True) -> DataFrame:
    """references plus n_candidates, state, reason, target_key and sorted candidate_keys.

    Every given selector must name the candidate (an intersection, taken as bits in one aggregation); the wrong-type probe is another
    aggregate of the same join. References that ask the same are one question, so a name asked by many meets its candidates once.
    A scope is part of the question's key, so parameters of other commands are never met. Without `candidates` their lists are left out
    and only the least of them is kept, as first_candidate. Unreferenced entities cost nothing but the scan.
    """
    by = by or []
    r = with_optional(references, "wkn_value", "wkn_authority", "wkn_scope", "scope_key", "target_key").withColumnRenamed("target_key", "given_target")
    given = {"id": F.col("implementation_id"), "name": F.col("name"), "wkn": _wkn()}
    r = r.withColumn("__selectors", F.filter(F.array(*[F.struct(F.lit(k).alias("selector"), F.lit(SELECTORS[k]).alias("bit"), v.alias("value")) for k, v in given.items()]), lambda s: s["value"].isNotNull()))
    r = r.withColumn("__question", F.to_json(F.struct(F.struct("__selectors", "target_types", "scope_key").alias("asked"), *by)))
    questions = r.filter((F.size("__selectors") > 0) & F.col("given_target").isNull()).select("__question", *by, "target_types", "scope_key", "__selectors").dropDuplicates(["__question"])
    mask = F.aggregate("__selectors", F.lit(0), lambda m, s: m + s["bit"])
    asked = questions.select("__question", *by, "target_types", "scope_key", mask.alias("asked"), F.explode("__selectors").alias("s"))
    asked = asked.select("__question", *by, "target_types", "scope_key", "asked", "s.selector", "s.bit", "s.value")
    found = selector_keys(entities, by)
    if "scope_key" in references.columns:
        # Places: anywhere (*), outside of commands, within one. A scoped question looks outside and within its command.
        within = F.concat(F.lit("in "), F.col("scope_key"))
        asked = asked.withColumn("__place", F.explode(F.when(F.col("scope_key").isNull(), F.array(F.lit("*"))).otherwise(F.array(F.lit("out"), within))))
        inside = F.when(F.col("canonical_type") == "remote_command_parameter", F.concat(F.lit("in "), F.coalesce("owner_key", F.lit("")))).otherwise("out")
        hits = asked.join(found.withColumn("__place", F.explode(F.array(F.lit("*"), inside))), [*by, "selector", "value", "__place"])
    else:
        hits = asked.join(found, [*by, "selector", "value"])
    typed_hit = F.array_contains("target_types", F.col("canonical_type")) & (F.col("special").isNull() | F.array_contains("target_types", F.col("special")))
    per = hits.groupBy("__question", "key", "asked").agg(F.bit_or("bit").alias("n"), F.coalesce(F.bit_or(F.when(typed_hit, F.col("bit"))), F.lit(0)).alias("typed"))
    own = F.when(F.col("typed") == F.col("asked"), F.col("key"))
    kept = F.array_sort(F.collect_list(own)).alias("candidates") if candidates else F.min(own).alias("first_candidate")
    found = per.filter("n = asked").groupBy("__question").agg(F.count_if(F.col("typed") == F.col("asked")).alias("nt"), F.count("*").alias("na"), kept)
    out = r.join(found, "__question", "left")
    nt, na = F.coalesce("nt", F.lit(0)), F.coalesce("na", F.lit(0))
    if validate_budget:
        # Ambiguous references keep their candidates; the budget is one document's.
        worst = out.filter(F.col("given_target").isNull() & (nt > 1)).groupBy(*by).agg(F.sum("nt").alias("n")).agg(F.max("n")).first()[0] or 0
        if worst > CANDIDATE_BUDGET:
            raise ResourceLimitError(f"{worst} candidates; the budget is {CANDIDATE_BUDGET}")
    none_asked, no_types = F.size("__selectors") == 0, F.coalesce(F.size("target_types"), F.lit(0)) <= 0
    state = F.when(F.col("given_target").isNotNull(), RESOLVED).when(none_asked | no_types, UNRESOLVED).when(nt == 1, RESOLVED).when(nt > 1, AMBIGUOUS).otherwise(UNRESOLVED)
    reason = F.when(F.col("given_target").isNotNull(), None).when(none_asked, MISSING_SELECTOR).when(no_types, UNSUPPORTED).when(nt > 1, AMBIGUOUS).when(nt == 1, None).when(na > 0, WRONG_TYPE).otherwise(NOT_FOUND)
    out = out.withColumn("state", state).withColumn("reason", reason).withColumn("n_candidates", F.when(F.col("state") == AMBIGUOUS, nt).otherwise(0).cast("long"))
    first = F.col("candidates")[0] if candidates else F.col("first_candidate")
    out = out.withColumn("target_key", F.coalesce("given_target", F.when(F.col("state") == RESOLVED, first)))
    if candidates:
        out = out.withColumn("candidate_keys", F.when(F.col("state") == AMBIGUOUS, F.col("candidates")).otherwise(F.array().cast("array<string>"))).drop("candidates")
    return out.drop("__question", "__selectors", "nt", "na", "given_target")


def indexes(entities: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, index, canonical_type, value, keys): every value under which entities of a type are known, collisions kept. NULL is no value,
    the empty text is one. by_stream_function is for lookups only; no reference selects by it.
    """
    by = by or []
    e = with_optional(entities, "designation", "wkn_value", "wkn_authority", "wkn_scope", "stream", "function", "owner_key")
    named = {
        "by_type": F.lit(""), "by_native_identifier": F.col("implementation_id"), "by_name": F.col("name"), "by_wkn": _wkn(), "by_standard_designation": F.col("designation"),
        "by_command_identity": F.when(F.col("canonical_type") == "remote_command", F.col("name")), "by_stream_function": F.to_json(F.when(F.col("stream").isNotNull() & F.col("function").isNotNull(), F.array("stream", "function"))),
        "parameter_owner_by_key": F.when(F.col("canonical_type") == "remote_command_parameter", F.col("owner_key")),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("index"), v.alias("value")) for k, v in named.items()])
    rows = e.select(*by, "canonical_type", "key", F.explode(F.filter(rows, lambda r: r["value"].isNotNull())).alias("r"))
    return rows.groupBy(*by, F.col("r.index").alias("index"), "canonical_type", F.col("r.value").alias("value")).agg(F.array_sort(F.collect_set("key")).alias("keys"))


def diagnostics(relationships: DataFrame) -> DataFrame:
    """One warning for each reference that isn't resolved."""
    code = F.when(F.col("state") == AMBIGUOUS, "AMBIGUOUS_REFERENCE").otherwise("UNRESOLVED_REFERENCE")
    return relationships.filter(F.col("state") != RESOLVED).withColumn("code", code).withColumn("severity", F.lit("WARNING"))


def owner_diagnostics(relationships: DataFrame, entities: DataFrame, by: list[str]) -> DataFrame:
    """diagnostics() with a message, the owner's type, and the reference's place, or the owner's where it has none."""
    owners = entities.select(*by, F.col("key").alias("owner_key"), F.col("canonical_type").alias("__type"), *[F.col(c).alias(f"__{c}") for c in ("path", "line", "col")])
    rows = diagnostics(relationships).join(owners, [*by, "owner_key"], "left")
    message = F.when(F.col("state") == AMBIGUOUS, F.concat(F.lit("reference "), F.col("role"), F.lit(" has "), F.col("n_candidates").cast("string"), F.lit(" possible targets")))
    message = message.otherwise(F.concat(F.lit("reference "), F.col("role"), F.lit(" has no target: "), F.lower("reason")))
    place = [F.coalesce(c, f"__{c}").alias(c) for c in ("path", "line", "col")]
    return rows.select(*by, "code", "severity", message.alias("message"), F.coalesce("__type", F.lit("equipment_interface")).alias("canonical_type"), "owner_key", F.col("role").alias("field"), *place)


def violations(relationships: DataFrame) -> DataFrame:
    """Rows against the rules of an outcome; a check query that must be empty."""
    many, target = F.size("candidate_keys"), F.col("target_key").isNotNull()
    known = F.col("reason").isin(MISSING_SELECTOR, UNSUPPORTED, NOT_FOUND, WRONG_TYPE)
    ok = F.when(F.col("state") == RESOLVED, target & F.col("reason").isNull() & (many == 0))
    ok = ok.when(F.col("state") == AMBIGUOUS, (many >= 2) & ~target & F.col("reason").eqNullSafe(F.lit(AMBIGUOUS)) & (F.array_sort(F.array_distinct("candidate_keys")) == F.col("candidate_keys")))
    return relationships.filter(~F.coalesce(ok.otherwise(F.coalesce(known, F.lit(False)) & ~target & (many == 0)), F.lit(False)))

"""Operators on the relationship graph: adjacency, dependency joins, bounded search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ResourceLimitError
from ..storage import cut
from .resolve import AMBIGUOUS, RESOLVED

FANOUT_BUDGET = 250_000
MAX_DEPTH = 8


def adjacency(relationships: DataFrame, entities: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """(by, key, direction, other, role): outgoing, incoming and candidate edges; containment where entities are given."""
    by = by or []
    solid = relationships.filter(F.col("state") == RESOLVED)
    out = solid.select(*by, F.col("owner_key").alias("key"), F.lit("outgoing").alias("direction"), F.col("target_key").alias("other"), "role")
    back = solid.select(*by, F.col("target_key").alias("key"), F.lit("incoming").alias("direction"), F.col("owner_key").alias("other"), "role")
    maybe = relationships.filter(F.col("state") == AMBIGUOUS).select(*by, F.explode("candidate_keys").alias("key"), F.lit("incoming_candidate").alias("direction"), F.col("owner_key").alias("other"), "role")
    edges = out.unionByName(back).unionByName(maybe)
    if entities is not None and "owner_key" in entities.columns:
        inside = entities.filter("owner_key is not null")
        role = F.concat(F.lit("parameters["), F.col("idx").cast("string"), F.lit("]")) if "idx" in entities.columns else F.lit("containment")
        edges = edges.unionByName(inside.select(*by, F.col("owner_key").alias("key"), F.lit("contains").alias("direction"), F.col("key").alias("other"), role.alias("role")))
        edges = edges.unionByName(inside.select(*by, "key", F.lit("contained_by").alias("direction"), F.col("owner_key").alias("other"), role.alias("role")))
    return edges


def fanout(candidates_per_reference: DataFrame, n_col: str) -> DataFrame:
    """(references, candidates, work): what adjacency of ambiguous references would cost."""
    n = F.col(n_col).cast("long")
    return candidates_per_reference.agg(F.count("*").alias("references"), F.sum(n).alias("candidates"), F.sum(n * n).alias("work"))


def check_fanout(relationships: DataFrame, budget: int = FANOUT_BUDGET, by: list[str] | None = None) -> None:
    """Fails if the adjacency of a document's ambiguous references would cost more than the budget."""
    n = F.col("n_candidates").cast("long")
    work = relationships.groupBy(*(by or [])).agg(F.sum(n * n).alias("work")).agg(F.max("work")).first()[0] or 0
    if work > budget:
        raise ResourceLimitError(f"candidate work {work}; the budget is {budget}")


def referenced_by(edges: DataFrame) -> DataFrame:
    """(subject, n) distinct owners of one-edge dependencies; edges: (owner, target)."""
    return edges.groupBy(F.col("target").alias("subject")).agg(F.count_distinct("owner").alias("n"))


def through(*steps: DataFrame) -> DataFrame:
    """(subject, entity) over a fixed path of (owner, target) edge frames, each walked from target to owner or as given.

    The end columns of one step meet the start of the next; distinct pairs are taken after every join, so multiplicities don't pile up.
    """
    path = steps[0].select(F.col("start").alias("subject"), F.col("end").alias("at")).distinct()
    for s in steps[1:]:
        path = path.join(s.select(F.col("start").alias("at"), "end"), "at").select("subject", F.col("end").alias("at")).distinct()
    return path.withColumnRenamed("at", "entity")


def dependents(path: DataFrame) -> DataFrame:
    return path.groupBy("subject").agg(F.count("*").alias("n"))


VARIABLES = ("status_variable", "data_variable", "equipment_constant")
#: Kinds of dependencies in order, with the words that open their statement.
DEPENDENCIES = {"REFERENCED_BY": "Referenced by", "LINKED_REPORT": "Linked to", "LINKED_EVENT": "Linked from", "EVENT_VIA_REPORT": "Linked through containing reports to"}
#: What entity types are called, one and several.
LABELS = {
    "status_variable": ("status variable", "status variables"), "data_variable": ("data variable", "data variables"), "equipment_constant": ("equipment constant", "equipment constants"),
    "collection_event": ("collection event", "collection events"), "alarm": ("alarm", "alarms"), "remote_command": ("remote command", "remote commands"),
    "remote_command_parameter": ("command parameter", "command parameters"), "supported_message": ("supported message", "supported messages"), "variable_format": ("variable format", "variable formats"),
    "default_report": ("default report", "default reports"), "event_report_link": ("event/report link", "event/report links"), "standard_reference": ("standard reference", "standard references"),
}
NO_DEPENDENCIES = "No dependencies found in the supported resolved graph paths."
NOT_IN_GRAPH = "This change has no catalogued entity in the reference graph."
PATH_BUDGET = 250_000


def edges(relationships: DataFrame, entities: DataFrame, by: list[str]) -> DataFrame:
    """(by, edge, owner_type, target_type): resolved references with the types of both ends."""
    kind = lambda end: entities.select(*by, F.col("key").alias(f"{end}_key"), F.col("canonical_type").alias(f"{end}_type"))
    solid = relationships.filter(F.col("state") == RESOLVED).select(*by, "owner_key", "role", "target_key")
    solid = solid.join(kind("owner"), [*by, "owner_key"]).join(kind("target"), [*by, "target_key"])
    return solid.select(*by, F.struct("owner_key", "role", "target_key").alias("edge"), "owner_type", "target_type")


def dependencies(relationships: DataFrame, entities: DataFrame, by: list[str], subjects: DataFrame | None = None) -> DataFrame:
    """(by, subject, kind, entity_key, entity_type, edges): one row a proof, of one to three resolved edges; of `subjects` (by, subject)
    only, if given. Candidates prove nothing.
    """
    e = edges(relationships, entities, by)
    link = F.col("owner_type") == "event_report_link"
    member = e.filter((F.col("owner_type") == "default_report") & F.col("edge.role").startswith("variables[") & F.col("target_type").isin(*VARIABLES)).select(*by, F.col("edge").alias("v"), F.col("edge.owner_key").alias("report"))
    reports = e.filter(link & F.col("edge.role").startswith("reports[") & (F.col("target_type") == "default_report")).select(*by, F.col("edge").alias("r"), F.col("edge.target_key").alias("report"), F.col("edge.owner_key").alias("link"))
    events = e.filter(link & (F.col("edge.role") == "event") & (F.col("target_type") == "collection_event")).select(*by, F.col("edge").alias("l"), F.col("edge.target_key").alias("event"), F.col("edge.owner_key").alias("link"))
    if subjects is not None:
        own = lambda df, c: df.join(subjects.withColumnRenamed("subject", c), [*by, c], "left_semi")
    else:
        own = lambda df, c: df
    row = lambda df, subject, kind, entity, kind_of, *path: df.select(*by, F.col(subject).alias("subject"), F.lit(kind).alias("kind"), F.col(entity).alias("entity_key"), kind_of.alias("entity_type"), F.array_sort(F.array(*path)).alias("edges"))
    direct = e.withColumn("to", F.col("edge.target_key")).withColumn("from", F.col("edge.owner_key"))
    linked = reports.join(events, [*by, "link"])
    through = own(member.withColumn("variable", F.col("v.target_key")), "variable").join(linked, [*by, "report"])
    event, report = F.lit("collection_event"), F.lit("default_report")
    return (
        row(own(direct, "to"), "to", "REFERENCED_BY", "from", F.col("owner_type"), "edge")
        .unionByName(row(own(linked, "event"), "event", "LINKED_REPORT", "report", report, "l", "r"))
        .unionByName(row(own(linked, "report"), "report", "LINKED_EVENT", "event", event, "r", "l"))
        .unionByName(row(through, "variable", "EVENT_VIA_REPORT", "event", event, "v", "r", "l"))
    )


def check_paths(proofs: DataFrame, by: list[str], budget: int = PATH_BUDGET) -> None:
    """Fails if one document has more proofs than the budget."""
    most = proofs.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if most > budget:
        raise ResourceLimitError(f"{most} dependency paths; the budget is {budget}")


def contexts(proofs: DataFrame, by: list[str]) -> DataFrame:
    """(by, subject, kind, entity_key, entity_type, evidence): each dependency with its distinct proofs in order."""
    return proofs.groupBy(*by, "subject", "kind", "entity_key", "entity_type").agg(F.array_sort(F.collect_set("edges")).alias("evidence"))


def statements(proofs: DataFrame, by: list[str]) -> DataFrame:
    """(by, subject, statements): a sentence for each kind of dependency, counting distinct entities by type."""
    n = proofs.select(*by, "subject", "kind", "entity_type", "entity_key").distinct().groupBy(*by, "subject", "kind", "entity_type").agg(F.count("*").alias("n"))
    label = F.lit(None).cast("string")
    for t, (one, many) in LABELS.items():
        label = F.when(F.col("entity_type") == t, F.when(F.col("n") == 1, one).otherwise(many)).otherwise(label)
    part = F.concat(F.col("n").cast("string"), F.lit(" "), label)
    per = n.groupBy(*by, "subject", "kind").agg(F.array_sort(F.collect_list(F.struct("entity_type", part.alias("part")))).alias("p"))
    parts = F.transform("p", lambda x: x["part"])
    size = F.size(parts)
    phrase = F.when(size == 1, parts[0]).otherwise(F.concat(F.array_join(F.slice(parts, 1, F.greatest(size - 1, F.lit(1))), ", "), F.lit(" and "), F.element_at(parts, -1)))
    order, opening = F.lit(len(DEPENDENCIES)), F.lit("")
    for i, (kind, words) in enumerate(DEPENDENCIES.items()):
        order, opening = F.when(F.col("kind") == kind, i).otherwise(order), F.when(F.col("kind") == kind, words).otherwise(opening)
    said = per.select(*by, "subject", F.struct(order.alias("i"), F.concat(opening, F.lit(" "), phrase, F.lit(".")).alias("s")).alias("x"))
    return said.groupBy(*by, "subject").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]).alias("statements"))


def traversable(relationships: DataFrame, entities: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, a, b): undirected resolved and containment edges, both ways, distinct."""
    by = by or []
    e = adjacency(relationships, entities, by).filter("direction <> 'incoming_candidate'")
    return e.select(*by, F.col("key").alias("a"), F.col("other").alias("b")).distinct()


def bounded_distances(edges: DataFrame, start: DataFrame, depth: int, by: list[str] | None = None) -> DataFrame:
    """(by, key, depth): least number of hops from the start keys, up to depth. One join and anti join a hop, only new keys go on."""
    if not 0 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must be 0 to {MAX_DEPTH}")
    by = by or []
    step = edges.withColumnsRenamed({"a": "key", "b": "__next"})
    reached = start.select(*by, "key").distinct().withColumn("depth", F.lit(0))
    front = reached
    for d in range(1, depth + 1):
        found = front.join(step, [*by, "key"]).select(*by, F.col("__next").alias("key")).distinct().join(reached.select(*by, "key"), [*by, "key"], "left_anti")
        front = cut(found.withColumn("depth", F.lit(d)), "front")
        if front.isEmpty():
            break
        reached = reached.unionByName(front)
    return reached

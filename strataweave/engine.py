"""The engine's facade: documents in, lazy tables out.

    spark = session()
    one = load(spark, "machine.xml")                      # a file, a folder, a pattern, any store Spark reads
    one.entities, one.references, one.relationships, one.diagnostics
    changes = compare(load(spark, "v1.xml"), load(spark, "v2.xml"))
    changes.summary, changes.properties, changes.roles, changes.issues, changes.contexts()

Every table carries doc_id, and comparisons carry `pair`, so that one document and a million go the same way.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import InputError, ModelValidationError
from .operators import compare as comparing
from .operators import graph, resolve, rules
from .sources import paths, xml
from .sources.dictionary import TYPES
from .sources.registry import Registry
from .storage import cut

_ENTITY = ("canonical_type", "key", "owner_key", "idx", "implementation_id", "name", "description", "declared_source", "wkn_value", "wkn_authority", "wkn_scope", "wkn_status", "designation", "stream", "function", "fields", "roles", "opaque", "path", "line", "col")
_REFERENCE = ("canonical_type", "owner_key", "field", "idx", "role", "target_types", "implementation_id", "name", "wkn_value", "wkn_authority", "wkn_scope", "wkn_status", "scope_key", "target_key", "json", "path", "line", "col")


@dataclass
class Interface:
    """Canonical tables of the documents read. subjects are the entities, the equipment and the interface, the latter two without a key."""

    documents: DataFrame
    subjects: DataFrame
    references: DataFrame
    extensions: DataFrame
    adapter_diagnostics: DataFrame

    @property
    def entities(self) -> DataFrame:
        return self.subjects.filter("key is not null")

    @cached_property
    def relationships(self) -> DataFrame:
        """Every reference with its outcome, resolved once."""
        return cut(resolve.resolve(self.references, self.entities, by=["doc_id"], validate_budget=True), "relationships")

    @property
    def unresolved(self) -> DataFrame:
        return self.relationships.filter(F.col("state") != resolve.RESOLVED)

    @property
    def diagnostics(self) -> DataFrame:
        """Of the adapters and of references; what is only provisional is left out."""
        own = self.adapter_diagnostics.filter("code <> 'REFERENCE_RESOLUTION_PENDING'")
        return own.unionByName(resolve.owner_diagnostics(self.relationships, self.entities, ["doc_id"]).select(*own.columns))

    def adjacency(self) -> DataFrame:
        graph.check_fanout(self.relationships, by=["doc_id"])
        return graph.adjacency(self.relationships, self.entities, ["doc_id"])

    def dependencies(self) -> DataFrame:
        proofs = cut(graph.dependencies(self.relationships, self.entities, ["doc_id"]), "proofs")
        graph.check_paths(proofs, ["doc_id"])
        return proofs

    @property
    def pending(self) -> DataFrame:
        """References before resolution, with why they may never be resolved: an empty selector counts as none here."""
        given = F.concat_ws("", "implementation_id", "name", "wkn_value") != ""
        return self.references.withColumn("reason", F.when(given, "NOT_ATTEMPTED").otherwise(resolve.MISSING_SELECTOR))

    def violations(self) -> DataFrame:
        """Rows that break a rule of the model: none, unless an adapter is at fault."""
        by = ["doc_id"]
        return rules.subjects(self.subjects, by).unionByName(rules.references(self.references, by)).unionByName(rules.relationships(self.relationships, self.entities, by)).unionByName(rules.diagnostics(self.diagnostics, by))

    def counts(self) -> DataFrame:
        """(doc_id, canonical_type, n): entities by type, zeros included."""
        n = self.entities.groupBy("doc_id", "canonical_type").agg(F.count("*").alias("n"))
        return self.documents.select("doc_id", F.explode(F.array(*map(F.lit, TYPES))).alias("canonical_type")).join(n, ["doc_id", "canonical_type"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def from_files(files: DataFrame, revision: str | None = None, registry: Registry | None = None, limits: xml.Limits | None = None, strict: bool = True) -> Interface:
    """files: (doc_id, content). Strict: a document that no adapter reads fails the load; else it stands in documents alone."""
    registry = registry or Registry()
    documents, facts = registry.adapt(files, revision, limits, strict)
    entity = facts.filter("kind = 'entity'").select("doc_id", *_ENTITY)
    reference = facts.filter("kind = 'reference'").select("doc_id", *_REFERENCE)
    extension = facts.filter("kind = 'extension'").select("doc_id", "canonical_type", "owner_key", "name", "namespace", "reason", "json", "path", "line", "col")
    return Interface(documents, entity, reference, extension, registry.diagnostics(documents, facts))


def local_files(spark: SparkSession, *names: str, limits: xml.Limits | None = None) -> DataFrame:
    """(doc_id, content) of local documents, admitted and read on the driver without following links."""
    most = (limits or xml.Limits()).bytes
    rows = [(str(paths.local_path(n)), bytearray(paths.read_regular(n, most))) for n in names]
    return spark.createDataFrame(rows, "doc_id string, content binary")


def load(spark: SparkSession, path: str | list[str], **options) -> Interface:
    """Documents at a path that Spark reads; see from_files for the options."""
    return from_files(xml.files(spark, path), **options)


def load_local(spark: SparkSession, name: str, **options) -> Interface:
    """One local document."""
    return from_files(local_files(spark, name, limits=options.get("limits")), **options)


def compare(old: Interface, new: Interface, pairs: DataFrame | None = None) -> comparing.ChangeSet:
    """pairs: (pair, old_doc, new_doc); left out if either side is one document."""
    if pairs is None:
        ends = [i.documents.filter("revision is not null").select("doc_id").limit(2).collect() for i in (old, new)]
        if any(len(e) != 1 for e in ends):
            raise InputError("say which documents are compared: (pair, old_doc, new_doc)")
        pairs = old.documents.sparkSession.createDataFrame([("0", ends[0][0].doc_id, ends[1][0].doc_id)], "pair string, old_doc string, new_doc string")

    def both(table: str) -> DataFrame:
        side = lambda i, s: getattr(i, table).join(F.broadcast(pairs.select("pair", F.col(f"{s}_doc").alias("doc_id"))), "doc_id").withColumn("side", F.lit(s))
        return cut(side(old, "old").unionByName(side(new, "new")), table)

    return comparing.compare_interfaces(both("subjects"), both("relationships"), ["pair"])


def verify_names(interface: Interface, evidence: DataFrame) -> Interface:
    """Well-known names that the evidence (canonical_type, value, authority, scope) vouches for become verified."""
    kinds = evidence.select("canonical_type", F.col("value").alias("wkn_value"), F.col("authority").alias("__a"), F.col("scope").alias("__s")).distinct()
    if not kinds.groupBy("canonical_type", "wkn_value").count().filter("count > 1").isEmpty():
        raise ModelValidationError("evidence gives a name two authorities or scopes")
    joined = interface.subjects.join(kinds, ["canonical_type", "wkn_value"], "left")
    known = F.col("__a").isNotNull() & F.col("__s").isNotNull()
    for column, value in (("wkn_authority", F.col("__a")), ("wkn_scope", F.col("__s")), ("wkn_status", F.lit("verified"))):
        joined = joined.withColumn(column, F.when(known, value).otherwise(F.col(column)))
    json = F.map_from_entries(F.array(F.struct(F.lit("wkn"), comparing._wkn())))
    fields = F.when(known, F.map_concat(F.map_filter("fields", lambda k, _: k != "wkn"), json)).otherwise(F.col("fields"))
    return Interface(interface.documents, joined.withColumn("fields", fields).select(*interface.subjects.columns), interface.references, interface.extensions, interface.adapter_diagnostics)

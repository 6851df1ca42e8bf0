"""XML documents, parsed by Expat on executors with declarations and entities refused, as trees and as a node table.

Any DOCTYPE or entity declaration, a broken document, or a passed limit fails the whole load; nothing is truncated or expanded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InputTooLargeError, InvalidXmlError, ResourceLimitError, StructureLimitError, UnsafeXmlError
from ..storage import ship

#: The loader's limits and the parser version from which it is thought safe.
MAX_BYTES = 10 << 20
MAX_DEPTH = 64
MAX_ELEMENTS = 100_000
MAX_ATTRIBUTES = 128
MAX_NAME = 1024
MAX_TEXT = 16 << 20
MAX_PATHS = 16 << 20
EXPAT_FLOOR = (2, 7, 2)

XSI = "http://www.w3.org/2001/XMLSchema-instance"
SCHEMA = "doc_id string, node_id long, parent_id long, ordinal int, depth int, ns string, local string, path string, attrs map<string,string>, text string, n_children int, line int, col int"
_ARROW = pa.schema([("doc_id", pa.string()), ("node_id", pa.int64()), ("parent_id", pa.int64()), ("ordinal", pa.int32()), ("depth", pa.int32()), ("ns", pa.string()), ("local", pa.string()), ("path", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("n_children", pa.int32()), ("line", pa.int32()), ("col", pa.int32())])


@dataclass(frozen=True)
class Limits:
    """All positive; depth at most MAX_DEPTH. `floor` refuses an Expat older than EXPAT_FLOOR, off by default."""

    bytes: int = MAX_BYTES
    depth: int = MAX_DEPTH
    elements: int = MAX_ELEMENTS
    attributes: int = MAX_ATTRIBUTES
    floor: bool = False

    def __post_init__(self):
        if min(self.bytes, self.depth, self.elements, self.attributes) < 1 or self.depth > MAX_DEPTH:
            raise ValueError(f"limits must be positive, and depth at most {MAX_DEPTH}")


@dataclass(slots=True, eq=False)
class Element:
    """A node with its expanded name ({namespace}local), and text and children in order."""

    tag: str
    attrs: list[tuple[str, str]]
    path: str
    line: int
    col: int
    content: list = field(default_factory=list)

    @property
    def children(self) -> list[Element]:
        return [c for c in self.content if type(c) is Element]

    @property
    def text(self) -> str:
        return "".join(c for c in self.content if type(c) is str)

    def attribute(self, name: str) -> str | None:
        return next((v for k, v in self.attrs if k == name), None)


def _expanded(name: str) -> str:
    return "{" + name if "}" in name else name


def split_name(tag: str) -> tuple[str | None, str]:
    """(namespace, local); no namespace is None."""
    ns, found, local = tag.rpartition("}")
    return (ns[1:], local) if found else (None, tag)


class _Builder:
    """Handlers of one parse."""

    def __init__(self, doc_id: str, limits: Limits):
        self.doc_id, self.limits = doc_id, limits
        self.open, self.counts, self.texts, self.root = [], [{}], [], None
        self.elements = self.size = self.paths = self.declared = 0
        self.parser = p = expat.ParserCreate(namespace_separator="}")
        p.buffer_text = True
        p.SetParamEntityParsing(expat.XML_PARAM_ENTITY_PARSING_NEVER)
        p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler, p.StartNamespaceDeclHandler = self.start, self.end, self.data, self.namespace
        p.StartDoctypeDeclHandler = p.EntityDeclHandler = p.ExternalEntityRefHandler = self.refuse

    def at(self) -> str:
        return f"{self.doc_id}, line {self.parser.CurrentLineNumber}, column {self.parser.CurrentColumnNumber + 1}"

    def refuse(self, *_):
        raise UnsafeXmlError(f"document type and entity declarations are refused: {self.at()}")

    def check(self, ok: bool, what: str) -> None:
        if not ok:
            raise StructureLimitError(f"too many or too long: {what} ({self.at()})")

    def grow(self, n: int) -> None:
        self.size += n
        self.check(self.size <= MAX_TEXT, "characters")

    def namespace(self, prefix, uri):
        self.declared += 1
        self.check(self.declared <= self.limits.attributes, "namespace declarations")
        self.check(len(prefix or "") + len(uri or "") <= MAX_NAME, "a namespace")

    def settle(self) -> None:
        """Text up to a boundary is one piece."""
        if self.texts:
            self.open[-1].content.append("".join(self.texts))
            self.texts.clear()

    def start(self, tag, attrs):
        self.check(len(self.open) < self.limits.depth, "levels")
        self.check(len(attrs) + self.declared <= self.limits.attributes, "attributes")
        self.check(max(map(len, (tag, *attrs))) <= MAX_NAME, "a name")
        self.declared = 0
        self.elements += 1
        self.check(self.elements <= self.limits.elements, "elements")
        self.grow(len(tag) + sum(len(k) + len(v) for k, v in attrs.items()))
        name, seen = _expanded(tag), self.counts[-1]
        nth = seen[name] = seen.get(name, 0) + 1
        above = self.open[-1] if self.open else None
        path = f"{above.path if above else ''}/{name}[{nth}]"
        self.paths += len(path)
        if self.paths > MAX_PATHS:
            raise ResourceLimitError(f"{self.doc_id}: paths of more than {MAX_PATHS} characters")
        node = Element(name, [(_expanded(k), v) for k, v in attrs.items()], path, self.parser.CurrentLineNumber, self.parser.CurrentColumnNumber + 1)
        if above:
            self.settle()
            above.content.append(node)
        else:
            self.root = node
        self.open.append(node)
        self.counts.append({})

    def end(self, _):
        self.settle()
        self.open.pop()
        self.counts.pop()

    def data(self, text):
        self.grow(len(text))
        if self.open:
            self.texts.append(text)


def parse(doc_id: str, raw: bytes, limits: Limits | None = None) -> Element:
    """The tree of one document."""
    limits = limits or Limits()
    if limits.floor and expat.version_info < EXPAT_FLOOR:
        raise UnsafeXmlError(f"Expat {'.'.join(map(str, EXPAT_FLOOR))} or newer is asked for, this is {expat.EXPAT_VERSION}")
    if len(raw) > limits.bytes:
        raise InputTooLargeError(f"{doc_id}: {len(raw)} bytes")
    builder = _Builder(doc_id, limits)
    try:
        builder.parser.Parse(raw, True)
    except (expat.ExpatError, LookupError, ValueError) as e:
        raise InvalidXmlError(f"{doc_id}: {e}") from None
    return builder.root


def walk(root: Element) -> Iterator[Element]:
    """All nodes in document order."""
    left = [root]
    while left:
        node = left.pop()
        yield node
        left.extend(reversed(node.children))


def shred(doc_id: str, raw: bytes, limits: Limits | None = None) -> list[dict]:
    """The nodes of one document in document order; text is a node's own text, its pieces joined."""
    root = parse(doc_id, raw, limits)
    place = {id(root): (None, 0, 1)}
    rows = []
    for n, node in enumerate(walk(root)):
        parent, ordinal, depth = place.pop(id(node))
        children = node.children
        for i, child in enumerate(children):
            place[id(child)] = (n, i, depth + 1)
        ns, local = split_name(node.tag)
        rows.append({"doc_id": doc_id, "node_id": n, "parent_id": parent, "ordinal": ordinal, "depth": depth, "ns": ns or "", "local": local, "path": node.path, "attrs": node.attrs, "text": node.text, "n_children": len(children), "line": node.line, "col": node.col})
    return rows


def nodes(files: DataFrame) -> DataFrame:
    """The node table of (doc_id, content) rows; each document is one row of one task."""
    ship(files.sparkSession)

    def scan(batches):
        for b in batches:
            for doc_id, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                yield pa.RecordBatch.from_pylist(shred(doc_id, raw.as_py()), schema=_ARROW)

    return files.select("doc_id", "content").mapInArrow(scan, SCHEMA)


def files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(doc_id, content) of the documents at a path that Spark reads: a file, a folder, a pattern, in any store."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc_id"), "content")


def load(spark: SparkSession, path: str) -> DataFrame:
    return nodes(files(spark, path))


def _let(value: Column, then) -> Column:
    """then(value), the value standing in the plan once."""
    return F.transform(F.array(value), then)[0]


def hint(ns: Column, schema_location: Column, no_namespace: Column, pattern: str, prefix: str = "") -> Column:
    """struct(code, revision, candidates, locations): the label that a root's schema locations give, or the code of why they give none.

    Only locations of the root's own namespace count, and those without one where the root has none; several stay ambiguous even if
    they agree. The label is `prefix` and the first group of `pattern`, which must match the whole base name, URL-decoded.
    """
    words = lambda c: F.split(F.btrim(F.regexp_replace(c, r"[ \t\r\n]+", " ")), " ")
    none = F.array().cast("array<string>")

    def located(r: Column) -> Column:
        """(bad, found): whether the attributes are malformed, and the distinct locations that count."""
        rootless = r["ns"] == ""
        bad = F.coalesce((F.size(r["parts"]) % 2 == 1) | F.array_contains(r["parts"], ""), F.lit(False))
        bad_alone = F.coalesce(rootless & ((F.size(r["alone"]) != 1) | (r["alone"][0] == "")), F.lit(False))
        n = F.greatest(F.lit(0), F.floor(F.size(r["parts"]) / 2).cast("int") - 1)
        pairs = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(F.get(r["parts"], i * 2).alias("ns"), F.get(r["parts"], i * 2 + 1).alias("at")))
        own = F.coalesce(F.transform(F.filter(pairs, lambda p: (p["ns"] == r["ns"]) & p["at"].isNotNull()), lambda p: p["at"]), none)
        found = F.when(rootless & r["alone"].isNotNull(), F.concat(own, r["alone"])).otherwise(own)
        return F.struct((bad | bad_alone).alias("bad"), F.array_sort(F.array_distinct(found)).alias("found"))

    def label(at: Column) -> Column:
        path = F.regexp_replace(F.regexp_replace(at, r"[?#].*$", ""), r"^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/]*)?", "")
        decoded = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
        base = F.substring_index(F.substring_index(decoded, "/", -1), "\\", -1)
        return F.regexp_extract(base, rf"^(?:{pattern})\z", 1)

    def labelled(r: Column) -> Column:
        host = lambda at: F.regexp_extract(at, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
        broken = F.exists(r["found"], lambda at: F.contains(host(at), F.lit("[")) != F.contains(host(at), F.lit("]")))
        labels = F.filter(F.transform(r["found"], label), lambda x: x != "")
        return F.struct(r["bad"].alias("bad"), r["found"].alias("found"), broken.alias("broken"), F.array_sort(F.array_distinct(F.transform(labels, lambda x: F.concat(F.lit(prefix), x)))).alias("labels"))

    def coded(r: Column) -> Column:
        code = F.when(r["bad"], "MALFORMED_SCHEMA_HINT").when(F.size(r["found"]) == 0, "MISSING_SCHEMA_HINT").when(r["broken"], "MALFORMED_SCHEMA_HINT")
        code = code.when(F.size(r["found"]) > 1, "AMBIGUOUS_SCHEMA_HINT").when(F.size(r["labels"]) == 0, "UNRECOGNIZED_SCHEMA_HINT")
        return F.struct(code.alias("code"), F.when(r["bad"], none).otherwise(r["labels"]).alias("candidates"), r["found"].alias("locations"))

    def revised(r: Column) -> Column:
        return F.struct(r["code"].alias("code"), F.when(r["code"].isNull(), F.get(r["candidates"], F.lit(0))).alias("revision"), r["candidates"].alias("candidates"), r["locations"].alias("locations"))

    raw = F.struct(F.coalesce(ns, F.lit("")).alias("ns"), words(schema_location).alias("parts"), words(no_namespace).alias("alone"))
    return _let(_let(_let(_let(raw, located), labelled), coded), revised)


def revisions(node_table: DataFrame, pattern: str, prefix: str = "") -> DataFrame:
    """(doc_id, code, revision) of each root."""
    root = node_table.filter("parent_id is null")
    at = lambda name: F.col("attrs")["{" + XSI + "}" + name]
    found = root.select("doc_id", hint(F.col("ns"), at("schemaLocation"), at("noNamespaceSchemaLocation"), pattern, prefix).alias("h"))
    return found.select("doc_id", "h.code", "h.revision")

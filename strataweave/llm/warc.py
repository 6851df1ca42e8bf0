"""WARC archives: writing with revisit records, and reading back by boundary-chain verification.

Writing goes through Spark's text writer with the record terminator as line separator, so it works on any file system Spark
writes to and is committed by task. Reading goes through Spark's text reader with the record magic as delimiter, so archives of any
size are split. Tasks emit, for every occurrence of the magic, a candidate offset and the successor its header implies.
Payloads may hold the magic as well; pointer jumping from offset 0 of each file keeps only reachable candidates:
in round k every known record adds the one 2**k records on. Within a segment of a file these rounds run in one task's memory; between
segments they run as joins, so a file of n segments takes log2(n) of those, and a file of one segment none.

Equal payloads are found on their keys alone (SHA-1, SHA-256 and length). A bitmap of the keys that stand in several rows tells which
payloads must meet their group's first record; only those are shuffled. The other payloads are written where they were read, and
revisits need none.

Defined results: null html is an empty payload; equal payloads of `least_bytes` and more become revisits of the smallest id;
rows that repeat an id with an equal payload are responses both; a revisit names its response by id and digest, so an id may stand
for several payloads; a null id is kept, sorts after all others and is never referred to; other columns are ignored; an empty
table gives empty archives and no records.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_table, key_join, prepare, table, thinned

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
_FIELD = re.compile(rb"^([A-Za-z-]+):[ \t]*(.*?)[ \t]*\r?$", re.M)
LEAST_BYTES = 0
#: Bytes of a file whose candidates one task holds: at most a tenth as many, of two integers each.
SEGMENT = 64 << 20


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = LEAST_BYTES) -> tuple[DataFrame, list[DataFrame]]:
    """(page_id, url, payload, n, sha, refers_to), which rows are responses, which revisit another (without a payload); and the
    tables this reads, to be dropped when it is written."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    raw = F.col("payload").cast("binary")
    rows = rows.withColumn("n", F.octet_length("payload").cast("long")).withColumn("sha", F.sha1(raw)).withColumn("key", F.unhex(F.sha2(raw, 256)))
    keys = table(rows.drop("payload"), "keys")
    groups = keys.filter(F.col("n") >= least_bytes).groupBy("sha", "key", "n").agg(F.min("page_id").alias("first"), F.count("*").alias("rows"))
    groups = table(groups.filter("rows > 1"), "groups")
    several = groups.count()
    # A group's response is found by key and id, so its copies lie in as many tasks as they have ids.
    keyed, hit = thinned(keys, ["key"], groups, several)
    firsts = keyed.filter(hit).groupBy("sha", "key", "n").agg(F.min("page_id").alias("first"))
    columns = ["page_id", "url", "payload", "n", "sha"]
    marked, may = thinned(rows, ["key"], groups, several)
    may = may & (F.col("n") >= least_bytes)
    maybe = marked.filter(may).select(*columns, "key")
    same = (maybe["sha"] == firsts["sha"]) & (maybe["key"] == firsts["key"]) & (maybe["n"] == firsts["n"]) & maybe["page_id"].eqNullSafe(firsts["first"])
    responses = marked.filter(~may).select(*columns).unionByName(maybe.join(firsts, same, "left_semi").select(*columns))
    copies = key_join(keys, groups.withColumnsRenamed({"sha": "sha_", "n": "n_"}), "key", "rows", keys.count())
    copies = copies.filter((F.col("sha") == F.col("sha_")) & (F.col("n") == F.col("n_")) & F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")))
    revisits = copies.select("page_id", "url", F.lit("").alias("payload"), "n", "sha", F.col("first").alias("refers_to"))
    return responses.withColumn("refers_to", F.lit(None).cast("long")).unionByName(revisits), [keys, groups]


def write(pages: DataFrame, path: str, **columns) -> None:
    """Write the rows as WARC files under path."""
    rows, made = plan_records(pages, **columns)
    nl = "\r\n"
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    # Base32 of the 160-bit digest: letter i is place i % 4 of the four base-32 digits in the i // 4-th group of five hex digits.
    group = lambda i: F.conv(F.substr(F.col("sha"), F.floor(i / 4).cast("int") * 5 + 1, F.lit(5)), 16, 10).cast("long")
    letter = lambda i: F.substr(alphabet, F.pmod(F.floor(group(i) / F.pow(F.lit(32), 3 - F.pmod(i, F.lit(4)))).cast("int"), F.lit(32)) + 1, F.lit(1))
    b32 = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), letter), "")
    revisit = F.col("refers_to").isNotNull()
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    name = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    head = F.concat(
        F.lit(MAGIC),
        F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit(nl),
        F.lit("WARC-Record-ID: "), name(F.coalesce(F.col("page_id").cast("string"), F.lit(""))), F.lit(nl),
        F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", " "), F.lit(nl),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z" + nl),
        F.lit("WARC-Payload-Digest: sha1:"), b32, F.lit(nl),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name(F.col("refers_to")), F.lit(nl + "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest" + nl))).otherwise(F.lit("")),
        F.lit("Content-Type: text/html" + nl + "Content-Length: "), F.octet_length(body).cast("string"), F.lit(END),
    )
    rows.select(F.concat(head, body).alias("value")).write.option("lineSep", END).text(path)
    drop_table(*made)


def _scanned(spark: SparkSession, path: str) -> DataFrame:
    """Candidates by file and block: (file, block, at, size, head, length, kind, id, refers, sha); at counts bytes within the block."""
    prepare(spark)
    raw = spark.read.option("lineSep", MAGIC).text(path).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))

    def scan(batches):
        where, at = None, 0
        for b in batches:
            out = []
            for value, file, block in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if (file, block) != where:
                    where, at = (file, block), 0
                v = value.as_py()
                head = v.find(b"\r\n\r\n")
                fields = {k.lower(): x for k, x in _FIELD.findall(v[:head])} if head >= 0 else {}
                length = fields.get(b"content-length", b"")
                ok = length.isdigit()
                n = int(length) if ok else -1
                begin = head + 4
                complete = ok and begin + n <= len(v)
                text = lambda k: fields[k].decode("utf-8", "replace") if k in fields else None
                out.append((file, block, at, len(v), begin, n, text(b"warc-type"), text(b"warc-record-id"), text(b"warc-refers-to"), text(b"warc-payload-digest"), digest(v[begin : begin + n]) if complete else None))
                at += len(v) + len(MAGIC)
            cols = list(zip(*out, strict=True)) or [()] * 11
            kinds = [pa.string(), *[pa.int64()] * 5, *[pa.string()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["file", "block", "at", "size", "head", "length", "kind", "id", "refers", "stated", "sha"])

    return raw.mapInArrow(scan, "file string, block long, at long, size long, head long, length long, kind string, id string, refers string, stated string, sha string")


def _successors(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one segment: offsets in order, their successors (-1: none), and the place of each one's successor; its own if that isn't here."""
    off, succ = t.column("off").to_numpy(), t.column("succ").fill_null(-1).to_numpy()
    order = np.argsort(off, kind="stable")
    off, succ = off[order], succ[order]
    at = np.minimum(np.searchsorted(off, succ), len(off) - 1)
    return off, succ, np.where((off[at] == succ) & (succ > off), at, np.arange(len(off)))


def _exits(links: DataFrame) -> DataFrame:
    """(file, off, succ): where the chain of each candidate first leaves its segment, for those whose chain does."""

    def leave(t: pa.Table) -> pa.Table:
        off, succ, to = _successors(t)
        while (to != to[to]).any():
            to = to[to]
        out = succ[to]
        gone = out // SEGMENT > off // SEGMENT
        return pa.table({"file": pa.array([t.column("file")[0].as_py()] * int(gone.sum()), pa.string()), "off": off[gone], "succ": out[gone]})

    return links.groupBy("file", F.expr(f"off div {SEGMENT}").alias("segment")).applyInArrow(leave, "file string, off long, succ long")


def _entries(links: DataFrame) -> DataFrame:
    """(file, off): offset 0 of each file, and where its chain enters each later segment, by pointer jumping from exit to exit."""
    known = links.filter("off = 0").select("file", "off")
    exits = table(_exits(links), "exits")
    targets = exits.select("file", F.col("succ").alias("off")).distinct()
    jump = table(exits.filter("off > 0").join(targets, ["file", "off"], "left_semi").unionByName(exits.filter("off = 0")), "jump")
    drop_table(exits)
    if jump.isEmpty():
        return known
    known = table(known, "known")
    n = known.count()
    while True:
        step = known.join(jump, ["file", "off"]).select("file", F.col("succ").alias("off"))
        new = table(known.unionByName(step).distinct(), "known")
        drop_table(known)
        known, before, n = new, n, new.count()
        if n == before:
            return known
        onward = jump.select("file", F.col("off").alias("succ"), F.col("succ").alias("next"))
        longer = table(jump.join(onward, ["file", "succ"]).select("file", "off", F.col("next").alias("succ")), "jump")
        drop_table(jump)
        jump = longer


def _reachable(links: DataFrame) -> DataFrame:
    """links: (file, off, succ). The (file, off) on the chain from offset 0 of each file. Pointers are jumped at two levels: within
    segments of SEGMENT bytes, each in the memory of one task, and from segment to segment between tables.
    """
    marks = _entries(links).select("file", "off", F.lit(None).cast("long").alias("succ"), F.lit(True).alias("entry"))
    rows = links.select("file", "off", "succ", F.lit(False).alias("entry")).unionByName(marks)

    def mark(t: pa.Table) -> pa.Table:
        own = t.filter(pc.invert(t.column("entry")))
        if not own.num_rows:
            return pa.table({"file": pa.array([], pa.string()), "off": pa.array([], pa.int64())})
        off, _, to = _successors(own)
        on = np.isin(off, t.filter(t.column("entry")).column("off").to_numpy())
        while (to != to[to]).any():
            on[to[on]] = True
            to = to[to]
        on[to[on]] = True
        return pa.table({"file": pa.array([t.column("file")[0].as_py()] * int(on.sum()), pa.string()), "off": off[on]})

    return rows.groupBy("file", F.expr(f"off div {SEGMENT}").alias("segment")).applyInArrow(mark, "file string, off long")


def _offsets(scanned: DataFrame) -> DataFrame:
    """Adds off, the offset of each piece's magic in its file: block totals are summed, not pieces. File starts have none."""
    blocks = scanned.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("n"))
    base = blocks.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return scanned.join(base, ["file", "block"]).withColumn("off", F.col("base") + F.col("at") - len(MAGIC)).filter("off >= 0").drop("base")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, off, record_type, record_id, refers_to, stated_digest, payload_bytes, payload_digest) of every true record."""
    return _read(spark, path)[0]


def _read(spark: SparkSession, path: str) -> tuple[DataFrame, list[DataFrame]]:
    """The records, and the tables they are read from."""
    scanned = table(_scanned(spark, path), "scanned")
    pieces = table(_offsets(scanned).withColumn("succ", F.when(F.col("length") >= 0, F.col("off") + len(MAGIC) + F.col("head") + F.col("length") + len(END))), "pieces")
    drop_table(scanned)
    chain = table(_reachable(pieces.select("file", "off", "succ")), "chain")
    records = table(pieces.join(chain, ["file", "off"], "left_semi").filter("length >= 0"), "records")
    whole = records.filter("sha is not null")
    broken = records.filter("sha is null")
    if not broken.isEmpty():
        # The payload holds the magic: gather the pieces up to the successor and join them again.
        start = F.when(F.col("true"), F.col("off"))
        marked = pieces.select("file", "block", "at", "off").join(chain.withColumn("true", F.lit(True)), ["file", "off"], "left")
        owned = marked.withColumn("own", F.last(start, ignorenulls=True).over(Window.partitionBy("file").orderBy("off")))
        parts = owned.join(broken.select("file", F.col("off").alias("own")), ["file", "own"], "left_semi").select("file", "block", "at", "off", "own")
        texts = spark.read.option("lineSep", MAGIC).text(path).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
        needed = F.broadcast(parts.select("file", "block").distinct()) if parts.count() <= 100_000 else parts.select("file", "block").distinct()
        texts = texts.join(needed, ["file", "block"], "left_semi")
        kept = texts.mapInArrow(_numbered, "file string, block long, at long, value binary")
        gathered = kept.join(parts, ["file", "block", "at"]).groupBy("file", "own").agg(F.array_sort(F.collect_list(F.struct("off", "value"))).alias("parts"))
        payload = broken.join(gathered.withColumnRenamed("own", "off"), ["file", "off"])

        def rejoin(batches):
            for b in batches:
                sha = []
                for parts_, head, n in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                    v = MAGIC.encode().join(p["value"] for p in parts_)
                    sha.append(digest(v[head : head + n]) if head + n <= len(v) else None)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sha, pa.string())], ["file", "off", "sha"])

        shas = payload.select("file", "off", "parts", "head", "length").mapInArrow(rejoin, "file string, off long, sha string")
        whole = whole.unionByName(broken.drop("sha").join(shas, ["file", "off"]).select(*whole.columns))
    found = whole.select("file", "off", F.col("kind").alias("record_type"), F.col("id").alias("record_id"), F.col("refers").alias("refers_to"), F.col("stated").alias("stated_digest"), F.col("length").alias("payload_bytes"), F.col("sha").alias("payload_digest"))
    return found, [pieces, chain, records]


def _numbered(batches):
    where, at = None, 0
    for b in batches:
        places = []
        for value, file, block in zip(b.column("value"), b.column("file").to_pylist(), b.column("block").to_pylist(), strict=True):
            if (file, block) != where:
                where, at = (file, block), 0
            places.append(at)
            at += len(value.as_buffer()) + len(MAGIC)
        yield pa.RecordBatch.from_arrays([b.column("file"), b.column("block"), pa.array(places, pa.int64()), b.column("value")], ["file", "block", "at", "value"])


def page_of(name: Column) -> Column:
    number = F.regexp_extract(name, r"^<urn:page:(-?[0-9]+)>$", 1)
    return F.when(number != "", number).cast("long")


def round_trip(pages: DataFrame, path: str, **columns) -> DataFrame:
    """Write, read back, and resolve revisits: the full payload's size and digest of every page."""
    write(pages, path, **columns)
    got, made = _read(pages.sparkSession, path)
    stated = F.regexp_replace("stated_digest", "^sha1:", "")
    got = table(got.select(page_of(F.col("record_id")).alias("page_id"), "record_type", page_of(F.col("refers_to")).alias("refers_to"), stated.alias("stated"), "payload_bytes", "payload_digest"), "records")
    drop_table(*made)
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    revisits = got.filter("refers_to is not null").select("page_id", "record_type", "refers_to", F.struct("refers_to", "stated").alias("of"))
    full = got.filter("record_type = 'response'").groupBy(F.struct(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("stated")).alias("of")).agg(F.max("payload_bytes").alias("payload_bytes"))
    asked = revisits.groupBy("of").agg(F.count("*").alias("rows")).join(full, "of").withColumn("payload_digest", F.col("of.stated"))
    again = key_join(revisits, asked, "of", "rows", revisits.count())
    return got.filter("refers_to is null").select(*columns).unionByName(again.select(*columns))

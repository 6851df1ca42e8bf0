"""Reports of classified changes: JSON, text and HTML files.

Rows are rendered to text and put in order on the executors. A report is one file and so has a ceiling of characters, which one
aggregation checks before anything reaches the driver; beyond it the report fails and is never cut. Rows then stream to the
driver a partition at a time, into a temporary file beside the target that replaces it only when whole. Changes of any number go to a
table of rows instead (`change_rows(...).write`).
"""

from __future__ import annotations

import contextlib
import json
import os
import tempfile
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ReportError, ResourceLimitError
from ..functions import text as T
from ..operators import diff

#: Characters of a report.
CEILING = 64 << 20
COLUMNS = ("key", "canonical_type", "field", "kind", "category", "before", "after")

_PAGE = """<!doctype html>
<html lang="en"><head><meta charset="utf-8"><meta http-equiv="Content-Security-Policy" content="default-src 'none'; style-src 'unsafe-inline'">
<title>{title}</title><style>table{{border-collapse:collapse}}td,th{{border:1px solid #999;padding:2px 6px;text-align:left}}</style></head>
<body><h1>{title}</h1><p>{summary}</p>
<table><tr><th>change</th><th>entity</th><th>field</th><th>before</th><th>after</th></tr>
"""


def change_rows(changes: DataFrame) -> DataFrame:
    """(code, json) of each change: its public code, and canonical JSON with the keys in order and nulls kept."""
    coded = changes.select(*COLUMNS).withColumn("code", diff.change_code(F.col("canonical_type"), F.col("kind")))
    return coded.select("code", T.canonical_json(*COLUMNS, "code").alias("json"))


def _shown(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("—"))


def html_rows(changes: DataFrame) -> DataFrame:
    """(key, field, html) of each change: an escaped table row."""
    cells = [diff.change_code(F.col("canonical_type"), F.col("kind")), F.concat_ws(" ", "canonical_type", "key"), *(_shown(c) for c in ("field", "before", "after"))]
    row = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), T.html_escape(c), F.lit("</td>")) for c in cells], F.lit("</tr>"))
    return changes.select("key", "field", row.alias("html"))


def text_rows(changes: DataFrame) -> DataFrame:
    """(key, field, line) of each change; control characters and line ends are escaped as in JSON, so a change is one line."""
    plain = lambda c: F.when(F.col(c).isNull(), "none").otherwise(F.regexp_extract(F.to_json(F.struct(F.col(c).cast("string").alias("v"))), r'^\{"v":([\s\S]*)\}$', 1))
    line = F.concat(F.col("category"), F.lit("  "), F.col("kind"), F.lit("  "), F.concat_ws(" ", "canonical_type", "key"), F.lit("."), F.col("field"), F.lit(": "), plain("before"), F.lit(" -> "), plain("after"))
    return changes.select("key", "field", line.alias("line"))


def _summary(changes: DataFrame) -> dict:
    return diff.summary(changes).first().asDict()


def _ordered(rows: DataFrame, column: str, order: Iterable[str]) -> Iterator[str]:
    """The texts in order, after the check of their size."""
    size = rows.agg(F.coalesce(F.sum(F.length(column) + 1), F.lit(0)).alias("n")).first()["n"]
    if size > CEILING:
        raise ResourceLimitError(f"the report has {size} characters, more than {CEILING}")
    return (r[0] for r in rows.orderBy(*order, column).select(column).toLocalIterator())


def _inode(path: str) -> tuple | None:
    try:
        found = os.stat(path)
    except OSError:
        return None
    return found.st_dev, found.st_ino


@contextlib.contextmanager
def _sibling(target: str):
    """A temporary file beside the target, gone afterwards unless it took the target's place."""
    fd, name = tempfile.mkstemp(prefix=".report-", dir=os.path.dirname(target))
    try:
        with open(fd, "w", encoding="utf-8", newline="") as f:
            yield f
        os.replace(name, target)
    except BaseException:
        os.unlink(name)
        raise


def write_atomically(path: str, parts: Iterable[str], inputs: Iterable[str] = ()) -> None:
    """Write a local file whole or not at all. It may be none of the inputs, by any name or link."""
    target = os.path.abspath(path)
    taken = {x for i in inputs for x in (_inode(i), os.path.realpath(i)) if x}
    if taken & {_inode(target), os.path.realpath(target)}:
        raise ReportError(f"{path} is an input")
    try:
        with _sibling(target) as f:
            f.writelines(parts)
    except OSError as e:
        raise ReportError(f"{path} can't be written: {e.strerror}") from e


def write_json(changes: DataFrame, path: str, inputs: Iterable[str] = ()) -> None:
    """{"changes": [...], "schema_version": "2.0", "summary": {...}}: changes in order of their JSON text."""

    def parts():
        yield '{"changes":['
        for i, row in enumerate(_ordered(change_rows(changes), "json", ())):
            yield ("," if i else "") + row
        yield '],"schema_version":"2.0","summary":' + json.dumps(_summary(changes), sort_keys=True, separators=(",", ":")) + "}\n"

    write_atomically(path, parts(), inputs)


def write_text(changes: DataFrame, path: str, inputs: Iterable[str] = ()) -> None:
    s = _summary(changes)
    head = "".join(f"{k.replace('_', ' ')}: {v}\n" for k, v in s.items())
    write_atomically(path, (x for part in ([head], (line + "\n" for line in _ordered(text_rows(changes), "line", ("key", "field")))) for x in part), inputs)


def write_html(changes: DataFrame, path: str, title: str = "Interface changes", inputs: Iterable[str] = ()) -> None:
    """An offline page without scripts; every value is escaped."""
    import html

    s = _summary(changes)
    head = _PAGE.format(title=html.escape(title), summary=html.escape("; ".join(f"{k.replace('_', ' ')} {v}" for k, v in s.items())))
    rows = (row + "\n" for row in _ordered(html_rows(changes), "html", ("key", "field")))
    write_atomically(path, (x for part in ([head], rows, ["</table></body></html>\n"]) for x in part), inputs)

"""Command line.

    python -m strataweave inspect FILE [--type T] [--id I] [--wkn W] [--json]
    python -m strataweave explore FILE KIND:VALUE [--depth N] [--json]
    python -m strataweave compare OLD NEW [--type T] [--only-changed] [--include-documentation] [--no-color] [--json]
    python -m strataweave report FILE_OR_OLD [NEW] --html FILE

Files are local documents. Findings never change the exit status: 0 is success, 2 an error, told on stderr.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from . import engine
from .errors import EngineError, UnsupportedRevisionError, worker_errors
from .operators.graph import MAX_DEPTH
from .sinks import documents, pages, reports, views
from .sources.dictionary import TYPES
from .sources.paths import local_path


def _one(spark: SparkSession, name: str) -> tuple[engine.Interface, dict]:
    interface = engine.load_local(spark, name)
    row = interface.documents.select("doc_id", "revision").first()
    return interface, {"path": row.doc_id, "revision": row.revision}


def _two(spark: SparkSession, old: str, new: str):
    a, b = _one(spark, old), _one(spark, new)
    return a, b, engine.compare(a[0], b[0])


def report_files(spark: SparkSession, old: str, new: str) -> dict:
    """The report document of two local files."""
    a, b, changes = _two(spark, old, new)
    return documents.report(changes, a[1], b[1], a[0].diagnostics, b[0].diagnostics)


def inspect(spark: SparkSession, args) -> str:
    interface, src = _one(spark, args.file)
    found = views.inspection(interface, src["path"], args.type, args.id, args.wkn)
    return documents.dump(found) + "\n" if args.json else views.inspection_text(found)


def explore(spark: SparkSession, args) -> str:
    views.parse_selector(args.entity)
    interface, src = _one(spark, args.file)
    found = views.exploration(interface, src["path"], args.entity, args.depth)
    return documents.dump(found) + "\n" if args.json else views.exploration_text(found)


def compare(spark: SparkSession, args) -> str:
    a, b, changes = _two(spark, args.old, args.new)
    found = views.comparison(changes, a[1], b[1], {"old": a[0].diagnostics, "new": b[0].diagnostics}, args.type, args.only_changed, args.include_documentation)
    color = not args.no_color and sys.stdout.isatty() and "NO_COLOR" not in os.environ
    return documents.dump(found) + "\n" if args.json else views.comparison_text(found, color)


def report(spark: SparkSession, args) -> str:
    inputs = [args.old] + ([args.new] if args.new else [])
    target = str(local_path(args.html))
    if args.new:
        page = pages.comparison_page(report_files(spark, args.old, args.new))
    else:
        page = interface_page(*_one(spark, args.old))
    reports.write_atomically(target, [page], inputs)
    return f"wrote {target}\n"


def interface_page(interface: engine.Interface, src: dict) -> str:
    import json

    model = json.loads(documents.canonical_json(interface, src["path"]))
    relationships = [json.loads(t) for t in documents._texts(documents.relationship_rows(interface.relationships))]
    told = [json.loads(t) for t in documents._texts(documents.diagnostic_rows(interface.diagnostics))]
    return pages.interface_page(model, relationships, told, src["path"], src["revision"])


def _depth(text: str) -> int:
    if not text.isascii() or not text.isdigit() or int(text) > MAX_DEPTH:
        raise argparse.ArgumentTypeError(f"depth is a number from 0 to {MAX_DEPTH}")
    return int(text)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strataweave", allow_abbrev=False)
    p.add_argument("--version", action="version", version=f"%(prog)s {documents.VERSION}")
    commands = p.add_subparsers(dest="command")

    def command(run, help_: str, *names: str) -> argparse.ArgumentParser:
        c = commands.add_parser(run.__name__, help=help_, allow_abbrev=False)
        c.set_defaults(run=run)
        for n in names:
            c.add_argument(n)
        return c

    c = command(inspect, "count, select and check the entities of a document", "file")
    c.add_argument("--type", choices=TYPES)
    c.add_argument("--id")
    c.add_argument("--wkn")
    c.add_argument("--json", action="store_true")
    c = command(explore, "what lies within a few references of an entity", "file", "entity")
    c.add_argument("--depth", type=_depth, default=1)
    c.add_argument("--json", action="store_true")
    c = command(compare, "what changed between two documents", "old", "new")
    c.add_argument("--type", choices=views.COMPARED)
    for flag in ("--only-changed", "--include-documentation", "--no-color", "--json"):
        c.add_argument(flag, action="store_true")
    c = command(report, "write a page about one document or two", "old")
    c.add_argument("new", nargs="?")
    c.add_argument("--html", required=True)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command is None:
        parser().print_help()
        return 0
    from .session import session

    try:
        with worker_errors():
            out = args.run(spark or session(), args)
    except UnsupportedRevisionError as e:
        print(f"error: {e.code}: {e}", file=sys.stderr)
        return 2
    except (EngineError, PySparkException, OSError) as e:
        print(f"error: {str(e).strip().splitlines()[0] if str(e).strip() else type(e).__name__}", file=sys.stderr)
        return 2
    sys.stdout.write(out)
    return 0

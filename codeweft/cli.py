"""Command line: ``python -m codeweft.cli FOLDER COMMAND ...`` prints the rows of a call as lines of JSON."""

from __future__ import annotations

import argparse
import datetime as dt
import sys

from pyspark.sql import DataFrame, SparkSession

from codeweft.api import Engine


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="codeweft")
    p.add_argument("folder", help="folder of the Parquet tables")
    s = p.add_subparsers(dest="command", required=True)
    for name, args in {"status": (), "context": ("task",), "search": ("task",), "impact": ("fqn",), "flow": ("start", "end"), "skeleton": ("file",), "anchors": ("text",), "memory": ("query",), "session": (), "diff": ("file",), "stats": (), "docs": (), "config": ()}.items():
        c = s.add_parser(name)
        for a in args:
            c.add_argument(a)
        c.add_argument("--now", default=None)
        c.add_argument("--days", type=int, default=30)
    return p


def rows(e: Engine, a: argparse.Namespace) -> list[DataFrame]:
    now = dt.datetime.fromisoformat(a.now) if a.now else dt.datetime.now(dt.UTC).replace(tzinfo=None)
    match a.command:
        case "status":
            return [e.index_status()]
        case "context":
            return [e.run_pipeline(a.task)]
        case "search":
            return [e.select(a.task).ranked.orderBy("rank").limit(20)]
        case "impact":
            return [e.get_impact_graph(a.fqn)]
        case "flow":
            return [e.search_logic_flow(a.start, a.end)]
        case "skeleton":
            return [e.get_skeleton(a.file)]
        case "anchors":
            return [e.extract_anchors(a.text)]
        case "memory":
            return [e.search_memory(a.query, now)]
        case "session":
            return [e.get_session_context(now)]
        case "diff":
            return [e.get_diff_capsule(sys.stdin.read() if a.file == "-" else open(a.file, encoding="utf-8").read())]
        case "stats":
            return list(e.get_stats(now, a.days).values())
        case "docs":
            return [e.generate_module_docs()]
    raise ValueError(a.command)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    e = Engine(SparkSession.builder.appName("codeweft").getOrCreate(), a.folder)
    if a.command == "config":
        print(e.conf)
        return 0
    try:
        for df in rows(e, a):
            for line in df.toJSON().toLocalIterator():
                print(line)
    except LookupError as err:
        print(err, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())

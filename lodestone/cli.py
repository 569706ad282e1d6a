"""Command line: status, index, search, snippet, context, visualize, serve."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .api import CodeGraph
from .server import serve


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lodestone", description=__doc__)
    top.add_argument("--warehouse")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("status", "index", "visualize"):
        commands.add_parser(name).add_argument("path", nargs="?", default=".")
    indexing = commands.choices["index"]
    mode = indexing.add_mutually_exclusive_group()
    mode.add_argument("--full", dest="mode", action="store_const", const="full")
    mode.add_argument("--incremental", dest="mode", action="store_const", const="incremental")
    indexing.add_argument("--level", type=int, choices=(0, 1), default=0)
    commands.choices["visualize"].add_argument("--output")
    searching = commands.add_parser("search")
    searching.add_argument("query")
    searching.add_argument("path", nargs="?", default=".")
    searching.add_argument("--limit", type=int)
    snippet = commands.add_parser("snippet")
    snippet.add_argument("file")
    snippet.add_argument("path", nargs="?", default=".")
    snippet.add_argument("--start", type=int)
    snippet.add_argument("--end", type=int)
    context = commands.add_parser("context")
    context.add_argument("task")
    context.add_argument("path", nargs="?", default=".")
    context.add_argument("--budget", type=int)
    context.add_argument("--hint-path", action="append")
    context.add_argument("--hint-symbol", action="append")
    commands.add_parser("serve")
    return top


def report(command: str, result: dict, path: str) -> str:
    """What status and index print."""
    if command == "status":
        if result["status"] == "not_indexed":
            return f"Not indexed: {path}"
        langs = ", ".join(f"{lang}({n})" for lang, n in sorted(result["fileCounts"]["byLang"].items(), key=lambda x: -x[1]))
        rows = [("Last indexed", result["lastIndexedAt"]), ("Files", result["fileCounts"]["total"]), ("Languages", langs), ("Symbols", result["symbolCount"]), ("Edges", result["edgeCount"])]
        return "\n".join([f"Indexed: {result['rootPath']}", *(f"  {name + ':':<14}{value}" for name, value in rows if value != "")])
    names = {"Mode": "mode", "Level": "level", "Files indexed": "filesIndexed", "Files skipped": "filesSkipped", "Files deleted": "filesDeleted", "Symbols": "symbolCount", "Edges": "edgeCount"}
    lines = [f"Indexing: {path}", *(f"  {label + ':':<15}{result[key]}" for label, key in names.items() if key != "filesDeleted" or result[key])]
    lines.append(f"  {'Duration:':<15}{result['durationMs']}ms")
    return "\n".join(lines + (["  Warnings:", *(f"    - {w}" for w in result["warnings"])] if result["warnings"] else []))


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("lodestone").getOrCreate()
    graph = CodeGraph(spark, a.warehouse, getattr(a, "path", None))
    if a.command == "serve":
        serve(graph, sys.stdin, sys.stdout)
        return 0
    try:
        if a.command == "status":
            print(report("status", graph.status(a.path), a.path))
        elif a.command == "index":
            print(report("index", graph.index(a.path, a.mode, a.level), a.path))
        elif a.command == "search":
            print(json.dumps([r.asDict() for r in graph.search(a.path, a.query, a.limit).collect()], indent=2))
        elif a.command == "snippet":
            print(json.dumps(graph.snippet(a.path, a.file, a.start, a.end), indent=2))
        elif a.command == "context":
            hints = {"paths": a.hint_path or [], "symbols": a.hint_symbol or []}
            print(json.dumps(graph.context(a.path, a.task, a.budget, hints), indent=2))
        else:
            print(f"Graph written to: {graph.visualize(a.path, a.output)}")
    except ValueError as e:
        print(json.dumps({"error": str(e)}), file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())

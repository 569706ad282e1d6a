"""The five calls as a tool server: JSON-RPC 2.0, one message a line, over standard input and output."""

from __future__ import annotations

import json
from typing import TextIO

from .api import CodeGraph

VERSION = "2024-11-05"


def _schema(required: str, **properties: dict) -> dict:
    return {"type": "object", "properties": {"repo_path": {"type": "string", "description": "Root of the source tree"}} | properties, "required": required.split()}


def _of(kind: str, description: str, **more) -> dict:
    return {"type": kind, "description": description} | more


#: Names of the tools, their arguments, and the choices these have.
TOOLS = {
    "repo_status": ("Whether a tree is indexed, with its counts", _schema("repo_path")),
    "repo_index": (
        "Index a tree",
        _schema("repo_path", mode=_of("string", "Full, or only what has changed; by default whichever fits", enum=["full", "incremental"]), level=_of("number", "Depth; 0 by default", enum=[0, 1])),
    ),
    "repo_search": ("Rank files and symbols by the words of a query", _schema("repo_path query", query=_of("string", "Words that must all occur"), limit=_of("number", "Results, 1 to 100; 20 by default"))),
    "repo_snippet": (
        "Read lines of one file",
        _schema("repo_path file_path", file_path=_of("string", "Path of the file"), start_line=_of("number", "First line, from 1"), end_line=_of("number", "Last line")),
    ),
    "repo_context_get": (
        "Rank and cut the code that a task needs",
        _schema(
            "repo_path task",
            task=_of("string", "The task in plain words"),
            budget=_of("number", "Tokens of all pieces, 100 to 50000; 8000 by default"),
            hints=_of("object", "What to look at first", properties={"paths": {"type": "array", "items": {"type": "string"}}, "symbols": {"type": "array", "items": {"type": "string"}}, "lang": {"type": "string"}}),
        ),
    ),
}


def call(graph: CodeGraph, name: str, a: dict) -> dict:
    """The result of one tool call in its envelope; errors are results that say so."""
    try:
        if name == "repo_status":
            result = graph.status(a["repo_path"])
        elif name == "repo_index":
            result = graph.index(a["repo_path"], a.get("mode"), a.get("level") or 0)
        elif name == "repo_search":
            result = {"results": [r.asDict() for r in graph.search(a["repo_path"], a["query"], a.get("limit")).collect()]}
        elif name == "repo_snippet":
            result = graph.snippet(a["repo_path"], a["file_path"], a.get("start_line"), a.get("end_line"))
        elif name == "repo_context_get":
            result = graph.context(a["repo_path"], a["task"], a.get("budget"), a.get("hints"))
        else:
            raise ValueError(f"Unknown tool: {name}")
        return {"content": [{"type": "text", "text": json.dumps(result, indent=2, default=str)}]}
    except KeyError as e:
        return _failed(f"Missing argument: {e.args[0]}")
    except Exception as e:  # noqa: BLE001 - whatever a call meets is its caller's to read; the server goes on
        return _failed(str(e))


def _failed(message: str) -> dict:
    return {"content": [{"type": "text", "text": json.dumps({"error": message})}], "isError": True}


def answer(graph: CodeGraph, message: dict) -> dict | None:
    """The answer to one message; None to a notification."""
    method, params = message.get("method"), message.get("params") or {}
    if "id" not in message:
        return None
    reply = {"jsonrpc": "2.0", "id": message["id"]}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": params.get("protocolVersion", VERSION), "capabilities": {"tools": {}}, "serverInfo": {"name": "lodestone", "version": "2"}}}
    if method == "ping":
        return reply | {"result": {}}
    if method == "tools/list":
        return reply | {"result": {"tools": [{"name": n, "description": d, "inputSchema": x} for n, (d, x) in TOOLS.items()]}}
    if method == "tools/call":
        return reply | {"result": call(graph, params.get("name"), params.get("arguments") or {})}
    return reply | {"error": {"code": -32601, "message": f"Unknown method: {method}"}}


def serve(graph: CodeGraph, lines: TextIO, out: TextIO) -> None:
    for line in lines:
        if not line.strip():
            continue
        try:
            reply = answer(graph, json.loads(line))
        except (json.JSONDecodeError, AttributeError):
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "Not a message"}}
        if reply is not None:
            print(json.dumps(reply), file=out, flush=True)

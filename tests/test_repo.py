"""Walking, resolving, indexing, searching and context on small trees of our own."""

import io
import json
import os

import pytest
from pyspark.sql import functions as F

from lodestone import cli, server
from lodestone.api import CodeGraph
from lodestone.operators import resolve
from lodestone.parsers import parsed
from lodestone.sources import walk
from lodestone.streaming.incremental import index_on_change

TREE = {
    "src/app.ts": "import { Store } from './store';\nimport { Item } from './model/item.js';\nimport { all } from './model';\nimport x from 'outside';\nexport class App extends Store {}\n",
    "src/store.ts": "import { Item } from './model/item';\nexport class Store implements Bag {\n  put(i: Item) {}\n}\nexport class Bag {}\n",
    "src/model/item.ts": "export interface Item { id: number }\nexport const LIMIT = 3;\n",
    "src/model/index.ts": "export { Item } from './item';\nexport const all = 1;\n",
    "src/old.js": "const { Store } = require('./store');\nmodule.exports = { legacy };\nfunction legacy() {}\n",
    "pkg/__init__.py": "from .core import run\n",
    "README.md": "no language",
    ".hidden/a.ts": "export class Hidden {}",
    "node_modules/m/index.js": "exports.no = 1",
    "gen/out.ts": "export class Out {}",
    "gen/keep.ts": "export class Keep {}",
    ".gitignore": "gen/*\n!gen/keep.ts\n",
}


def plant(root, tree):
    for path, text in tree.items():
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text)
    return str(root)


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("repo")
    root = plant(base / "tree", TREE)
    graph = CodeGraph(spark, str(base / "warehouse"))
    return graph, root, graph.index(root)


def test_ignore_rules():
    rules = walk.Ignore(["*.log", "!keep.log", "/top", "dir/", "a/**/z", "x[0-9].ts", "# note", "", "b/*.c", "deep/**"])
    ignored = ["a.log", "p/q.LOG", "top", "dir/f", "p/dir/f", "a/z", "a/b/c/z", "x1.ts", "b/f.c", "deep/e/f"]
    kept = ["keep.log", "p/top", "dir", "xa.ts", "p/b/f.c", "deep", "note"]
    assert [p for p in ignored if not rules.ignored(p)] == [] and [p for p in kept if rules.ignored(p)] == []


def test_nothing_in_an_ignored_folder_comes_back():
    assert walk.Ignore(["dir/", "!dir/f"]).ignored("dir/f")


def test_walk(spark, tmp_path):
    root = plant(tmp_path, TREE)
    os.symlink(os.path.join(root, "src"), os.path.join(root, "link"))
    found = {r["path"]: r["lang"] for r in walk.source_files(walk.listing(spark, root)).collect()}
    assert found == {"src/app.ts": "typescript", "src/store.ts": "typescript", "src/model/item.ts": "typescript", "src/model/index.ts": "typescript", "src/old.js": "javascript", "pkg/__init__.py": "python", "gen/keep.ts": "typescript"}


def test_languages(spark):
    rows = spark.createDataFrame([("a.TSX",), ("d.x/b.pyi",), ("c",), (".ts",), ("e.hh",), (None,), ("x/.js",)], "p string")
    assert [r[0] for r in rows.select(walk.language(F.col("p"))).collect()] == ["typescript", "python", None, None, "cpp", None, None]


def test_paths_that_leave_the_root_are_null(spark):
    rows = spark.createDataFrame([("a/b", "../c"), ("", "./x"), ("a", "../../x"), ("a", ".."), ("a", "./b/../c/."), ("a", "../..")], "f string, r string")
    assert [r[0] for r in rows.select(resolve.joined_path(F.col("f"), F.col("r"))).collect()] == ["a/c", "x", None, "", "a/c", None]


def test_import_readings_by_preference(spark):
    paths = [("a.ts", False), ("a.tsx", False), ("b.js", False), ("b.ts", False), ("d", True), ("d/index.js", False), ("d/index.ts", False), ("e.json", False), ("e.json.ts", False), ("f.cpp", False)]
    listed = spark.createDataFrame([(1, p, d) for p, d in paths], "repo_id long, path string, is_dir boolean")
    files = listed.where("not is_dir and path <> 'e.json'").select("repo_id", "path", F.xxhash64("path").alias("file_id"))
    sources = ["./a", "./a.js", "./a.jsx", "./b", "./b.js", "./d", "./e.json", "./f", "./none", "a", "./main"]
    imports = spark.createDataFrame([(1, 0, "main.ts", s) for s in sources], "repo_id long, file_id long, path string, source string")

    def meant(strict):
        found = resolve.resolved(imports, listed, files, strict).join(files.select("path", F.col("file_id").alias("dst_id")).withColumnRenamed("path", "to"), "dst_id")
        return {r["source"]: r["to"] for r in found.collect()}

    both = {"./a": "a.ts", "./a.js": "a.ts", "./a.jsx": "a.tsx", "./b": "b.ts", "./b.js": "b.js", "./f": "f.cpp"}
    assert meant(False) == both | {"./d": "d/index.ts"}
    assert meant(True) == both


def test_index(indexed):
    graph, root, summary = indexed
    assert (summary["mode"], summary["filesIndexed"], summary["filesSkipped"], summary["warnings"]) == ("full", 7, 0, [])
    path = {r["file_id"]: r["path"] for r in graph.store.table("files", summary["repoId"]).collect()}
    name = {r["symbol_id"]: r["name"] for r in graph.store.table("symbols", summary["repoId"]).collect()}
    edges = {(r["rel"], path.get(r["src_id"]) or name[r["src_id"]], path.get(r["dst_id"]) or name[r["dst_id"]]) for r in graph.store.table("edges", summary["repoId"]).where("rel <> 'DEFINES'").collect()}
    assert edges == {
        ("IMPORTS", "src/app.ts", "src/store.ts"), ("IMPORTS", "src/app.ts", "src/model/item.ts"), ("IMPORTS", "src/app.ts", "src/model/index.ts"),
        ("IMPORTS", "src/store.ts", "src/model/item.ts"), ("IMPORTS", "src/old.js", "src/store.ts"),
        ("EXPORTS", "src/app.ts", "App"), ("EXPORTS", "src/store.ts", "Store"), ("EXPORTS", "src/store.ts", "Bag"), ("EXPORTS", "src/model/item.ts", "Item"),
        ("EXPORTS", "src/model/item.ts", "LIMIT"), ("EXPORTS", "src/model/index.ts", "all"), ("EXPORTS", "src/old.js", "legacy"), ("EXPORTS", "gen/keep.ts", "Keep"),
        ("IMPLEMENTS", "Store", "Bag"),
    }
    status = graph.status(root)
    assert status["fileCounts"] == {"total": 7, "byLang": {"typescript": 5, "javascript": 1, "python": 1}} and status["edgeCount"] == summary["edgeCount"]


def test_search(indexed):
    graph, root, _ = indexed
    found = graph.search(root, "Store").collect()
    assert found[0]["path"] == "src/store.ts" and all("store" in r["excerpt"].lower() for r in found)
    assert graph.search(root, "").count() == graph.search(root, "()").count() == graph.search(root, "NoSuchName").count() == 0
    assert graph.search(root, "store", 0).count() == 1
    assert {r["text"] for r in graph.search_prefix(root, "LIM").collect()} == {"LIMIT src/model/item.ts:LIMIT"}


def test_snippet(indexed):
    graph, root, _ = indexed
    assert graph.snippet(root, "src/store.ts", 2, 3)["text"] == "export class Store implements Bag {\n  put(i: Item) {}"
    assert graph.snippet(root, "src/store.ts", -5, 99)["total_lines"] == 6
    for bad in ("../../etc/passwd", "/etc/passwd", "none.ts", "src"):
        with pytest.raises(ValueError):
            graph.snippet(root, bad)


def test_context(indexed):
    graph, root, _ = indexed
    found = graph.context(root, "  Change   how src/model/item.ts is put in the store ", 5000, {"paths": ["src/old.js"], "symbols": ["App"]})
    assert found["intent"] == "Change how src/model/item.ts is put in the store"
    files = [f["path"] for f in found["focus"] if f["type"] == "file"]
    assert {"src/old.js", "src/app.ts", "src/model/item.ts", "src/store.ts"} <= set(files)
    assert found["focus"][0]["reason"].startswith(("hint:", "path-in-task"))
    assert found["limits"]["used_estimate"] == sum(-(-len(s["text"]) // 4) for s in found["snippets"]) <= 5000
    ends = {f"{n['type']}:{n['id']}" for n in found["subgraph"]["nodes"]}
    assert found["subgraph"]["edges"] and all({e["src"], e["dst"]} <= ends for e in found["subgraph"]["edges"])
    # The first piece is taken even over budget.
    assert len(graph.context(root, "LIMIT Store", 0, {"paths": ["src/store.ts"]})["snippets"]) >= 1


def test_context_without_candidates_is_empty(indexed):
    graph, root, _ = indexed
    found = graph.context(root, "")
    assert (found["focus"], found["snippets"], found["subgraph"]) == ([], [], {"nodes": [], "edges": []})


def test_graph_and_page(indexed, tmp_path):
    graph, root, _ = indexed
    nodes, links, counts = graph.graph(root)
    labels = {r["id"]: r["label"] for r in nodes.collect()}
    assert set(labels.values()) == {"src/app.ts", "src/store.ts", "model/item.ts", "model/index.ts", "src/old.js", "App", "Store", "Bag", "Item", "Keep"}
    assert all({r["source"], r["target"]} <= set(labels) for r in links.collect())
    assert counts.first()["classes"] == 4
    page = open(graph.visualize(root, str(tmp_path / "g.html"))).read()
    assert "src/store.ts" in page and page.count("</script>") == 2


def test_incremental_equals_full(spark, tmp_path, capsys):
    root = plant(tmp_path / "tree", TREE)
    graph = CodeGraph(spark, str(tmp_path / "warehouse"))
    assert graph.status(root) == {"status": "not_indexed"}
    assert graph.context(root, "x")["suggestion"] == "index"
    with pytest.raises(ValueError):
        graph.index(root, "incremental")
    repo = graph.index(root)["repoId"]
    assert graph.index(root)["filesIndexed"] == 0
    # One file changes, one goes, one comes that an unchanged file's import now means.
    plant(tmp_path / "tree", {"src/store.ts": "export class Store {}\nexport class Two {}\n", "outside.ts": "export class Gone {}\n"})
    os.remove(os.path.join(root, "src/model/item.ts"))
    plant(tmp_path / "tree", {"src/model/item.tsx": "export interface Item {}\n"})
    summary = graph.index(root)
    assert (summary["mode"], summary["filesIndexed"], summary["filesDeleted"]) == ("incremental", 3, 1)

    def state():
        tables = {"files": ["path", "sha256"], "symbols": ["fq_name", "kind"], "edges": ["rel", "src_id", "dst_id", "meta_json"], "search_index": ["entity_type", "entity_id", "text"], "contents": ["path", "text"]}
        return {name: sorted(map(str, graph.store.table(name, repo).select(*cols).collect())) for name, cols in tables.items()}

    after = state()
    assert graph.index(root, "full")["mode"] == "full"
    assert state() == after
    assert any("item.tsx" in f for f in after["files"])
    folders = os.listdir(tmp_path / "warehouse" / "data" / "files" / str(repo))
    assert len(folders) == 1
    assert cli.report("status", graph.status(root), root).startswith(f"Indexed: {root}\n  Last indexed: ")
    graph.store.drop(repo)
    assert graph.status(root) == {"status": "not_indexed"}


def test_a_failed_index_leaves_the_old_version(spark, tmp_path, monkeypatch):
    root = plant(tmp_path / "tree", {"a.py": "x = 1\n"})
    graph = CodeGraph(spark, str(tmp_path / "warehouse"))
    repo = graph.index(root)["repoId"]
    before = graph.store.manifest(repo)
    from lodestone.plans import index

    def fail(*_):
        raise RuntimeError("stop")

    monkeypatch.setattr(index, "search_rows", fail)
    with pytest.raises(RuntimeError):
        graph.index(root)
    assert graph.store.manifest(repo) == before and graph.store.table("symbols", repo).count() == 1


def test_empty_tree_and_odd_bytes(spark, tmp_path):
    graph = CodeGraph(spark, str(tmp_path / "warehouse"))
    (tmp_path / "empty").mkdir()
    assert graph.index(str(tmp_path / "empty"))["filesIndexed"] == 0
    root = tmp_path / "odd"
    root.mkdir()
    (root / "bad.py").write_bytes(b"x = '\xff\xfe'\n")
    (root / "none.ts").write_bytes(b"")
    graph.index(str(root))
    assert graph.index(str(root))["filesIndexed"] == 0
    for bad in (str(tmp_path / "missing"), str(root / "bad.py")):
        with pytest.raises(ValueError):
            graph.status(bad)


def test_parsed_column_keeps_clashing_columns(spark):
    rows = spark.createDataFrame([("def f(): pass", "python", 1), (None, "python", 2), ("x", None, 3)], "text string, lang string, symbols int")
    got = {r["symbols"]: [s["name"] for s in r["parsed"]["symbols"]] for r in parsed(rows).collect()}
    assert got == {1: ["f"], 2: [], 3: []}


def test_stream_indexes_trees_as_they_change(spark, tmp_path):
    root = plant(tmp_path / "tree", {"a.py": "x = 1\n"})
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "1.json").write_text(f'{{"root": "{root}"}}\n{{"root": "{root}"}}\n')
    changes = spark.readStream.schema("root string").json(str(inbox))
    index_on_change(changes, str(tmp_path / "warehouse")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert CodeGraph(spark, str(tmp_path / "warehouse")).status(root)["fileCounts"]["total"] == 1


def test_tool_server(indexed, tmp_path):
    graph, root, _ = indexed
    tree = plant(tmp_path / "other", {"a.ts": "import { b } from './b';\nexport class Žába {}\n", "b.ts": "export const b = 1;\n"})

    def tool(name, **a):
        return {"jsonrpc": "2.0", "id": 7, "method": "tools/call", "params": {"name": name, "arguments": a}}

    messages = [
        {"jsonrpc": "2.0", "id": 1, "method": "initialize", "params": {}}, {"jsonrpc": "2.0", "method": "notifications/initialized"}, {"jsonrpc": "2.0", "id": 2, "method": "tools/list"},
        tool("repo_status", repo_path=tree), tool("repo_index", repo_path=tree), tool("repo_status", repo_path=tree), tool("repo_search", repo_path=tree, query="zaba"),
        tool("repo_snippet", repo_path=tree, file_path="b.ts"), tool("repo_context_get", repo_path=tree, task="Change a.ts", hints={"paths": ["a.ts"]}),
        tool("repo_snippet", repo_path=tree, file_path="../x"), tool("none"), tool("repo_search", repo_path=tree), {"jsonrpc": "2.0", "id": 9, "method": "no/such"},
    ]
    out = io.StringIO()
    server.serve(graph, io.StringIO("\n".join([*map(json.dumps, messages), "", "{"])), out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert len(got) == len(messages) and got[0]["result"]["capabilities"] == {"tools": {}}
    assert {t["name"] for t in got[1]["result"]["tools"]} == {"repo_status", "repo_index", "repo_search", "repo_snippet", "repo_context_get"}
    results = [json.loads(x["result"]["content"][0]["text"]) for x in got[2:11]]
    assert results[0] == {"status": "not_indexed"} and results[1]["filesIndexed"] == 2 and results[2]["status"] == "indexed"
    assert results[3]["results"][0]["name"] == "Žába" and results[4]["text"] == "export const b = 1;\n"
    assert [x["path"] for x in results[5]["focus"] if x["type"] == "file"] == ["a.ts", "b.ts"]
    assert [("error" in x, y["result"].get("isError")) for x, y in zip(results[6:], got[8:11])] == [(True, True)] * 3
    assert got[11]["error"]["code"] == -32601 and got[12]["error"]["code"] == -32700


def test_neighbours_and_lookups(indexed):
    graph, root, _ = indexed
    ids = {r.path: r.file_id for r in graph.store.table("files", graph._known(root)).collect()}
    nodes, edges = graph.neighbours(root, "file", ids["src/store.ts"], 1, "incoming")
    assert {(r.type, r.id) for r in nodes.collect()} == {("file", ids[p]) for p in ("src/store.ts", "src/app.ts", "src/old.js")}
    assert {r.rel for r in edges.collect()} == {"IMPORTS"} and edges.count() == edges.distinct().count() == 2
    nodes, edges = graph.neighbours(root, "file", ids["src/app.ts"], 2, "outgoing")
    assert ids["src/model/item.ts"] in {r.id for r in nodes.collect()} and edges.count() == edges.distinct().count()
    with pytest.raises(ValueError):
        graph.neighbours(root, "file", 1, 1, "sideways")
    assert [r.name for r in graph.symbol(root, "src/store.ts:Bag").collect()] == ["Bag"] and graph.module(root, "none").count() == 0


def test_search_falls_back_to_a_prefix(indexed):
    graph, root, _ = indexed
    assert graph.search(root, "Stor").count() == 0
    assert {r.name for r in graph.search(root, "Stor", prefix=True).collect() if r.type == "symbol"} == {"Store", "Store.put", "Bag"}
    assert graph.search(root, "", prefix=True).count() == graph.search(root, "NoneSuch", prefix=True).count() == 0


def test_a_tree_may_hold_its_own_warehouse(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("LODESTONE_WAREHOUSE", str(tmp_path / "global"))
    assert CodeGraph(spark, repo_path=str(tmp_path)).store.root == str(tmp_path / "global")
    (tmp_path / ".lodestone" / "warehouse").mkdir(parents=True)
    assert CodeGraph(spark, repo_path=str(tmp_path)).store.root == str(tmp_path / ".lodestone" / "warehouse")
    assert CodeGraph(spark, "/given", str(tmp_path)).store.root == "/given"

"""One object for everything: index, status, search, snippet, context, graph."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import graph as operators
from .operators import search as text_search
from .plans import context as ctx
from .plans import index, visual
from .store import Store

#: Limits of calls.
MAX_SNIPPET_LINES = 500
LIMIT, BUDGET = (1, 100, 20), (100, 50_000, 8_000)


def _clamped(value: float | None, bounds: tuple[int, int, int]) -> int:
    low, high, default = bounds
    return default if value is None else max(low, min(high, int(value // 1)))


class CodeGraph:
    """A warehouse of indexed repositories.

    The warehouse is a folder on any file system that Spark reaches; by default the one in the given tree's own
    `.lodestone/warehouse`, where there is one, then that of LODESTONE_WAREHOUSE, else one in the user's home."""

    def __init__(self, spark: SparkSession, warehouse: str | None = None, repo_path: str | None = None):
        own = os.path.join(os.path.abspath(repo_path), ".lodestone", "warehouse") if repo_path else None
        self.spark = spark
        self.store = Store(spark, warehouse or (own if own and os.path.isdir(own) else None) or os.environ.get("LODESTONE_WAREHOUSE") or str(Path.home() / ".lodestone"))

    def _root(self, repo_path: str) -> str:
        root = os.path.abspath(repo_path)
        if not os.path.exists(root):
            raise ValueError(f"Path does not exist: {root}")
        if not os.path.isdir(root):
            raise ValueError(f"Path is not a directory: {root}")
        return root

    def _known(self, root: str) -> int | None:
        repo_id = index.repo_id_of(self.spark, root)
        return repo_id if self.store.manifest(repo_id) else None

    def _must_know(self, repo_path: str) -> tuple[str, int]:
        root = self._root(repo_path)
        repo_id = self._known(root)
        if repo_id is None:
            raise ValueError("Repository not indexed. Index it first.")
        return root, repo_id

    def tables(self, repo_id: int) -> ctx.Tables:
        one = lambda name: self.store.table(name, repo_id)
        return ctx.Tables(one("files"), one("symbols"), one("edges"), one("contents"), self.store.table("search_index"), repo_id)

    def index(self, repo_path: str, mode: str | None = None, level: int = 0, strict_compat: bool = False) -> dict:
        """Indexes a tree; incrementally if it is known and no mode is given."""
        return index.index_repo(self.store, self._root(repo_path), mode, level, strict_compat)

    def status(self, repo_path: str) -> dict:
        root = self._root(repo_path)
        repo_id = self._known(root)
        if repo_id is None:
            return {"status": "not_indexed"}
        by_lang = {r["lang"]: r["count"] for r in self.store.table("files", repo_id).groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()}
        return {
            "status": "indexed", "repoId": repo_id, "rootPath": root, "lastIndexedAt": str(self.store.table("repos", repo_id).first()["updated_at"]),
            "fileCounts": {"total": sum(by_lang.values()), "byLang": by_lang},
            "symbolCount": self.store.table("symbols", repo_id).count(), "edgeCount": self.store.table("edges", repo_id).count(),
        }

    def search(self, repo_path: str, query: str, limit: int | None = None, prefix: bool = False) -> DataFrame:
        """type, path, name, line, excerpt, score of the rows that hold every term, the best first; none for an
        empty query.  With `prefix`, where no row does, those with a token that begins as the query's first word,
        with score 0."""
        _, repo_id = self._must_know(repo_path)
        t, limit = self.tables(repo_id), _clamped(limit, LIMIT)
        hits = ctx.ranked_hits(t.search_index, repo_id, query, limit, every=True)
        if prefix and query.split() and not hits.head(1):
            own = t.search_index.where(F.col("repo_id") == repo_id).withColumn("key", F.struct("entity_type", "entity_id", "text"))
            hits = text_search.match_prefix(own, query.split()[0], "key").select("key.*", F.lit(0.0).alias("rank")).orderBy("entity_type", "entity_id").limit(limit)
        symbols = t.symbols.select(F.col("symbol_id").alias("entity_id"), "name", F.col("start_line").alias("line"), F.col("file_id").alias("_file"))
        files = t.files.select(F.col("file_id").alias("_in"), "path")
        found = hits.join(symbols, "entity_id", "left").withColumn("_in", F.coalesce("_file", "entity_id")).join(files, "_in", "left")
        lost = F.when(F.col("entity_type") == "file", F.concat(F.lit("file:"), F.col("entity_id").cast("string"))).otherwise("unknown")
        rows = found.select(F.col("entity_type").alias("type"), F.coalesce("path", lost).alias("path"), "name", "line", F.col("text").alias("excerpt"), F.col("rank").alias("score"))
        return rows.orderBy("score", "type", "path", "line")

    def search_prefix(self, repo_path: str, word: str, limit: int | None = None) -> DataFrame:
        """entity_type, entity_id, text of the rows with a token that begins with word."""
        _, repo_id = self._must_know(repo_path)
        rows = self.store.table("search_index", repo_id).select("entity_type", "entity_id", "text")
        return text_search.match_prefix(rows.withColumn("key", F.struct("entity_type", "entity_id", "text")), word, "key").select("key.*").orderBy("entity_type", "entity_id").limit(_clamped(limit, LIMIT))

    def neighbours(self, repo_path: str, node_type: str, node_id: int, depth: int = 1, direction: str = "both") -> tuple[DataFrame, DataFrame]:
        """Nodes around one node of the graph and the edges walked to them."""
        _, repo_id = self._must_know(repo_path)
        seed = self.spark.createDataFrame([(node_type, node_id)], "type string, id long")
        return operators.neighbours(self.store.table("edges", repo_id), seed, depth, direction)

    def symbol(self, repo_path: str, fq_name: str) -> DataFrame:
        """Symbols by their full name, `path:name`."""
        _, repo_id = self._must_know(repo_path)
        return operators.named(self.store.table("symbols", repo_id), "fq_name", fq_name)

    def module(self, repo_path: str, name: str) -> DataFrame:
        _, repo_id = self._must_know(repo_path)
        return operators.named(self.store.table("modules", repo_id), "name", name)

    def snippet(self, repo_path: str, file_path: str, start_line: int | None = None, end_line: int | None = None) -> dict:
        """Lines of one file on disk, at most 500; a path outside the tree or without a file is an error."""
        root = self._root(repo_path)
        full = os.path.abspath(os.path.join(root, file_path))
        if os.path.commonpath([root, full]) != root or os.path.commonpath([os.path.realpath(root), os.path.realpath(full)]) != os.path.realpath(root):
            raise ValueError(f"Path is outside the repository: {file_path}")
        if not os.path.isfile(full):
            raise ValueError(f"File does not exist: {file_path}")
        lines = Path(full).read_bytes().decode("utf-8", errors="replace").split("\n")
        start = max(1, min(start_line if start_line is not None else 1, len(lines)))
        end = max(start, min(end_line if end_line is not None else len(lines), len(lines)))
        end = min(end, start + MAX_SNIPPET_LINES - 1)
        return {"path": os.path.relpath(full, root).replace(os.sep, "/"), "start_line": start, "end_line": end, "total_lines": len(lines), "text": "\n".join(lines[start - 1 : end])}

    def context(self, repo_path: str, task: str, budget: int | None = None, hints: dict | None = None, fts_score: str = "inverted") -> dict:
        """The context bundle for a task; an error with a suggestion where the tree is not indexed."""
        root = self._root(repo_path)
        repo_id = self._known(root)
        if repo_id is None:
            return {"error": "Repository not indexed. Index it first.", "suggestion": "index"}
        kept: list[DataFrame] = []

        def keep(df: DataFrame) -> DataFrame:
            kept.append(df.persist())
            return kept[-1]

        try:
            return ctx.bundle(self.tables(repo_id), root, task, _clamped(budget, BUDGET), hints, fts_score, keep).first().asDict(recursive=True)
        finally:
            for df in kept:
                df.unpersist()

    def graph(self, repo_path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Nodes, links and counts of the drawn graph."""
        _, repo_id = self._must_know(repo_path)
        t = self.tables(repo_id)
        found = visual.links(t.symbols, t.edges)
        return visual.nodes(t.files, t.symbols, found), found, visual.stats(t.files, t.symbols, t.edges)

    def visualize(self, repo_path: str, output: str | None = None) -> str:
        """Writes the drawn graph as one HTML file and returns where."""
        root = self._root(repo_path)
        target = Path(output or os.path.join(root, ".lodestone", "graph.html"))
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(visual.page(*self.graph(root), root), encoding="utf-8")
        return str(target)

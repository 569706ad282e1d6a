"""Property-graph operators over an edge list: src, dst, and further columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the kinds of edges.
WEIGHTS = {"DEFINES": 1.0, "IMPORTS": 1.0, "EXPORTS": 0.8, "EXTENDS": 1.0, "IMPLEMENTS": 0.8}
DECAY = {0: 5, 1: 3, 2: 1}


def successive_edges(rows: DataFrame, group: str, node: str, order: list[str]) -> DataFrame:
    """Distinct src, dst of neighbouring rows in each group; no edges to itself."""
    after = F.lead(node).over(Window.partitionBy(group).orderBy(*order))
    return rows.select(F.col(node).alias("src"), after.alias("dst")).where("src <> dst").distinct()


def degree(edges: DataFrame) -> DataFrame:
    """node, degree: ends of edges, both directions.  Ends are counted before they are united."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def k_hop(edges: DataFrame, seeds: DataFrame, depth: int, both: bool = False) -> DataFrame:
    """node, depth: every node within `depth` steps of a seed, with its smallest distance.

    One join by level; nodes that were reached before leave the frontier by an anti join."""
    steps = edges.select("src", "dst")
    if both:
        steps = steps.union(edges.select("dst", "src")).distinct()
    seen = [seeds.select(F.col("node"), F.lit(0).alias("depth")).distinct()]
    for level in range(1, depth + 1):
        frontier = seen[-1].select(F.col("node").alias("src"))
        reached = steps.join(frontier, "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        known = reduce(DataFrame.union, seen).select("node")
        seen.append(reached.join(known, "node", "left_anti").withColumn("depth", F.lit(level)))
    return reduce(DataFrame.union, seen)


def expand_scored(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """node, depth, score: reached nodes, scored by distance."""
    score = F.lit(0)
    for d, s in DECAY.items():
        score = F.when(F.col("depth") == d, s).otherwise(score)
    return k_hop(edges, seeds, depth).withColumn("score", score)


def subgraph(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges with either end among chosen nodes; each side is a semi join, so no row is made twice."""
    nodes = chosen.select("node").distinct()
    by_src = edges.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi")
    rest = edges.join(nodes.withColumnRenamed("node", "src"), "src", "left_anti")
    by_dst = rest.join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return by_src.select("src", "dst").union(by_dst.select("src", "dst"))


def without_nodes(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges that touch none of the nodes."""
    nodes = gone.select("node").distinct()
    for end in ("src", "dst"):
        edges = edges.join(nodes.withColumnRenamed("node", end), end, "left_anti")
    return edges.select("src", "dst")


def neighbours(edges: DataFrame, seeds: DataFrame, depth: int = 1, direction: str = "both") -> tuple[DataFrame, DataFrame]:
    """Nodes (type, id, depth) within `depth` steps of the seeds (type, id), and the edges walked, each once.

    edges: src_type, src_id, dst_type, dst_id and further columns; direction: outgoing, incoming or both.  An edge is
    walked if it leaves a node that is less than `depth` steps away, wherever it leads."""
    if direction not in ("outgoing", "incoming", "both"):
        raise ValueError(f"Unknown direction: {direction}")
    at = {"outgoing": ("src",), "incoming": ("dst",), "both": ("src", "dst")}[direction]
    other = {"src": "dst", "dst": "src"}
    steps = reduce(DataFrame.union, [edges.select(f"{e}_type", f"{e}_id", f"{other[e]}_type", f"{other[e]}_id").toDF("type", "id", "to_type", "to_id") for e in at]).distinct()
    seen = [seeds.select("type", "id", F.lit(0).alias("depth")).distinct()]
    for level in range(1, depth + 1):
        reached = steps.join(seen[-1].select("type", "id"), ["type", "id"], "left_semi").select(F.col("to_type").alias("type"), F.col("to_id").alias("id")).distinct()
        known = reduce(DataFrame.union, seen).select("type", "id")
        seen.append(reached.join(known, ["type", "id"], "left_anti").withColumn("depth", F.lit(level)))
    nodes = reduce(DataFrame.union, seen)
    inner = nodes.where(F.col("depth") < depth).select("type", "id")
    walked, left = None, edges
    for e in at:
        ends, on = inner.toDF(f"{e}_type", f"{e}_id"), [f"{e}_type", f"{e}_id"]
        part = left.join(ends, on, "left_semi").select(*edges.columns)
        walked = part if walked is None else walked.union(part)
        left = left.join(ends, on, "left_anti").select(*edges.columns)
    return nodes, walked


def edges_at(edges: DataFrame, src: tuple[str, int] | None = None, dst: tuple[str, int] | None = None, rel: str | None = None) -> DataFrame:
    """Edges from one node, to one node and of one kind, as far as these are given."""
    for end, node in (("src", src), ("dst", dst)):
        if node is not None:
            edges = edges.where((F.col(f"{end}_type") == node[0]) & (F.col(f"{end}_id") == node[1]))
    return edges if rel is None else edges.where(F.col("rel") == rel)


def without_files(edges: DataFrame, symbols: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges that touch none of the files (file_id) nor any symbol of theirs."""
    files = gone.select(F.lit("file").alias("type"), F.col("file_id").alias("id"))
    own = symbols.join(gone.select("file_id"), "file_id", "left_semi").select(F.lit("symbol").alias("type"), F.col("symbol_id").alias("id"))
    nodes = files.union(own).distinct()
    for end in ("src", "dst"):
        edges = edges.join(nodes.toDF(f"{end}_type", f"{end}_id"), [f"{end}_type", f"{end}_id"], "left_anti")
    return edges


def named(rows: DataFrame, column: str, value: str, repo_id: int | None = None) -> DataFrame:
    """Rows of one name: symbols by `name` or `fq_name`, modules and files by theirs."""
    rows = rows.where(F.col(column) == value)
    return rows if repo_id is None else rows.where(F.col("repo_id") == repo_id)

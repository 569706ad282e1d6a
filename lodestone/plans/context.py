"""Ranked context for a task: candidates, expansion, ranking, snippets under a token budget, and the bundle."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph, relational, search

#: Scores, sizes and counts.
HINT, PATH_IN_TASK, CAMEL = 10.0, 8.0, 6.0
SEEDS, FOCUS, FTS_HITS, SYMBOLS_SHOWN, REASONS_SHOWN = 5, 10, 20, 3, 3
SMALL_FILE, CONTEXT_LINES, ENTRY_BONUS = 60, 3, 3.0
#: What a path and a name look like in a task, and paths that are entry points.
PATH_IN_TEXT = r"[\w./-]+/[\w./-]*\.(?:ts|js|tsx|jsx)\b"
CAMEL_CASE = r"\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\b"
ENTRY_POINT = r"/(?:routes|controllers|pages)/|/(?:app|main)\.[^/]+$|/index\.(?:ts|tsx|js|jsx)$"

CANDIDATE = "strategy int, ord long, key string, score double, reason string"


class Tables:
    """The tables of one repository, and the search rows of all, which the ranking's statistics are of."""

    def __init__(self, files: DataFrame, symbols: DataFrame, edges: DataFrame, contents: DataFrame, search_index: DataFrame, repo_id: int):
        self.files, self.symbols, self.edges, self.contents, self.search_index, self.repo_id = files, symbols, edges, contents, search_index, repo_id


def ranked_hits(search_index: DataFrame, repo_id: int, query: str, limit: int, every: bool) -> DataFrame:
    """entity_type, entity_id, text, rank of a repository's best rows; every: all terms must occur.

    Where no term has a letter or digit there are no rows."""
    terms = search.phrases(query)
    rows = search_index.select("repo_id", "entity_type", "entity_id", "text", F.struct("entity_type", "entity_id").alias("key"))
    if not terms:
        return rows.select("entity_type", "entity_id", "text", F.lit(0.0).alias("rank")).limit(0)
    ranked = search.bm25(rows, query, "key", every)
    hits = ranked.select("key.entity_type", "key.entity_id", "rank").join(search_index.where(F.col("repo_id") == repo_id), ["entity_type", "entity_id"])
    return hits.orderBy("rank", "entity_type", "entity_id").limit(limit).select("entity_type", "entity_id", "text", "rank")


def candidates(t: Tables, task: str, hints: dict | None = None, fts_score: str = "inverted") -> DataFrame:
    """file_id, score, reason, ord: each file's best reason for being looked at, the earliest among equals.

    fts_score 'inverted' gives the strongest text hits the least score, as the rank is negative; 'fixed' turns that
    round.  A hint of a language is accepted and has no effect."""
    spark, hints = t.files.sparkSession, hints or {}
    asked: list[tuple] = [(0, i, p, HINT, f'hint:path "{p}"') for i, p in enumerate(hints.get("paths") or [])]
    mentioned = re.findall(PATH_IN_TEXT, task, re.A)
    named = [(1, i, s, HINT, f'hint:symbol "{s}"') for i, s in enumerate(hints.get("symbols") or [])]
    camel = [(3, i, n, CAMEL, f'camelcase-match "{n}"') for i, n in enumerate(dict.fromkeys(re.findall(CAMEL_CASE, task, re.A)))]
    # A mention is looked up as it stands, and only then without the dot before it.
    exact = [(2, i, p, PATH_IN_TASK, f'path-in-task "{p}"') for i, p in enumerate(mentioned)]

    def frame(rows: list[tuple]) -> DataFrame:
        return F.broadcast(spark.createDataFrame(rows, CANDIDATE))

    paths, symbols = t.files.select("file_id", F.col("path").alias("key")), t.symbols.select("file_id", F.col("name").alias("key"), "start_line", "start_col")
    by_path = frame(asked + exact).join(paths, "key").select("file_id", "strategy", "ord", F.lit(0).alias("sub"), "score", "reason")
    bare = frame([(s, i, re.sub(r"^\./", "", k), x, r) for s, i, k, x, r in exact if k.startswith("./")]).join(paths, "key").select("file_id", "strategy", "ord", F.lit(1).alias("sub"), "score", "reason")
    by_name = frame(named + camel).join(symbols, "key").select("file_id", "strategy", "ord", F.lit(0).alias("sub"), "score", "reason")
    found = by_path.unionByName(bare).unionByName(by_name)

    words = [w for w in dict.fromkeys(re.sub(r"[^A-Za-z0-9_\s]", " ", task).lower().split()) if len(w) > 3 and w not in T.STOP_WORDS]
    if words:
        hits = ranked_hits(t.search_index, t.repo_id, " ".join(words), FTS_HITS, every=False)
        hits = hits.withColumn("ord", F.row_number().over(Window.orderBy("rank", "entity_type", "entity_id")).cast("long"))
        owner = hits.join(t.symbols.select(F.col("symbol_id").alias("entity_id"), F.col("file_id").alias("_owner")), "entity_id", "left")
        file_id = F.when(F.col("entity_type") == "file", F.col("entity_id")).otherwise(F.col("_owner"))
        score = T.clamp(3 + (F.col("rank") if fts_score == "inverted" else -F.col("rank")), 1.0, 5.0)
        texts = owner.select(file_id.alias("file_id"), F.lit(4).alias("strategy"), "ord", F.lit(0).alias("sub"), score.alias("score"), F.lit("fts-match").alias("reason"))
        found = found.unionByName(texts.where("file_id is not null"))
    # Of equal scores the first found is kept, and a file stands where it was found first.
    first = F.min(F.struct("strategy", "ord", "sub", "file_id"))
    best = F.min_by("reason", F.struct((-F.col("score")).alias("s"), "strategy", "ord", "sub"))
    return found.groupBy("file_id").agg(F.max("score").alias("score"), best.alias("reason"), first.alias("ord"))


def expanded(t: Tables, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files reached from seeds over IMPORTS in two steps (node, depth, score), and the edges walked.

    Edges lead from a file, or from a symbol of it, to a file or to a symbol's file.  Those to a module are walked,
    but lead nowhere."""
    owner = t.symbols.select("symbol_id", F.col("file_id").alias("_file"))
    e = t.edges.where("rel = 'IMPORTS' or (rel = 'REFERENCES' and src_type = 'symbol')")
    e = e.join(owner.toDF("src_id", "_src_file"), "src_id", "left").join(owner.toDF("dst_id", "_dst_file"), "dst_id", "left")
    src = F.when(F.col("src_type") == "symbol", F.col("_src_file")).otherwise(F.col("src_id"))
    dst = F.when(F.col("dst_type") == "symbol", F.col("_dst_file")).when(F.col("dst_type") == "file", F.col("dst_id"))
    walk = e.select(src.alias("src"), dst.alias("dst"), "src_type", "src_id", "rel", "dst_type", "dst_id", "ord")
    steps = walk.where("src is not null and dst is not null")
    nodes = graph.expand_scored(steps.select("src", "dst").distinct(), seeds.select(F.col("file_id").alias("node")))
    from_ = nodes.where("depth < 2").select(F.col("node").alias("src"), "depth")
    return nodes, walk.join(from_, "src").select("src", "dst", "src_type", "src_id", "rel", "dst_type", "dst_id", "depth", "ord")


def ranked_files(t: Tables, found: DataFrame, nodes: DataFrame) -> DataFrame:
    """file_id, path, score, reasons, rank: candidates' and expansion scores summed, entry points favoured."""
    reach = nodes.select(F.col("node").alias("file_id"), F.col("score").cast("double").alias("score"), F.format_string("graph-expansion depth=%d", "depth").alias("reason"), F.lit(1).alias("part"), F.col("depth").alias("at"), F.lit(None).alias("ord"))
    own = found.select("file_id", "score", "reason", F.lit(0).alias("part"), F.lit(0).alias("at"), "ord")
    summed = own.unionByName(reach.withColumn("ord", F.col("ord").cast(found.schema["ord"].dataType))).groupBy("file_id").agg(
        F.sum("score").alias("score"), F.array_sort(F.collect_list(F.struct("part", "at", "reason"))).alias("why"), F.min("ord").alias("ord"), F.min("at").alias("at")
    )
    entry = F.col("path").rlike(ENTRY_POINT)
    reasons = F.transform("why", lambda w: w["reason"])
    full = summed.join(t.files.select("file_id", "path"), "file_id").select(
        "file_id", "path", (F.col("score") + F.when(entry, ENTRY_BONUS).otherwise(0.0)).alias("score"),
        F.when(entry, F.concat(reasons, F.array(F.lit("entry-point-bonus")))).otherwise(reasons).alias("reasons"), "ord", "at",
    )
    # Ranks are of the files that a task reaches, one list that the answer is.
    place = F.row_number().over(Window.orderBy(F.col("score").desc(), F.col("ord").asc_nulls_last(), "at", "path"))
    return full.withColumn("rank", place).select("file_id", "path", "score", "reasons", "rank")


def snippets(t: Tables, ranked: DataFrame, budget: int) -> DataFrame:
    """rank, path, start, end, sha256, text, tokens: pieces of the ranked files that the budget admits.

    Files of at most 60 lines, or without symbols, come whole; of others the lines of symbols with three lines
    around, united where they meet."""
    texts = ranked.select("file_id", "path", "rank").join(t.contents.select("file_id", "text"), "file_id").withColumn("lines", F.split("text", "\n"))
    texts = texts.withColumn("total", F.size("lines"))
    shown = t.symbols.select("file_id", "start_line", "end_line")
    spans = texts.where(F.col("total") > SMALL_FILE).select("file_id", "total").join(shown, "file_id")
    ranges = spans.select(F.col("file_id").alias("file"), F.greatest(F.lit(1), F.col("start_line") - CONTEXT_LINES).alias("first"), F.least(F.col("total"), F.col("end_line") + CONTEXT_LINES).alias("last"))
    merged = relational.merged_ranges(ranges, "file").withColumnRenamed("file", "file_id")
    cut = texts.join(merged, "file_id", "left")
    whole = F.col("first").isNull()
    start, end = F.coalesce("first", F.lit(1)), F.coalesce("last", "total")
    body = F.when(whole, F.col("text")).otherwise(F.array_join(F.slice("lines", start, F.greatest(end - start + 1, F.lit(0))), "\n"))
    pieces = cut.select(F.lit(0).alias("one"), "rank", start.alias("piece"), whole.alias("whole"), T.token_estimate(body).alias("tokens"), "path", end.alias("end"), body.alias("text"))
    taken = relational.budget_fold(pieces.select("one", "rank", "piece", "whole", "tokens"), "one", budget).select("rank", "piece")
    return pieces.join(F.broadcast(taken), ["rank", "piece"]).select("rank", "path", F.col("piece").alias("start"), "end", F.sha2("text", 256).alias("sha256"), "text", "tokens")


def first_symbols(t: Tables, chosen: DataFrame) -> DataFrame:
    """rank, place, path and the first three symbols of each chosen file."""
    rows = t.symbols.join(F.broadcast(chosen.select("file_id", "path", "rank")), "file_id")
    return relational.top_per(rows, "file_id", SYMBOLS_SHOWN, [F.col("ord")])


def focus(t: Tables, ranked: DataFrame, found: DataFrame) -> DataFrame:
    """rank, place, type, id, path, fq_name, reason: the ten best files, each with its first three symbols."""
    chosen = ranked.where(F.col("rank") <= FOCUS)
    own = found.select("file_id", F.col("reason").alias("found"))
    reason = F.coalesce("found", F.array_join(F.slice("reasons", 1, REASONS_SHOWN), "; "))
    of_files = chosen.join(own, "file_id", "left").select("rank", F.lit(0).alias("place"), F.lit("file").alias("type"), F.col("file_id").cast("string").alias("id"), "path", F.lit(None).cast("string").alias("fq_name"), reason.alias("reason"))
    of_symbols = first_symbols(t, chosen).select("rank", "place", F.lit("symbol").alias("type"), F.col("symbol_id").cast("string").alias("id"), "path", "fq_name", F.concat("kind", F.lit(" in focused file")).alias("reason"))
    return of_files.unionByName(of_symbols)


def subgraph(t: Tables, ranked: DataFrame, walked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (type, id, path) and edges (src, rel, dst) of the walked edges with an end in the focus."""
    chosen = ranked.where(F.col("rank") <= FOCUS).select("file_id")
    flag = lambda end: F.broadcast(chosen.select(F.col("file_id").alias(end), F.lit(True).alias(f"_{end}")))
    kept = walked.join(flag("src"), "src", "left").join(flag("dst"), "dst", "left").where("_src or _dst")
    name = lambda end: F.concat_ws(":", f"{end}_type", F.col(f"{end}_id").cast("string"))
    edges = kept.select(name("src").alias("src"), "rel", name("dst").alias("dst"), "depth", "ord")
    ends = kept.select("src_type", "src_id").toDF("type", "id").union(kept.select("dst_type", "dst_id").toDF("type", "id")).distinct()
    nodes = ends.join(t.files.select(F.col("file_id").alias("id"), "path"), "id", "left").select("type", F.col("id").cast("string").alias("id"), F.when(F.col("type") == "file", F.col("path")).alias("path"))
    return nodes, edges


def bundle(t: Tables, root: str, task: str, budget: int, hints: dict | None = None, fts_score: str = "inverted", keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """One row: repo, intent, focus, snippets, subgraph, notes, limits.

    keep may persist what several parts read: candidates, the nodes and edges walked, and the ranking.

    Its arrays hold at most ten files with three symbols each, the snippets of one budget, and the edges around the
    focus; they are gathered by one aggregate each."""
    found = keep(candidates(t, task, hints, fts_score))
    seeds = found.orderBy(F.col("score").desc(), "ord").limit(SEEDS)
    nodes, walked = map(keep, expanded(t, seeds))
    ranked = keep(ranked_files(t, found, nodes))
    shown = snippets(t, ranked, budget)
    sub_nodes, sub_edges = subgraph(t, ranked, walked)

    def gathered(rows: DataFrame, name: str, order: list[str], fields: list[str]) -> DataFrame:
        packed = F.array_sort(F.collect_list(F.struct(*[F.col(o).alias(f"_{i}") for i, o in enumerate(order)], F.struct(*fields).alias("v"))))
        return rows.agg(F.transform(packed, lambda x: x["v"]).alias(name))

    parts = [
        gathered(focus(t, ranked, found), "focus", ["rank", "place"], ["type", "id", "path", "fq_name", "reason"]),
        shown.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "start", F.struct("path", "start", "end", "sha256", "text").alias("v")))), lambda x: x["v"]).alias("snippets"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("_used")),
        gathered(sub_nodes, "_nodes", ["type", "path", "id"], ["type", "id", "path"]),
        gathered(sub_edges, "_edges", ["depth", "src", "ord", "dst"], ["src", "rel", "dst"]),
        ranked.agg(F.count("*").alias("_found")),
    ]
    row = parts[0]
    for part in parts[1:]:
        row = row.crossJoin(part)  # each side is one row
    notes = F.when(F.col("_found") == 0, F.array(F.lit("No candidates found for this task."))).otherwise(F.array().cast("array<string>"))
    return row.select(
        F.struct(F.lit(root).alias("root"), F.lit(None).cast("string").alias("rev")).alias("repo"), T.intent(F.lit(task)).alias("intent"), "focus", "snippets",
        F.struct(F.col("_nodes").alias("nodes"), F.col("_edges").alias("edges")).alias("subgraph"), notes.alias("notes"),
        F.struct(F.lit(budget).alias("budget"), F.col("_used").alias("used_estimate")).alias("limits"),
    )

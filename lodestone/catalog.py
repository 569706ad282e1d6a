"""Every registered query of the engine, with its SQL twin.

The star schema stands for a code graph: documents are files of twenty repositories, parts are nodes,
successive parts of an order are IMPORTS edges, orders define lines, customers extend nations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import code_queries, operator_queries
from .functions import text as T
from .operators import graph, relational, search

FLAGSHIP = "bm25_topk"
SEEDS = (1, 2, 3, 4, 5)
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

#: DuckDB: pieces that several twins share.
_TOKENS = "tokens_of_documents AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\\p{L}\\p{N}\\p{Co}]+') AS t FROM documents)"
_EDGES = "edges AS (SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem) WHERE src <> dst)"
_FILES = "files AS (SELECT doc_id AS file_id, CAST(substr(source, 4) AS INTEGER) AS repo_id, source || '/' || lang || '/doc_' || doc_id || '.txt' AS path, lang, sha256(text) AS digest, text, length(text) AS size FROM documents)"


def _query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select(F.col("doc_id").alias("file_id"), F.substr("source", F.lit(4)).cast("int").alias("repo_id"), path.alias("path"), "lang", F.sha2("text", 256).alias("digest"), "text", F.length("text").alias("size"))


def import_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.successive_edges(_table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", ["l_linenumber", "l_partkey", "l_suppkey"])


def _seeds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s,) for s in SEEDS], "node long")


@_query(f"WITH {_FILES} SELECT repo_id, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS size FROM files GROUP BY repo_id")
def repo_status_counts(spark, sf_dir):
    return files(spark, sf_dir).groupBy("repo_id").agg(F.count("*").alias("n_files"), F.sum("size").alias("size"))


@_query(f"WITH {_FILES} SELECT repo_id, lang, count(*) AS n_files FROM files GROUP BY repo_id, lang")
def files_by_lang(spark, sf_dir):
    return files(spark, sf_dir).groupBy("repo_id", "lang").agg(F.count("*").alias("n_files"))


@_query(f"WITH {_FILES} SELECT file_id, path, digest FROM files")
def content_hash(spark, sf_dir):
    return files(spark, sf_dir).select("file_id", "path", "digest")


@_query(f"""WITH {_FILES}, stored AS (SELECT path, digest FROM files WHERE file_id % 5 <> 0),
current AS (SELECT path, CASE WHEN file_id % 11 = 0 THEN digest || 'x' ELSE digest END AS digest FROM files WHERE file_id % 7 <> 0)
SELECT coalesce(s.path, c.path) AS path, CASE WHEN s.path IS NULL THEN 'new' WHEN c.path IS NULL THEN 'deleted' ELSE 'changed' END AS change
FROM stored s FULL JOIN current c ON s.path = c.path WHERE s.path IS NULL OR c.path IS NULL OR s.digest <> c.digest""")
def change_set(spark, sf_dir):
    f = files(spark, sf_dir)
    current = f.where("file_id % 7 <> 0").select("path", F.when(F.col("file_id") % 11 == 0, F.concat("digest", F.lit("x"))).otherwise(F.col("digest")).alias("digest"))
    return relational.change_set(f.where("file_id % 5 <> 0"), current, "path", "digest")


@_query("""WITH stored AS (SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 3 <> 0),
incoming AS (SELECT c_custkey, upper(c_name) AS c_name, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(s.c_custkey, i.c_custkey) AS c_custkey, coalesce(i.c_name, s.c_name) AS c_name, coalesce(i.c_acctbal, s.c_acctbal) AS c_acctbal
FROM stored s FULL JOIN incoming i ON s.c_custkey = i.c_custkey""")
def upsert_merge(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    incoming = c.where("c_custkey % 2 = 0").select("c_custkey", F.upper("c_name").alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return relational.upsert(c.where("c_custkey % 3 <> 0"), incoming, "c_custkey")


@_query(f"WITH {_TOKENS} SELECT doc_id FROM tokens_of_documents WHERE list_contains(t, 'that') AND list_contains(t, 'from')")
def search_and(spark, sf_dir):
    return search.match(_table(spark, sf_dir, "documents"), "that from", every=True)


@_query(f"WITH {_TOKENS} SELECT doc_id FROM tokens_of_documents WHERE list_contains(t, 'moron') OR list_contains(t, 'los')")
def search_or(spark, sf_dir):
    return search.match(_table(spark, sf_dir, "documents"), "moron los", every=False)


@_query(f"WITH {_TOKENS} SELECT doc_id FROM tokens_of_documents WHERE contains(' ' || array_to_string(t, ' ') || ' ', ' apache license ')")
def search_phrase(spark, sf_dir):
    return search.match(_table(spark, sf_dir, "documents"), "apache_license", every=True)


@_query(f"WITH {_TOKENS} SELECT doc_id FROM tokens_of_documents WHERE len(list_filter(t, lambda x: starts_with(x, 'licens'))) > 0")
def search_prefix(spark, sf_dir):
    return search.match_prefix(_table(spark, sf_dir, "documents"), "licens")


@_query(f"WITH {_TOKENS} SELECT doc_id, rank FROM ({search.bm25_sql(['license', 'version', 'from'])}) ORDER BY rank, doc_id LIMIT 20")
def bm25_topk(spark, sf_dir):
    return search.bm25(_table(spark, sf_dir, "documents"), "license version from").orderBy("rank", "doc_id").limit(20)


@_query(f"""WITH {_TOKENS}, hits AS ({search.bm25_sql(['license', 'version'])})
SELECT doc_id, rank, greatest(1, least(5, 3 + rank)) AS score, coalesce(CAST(quality AS VARCHAR), 'unknown') AS quality
FROM hits LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id)""")
def search_enriched(spark, sf_dir):
    labels = _table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    hits = search.bm25(_table(spark, sf_dir, "documents"), "license version").join(labels, "doc_id", "left")
    return hits.select("doc_id", "rank", T.clamp(3 + F.col("rank"), 1.0, 5.0).alias("score"), F.coalesce(F.col("quality").cast("string"), F.lit("unknown")).alias("quality"))


@_query(f"""SELECT conv_id, turn, word, count(*) AS n FROM (SELECT conv_id, turn, unnest(list_distinct(list_filter(
  string_split_regex(lower(trim(regexp_replace(text, '[^A-Za-z0-9_\\s]', ' ', 'g'), ' ')), '\\s+'),
  lambda w: length(w) > 3 AND NOT list_contains([{", ".join(f"'{w}'" for w in T.STOP_WORDS)}], w)))) AS word FROM conversations) GROUP BY ALL""")
def query_terms(spark, sf_dir):
    words = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(T.query_words(F.col("text"))).alias("word"))
    return words.groupBy("conv_id", "turn", "word").agg(F.count("*").alias("n"))


@_query(f"WITH {_EDGES} SELECT src, dst, 'IMPORTS' AS rel, CAST(1.0 AS DOUBLE) AS weight FROM edges")
def import_edges(spark, sf_dir):
    return import_graph(spark, sf_dir).select("src", "dst", F.lit("IMPORTS").alias("rel"), F.lit(graph.WEIGHTS["IMPORTS"]).alias("weight"))


@_query("""WITH l AS (SELECT l_orderkey AS src, l_partkey AS dst, l_returnflag FROM lineitem)
SELECT src, dst, 'DEFINES' AS rel, CAST(1.0 AS DOUBLE) AS weight FROM l UNION ALL SELECT src, dst, 'EXPORTS', CAST(0.8 AS DOUBLE) FROM l WHERE l_returnflag = 'R'""")
def defines_exports_edges(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), "l_returnflag")
    kinds = F.when(F.col("l_returnflag") == "R", F.array(F.lit("DEFINES"), F.lit("EXPORTS"))).otherwise(F.array(F.lit("DEFINES")))
    made = lines.select("src", "dst", F.explode(kinds).alias("rel"))
    return made.withColumn("weight", F.when(F.col("rel") == "EXPORTS", graph.WEIGHTS["EXPORTS"]).otherwise(graph.WEIGHTS["DEFINES"]))


@_query("""SELECT 'customer:' || c_custkey AS src, 'nation:' || n_nationkey AS dst, 'EXTENDS' AS rel FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || r_regionkey, 'IMPLEMENTS' FROM nation JOIN region ON n_regionkey = r_regionkey""")
def extends_implements_edges(spark, sf_dir):
    c, n, r = (_table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    up = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("customer:"), "c_custkey").alias("src"), F.concat(F.lit("nation:"), "n_nationkey").alias("dst"), F.lit("EXTENDS").alias("rel"))
    top = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("nation:"), "n_nationkey"), F.concat(F.lit("region:"), "r_regionkey"), F.lit("IMPLEMENTS"))
    return up.union(top)


@_query(f"WITH {_EDGES} SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY node")
def node_degree(spark, sf_dir):
    return graph.degree(import_graph(spark, sf_dir))


def _hops(steps: str, depth: int) -> str:
    seeds = " UNION ALL ".join(f"SELECT CAST({s} AS BIGINT) AS node, 0 AS depth" for s in SEEDS)
    return f"WITH RECURSIVE {_EDGES}, steps AS ({steps}), walk AS ({seeds} UNION SELECT dst, depth + 1 FROM walk JOIN steps ON src = node WHERE depth < {depth}) SELECT node, min(depth) AS depth FROM walk GROUP BY node"


@_query(_hops("SELECT src, dst FROM edges", 2))
def k_hop_out(spark, sf_dir):
    return graph.k_hop(import_graph(spark, sf_dir), _seeds(spark), 2)


@_query(_hops("SELECT src, dst FROM edges UNION SELECT dst, src FROM edges", 1))
def k_hop_both(spark, sf_dir):
    return graph.k_hop(import_graph(spark, sf_dir), _seeds(spark), 1, both=True)


@_query(f"SELECT node, depth, CASE depth WHEN 0 THEN 5 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 0 END AS score FROM ({_hops('SELECT src, dst FROM edges', 2)})")
def expand_scored(spark, sf_dir):
    return graph.expand_scored(import_graph(spark, sf_dir), _seeds(spark))


@_query(f"WITH {_EDGES} SELECT src, dst FROM edges WHERE src IN {SEEDS} OR dst IN {SEEDS}")
def subgraph_edges(spark, sf_dir):
    return graph.subgraph(import_graph(spark, sf_dir), _seeds(spark))


@_query(f"WITH {_EDGES} SELECT src, dst FROM edges WHERE src % 10 <> 0 AND dst % 10 <> 0")
def edge_delete_cascade(spark, sf_dir):
    gone = _table(spark, sf_dir, "part").where("p_partkey % 10 = 0").select(F.col("p_partkey").alias("node"))
    return graph.without_nodes(import_graph(spark, sf_dir), gone)


@_query(f"""WITH {_EDGES}, d AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY node)
SELECT p_partkey AS node, p_name AS label, degree, CAST(greatest(5.0, least(22.0, 6 + 1.5 * degree)) AS DOUBLE) AS radius FROM part JOIN d ON p_partkey = node""")
def visual_graph_nodes(spark, sf_dir):
    nodes = graph.degree(import_graph(spark, sf_dir)).join(_table(spark, sf_dir, "part"), F.col("node") == F.col("p_partkey"))
    return nodes.select("node", F.col("p_name").alias("label"), "degree", T.clamp(6 + 1.5 * F.col("degree"), 5.0, 22.0).alias("radius"))


@_query(f"WITH {_EDGES} SELECT src, dst FROM edges WHERE src IN (SELECT p_partkey FROM part WHERE p_size <= 25) AND dst IN (SELECT p_partkey FROM part WHERE p_size <= 25)")
def visual_graph_links(spark, sf_dir):
    seen = _table(spark, sf_dir, "part").where("p_size <= 25").select("p_partkey")
    return import_graph(spark, sf_dir).join(seen.withColumnRenamed("p_partkey", "src"), "src", "left_semi").join(seen.withColumnRenamed("p_partkey", "dst"), "dst", "left_semi").select("src", "dst")


@_query("""SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS place FROM documents) WHERE place = 1""")
def candidate_dedupe(spark, sf_dir):
    return relational.best_per(_table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), "source", "n_chars", "doc_id")


@_query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS place FROM lineitem) WHERE place <= 3""")
def top3_per_file(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem")
    order = [F.col("l_extendedprice").desc(), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]
    return relational.top_per(lines, "l_orderkey", 3, order).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "place")


@_query("""WITH r AS (SELECT DISTINCT l_orderkey AS file, greatest(1, l_linenumber * 9 - 3) AS first, l_linenumber * 9 + 3 AS last FROM lineitem),
m AS (SELECT *, max(last) OVER (PARTITION BY file ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
g AS (SELECT *, sum(CASE WHEN first > coalesce(reach, -2) + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY first, last ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT file, min(first) AS first, max(last) AS last FROM g GROUP BY file, island""")
def range_merge(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.greatest(F.lit(1), F.col("l_linenumber") * 9 - 3).alias("first"), (F.col("l_linenumber") * 9 + 3).alias("last"))
    return relational.merged_ranges(lines, "file")


@_query(f"""WITH {_EDGES}, b AS (SELECT src AS node, CAST(sum(3) AS BIGINT) AS score FROM edges GROUP BY src)
SELECT p_partkey AS node, coalesce(score, 0) + CASE WHEN p_size = 1 THEN 3 ELSE 0 END AS score FROM part LEFT JOIN b ON p_partkey = node ORDER BY 2 DESC, 1 LIMIT 50""")
def rank_files(spark, sf_dir):
    scores = import_graph(spark, sf_dir).groupBy(F.col("src").alias("node")).agg(F.sum(F.lit(3)).alias("score"))
    ranked = _table(spark, sf_dir, "part").join(scores, F.col("p_partkey") == F.col("node"), "left")
    total = F.coalesce("score", F.lit(0)) + F.when(F.col("p_size") == 1, 3).otherwise(0)
    return ranked.select(F.col("p_partkey").alias("node"), total.alias("score")).orderBy(F.col("score").desc(), "node").limit(50)


@_query("SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS snippet FROM documents")
def snippet_lines(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.slice(F.split("text", "\n"), 2, 3), "\n").alias("snippet"))


@_query("SELECT doc_id, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@_query("SELECT doc_id, CASE WHEN length(l) > 200 THEN substr(l, 1, 200) || '...' ELSE l END AS signature FROM (SELECT doc_id, string_split(text, chr(10))[1] AS l FROM documents)")
def signature_text(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.signature(F.col("text")).alias("signature"))


@_query("""SELECT conv_id, turn, CASE WHEN length(f) > 100 THEN rtrim(substr(f, 1, 100)) || '...' ELSE f END AS intent
FROM (SELECT conv_id, turn, trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')) AS f FROM conversations)""")
def intent_text(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", T.intent(F.col("text")).alias("intent"))


@_query(f"WITH {_FILES} SELECT file_id, array_to_string(string_split(path, '/')[-2:], '/') AS short FROM files")
def short_path(spark, sf_dir):
    return files(spark, sf_dir).select("file_id", T.short_path(F.col("path")).alias("short"))


@_query("SELECT doc_id, CASE WHEN n_chars < 1024 THEN n_chars || ' B' WHEN n_chars < 1048576 THEN printf('%.1f KB', round(n_chars / 1024 * 10) / 10) ELSE printf('%.1f MB', round(n_chars / 1048576 * 10) / 10) END AS size FROM documents")
def human_bytes(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.human_bytes(F.col("n_chars")).alias("size"))


@_query("SELECT event_id, greatest(1, least(5, 3 + value / 100)) AS score FROM events")
def score_clamp(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", T.clamp(3 + F.col("value") / 100, 1.0, 5.0).alias("score"))


@_query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def meta_json_roundtrip(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@_query("""WITH RECURSIVE items AS (SELECT conv_id, turn // 2 AS rank, turn AS piece, role = 'system' AS whole, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens,
row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS n FROM conversations WHERE text IS NOT NULL),
fold AS (SELECT conv_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS total, CAST(0 AS BIGINT) AS used, false AS took, false AS got, false AS stop, CAST(-1 AS BIGINT) AS shut, CAST(0 AS BIGINT) AS rank, CAST(0 AS BIGINT) AS piece, CAST(0 AS BIGINT) AS tokens FROM items WHERE n = 1
UNION ALL SELECT conv_id, n, CAST(CASE WHEN NOT closed AND NOT over THEN total + tokens ELSE total END AS BIGINT), CAST(total AS BIGINT), NOT closed AND NOT over, got OR (NOT closed AND NOT over), stop OR (NOT closed AND over AND whole), CAST(CASE WHEN NOT closed AND over AND NOT whole THEN rank ELSE shut END AS BIGINT), CAST(rank AS BIGINT), CAST(piece AS BIGINT), tokens
FROM (SELECT i.conv_id, i.n, f.total, f.got, f.stop, f.shut, i.rank, i.piece, i.tokens, i.whole, f.stop OR f.total >= 200 OR (NOT i.whole AND f.shut = i.rank) AS closed, f.got AND f.total + i.tokens > 200 AS over FROM fold f JOIN items i ON i.conv_id = f.conv_id AND i.n = f.n + 1) s)
SELECT conv_id, rank, piece, tokens, used FROM fold WHERE took""")
def budget_fold(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").where("text is not null")
    pieces = turns.select("conv_id", F.floor(F.col("turn") / 2).alias("rank"), F.col("turn").alias("piece"), (F.col("role") == "system").alias("whole"), T.token_estimate(F.col("text")).alias("tokens"))
    return relational.budget_fold(pieces, "conv_id", 200)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _QUERIES | code_queries.QUERIES | operator_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return _SQL | code_queries.SQL | operator_queries.SQL

"""Registered queries over small code graphs made of the part table, each with its SQL twin: lookups, neighbours,
expansion, ranking inputs, parsing of special cases, and the drawn graph.

The graph: a file a part, of seven folders; each imports the next one's; every tenth also imports a module; every
part has one symbol, and the symbol of every third refers to the next part's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import graph, relational, search
from .parsers import parsed
from .plans import context as ctx
from .plans import visual
from .plans.index import import_edges, search_rows, symbol_edges, symbols_of
from .plans.lineage import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SEEDS = (3, 40, 99)
KINDS = ("class", "function", "interface", "method", "enum")
NAMES = ("UserService", "Plain", "OrderItem", "café", "load")
FOLDERS = ("routes", "lib", "pages", "controllers", "model", "view", "x")


def _query(sql: str):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("n"), "p_name", "p_size")


def _pick(values: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def _picked(values: tuple[str, ...], n: str = "n") -> str:
    return f"([{', '.join(repr(v) for v in values)}])[CAST({n} % {len(values)} AS INTEGER) + 1]"


def tables(spark: SparkSession, sf_dir: str) -> ctx.Tables:
    n, part = F.col("n"), _part(spark, sf_dir)
    one = F.lit(1).cast("long").alias("repo_id")
    name = F.when(n % 50 == 0, F.lit("index")).otherwise(F.concat(F.lit("f"), n.cast("string")))
    path = F.concat(F.lit("src/"), _pick(FOLDERS, n), F.lit("/"), name, F.lit(".ts"))
    files = part.select(one, n.alias("file_id"), path.alias("path"), F.lit("typescript").alias("lang"), F.col("p_size").cast("long").alias("size_bytes"))
    symbols = files.select(
        one, "file_id", (F.col("file_id") + 1_000_000).alias("symbol_id"), F.lit(0).alias("ord"), _pick(KINDS, F.col("file_id")).alias("kind"), _pick(NAMES, F.col("file_id")).alias("name"),
        F.concat_ws(":", "path", _pick(NAMES, F.col("file_id"))).alias("fq_name"), F.lit(1).alias("start_line"), F.lit(0).alias("start_col"), F.lit(3).alias("end_line"),
    )
    last = part.agg(F.max("n")).first()[0]

    def edges(src: str, src_id: Column, rel: str, dst: str, dst_id: Column, when: Column) -> DataFrame:
        return part.where(when).select(one, F.lit(src).alias("src_type"), src_id.alias("src_id"), F.lit(rel).alias("rel"), F.lit(dst).alias("dst_type"), dst_id.alias("dst_id"), F.lit(1.0).alias("weight"), F.lit(0).alias("ord"))

    inner = n < last
    every = edges("file", n, "IMPORTS", "file", n + 1, inner).union(edges("file", n, "IMPORTS", "module", n, n % 10 == 0))
    every = every.union(edges("symbol", n + 1_000_000, "REFERENCES", "symbol", n + 1_000_001, inner & (n % 3 == 0))).union(edges("file", n, "DEFINES", "symbol", n + 1_000_000, n >= 0))
    every = every.union(edges("symbol", n + 1_000_000, "EXTENDS", "symbol", n + 1_000_002, n + 2 <= last))
    return ctx.Tables(files, symbols, every, files.select("file_id", F.col("path").alias("text")), search_rows(files, symbols), 1)


_FILES = f"files AS (SELECT p_partkey AS n, 'src/' || {_picked(FOLDERS, 'p_partkey')} || '/' || CASE WHEN p_partkey % 50 = 0 THEN 'index' ELSE 'f' || p_partkey END || '.ts' AS path FROM part)"
_SYMBOLS = f"symbols AS (SELECT n + 1000000 AS symbol_id, n, path, {_picked(KINDS)} AS kind, {_picked(NAMES)} AS name, path || ':' || {_picked(NAMES)} AS fq_name FROM files)"
_EDGES = """edges AS (SELECT 'file' AS src_type, n AS src_id, 'IMPORTS' AS rel, 'file' AS dst_type, n + 1 AS dst_id FROM files WHERE n < (SELECT max(n) FROM files)
UNION ALL SELECT 'file', n, 'IMPORTS', 'module', n FROM files WHERE n % 10 = 0
UNION ALL SELECT 'symbol', n + 1000000, 'REFERENCES', 'symbol', n + 1000001 FROM files WHERE n % 3 = 0 AND n < (SELECT max(n) FROM files)
UNION ALL SELECT 'file', n, 'DEFINES', 'symbol', n + 1000000 FROM files
UNION ALL SELECT 'symbol', n + 1000000, 'EXTENDS', 'symbol', n + 1000002 FROM files WHERE n + 2 <= (SELECT max(n) FROM files))"""
_GRAPH = f"{_FILES}, {_SYMBOLS}, {_EDGES}"
_EDGE = ["src_type", "src_id", "rel", "dst_type", "dst_id"]


# Lookups.


@_query(f"WITH {_GRAPH} SELECT src_type, src_id, rel, dst_type, dst_id FROM edges WHERE src_type = 'file' AND src_id = 40 AND rel = 'IMPORTS' UNION ALL SELECT src_type, src_id, rel, dst_type, dst_id FROM edges WHERE dst_type = 'symbol' AND dst_id = 1000040")
def edge_lookup(spark, sf_dir):
    e = tables(spark, sf_dir).edges.select(*_EDGE)
    return graph.edges_at(e, src=("file", 40), rel="IMPORTS").union(graph.edges_at(e, dst=("symbol", 1_000_040)))


@_query(f"WITH {_GRAPH} SELECT symbol_id, kind, name FROM symbols WHERE fq_name = 'src/view/f5.ts:UserService'")
def fq_name_lookup(spark, sf_dir):
    return graph.named(tables(spark, sf_dir).symbols, "fq_name", "src/view/f5.ts:UserService", 1).select("symbol_id", "kind", "name")


@_query("SELECT n_nationkey AS module_id, n_name AS name FROM nation WHERE n_name = (SELECT min(n_name) FROM nation)")
def module_lookup(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    modules = n.select(F.lit(1).cast("long").alias("repo_id"), F.col("n_nationkey").alias("module_id"), F.col("n_name").alias("name"))
    return graph.named(modules, "name", n.agg(F.min("n_name")).first()[0], 1).select("module_id", "name")


@_query(f"WITH {_GRAPH} SELECT file_id, symbol_id, fq_name FROM (SELECT n AS file_id, symbol_id, fq_name FROM symbols)")
def qualified_names(spark, sf_dir):
    return tables(spark, sf_dir).symbols.select("file_id", "symbol_id", "fq_name")


@_query(f"WITH {_GRAPH} SELECT 'file' AS entity_type, n AS entity_id, path AS text FROM files UNION ALL SELECT 'symbol', symbol_id, name || ' ' || fq_name FROM symbols")
def search_texts(spark, sf_dir):
    return tables(spark, sf_dir).search_index.select("entity_type", "entity_id", "text")


@_query(f"""WITH {_GRAPH}, gone AS (SELECT 'file' AS t, n AS id FROM files WHERE n % 4 = 0 UNION ALL SELECT 'symbol', symbol_id FROM symbols WHERE n % 4 = 0)
SELECT * FROM edges WHERE (src_type, src_id) NOT IN (SELECT (t, id) FROM gone) AND (dst_type, dst_id) NOT IN (SELECT (t, id) FROM gone)""")
def files_deleted(spark, sf_dir):
    t = tables(spark, sf_dir)
    return graph.without_files(t.edges, t.symbols, t.files.where("file_id % 4 = 0")).select(*_EDGE)


# Neighbours.


def _walk(direction: str, depth: int, result: str) -> str:
    out, back = "SELECT src_type AS t, src_id AS i, dst_type AS u, dst_id AS j FROM edges", "SELECT dst_type, dst_id, src_type, src_id FROM edges"
    steps = {"outgoing": out, "incoming": out.replace("src", "x").replace("dst", "src").replace("x_", "dst_"), "both": f"{out} UNION ALL {back}"}[direction]
    seeds = " UNION ALL ".join(f"SELECT 'file' AS type, CAST({s} AS BIGINT) AS id, 0 AS depth" for s in SEEDS)
    return f"""WITH RECURSIVE {_GRAPH}, steps AS ({steps}), walk AS ({seeds} UNION SELECT u, j, depth + 1 FROM walk JOIN steps ON t = type AND i = id WHERE depth < {depth}),
nodes AS (SELECT type, id, min(depth) AS depth FROM walk GROUP BY type, id), inside AS (SELECT type, id FROM nodes WHERE depth < {depth}) {result}"""


def _around(spark: SparkSession, sf_dir: str, direction: str, depth: int) -> tuple[DataFrame, DataFrame]:
    seeds = spark.createDataFrame([("file", s) for s in SEEDS], "type string, id long")
    return graph.neighbours(tables(spark, sf_dir).edges, seeds, depth, direction)


@_query(_walk("incoming", 2, "SELECT type, id, depth FROM nodes"))
def neighbours_incoming(spark, sf_dir):
    return _around(spark, sf_dir, "incoming", 2)[0]


@_query(_walk("outgoing", 2, "SELECT e.* FROM edges e JOIN inside ON type = src_type AND id = src_id"))
def neighbours_outgoing_edges(spark, sf_dir):
    return _around(spark, sf_dir, "outgoing", 2)[1].select(*_EDGE)


@_query(_walk("both", 1, "SELECT * FROM edges WHERE (src_type, src_id) IN (SELECT (type, id) FROM inside) OR (dst_type, dst_id) IN (SELECT (type, id) FROM inside)"))
def neighbours_both_edges(spark, sf_dir):
    return _around(spark, sf_dir, "both", 1)[1].select(*_EDGE)


# Candidates, expansion and ranking of a task.

_TASK = "Fix src/controllers/f17.ts, ./src/model/f18.ts for OrderItem: plain"
_HINTS = {"paths": ["src/lib/f1.ts", "none.ts"], "symbols": ["load", "nobody"], "lang": "typescript"}
_TEXTS = "texts AS (SELECT 'file:' || n AS key, 'file' AS et, n AS eid, path AS text FROM files UNION ALL SELECT 'symbol:' || symbol_id, 'symbol', symbol_id, name || ' ' || fq_name FROM symbols)"
_TOKENS = "tokens_of_texts AS (SELECT key, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}\\p{Co}]+') AS t FROM texts)"
#: Words of the task beside the stop words, each of one token.
_WORDS = T.folded_words("controllers model orderitem plain")
_FOUND = f"""{_GRAPH}, {_TEXTS}, {_TOKENS}, hits AS (SELECT key, rank, row_number() OVER (ORDER BY rank, et, eid) AS ord FROM ({search.bm25_sql(_WORDS, 'key', 'texts')}) JOIN texts USING (key) ORDER BY rank, et, eid LIMIT 20),
found AS (SELECT n AS file_id, 0 AS strategy, 0 AS ord, CAST(10 AS DOUBLE) AS score, 'hint:path "src/lib/f1.ts"' AS reason FROM files WHERE path = 'src/lib/f1.ts'
UNION ALL SELECT n, 1, 0, 10, 'hint:symbol "load"' FROM symbols WHERE name = 'load'
UNION ALL SELECT n, 2, 0, 8, 'path-in-task "src/controllers/f17.ts"' FROM files WHERE path = 'src/controllers/f17.ts'
UNION ALL SELECT n, 2, 1, 8, 'path-in-task "./src/model/f18.ts"' FROM files WHERE path = 'src/model/f18.ts'
UNION ALL SELECT n, 3, 0, 6, 'camelcase-match "OrderItem"' FROM symbols WHERE name = 'OrderItem'
UNION ALL SELECT CASE WHEN key LIKE 'file:%' THEN CAST(substr(key, 6) AS BIGINT) ELSE CAST(substr(key, 8) AS BIGINT) - 1000000 END, 4, ord, greatest(1, least(5, 3 + rank)), 'fts-match' FROM hits),
best AS (SELECT file_id, score, reason, strategy, ord FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY score DESC, strategy, ord) AS place FROM found) WHERE place = 1)"""


@_query(f"WITH {_FOUND} SELECT file_id, score, reason FROM best")
def context_candidates(spark, sf_dir):
    return ctx.candidates(tables(spark, sf_dir), _TASK, _HINTS).select("file_id", "score", "reason")


_SEED_FILES = " UNION ALL ".join(f"SELECT CAST({s} AS BIGINT) AS node, 0 AS depth" for s in SEEDS)
_REACHED = f"""{_GRAPH}, steps AS (SELECT DISTINCT CASE WHEN src_type = 'symbol' THEN src_id - 1000000 ELSE src_id END AS src, CASE WHEN dst_type = 'symbol' THEN dst_id - 1000000 WHEN dst_type = 'file' THEN dst_id END AS dst, src_type, src_id, rel, dst_type, dst_id
FROM edges WHERE rel = 'IMPORTS' OR (rel = 'REFERENCES' AND src_type = 'symbol')),
walk AS ({_SEED_FILES} UNION SELECT dst, depth + 1 FROM walk JOIN steps ON src = node WHERE depth < 2 AND dst IS NOT NULL),
nodes AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node),
walked AS (SELECT steps.*, depth FROM steps JOIN nodes ON src = node WHERE depth < 2)"""


def _expanded(spark: SparkSession, sf_dir: str) -> tuple[ctx.Tables, DataFrame, DataFrame]:
    t = tables(spark, sf_dir)
    return t, *ctx.expanded(t, spark.createDataFrame([(s,) for s in SEEDS], "file_id long"))


@_query(f"WITH RECURSIVE {_REACHED} SELECT node, depth, CASE depth WHEN 0 THEN 5 WHEN 1 THEN 3 ELSE 1 END AS score FROM nodes")
def context_expansion(spark, sf_dir):
    return _expanded(spark, sf_dir)[1].select("node", "depth", "score")


@_query(f"WITH RECURSIVE {_REACHED} SELECT src_type, src_id, rel, dst_type, dst_id, depth FROM walked")
def context_walked_edges(spark, sf_dir):
    return _expanded(spark, sf_dir)[2].select(*_EDGE, "depth")


_ENTRY = "regexp_matches(path, '" + ctx.ENTRY_POINT.replace("(?:", "(") + "')"
_SCORES = f"""scored AS (SELECT path, score + CASE WHEN {_ENTRY} THEN 3 ELSE 0 END AS score, {_ENTRY} AS entry FROM
(SELECT file_id, CAST(sum(score) AS DOUBLE) AS score FROM (SELECT file_id, score FROM given UNION ALL SELECT node, CASE depth WHEN 0 THEN 5 WHEN 1 THEN 3 ELSE 1 END FROM nodes) GROUP BY file_id) JOIN files ON n = file_id)"""
_GIVEN = "given AS (SELECT n AS file_id, CAST(7 AS DOUBLE) AS score FROM files WHERE n IN (3, 41, 150))"


def _given(spark: SparkSession) -> DataFrame:
    first = F.struct(F.lit(0).alias("strategy"), F.lit(0).cast("long").alias("ord"), F.lit(0).alias("sub"), F.col("file_id")).alias("ord")
    return spark.createDataFrame([(3,), (41,), (150,)], "file_id long").select("file_id", F.lit(7.0).alias("score"), F.lit("given").alias("reason"), first)


@_query(f"WITH RECURSIVE {_REACHED}, {_GIVEN}, {_SCORES} SELECT path, score, entry FROM scored")
def context_scores(spark, sf_dir):
    t, nodes, _ = _expanded(spark, sf_dir)
    ranked = ctx.ranked_files(t, _given(spark), nodes)
    return ranked.select("path", "score", F.array_contains("reasons", "entry-point-bonus").alias("entry"))


@_query(f"""WITH RECURSIVE {_REACHED}, {_GIVEN}, why AS (SELECT file_id, 0 AS part, 0 AS step, 'given' AS reason FROM given UNION ALL SELECT node, 1, depth, 'graph-expansion depth=' || depth FROM nodes)
SELECT path, string_agg(reason, '; ' ORDER BY part, step) || CASE WHEN {_ENTRY} THEN '; entry-point-bonus' ELSE '' END AS reasons FROM why JOIN files ON n = file_id GROUP BY path""")
def context_reasons(spark, sf_dir):
    t, nodes, _ = _expanded(spark, sf_dir)
    return ctx.ranked_files(t, _given(spark), nodes).select("path", F.array_join("reasons", "; ").alias("reasons"))


@_query(f"""WITH RECURSIVE {_REACHED}, focus AS (SELECT unnest([3, 41]) AS f), kept AS (SELECT * FROM walked WHERE src IN (SELECT f FROM focus) OR dst IN (SELECT f FROM focus)),
ends AS (SELECT src_type AS type, src_id AS id FROM kept UNION SELECT dst_type, dst_id FROM kept)
SELECT type, CAST(id AS VARCHAR) AS id, CASE WHEN type = 'file' THEN path END AS path FROM ends LEFT JOIN files ON n = id""")
def context_subgraph_nodes(spark, sf_dir):
    t, _, walked = _expanded(spark, sf_dir)
    ranked = spark.createDataFrame([(3, 1), (41, 2), (99, 11)], "file_id long, rank int")
    return ctx.subgraph(t, ranked, walked)[0]


# Patterns and words.


@_query(f"""SELECT p_partkey AS n, unnest(regexp_extract_all('see src/d' || p_partkey || '/f.ts and ./a/' || p_name || '.jsx, not x.py', '{ctx.PATH_IN_TEXT.replace("(?:", "(")}')) AS path FROM part""")
def paths_in_text(spark, sf_dir):
    text = F.concat(F.lit("see src/d"), F.col("n").cast("string"), F.lit("/f.ts and ./a/"), "p_name", F.lit(".jsx, not x.py"))
    return _part(spark, sf_dir).select("n", F.explode(F.regexp_extract_all(text, F.lit(ctx.PATH_IN_TEXT), F.lit(0))).alias("path"))


@_query(f"""SELECT p_partkey AS n, unnest(regexp_extract_all('Why does UserService call {'{'}' || upper(substr(p_name, 1, 1)) || lower(substr(p_name, 2, 1)) || 'OrderItem, HTTPServer or Plain', '{ctx.CAMEL_CASE.replace("(?:", "(")}')) AS name FROM part""")
def camel_case_names(spark, sf_dir):
    text = F.concat(F.lit("Why does UserService call {"), F.upper(F.substr("p_name", F.lit(1), F.lit(1))), F.lower(F.substr("p_name", F.lit(2), F.lit(1))), F.lit("OrderItem, HTTPServer or Plain"))
    return _part(spark, sf_dir).select("n", F.explode(F.regexp_extract_all(text, F.lit(ctx.CAMEL_CASE), F.lit(0))).alias("name"))


_ACCENTED = ("Žluťoučký kůň", "zlutoucky kun", "CAFÉ Ångström", "cafe angstrom ộ", "Ωμέγα ё", "plain")
_ROWS = f"texts AS (SELECT p_partkey AS key, {_picked(_ACCENTED, 'p_partkey')} || ' ' || p_partkey AS text FROM part)"


def _accented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part(spark, sf_dir).select(F.col("n").alias("key"), F.concat_ws(" ", _pick(_ACCENTED, F.col("n")), F.col("n").cast("string")).alias("text"))


@_query(f"WITH {_ROWS}, {_TOKENS} SELECT key FROM tokens_of_texts WHERE list_contains(t, 'zlutoucky') AND list_contains(t, 'kun')")
def search_accents(spark, sf_dir):
    return search.match(_accented(spark, sf_dir), "KŮŇ žluťoučký", True, "key")


@_query(f"WITH {_ROWS}, {_TOKENS} SELECT key FROM tokens_of_texts WHERE len(list_filter(t, lambda x: starts_with(x, 'angst'))) > 0 OR list_contains(t, 'ωμεγα')")
def search_accent_prefix(spark, sf_dir):
    rows = _accented(spark, sf_dir)
    return search.match_prefix(rows, "Ångst", "key").union(search.match(rows, "ΩΜΈΓΑ", False, "key"))


@_query(f"WITH {_ROWS}, {_TOKENS} {search.bm25_sql(['cafe', 'zlutoucky'], 'key', 'texts')}")
def search_accents_ranked(spark, sf_dir):
    return search.bm25(_accented(spark, sf_dir), "Café žluťoučký", "key")


@_query("SELECT source, lang, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, lang) AS place FROM documents WHERE lang IS NOT NULL) WHERE place = 1")
def best_by_text(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang is not null")
    return relational.best_per(rows, "source", "n_chars", "lang")


# Parsing and edges of special cases.

_SOURCE = "export { q } from './q';\ninterface I@ {}\nclass A@ implements I@ {}\nfunction d@() { return 1 }\nfunction d@() { return 2 }\nexport { d@ };\n"


@_query("""WITH s(name, line) AS (VALUES ('I@', 2), ('A@', 3), ('d@', 4), ('d@', 5)), e AS (SELECT 'DEFINES' AS rel, name, line FROM s UNION ALL VALUES ('EXPORTS', 'd@', 5), ('IMPLEMENTS', 'I@', 2))
SELECT p_partkey AS file_id, rel, replace(name, '@', CAST(p_partkey AS VARCHAR)) AS dst, line FROM part, e""")
def last_symbol_wins(spark, sf_dir):
    rows = _part(spark, sf_dir).select(F.lit(1).cast("long").alias("repo_id"), F.col("n").alias("file_id"), F.concat(F.lit("a/f"), F.col("n").cast("string"), F.lit(".ts")).alias("path"), F.lit("typescript").alias("lang"), F.replace(F.lit(_SOURCE), F.lit("@"), F.col("n").cast("string")).alias("text"))
    rows = cut(parsed(rows).drop("text"))
    symbols = symbols_of(rows)
    edges = symbol_edges(symbols, rows.select("repo_id", "file_id", F.col("parsed.exports").alias("exports")))
    ends = symbols.select(F.col("symbol_id").alias("dst_id"), F.col("name").alias("dst"), F.col("start_line").alias("line"))
    return edges.join(ends, "dst_id").select("file_id", "rel", "dst", "line")


@_query("SELECT p_partkey AS file_id, unnest(['./a', './b' || p_partkey]) AS source FROM part")
def esm_before_cjs(spark, sf_dir):
    source = F.concat(F.lit("import x from './a';\nconst { y } = require('./a');\nconst z = require('./b"), F.col("n").cast("string"), F.lit("');\n"))
    rows = parsed(_part(spark, sf_dir).select(F.col("n").alias("file_id"), source.alias("text"), F.lit("javascript").alias("lang")))
    return rows.select("file_id", F.explode("parsed.imports").alias("i")).select("file_id", "i.source")


@_query("SELECT a.p_partkey AS src_id, b.p_partkey AS dst_id FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def import_rejections(spark, sf_dir):
    """Bare specifiers, a file's own path and paths outside of the root mean nothing."""
    n = F.col("n")
    files = _part(spark, sf_dir).select(F.lit(1).cast("long").alias("repo_id"), n.alias("file_id"), F.concat(F.lit("s/f"), n.cast("string"), F.lit(".ts")).alias("path"))
    sources = [F.lit("react"), F.lit("s/f1"), F.concat(F.lit("./f"), n.cast("string")), F.lit("../../etc"), F.concat(F.lit("./f"), (n + 1).cast("string"))]
    imports = F.array(*[F.struct(x.alias("source"), F.array(F.lit("x")).alias("names"), F.lit(False).alias("is_type_only")) for x in sources])
    rows = files.join(_part(spark, sf_dir).select(n.alias("file_id"), imports.alias("imports")), "file_id")
    return import_edges(rows, files.withColumn("is_dir", F.lit(False)), files).select("src_id", "dst_id")


# The drawn graph.

_DRAWN = """drawn AS (SELECT * FROM symbols WHERE kind IN ('class', 'interface', 'enum')), links AS (SELECT 'file:' || src_id AS source, 'file:' || dst_id AS target, rel FROM edges WHERE rel = 'IMPORTS' AND dst_type = 'file'
UNION ALL SELECT 'symbol:' || src_id, 'symbol:' || dst_id, rel FROM edges WHERE rel = 'EXTENDS' AND src_id IN (SELECT symbol_id FROM drawn) AND dst_id IN (SELECT symbol_id FROM drawn)),
degrees AS (SELECT id, count(*) AS connections FROM (SELECT source AS id FROM links UNION ALL SELECT target FROM links) GROUP BY id)"""


@_query(f"WITH {_GRAPH}, {_DRAWN} SELECT * FROM links")
def drawn_links(spark, sf_dir):
    t = tables(spark, sf_dir)
    return visual.links(t.symbols, t.edges)


_NODES = """nodes AS (SELECT id, array_to_string(string_split(path, '/')[-2:], '/') AS label, path AS "fullPath", connections, CAST(greatest(5, least(22, 6 + 1.5 * connections)) AS DOUBLE) AS radius FROM files JOIN degrees ON id = 'file:' || n
UNION ALL SELECT 'symbol:' || symbol_id, name, fq_name, coalesce(connections, 0), CAST(greatest(7, least(22, 8 + 2.0 * coalesce(connections, 0))) AS DOUBLE) FROM drawn LEFT JOIN degrees ON id = 'symbol:' || symbol_id)"""


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    return visual.nodes(t.files, t.symbols, visual.links(t.symbols, t.edges)).select("id", "label", "fullPath", "connections", "radius")


@_query(f"WITH {_GRAPH}, {_DRAWN}, {_NODES} SELECT * FROM nodes")
def drawn_nodes(spark, sf_dir):
    return _nodes(spark, sf_dir)


@_query(f"""WITH {_GRAPH}, {_DRAWN}, {_NODES} SELECT id FROM nodes WHERE contains(lower(label), 'order') OR contains(lower("fullPath"), 'order') OR contains(lower(label), 'f77') OR contains(lower("fullPath"), 'f77')""")
def drawn_found(spark, sf_dir):
    n = _nodes(spark, sf_dir)
    return visual.find(n, "ORDER").select("id").union(visual.find(n, "f77").select("id")).distinct()


@_query(f"""WITH {_GRAPH} SELECT (SELECT count(*) FROM files) AS files, count(*) AS symbols, count(*) FILTER (WHERE kind = 'class') AS classes, count(*) FILTER (WHERE kind = 'interface') AS interfaces,
count(*) FILTER (WHERE kind = 'enum') AS enums, (SELECT count(*) FROM edges) AS edges FROM symbols""")
def drawn_stats(spark, sf_dir):
    t = tables(spark, sf_dir)
    return visual.stats(t.files, t.symbols, t.edges).select("files", "symbols", "classes", "interfaces", "enums", "edges")


@_query("SELECT r_regionkey, count(*) || CASE WHEN count(*) = 1 THEN ' nation' ELSE ' nations' END AS label FROM region JOIN nation ON r_regionkey = n_regionkey AND (n_regionkey > 0 OR n_nationkey = 0) GROUP BY r_regionkey")
def counted_labels(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_regionkey > 0 or n_nationkey = 0")
    return n.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count("*").alias("n")).select("r_regionkey", visual.counted(F.col("n"), "nation", "nations").alias("label"))

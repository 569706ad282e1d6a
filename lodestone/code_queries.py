"""Registered queries over source code: the part table is turned into files of eleven languages, whose symbols,
exports and imports are known, so that SQL can say what the parsers and the resolver must find."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .parsers import parsed
from .plans import context as ctx
from .plans.index import import_edges, search_rows, symbol_edges, symbols_of
from .plans.lineage import cut
from .sources.walk import language

#: Extension, source, symbols (kind, name, extends) and exports of the file of a part; @ is its number, ~ its name.
SAMPLES: list[tuple[str, str, list[tuple[str, str, str | None]], list[str]]] = [
    ("ts", "// class No {} ~\nimport { a } from './a';\nclass B@ {}\nexport class C@ extends B@ {\n  go(): string { return \"class D { ~\" }\n}\nexport const v@ = /[{']/;\n",
     [("class", "B@", None), ("class", "C@", "B@"), ("method", "C@.go", None), ("variable", "v@", None)], ["C@", "v@"]),
    ("js", "const a = require('./a'); // ~\nfunction f@() { return `}${ { x: '~' } }{` }\nmodule.exports = { f@ };\n",
     [("function", "f@", None), ("variable", "a", None)], ["f@"]),
    ("py", "from .a import b\n\nclass C@(Base):\n    '''class No: ~'''\n    def go(self):\n        return '~'\n\n_x = 1\n",
     [("class", "C@", "Base"), ("method", "C@.go", None), ("variable", "_x", None)], ["C@"]),
    ("go", "package p\nimport \"fmt\"\n// func No() {} ~\ntype T@ struct {\n\tBase\n}\nfunc (t *T@) Go() string { return `} ~` }\nfunc low@() {}\n",
     [("struct", "T@", "Base"), ("method", "T@.Go", None), ("function", "low@", None)], ["T@", "T@.Go"]),
    ("rs", "use a::b;\npub struct S@ { x: u8 }\nimpl S@ { pub fn go<'a>(&'a self) -> char { '}' } }\n/* fn no() {} ~ */ fn low@() {}\n",
     [("struct", "S@", None), ("method", "S@.go", None), ("function", "low@", None)], ["S@", "S@.go"]),
    ("php", "<?php\nuse A\\B;\n// class No {} ~\nclass C@ extends Base {\n  public function go() { return \"} ~\"; }\n}\nfunction f@() {}\n",
     [("class", "C@", "Base"), ("method", "C@.go", None), ("function", "f@", None)], ["C@", "f@"]),
    ("java", "import a.B;\n/* class No {} ~ */\npublic class C@ extends Base<B> {\n  private int n = 1;\n  public String go() { return \"} ~\"; }\n}\nclass P@ {}\n",
     [("class", "C@", "Base"), ("variable", "C@.n", None), ("method", "C@.go", None), ("class", "P@", None)], ["C@"]),
    ("rb", "require 'a'\n# class No ~\nclass C@ < Base\n  attr_reader :n\n  def go\n    if n then 'end ~' end\n  end\nend\ndef f@; end\n",
     [("class", "C@", "< Base"), ("property", "C@.n", None), ("method", "C@.go", None), ("function", "f@", None)], ["C@", "f@"]),
    ("c", "#include \"a.h\"\n#define M@ 1\n/* int no(void); ~ */\nstatic int low@(int a) { return a; }\nchar *go@(void) { return \"} ~\"; }\n",
     [("constant", "M@", None), ("function", "low@", None), ("function", "go@", None)], ["M@", "go@"]),
    ("cpp", "#include <a>\n// class No {}; ~\nclass C@ : public Base {\npublic:\n  const char *go() { return \"} ~\"; }\n};\nnamespace n@ { int f@() { return 1; } }\n",
     [("class", "C@", "Base"), ("method", "C@::go", None), ("namespace", "n@", None), ("function", "f@", None)], ["C@", "C@::go", "n@", "f@"]),
    ("cs", "using A.B;\n// class No {} ~\npublic class C@ : Base {\n  public int N { get; set; }\n  private string go() { return \"} ~\"; }\n}\n",
     [("class", "C@", "Base"), ("property", "C@.N", None), ("method", "C@.go", None)], ["C@", "C@.N"]),
]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _choice(values: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col("p_partkey") % len(values) + 1).cast("int"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo_id, file_id, path, lang, text: one file a part."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name")
    number = F.col("p_partkey").cast("string")
    text = F.replace(F.replace(_choice([s[1] for s in SAMPLES]), F.lit("@"), number), F.lit("~"), F.col("p_name"))
    path = F.concat(F.lit("src/f"), number, F.lit("."), _choice([s[0] for s in SAMPLES]))
    return part.select(F.lit(1).cast("long").alias("repo_id"), F.col("p_partkey").alias("file_id"), path.alias("path"), text.alias("text")).withColumn("lang", language(F.col("path")))


def _quoted(s: str | None) -> str:
    return "NULL" if s is None else "'" + s + "'"


def _numbered(column: str) -> str:
    return f"replace({column}, '@', CAST(p_partkey AS VARCHAR))"


_SYMBOLS = "samples(lang, kind, name, base) AS (VALUES " + ", ".join(f"({i}, '{kind}', '{name}', {_quoted(base)})" for i, s in enumerate(SAMPLES) for kind, name, base in s[2]) + ")"
_EXPORTS = "listed(lang, name) AS (VALUES " + ", ".join(f"({i}, '{name}')" for i, s in enumerate(SAMPLES) for name in s[3]) + ")"


@_query(f"WITH {_SYMBOLS} SELECT p_partkey AS file_id, kind, {_numbered('name')} AS name, {_numbered('base')} AS base FROM part JOIN samples ON p_partkey % {len(SAMPLES)} = lang")
def parse_symbols(spark, sf_dir):
    rows = parsed(sources(spark, sf_dir)).select("file_id", F.explode("parsed.symbols").alias("s"))
    return rows.select("file_id", "s.kind", "s.name", F.col("s.extends").alias("base"))


@_query(f"WITH {_EXPORTS} SELECT p_partkey AS file_id, {_numbered('name')} AS name FROM part JOIN listed ON p_partkey % {len(SAMPLES)} = lang")
def parse_exports(spark, sf_dir):
    return parsed(sources(spark, sf_dir)).select("file_id", F.explode("parsed.exports").alias("e")).select("file_id", "e.name")


_SOURCE_OF = ["./a", "./a", ".a", "fmt", "a", "A", "a", "a", "a.h", "a", "A.B"]


@_query(f"SELECT p_partkey AS file_id, ([{', '.join(map(_quoted, _SOURCE_OF))}])[CAST(p_partkey % {len(SAMPLES)} AS INTEGER) + 1] AS source FROM part")
def parse_imports(spark, sf_dir):
    return parsed(sources(spark, sf_dir)).select("file_id", F.explode("parsed.imports").alias("i")).select("file_id", "i.source")


@_query(f"""WITH {_SYMBOLS}, {_EXPORTS}, s AS (SELECT p_partkey AS file_id, {_numbered('name')} AS name, {_numbered('base')} AS base FROM part JOIN samples ON p_partkey % {len(SAMPLES)} = lang),
e AS (SELECT p_partkey AS file_id, {_numbered('name')} AS name FROM part JOIN listed ON p_partkey % {len(SAMPLES)} = lang)
SELECT file_id, 'DEFINES' AS rel, name AS dst, CAST(1.0 AS DOUBLE) AS weight FROM s
UNION ALL SELECT e.file_id, 'EXPORTS', e.name, CAST(0.8 AS DOUBLE) FROM e JOIN s ON e.file_id = s.file_id AND e.name = s.name
UNION ALL SELECT a.file_id, 'EXTENDS', b.name, CAST(1.0 AS DOUBLE) FROM s a JOIN s b ON a.file_id = b.file_id AND a.base = b.name""")
def index_symbol_edges(spark, sf_dir):
    rows = cut(parsed(sources(spark, sf_dir)).drop("text"))  # read by three branches, parsed once
    symbols = symbols_of(rows)
    edges = symbol_edges(symbols, rows.select("repo_id", "file_id", F.col("parsed.exports").alias("exports")))
    return edges.join(symbols.select(F.col("symbol_id").alias("dst_id"), F.col("name").alias("dst")), "dst_id").select("file_id", "rel", "dst", "weight")


def module_tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Files of a tree, one a part, some of them index files of a folder; and their imports: each of the next part's
    file, by one of several spellings, and of one that does not exist."""
    p = F.col("p_partkey")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey")
    stem = lambda n: F.concat(F.lit("d"), (n % 7).cast("string"), F.lit("/f"), n.cast("string"))
    ending = F.when(p % 10 == 0, F.lit("/index.ts")).otherwise(F.concat(F.lit("."), _choice(["ts", "tsx", "js"])))
    files = part.select(F.lit(1).cast("long").alias("repo_id"), p.alias("file_id"), F.concat(F.lit("src/"), stem(p), ending).alias("path"))
    up = F.when(p % 10 == 0, "../../").otherwise("../")
    spelled = F.when((p % 2 == 0) & ((p + 1) % 10 != 0), F.lit(".js")).otherwise("")
    following = F.struct(F.concat(up, stem(p + 1), spelled).alias("source"), F.array(F.lit("x")).alias("names"), F.lit(False).alias("is_type_only"))
    missing = F.struct(F.lit("./missing").alias("source"), F.array(F.lit("y")).alias("names"), F.lit(True).alias("is_type_only"))
    outside = F.struct(F.lit("../../../../x").alias("source"), F.array(F.lit("z")).alias("names"), F.lit(False).alias("is_type_only"))
    rows = files.join(part.select(p.alias("file_id"), F.array(following, missing, outside).alias("imports")), "file_id")
    return files, rows


@_query("""SELECT a.p_partkey AS src_id, b.p_partkey AS dst_id, 'IMPORTS' AS rel, '{"names":["x"],"isTypeOnly":false}' AS meta_json FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""")
def import_resolution(spark, sf_dir):
    files, rows = module_tree(spark, sf_dir)
    return import_edges(rows, files.withColumn("is_dir", F.lit(False)), files).select("src_id", "dst_id", "rel", "meta_json")


@_query(f"""SELECT p_partkey AS file_id, ([{', '.join(_quoted(n) for n in ("typescript", "javascript", "python", "go", "rust", "php", "java", "ruby", "c", "cpp", "csharp"))}])[CAST(p_partkey % 11 AS INTEGER) + 1] AS lang FROM part""")
def file_language(spark, sf_dir):
    return sources(spark, sf_dir).select("file_id", "lang")


def _tables(spark: SparkSession, sf_dir: str) -> ctx.Tables:
    files, rows = module_tree(spark, sf_dir)
    text = sources(spark, sf_dir)
    symbols = cut(symbols_of(parsed(text.drop("path").join(files.select("file_id", "path"), "file_id"))))
    edges = cut(import_edges(rows, files.withColumn("is_dir", F.lit(False)), files))
    return ctx.Tables(files, symbols, edges, text.select("file_id", "text"), search_rows(files, symbols), 1)


_TASK, _HINTS = "Change how src/d3/f17.ts is built from other parts", {"symbols": ["C1", "C22"], "paths": ["src/d0/f0/index.ts"]}


def _ranked(spark: SparkSession, sf_dir: str) -> tuple[ctx.Tables, DataFrame, DataFrame]:
    t = _tables(spark, sf_dir)
    found = cut(ctx.candidates(t, _TASK, _HINTS))
    nodes, _ = ctx.expanded(t, found.orderBy(F.col("score").desc(), "ord").limit(ctx.SEEDS))
    return t, cut(ctx.ranked_files(t, found, nodes)), found


@_query()
def context_focus(spark, sf_dir):
    return ctx.focus(*_ranked(spark, sf_dir)).select("rank", "place", "type", "path", "fq_name", "reason")


@_query()
def context_snippets(spark, sf_dir):
    t, ranked, _ = _ranked(spark, sf_dir)
    return ctx.snippets(t, ranked, 500).select("rank", "path", "start", "end", "sha256", "tokens")

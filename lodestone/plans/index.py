"""From source files to the tables of a code graph: full and incremental indexing."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import WEIGHTS
from ..operators.resolve import resolved
from ..parsers import parsed
from ..sources import walk
from ..store import Store

#: Warnings that a summary lists; it counts the rest.
SHOWN_WARNINGS = 1000


def repo_id_of(spark: SparkSession, root: str) -> int:
    return spark.range(1).select(F.xxhash64(F.lit(root))).first()[0]


def with_ids(files: DataFrame, repo_id: int | None = None) -> DataFrame:
    """files (path, ...) with repo_id and file_id; repo_id may be a column already."""
    if repo_id is not None:
        files = files.withColumn("repo_id", F.lit(repo_id).cast("long"))
    return files.withColumn("file_id", F.xxhash64("repo_id", "path"))


def symbols_of(parsed_files: DataFrame) -> DataFrame:
    """One row a symbol.  parsed_files: repo_id, file_id, path, parsed."""
    s = parsed_files.select("repo_id", "file_id", "path", F.posexplode("parsed.symbols").alias("ord", "s"))
    return s.select("repo_id", "file_id", F.xxhash64("repo_id", "path", "ord").alias("symbol_id"), "ord", "s.*", F.concat_ws(":", "path", "s.name").alias("fq_name"))


def symbol_edges(symbols: DataFrame, parsed_rows: DataFrame) -> DataFrame:
    """DEFINES, EXPORTS, EXTENDS and IMPLEMENTS edges.  Names are looked up in their own file, where the last symbol
    of a name wins.  parsed_rows: file_id and exports."""
    named = symbols.groupBy("file_id", "name").agg(F.max_by("symbol_id", "ord").alias("named_id"))
    base = ["repo_id", "file_id"]

    def edge(rel: str, src_type: str, src: str, dst: str) -> list:
        return [*base, F.lit(src_type).alias("src_type"), F.col(src).alias("src_id"), F.lit(rel).alias("rel"), F.lit("symbol").alias("dst_type"), F.col(dst).alias("dst_id"), F.lit(WEIGHTS[rel]).alias("weight"), "ord"]

    defines = symbols.select(*edge("DEFINES", "file", "file_id", "symbol_id"))
    exports = parsed_rows.select(*base, F.posexplode("exports").alias("ord", "e")).where("not e.is_re_export").select(*base, "ord", F.col("e.name").alias("name"))
    own_base = symbols.where("extends is not null").select(*base, "ord", "symbol_id", F.col("extends").alias("name"))
    listed = symbols.select(*base, "ord", "symbol_id", F.explode("implements").alias("name"))
    return (
        defines.unionByName(exports.join(named, ["file_id", "name"]).select(*edge("EXPORTS", "file", "file_id", "named_id")))
        .unionByName(own_base.join(named, ["file_id", "name"]).select(*edge("EXTENDS", "symbol", "symbol_id", "named_id")))
        .unionByName(listed.join(named, ["file_id", "name"]).select(*edge("IMPLEMENTS", "symbol", "symbol_id", "named_id")))
        .withColumn("meta_json", F.lit(None).cast("string"))
    )


def import_edges(parsed_rows: DataFrame, listed: DataFrame, files: DataFrame, strict_compat: bool = False) -> DataFrame:
    """One IMPORTS edge a statement that means another indexed file.  parsed_rows: repo_id, file_id, path, imports."""
    imports = parsed_rows.select("repo_id", "file_id", "path", F.posexplode("imports").alias("ord", "i")).select("repo_id", "file_id", "path", "ord", "i.source", "i.names", "i.is_type_only")
    meta = F.to_json(F.struct("names", F.col("is_type_only").alias("isTypeOnly")))
    return resolved(imports, listed, files, strict_compat).select(
        "repo_id", "file_id", F.lit("file").alias("src_type"), F.col("file_id").alias("src_id"), F.lit("IMPORTS").alias("rel"),
        F.lit("file").alias("dst_type"), "dst_id", F.lit(WEIGHTS["IMPORTS"]).alias("weight"), "ord", meta.alias("meta_json"),
    )


def search_rows(files: DataFrame, symbols: DataFrame) -> DataFrame:
    of_files = files.select("repo_id", F.lit("file").alias("entity_type"), F.col("file_id").alias("entity_id"), F.col("path").alias("text"))
    return of_files.unionByName(symbols.select("repo_id", F.lit("symbol").alias("entity_type"), F.col("symbol_id").alias("entity_id"), F.concat_ws(" ", "name", "fq_name").alias("text")))


def index_repo(store: Store, root: str, mode: str | None = None, level: int = 0, strict_compat: bool = False) -> dict:
    """Indexes the tree at root and returns a summary.

    Without a mode, a repository that is known is indexed incrementally: files of equal digest and time are taken
    over as they were parsed, others are parsed anew.  Either way IMPORTS edges are derived from all parsed rows, so
    an edge comes and goes with either of its ends.  A full index replaces what was there."""
    spark, began = store.spark, time.time()
    repo_id = repo_id_of(spark, root)
    old = store.manifest(repo_id)
    mode = mode or ("incremental" if old else "full")
    if mode not in ("full", "incremental"):
        raise ValueError(f"Unknown mode: {mode}")
    if mode == "incremental" and not old:
        raise ValueError("Repository has not been indexed yet. Run a full index first.")
    version, stamp = store.version(), F.current_timestamp()

    try:
        every = with_ids(walk.listing(spark, root), repo_id)
        listed = store.write(repo_id, version, "listing", every)
        found = with_ids(walk.source_files(every), repo_id)
        # Read once, written once; everything after reads these files.
        read = walk.read(found.repartition(spark.sparkContext.defaultParallelism, "file_id"), root)
        read.write.mode("overwrite").parquet(store._folder(repo_id, version, "read"))
        read = spark.read.parquet(store._folder(repo_id, version, "read"))
        current, unread = read.where("text is not null"), read.where("text is null")

        if mode == "incremental":
            before = store.table("files", repo_id)
            both = before.select("file_id", F.col("sha256").alias("_sha"), F.col("mtime").alias("_mtime")).join(current.select("file_id", "sha256", "mtime"), "file_id", "full")
            same = both.where("_sha = sha256 and _mtime = mtime").select("file_id")
            deleted = both.where("sha256 is null").count()
            fresh = current.join(same, "file_id", "left_anti")
            kept = lambda name: store.table(name, repo_id).join(same, "file_id", "left_semi")
        else:
            same, deleted, fresh = None, 0, current

        new = parsed(fresh.select("repo_id", "file_id", "path", "lang", "text")).select("repo_id", "file_id", "path", "parsed")
        new_parsed = new.select("repo_id", "file_id", "path", "parsed.imports", "parsed.exports", "parsed.symbols", F.col("parsed.error").alias("warning"))
        new_parsed.write.mode("overwrite").parquet(store._folder(repo_id, version, "fresh"))
        new_parsed = spark.read.parquet(store._folder(repo_id, version, "fresh"))
        new_symbols = symbols_of(new_parsed.withColumn("parsed", F.struct("symbols")))
        new_files = fresh.withColumn("last_indexed_at", stamp)
        new_edges = symbol_edges(new_symbols, new_parsed)

        join_kept = (lambda name, rows: kept(name).unionByName(rows, allowMissingColumns=True)) if same is not None else (lambda _, rows: rows)
        files = store.write(repo_id, version, "files", join_kept("files", new_files.select("repo_id", "file_id", "path", "lang", "sha256", "mtime", "size_bytes", "last_indexed_at")))
        symbols = store.write(repo_id, version, "symbols", join_kept("symbols", new_symbols))
        rows = store.write(repo_id, version, "parsed", join_kept("parsed", new_parsed.drop("symbols")))
        store.write(repo_id, version, "contents", current)
        own = join_kept("edges", new_edges)
        edges = store.write(repo_id, version, "edges", own.where("rel <> 'IMPORTS'").unionByName(import_edges(rows, listed, files, strict_compat)))
        store.write(repo_id, version, "search_index", search_rows(files, symbols))
        created = old["created_at"] if old else time.time()
        repos = spark.createDataFrame([(repo_id, root, created, time.time())], "repo_id long, root_path string, c double, u double")
        store.write(repo_id, version, "repos", repos.select("repo_id", "root_path", F.timestamp_seconds("c").alias("created_at"), F.timestamp_seconds("u").alias("updated_at")))
        modules = spark.createDataFrame([], "repo_id long, module_id long, name string, version string, manifest_path string")
        store.write(repo_id, version, "modules", modules)

        warned = unread.select("warning").unionByName(new_parsed.where("warning is not null").select("warning"))
        warnings = [r[0] for r in warned.orderBy("warning").limit(SHOWN_WARNINGS).collect()]
        if len(warnings) == SHOWN_WARNINGS and (more := warned.count() - SHOWN_WARNINGS):
            warnings.append(f"{more} more warnings")
        summary = {
            "repoId": repo_id, "mode": mode, "level": level, "filesIndexed": fresh.count(), "filesSkipped": unread.count(),
            "filesDeleted": deleted, "symbolCount": new_symbols.count(), "edgeCount": edges.count(), "warnings": warnings,
        }
        store.commit({"repo_id": repo_id, "root_path": root, "version": version, "created_at": created, "strict_compat": strict_compat})
    except BaseException:
        store.rollback(repo_id, version)
        raise
    finally:
        for name in ("read", "fresh"):
            store._fs.delete(store._path(store._folder(repo_id, version, name)), True)
    return summary | {"durationMs": round((time.time() - began) * 1000)}

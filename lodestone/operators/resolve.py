"""Import resolution as one equi-join.

Every path on disk is listed once under each specifier that may mean it, with the place of that reading in the
order of preference; the best reading of a specifier is chosen before the join.  So an import is one row and one
key, instead of one row for each of some thirty candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Extensions that a specifier may leave out, and files that stand for their folder, best first.
ADDED = [".ts", ".tsx", ".js", ".jsx", ".py", ".go", ".rs", ".php", ".java", ".rb", ".c", ".h", ".cpp", ".cc", ".cxx", ".hpp", ".cs"]
INDEX_FILES = ["index.ts", "index.tsx", "index.js", "index.jsx", "__init__.py", "mod.rs"]
#: What an extension in a specifier may stand for.
WRITTEN_FOR = [(".js", ".ts"), (".js", ".tsx"), (".jsx", ".tsx")]


def joined_path(folder: Column, relative: Column) -> Column:
    """relative seen from folder, without dots; null where it leaves the root."""
    parts = F.split(F.concat(folder, F.lit("/"), relative), "/")
    rooted = F.array(F.lit(""))  # never popped, so that an empty path is no escape

    def step(path: Column, part: Column) -> Column:
        return (
            F.when(path.isNull(), path)
            .when(part.isin("", "."), path)
            .when(part == "..", F.when(F.size(path) > 1, F.slice(path, F.lit(1), F.size(path) - 1)))
            .otherwise(F.concat(path, F.array(part)))
        )

    return F.aggregate(parts, rooted, step, lambda p: F.array_join(F.slice(p, F.lit(2), F.greatest(F.size(p), F.lit(1))), "/"))


def folder_of(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise("")


def specifiers(listed: DataFrame, strict_compat: bool = False) -> DataFrame:
    """repo_id, target, path: what each specifier means.  listed: repo_id, path, is_dir.

    With strict_compat a folder is what its own path means, which hides its index file."""
    path, file = F.col("path"), ~F.col("is_dir")

    def reading(when: Column, target: Column, place: int) -> Column:
        return F.when(when, F.struct(target.alias("target"), F.lit(place).alias("place")))

    readings = [reading(file | F.lit(strict_compat), path, 0)]
    for i, (written, real) in enumerate(WRITTEN_FOR):
        readings.append(reading(file & path.endswith(real), F.concat(path.substr(F.lit(1), F.length(path) - len(real)), F.lit(written)), 1 + i))
    for i, ext in enumerate(ADDED):
        readings.append(reading((file | F.lit(strict_compat)) & path.endswith(ext), path.substr(F.lit(1), F.length(path) - len(ext)), 10 + i))
    for i, name in enumerate(INDEX_FILES):
        readings.append(reading(file & ((path == name) | path.endswith(f"/{name}")), folder_of(path), 40 + i))
    flat = listed.select("repo_id", "path", F.explode(F.array_compact(F.array(*readings))).alias("r"))
    best = flat.groupBy("repo_id", "r.target").agg(F.min(F.struct("r.place", "path")).alias("b"))
    return best.select("repo_id", "target", F.col("b.path").alias("path"))


def resolved(imports: DataFrame, listed: DataFrame, files: DataFrame, strict_compat: bool = False) -> DataFrame:
    """imports with dst_id, of those that mean another indexed file.

    imports: repo_id, file_id, path (of the importing file), source and further columns.  Only sources that begin
    with a dot are looked up."""
    wanted = imports.where(F.startswith("source", F.lit("."))).withColumn("target", joined_path(folder_of(F.col("path")), F.col("source")))
    meant = specifiers(listed, strict_compat).join(files.select("repo_id", "path", F.col("file_id").alias("dst_id")), ["repo_id", "path"])
    return wanted.where("target is not null").join(meant.drop("path"), ["repo_id", "target"]).where("dst_id <> file_id").drop("target")

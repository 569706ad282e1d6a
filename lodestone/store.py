"""A warehouse of code graphs: tables in versions by repository, and a manifest that names the current one.

A commit writes its tables beside those of earlier versions and then replaces the repository's manifest in one
rename, so readers see all of a version or nothing of it, and a job that fails leaves the old one.  Files are read
and written through Spark's own file systems, so a warehouse may lie on any that Spark reaches.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from .schemas import TABLES


class Store:
    def __init__(self, spark: SparkSession, warehouse: str):
        self.spark, self.root = spark, warehouse.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifest_path(self, repo_id: int):
        return self._path(f"{self.root}/manifests/{repo_id}.json")

    def _read(self, path) -> dict:
        stream = self._fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def manifest(self, repo_id: int) -> dict | None:
        path = self._manifest_path(repo_id)
        return self._read(path) if self._fs.exists(path) else None

    def manifests(self) -> list[dict]:
        folder = self._path(f"{self.root}/manifests")
        if not self._fs.exists(folder):
            return []
        return [self._read(s.getPath()) for s in self._fs.listStatus(folder) if s.getPath().getName().endswith(".json")]

    def _folder(self, repo_id: int, version: str, table: str) -> str:
        return f"{self.root}/data/{table}/{repo_id}/{version}"

    def table(self, name: str, repo_id: int | None = None) -> DataFrame:
        """The current rows of a table, of one repository or all."""
        current = [m for m in ([self.manifest(repo_id)] if repo_id is not None else self.manifests()) if m]
        folders = [self._folder(m["repo_id"], m["version"], name) for m in current]
        if not folders:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(*folders)

    def write(self, repo_id: int, version: str, name: str, rows: DataFrame) -> DataFrame:
        """Writes one table of a version that is not yet current, and reads it again."""
        folder = self._folder(repo_id, version, name)
        columns = [c.split(" ", 1)[0] for c in _columns(TABLES[name])]
        rows.select(*columns).write.mode("overwrite").parquet(folder)
        return self.spark.read.schema(TABLES[name]).parquet(folder)

    def version(self) -> str:
        return uuid.uuid4().hex

    def commit(self, manifest: dict) -> None:
        """Makes a version current and deletes the one before it."""
        old = self.manifest(manifest["repo_id"])
        path = self._manifest_path(manifest["repo_id"])
        staged = self._path(f"{path.toString()}.{manifest['version']}")
        stream = self._fs.create(staged, True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(staged, path, options)
        if old:
            self._delete(old["repo_id"], old["version"])

    def _delete(self, repo_id: int, version: str) -> None:
        for name in TABLES:
            self._fs.delete(self._path(self._folder(repo_id, version, name)), True)

    def rollback(self, repo_id: int, version: str) -> None:
        """Deletes what a version that never became current has written."""
        self._delete(repo_id, version)

    def drop(self, repo_id: int) -> None:
        """Forgets a repository with everything in it."""
        if old := self.manifest(repo_id):
            self._fs.delete(self._manifest_path(repo_id), False)
            self._delete(repo_id, old["version"])


def _columns(ddl: str) -> list[str]:
    """Column definitions of a table, split at the commas outside angle brackets."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(ddl[last:i].strip())
            last = i + 1
    return [*out, ddl[last:].strip()]

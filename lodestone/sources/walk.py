"""Source trees as tables: walking, ignore rules, languages, reading.

One tree is listed by the driver, which keeps a path, two numbers and a flag of each entry; files are read by the
executors, which must see the tree.  A corpus too large for that comes as a table with path and text columns.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What is never indexed.
DEFAULT_IGNORES = ["node_modules", "vendor", "dist", "build", ".next", ".cache", "coverage", ".git", "*.lock", "*.min.js", "*.min.css", "*.map"]
#: Extensions of each language.
EXTENSIONS = {
    "typescript": [".ts", ".tsx"], "javascript": [".js", ".jsx", ".mjs", ".cjs"], "python": [".py", ".pyi"], "go": [".go"],
    "rust": [".rs"], "php": [".php"], "java": [".java"], "ruby": [".rb"], "c": [".c", ".h"],
    "cpp": [".cpp", ".cc", ".cxx", ".hpp", ".hxx", ".hh"], "csharp": [".cs"],
}
LANGUAGE_OF = {ext: lang for lang, exts in EXTENSIONS.items() for ext in exts}


def language(path: Column) -> Column:
    """The language that a path's extension names, in either case; null for others."""
    ext = F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))
    known = F.create_map(*[F.lit(x) for pair in LANGUAGE_OF.items() for x in pair])
    return F.try_element_at(known, ext)


class Ignore:
    """Ignore rules in the usual format, in either case.  The last rule that fits a path decides; what lies in an
    ignored folder is ignored, whatever rules come after."""

    def __init__(self, lines: list[str]):
        self.rules = [rule for rule in map(self._rule, lines) if rule]

    @staticmethod
    def _rule(line: str) -> tuple[re.Pattern, bool, bool] | None:
        line = line.rstrip("\r\n")
        line = re.sub(r"(?<!\\)[ \t]+$", "", line)
        if not line or line.startswith("#"):
            return None
        negated = line.startswith("!")
        line = line[negated:]
        only_folders = line.endswith("/")
        line = line.rstrip("/") if only_folders else line
        anchored = "/" in line
        line = line.lstrip("/")
        if not line:
            return None
        out, i = [], 0
        while i < len(line):
            if line.startswith("**/", i) and (i == 0 or line[i - 1] == "/"):
                out.append("(?:[^/]+/)*")
                i += 3
            elif line[i:] == "**" and i and line[i - 1] == "/":
                out.append(".+")
                i += 2
            elif line[i] == "*":
                out.append("[^/]*")
                i += 1
                while line[i : i + 1] == "*":
                    i += 1
            elif line[i] == "?":
                out.append("[^/]")
                i += 1
            elif line[i] == "[" and (close := line.find("]", i + 2)) > 0:
                body = line[i + 1 : close].replace("\\", "\\\\")
                out.append("[" + ("^" + body[1:] if body[0] in "!^" else body) + "]")
                i = close + 1
            elif line[i] == "\\" and i + 1 < len(line):
                out.append(re.escape(line[i + 1]))
                i += 2
            else:
                out.append(re.escape(line[i]))
                i += 1
        try:
            return re.compile(("" if anchored else "(?:.*/)?") + "".join(out), re.I | re.S), negated, only_folders
        except re.error:
            return None

    def _own(self, path: str, is_dir: bool) -> bool:
        for pattern, negated, only_folders in reversed(self.rules):
            if (is_dir or not only_folders) and pattern.fullmatch(path):
                return not negated
        return False

    def ignored(self, path: str, is_dir: bool = False) -> bool:
        parts = path.split("/")
        return any(self._own("/".join(parts[:n]), True) for n in range(1, len(parts))) or self._own(path, is_dir)


def ignore_rules(root: str) -> Ignore:
    """The default rules, then those of the root's .gitignore; files of that name below it are not read."""
    try:
        lines = (Path(root) / ".gitignore").read_text(encoding="utf-8", errors="replace").split("\n")
    except OSError:
        lines = []
    return Ignore(DEFAULT_IGNORES + lines)


def entries(root: str) -> Iterator[tuple[str, bool, int, float, bool]]:
    """path, is_dir, size, mtime in ms and wanted, of everything below root but its .git, in order of paths.

    Links are not followed.  Wanted are files that no rule ignores and no hidden name is part of."""
    rules, found = ignore_rules(root), []
    stack: list[tuple[str, bool]] = [("", True)]
    while stack:
        folder, wanted = stack.pop()
        try:
            inside = list(os.scandir(os.path.join(root, folder)))
        except OSError:
            continue
        for e in inside:
            path = f"{folder}/{e.name}" if folder else e.name
            try:
                linked, is_dir = e.is_symlink(), e.is_dir(follow_symlinks=False)
                stat = e.stat(follow_symlinks=False)
            except OSError:
                continue
            ok = wanted and not linked and not e.name.startswith(".") and not rules._own(path, is_dir)
            found.append((path, is_dir, stat.st_size, stat.st_mtime * 1000, ok and not is_dir))
            if is_dir and path != ".git":
                stack.append((path, ok))
    return iter(sorted(found))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path, is_dir, size_bytes, mtime, wanted of everything below root."""
    rows = list(entries(root))
    return spark.createDataFrame(rows, "path string, is_dir boolean, size_bytes long, mtime double, wanted boolean")


def source_files(listed: DataFrame) -> DataFrame:
    """path, lang, size_bytes, mtime of the wanted files whose extension names a language."""
    return listed.where("wanted").select("path", language(F.col("path")).alias("lang"), "size_bytes", "mtime").where("lang is not null")


def read(files: DataFrame, root: str) -> DataFrame:
    """files with text, sha256 (of the bytes) and warning; a file that cannot be read has a null text and a warning."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for batch in batches:
            # A file at a time, so that a batch of large files does not stand in memory at once.
            for row in range(len(batch)):
                one = batch.iloc[row : row + 1].copy()
                try:
                    data = (Path(root) / one["path"].iloc[0]).read_bytes()
                    one["text"], one["sha256"], one["warning"] = data.decode("utf-8", errors="replace"), hashlib.sha256(data).hexdigest(), None
                except OSError as e:
                    one["text"], one["sha256"], one["warning"] = None, None, f"Failed to read {one['path'].iloc[0]}: {e.strerror}"
                yield one

    return files.mapInPandas(load, f"{fields}, text string, sha256 string, warning string")

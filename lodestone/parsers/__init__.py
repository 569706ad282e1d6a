"""Table-valued parsers: source text to imports, exports and symbols, for eleven languages."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import PARSED
from .braces import c_language, cpp, csharp, go, java, php, rust
from .lexer import Code
from .python import python
from .ruby import ruby
from .script import javascript, typescript

LANGUAGES: dict[str, Callable[[Code], dict]] = {
    "typescript": typescript, "javascript": javascript, "python": python, "go": go, "rust": rust, "php": php,
    "java": java, "ruby": ruby, "c": c_language, "cpp": cpp, "csharp": csharp,
}


def parse(text: str | None, lang: str | None) -> dict:
    """imports, exports and symbols of one file; all empty for a null or blank text or an unknown language.

    A file that an extractor cannot read yields nothing, and its `error` says why; other files go on."""
    found = {"imports": [], "exports": [], "symbols": [], "error": None}
    if text and text.strip() and lang in LANGUAGES:
        try:
            found |= LANGUAGES[lang](Code(text, lang))
        except Exception as e:  # noqa: BLE001 - one odd file must not end a job over millions
            found["error"] = f"{type(e).__name__}: {e}"
    return found


def parsed(files: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """files with a `parsed` column.  Only text and language go to Python; the text comes back nowhere."""

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, langs in batches:
            yield pd.Series([json.dumps(parse(t, k)) for t, k in zip(texts, langs, strict=True)], dtype=object)

    return files.withColumn("parsed", F.from_json(run(F.col(text), F.col(lang)), PARSED))

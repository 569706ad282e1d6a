"""Scalar functions over text, paths and scores, as column expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folding() -> tuple[str, str]:
    """Letters of the Latin, Greek and Cyrillic blocks that are a letter with marks, those letters, and then the marks
    alone, which fold to nothing."""
    found = {}
    for c in map(chr, [*range(0xC0, 0x530), *range(0x1E00, 0x2000)]):
        base, *marks = unicodedata.normalize("NFD", c)
        if marks and all(unicodedata.combining(m) for m in marks) and c == c.lower():
            found[c] = base
    return "".join(found) + "".join(map(chr, range(0x300, 0x370))), "".join(found.values())


ACCENTED, FOLDED = _folding()
_FOLD = dict(zip(map(ord, ACCENTED), FOLDED)) | dict.fromkeys(range(0x300, 0x370))
#: Words of a question that name nothing; only words of more than three letters are looked up.
STOP_WORDS = (
    "the and for are but not you all can had her was one our out has have been this that with they from will what when make like time "
    "just know take come could than look only into over such also some more very does then them would about which there their should each file "
    "code function import export const class type interface return async await void null undefined true false need want find show help using where how"
).split()


def tokens(text: Column) -> Column:
    """Letters and digits, lower-cased, accents folded."""
    return F.filter(F.split(F.translate(F.lower(text), ACCENTED, FOLDED), r"[^\p{L}\p{N}\p{Co}]+"), lambda t: t != "")


def folded_words(text: str) -> list[str]:
    """The tokens of one string, as tokens() gives them."""
    return re.findall(r"[^\W_]+", text.lower().translate(_FOLD))


def occurrences(toks: Column, phrase: list[str]) -> Column:
    """How often a phrase of one or more tokens stands in a token array."""
    if len(phrase) == 1:
        return F.size(F.filter(toks, lambda t: t == phrase[0]))
    wanted, k = F.array(*map(F.lit, phrase)), len(phrase)

    def count(t: Column) -> Column:
        starts = F.when(F.size(t) >= k, F.sequence(F.lit(1), F.size(t) - k + 1)).otherwise(F.array().cast("array<int>"))
        return F.size(F.filter(starts, lambda i: F.slice(t, i, F.lit(k)) == wanted))

    # Bound once: an outer expression inside a lambda would be computed again for every element.
    return F.element_at(F.transform(F.array(toks), count), 1)


def query_words(text: Column) -> Column:
    """Distinct words of a question, in order, without short and stop words."""
    words = F.split(F.lower(F.trim(F.regexp_replace(text, r"[^A-Za-z0-9_\s]", " "))), r"\s+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 3) & ~w.isin(STOP_WORDS)))


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("long")


def signature(text: Column) -> Column:
    """The first line, cut at 200 characters."""
    line = F.element_at(F.split(text, "\n"), 1)
    return F.when(F.length(line) > 200, F.concat(F.substr(line, F.lit(1), F.lit(200)), F.lit("..."))).otherwise(line)


def intent(text: Column) -> Column:
    """White space collapsed, cut at 100 characters."""
    flat = F.trim(F.regexp_replace(text, r"[ \t\n\r]+", " "))
    return F.when(F.length(flat) > 100, F.concat(F.rtrim(F.substr(flat, F.lit(1), F.lit(100))), F.lit("..."))).otherwise(flat)


def short_path(path: Column) -> Column:
    return F.substring_index(path, "/", -2)


def human_bytes(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, F.format_string("%.1f KB", n / 1024)).otherwise(F.format_string("%.1f MB", n / (1 << 20)))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))

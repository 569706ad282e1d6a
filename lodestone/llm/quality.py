"""Quality rules, line first: lines are judged alone, failing lines go, then documents that lose too much go.

All of it is expressions over one row: no shuffle, no Python.  A helper binds a value once, so that lambdas
over it do not compute it again for every element.

A line fails if symbols are too large a share of it (punctuation), if bars or arrows split it into short
pieces (navigation), if it shouts (marks after most words), or if it holds a stock phrase (boilerplate).
Lines without a word are dropped and count for nothing.

Defined results: a null, empty or wordless text has no words and fails the base rule; repeated rows each get
a verdict; a text of any length is judged whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the base rules.
SYMBOLS, SPACES = "#*$%&|<>", " \t\n\x0b\x0c\r"
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
#: Percent of a line's characters in words that may be symbols; of a line's words that may shout; of a
#: document's characters in words that may be lost.
MOST_SYMBOLS, MOST_SHOUTS, MOST_LOST = 10, 30, 50
#: Bars and arrows between the pieces of navigation.
BARS = "|»›>"
#: Words that a piece between bars or arrows has at most, on average, in navigation.
PIECE_WORDS = 3
BOILERPLATE = ("all rights reserved", "licensed under the", "privacy policy", "terms of use", "terms of service", "accept cookies", "use cookies", "sign in", "log in", "subscribe now", "click here", "read more", "enable javascript")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _solid(text: Column) -> Column:
    """Number of characters in words."""
    return F.length(_without(text, SPACES))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def repeated_words(words: Column, size: int = WINDOW) -> Column:
    """Words in windows of `size` words that occur twice or more, the first occurrence included."""

    def covered(starts: Column) -> Column:
        # Each start covers `size` words, or as many as there are before the next start.
        gaps = F.zip_with(F.slice(starts, 2, F.size(starts) - 1), F.slice(starts, 1, F.size(starts) - 1), lambda b, a: F.least(b - a, F.lit(size)))
        return F.aggregate(gaps, F.lit(0), lambda acc, x: acc + x) + size

    def starts_of(sorted_windows: Column) -> Column:
        n = F.size(sorted_windows)
        same = lambda i, j: F.get(sorted_windows, i)["h"] == F.get(sorted_windows, j)["h"]
        again = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(F.when(i > 0, same(i, i - 1)), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
        return F.sort_array(F.transform(again, lambda i: F.get(sorted_windows, i)["i"]))

    def of_hashes(h: Column) -> Column:
        windows = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        count = let(windows, lambda w: let(starts_of(w), covered))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(count)

    def of_words(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))
        return F.when(F.size(w) < size, F.lit(0)).otherwise(let(hashes, of_hashes))

    return of_words(words)


def _phrase(text: Column) -> Column:
    low = F.lower(text)
    found = F.lit(False)
    for phrase in BOILERPLATE:
        found = found | F.contains(low, F.lit(phrase))
    return found


def _hints(text: Column, n_symbols: Column) -> Column:
    """Which of a line's rules a text gives cause to try: without its marks anywhere no line fails by a rule."""
    bars = F.lit(False)
    for mark in BARS:
        bars = bars | (n_symbols > 0 if mark in SYMBOLS else F.contains(text, F.lit(mark)))
    return F.struct((n_symbols > 0).alias("symbols"), bars.alias("bars"), F.contains(text, F.lit("!!")).alias("shouts"), _phrase(text).alias("phrase"))


def line_fails(line: Column, hints: Column) -> Column:
    n_words = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))
    symbols = 100 * (F.length(line) - F.length(_without(line, SYMBOLS))) > MOST_SYMBOLS * _solid(line)
    bars = F.length(line) - F.length(_without(line, BARS))
    navigation = (bars >= 2) & (n_words - bars <= PIECE_WORDS * (bars + 1))
    shouts = 100 * F.regexp_count(line, F.lit(r"!!")) > MOST_SHOUTS * n_words
    return (hints["symbols"] & symbols) | (hints["bars"] & navigation) | (hints["shouts"] & shouts) | (hints["phrase"] & _phrase(line))


def measure(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    lost_chars, base_failed, kept, clean_text (the text without failing lines, null if not kept)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))

    def of_words(w: Column) -> Column:
        chars = F.length(F.array_join(w, ""))
        return F.struct(F.size(w).cast("long").alias("n"), chars.cast("long").alias("chars"), repeated_words(w).cast("long").alias("r"))

    def of_lines(lines: Column) -> Column:
        def judged(hints: Column) -> Column:
            return F.transform(lines, lambda x: F.struct(x.alias("line"), line_fails(x, hints).alias("fails")))

        again = F.size(lines) - F.size(F.array_distinct(lines))
        return F.struct(again.cast("long").alias("dup"), let(_hints(F.col("text"), F.col("n_symbols")), judged).alias("all"))

    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    symbols = F.length("text") - F.length(_without(F.col("text"), SYMBOLS))
    got = base.withColumn("n_symbols", symbols.cast("long"))
    got = got.select("doc_id", "n_symbols", let(words_of(F.col("text")), of_words).alias("w"), let(lines, of_lines).alias("l"))
    failing, good = F.filter("l.all", lambda x: x["fails"]), F.filter("l.all", lambda x: ~x["fails"])
    lost = F.aggregate(failing, F.lit(0), lambda acc, x: acc + _solid(x["line"]))
    got = got.select("doc_id", F.col("w.n").alias("n_words"), F.col("w.chars").alias("word_chars"), "n_symbols", F.col("l.dup").alias("n_dup_lines"), F.col("w.r").alias("n_repeat_words"), lost.cast("long").alias("lost_chars"), F.array_join(F.transform(good, lambda x: x["line"]), "\n").alias("clean_text"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    kept = ~failed & (100 * F.col("lost_chars") <= MOST_LOST * F.col("word_chars"))
    return got.withColumn("base_failed", failed).withColumn("kept", kept).withColumn("clean_text", F.when(F.col("kept"), F.col("clean_text")))


def sql() -> str:
    """DuckDB: the rows of measure(), without lost_chars and clean_text."""
    spaces = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    solid = lambda x: f"length(translate({x}, {spaces}, ''))"
    count = lambda x, p: f"len(regexp_extract_all({x}, '{p}'))"
    word, phrases = r"[^\x20\x09-\x0D]+", " OR ".join(f"contains(lower(x), '{p}')" for p in BOILERPLATE)
    symbols = lambda x: f"(length({x}) - length(translate({x}, '{SYMBOLS}', '')))"
    bars = f"(length(x) - length(translate(x, '{BARS}', '')))"
    return f"""
WITH base AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, regexp_extract_all(text, '{word}') AS w, list_filter(string_split(text, chr(10)), lambda x: {solid("x")} > 0) AS lines FROM base),
windows AS (SELECT row, i, list_aggregate(w[i:i + {WINDOW - 1}], 'string_agg', ' ') AS win FROM (SELECT row, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM split WHERE len(w) >= {WINDOW})),
again AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, win) AS n FROM windows) WHERE n > 1),
repeated AS (SELECT row, count(DISTINCT j) AS n FROM (SELECT row, unnest(range(i, i + {WINDOW})) AS j FROM again) GROUP BY row),
measured AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST({solid("text")} AS BIGINT) AS word_chars, CAST({symbols("text")} AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
    {solid("text")} - coalesce(list_sum(list_transform(list_filter(lines, lambda x: NOT (100 * {symbols("x")} > {MOST_SYMBOLS} * {solid("x")}
        OR ({bars} >= 2 AND {count("x", word)} - {bars} <= {PIECE_WORDS} * ({bars} + 1))
        OR 100 * {count("x", "!!")} > {MOST_SHOUTS} * {count("x", word)} OR {phrases})), lambda x: {solid("x")})), 0) AS lost
  FROM split LEFT JOIN repeated USING (row)),
judged AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * lost <= {MOST_LOST} * word_chars AS kept FROM judged
"""

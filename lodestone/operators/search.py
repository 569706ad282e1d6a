"""Full-text search: phrase matching and BM25 over token arrays.

Terms of a query are few, so texts are never exploded into postings: a term's frequency is counted inside the
row, and statistics and ranks come from these counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import folded_words, occurrences, tokens
from ..plans.lineage import cut

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def phrases(query: str) -> list[list[str]]:
    """Terms between white space, each a phrase of its letters and digits, folded as texts are."""
    parts = [folded_words(term) for term in query.split()]
    return [p for p in parts if p]


def counted(docs: DataFrame, terms: list[list[str]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, dl (tokens), tf0, tf1, ... of each term."""
    toks = docs.select(key, tokens(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    return toks.select(key, F.size("t").alias("dl"), *[occurrences(F.col("t"), p).alias(f"tf{i}") for i, p in enumerate(terms)])


def match(docs: DataFrame, query: str, every: bool, key: str = "doc_id") -> DataFrame:
    """Keys of the rows that hold every term, or any; none for an empty query."""
    terms = phrases(query)
    hits: Column = F.lit(bool(terms)) if every else F.lit(False)
    for i in range(len(terms)):
        hits = hits & (F.col(f"tf{i}") > 0) if every else hits | (F.col(f"tf{i}") > 0)
    return counted(docs, terms, key).where(hits).select(key)


def match_prefix(docs: DataFrame, word: str, key: str = "doc_id") -> DataFrame:
    """Keys of the rows with a token that begins as the last token of `word`, after its others; none without one."""
    first = folded_words(word)
    if not first:
        return docs.select(key).limit(0)
    toks = tokens(F.coalesce(F.col("text"), F.lit("")))
    hits = F.exists(toks, lambda t: F.startswith(t, F.lit(first[-1])))
    if len(first) > 1:
        hits = hits & (occurrences(toks, first[:-1]) > 0)
    return docs.where(hits).select(key)


def bm25(docs: DataFrame, query: str, key: str = "doc_id", every: bool = False) -> DataFrame:
    """key, rank (negative, best first) of the rows that hold any term, or every one; statistics are those of all rows.

    Texts are read and split once: what is counted of them, a few numbers a row, is kept for both the statistics and
    the ranks."""
    terms = phrases(query)
    rows = cut(counted(docs, terms, key))
    stats = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"n{i}") for i in range(len(terms))])
    total: Column = F.lit(0.0)
    hit: Column = F.lit(every)
    for i in range(len(terms)):
        tf, n = F.col(f"tf{i}"), F.col(f"n{i}")
        idf = F.ln((F.col("n") - n + 0.5) / (n + 0.5))
        idf = F.when(idf > 0, idf).otherwise(F.lit(LEAST_IDF))
        total = total + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
        hit = hit & (tf > 0) if every else hit | (tf > 0)
    # The statistics are one row, whatever the input.
    return rows.where(hit).crossJoin(F.broadcast(stats)).select(key, F.round(-total, 6).alias("rank"))


def bm25_sql(terms: list[str], key: str = "doc_id", table: str = "documents") -> str:
    """DuckDB: bm25() for terms of one token each."""
    tf = [f"len(list_filter(t, lambda x: x = '{w}'))" for w in terms]
    idf = [f"ln((n - n{i} + 0.5) / (n{i} + 0.5))" for i in range(len(terms))]
    parts = [f"CASE WHEN {idf[i]} > 0 THEN {idf[i]} ELSE {LEAST_IDF} END * tf{i} * {K1 + 1} / (tf{i} + {K1} * (1 - {B} + {B} * dl / avgdl))" for i in range(len(terms))]
    return f"""SELECT {key}, round(-({" + ".join(parts)}), 6) AS rank
FROM (SELECT {key}, len(t) AS dl, {", ".join(f"{x} AS tf{i}" for i, x in enumerate(tf))} FROM tokens_of_{table}) r,
     (SELECT count(*) AS n, avg(len(t)) AS avgdl, {", ".join(f"count(*) FILTER (WHERE {x} > 0) AS n{i}" for i, x in enumerate(tf))} FROM tokens_of_{table}) s
WHERE {" OR ".join(f"tf{i} > 0" for i in range(len(terms)))}"""

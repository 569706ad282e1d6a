"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of SIZE consecutive words of a benchmark item (a whole item if it is shorter).  All
patterns of one length m share a table of shifts, indexed by a hash of two neighbouring words: how far the
search may move on when it meets these two words at the end of its window.  A cursor moves through the
words by these shifts; where the shift is 0 the bucket of the patterns that end in these words is chosen, and
the window is compared with its strings: those of its hash are found by bisection within the bucket, and each of
them is compared byte by byte.  Many cursors, one for each stretch of words, move in step, as numpy arrays.

The benchmark is split into blocks of at most BLOCK_WORDS words, so the broadcast tables have a bounded
size; each block is one pass over the documents, and passes are united by document.  One block, the usual
case, needs no shuffle; of several, the driver holds two at most, and each pass is stored before the next.

Defined results: null, empty and wordless texts have no words and no hits; items without words never occur;
items of equal text all count; repeated rows of documents each get a result; items with a null id are not
named, but hit.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import release, store

SIZE = 10
#: Words of benchmark items that one broadcast table holds at most (one longer item makes its own table).
BLOCK_WORDS = 500_000
#: Words between neighbouring cursors.
STRETCH = 256
_SHIFT_BITS = 16


class Patterns:
    """The tables of one pattern length."""

    def __init__(self, length: int, texts: list[bytes], hashes: np.ndarray, words: np.ndarray) -> None:
        """hashes: rolling hash of each pattern; words: word hashes, one row a pattern."""
        self.length, self.width = length, min(2, length)
        ends = _key(words[:, -1], words[:, -self.width])
        order = np.lexsort((hashes, ends))
        self.texts, self.hashes = [texts[i] for i in order], hashes[order]
        # The bucket of each two-word suffix: where its patterns, ascending by hash, begin and end.
        self.begin, self.end = (np.searchsorted(ends[order], np.arange(1 << _SHIFT_BITS), side) for side in ("left", "right"))
        self.shift = np.full(1 << _SHIFT_BITS, length - self.width + 1, np.int64)
        for end in range(self.width, length + 1):
            key = _key(words[:, end - 1], words[:, end - self.width])
            np.minimum.at(self.shift, key, length - end)

    def find(self, block: W.Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, pattern) of every occurrence in a block of documents."""
        m, n = self.length, len(hashes)
        none = np.zeros(0, np.int64)
        if n < m:
            return none, none
        keys = np.empty(n, np.int64)
        keys[self.width - 1 :] = _key(hashes[self.width - 1 :], hashes[: n - self.width + 1])
        keys[: self.width - 1] = 0
        step = self.shift[keys]
        at = np.arange(m - 1, n, STRETCH)
        limit = np.minimum(at + STRETCH, n)
        zero = []
        while len(at):
            move = step[at]
            zero.append(at[move == 0])
            at = at + np.maximum(move, 1)
            live = at < limit
            at, limit = at[live], limit[live]
        ends = np.sort(np.concatenate(zero))
        first = ends - m + 1
        doc = block.doc
        first = first[doc[first] == doc[ends[: len(first)]]]
        if not len(first):
            return none, none
        window, key = W.rolling(hashes, m)[first], keys[first + m - 1]
        low, high, end = self.begin[key], self.end[key], self.end[key]
        while (open_ := low < high).any():
            middle = (low + high) // 2
            less = self.hashes[np.minimum(middle, len(self.hashes) - 1)] < window
            low, high = np.where(open_ & less, middle + 1, low), np.where(open_ & ~less, middle, high)
        found, which, live = [], [], np.arange(len(first))
        while len(live := live[low[live] < end[live]]) and len(live := live[self.hashes[low[live]] == window[live]]):
            for i in live:
                if block.text(first[i], first[i] + m) == self.texts[low[i]]:
                    found.append(first[i])
                    which.append(low[i])
            low[live] += 1
        return np.array(found, np.int64), np.array(which, np.int64)


def _key(last: np.ndarray, before: np.ndarray) -> np.ndarray:
    return (W.mix(last * np.uint64(3) ^ before) >> np.uint64(64 - _SHIFT_BITS)).astype(np.int64)


class Index:
    """The windows of a block of items, and the items that have each."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int = SIZE) -> None:
        found: dict[int, dict[bytes, tuple[int, np.ndarray, set]]] = defaultdict(dict)
        for item, text in items:
            for block in W.blocks(pa.array([text], pa.string()), W.ALNUM, lower=True):
                hashes = block.hashes()
                m = min(size, len(hashes))
                rolled = W.rolling(hashes, m) if m else []
                for i, h in enumerate(rolled):
                    _, _, named = found[m].setdefault(block.text(i, i + m), (int(h), hashes[i : i + m], set()))
                    if item is not None:
                        named.add(item)
        self.patterns, self.items = [], []
        for m, texts in sorted(found.items()):
            p = Patterns(m, list(texts), np.array([x[0] for x in texts.values()], np.uint64), np.array([x[1] for x in texts.values()], np.uint64))
            self.patterns.append(p)
            self.items.append([sorted(texts[t][2]) for t in p.texts])

    def search(self, column: pa.Array) -> Iterator[tuple[int, int, set, np.ndarray]]:
        """Of each text: its place, number of words, items and mask of hit words (no mask without hits)."""
        for block in W.blocks(column, W.ALNUM, lower=True):
            hashes = block.hashes()
            items, marks = defaultdict(set), np.zeros(len(hashes) + 1, np.int64)
            doc = block.doc
            for patterns, names in zip(self.patterns, self.items, strict=True):
                first, which = patterns.find(block, hashes)
                np.add.at(marks, first, 1)
                np.add.at(marks, first + patterns.length, -1)
                for a, p in zip(first, which, strict=True):
                    items[int(doc[a])].update(names[p])
            hit = np.cumsum(marks[:-1]) > 0
            for d, n in enumerate(block.counts):
                yield block.rows.start + d, int(n), items.get(d, set()), hit[block.first[d] : block.first[d + 1]]


def _blocks(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes of the items, read through a local iterator, a bounded number of words each."""
    held, size = [], 0
    for item, text in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).toLocalIterator():
        held.append((item, text))
        size += len(text or "") // 2 + 1
        if size >= BLOCK_WORDS:
            yield Index(held)
            held, size = [], 0
    if held:
        yield Index(held)


def _digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def annotate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_hit, items (sorted), items_sha256, contaminated."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    indexes = _blocks(benchmark.where("text is not null"))
    index, more = next(indexes, Index([])), next(indexes, None)
    if more is None:
        found, _ = _pass(docs, index, masks=False)
    else:
        passes, docs = [], docs.withColumn("row", F.xxhash64("doc_id", "text"))
        for index in chain((index, more), indexes):
            done, held = _pass(docs, index, masks=True)
            passes.append(store(done))
            held.unpersist()
        found = _united(passes)
    digest = F.sha2(F.concat_ws(",", "items"), 256)
    return found.select("doc_id", "n_words", "n_hit", "items", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _pass(docs: DataFrame, index: Index, masks: bool) -> tuple[DataFrame, Broadcast]:
    held = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(held.value.search(batch.column("text")))
            columns = [batch.column("doc_id"), pa.array([r[1] for r in rows], pa.int64()), pa.array([int(np.count_nonzero(r[3])) for r in rows], pa.int64()), pa.array([sorted(r[2]) for r in rows], pa.list_(pa.string()))]
            names = ["doc_id", "n_words", "n_hit", "items"]
            if masks:
                columns += [batch.column("row"), pa.array([np.flatnonzero(r[3]) for r in rows], pa.list_(pa.int64()))]
                names += ["row", "at"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, "doc_id long, n_words long, n_hit long, items array<string>" + ", row long, at array<long>" * masks), held


def _united(passes: list[DataFrame]) -> DataFrame:
    """Hits of several blocks of items together: rows of equal id and text have equal hits, so they are one group."""
    every = passes[0]
    for x in passes[1:]:
        every = every.unionByName(x)
    blocks = len(passes)
    word = every.groupBy("doc_id", "row").agg(F.first("n_words").alias("n_words"), (F.count("*") / blocks).cast("int").alias("times"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.size(F.array_distinct(F.flatten(F.collect_set("at")))).cast("long").alias("n_hit"))
    return word.withColumn("times", F.explode(F.sequence(F.lit(1), "times"))).drop("times", "row")


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs, all columns unchanged, in which no window of the benchmark occurs."""
    place, kept = docs.columns.index(text), None
    for index in _blocks(benchmark.where("text is not null")):
        if kept is not None:
            # A further block: what the last one kept is stored first, so that no more than two are held.
            before, docs = docs, store(kept)
            if hasattr(before, "stored_in"):
                release(before)
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not hit.any() for _, _, _, hit in held.value.search(batch.column(place))], pa.bool_()))

        kept = docs.mapInArrow(run, docs.schema)
    return docs if kept is None else kept


#: DuckDB: the rows of annotate(), without items.
SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
patterns AS (SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS win FROM (SELECT item, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
places AS (SELECT row, m, i, array_to_string(w[i:i + m - 1], ' ') AS win FROM (SELECT row, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM docs, (SELECT DISTINCT m FROM patterns) WHERE len(w) >= m)),
hits AS (SELECT row, i, m, item FROM places JOIN patterns USING (m, win)),
words AS (SELECT row, count(DISTINCT j) AS n_hit FROM (SELECT row, unnest(range(i, i + m)) AS j FROM (SELECT DISTINCT row, i, m FROM hits)) GROUP BY row),
named AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item FROM hits) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (row) LEFT JOIN named USING (row)
"""

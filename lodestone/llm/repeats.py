"""Substring deduplication with fixed-block anchors.

A window is SIZE consecutive words of one document.  Words covered by a window that also starts in a
document with a smaller doc_id are removed; windows are judged on the input.

Of every document, the non-overlapping blocks of BLOCK words are indexed and all its rolling windows of BLOCK
words are probes.  Any SIZE-word window holds a whole indexed block of each document it stands in, as SIZE >=
2 * BLOCK - 1, so a repeat cannot be missed.  A block that is indexed somewhere and occurs in two documents is
a hit.  Around hits only, SIZE-word windows are looked up, each with its smallest document; the run of
windows so confirmed is the maximal exact repeat.  Windows are grouped by content, so a passage or copy that
n documents share costs n rows, never n * n.

What is shuffled: texts once, by bucket of documents; then, from each bucket to each range of hashes, one row
of packed distinct 32-bit fingerprints (a false hit costs two in 100,000 probes some work, at any size of the
corpus, as ranges are added with the words; it can't change the result); then windows around hits.  A group
in a task is a bucket, or a range, of some 4 MB of text.  Rows without words or doc_id, which all would share a
bucket, get none, and equal rows are counted before they are grouped.

Defined results: null, empty and wordless texts have no words; documents of fewer than SIZE words keep all;
rows with a null doc_id keep all words and remove none elsewhere; rows that share a doc_id don't remove each
other's words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import shuffle_partitions

SIZE, BLOCK = 13, 7
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a bucket of documents holds about, and at least where there are few.
BUCKET_BYTES, LEAST_BYTES = 4 << 20, 512 << 10

_U = np.uint64
_MISSING = -1 << 63


def _parts(order: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, begin, end) of the runs of a sorted array."""
    if len(order):
        at = np.flatnonzero(np.concatenate([[True], order[1:] != order[:-1]]))
        yield from zip(order[at].tolist(), at.tolist(), [*at[1:].tolist(), len(order)], strict=True)


def _block(table: pa.Table) -> W.Words:
    """All words of a bucket."""
    return next(W.blocks(table.column("text"), W.SPACED, lower=False, limit=1 << 62))


def _ids(table: pa.Table) -> np.ndarray:
    return table.column("doc_id").combine_chunks().fill_null(_MISSING).to_numpy(zero_copy_only=False)


def _binary(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([x.tobytes() for x in arrays], pa.binary())


def _anchors(block: W.Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rolling BLOCK-word hashes, whether each lies in one document, whether it is an indexed block."""
    rolled = W.rolling(hashes, BLOCK)
    inner = W.inside(block, BLOCK)
    place = np.arange(len(rolled)) - block.first[:-1][block.doc[: len(rolled)]]
    return rolled, inner, inner & (place % BLOCK == 0)


def _range_and_print(rolled: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    return (rolled >> _U(32)) % _U(ranges), (rolled & _U(0xFFFFFFFF)).astype(np.uint32)


def _probes(ranges: int):
    """A bucket's distinct fingerprints for each range, with two marks: indexed, in two documents."""

    def run(table: pa.Table) -> pa.Table:
        rows = []
        known = table.filter(table.column("doc_id").is_valid())
        if known.num_rows:
            block = _block(known)
            rolled, inner, indexed = _anchors(block, block.hashes())
            key, doc = rolled[inner], _ids(known)[block.doc[: len(rolled)][inner]]
            range_of, prints = _range_and_print(key, ranges)
            joint = range_of << _U(32) | prints
            order = np.argsort(joint, kind="stable")
            joint, doc, indexed = joint[order], doc[order], indexed[inner][order]
            first = np.flatnonzero(np.concatenate([[True], joint[1:] != joint[:-1]])) if len(joint) else np.zeros(0, int)
            if len(first):
                several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
                marks = np.logical_or.reduceat(indexed, first) * 1 + several * 2
                # Of the four marks only sets are sent, so a mark takes no room.
                joint = joint[first]
                of = (joint >> _U(32)).astype(np.int64) * 4 + marks
                order = np.argsort(of, kind="stable")
                prints = (joint & _U(0xFFFFFFFF)).astype(np.uint32)[order]
                rows = [(v // 4, v % 4, prints[a:b]) for v, a, b in _parts(of[order])]
        bucket = table.column("bucket")[0].as_py()
        return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([bucket] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.int32()), _binary([r[2] for r in rows])], ["range", "bucket", "mark", "prints"])

    return run


def _hits(table: pa.Table) -> pa.Table:
    """Of one range: the fingerprints that are indexed somewhere and in two documents, for each bucket that has them."""
    buckets, marks = (table.column(c).to_numpy() for c in ("bucket", "mark"))
    blobs = [np.frombuffer(x.as_py(), np.uint32) for x in table.column("prints")]
    prints = np.concatenate(blobs)
    lengths = [len(x) for x in blobs]
    bucket, mark = np.repeat(buckets, lengths), np.repeat(marks, lengths)
    order = np.argsort(prints, kind="stable")
    prints, bucket, mark = prints[order], bucket[order], mark[order]
    first = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]]))
    union = np.bitwise_or.reduceat(mark, first)
    many = np.diff([*first, len(prints)])
    hit = np.repeat((union & 1 > 0) & ((union & 2 > 0) | (many > 1)), many)
    order = np.argsort(bucket[hit], kind="stable")
    prints, bucket = prints[hit][order], bucket[hit][order]
    rows = list(_parts(bucket))
    of = table.column("range")[0].as_py()
    return pa.table([pa.array([v for v, _, _ in rows], pa.int64()), pa.array([of] * len(rows), pa.int64()), _binary([prints[a:b] for _, a, b in rows])], ["bucket", "range", "prints"])


def _windows(block: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of every SIZE-word window, and whether it lies in one document."""
    hashes = block.hashes()
    return W.rolling(hashes, SIZE), W.rolling(hashes, SIZE, seed=0x5851F42D4C957F2D), W.inside(block, SIZE)


def _candidates(ranges: int):
    """A bucket's windows around hits, each with the smallest document of the bucket, for each range of windows."""

    def run(texts: pa.Table, hits: pa.Table) -> pa.Table:
        rows = []
        known = texts.filter(texts.column("doc_id").is_valid())
        if known.num_rows and hits.num_rows:
            block = _block(known)
            rolled, inner, _ = _anchors(block, block.hashes())
            wanted = np.sort(np.concatenate([np.frombuffer(p.as_py(), np.uint32).astype(np.uint64) | _U(r.as_py() << 32) for r, p in zip(hits.column("range"), hits.column("prints"), strict=True)]))
            range_of, prints = _range_and_print(rolled, ranges)
            joint = range_of << _U(32) | prints
            near = inner & (wanted[np.minimum(np.searchsorted(wanted, joint), len(wanted) - 1)] == joint)
            seen = np.concatenate([[0], np.cumsum(near)])
            window, other, whole = _windows(block)
            # A window of SIZE words holds the BLOCK-word windows that start in its first SIZE - BLOCK + 1 words.
            at = np.flatnonzero(whole & (seen[SIZE - BLOCK + 1 :][: len(whole)] > seen[: len(whole)])) if len(whole) else np.zeros(0, int)
            w, of, doc = window[at], (other[at] % _U(ranges)).astype(np.int64), _ids(known)[block.doc[at]]
            order = np.lexsort((doc, w, of))
            w, of, doc = w[order], of[order], doc[order]
            new = np.concatenate([[True], (w[1:] != w[:-1]) | (of[1:] != of[:-1])]) if len(w) else np.zeros(0, bool)
            w, of, doc = w[new], of[new], doc[new]
            order = np.lexsort((doc, of))
            w, of, doc = w[order], of[order], doc[order]
            for v, a, b in _parts(of):
                ids, times = np.unique(doc[a:b], return_counts=True)
                rows.append((v, w[a:b], ids, times.astype(np.uint32)))
        bucket = texts.column("bucket")[0].as_py() if texts.num_rows else hits.column("bucket")[0].as_py()
        return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([bucket] * len(rows), pa.int64()), *(_binary([r[i] for r in rows]) for i in (1, 2, 3))], ["range", "bucket", "windows", "ids", "times"])

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """Of one range of windows: for each bucket those that a smaller document outside of it has."""
    windows, docs, buckets = [], [], []
    for b, w, ids, times in zip(table.column("bucket"), table.column("windows"), table.column("ids"), table.column("times"), strict=True):
        windows.append(np.frombuffer(w.as_py(), np.uint64))
        docs.append(np.repeat(np.frombuffer(ids.as_py(), np.int64), np.frombuffer(times.as_py(), np.uint32)))
        buckets.append(np.full(len(windows[-1]), b.as_py()))
    w, doc, bucket = np.concatenate(windows), np.concatenate(docs), np.concatenate(buckets)
    order = np.argsort(w, kind="stable")
    w, doc, bucket = w[order], doc[order], bucket[order]
    first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
    least = np.repeat(np.minimum.reduceat(doc, first), np.diff([*first, len(w)]))
    later = doc > least
    order = np.argsort(bucket[later], kind="stable")
    w, bucket = w[later][order], bucket[later][order]
    rows = list(_parts(bucket))
    return pa.table([pa.array([v for v, _, _ in rows], pa.int64()), _binary([w[a:b] for _, a, b in rows])], ["bucket", "windows"])


def _removed(texts: pa.Table, repeated: pa.Table) -> tuple[W.Words, np.ndarray]:
    """A bucket's words and which of them go."""
    block, ids = _block(texts), _ids(texts)
    window, _, whole = _windows(block)
    doc = ids[block.doc[: len(window)]]
    at = np.flatnonzero(whole & (doc != _MISSING)) if len(window) else np.zeros(0, int)
    w, doc = window[at], doc[at]
    order = np.argsort(w, kind="stable")
    sorted_w, sorted_doc = w[order], doc[order]
    gone = np.zeros(len(w), bool)
    if len(w):
        first = np.flatnonzero(np.concatenate([[True], sorted_w[1:] != sorted_w[:-1]]))
        least = np.repeat(np.minimum.reduceat(sorted_doc, first), np.diff([*first, len(w)]))
        gone[order] = sorted_doc > least
        if repeated.num_rows:
            outside = np.sort(np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in repeated.column("windows")]))
            gone |= outside[np.minimum(np.searchsorted(outside, w), len(outside) - 1)] == w
    marks = np.zeros(len(block.start) + 1, np.int64)
    np.add.at(marks, at[gone], 1)
    np.add.at(marks, at[gone] + SIZE, -1)
    return block, np.cumsum(marks[:-1]) > 0


def _kept(texts: pa.Table, repeated: pa.Table) -> pa.Table:
    if not texts.num_rows:
        return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.string()), pa.array([], pa.int64())], ["doc_id", "n_words", "n_removed", "kept_text", "times"])
    block, gone = _removed(texts, repeated)
    removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[block.first])
    out = []
    for d, (a, b) in enumerate(zip(block.first[:-1], block.first[1:], strict=True)):
        if removed[d]:
            keep = np.flatnonzero(~gone[a:b]) + a
            out.append(b" ".join(block.buf[s:e].tobytes() for s, e in zip(block.start[keep], block.end[keep], strict=True)).decode())
        else:
            out.append(b" ".join(block.buf[block.offsets[d] : block.offsets[d + 1]].tobytes().split()).decode())
    return pa.table([texts.column("doc_id"), pa.array(block.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.string()), texts.column("times")], ["doc_id", "n_words", "n_removed", "kept_text", "times"])


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text.  One row for each: doc_id, n_words, n_removed, kept_text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Small inputs get smaller buckets, so that all tasks have work.
    buckets = max(1, math.ceil(size / BUCKET_BYTES), min(2 * shuffle_partitions(docs), math.ceil(size / LEAST_BYTES)))
    alone = F.col("doc_id").isNull() | ~F.col("text").rlike(WORD)
    dealt = docs.where(~alone).select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).alias("bucket"), "doc_id", "text")
    dealt = dealt.repartition("bucket").groupBy("bucket", "doc_id", "text").agg(F.count("*").alias("times"))
    probes = dealt.groupBy("bucket").applyInArrow(_probes(buckets), "range long, bucket long, mark int, prints binary")
    hits = probes.groupBy("range").applyInArrow(_hits, "bucket long, range long, prints binary")
    around = dealt.groupBy("bucket").cogroup(hits.groupBy("bucket")).applyInArrow(_candidates(buckets), "range long, bucket long, windows binary, ids binary, times binary")
    repeated = around.groupBy("range").applyInArrow(_repeated, "bucket long, windows binary")
    kept = dealt.groupBy("bucket").cogroup(repeated.groupBy("bucket")).applyInArrow(_kept, "doc_id long, n_words long, n_removed long, kept_text string, times long")
    kept = kept.select("doc_id", "n_words", "n_removed", "kept_text", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("col")
    whole = F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "))
    return kept.union(docs.where(alone).select("doc_id", F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0).cast("long"), whole))


#: DuckDB: doc_id, n_words, n_removed and the digest of the kept text.
SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT row, doc_id, i, array_to_string(w[i:i + 12], ' ') AS win FROM (SELECT row, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM docs WHERE len(w) >= 13)),
later AS (SELECT row, i FROM (SELECT row, i, doc_id, min(doc_id) OVER (PARTITION BY win) AS least FROM windows) WHERE least < doc_id),
gone AS (SELECT DISTINCT row, unnest(range(i, i + 13)) AS j FROM later),
words AS (SELECT row, doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM docs),
kept AS (SELECT row, string_agg(word, ' ' ORDER BY j) AS text FROM words ANTI JOIN gone USING (row, j) GROUP BY row),
removed AS (SELECT row, count(*) AS n FROM gone GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (row) LEFT JOIN removed USING (row)
"""

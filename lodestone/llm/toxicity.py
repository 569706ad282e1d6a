"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  Each sentence has a probability, a logistic function of the summed
weights of its hashed words and word beginnings; a document's score is the noisy-or of its sentences,
1 - prod(1 - p), to a power that maps OPERATING to 0.5.  Only document labels are known: the loss is the cross entropy of the noisy-or, whose
gradient reaches the sentences.  The same sentence probabilities then locate the offending sentences.

Training reads a bounded sample (`bound` labelled documents, the smallest by a hash of doc_id, with whole texts,
and of these what fits in SAMPLE_WORDS words) in one executor task, so that the driver holds no text.  The model is
one array of `1 << BITS` floats, whatever the input; it is all that the driver and the executors get.

Defined results: a null, empty or wordless text scores 0 with no sentences.  A document whose labels
disagree counts as toxic.  Rows with a null doc_id or label are not learned from.  Repeated rows each get
a score.  Without labels of both kinds every score is the share of toxic labels (0 without labels), except
that wordless texts keep 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import fold

#: Labelled documents that training reads at most.
SAMPLE = 8000
#: Words of these documents that training holds; a document that does not fit in what is left of them is left out.
SAMPLE_WORDS = 4_000_000
BITS = 18
#: Bytes of a word's beginnings that count as features, beside the whole word.
PREFIXES = (4, 5, 6, 7)
EPOCHS, BATCH, RATE, BIAS, CAUTION = 8, 128, 0.2, -6.0, 2.0
#: What a step takes from the size of each weight that it touches.
SHRINK = 0.004
#: The noisy-or that counts as toxic, which the score maps to 0.5: of the settings seen in four-fold trials inside
#: the learning folds of 3155 documents, the one that found 93 % of toxic ones with 0.9 % false alarms.
OPERATING = 0.3
#: Largest pull of one positive document on its sentences, against wrong labels.
PULL = 8.0
_BREAK = np.isin(np.arange(256), np.frombuffer(b".!?\n", np.uint8))


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    #: The score of every document with words where there was nothing to learn.
    constant: float | None = None


def _features(block: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids, one row a word, and each word's sentence, ascending over the block."""
    of, start, end = block.span_hashes(), block.start, block.end
    spans = [end, *(np.minimum(start + k, end) for k in PREFIXES)]
    ids = np.stack([(of(start, e) + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(64 - BITS) for k, e in enumerate(spans)], 1).astype(np.int32)
    breaks = np.cumsum(_BREAK[block.buf], dtype=np.int64)
    key = breaks[start] if len(start) else breaks[:0]
    doc = block.doc
    new = np.ones(len(start), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    return ids, np.cumsum(new) - 1


def _sentence_logits(model: Model, block: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logit of each sentence, its document, its first word."""
    ids, sentence = _features(block)
    first = np.flatnonzero(np.diff(sentence, prepend=-1))
    per_word = model.weights[ids].sum(1, dtype=np.float64)
    logits = model.bias + np.add.reduceat(per_word, first) if len(first) else np.zeros(0)
    return logits, block.doc[first], first


def _document_scores(model: Model, block: W.Words, logits: np.ndarray, doc: np.ndarray) -> np.ndarray:
    counts = block.counts
    if model.constant is not None:
        return np.where(counts > 0, model.constant, 0.0)
    log_none = -np.bincount(doc, np.logaddexp(0, logits), len(counts))
    return (-np.expm1(log_none)) ** (np.log(0.5) / np.log(OPERATING))


def scores(model: Model, column: pa.Array, sentences: bool = False) -> tuple[np.ndarray, list]:
    """Score of each text; with `sentences` also the offending sentences of each, as (start, end, score)
    in code points of the text."""
    out, found = [np.zeros(0)], []
    for block in W.blocks(column, W.LETTER, lower=True):
        logits, doc, first = _sentence_logits(model, block)
        out.append(_document_scores(model, block, logits, doc))
        if sentences:
            lists: list = [[] for _ in block.counts]
            ends = np.append(first[1:], len(block.start)) - 1
            for i in np.flatnonzero(logits >= np.log(OPERATING / (1 - OPERATING))) if model.constant is None else ():
                d = doc[i]
                base, s, e = block.offsets[d], block.start[first[i]], block.end[ends[i]]
                points = lambda a, b: int(np.count_nonzero((block.buf[a:b] & 0xC0) != 0x80))
                begin = points(base, s)
                lists[d].append({"start": begin, "end": begin + points(s, e), "score": float(np.exp(-np.logaddexp(0, -logits[i])))})
            found += lists
    return np.concatenate(out), found


def _sample(docs: DataFrame, labels: DataFrame, bound: int) -> DataFrame:
    """At most `bound` labelled documents of the learning folds, one row each."""
    known = labels.where(fold() != 0).where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("double").alias("y"))
    known = known.withColumn("h", F.xxhash64("doc_id"))
    n = known.count()
    if n > 1.2 * bound:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 20)) < int((1 << 20) * 1.2 * bound / n))
    known = known.orderBy("h", "doc_id").limit(bound).select("doc_id", "y")
    chosen = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    return chosen.groupBy("doc_id").agg(F.first("y").alias("y"), F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic (0 or 1)."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, ids, sentence, room = [], [], [], SAMPLE_WORDS
        for batch in batches:
            marks = batch.column("y").to_pylist()
            for block in W.blocks(batch.column("text"), W.LETTER, lower=True):
                x, s = _features(block)
                for k, (a, b) in enumerate(zip(block.first[:-1], block.first[1:], strict=True)):
                    if b - a <= room:
                        room -= b - a
                        y.append(marks[block.rows.start + k])
                        ids.append(x[a:b].copy())
                        sentence.append((s[a:b] - s[a:b][:1]).astype(np.int32))
        model = train(np.array(y), ids, sentence)
        yield pa.RecordBatch.from_pylist([{"weights": model.weights.tobytes(), "bias": model.bias, "constant": model.constant}], pa.schema([("weights", pa.binary()), ("bias", pa.float64()), ("constant", pa.float64())]))

    rows = _sample(docs, labels, bound).withColumn("h", F.xxhash64("doc_id"))
    rows = rows.repartition(1).sortWithinPartitions("h", "doc_id").select("y", "text")
    got = rows.mapInArrow(learn, "weights binary, bias double, constant double").first()
    if got is None:
        return Model(np.zeros(1 << BITS, np.float32), BIAS, 0.0)
    return Model(np.frombuffer(got.weights, np.float32), got.bias, got.constant)


def _start(y: np.ndarray, ids: list[np.ndarray], size: int) -> np.ndarray:
    """First weights: the log odds of a feature's documents being toxic, less CAUTION standard errors, where positive."""
    seen = np.zeros((2, size))
    for x, t in zip(ids, y, strict=True):
        seen[int(t > 0), np.unique(x)] += 1
    toxic = np.count_nonzero(y > 0)
    odds = np.log((seen[1] + 0.5) / (toxic + 1)) - np.log((seen[0] + 0.5) / (len(y) - toxic + 1))
    error = np.sqrt(1 / (seen[1] + 0.5) + 1 / (seen[0] + 0.5))
    return np.where(seen.sum(0) >= 2, 1.5 * np.maximum(0, odds - CAUTION * error), 0)


def train(y: np.ndarray, ids: list[np.ndarray], sentence: list[np.ndarray]) -> Model:
    """Stochastic gradient descent (Adagrad, with an L1 penalty) on the noisy-or loss, in an order fixed by a seed."""
    size = 1 << BITS
    full = np.array([i for i, x in enumerate(ids) if len(x)], int)
    if not len(full) or y[full].min() == y[full].max():
        return Model(np.zeros(size, np.float32), BIAS, float(y.mean()) if len(y) else 0.0)
    weights, squares, bias, bias_squares = _start(y, ids, size), np.ones(size), BIAS, 1.0
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        order.shuffle(full)
        for part in np.array_split(full, max(1, len(full) // BATCH)):
            x = np.concatenate([ids[i] for i in part])
            counts = np.array([sentence[i][-1] + 1 for i in part])
            base = np.repeat(np.cumsum(counts) - counts, [len(ids[i]) for i in part])
            s = np.concatenate([sentence[i] for i in part]) + base
            z = bias + np.bincount(s, weights[x].sum(1))
            doc = np.repeat(np.arange(len(part)), counts)
            none = np.bincount(doc, np.logaddexp(0, z))
            some = np.maximum(-np.expm1(-none), 1e-9)
            pull = np.where(y[part] > 0, -np.minimum(np.exp(-none) / some, PULL), 1.0)
            slope = pull[doc] * np.exp(-np.logaddexp(0, -z))
            g = np.bincount(x.ravel(), np.repeat(slope[s], x.shape[1]), size)
            hit = np.flatnonzero(g)
            squares[hit] += g[hit] ** 2
            moved = weights[hit] - RATE * g[hit] / np.sqrt(squares[hit])
            weights[hit] = np.sign(moved) * np.maximum(np.abs(moved) - SHRINK, 0)
            bias_squares += slope.sum() ** 2
            bias -= RATE * slope.sum() / bias_squares**0.5
    return Model(weights.astype(np.float32), float(bias))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each row of docs: doc_id, score, predicted, sentences (those at OPERATING or more)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            got, found = scores(held.value, batch.column("text"), sentences=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got), pa.array((got >= 0.5).astype(np.int32)), pa.array(found, kind)], ["doc_id", "score", "predicted", "sentences"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int, sentences array<struct<start: long, end: long, score: double>>")


def keep_clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs, all columns unchanged, whose text scores below 0.5."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got, _ = scores(held.value, batch.column(place))
            yield batch.filter(pa.array(got < 0.5))

    return docs.mapInArrow(run, docs.schema)

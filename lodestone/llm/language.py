"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's vector is the mean of the embeddings of its hashed subwords (whole words and runs of two, three
and four bytes inside lower-cased words); a linear softmax gives language probabilities.  Embeddings and
softmax are trained together by stochastic gradient descent in numpy on a bounded sample of documents, the same
number of each language (the smallest by a hash of doc_id), each as its whole text and as a few of its words, so
that short texts are learned too.  A tenth of the sample's documents is held back, with their pieces, to calibrate:
a temperature that makes the scores honest probabilities, and the score below which a prediction is marked as
rejected.  Languages learn with equal weight, and how frequent each is in the corpus then enters as its prior.  One
executor task trains, so that the driver holds no text.

As averaging and the softmax's matrix are linear, the executors get their product, one row of logits a
bucket: its size does not depend on the input.

Defined results: a null text, or one without a letter, is `und` with score 0 and rejected; so is every text
where nothing could be learned.  Rows with a null lang or doc_id are not learned from.  Repeated rows each
get a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .common import fold

#: Documents that training reads at most, in equal parts of the languages; languages that are learned at most, the
#: most frequent ones; subwords of all these documents together (one that does not fit in what is left is left out).
SAMPLE, LANGUAGES, SUBWORDS = 3000, 200, 16_000_000
BITS, WIDTH, GRAMS = 16, 16, (2, 3, 4)
EPOCHS, BATCH, RATE = 6, 32, 1.0
#: Steps that training takes at least, and the most that a document of a rare language counts beside one of the average.
STEPS, MOST_WEIGHT = 600, 10.0
#: Words of the short pieces that are learned beside whole texts.
PIECE = 6
#: Share of wrong predictions that are accepted on the calibration part.
ERRORS = 0.01
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float


def _subwords(block: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each subword and its document, ascending by document."""
    of, start, end = block.span_hashes(), block.start, block.end
    doc = block.doc
    ids, docs = [of(start, end)], [doc]
    for n in GRAMS:
        many = np.maximum(end - start - n + 1, 0)
        total = int(many.sum())
        at = np.repeat(start - (np.cumsum(many) - many), many) + np.arange(total)
        ids.append(of(at, at + n) ^ np.uint64(n))
        docs.append(np.repeat(doc, many))
    ids, docs = np.concatenate(ids), np.concatenate(docs)
    order = np.argsort(docs, kind="stable")
    return (ids[order] >> np.uint64(64 - BITS)).astype(np.int32), docs[order]


def _piece(block: W.Words, d: int) -> bytes:
    a, b = block.first[d], block.first[d + 1]
    i = a + (b - a) // 3
    return block.text(i, min(b, i + PIECE))


def _bags(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each text with letters: its place, its buckets and how often it has each."""
    for block in W.blocks(column, W.LETTER, lower=True):
        ids, docs = _subwords(block)
        edges = np.searchsorted(docs, np.arange(len(block.counts) + 1))
        for d, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if b > a:
                yield block.rows.start + d, *np.unique(ids[a:b], return_counts=True)


def _pieces(column: pa.Array) -> pa.Array:
    out = []
    for block in W.blocks(column, W.LETTER, lower=True):
        out += [_piece(block, d).decode("utf-8", "replace") for d in range(len(block.counts))]
    return pa.array(out, pa.string())


def _sample(docs: DataFrame, bound: int) -> DataFrame:
    """lang, h, doc_id, text: of each language as many documents, `bound` together."""
    known = docs.select("doc_id", "text", "lang").where(fold(parts=4) != 2).where("lang is not null and text is not null")
    counts = known.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(LANGUAGES).persist()
    each = max(1, bound // max(1, counts.count()))
    # Thinned by a hash to little more than is needed, before anything is put in order.
    share = F.lit(float(1 << 24)) * (1.5 * each + 20) / F.col("count")
    known = known.join(F.broadcast(counts), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 24)) < share)
    known = known.groupBy("lang", F.xxhash64("doc_id").alias("h"), "doc_id").agg(F.min("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    return known.withColumn("place", place).where(F.col("place") <= each).drop("place").join(F.broadcast(counts), "lang")


def fit(docs: DataFrame, bound: int = SAMPLE) -> Model:
    """docs: doc_id, text, lang."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, ids, times, of, room, n, often = [], [], [], [], SUBWORDS, 0, {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            often |= dict(zip(langs, batch.column("count").to_pylist(), strict=True))
            for column in (batch.column("text"), _pieces(batch.column("text"))):
                for i, x, t in _bags(column):
                    if len(x) <= room:
                        room -= len(x)
                        labels.append(langs[i])
                        ids.append(x)
                        times.append(t.astype(np.float32))
                        of.append(n + i)
            n += len(langs)
        model = train(labels, ids, times, np.array(of, int), often)
        kind = pa.schema([("languages", pa.list_(pa.string())), ("table", pa.binary()), ("bias", pa.binary()), ("temperature", pa.float64()), ("least", pa.float64())])
        yield pa.RecordBatch.from_pylist([{"languages": model.languages, "table": model.table.tobytes(), "bias": model.bias.tobytes(), "temperature": model.temperature, "least": model.least}], kind)

    rows = _sample(docs, bound).repartition(1).sortWithinPartitions("h", "doc_id", "lang").select("lang", "text", "count")
    got = rows.mapInArrow(learn, "languages array<string>, table binary, bias binary, temperature double, least double").first()
    if got is None:
        return train([], [], [], np.zeros(0, int))
    return Model(got.languages, np.frombuffer(got.table, np.float32).reshape(1 << BITS, -1) if got.languages else np.zeros((1 << BITS, 0), np.float32), np.frombuffer(got.bias, np.float32), got.temperature, got.least)


def train(labels: list[str], ids: list[np.ndarray], times: list[np.ndarray], of: np.ndarray, often: dict[str, int] | None = None) -> Model:
    """of: the document of each bag; those of every tenth document are not learned but calibrate.  often: how many
    documents of each language there are."""
    languages = sorted(set(labels))
    random = np.random.default_rng(11)
    k = len(languages)
    e = random.uniform(-1, 1, (1 << BITS, WIDTH)).astype(np.float32) / WIDTH
    w, b = np.zeros((WIDTH, k), np.float32), np.zeros(k, np.float32)
    y = np.array([languages.index(x) for x in labels], int)
    shares = [t / t.sum() for t in times]
    held = of % 10 == 0 if len(set(of)) >= 50 else np.zeros(len(y), bool)
    learn = np.flatnonzero(~held)
    many = np.bincount(y[learn], minlength=k)
    counts = np.minimum(many.sum() / (max(1, k) * np.maximum(many, 1)), MOST_WEIGHT).astype(np.float32)
    epochs = max(EPOCHS, -(-STEPS * BATCH // max(1, len(learn)))) if k else 0
    for epoch in range(epochs):
        random.shuffle(learn)
        rate = RATE * (1 - epoch / epochs)
        for part in np.array_split(learn, max(1, len(learn) // BATCH)):
            x, v = np.concatenate([ids[i] for i in part]), np.concatenate([shares[i] for i in part]).astype(np.float32)
            first = np.cumsum([0, *(len(ids[i]) for i in part[:-1])])
            h = np.add.reduceat(e[x] * v[:, None], first)
            p = _softmax(h @ w + b)
            p[np.arange(len(part)), y[part]] -= 1
            p *= counts[y[part]][:, None]
            back = p @ w.T
            w -= rate / len(part) * (h.T @ p)
            b -= rate / len(part) * p.sum(0)
            np.subtract.at(e, x, rate * 4 * v[:, None] * np.repeat(back, np.diff([*first, len(x)]), 0))
    table = e @ w
    logits = np.array([shares[i] @ table[ids[i]] + b for i in np.flatnonzero(held)]).reshape(np.count_nonzero(held), k)
    prior = np.array([(often or {}).get(x, 1) for x in languages], float)
    prior = np.log(prior / prior.mean()) if k else prior
    temperature, least = _calibrate(logits, y[held], prior)
    return Model(languages, table.astype(np.float32), (b + temperature * prior).astype(np.float32), temperature, least)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def _calibrate(logits: np.ndarray, y: np.ndarray, prior: np.ndarray) -> tuple[float, float]:
    """The temperature of least cross entropy, and the least score that keeps errors among accepted ones at ERRORS.

    The rows have languages in equal parts; for the second they count as their languages do in the corpus."""
    if not len(y) or not logits.shape[1]:
        return 1.0, 0.5
    entropy = lambda t: -np.log(_softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean()
    temperature = float(min(np.geomspace(0.1, 10, 41), key=entropy))
    p = _softmax(logits / temperature + prior)
    order = np.argsort(-p.max(1), kind="stable")
    counts = np.exp(prior[y])[order]
    wrong = np.cumsum(counts * (p.argmax(1)[order] != y[order])) / np.cumsum(counts)
    fine = np.flatnonzero(wrong <= ERRORS)
    return temperature, float(p.max(1)[order][fine[-1]]) if len(fine) else 1.0


def _predictions(model: Model, column: pa.Array) -> tuple[list[str], np.ndarray]:
    names, scores = np.full(len(column), UNKNOWN, object), np.zeros(len(column))
    if not model.languages:
        return list(names), scores
    for block in W.blocks(column, W.LETTER, lower=True):
        ids, docs = _subwords(block)
        first = np.flatnonzero(np.diff(docs, prepend=-1))
        if not len(first):
            continue
        sums = np.stack([np.add.reduceat(model.table[:, j][ids].astype(np.float64), first) for j in range(len(model.languages))], 1)
        p = _softmax((sums / np.diff([*first, len(docs)])[:, None] + model.bias) / model.temperature)
        at = block.rows.start + docs[first]
        names[at] = np.array(model.languages, object)[p.argmax(1)]
        scores[at] = p.max(1)
    for i, text in enumerate(column):
        if names[i] != UNKNOWN and not any(map(str.isalpha, text.as_py())):
            names[i], scores[i] = UNKNOWN, 0.0
    return list(names), scores


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each row of docs: doc_id, lang_pred, score (a calibrated probability), rejected."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = _predictions(held.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores), pa.array(scores < held.value.least)], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")

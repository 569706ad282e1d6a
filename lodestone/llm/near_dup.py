"""Near duplicates by a chosen-path set similarity join.

A document's set is its distinct shingles of `size` words (64-bit hashes).  Documents of equal sets are one
class, found by grouping, and only a class's smallest doc_id, its representative, goes on.

Each of TREES independent trees sends a set to the child of its minwise token, two levels deep; all trees are
made at once.  There each node's pivot, its smallest member, is first compared with all others and leaves, which
joins most of a group of copies; only then, and only between members that are not yet in one component, a node of
at most LEAF members is compared exhaustively.  In a larger one, where the members outside of its largest component
are few, they are compared with all its members, in blocks to which each set is shipped once.  Where they are not
few, further pivots are compared, up to round PIVOTS; what is then still outside is dealt into parts, and each part
is compared with each block.  Nodes never branch further, as a pair that shares no child would be lost: whatever
meets in a node is compared, however large the node.  Members of one component are not compared, so a group of n
near copies costs about n comparisons; n sets that meet in a node without being copies cost the square of n
comparisons of sketches.

A pair at the threshold meets in one tree with probability 0.64, in any of 16 trees with 1 - 1e-7.  Pairs whose
sizes, or whose sketches of 64 coordinates (five standard deviations), exclude the threshold are skipped; all others
are confirmed on the full sets.  What is shipped for that is the text, a third of its set's bytes, and only for what
such pairs hold.  Components come from label propagation with pointer jumping over the confirmed links.

Defined results: null, empty and wordless texts have an empty set, are linked with nothing and are their own
component; a text of fewer than `size` words has one shingle, all its words; rows with a null doc_id get a
null component and are kept; rows that share a doc_id are compared like others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .common import release, store

TREES, COORDINATES, LEAF = 16, 64, 24
#: The last round in which a large node's pivot is compared, before all that is left in the node is.  On check_h
#: pivots of rounds 2 and 3 left 3686 of 3688 members outside.
PIVOTS = 1
#: Bytes of the minwise values that the trees read: two of 4 bytes a tree.
MINS = 8
#: Coordinates of 64 that may differ: at a similarity of 0.8 the mean is 12 and the deviation 3.1.
MOST_DIFFERENT = 28
#: Members of a node that one copy of its pivot's set serves.
SERVED = 256
#: Members outside a node's largest component, and shingles in their sets, that are compared with a block at once.
FEW, FEW_SHINGLES = 512, 1 << 22
#: Shingles in the sets of a block of a node's members.
BLOCK_SHINGLES = 1 << 20
#: Bytes of text that are turned into shingles at once.
TEXT_BYTES = 1 << 19
#: Representatives whose texts are picked by a broadcast table of ids; more are joined by a shuffle.
BROADCAST = 200_000

_U = np.uint64
_SEEDS = W.mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_ODD = W.mix(_SEEDS) | _U(1)


def _shingles(block: W.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of the block's documents, ascending by document and hash, and where each document begins."""
    words, counts = block.hashes(), block.counts
    rolled, doc = W.rolling(words, size), block.doc
    whole = W.inside(block, size)
    h, d = rolled[whole], doc[: len(rolled)][whole]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        ones = [W.rolling(words[block.first[i] : block.first[i] + counts[i]], int(counts[i])) for i in short]
        h, d = np.concatenate([h, *ones]), np.concatenate([d, short])
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[new], d[new]
    return h, np.searchsorted(d, np.arange(len(counts) + 1))


def _sums(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each document's set."""
    out = []
    for seed in (_U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB)):
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(W.mix(h ^ seed), out=total[1:])
        out.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
    return out[0], out[1]


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n (set size), lo and hi (of the set), mins (the trees' minwise values, 4 bytes each), s0 to s3 (4 bits of all)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in W.blocks(batch.column("text"), W.SPACED, lower=True, limit=TEXT_BYTES):
                h, first = _shingles(block, size)
                n = np.diff(first)
                lo, hi = _sums(h, first)
                mins = np.zeros((len(n), COORDINATES), np.uint32)
                full = n > 0
                if full.any():
                    for k in range(COORDINATES):
                        mins[full, k] = np.minimum.reduceat(((h ^ _SEEDS[k]) * _ODD[k]) >> _U(32), first[:-1][full])
                bits = (W.mix(mins.astype(np.uint64)) & _U(15)).reshape(len(n), 4, 16) << (_U(4) * np.arange(16, dtype=np.uint64))
                packed = np.bitwise_or.reduce(bits, 2).view(np.int64)
                ids = batch.column("doc_id").slice(block.rows.start, len(n))
                yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(lo), pa.array(hi), pa.array([m.tobytes() for m in mins[:, : MINS * TREES // 4]], pa.binary()), *(pa.array(packed[:, j]) for j in range(4))], ["doc_id", "n", "lo", "hi", "mins", "s0", "s1", "s2", "s3"])

    return docs.mapInArrow(run, "doc_id long, n long, lo long, hi long, mins binary, s0 long, s1 long, s2 long, s3 long")


def texts_of(docs: DataFrame, size: int) -> DataFrame:
    """docs: doc_id, text, lo, hi.  rep and text of the rows whose set lo and hi are of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = [batch.column(c).to_numpy() for c in ("lo", "hi")]
            for block in W.blocks(batch.column("text"), W.SPACED, lower=True, limit=TEXT_BYTES):
                lo, hi = _sums(*_shingles(block, size))
                same = pa.array(np.flatnonzero((lo == wanted[0][block.rows]) & (hi == wanted[1][block.rows])) + block.rows.start)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(same), batch.column("text").take(same)], ["rep", "text"])

    return docs.select("doc_id", "text", "lo", "hi").mapInArrow(run, "rep long, text string")


def _first_nodes(reps: DataFrame) -> DataFrame:
    """Members of the nodes two levels down every tree."""
    keys = F.array(*[F.xxhash64(F.lit(t), F.substr("mins", F.lit(MINS * t + 1), F.lit(MINS))) for t in range(TREES)])
    return reps.select(F.explode(keys).alias("key"), "rep", "n")


def _alike(a: str, b: str, percent: int) -> Column:
    """Whether sizes and sketches leave the threshold possible."""
    sizes = 100 * F.least(f"{a}.n", f"{b}.n") >= percent * F.greatest(f"{a}.n", f"{b}.n")

    def differ(i: int) -> Column:
        x = F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))

    return sizes & (differ(0) + differ(1) + differ(2) + differ(3) <= MOST_DIFFERENT)


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """pairs: a, b, salt.  Those whose full sets reach the threshold.  A hot a is spread by salt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = None, None
        for batch in batches:
            a = batch.column("a").to_pylist()
            keep = np.zeros(len(a), bool)
            for block in W.blocks(batch.column("y"), W.SPACED, lower=True, limit=TEXT_BYTES):
                h, first = _shingles(block, size)
                for k, i in enumerate(range(block.rows.start, block.rows.stop)):
                    if a[i] != last:
                        last, x = a[i], _shingles(next(W.blocks(batch.column("x").slice(i, 1), W.SPACED, lower=True)), size)[0]
                    both = np.concatenate([x, h[first[k] : first[k + 1]]])
                    both.sort()
                    common = int(np.count_nonzero(both[1:] == both[:-1]))
                    keep[i] = 100 * common >= percent * (len(both) - common)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    right = pairs.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("y")), "b")
    left = pairs.select("a", "salt").distinct().join(texts.select(F.col("rep").alias("a"), F.col("text").alias("x")), "a")
    return right.join(left, ["a", "salt"]).select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """rep, comp: the smallest member that each end of an edge reaches."""
    both = store(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = store(both.groupBy(F.col("a").alias("rep")).agg(F.least(F.min("b"), F.first("a")).alias("comp"), F.lit(True).alias("moved")))
    while labels.where("moved").head(1):
        near = both.join(labels.withColumnRenamed("rep", "b"), "b").groupBy(F.col("a").alias("rep")).agg(F.min("comp").alias("low"))
        lower = labels.join(near, "rep").select("rep", "comp", F.least("comp", "low").alias("low"))
        jump = labels.select(F.col("rep").alias("low"), F.col("comp").alias("far"))
        before, least = labels, F.least("low", "far")
        labels = store(lower.join(jump, "low").select("rep", least.alias("comp"), (least < F.col("comp")).alias("moved")))
        release(before)
    release(both)
    return labels


def link(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs: doc_id, text.  One row for each: doc_id, n_shingles, component_id, kept."""
    return _link(docs, size, percent)[0]


def _link(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """link() and the stored frames that its result reads."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = store(signatures(docs, size))
    member = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    reps = rows.where(member).groupBy("lo", "hi").agg(F.min(F.struct("doc_id", "n", "s0", "s1", "s2", "s3", "mins")).alias("r"))
    reps = store(reps.select("lo", "hi", F.col("r.doc_id").alias("rep"), *[F.col(f"r.{c}").alias(c) for c in ("n", "s0", "s1", "s2", "s3", "mins")]))
    comp = _linked(docs, reps, size, percent)
    classes = reps.select("lo", "hi", "rep")
    if comp is not None:
        classes = classes.join(comp.select("rep", "comp"), "rep", "left").select("lo", "hi", F.coalesce("comp", "rep").alias("rep"))
    # Rows without a set, which are as one key, stay out of the join.
    found = rows.where(member).select("doc_id", "n", "lo", "hi").join(classes, ["lo", "hi"]).select("doc_id", "n", "rep")
    found = found.union(rows.where(~member).select("doc_id", "n", F.col("doc_id").alias("rep")))
    found = found.select("doc_id", F.col("n").alias("n_shingles"), F.col("rep").alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), [rows, reps, *([] if comp is None else [comp])]


def _open(members: DataFrame, reps: DataFrame, comp: DataFrame | None) -> DataFrame:
    """Members (key, rep, n) of the nodes that still have something to compare, with their sketch and component c.

    Of the node: size and volume (shingles), main (its largest component), few and few_volume (what lies outside
    of main) and pivot.  Nodes are stored before members are joined with them, so that a large node's members can be
    split over tasks."""
    sizes = [F.count("*").alias("size"), F.sum("n").alias("volume"), F.min("rep").alias("pivot")]
    if comp is None:
        members = members.withColumn("c", F.col("rep"))
        nodes = members.groupBy("key").agg(*sizes).where("size > 1")
        nodes = nodes.select("*", F.col("pivot").alias("main"), (F.col("size") - 1).alias("few"), F.col("volume").alias("few_volume"))
    else:
        members = members.join(comp.select("rep", "comp"), "rep", "left").withColumn("c", F.coalesce("comp", "rep")).drop("comp")
        parts = members.groupBy("key", "c").agg(*sizes)
        most = F.max(F.struct("size", "volume", "c")).alias("most")
        nodes = parts.groupBy("key").agg(F.sum("size").alias("size"), F.sum("volume").alias("volume"), F.min("pivot").alias("pivot"), most)
        nodes = nodes.where("size > most.size").select("key", "size", "volume", "pivot", F.col("most.c").alias("main"), (F.col("size") - F.col("most.size")).alias("few"), (F.col("volume") - F.col("most.volume")).alias("few_volume"))
    nodes = store(nodes)
    held = store(members.join(nodes, "key").join(reps.select("rep", "s0", "s1", "s2", "s3"), "rep"))
    release(nodes)
    return held


def _merged(comp: DataFrame | None, links: DataFrame) -> DataFrame:
    """rep, comp after new links, which are followed between components only."""
    if comp is None:
        return components(links)
    of = lambda end: comp.select(F.col("rep").alias(end), F.col("comp").alias(f"c{end}"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    moves = components(between.where("a <> b").distinct())
    every = comp.select("rep", "comp").union(moves.select("rep", F.col("rep").alias("comp"))).groupBy("rep").agg(F.min("comp").alias("old"))
    after = store(every.join(moves.select(F.col("rep").alias("old"), F.col("comp").alias("new")), "old", "left").select("rep", F.coalesce("new", "old").alias("comp")))
    release(comp, moves)
    return after


def _exhaustive(small: DataFrame, percent: int) -> DataFrame:
    a, b = small.alias("a"), small.alias("b")
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.rep") < F.col("b.rep")) & (F.col("a.c") != F.col("b.c")) & _alike("a", "b", percent))
    return pairs.select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"), F.lit(0).cast("long").alias("salt"))


def _stars(large: DataFrame, percent: int) -> DataFrame:
    copies = F.ceil(F.col("size") / SERVED).cast("long")
    a = large.where(F.col("rep") == F.col("pivot")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1))).alias("a")
    b = large.withColumn("salt", F.pmod(F.xxhash64("rep"), copies)).alias("b")
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.salt") == F.col("b.salt")) & (F.col("a.c") != F.col("b.c")) & _alike("a", "b", percent))
    return pairs.select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"), F.col("b.salt").alias("salt"))


def _blocks(held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members of nodes dealt into blocks, and those outside the node's largest component into parts: each block meets each part."""
    copies = F.ceil(F.greatest(F.col("size") / SERVED, F.col("volume") / BLOCK_SHINGLES)).cast("long")
    parts = F.ceil(F.greatest(F.col("few") / FEW, F.col("few_volume") / FEW_SHINGLES)).cast("long")
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    every = held.withColumn("block", F.pmod(F.xxhash64("rep"), copies)).withColumn("part", all_of(parts))
    few = held.where("c <> main").withColumn("part", F.pmod(F.xxhash64("rep", F.lit(1)), parts)).withColumn("block", all_of(copies))
    return every, few


def _comparable(every: DataFrame, few: DataFrame, percent: int) -> DataFrame:
    """Of each block and part the members, and those outside, that sizes and sketches leave something to compare with."""

    def alone(left: DataFrame, right: DataFrame, outside: bool) -> DataFrame:
        x, y = left.alias("x"), right.alias("y")
        met = (F.col("x.key") == F.col("y.key")) & (F.col("x.block") == F.col("y.block")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.c") != F.col("y.c")) & _alike("x", "y", percent)
        return x.join(y, met, "left_semi").select("key", "block", "part", F.lit(outside).alias("outside"), "rep", "c", "n", "s0", "s1", "s2", "s3")

    return alone(every, few, False).union(alone(few, every, True))


def _block_links(rows: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """a, b: of each block and part links that join its components wherever a pair of sets reaches the threshold."""
    ones = _U(0x1111111111111111)

    def run(block: pa.Table) -> pa.Table:
        outside = block.column("outside").to_numpy()
        rep, c, n = (block.column(k).to_numpy() for k in ("rep", "c", "n"))
        sketch = np.stack([block.column(f"s{k}").to_numpy() for k in range(4)], 1).view(np.uint64)
        held = []
        for words in W.blocks(block.column("text"), W.SPACED, lower=True, limit=TEXT_BYTES):
            h, first = _shingles(words, size)
            held += [h[i:j] for i, j in zip(first[:-1], first[1:], strict=True)]
        inner = np.flatnonzero(~outside)
        group = c.copy()
        found: list[tuple[int, int]] = []
        for i in np.flatnonzero(outside):
            x = sketch[inner] ^ sketch[i]
            x |= x >> _U(1)
            x |= x >> _U(2)
            differ = np.bitwise_count(x & ones).sum(1)
            like = (differ <= MOST_DIFFERENT) & (100 * np.minimum(n[inner], n[i]) >= percent * np.maximum(n[inner], n[i]))
            left, step = inner[like], 8
            while True:
                left = left[group[left] != group[i]]
                if not len(left):
                    break
                now, left = left[:step], left[step:]
                step *= 4
                values = np.concatenate([held[j] for j in now])
                at = np.searchsorted(held[i], values)
                at[at == len(held[i])] = 0
                common = np.add.reduceat((held[i][at] == values).astype(np.int64), np.cumsum(n[now]) - n[now])
                for j in now[100 * common >= percent * (n[now] + n[i] - common)]:
                    if group[j] != group[i]:
                        group[group == group[j]] = group[i]
                        found.append((int(rep[i]), int(rep[j])))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return rows.join(texts, "rep").groupBy("key", "block", "part").applyInArrow(run, "a long, b long")


def _texts(docs: DataFrame, reps: DataFrame, ends: DataFrame, size: int) -> DataFrame:
    """rep, text of the representatives in ends, once each."""
    wanted = store(ends.distinct().join(reps.select("rep", "lo", "hi"), "rep").withColumnRenamed("rep", "doc_id"))
    few = wanted.count() <= BROADCAST
    found = texts_of(docs.join(F.broadcast(wanted) if few else wanted, "doc_id"), size)
    texts = store(found.groupBy("rep").agg(F.first("text").alias("text")))
    release(wanted)
    return texts


def _linked(docs: DataFrame, reps: DataFrame, size: int, percent: int) -> DataFrame | None:
    """rep, comp of the representatives that have a link; None without any."""
    comp, level, before = None, 0, None
    members = _first_nodes(reps)
    while True:
        held = _open(members, reps, comp)
        if before is not None:
            release(before)
        if level == 0:
            stars, rest, ready = held, held.where("size > 2"), None
        else:
            small = F.col("size") <= LEAF
            done = (F.col("few") <= FEW) & (F.col("few_volume") <= FEW_SHINGLES) | F.lit(level > PIVOTS)
            stars = rest = held.where(~small & ~done)
            ready = held.where(~small & done)
        rows, more = held.agg(F.count("*"), F.max(F.col("size") > 2) if level == 0 else F.max(~small & ~done)).first()
        if not rows:
            release(held)
            return comp
        pairs = _stars(stars, percent)
        if level:
            pairs = pairs.union(_exhaustive(held.where(small), percent))
        pairs = store(pairs.groupBy("a", "b").agg(F.min("salt").alias("salt")))
        blocks = store(_comparable(*_blocks(ready), percent)) if level else None
        ends = pairs.select(F.explode(F.array("a", "b")).alias("rep"))
        texts = _texts(docs, reps, ends if blocks is None else ends.union(blocks.select("rep")), size)
        links = _confirmed(pairs, texts, size, percent)
        if blocks is not None:
            links = links.union(_block_links(blocks, texts, size, percent))
        links = store(links)
        if links.head(1):
            comp = _merged(comp, links)
        release(*[x for x in (pairs, blocks, texts, links) if x is not None])
        if not more:
            release(held)
            return comp
        members = rest.where(F.col("rep") != F.col("pivot")).select("key", "rep", "n")
        before, level = held, level + 1


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns unchanged, without those whose component has a smaller doc_id.

    Of rows that share a doc_id one stays, that of the smallest text, source and lang, and among equal ones any one;
    rows with a null doc_id stay."""
    found, read = _link(docs, size, percent)
    found = store(found.where("doc_id is not null").select("doc_id", "kept"))
    release(*read)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    left = docs.join(gone, F.col("doc_id").cast("long") == F.col("_gone"), "left_anti")
    again = found.groupBy(F.col("doc_id").alias("_again")).count().where("count > 1").select("_again")
    if not again.head(1):
        return left
    repeated = F.col("doc_id").cast("long") == F.col("_again")
    order = Window.partitionBy("doc_id").orderBy("text", *[c for c in ("source", "lang") if c in docs.columns])
    one = left.join(again, repeated, "left_semi").withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")
    return left.join(again, repeated, "left_anti").unionByName(one)

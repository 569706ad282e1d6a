"""Mixing sources to target weights by weighted fair queueing.

Every document stands twice in the queue of its source, in a shuffled order (md5 of doc_id) that is the same
in both rounds.  Its virtual finish time is its source's words up to and including it, divided by the
source's target.  All queues are served together in the order of virtual finish times, and the mix is cut
where the budget, the sum of targets, is reached.

No task holds a source or the whole order: running sums are those of (source, range of the shuffle) plus a
prefix over the ranges, and the cut is found among as many ranges of finish times as there are rows for;
only the range that holds the cut is put in order.  Ties go by source, md5, doc_id and round.

Defined results: null, empty and wordless texts have size 0 and take nothing; null sources are one source,
the last; rows with a null doc_id are shuffled by their size; repeated rows are documents of their own; a source
without words has target 0; without any words every target is 0.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, store

#: Weights of the sources, by code point, repeating.
WEIGHTS = (5, 2, 1)
#: Words of the mix as a share of all words, as a fraction.
SHARE = (3, 2)
#: How often a document can be taken at most.
ROUNDS = 2
#: Columns that tell rows apart.
KEY = ("_mix_file", "_mix_row")
#: Sources whose targets are broadcast at most; more are joined by a shuffle.
SOURCES = 10_000
#: Rows that one range of the shuffle, or of finish times, holds about; ranges of finish times there are at most.
RANGE_ROWS, RANGES = 2000, 1 << 16


def sized(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, source, columns to keep, size in words `[^\\x20\\x09-\\x0D]+`; source as text."""
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), *keep, size.alias("size"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, rounds: int = ROUNDS) -> DataFrame:
    """One row for each source: source, place, source_size, target.  Sources fill by weight up to `rounds` times their size."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("place", place).withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long"))
    all_rows = Window.partitionBy()
    before = Window.orderBy(F.col("most") / F.col("w"), "place").rowsBetween(Window.unboundedPreceding, -1)
    up, down = share
    per = per.withColumn("most", F.col("source_size") * rounds).withColumn("words", F.sum("source_size").over(all_rows)).withColumn("ws", F.sum("w").over(all_rows))
    per = per.withColumn("full", F.coalesce(F.sum("most").over(before), F.lit(0))).withColumn("rest", F.col("ws") - F.coalesce(F.sum("w").over(before), F.lit(0)))
    # In the order of most / w, a source is full when the level that fills it does not need more than there is.
    per = per.withColumn("capped", down * (F.col("most") * F.col("rest") + F.col("full") * F.col("w")) <= up * F.col("words") * F.col("w"))
    done = F.coalesce(F.sum(F.when(F.col("capped"), F.col("most"))).over(all_rows), F.lit(0))
    open_w = F.sum(F.when(~F.col("capped"), F.col("w"))).over(all_rows)
    level = (F.lit(float(up)) * F.col("words") / F.lit(float(down)) - done) / open_w
    target = F.when(F.col("capped"), F.col("most").cast("double")).otherwise(F.col("w") * level)
    return per.select("source", "place", "source_size", target.alias("target"))


def mix(sizes: DataFrame, **settings) -> DataFrame:
    """sizes: doc_id, source, size.  One row for each: doc_id, source, size, source_size, target, copies, taken, and its
    other columns, by which ties are put in order."""
    rounds = settings.get("rounds", ROUNDS)
    others = [c for c in sizes.columns if c not in ("doc_id", "source", "size")]
    place_of = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null"), F.col("size").cast("string")))
    sizes = cut(sizes.withColumn("h", F.md5(place_of.cast("binary"))))
    n = sizes.count()
    digits = 1
    while 16**digits * RANGE_ROWS < n:
        digits += 1
    goal = cut(targets(sizes, **settings))
    budget = goal.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]
    # Rows without words take nothing, and stay out of the queues.
    none, sizes = sizes.where("size = 0"), sizes.where("size > 0").withColumn("part", F.substring("h", 1, digits))
    parts = sizes.groupBy("source", "part").agg(F.sum("size").alias("in_part"))
    parts = parts.withColumn("before", F.coalesce(F.sum("in_part").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    parts = parts.select(F.col("source").alias("s"), F.col("part").alias("p"), "before")
    inside = F.sum("size").over(Window.partitionBy("source", "part").orderBy("h", "doc_id", "size", *others).rowsBetween(Window.unboundedPreceding, 0))
    rows = sizes.withColumn("inside", inside)
    rows = rows.join(parts, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p"))).withColumn("upto", F.col("before") + F.col("inside")).drop("s", "p", "part", "before", "inside")
    named = goal.select(F.col("source").alias("s"), "place", "source_size", "target")
    rows = rows.unionByName(none.withColumn("upto", F.lit(0).cast("long")))
    rows = cut(rows.join(F.broadcast(named) if goal.count() <= SOURCES else named, F.col("source").eqNullSafe(F.col("s"))).drop("s"))

    ranges = max(64, min(n // RANGE_ROWS, RANGES))
    finish = lambda r: (F.col("upto") + r * F.col("source_size")) / F.col("target")
    bin_of = lambda f: F.least(F.floor(f * ranges), F.lit(8 * ranges)).cast("long")
    queue = rows.where("size > 0").select("place", "h", "doc_id", "size", F.explode(F.array(*[F.struct(F.lit(r).alias("round"), finish(r).alias("finish")) for r in range(rounds)])).alias("c"))
    queue = queue.select("place", "h", "doc_id", "size", "c.round", "c.finish", bin_of(F.col("c.finish")).alias("bin"))
    bins = queue.groupBy("bin").agg(F.sum("size").alias("words"))
    bins = bins.withColumn("upto", F.sum("words").over(Window.orderBy("bin")))
    over = bins.where(F.col("upto") > budget).orderBy("bin").limit(1).select("bin", (F.col("upto") - F.col("words")).alias("before")).collect()
    if not over:
        copies = F.when(F.col("size") > 0, F.lit(rounds)).otherwise(0)
    else:
        at, before = over[0]
        order = ["finish", "place", "h", "doc_id", "round"]
        last = queue.where(F.col("bin") == at).withColumn("upto", F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) + before)
        last = last.where(F.col("upto") <= budget).orderBy(*[F.col(c).desc() for c in order]).limit(1).select(*order).collect()
        copies = F.lit(0)
        for r in range(rounds):
            taken = bin_of(finish(r)) < at
            if last:
                top = last[0]
                here = F.struct(finish(r).alias("finish"), F.col("place"), F.col("h"), F.coalesce(F.col("doc_id"), F.lit(-1 << 63)).alias("doc_id"), F.lit(r).alias("round"))
                end = F.struct(F.lit(top["finish"]).alias("finish"), F.lit(top["place"]).alias("place"), F.lit(top["h"]).alias("h"), F.lit(-1 << 63 if top["doc_id"] is None else top["doc_id"]).cast("long").alias("doc_id"), F.lit(top["round"]).alias("round"))
                taken = taken | ((bin_of(finish(r)) == at) & (here <= end))
            copies = copies + F.when((F.col("size") > 0) & taken, 1).otherwise(0)
    return rows.withColumn("copies", copies.cast("int")).select("doc_id", "source", "size", "source_size", F.coalesce(F.col("target"), F.lit(0.0)).alias("target"), "copies", *others, (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def draw(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: the rows of docs, as often as they are taken, with a column `copy` from 1.

    Rows are told apart by where they stand in their files, so that equal ones, and those that share a doc_id, are
    drawn each by itself."""
    keyed = _keyed(docs)
    plan = mix(sized(keyed, *KEY), **settings).where("copies > 0").select(*KEY, F.col("copies").alias("_mix_copies"))
    return keyed.join(plan, list(KEY)).select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("_mix_copies"))).alias("copy" if "copy" not in docs.columns else "mix_copy"))


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a key of each row that every reading gives again: that of a table of files comes from the files, any
    other is written once with numbers."""
    if docs._jdf.queryExecution().analyzed().nodeName().startswith("LogicalRelation"):
        try:
            return docs.select("*", F.xxhash64("_metadata.file_path").alias(KEY[0]), F.col("_metadata.row_index").alias(KEY[1]))
        except AnalysisException:
            pass  # files of a format that does not count rows
    return store(docs.select("*", F.lit(0).cast("long").alias(KEY[0]), F.monotonically_increasing_id().alias(KEY[1])))


#: DuckDB: the rows of mix(), without source and copies.
SQL = r"""
WITH sizes AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                      md5(coalesce(CAST(doc_id AS VARCHAR), 'null' || size)) AS h FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sizes GROUP BY source),
weighed AS (SELECT *, 2 * source_size AS most, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM per),
ordered AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS words,
                   CAST(coalesce(sum(most) OVER o, 0) AS BIGINT) AS done,
                   CAST(sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS BIGINT) AS rest
            FROM weighed WINDOW o AS (ORDER BY most / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, 2 * (most * rest + done * w) <= 3 * words * w AS capped FROM ordered),
goal AS (SELECT source, place, source_size,
                CASE WHEN capped THEN CAST(most AS DOUBLE)
                     ELSE w * ((CAST(3 AS DOUBLE) * words / CAST(2 AS DOUBLE) - CAST(coalesce(sum(CASE WHEN capped THEN most END) OVER (), 0) AS DOUBLE))
                               / CAST(sum(CASE WHEN NOT capped THEN w END) OVER () AS DOUBLE)) END AS target FROM capped),
queue AS (SELECT s.doc_id, s.size, s.h, g.place, g.source_size, g.target, r.round,
                 CAST(sum(s.size) OVER (PARTITION BY g.place, r.round ORDER BY s.h, s.doc_id ROWS UNBOUNDED PRECEDING) + r.round * g.source_size AS BIGINT) / g.target AS finish
          FROM sizes s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source, (VALUES (0), (1)) r(round)),
served AS (SELECT *, sum(size) OVER (ORDER BY finish, place, h, doc_id, round ROWS UNBOUNDED PRECEDING) AS upto FROM queue)
SELECT doc_id, size, source_size, target, CAST(sum(CASE WHEN upto <= (SELECT sum(target) FROM goal) THEN size ELSE 0 END) AS BIGINT) AS taken
FROM served GROUP BY doc_id, size, source_size, target
"""

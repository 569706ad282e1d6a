"""Operators of the engine on small tables."""

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import graph, relational, search


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_change_set(spark):
    stored = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, digest string")
    current = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, digest string")
    assert rows(relational.change_set(stored, current, "path", "digest")) == [("b", "changed"), ("c", "deleted"), ("d", "new")]


def test_upsert_keeps_incoming_nulls(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    incoming = spark.createDataFrame([(2, None), (3, "c")], "id int, v string")
    assert sorted(((r.id, r.v) for r in relational.upsert(stored, incoming, "id").collect())) == [(1, "a"), (2, None), (3, "c")]


def test_ranges_that_overlap_or_touch_are_one(spark):
    ranges = spark.createDataFrame([("f", 1, 4), ("f", 5, 6), ("f", 2, 3), ("f", 9, 9), ("f", 9, 9)], "file string, first int, last int")
    assert rows(relational.merged_ranges(ranges, "file")) == [("f", 1, 6), ("f", 9, 9)]


def test_hops_scores_and_subgraph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (2, 1)], "src long, dst long")
    seeds = spark.createDataFrame([(1,)], "node long")
    assert rows(graph.expand_scored(edges, seeds)) == [(1, 0, 5), (2, 1, 3), (3, 2, 1)]
    assert rows(graph.k_hop(edges, spark.createDataFrame([(4,)], "node long"), 1, both=True)) == [(3, 1), (4, 0)]
    assert rows(graph.subgraph(edges, seeds)) == [(1, 2), (2, 1)]
    assert rows(graph.without_nodes(edges, seeds)) == [(2, 3), (3, 4)]
    assert dict(rows(graph.degree(edges))) == {1: 2, 2: 3, 3: 2, 4: 1}


def test_search(spark):
    docs = spark.createDataFrame([(1, "user_id of AuthService"), (2, "id user"), (3, None), (4, "Café auth")], "doc_id long, text string")
    assert rows(search.match(docs, "user_id", every=True)) == [(1,)]
    assert rows(search.match(docs, "cafe id", every=False)) == [(1,), (2,), (4,)]
    assert rows(search.match(docs, "", every=True)) == []
    assert rows(search.match_prefix(docs, "auth")) == [(1,), (4,)]
    ranked = rows(search.bm25(docs, "auth"))
    assert [r[0] for r in ranked] == [4] and ranked[0][1] < 0


def test_text_functions(spark):
    df = spark.createDataFrame([("a" * 201 + "\nb", " x  y ", "p/q/r.ts", 1280)], "s string, i string, p string, n long")
    got = df.select(T.signature(F.col("s")), T.intent(F.col("i")), T.short_path(F.col("p")), T.human_bytes(F.col("n")), T.token_estimate(F.lit("abcde"))).first()
    assert tuple(got) == ("a" * 200 + "...", "x y", "q/r.ts", "1.3 KB", 2)


def test_budget_ends_at_a_whole_file_but_only_the_file_of_a_range(spark):
    pieces = spark.createDataFrame([
        ("a", 1, 1, True, 9), ("a", 2, 1, True, 3),
        ("b", 1, 1, False, 4), ("b", 1, 2, False, 9), ("b", 1, 3, False, 1), ("b", 2, 1, True, 2), ("b", 3, 1, True, 8), ("b", 4, 1, True, 1),
    ], "task string, rank int, piece int, whole boolean, tokens int")
    assert rows(relational.budget_fold(pieces, "task", 8)) == [("a", 1, 1, 9, 0), ("b", 1, 1, 4, 0), ("b", 2, 1, 2, 4)]

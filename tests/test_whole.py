"""The queries of plans/whole.py against their SQL, and what the cut ones leave out."""

import os

import pytest
from pyspark.sql import functions as F

from test_queries import DIR, same
from wordloom.operators import graph, tokens
from wordloom.plans import whole

data = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@data
@pytest.mark.parametrize("name", sorted(whole.catalog.queries))
def test_whole_query(spark, name):
    same(spark, whole.catalog.queries[name], whole.catalog.sql[name])


@data
def test_graph_has_more_than_150_terms(spark):
    n = whole.catalog.queries["k06_vocabulary_whole"](spark, DIR).count()
    assert 150 < n <= 2000
    from wordloom.plans import corpus

    assert corpus.catalog.queries["k11_communities"](spark, DIR).select("term").distinct().count() > 150


def test_edges_keep_the_order_of_terms(spark):
    df = spark.createDataFrame([(i, ["b", "a", "c-d", "Z", "b"]) for i in range(5)], "id int, t array<string>")
    got = {(r["src"], r["dst"], r["weight"]) for r in graph.edges(df, F.col("t"), graph.vocabulary(df, F.col("t")), "id").collect()}
    assert got == {("Z", "a", 5), ("Z", "b", 5), ("Z", "c-d", 5), ("a", "b", 5), ("a", "c-d", 5), ("b", "c-d", 5)}


def test_kwic_keeps_short_words(spark):
    df = spark.createDataFrame([(1, "I said: talk to a therapist, it is ok")], "id int, t string")
    seeds = spark.createDataFrame([("talk to a therapist",)], "seed string").withColumn("seed_tokens", tokens.loose_words(F.col("seed")))
    got = tokens.kwic(df, tokens.loose_words(F.col("t")), seeds, [1, 5], ["id"]).orderBy("width").collect()
    assert [(r["pos"], r["width"], r["left_context"], r["right_context"]) for r in got] == [(2, 1, "said", "it"), (2, 5, "i said", "it is ok")]


def test_comparison_takes_true_counts(spark):
    mk = lambda c: spark.createDataFrame(c, "term string, n long")
    a, b = mk([("x", 9), ("y", 5), ("q", 1)]), mk([("z", 9), ("y", 6), ("x", 4)])
    assert {r["term"]: (r["a"], r["b"]) for r in tokens.compare_whole(a, b, 1).collect()} == {"x": (9, 4), "z": (0, 9)}
    assert [r["term"] for r in tokens.compare_whole(a, b, None).where("b = 0").collect()] == ["q"]


def test_phrases_have_neighbours(spark):
    df = spark.createDataFrame([("seek professional help from friends".split(),)] * 5, "t array<string>")
    anchors = spark.createDataFrame([("professional help", ["professional", "help"]), ("help", ["help"])], "seed string, seed_tokens array<string>")
    got = {(r["anchor"], r["width"], r["term"]): (r["cooc"], r["anchor_n"]) for r in tokens.phrase_collocations(df, F.col("t"), anchors, [1, 5]).collect()}
    assert got["professional help", 5, "friends"] == (5, 5) and got["professional help", 1, "seek"] == (5, 5) and ("professional help", 1, "help") not in got and ("help", 1, "professional") in got


def test_fragments_are_no_words(spark):
    df = spark.createDataFrame([("erklärte abc_def gpt4all plain",)], "t string")
    with tokens.splitting(tokens.strict_words):
        assert df.select(tokens.words(F.col("t"))).head()[0] == ["plain"]
    assert df.select(tokens.words(F.col("t"))).head()[0] == ["erkl", "rte", "abc", "def", "gpt", "all", "plain"]

import itertools
import math
from collections import Counter
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wordloom.operators import clean, clusters, graph, relational, segments, tagging, tokens


def one(df):
    return [r[0] for r in df.collect()]


def test_stub_rule(spark):
    long = "y" * 200
    rows = [None, "", "  ", "title [removed]", long + "[removed]", "[DELETED]", "[removed] [deleted]", "fine"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, t string").orderBy("i")
    assert one(df.select(clean.is_stub(F.col("t")))) == [True, True, True, True, False, True, True, False]


def test_urls_entities_slug(spark):
    df = spark.createDataFrame([(r"a\_b &amp; &#39;c&#39; http://x.y/z [l](http://q) www.k.de e",)], "t string")
    assert one(df.select(clean.collapse(clean.strip_urls(clean.unescape(F.col("t")))))) == ["a_b & 'c' e"]
    assert one(df.select(clean.slug(F.lit("  Talk to a Therapist! ")))) == ["talk_to_a_therapist"]
    with pytest.raises(ValueError):
        clean.first_column(df, ["nope"])


def test_tokenizers(spark):
    df = spark.createDataFrame([("don't abc_d gpt4 éabc two-part it’s ab",), (None,), ("",)], "t string")
    assert one(df.select(tokens.strict_words(F.col("t"))))[0] == ["don", "two", "part"]
    assert one(df.select(tokens.loose_words(F.col("t"))))[0] == ["don't", "abc", "d", "gpt4", "abc", "two-part", "it's", "ab"]
    assert one(df.select(tokens.words(F.col("t"))))[1:] == [[], []]


def test_skipgrams_modes(spark):
    t = "a b a c b".split()
    df = spark.createDataFrame([(t,), ([],), (None,)], "t array<string>")
    for skip in (1, 2):
        plain, weighted, width = Counter(), Counter(), 2 + 2 * skip
        for a in range(len(t)):
            for b in range(a + 1, min(a + skip + 2, len(t))):
                plain[t[a], t[b]] += 1
            # every window that begins here counts its pairs of at most 2 + skip apart
            for x, y in itertools.combinations(range(a, min(a + width, len(t))), 2):
                weighted[t[x], t[y]] += y - x <= 2 + skip
        get = lambda c: {(r["first"], r["second"]): r["n"] for r in tokens.skipgrams(df, F.col("t"), skip, c).collect()}  # noqa: E731,B023
        assert get(False) == plain and get(True) == weighted


def test_ngrams_stay_inside_documents(spark):
    df = spark.createDataFrame([(["a", "b"],), (["c"],), ([],)], "t array<string>")
    assert [r["term"] for r in tokens.frequency(df, tokens.ngrams(F.col("t"), 2)).collect()] == ["a b"]


def test_keep_first_with_null_keys_and_ties(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, None, "x"), (3, "k", "x")], "id int, k string, b string")
    assert sorted(r["id"] for r in relational.keep_first(df, ["k", "b"], ["id"]).collect()) == [1, 3]


def test_stratified_sample_quota(spark):
    df = spark.createDataFrame([(i, "big" if i < 95 else None if i < 98 else "small") for i in range(100)], "id int, s string")
    got = Counter(r["s"] for r in relational.stratified_sample(df, "s", "id", 30).collect())
    assert sum(got.values()) == 30 and got["small"] >= 1 and got[None] >= 1
    assert relational.stratified_sample(df.limit(0), "s", "id", 5).count() == 0


def test_tagging_and_saturation(spark):
    df = spark.createDataFrame([("Please Talk To A Therapist now",), (None,), ("x(y",)], "t string")
    terms = [{"term": "talk to a therapist", "retrieval_action": "exact match"}, {"term": "x(y", "retrieval_action": "regex"}, {"term": r"\bplease\b", "retrieval_action": "regex"}]
    assert one(tagging.tag(df, "t", terms).select("matched")) == [["talk to a therapist", r"\bplease\b"], [], ["x(y"]]
    s = spark.createDataFrame([(5, 100, 0.9), (50, 100, 0.9), (50, 100, 0.4), (50, 100, None)], "n int, p int, q double")
    assert one(s.select(tagging.saturated(F.col("n"), F.col("p"), F.col("q")))) == [True, False, True, True]


def test_proximity_edges(spark):
    mk = lambda gap: "AAA" + "x" * (gap - 3) + "BBB"
    df = spark.createDataFrame([(1, mk(1500)), (2, mk(1501)), (3, "BBB AAA"), (4, None)], "id int, t string")
    got = {r["id"]: r["context"] for r in tagging.proximity(df, "t", "AAA", "BBB", keep=["id"]).collect()}
    assert set(got) == {1, 3} and got[3] == "BBB AAA" and got[1] == mk(1500)


def test_graph_against_brute_force(spark):
    docs = [["a", "b", "c"], ["a", "b"], ["b", "c", "b"], [], ["d"]]
    df = spark.createDataFrame(list(enumerate(docs)), "id int, t array<string>")
    e = graph.edges(df, F.col("t"), graph.vocabulary(df, F.col("t"), 10), "id", 1)
    want = Counter((a, b) for d in docs for a in set(d) for b in set(d) if a < b)
    assert {(r["src"], r["dst"]): r["weight"] for r in e.collect()} == want
    assert graph.stats(e).head().asDict() == {"nodes": 3, "edges": 3, "density": 1.0, "avg_degree": 2.0}
    assert graph.stats(e.limit(0)).head()["density"] == 0.0


def test_communities_beat_singletons(spark):
    es = [(a, b, 10) for g in ("abcd", "wxyz") for i, a in enumerate(g) for b in g[i + 1 :]] + [("d", "w", 1)]
    e = spark.createDataFrame(es, "src string, dst string, weight long")
    lab = graph.communities(e, [1.0])
    assert {r["term"]: r["community"] for r in lab.collect()} in ({**dict.fromkeys("abcd", 0), **dict.fromkeys("wxyz", 1)},)
    assert graph.modularity(e, lab.select("term", "community")).head()[0] > 0.4


def test_agreement(spark):
    df = spark.createDataFrame([(i % 3, (i + 1) % 3, 0) for i in range(30)], "a int, b int, c int")
    assert clusters.adjusted_rand(df, "a", "b").head()[0] == 1.0 and clusters.normalized_mutual_information(df, "a", "b").head()[0] == 1.0
    assert clusters.adjusted_rand(df, "a", "c").head()[0] == 0.0
    assert clusters.kappa(df, "a", "a").head()["kappa"] == 1.0 and clusters.kappa(df, "c", "c").head()["kappa"] is None
    assert clusters.adjusted_rand(df.limit(1), "a", "b").head()[0] is None


def test_density_clusters(spark):
    rows = [("g", i, [math.cos(i) * 0.1 + (10 if i % 2 else 0), math.sin(i) * 0.1]) for i in range(40)] + [("g", 99, [500.0, 500.0])]
    got = {r["id"]: r["cluster"] for r in clusters.density_clusters(spark.createDataFrame(rows, "g string, id int, v array<double>"), "g", "id", "v").collect()}
    assert got[99] == -1 and len({got[i] for i in range(0, 40, 2)} - {-1}) == 1 and got[0] != got[1]


_SPAN = st.tuples(st.integers(0, 30), st.integers(1, 12), st.sampled_from(list(segments.LABEL_RANK)), st.sampled_from(["high", "medium", "low"]))


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 40), st.lists(_SPAN, max_size=8))
def test_cover_is_gapless_and_matches_characters(n, raw):
    spans = [(min(a, n), min(a + k, n), lab, c, str(i)) for i, (a, k, lab, c) in enumerate(raw) if min(a, n) < min(a + k, n)]
    out = segments.cover(n, spans)
    assert out[0][0] == 0 and out[-1][1] == n and all(x[1] == y[0] for x, y in zip(out, out[1:]))
    assert all(x[2:] != y[2:] for x, y in zip(out, out[1:]))
    for p in range(n):
        over = [(segments.LABEL_RANK[s[2]], segments.CONFIDENCE_RANK[s[3]], i) for i, s in enumerate(spans) if s[0] <= p < s[1]]
        want = spans[min(over)[2]][2:] if over else segments.FLOOR
        assert next(s[2:] for s in out if s[0] <= p < s[1]) == want


def test_segment_rows(spark):
    df = spark.createDataFrame([(1, "Hi. > no\n> quoted\n> more\nend"), (2, None), (3, ""), (4, "This was posted by a script; ok")], "id int, t string")
    got = {}
    for r in segments.segment(df, "t", "id").orderBy("id", "span_index").collect():
        got.setdefault(r["id"], []).append((r["span_start"], r["span_end"], r["label"]))
    assert got[2] == got[3] == [(0, 0, "User_Original_Content")]
    assert got[4] == [(0, 31, "Moderation_Notice")] and got[1][1] == (9, 25, "Direct_Quote_Of_Model")


def test_cut_counts_with_missing_time(spark):
    df = spark.createDataFrame([(datetime(2025, 1, 1),), (datetime(2026, 1, 1),), (None,)], "t timestamp")
    assert relational.cut_counts(df, "t", "2025-09-29").head()[:3] == (1, 1, 1)

"""Operators of the inventory against brute force on small tables, with nulls, ties, repeated rows and empty tables."""

import itertools
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wordloom.operators import clusters, graph, relational, segments, tagging, tokens


def test_places_without_a_window_over_all(spark):
    rows = [(i, random.Random(i).choice([None, 1, 2, 3])) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, v int").repartition(7)
    got = {r["id"]: r["place"] for r in relational.global_rank(df, [F.col("v").desc_nulls_last(), F.col("id")]).collect()}
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert got == {r[0]: i + 1 for i, r in enumerate(want)}
    assert relational.global_rank(df.limit(0), [F.col("id")]).count() == 0


def test_upper_median_of_groups(spark):
    rnd = random.Random(4)
    rows = [("hot", rnd.choice([rnd.random(), 0.5, None])) for _ in range(400)] + [("one", 3.0), ("two", 1.0), ("two", 2.0), (None, 7.0), ("none", None)]
    got = {r["g"]: r["upper_median"] for r in relational.value_at_half(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()}
    by = {g: sorted(v for k, v in rows if k == g and v is not None) for g in {g for g, _ in rows}}
    assert got == {g: v[len(v) // 2] for g, v in by.items() if v}


@pytest.mark.parametrize("skip", [1, 2])
def test_skipgrams_that_count_windows(spark, skip):
    t = "a b c a d b e f a".split()
    want = Counter()
    for i in range(len(t)):
        for x, y in itertools.combinations(range(i, min(i + 2 + 2 * skip, len(t))), 2):
            if y - x <= 2 + skip:
                want[t[x], t[y]] += 1
    df = spark.createDataFrame([(t,), ([],), (None,), (["z"],)], "t array<string>")
    got = {(r["first"], r["second"]): r["n"] for r in tokens.skipgrams(df, F.col("t"), skip, compat=True).collect()}
    assert got == want
    plain = Counter((t[i], t[j]) for i in range(len(t)) for j in range(i + 1, min(i + 2 + skip, len(t))))
    assert {(r["first"], r["second"]): r["n"] for r in tokens.skipgrams(df, F.col("t"), skip).collect()} == plain


def test_sense_contexts(spark):
    text = "Talk to a Therapist, talk to A therapist www.x.org now"
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (1, text)], "id int, body string")
    seeds = spark.createDataFrame([("talk to a",), ("a therapist",), ("  ",), (None,)], "seed string")
    got = tokens.sense_contexts(df, "body", seeds, ["id"], width=2)
    rows = sorted((r["seed"], r["pos"], r["seed_token"], r["left_context"], r["right_context"]) for r in got.collect())
    assert rows == sorted(2 * [("talk to a", 0, "Talk to a", "", "Therapist, talk"), ("talk to a", 4, "talk to A", "a Therapist,", "therapist now"), ("a therapist", 6, "A therapist", "talk to", "now")])
    moved = tokens.sense_contexts(df, "body", seeds, ["id"], width=2, compat=True)
    assert {(r["seed"], r["pos"], r["seed_token"]) for r in moved.collect()} == {("talk to a", 0, "Talk"), ("talk to a", 3, "Therapist,"), ("a therapist", 5, "to")}


def test_terms_in_blocks_are_those_of_one_expression(spark):
    df = spark.createDataFrame([(1, "Say HELLO there, hell"), (2, None), (3, ""), (4, "x" * 5000 + "hello")], "id int, body string")
    terms = spark.createDataFrame([(t, None, None) for t in ["hello", "Hello", "hell", "there", "zz", "", None]], "term string, confidence string, retrieval_action string")
    want = {(r["id"], r["term"]) for r in tagging.tag(df, "body", tagging.read_terms(terms.where("term <> ''"))).select("id", F.explode("matched").alias("term")).collect()}
    for block in (100, 2):
        assert {tuple(r) for r in tagging.tag_blocks(df, "id", "body", terms, block=block).collect()} == want
    assert tagging.tag_blocks(df, "id", "body", terms.limit(0)).count() == 0


def test_bad_patterns_are_literals(spark):
    df = spark.createDataFrame([("a(b",), ("colour",)], "body string")
    terms = [{"term": "a(b", "retrieval_action": "regex"}, {"term": "colou?r", "retrieval_action": "regex"}]
    assert [r["matched"] for r in tagging.tag(df, "body", terms).collect()] == [["a(b"], ["colou?r"]]


def test_excerpts(spark):
    text = "One. " * 400 + "Here is the Anchor word. " + "Two. " * 400 + "A second anchor. End"
    (a, b), *rest = tagging.windows_around(text, ["anchor"])
    first, second = (m.start() for m in re.finditer("anchor", text.lower()))
    assert not rest if second - first <= 1800 else rest
    assert text[a:].startswith("One. ") and text[b - 1] in ".d" and a <= first < b
    df = spark.createDataFrame([(1, text), (2, "nothing"), (3, None), (4, ""), (5, "anchor")], "id int, body string")
    got = {r["id"]: (r["places"], r["excerpt"]) for r in tagging.excerpts(df, "body", "id", [{"term": "anchor"}]).collect()}
    assert got[5] == (1, "anchor") and got[2] == got[3] == got[4] == (0, None) and "Anchor word." in got[1][1]


def test_sweep_gives_the_cover(spark):
    rnd, labels, confs = random.Random(8), list(segments.LABEL_RANK), list(segments.CONFIDENCE_RANK)
    rows, want = [], {}
    for k in range(25):
        n = rnd.randrange(1, 40)
        spans = []
        for o in range(rnd.randrange(1, 7)):
            a = rnd.randrange(0, n)
            s = (a, rnd.randrange(a + 1, n + 1), rnd.choice(labels), rnd.choice(confs), str(o))
            spans.append(s)
            rows.append((k, n, s[0], s[1], segments.LABEL_RANK[s[2]], segments.CONFIDENCE_RANK[s[3]], o))
        want[k] = [(a, b, int(src) if src != "floor" else None) for a, b, _, _, src in segments.cover(n, spans)]
    df = spark.createDataFrame(rows, "k int, length int, start int, end int, label_rank int, conf_rank int, ord int")
    got: dict[int, list] = {}
    for r in segments.resolve(df, "k").orderBy("k", "lo").collect():
        got.setdefault(r["k"], []).append((r["lo"], r["hi"], r["winner"]))
    assert got == want


def test_catalogue_of_rules():
    names = [r.name for r in segments.RULES]
    assert len(names) == len(set(names)) >= 56
    label = lambda t: next((r.label for r in segments.RULES if r.scope != "span" and re.search(r.pattern, t)), segments.FLOOR[0])
    for text, want in (("I am a bot. It said \"go away\".", "Moderation_Notice"), ("<long_reminder> be calm </long_reminder>", "Prompt_Reproduction"), ("> quoted", "Direct_Quote_Of_Model"), ('It said "take a rest now"', "Direct_Quote_Of_Model"), ("It kept telling me to rest.", "Paraphrase_Of_Model"), ("The bot told me to see a therapist", "Paraphrase_Of_Model"), ("I like tea.", "User_Original_Content"), ("", "User_Original_Content")):
        assert label(text) == want, text
    quoted = segments.raw_spans("> <x_reminder>stay calm</x_reminder>\nmine")
    assert any(s[2] == "Prompt_Reproduction" and s[4].startswith("blockquote:") for s in quoted)


def test_quota_sample_and_budget(spark):
    rows = [(i, "a" if i % 10 else "b", "x" if i % 3 else "y", i % 7 == 0) for i in range(400)] + [(900, None, None, None)]
    df = spark.createDataFrame(rows, "id int, label string, kind string, boosted boolean")
    got = segments.quota_sample(df, "id", "label", {"a": 5, "b": 4, "c": 9}, 20, boost=F.col("boosted")).collect()
    n = Counter((r["stage"], r["label"]) for r in got)
    assert len(got) == 20 and n[1, "a"] == 5 and n[1, "b"] == 4 and all(r["boosted"] for r in got if r["stage"] == 2) and not [r for r in got if r["stage"] == 3]
    split = Counter((r["label"], r["kind"]) for r in segments.quota_sample(df, "id", "label", {"a": 9}, 400, split="kind").collect() if r["stage"] == 1)
    assert split["a", "x"] == 6 and split["a", "y"] == 3  # in proportion
    assert len(segments.quota_sample(df, "id", "label", {}, 1000).collect()) == len(rows)
    quota = {r["stratum"]: r["quota"] for r in segments.budget(df, "kind", 100, ("label", "b")).collect()}
    assert sum(quota.values()) == 100 and quota["boost"] == 20 and set(quota) == {"boost", "x", "y", "unknown"}
    assert sum(r["quota"] for r in segments.budget(df, "kind", 10_000).collect()) == len(rows)
    assert segments.budget(df.limit(0), "kind", 5).count() == 0


def test_scorer(spark):
    spans = segments.segment(spark.createDataFrame([(1, "plain text"), (2, 'It said "go home now". Yes.'), (3, None)], "id int, body string"), "body", "id")
    assert segments.rescored(spans, "id", None, 5) is spans and segments.rescored(spans, "id", lambda t: [], 0) is spans
    mark = lambda texts: [("Paraphrase_Of_Model", "low") if "plain" in t else ("Nonsense", "high") for t in texts]
    got = {(r["id"], r["span_index"]): r["source"] for r in segments.rescored(spans, "id", mark, 10).collect()}
    assert got[1, 0] == "scorer" and list(got.values()).count("scorer") == 1

    def broken(texts):
        raise RuntimeError

    assert {r["source"] for r in segments.rescored(spans, "id", broken, 10).collect()} == {r["source"] for r in spans.collect()}


def test_lookup_flags_and_routing(spark):
    known = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), (None, 3, "x")], "key string, n int, v string")
    df = spark.createDataFrame([("k", "a"), ("z", "b"), (None, "c")], "key string, w string")
    assert {(r["w"], r["v"]) for r in relational.lookup(df, known, "key", "n", ["v"]).collect()} == {("a", "new"), ("b", "unknown"), ("c", "unknown")}
    new = spark.createDataFrame([("k", "new"), ("k", None), ("q", "x")], "key string, v string")
    assert sorted(r["v_changed"] for r in relational.change_flags(new, known, "key", "n", ["v"]).collect()) == ["no", "yes"]
    x = spark.createDataFrame([("s", "f", ["none"]), (None, "f", ["none", "p"]), ("s", "f", None)], "s string, f string, l array<string>")
    assert [(r["f"], r["valid"]) for r in relational.routed(x, {"f": "s"}, ("l", "none")).collect()] == [("f", True), (None, False), ("f", True)]


def test_agreement_matrix_against_one_pair(spark):
    rnd = random.Random(9)
    rows = [(i, m, s, rnd.choice([-1, 0, 1, 2])) for i in range(60) for m in "ab" for s in (5, 10)]
    df = spark.createDataFrame(rows, "id int, model string, mcs int, cluster int")
    matrix = clusters.ari_matrix(df, "id", "model", "mcs", "cluster")
    got = {(r["model_a"], r["mcs_a"], r["model_b"], r["mcs_b"]): r["ari"] for r in matrix.collect()}
    assert len(got) == 6
    for (ma, sa, mb, sb), ari in got.items():
        a, b = ({i: c for i, m, s, c in rows if (m, s) == k} for k in ((ma, sa), (mb, sb)))
        pairs = spark.createDataFrame([(a[i], b[i]) for i in a if a[i] != -1 and b[i] != -1], "a int, b int")
        assert abs(clusters.adjusted_rand(pairs, "a", "b").head()["ari"] - ari) < 1e-9
    means = {r["kind"]: (r["mean_ari"], r["pairs"]) for r in clusters.ari_means(matrix).collect()}
    assert means["cross"][1] == 2 and means["within"][1] == 2
    assert clusters.ari_matrix(df.limit(0), "id", "model", "mcs", "cluster").count() == 0


def test_label_propagation_parts_a_graph(spark):
    parts = [[f"a{i}" for i in range(5)], [f"b{i}" for i in range(5)]]
    e = [(x, y, 3) for p in parts for x, y in itertools.combinations(p, 2)] + [("a0", "b0", 1)]
    got = {r["term"]: r["community"] for r in graph.label_propagation(spark.createDataFrame(e, "src string, dst string, weight long")).collect()}
    assert [len({got[x] for x in p}) for p in parts] == [1, 1] and got["a1"] != got["b1"]
    with pytest.raises(ValueError):
        graph.communities(spark.createDataFrame(e, "src string, dst string, weight long"), [1.0], most=5)


def test_adjacency_prefixes_and_ego_status(spark):
    e = spark.createDataFrame([("a", "b", 5), ("a", "c", 6), ("b", "c", 7), ("c", "d", 8)], "src string, dst string, weight long")
    m = {(r["src"], r["dst"]): r["weight"] for r in graph.adjacency(e, 3).collect()}
    assert len(m) == 9 and m["a", "b"] == m["b", "a"] == 5 and m["a", "a"] == 0
    d = spark.createDataFrame([(1, "Same text"), (2, "same TEXT "), (3, None), (4, "")], "id int, body string")
    assert [tuple(r) for r in graph.prefix_examples(d, "body", "id").collect()] == [("", 2, 3), ("same text", 2, 1)]
    words, voc = spark.createDataFrame([("a",), ("z",), ("q",)], "term string"), spark.createDataFrame([("a", 200), ("q", 150)], "term string, n long")
    assert {(r["term"], r["status"], r["neighbours"]) for r in graph.ego_status(words, voc, graph.degrees(e)).collect()} == {("a", "built", 2), ("z", "too rare", 0), ("q", "no edge", 0)}

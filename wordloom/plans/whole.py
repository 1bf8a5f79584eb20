"""Queries that do the whole job where the query of the same name, held by its SQL, does a part of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordloom.operators import graph, tokens
from wordloom.plans import corpus as cut
from wordloom.plans import more
from wordloom.plans.catalog import Catalog, table
from wordloom.plans.corpus import BODY, STOP, C, corpus, docs, whole_edges
from wordloom.plans.more import LOOSE
from wordloom.storage import attach, materialize

catalog = Catalog()
q = catalog.add


def _graph_sql(name: str = "e", where: str = "true") -> str:
    """CTEs {name}v (vocabulary) and {name} (edges)."""
    held = f"SELECT row_id, unnest(list_distinct(list_filter({LOOSE}, lambda x: length(x) >= 3 AND x NOT IN ({STOP})))) AS term FROM {C} WHERE {where}"
    return f"{name}h AS MATERIALIZED ({held}), {name}v AS MATERIALIZED (SELECT term, count(*) AS n FROM {name}h GROUP BY term ORDER BY n DESC, term LIMIT 2000), {name}k AS MATERIALIZED (SELECT row_id, term FROM {name}h JOIN {name}v USING (term)), {name} AS MATERIALIZED (SELECT a.term AS src, b.term AS dst, count(*) AS weight FROM {name}k a JOIN {name}k b ON a.row_id = b.row_id AND a.term < b.term GROUP BY 1, 2 HAVING count(*) >= 5), {name}d AS MATERIALIZED (SELECT term, count(*) AS degree FROM (SELECT unnest([src, dst]) AS term FROM {name}) GROUP BY term)"


_E, _P, _M = _graph_sql(), _graph_sql("p", "type = 'post'"), _graph_sql("m", "type = 'comment'")


@q("k06_vocabulary_whole", f"WITH {_E} SELECT * FROM ev")
def k06(s, d):
    return graph.vocabulary(corpus(s, d).select(tokens.content(tokens.loose_words(F.col("body"))).alias("w")), F.col("w"))


@q("k07_cooccurrence_whole", f"WITH {_E} SELECT * FROM e")
def k07(s, d):
    return whole_edges(s, d)


@q("k09_graph_stats_whole", f"WITH {_E} SELECT nodes, edges, round(2.0 * edges / (nodes * (nodes - 1)), 4) AS density, round(2.0 * edges / nodes, 4) AS avg_degree FROM (SELECT count(*) AS nodes FROM ed), (SELECT count(*) AS edges FROM e)")
def k09(s, d):
    return graph.stats(whole_edges(s, d))


@q("k10_degrees_whole", f"WITH {_E} SELECT * FROM ed")
def k10(s, d):
    return graph.degrees(whole_edges(s, d))


@q("k12_modularity_whole", f"WITH {_E}, l AS (SELECT term AS t, length(term) % 3 AS c FROM ed), m AS (SELECT sum(weight) AS m FROM e), i AS (SELECT a.c, sum(weight) AS w FROM e JOIN l a ON a.t = src JOIN l b ON b.t = dst WHERE a.c = b.c GROUP BY a.c), k AS (SELECT c, sum(weight) AS k FROM (SELECT src AS t, weight FROM e UNION ALL SELECT dst, weight FROM e) JOIN l USING (t) GROUP BY c) SELECT round(sum(coalesce(w, 0)::DOUBLE / m - (k / (2.0 * m)) * (k / (2.0 * m))), 4) AS modularity FROM k LEFT JOIN i USING (c), m")
def k12(s, d):
    e = materialize(whole_edges(s, d), "edges")
    return graph.modularity(e, graph.degrees(e).select("term", (F.length("term") % 3).alias("community")))


@q("k14_ego_graph_whole", f"WITH {_E}, a AS (SELECT min(src) AS t FROM e), n AS (SELECT src AS t FROM e WHERE dst = (SELECT t FROM a) UNION SELECT dst FROM e WHERE src = (SELECT t FROM a) UNION SELECT t FROM a) SELECT src, dst, weight FROM e WHERE src IN (SELECT t FROM n) AND dst IN (SELECT t FROM n)")
def k14(s, d):
    e = materialize(whole_edges(s, d), "edges")
    return graph.ego(e, e.agg(F.min("src").alias("t")).head()["t"] or "")


@q("k15_stratum_networks_whole", f"WITH {_P}, {_M} SELECT 'post' AS stratum, * FROM pd UNION ALL SELECT 'comment', * FROM md")
def k15(s, d):
    parts = [graph.degrees(whole_edges(s, d, k)).select(F.lit(k).alias("stratum"), "term", "degree") for k in ("post", "comment")]
    return parts[0].unionByName(parts[1])


def _shared(k: int) -> str:
    a, b = (f"SELECT term FROM (SELECT term FROM {x}d ORDER BY degree DESC, term LIMIT {k})" for x in "pm")
    return f"(SELECT count(*) FROM ({a} INTERSECT {b}))::DOUBLE AS s{k}, (SELECT count(*) FROM ({a} UNION {b})) AS u{k}"


_DENSITY = "(SELECT CASE WHEN count(*) > 1 THEN 2.0 * (SELECT count(*) FROM {x}) / (count(*) * (count(*) - 1)) ELSE 0 END FROM {x}d) AS d{x}"


@q("k16_degree_overlap_whole", f"WITH {_P}, {_M}, r AS (SELECT {_shared(100)}, {_shared(20)}, {_DENSITY.format(x='p')}, {_DENSITY.format(x='m')}) SELECT s100 AS shared, round(CASE WHEN u100 = 0 THEN 0 ELSE s100 / u100 END, 4) AS jaccard, s20 AS top20_shared, round(CASE WHEN dm > 0 THEN round(dp, 4) / round(dm, 4) ELSE 0 END, 4) AS density_ratio FROM r")
def k16(s, d):
    """Of posts and comments: top-100 degree sets, top-20 overlap and the ratio of the densities (each of four digits), 0 where empty."""
    es = [materialize(whole_edges(s, d, k), "edges") for k in ("post", "comment")]
    dens = [graph.stats(e).select(F.col("density").alias(n)) for e, n in zip(es, ("dp", "dm"))]
    tops = {k: [tokens.top(graph.degrees(e), k, n="degree").select("term") for e in es] for k in (100, 20)}
    count = lambda df, n: df.agg(F.count(F.lit(1)).alias(n))
    x = attach(attach(attach(attach(count(tops[100][0].intersect(tops[100][1]), "shared"), count(tops[100][0].union(tops[100][1]).distinct(), "u")), count(tops[20][0].intersect(tops[20][1]), "top20_shared")), dens[0]), dens[1])
    return x.select("shared", F.round(F.when(F.col("u") == 0, 0.0).otherwise(F.col("shared") / F.col("u")), 4).alias("jaccard"), "top20_shared", F.round(F.when(F.col("dm") > 0, F.col("dp") / F.col("dm")).otherwise(0.0), 4).alias("density_ratio"))


_SEEDS = f"SELECT DISTINCT term AS seed, {LOOSE.replace('body', 'term')} AS st FROM seed_terms_round_2"
_HITS = f"t AS MATERIALIZED (SELECT row_id, type, {LOOSE} AS w FROM {C}), s AS MATERIALIZED ({_SEEDS}), p AS MATERIALIZED (SELECT row_id, type, w, unnest(range(len(w))) AS pos FROM t), h AS MATERIALIZED (SELECT row_id, type, w, pos, seed, len(st) AS n FROM p JOIN s ON w[pos + 1] = st[1] AND w[pos + 1:pos + len(st)] = st)"


def _seeds(s, d):
    return table(s, d, "seed_terms_round_2").select(F.col("term").alias("seed"), tokens.loose_words(F.col("term")).alias("seed_tokens")).distinct()


@q("k01_kwic_whole", f"WITH {_HITS} SELECT row_id, width, seed, pos, array_to_string(w[greatest(pos - width + 1, 1):pos], ' ') AS left_context, array_to_string(w[pos + n + 1:pos + n + width], ' ') AS right_context FROM h, (SELECT unnest([5, 10, 20]) AS width)")
def k01(s, d):
    return tokens.kwic(corpus(s, d), tokens.loose_words(F.col("body")), _seeds(s, d), [5, 10, 20], ["row_id"])


@q("k02_hit_counts_whole", f"WITH {_HITS} SELECT seed, width, count(row_id) AS total, count_if(coalesce(type = 'post', false)) AS posts, count_if(coalesce(type = 'comment', false)) AS comments FROM s LEFT JOIN h USING (seed), (SELECT unnest([5, 10, 20]) AS width) GROUP BY seed, width")
def k02(s, d):
    """Every seed at every width, which can't change its counts; 0 where there is no hit."""
    seeds = _seeds(s, d)
    h = tokens.hits(corpus(s, d), tokens.loose_words(F.col("body")), seeds, ["type"]).groupBy("seed").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("type") == "post").alias("posts"), F.count_if(F.col("type") == "comment").alias("comments"))
    return seeds.select("seed").join(h, "seed", "left").na.fill(0, ["total", "posts", "comments"]).withColumn("width", F.explode(F.array(F.lit(5), F.lit(10), F.lit(20))))


_URL = "https?://\\S+|www\\.\\S+|\\[[^\\]]*\\]\\([^)]*\\)"
STRICT = f"list_filter(regexp_extract_all(lower(regexp_replace(coalesce({{c}}, ''), '{_URL}', ' ', 'g')), '[\\p{{{{L}}}}\\p{{{{M}}}}\\p{{{{Nd}}}}\\p{{{{Pc}}}}]+'), lambda x: regexp_full_match(x, '[a-z]{{{{3,}}}}'))".replace("{{", "{").replace("}}", "}")
_BODY, _TEXT, _TERM = (STRICT.replace("{c}", c) for c in ("body", "text", "anchor"))


def _strict(c="body"):
    return tokens.strict_words(F.col(c))


_CMP = f"WITH f AS (SELECT type, term, count(*) AS n FROM (SELECT type, unnest({_BODY}) AS term FROM {C} WHERE type IS NOT NULL) GROUP BY type, term), x AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY n DESC, term) AS r FROM f), z AS (SELECT term, coalesce(sum(n) FILTER (WHERE type = 'post'), 0) AS a, coalesce(sum(n) FILTER (WHERE type = 'comment'), 0) AS b, min(r) FILTER (WHERE type IN ('post', 'comment')) AS r FROM x GROUP BY term), w AS (SELECT *, sum(a) OVER () AS ta, sum(b) OVER () AS tb FROM z), r AS (SELECT term, a, b, round(a / ta * 1000, 4) AS a_per_1k, round(b / tb * 1000, 4) AS b_per_1k, round((a / ta) / greatest(b / tb, 1e-9), 4) AS ratio, r FROM w WHERE a + b > 0) "


def _compared(s, d, k=200):
    f = materialize(tokens.frequency(corpus(s, d).where("type IS NOT NULL"), _strict(), ["type"]), "frequency")
    return tokens.compare_whole(f.where("type = 'post'").select("term", "n"), f.where("type = 'comment'").select("term", "n"), k)


q("f14_corpus_compare_whole", _CMP + "SELECT * EXCLUDE (r) FROM r WHERE r <= 200")(_compared)
q("f15_elevated_whole", _CMP + "SELECT term, a, ratio FROM r WHERE r <= 200 AND ratio >= 1.05 AND a >= 20")(lambda s, d: _compared(s, d).where("ratio >= 1.05 AND a >= 20").select("term", "a", "ratio"))
q("f16_only_in_a_whole", _CMP + "SELECT term FROM r WHERE b = 0")(lambda s, d: _compared(s, d, None).where("b = 0").select("term"))


_ANCHORS = ["warning", "therapist", "reminder"]


@q("f13_collocation_pmi_whole", f"WITH t AS MATERIALIZED (SELECT row_id, {_BODY} AS w FROM {C}), s AS MATERIALIZED (SELECT anchor, {_TERM} AS st FROM (SELECT DISTINCT term AS anchor FROM seed_terms_round_2 UNION SELECT unnest({_ANCHORS}))), p AS MATERIALIZED (SELECT row_id, w, unnest(range(len(w))) AS pos FROM t), f AS (SELECT x, count(*) AS n FROM (SELECT unnest(w) AS x FROM t) GROUP BY x), h AS MATERIALIZED (SELECT anchor, st, w, pos FROM p JOIN s ON w[pos + 1] = st[1] AND w[pos + 1:pos + len(st)] = st), n AS (SELECT anchor, count(*) AS anchor_n FROM h GROUP BY anchor), c AS (SELECT anchor, width, term, count(*) AS cooc FROM (SELECT anchor, st, width, unnest(list_concat(w[greatest(pos - width + 1, 1):pos], w[pos + len(st) + 1:pos + len(st) + width])) AS term FROM h, (SELECT unnest([5, 10, 20]) AS width)) WHERE NOT list_contains(st, term) AND term NOT IN ({STOP}) GROUP BY ALL HAVING count(*) >= 5), r AS (SELECT anchor, width, term, cooc, anchor_n, n AS freq, round(log2(cooc * (SELECT sum(n) FROM f)::DOUBLE / (anchor_n * n)), 4) AS pmi FROM c JOIN n USING (anchor) JOIN f ON x = term) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor, width ORDER BY pmi DESC, term) AS rank FROM r) WHERE rank <= 50")
def f13(s, d):
    """Three words and the phrases of the seed terms, split as the texts are."""
    anchors = table(s, d, "seed_terms_round_2").select(F.col("term").alias("seed")).union(s.createDataFrame([(a,) for a in _ANCHORS], "seed string")).distinct()
    return tokens.phrase_collocations(corpus(s, d), _strict(), anchors.withColumn("seed_tokens", _strict("seed")), [5, 10, 20])


@q("f11_skipgrams_whole", " UNION ALL ".join(f"(WITH t AS (SELECT row_id, {_BODY} AS w FROM {C}), p AS (SELECT row_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM t) SELECT {k} AS skip, a.x AS first, b.x AS second, count(*) AS n FROM p a JOIN p b ON a.row_id = b.row_id AND b.i - a.i BETWEEN 1 AND {k + 1} GROUP BY ALL ORDER BY n DESC, first, second LIMIT 200)" for k in (1, 2)))
def f11(s, d):
    one, two = (tokens.skipgrams(corpus(s, d), _strict(), k).orderBy(F.desc("n"), "first", "second").limit(200).select(F.lit(k).alias("skip"), "first", "second", "n") for k in (1, 2))
    return one.union(two)


@q("f09_unigram_topn_whole", f"SELECT source, rank, term, n FROM (SELECT source, term, n, row_number() OVER (PARTITION BY source ORDER BY n DESC, term) AS rank FROM (SELECT source, term, count(*) AS n FROM (SELECT source, unnest({_TEXT}) AS term FROM documents) WHERE term NOT IN ({STOP}) GROUP BY source, term)) WHERE rank <= 500")
def f09(s, d):
    return tokens.top(tokens.frequency(docs(s, d), tokens.content(_strict("text")), ["source"]), 500, ["source"]).select("source", "rank", "term", "n")


def _split_by(name: str, by, sql: str) -> None:
    """Register the query ``name`` with another tokenizer in it and in its SQL."""
    c = cut.catalog if name in cut.catalog.queries else more.catalog

    def run(s, d):
        with tokens.splitting(by):
            return c.queries[name](s, d)

    q(f"{name}_whole", c.sql[name].replace(BODY, sql))(run)


for _n in ("f01_token_counts", "f08_variants", "f10_ngrams_2", "f10_ngrams_3", "f10_ngrams_4", "f17_stop_candidates", "f18_summary", "rp04_category_pivot", "rp05_daily_rate", "rp06_rolling_mean"):
    _split_by(_n, tokens.strict_words, _BODY)
for _n in ("k04_seed_distribution", "k13_document_frequency"):
    _split_by(_n, tokens.loose_words, LOOSE)

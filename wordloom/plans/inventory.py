"""Queries of the inventory's larger operators: segmentation, sampling by quotas, sense contexts, sinks and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordloom.operators import clean, clusters, graph, relational, segments, tagging, tokens
from wordloom.plans.catalog import Catalog, table
from wordloom.plans.corpus import C, corpus, whole_edges
from wordloom.plans.more import LOOSE
from wordloom.plans.whole import _BODY as STRICT_BODY
from wordloom.plans.whole import _E, _graph_sql
from wordloom.sources import sinks
from wordloom.storage import attach, broadcast_checked, materialize

catalog = Catalog()
q = catalog.add
_LABEL, _CONF, _NAME = segments.classify_sql("b")
_ROWS = f"v AS MATERIALIZED (SELECT row_id, subreddit, type, coalesce(body, '') AS b FROM {C}), l AS MATERIALIZED (SELECT row_id, subreddit, type, {_LABEL} AS label, {_CONF} AS confidence, {_NAME} AS source FROM v)"


def _labels(s, d):
    return corpus(s, d).select("row_id", "subreddit", "type", segments.classify(F.coalesce("body", F.lit(""))).alias("c")).select("row_id", "subreddit", "type", "c.*")


def _spans(s, d):
    spans = segments.segment(corpus(s, d), "body", "row_id")
    return spans.join(corpus(s, d).select("row_id", "subreddit", "type"), "row_id")


@q("v01_rule_labels", f"WITH {_ROWS} SELECT row_id, label, confidence, source FROM l")
def v01(s, d):
    """The whole catalogue, row by row."""
    return _labels(s, d).select("row_id", "label", "confidence", "source")


@q("v07_budget", f"WITH z AS (SELECT CASE WHEN subreddit = 'storyforge' THEN 'boost' ELSE coalesce(type, 'unknown') END AS stratum, count(*) AS rows FROM {C} GROUP BY 1), f AS (SELECT stratum, rows, CASE WHEN stratum = 'boost' THEN least(200, rows) ELSE least(rows, floor(800 * rows / (SELECT sum(rows) FROM z WHERE stratum <> 'boost'))) END::BIGINT AS first FROM z), o AS (SELECT *, 1000 - sum(first) OVER () AS over, coalesce(sum(rows - first) OVER (ORDER BY rows DESC, stratum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f) SELECT stratum, rows, first + greatest(0, least(rows - first, over - before)) AS quota FROM o")
def v07(s, d):
    return segments.budget(corpus(s, d), "type", 1000, ("subreddit", "storyforge"))


@q("v08_span_text")
def v08(s, d):
    return segments.segment(corpus(s, d), "body", "row_id")


@q("v09_breakdown")
def v09(s, d):
    return segments.breakdown(_spans(s, d), ["type", "subreddit"])


_Q50 = {"Direct_Quote_Of_Model": 9, "Paraphrase_Of_Model": 9, "Prompt_Reproduction": 8, "User_Original_Content": 9, "Moderation_Notice": 8}


@q("v11_quota_sample")
def v11(s, d):
    dom = segments.dominant(segments.segment(corpus(s, d), "body", "row_id"), "row_id").join(corpus(s, d).select("row_id", "subreddit"), "row_id")
    return segments.quota_sample(dom, "row_id", "dominant", _Q50, 50, boost=F.col("subreddit") == "storyforge")


_Q70 = {"Direct_Quote_Of_Model": 15, "Paraphrase_Of_Model": 15, "Prompt_Reproduction": 10, "User_Original_Content": 15, "Moderation_Notice": 10}
_Q70_SQL = "CASE label " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _Q70.items()) + " ELSE 0 END"


@q("v12_quota_sample", f"WITH {_ROWS}, g AS (SELECT label, type, greatest(1, floor({_Q70_SQL} * count(*) / sum(count(*)) OVER (PARTITION BY label))) AS q FROM l GROUP BY label, type), r AS (SELECT l.*, q, row_number() OVER (PARTITION BY l.label, l.type ORDER BY md5('42|' || row_id), row_id) AS r FROM l JOIN g ON l.label = g.label AND l.type IS NOT DISTINCT FROM g.type), t AS (SELECT row_id, label, type, CASE WHEN r <= q THEN 1 WHEN coalesce(subreddit = 'storyforge', false) THEN 2 ELSE 3 END AS stage FROM r) SELECT * FROM t ORDER BY stage, md5('42|' || row_id), row_id LIMIT 70")
def v12(s, d):
    return segments.quota_sample(_labels(s, d), "row_id", "label", _Q70, 70, boost=F.col("subreddit") == "storyforge", split="type").select("row_id", "label", "type", "stage")


@q("v13_label_distribution", f"WITH {_ROWS} SELECT type, label, confidence, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM l GROUP BY ALL")
def v13(s, d):
    g = _labels(s, d).groupBy("type", "label", "confidence").agg(F.count(F.lit(1)).alias("n"))
    return attach(g, g.agg(F.sum("n").alias("all"))).select("type", "label", "confidence", "n", F.round(100.0 * F.col("n") / F.col("all"), 2).alias("pct"))


@q("r08_lookup_last_wins", f"WITH m AS (SELECT post_id AS k, arg_max(subreddit, row_id) AS subreddit FROM (SELECT * FROM {C} WHERE subreddit IS NOT NULL AND post_id IS NOT NULL) GROUP BY post_id) SELECT row_id, coalesce(m.subreddit, 'unknown') AS subreddit FROM memory_lcr_candidates c LEFT JOIN m ON c.post_id = m.k")
def r08(s, d):
    known = corpus(s, d).where("subreddit IS NOT NULL AND post_id IS NOT NULL")
    return relational.lookup(table(s, d, "memory_lcr_candidates").select("row_id", "post_id"), known, "post_id", "row_id", ["subreddit"]).select("row_id", "subreddit")


@q("r09_change_flags", f"WITH a AS (SELECT post_id AS k, arg_max(type, row_id) AS type, arg_max(source, row_id) AS source FROM {C} WHERE post_id IS NOT NULL AND row_id % 2 = 0 AND type IS NOT NULL AND source IS NOT NULL GROUP BY post_id) SELECT c.row_id, CASE WHEN a.type IS DISTINCT FROM c.type THEN 'yes' ELSE 'no' END AS type_changed, CASE WHEN a.source IS DISTINCT FROM c.source THEN 'yes' ELSE 'no' END AS source_changed FROM {C} c JOIN a ON c.post_id = a.k WHERE c.row_id % 2 = 1")
def r09(s, d):
    """Rows of odd id against the last row of even id and the same post, as two versions of one table."""
    c = corpus(s, d).select("row_id", "post_id", "type", "source")
    old = c.where("row_id % 2 = 0 AND type IS NOT NULL AND source IS NOT NULL")
    return relational.change_flags(c.where("row_id % 2 = 1"), old, "post_id", "row_id", ["type", "source"]).select("row_id", "type_changed", "source_changed")


@q("t05_counts_before_dedupe", f"SELECT term, count(*) AS hits, count(DISTINCT key) AS messages FROM (SELECT DISTINCT row_id, coalesce(comment_id, post_id) AS key, term FROM {C} c JOIN seed_terms_round_2 t ON contains(lower(c.body), lower(t.term))) GROUP BY term")
def t05(s, d):
    """Hits of each term in all deliveries, and in how many messages."""
    rows = corpus(s, d).select(F.coalesce("comment_id", "post_id").alias("key"), "body")
    hits = tagging.tag(rows, "body", tagging.read_terms(table(s, d, "seed_terms_round_2"))).select("key", F.explode("matched").alias("term"))
    return hits.groupBy("term").agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("key").alias("messages"))


_TERMS = "t AS (SELECT DISTINCT term, pattern_type FROM seed_terms_round_2), h AS (SELECT term, count(*) AS n, avg(CASE WHEN contains(lower(body), 'seek professional help') OR contains(lower(body), 'talk to a therapist') THEN 1.0 ELSE 0.5 END) AS p FROM (SELECT DISTINCT row_id, body, term FROM lcr_pass1b_canonical c JOIN seed_terms_round_2 s ON contains(lower(c.body), lower(s.term))) GROUP BY term)"
_CELL = "CASE WHEN coalesce(n, 0) = 0 THEN 'no corpus matches' WHEN contains(lower(pattern_type), 'reaction') OR contains(lower(pattern_type), 'grammat') THEN 'n/a (verbatim)' ELSE CAST(CAST(round_even(p * n, 0) AS BIGINT) AS VARCHAR) || '/' || n END"


def _term_hits(s, d):
    terms = table(s, d, "seed_terms_round_2")
    code, _ = tagging.auto_code(F.col("body"), ["seek professional help", "talk to a therapist"])
    tagged = tagging.tag(corpus(s, d).select("row_id", "body"), "body", tagging.read_terms(terms)).select(code.alias("code"), F.explode("matched").alias("term"))
    hits = tagged.groupBy("term").agg(F.count(F.lit(1)).alias("n"), tagging.precision(F.col("code")).alias("p"))
    anchor = clean.contains_any(F.col("pattern_type"), ["reaction", "grammat"])
    joined = terms.select("term", "pattern_type").distinct().join(hits, "term", "left")
    cell = F.when(F.coalesce("n", F.lit(0)) == 0, "no corpus matches").when(anchor, "n/a (verbatim)").otherwise(F.concat(F.bround(F.col("p") * F.col("n"), 0).cast("long").cast("string"), F.lit("/"), F.col("n").cast("string")))
    return joined.select("term", F.when(anchor, "retrieval_anchor").otherwise("validated_detector").alias("function"), tagging.shape(F.col("term")).alias("shape"), F.coalesce("n", F.lit(0)).alias("hits"), cell.alias("cell"), F.round("p", 4).alias("prec"))


@q("t12_k_of_n", f"WITH {_TERMS} SELECT term, coalesce(n, 0) AS hits, {_CELL} AS cell FROM t LEFT JOIN h USING (term)")
def t12(s, d):
    """How many of a term's hits are true, by the automatic code of the rows it hits; anchors and terms without hits have no share."""
    return _term_hits(s, d).select("term", "hits", "cell")


@q("rp03_term_table", f"WITH {_TERMS} SELECT row_number() OVER (ORDER BY round(p, 4) DESC NULLS LAST, coalesce(n, 0) DESC, term) AS place, term, CASE WHEN contains(lower(pattern_type), 'reaction') OR contains(lower(pattern_type), 'grammat') THEN 'retrieval_anchor' ELSE 'validated_detector' END AS function, CASE WHEN len(regexp_split_to_array(trim(term), '\\s+')) >= 4 THEN 'phrasal (long)' WHEN len(regexp_split_to_array(trim(term), '\\s+')) >= 2 THEN 'phrasal' WHEN contains(term, '-') THEN 'compound' ELSE 'unigram' END AS shape, {_CELL} AS cell FROM t LEFT JOIN h USING (term)")
def p03(s, d):
    """Function, shape, share of true hits and place of every term: T10 to T13 together."""
    return relational.global_rank(_term_hits(s, d), [F.col("prec").desc_nulls_last(), F.desc("hits"), F.col("term")]).select("place", "term", "function", "shape", "cell")


_P = ["(?is)posted by a script", "(?is)treat(?:s|ed) me like", "(?is)diagnosed me", "(?is)changed its tone", "(?is)refused to \\w+", "(?is)warning"]
_WHICH = "CASE " + " ".join(f"WHEN regexp_matches(body, '{p}') THEN {i}" for i, p in enumerate(_P)) + " END"
_MATCH = "CASE " + " ".join(f"WHEN regexp_matches(body, '{p}') THEN regexp_extract(body, '{p}')" for p in _P) + " END"


@q("x02_priority_search", f"WITH m AS (SELECT row_id, body, {_WHICH} AS pattern_id, {_MATCH} AS match FROM {C} WHERE body IS NOT NULL), a AS (SELECT *, strpos(body, match) AS p FROM m WHERE pattern_id IS NOT NULL) SELECT row_id, pattern_id, match, substring(body, greatest(p - 200, 1), p + length(match) + 200 - greatest(p - 200, 1)) AS context FROM a")
def x02(s, d):
    """The first of six patterns that matches, and 200 characters around its match."""
    return tagging.priority(corpus(s, d), "body", _P, ["row_id"], context=200)


@q("x04_evidence")
def x04(s, d):
    return tagging.excerpts(corpus(s, d), "body", "row_id", tagging.read_terms(table(s, d, "seed_terms_round_2")))


@q("x05_phrase_window", f"WITH t AS (SELECT row_id, list_filter(regexp_split_to_array(trim(regexp_replace(coalesce(body, ''), 'https?://\\S+|www\\.\\S+', ' ', 'g')), '[ \\t\\r\\n]+'), lambda x: x <> '') AS w FROM {C}), p AS (SELECT row_id, w, unnest(range(len(w))) AS i FROM t), h AS (SELECT row_id, i, array_to_string(w[greatest(i - 4, 1):i + 6], ' ') AS near FROM p WHERE contains(lower(w[i + 1]), 'therapist')) SELECT row_id, i AS pos, near, regexp_matches(near, '(?i)\\b(?:talk to|see|seek|find|call) ') AS phrase FROM h")
def x05(s, d):
    """Each token that holds a seed, with five tokens on either side, and whether an urging phrase stands among them."""
    t = tokens.raw_tokens(F.col("body"))
    hit = corpus(s, d).select("row_id", t.alias("w")).select("row_id", "w", F.posexplode("w").alias("pos", "x")).where(F.contains(F.lower("x"), F.lit("therapist")))
    near = F.array_join(F.slice("w", F.greatest(F.col("pos") - 4, F.lit(1)), F.least(F.col("pos") + 6, F.size("w")) - F.greatest(F.col("pos") - 4, F.lit(1)) + 1), " ")
    return hit.select("row_id", "pos", near.alias("near")).withColumn("phrase", F.col("near").rlike(r"(?i)\b(?:talk to|see|seek|find|call) "))


_RAW_SQL = "list_filter(regexp_split_to_array(trim(regexp_replace(coalesce({c}, ''), 'https?://\\S+|www\\.\\S+', ' ', 'g')), '[ \\t\\r\\n]+'), lambda x: x <> '')"


@q("f04_sense_tokens", f"SELECT row_id, len(w) AS n, nullif(array_to_string(w, ' '), '') AS joined FROM (SELECT row_id, {_RAW_SQL.format(c='body')} AS w FROM {C})")
def f04(s, d):
    t = tokens.raw_tokens(F.col("body"))
    return corpus(s, d).select("row_id", F.size(t).alias("n"), F.nullif(F.array_join(t, " "), F.lit("")).alias("joined"))


_DOMAIN = ("claude", "model", "assistant", "chat", "bot")


@q("f03_content_tokens_whole", f"SELECT row_id, len(list_filter({LOOSE}, lambda x: length(x) >= 3 AND x NOT IN ({', '.join(repr(w) for w in (*tokens.STOPWORDS, *_DOMAIN))}))) AS n FROM {C}")
def f03(s, d):
    """Tokenizer B without stop words and words of the domain, three letters or more."""
    kept = F.filter(tokens.loose_words(F.col("body")), lambda x: (F.length(x) >= 3) & ~x.isin(*tokens.STOPWORDS, *_DOMAIN))
    return corpus(s, d).select("row_id", F.size(kept).alias("n"))


# sense contexts

_SENSE = f"WITH t AS MATERIALIZED (SELECT row_id, type, {_RAW_SQL.format(c='body')} AS w FROM {C}), s AS MATERIALIZED (SELECT term AS seed, list_transform({_RAW_SQL.format(c='term')}, lambda x: lower(x)) AS st FROM (SELECT DISTINCT term FROM seed_terms_round_2)), p AS (SELECT row_id, type, w, unnest(range(len(w))) AS i FROM t), h AS MATERIALIZED (SELECT row_id, type, w, i, seed, len(st) AS n FROM p JOIN s ON lower(w[i + 1]) = st[1] AND list_transform(w[i + 1:i + len(st)], lambda x: lower(x)) = st) "


def _sense(s, d, compat=False):
    seeds = table(s, d, "seed_terms_round_2").select(F.col("term").alias("seed")).distinct()
    return tokens.sense_contexts(corpus(s, d), "body", seeds, ["row_id", "type"], compat=compat)


@q("d01_sense_contexts", _SENSE + "SELECT row_id, seed, i AS pos, array_to_string(w[i + 1:i + n], ' ') AS seed_token, array_to_string(w[greatest(i - 19, 1):i], ' ') AS left_context, array_to_string(w[i + n + 1:i + n + 20], ' ') AS right_context FROM h")
def d01(s, d):
    return _sense(s, d).select("row_id", "seed", "pos", "seed_token", "left_context", "right_context")


@q("d02_sense_contexts_compat", _SENSE + "SELECT row_id, seed, greatest(i - 1, 0) AS pos, w[greatest(i - 1, 0) + 1] AS seed_token FROM h")
def d02(s, d):
    """The centre one token to the left of the seed, as the second variant has it."""
    return _sense(s, d, compat=True).select("row_id", "seed", "pos", "seed_token")


@q("d03_support", _SENSE + ", c AS (SELECT seed, count(*) AS hits FROM h GROUP BY seed) SELECT term AS seed, coalesce(hits, 0) AS hits, CASE WHEN coalesce(hits, 0) = 0 THEN 'skipped' WHEN hits < 50 THEN 'too few' ELSE 'kept' END AS status FROM (SELECT DISTINCT term FROM seed_terms_round_2) LEFT JOIN c ON term = seed")
def d03(s, d):
    seeds = table(s, d, "seed_terms_round_2").select(F.col("term").alias("seed")).distinct()
    return clusters.support(seeds, _sense(s, d), "seed", 50)


_CFG = "SELECT vec_id, model, mcs, CASE WHEN (vec_id * 7 + mcs) % 11 = 0 THEN -1 WHEN model = 'a' THEN label % mcs ELSE (label + CASE WHEN vec_id % 5 = 0 THEN 1 ELSE 0 END) % mcs END AS cluster FROM embeddings, (SELECT unnest(['a', 'b']) AS model), (SELECT unnest([5, 10, 20]) AS mcs)"
_ARI = f"c AS MATERIALIZED ({_CFG}), n AS (SELECT a.model AS ma, a.mcs AS sa, b.model AS mb, b.mcs AS sb, a.cluster AS x, b.cluster AS y, count(*)::DOUBLE AS n FROM c a JOIN c b USING (vec_id) WHERE (a.model, a.mcs) < (b.model, b.mcs) AND a.cluster <> -1 AND b.cluster <> -1 GROUP BY ALL), s AS (SELECT ma, sa, mb, sb, sum(n * (n - 1) / 2) AS s, sum(n) AS n FROM n GROUP BY ALL), r AS (SELECT ma, sa, mb, sb, sum(n * (n - 1) / 2) AS r FROM (SELECT ma, sa, mb, sb, x, sum(n) AS n FROM n GROUP BY ALL) GROUP BY ALL), k AS (SELECT ma, sa, mb, sb, sum(n * (n - 1) / 2) AS k FROM (SELECT ma, sa, mb, sb, y, sum(n) AS n FROM n GROUP BY ALL) GROUP BY ALL), p AS (SELECT ma, sa, mb, sb, round((s - r * k / (n * (n - 1) / 2)) / ((r + k) / 2 - r * k / (n * (n - 1) / 2)), 4) AS ari FROM s JOIN r USING (ma, sa, mb, sb) JOIN k USING (ma, sa, mb, sb))"


def _configs(s, d):
    """Six clusterings of one table, made from its labels, so that the agreement measures have something to measure."""
    e = table(s, d, "embeddings").select("vec_id", "label")
    c = e.select("*", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("model")).select("*", F.explode(F.array(*[F.lit(k) for k in (5, 10, 20)])).alias("mcs"))
    moved = F.col("label") + F.when(F.col("vec_id") % 5 == 0, 1).otherwise(0)
    return c.select("vec_id", "model", "mcs", F.when((F.col("vec_id") * 7 + F.col("mcs")) % 11 == 0, -1).when(F.col("model") == "a", F.col("label") % F.col("mcs")).otherwise(moved % F.col("mcs")).alias("cluster"))


@q("d07_ari_matrix", f"WITH {_ARI} SELECT ma AS model_a, sa AS mcs_a, mb AS model_b, sb AS mcs_b, ari FROM p")
def d07(s, d):
    """Every two configurations, items that are noise in either left out."""
    return clusters.ari_matrix(_configs(s, d), "vec_id", "model", "mcs", "cluster")


@q("d09_ari_means", f"WITH {_ARI} SELECT CASE WHEN ma <> mb THEN 'cross' ELSE 'within' END AS kind, round(avg(ari), 4) AS mean_ari, count(*) AS pairs FROM p WHERE ma = mb OR sa = sb GROUP BY 1")
def d09(s, d):
    """Mean of the pairs of two models at one size, and of the pairs of sizes in one model."""
    return clusters.ari_means(clusters.ari_matrix(_configs(s, d), "vec_id", "model", "mcs", "cluster"))


@q("d10_verdict", f"WITH {_ARI}, z AS (SELECT model, mcs, count(DISTINCT cluster) FILTER (WHERE cluster <> -1) AS clusters FROM c GROUP BY model, mcs), x AS (SELECT sa AS mcs, ari FROM p WHERE ma <> mb AND sa = sb) SELECT model, mcs, clusters, ari, CASE WHEN clusters <= 1 OR ari < 0.2 THEN 'FALSIFIED' WHEN ari >= 0.4 THEN 'WORKS' ELSE 'INCONCLUSIVE' END AS verdict FROM z JOIN x USING (mcs)")
def d10(s, d):
    """The verdict on each configuration by its number of clusters and the agreement of both models at its size."""
    c = _configs(s, d)
    sizes = c.groupBy("model", "mcs").agg(F.count_distinct(F.when(F.col("cluster") != -1, F.col("cluster"))).alias("clusters"))
    cross = clusters.ari_matrix(c, "vec_id", "model", "mcs", "cluster").where("model_a <> model_b AND mcs_a = mcs_b").select(F.col("mcs_a").alias("mcs"), "ari")
    return sizes.join(cross, "mcs").select("model", "mcs", "clusters", "ari", clusters.verdict(F.col("clusters"), F.col("ari")).alias("verdict"))


@q("d12_cluster_features", f"WITH r AS (SELECT coalesce(subreddit, 'unknown') AS cluster, type, source, contains(body, '```') OR regexp_matches(body, '(?m)^    \\S') AS code, regexp_matches(body, '(?i)\\b(?:seek|talk to|get) \\w+') AS urging FROM {C} WHERE body IS NOT NULL), g AS (SELECT cluster, source, count(*) AS n FROM r WHERE source IS NOT NULL GROUP BY ALL) SELECT cluster, count(*) AS n, round(avg(code::INT), 4) AS code_share, round(avg(urging::INT), 4) AS urging_share, round(avg(coalesce(type = 'post', false)::INT), 4) AS post_share, (SELECT arg_max(source, (n, source)) FROM g WHERE g.cluster = r.cluster) AS dominant, (SELECT string_agg(source || ':' || n, ',' ORDER BY source) FROM g WHERE g.cluster = r.cluster) AS distribution FROM r GROUP BY cluster")
def d12(s, d):
    """Features of the rows of each group: size, shares of flags and of posts, dominant source and its distribution."""
    rows = corpus(s, d).where("body IS NOT NULL").select(F.coalesce("subreddit", F.lit("unknown")).alias("cluster"), "type", "source", (F.contains("body", F.lit("```")) | F.col("body").rlike(r"(?m)^    \S")).alias("code_share"), F.col("body").rlike(r"(?i)\b(?:seek|talk to|get) \w+").alias("urging_share"), F.coalesce(F.col("type") == "post", F.lit(False)).alias("post_share"))
    return clusters.features(rows, "cluster", ["code_share", "urging_share", "post_share"], "source")


# sinks and graphs

@q("s13_adjacency", f"WITH {_graph_sql()}, k AS (SELECT term FROM ed ORDER BY degree DESC, term LIMIT 200), b AS (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e) SELECT x.term AS src, y.term AS dst, coalesce(weight, 0) AS weight FROM k x, k y LEFT JOIN b ON b.src = x.term AND b.dst = y.term")
def s13(s, d):
    """The adjacency matrix of the 200 terms of the highest degree, one row a cell."""
    return graph.adjacency(materialize(whole_edges(s, d), "edges"), 200)


@q("k05_duplicate_posts", f"WITH p AS (SELECT row_id, trim(lower(substring(coalesce(body, ''), 1, 200))) AS k FROM {C} WHERE type = 'post'), g AS (SELECT k, count(*) AS c, min(row_id) AS example FROM p GROUP BY k) SELECT k AS prefix, c AS copies, example FROM g WHERE c > 1 ORDER BY c DESC, k LIMIT 5")
def k05(s, d):
    """The five prefixes of posts that most posts share, each with an example."""
    return graph.prefix_examples(corpus(s, d).where("type = 'post'"), "body", "row_id", 5)


@q("k14_ego_status", f"WITH {_E}, s AS (SELECT DISTINCT unnest(string_split(lower(term), ' ')) AS term FROM seed_terms_round_2), f AS (SELECT s.term, coalesce(n, 0) AS df, ed.degree FROM s LEFT JOIN ev ON ev.term = s.term LEFT JOIN ed ON ed.term = s.term) SELECT term, df, CASE WHEN df < 100 THEN 'too rare' WHEN degree IS NULL THEN 'no edge' ELSE 'built' END AS status, CASE WHEN df >= 100 THEN coalesce(degree, 0) ELSE 0 END AS neighbours FROM f")
def k14(s, d):
    """Which words of the seeds get a graph of their own, and why the others don't."""
    words = table(s, d, "seed_terms_round_2").select(F.explode(F.split(F.lower("term"), " ")).alias("term")).distinct()
    voc = graph.vocabulary(corpus(s, d).select(tokens.content(tokens.loose_words(F.col("body"))).alias("w")), F.col("w"))
    return graph.ego_status(words, voc, graph.degrees(whole_edges(s, d)), 100)


@q("s18_state_join", f"WITH t AS (SELECT case_id, row_id FROM round_1_positive_cases), j AS (SELECT case_id, source_csv AS source, string_split(seed_terms_matched, '|') AS terms FROM round_1_positive_cases WHERE row_id % 3 <> 0) SELECT t.case_id, j.source, array_to_string(j.terms, '|') AS terms, j.source IS NOT NULL AND j.terms IS NOT NULL AS complete FROM t LEFT JOIN j USING (case_id)")
def s18(s, d):
    """Template rows joined to a state of one JSON document a case; lists come back joined by bars, and incomplete rows are told."""
    cases = table(s, d, "round_1_positive_cases")
    state = cases.where("row_id % 3 <> 0").select("case_id", F.to_json(F.struct(F.col("source_csv").alias("source"), F.split("seed_terms_matched", r"\|").alias("terms"))).alias("state"))
    return sinks.fill_from_state(cases.select("case_id"), state, "case_id", "state", {"source": "string", "terms": "array<string>"})


@q("s10_jsonl", f"SELECT row_id, to_json(struct_pack(row_id := row_id, type := type, n := length(body))) AS line FROM (SELECT row_id, coalesce(type, '') AS type, coalesce(body, '') AS body FROM {C})")
def s10(s, d):
    """Rows as JSON lines, as the sink writes them."""
    rows = corpus(s, d).select("row_id", F.coalesce("type", F.lit("")).alias("type"), F.length(F.coalesce("body", F.lit(""))).alias("n"))
    return rows.select("row_id", sinks.json_line(rows.columns).alias("line"))


# reports

@q("rp02_signature_nested", "WITH c AS (SELECT source_csv IS NOT NULL AS sourced, regexp_matches(coalesce(why_positive, ''), '(?i)refus') AS refused, regexp_matches(coalesce(full_context, ''), '(?i)therap|professional') AS advised FROM round_1_positive_cases), a AS (SELECT count(*) AS n, count_if(sourced) AS s, count_if(refused) AS r, count_if(refused AND advised) AS ra, count_if(refused AND NOT advised) AS rn FROM c) SELECT 'sourced' AS property, s AS k, n AS of FROM a UNION ALL SELECT 'refused', r, n FROM a UNION ALL SELECT 'refused and advised', ra, r FROM a UNION ALL SELECT 'refused, not advised', rn, r FROM a")
def p02(s, d):
    """Counts over the cases, the last two among those that the line before counts."""
    c = table(s, d, "round_1_positive_cases").select(F.col("source_csv").isNotNull().alias("s"), F.coalesce("why_positive", F.lit("")).rlike("(?i)refus").alias("r"), F.coalesce("full_context", F.lit("")).rlike("(?i)therap|professional").alias("a"))
    one = c.agg(F.count(F.lit(1)).alias("n"), F.count_if("s").alias("s"), F.count_if("r").alias("r"), F.count_if(F.col("r") & F.col("a")).alias("ra"), F.count_if(F.col("r") & ~F.col("a")).alias("rn"))
    line = lambda name, k, of: F.struct(F.lit(name).alias("property"), F.col(k).alias("k"), F.col(of).alias("of"))
    return one.select(F.inline(F.array(line("sourced", "s", "n"), line("refused", "r", "n"), line("refused and advised", "ra", "r"), line("refused, not advised", "rn", "r"))))


_CATS = [("care", "therapist"), ("care", "professional"), ("care", "wellbeing"), ("memory", "remember"), ("memory", "memory"), ("memory", "sessions"), ("tone", "calm"), ("tone", "cold"), ("tone", "warning"), ("tone", "tone")]
_CAT_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _CATS) + ") AS m(category, term)"


@q("rp04_category_rates", f"WITH w AS (SELECT type, unnest({STRICT_BODY}) AS term FROM {C} WHERE type IS NOT NULL), t AS (SELECT type, count(*) AS total FROM w GROUP BY type), n AS (SELECT type, term, count(*) AS n FROM w JOIN (SELECT term FROM {_CAT_SQL}) USING (term) GROUP BY type, term) SELECT category, type AS stratum, sum(coalesce(n, 0)) AS n, round(sum(coalesce(n, 0)) * 1000.0 / any_value(total), 4) AS per_1k FROM {_CAT_SQL} CROSS JOIN t LEFT JOIN n USING (type, term) GROUP BY category, type")
def p04(s, d):
    """Rates of the categories of a dimension table by stratum; a category without a hit has the rate 0."""
    dim = s.createDataFrame(_CATS, "category string, term string")
    f = tokens.frequency(corpus(s, d).where("type IS NOT NULL"), tokens.strict_words(F.col("body")), ["type"])
    return tokens.category_rates(f, dim, "type").withColumnRenamed("type", "stratum")


_CODES = [("high", 2), ("medium", 1), ("low", 0)]


@q("rp08_coded_matrix", "WITH u AS (SELECT term, 'pattern_type' AS property, pattern_type AS value FROM seed_terms_round_2 UNION ALL SELECT term, 'confidence', confidence FROM seed_terms_round_2) SELECT term, property, value, CASE value WHEN 'high' THEN 2 WHEN 'medium' THEN 1 WHEN 'low' THEN 0 ELSE -1 END AS code FROM u")
def p08(s, d):
    """Term by property, with the code of each value; values without one have -1."""
    long = table(s, d, "seed_terms_round_2").unpivot("term", ["pattern_type", "confidence"], "property", "value")
    codes = broadcast_checked(s.createDataFrame(_CODES, "value string, code int"))
    return long.join(codes, "value", "left").select("term", "property", "value", F.coalesce("code", F.lit(-1)).alias("code"))


@q("rp10_validity", "WITH m AS (SELECT case_id, string_split(coalesce(seed_terms_matched, ''), '|') AS terms, source_csv, why_positive FROM round_1_positive_cases) SELECT case_id, CASE WHEN source_csv IS NOT NULL THEN why_positive END AS why_positive, NOT (list_contains(terms, 'null') AND len(terms) > 1) AS valid FROM m")
def p10(s, d):
    """A field that depends on another is null without it, and the exclusive value of a multiple choice may not stand beside others."""
    cases = table(s, d, "round_1_positive_cases")
    return relational.routed(cases.select("case_id", "source_csv", "why_positive", F.split(F.coalesce("seed_terms_matched", F.lit("")), r"\|").alias("terms")), {"why_positive": "source_csv"}, ("terms", "null")).select("case_id", "why_positive", "valid")

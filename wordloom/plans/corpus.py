"""Queries over the corpus operators, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.operators import clean, clusters, graph, relational, segments, tagging, tokens
from wordloom.plans.catalog import Catalog, table, texts
from wordloom.storage import attach, materialize

catalog = Catalog()
q = catalog.add

C = "lcr_pass1b_canonical"
WORDS = "list_filter(regexp_split_to_array(lower(regexp_replace(coalesce({c}, ''), 'https?://\\S+|www\\.\\S+|\\[[^\\]]*\\]\\([^)]*\\)', ' ', 'g')), '[^a-z]+'), lambda x: length(x) >= 3)"
BODY, TEXT = WORDS.format(c="body"), WORDS.format(c="text")
STOP = ", ".join(f"'{w}'" for w in tokens.STOPWORDS)
STUB = "(body IS NULL OR trim(body) = '' OR (regexp_extract(body, '(?i)(\\[removed\\]|\\[deleted\\]|removed by moderator|deleted by user)', 1) <> '' AND length(trim(body)) - length(regexp_extract(body, '(?i)(\\[removed\\]|\\[deleted\\]|removed by moderator|deleted by user)', 1)) < 200))"
MS = "TIMESTAMP '2025-09-29 00:00:00'"


def corpus(s: SparkSession, d: str) -> DataFrame:
    return texts(s, d, C)


def docs(s: SparkSession, d: str) -> DataFrame:
    return texts(s, d, "documents")




@q("c03_unescape", f"SELECT row_id, replace(replace(replace(replace(replace(replace(replace(body, '\\', ''), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS body FROM {C}")
def c03(s, d):
    return corpus(s, d).select("row_id", clean.unescape(F.col("body")).alias("body"))


@q("c04_strip_urls", f"SELECT row_id, trim(regexp_replace(regexp_replace(body, 'https?://\\S+|www\\.\\S+|\\[[^\\]]*\\]\\([^)]*\\)', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) AS body FROM {C}")
def c04(s, d):
    return corpus(s, d).select("row_id", clean.collapse(clean.strip_urls(F.col("body"))).alias("body"))


@q("c05_min_length", f"SELECT row_id FROM {C} WHERE length(body) > 30")
def c05(s, d):
    return clean.longer_than(corpus(s, d), "body").select("row_id")


@q("c06_prefilter", f"SELECT row_id FROM {C} WHERE contains(lower(coalesce(body, '')), 'professional help') OR contains(lower(coalesce(body, '')), 'therapist') OR contains(lower(coalesce(body, '')), 'grounded in')")
def c06(s, d):
    return corpus(s, d).where(clean.contains_any(F.col("body"), ["professional help", "therapist", "grounded in"])).select("row_id")


@q("c07_stub_flag", f"SELECT row_id, {STUB} AS is_stub FROM {C}")
def c07(s, d):
    return corpus(s, d).select("row_id", clean.is_stub(F.col("body")).alias("is_stub"))


@q("c08_slug", "SELECT term, substring(regexp_replace(regexp_replace(lower(term), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 60) AS slug FROM seed_terms_round_2")
def c08(s, d):
    return table(s, d, "seed_terms_round_2").select("term", clean.slug(F.col("term")).alias("slug"))


@q("c10_flat_prefix", f"SELECT row_id, substring(replace(body, chr(10), ' | '), 1, 200) AS flat FROM {C}")
def c10(s, d):
    return corpus(s, d).select("row_id", F.substring(clean.flat(F.col("body"), " | "), 1, 200).alias("flat"))


@q("c13_pointer", "SELECT row_id, CASE WHEN regexp_matches(post_id, '^(\\S+)\\s*\\((.+)\\)\\s*$') THEN regexp_extract(post_id, '^(\\S+)\\s*\\((.+)\\)\\s*$', 1) ELSE post_id END AS id, CASE WHEN regexp_matches(post_id, '^(\\S+)\\s*\\((.+)\\)\\s*$') THEN regexp_extract(post_id, '^(\\S+)\\s*\\((.+)\\)\\s*$', 2) END AS hint FROM round_1_positive_cases")
def c13(s, d):
    return table(s, d, "round_1_positive_cases").select("row_id", clean.pointer(F.col("post_id")).alias("p")).select("row_id", "p.id", "p.hint")


@q("r01_union", f"SELECT row_id, subreddit, body AS text FROM {C} UNION ALL SELECT row_id, subreddit, context FROM memory_lcr_candidates UNION ALL SELECT row_id, subreddit, context FROM yield_search_candidates")
def r01(s, d):
    parts = [table(s, d, t).select("row_id", "subreddit", F.col(c).alias("text")) for t, c in ((C, "body"), ("memory_lcr_candidates", "context"), ("yield_search_candidates", "context"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@q("r02_keep_first", f"SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY type, comment_id, post_id, body ORDER BY row_id) AS n FROM {C}) WHERE n = 1")
def r02(s, d):
    return relational.keep_first(corpus(s, d).select("row_id", "type", "comment_id", "post_id", "body"), ["type", "comment_id", "post_id", "body"], ["row_id"]).select("row_id")


@q("r04_provenance_merge", f"SELECT post_id, string_agg(DISTINCT retrieval_provenance, '|' ORDER BY retrieval_provenance) AS retrieval_provenance, arg_min(subreddit, row_id) FILTER (WHERE subreddit IS NOT NULL) AS subreddit FROM {C} WHERE post_id IS NOT NULL GROUP BY post_id")
def r04(s, d):
    m = relational.merge_provenance(corpus(s, d), "post_id", "retrieval_provenance", "row_id", ["subreddit"])
    return m.withColumn("retrieval_provenance", F.nullif("retrieval_provenance", F.lit("")))


@q("r05_semi_filter", f"SELECT DISTINCT post_id FROM {C} WHERE type = 'post' AND r2_any_match AND post_id IS NOT NULL")
def r05(s, d):
    return corpus(s, d).where("type = 'post' AND r2_any_match AND post_id IS NOT NULL").select("post_id").distinct()


@q("r06_anti_join", f"SELECT row_id FROM memory_lcr_candidates m WHERE NOT EXISTS (SELECT 1 FROM {C} c WHERE c.post_id = m.post_id)")
def r06(s, d):
    return table(s, d, "memory_lcr_candidates").join(corpus(s, d).select("post_id"), "post_id", "left_anti").select("row_id")


@q("r07_semi_join", f"SELECT row_id FROM {C} WHERE type = 'comment' AND post_id IN (SELECT post_id FROM {C} WHERE type = 'post' AND r2_any_match)")
def r07(s, d):
    c = corpus(s, d)
    return c.where("type = 'comment'").join(c.where("type = 'post' AND r2_any_match").select("post_id"), "post_id", "left_semi").select("row_id")


@q("r08_lookup_join", f"SELECT row_id, coalesce(zone_name, 'unknown') AS zone_name FROM {C} LEFT JOIN feed_sources USING (source)")
def r08(s, d):
    return corpus(s, d).join(table(s, d, "feed_sources"), "source", "left").select("row_id", F.coalesce("zone_name", F.lit("unknown")).alias("zone_name"))


@q("r09_change_flags", f"SELECT m.row_id, CASE WHEN m.subreddit IS DISTINCT FROM c.subreddit THEN 'yes' ELSE 'no' END AS label_changed FROM memory_lcr_candidates m JOIN (SELECT post_id, max(subreddit) AS subreddit FROM {C} GROUP BY post_id) c USING (post_id)")
def r09(s, d):
    c = corpus(s, d).groupBy("post_id").agg(F.max("subreddit").alias("was"))
    return table(s, d, "memory_lcr_candidates").join(c, "post_id").select("row_id", F.when(F.col("subreddit").eqNullSafe(F.col("was")), "no").otherwise("yes").alias("label_changed"))


@q("r10_concat_records", "SELECT pattern_id, string_agg(coalesce(match, ''), ' || ' ORDER BY row_id) AS texts FROM yield_search_candidates GROUP BY pattern_id")
def r10(s, d):
    g = table(s, d, "yield_search_candidates").groupBy("pattern_id").agg(F.sort_array(F.collect_list(F.struct("row_id", F.coalesce("match", F.lit("")).alias("m")))).alias("l"))
    return g.select("pattern_id", F.array_join(F.transform("l", lambda x: x["m"]), " || ").alias("texts"))


@q("r13_strata", f"SELECT 'type' AS dim, type AS value, count(*) AS rows FROM {C} GROUP BY type UNION ALL SELECT 'subreddit', subreddit, count(*) FROM {C} GROUP BY subreddit UNION ALL SELECT 'r2_any_match', CAST(r2_any_match AS VARCHAR), count(*) FROM {C} GROUP BY r2_any_match")
def r13(s, d):
    return relational.strata(corpus(s, d), ["type", "subreddit", "r2_any_match"])


@q("r14_cut_counts", f"SELECT count_if(ingested_at < {MS}) AS pre, count_if(ingested_at >= {MS}) AS post, count_if(ingested_at IS NULL) AS untimed, min(ingested_at) AS first_ts, max(ingested_at) AS last_ts FROM {C}")
def r14(s, d):
    return relational.cut_counts(corpus(s, d), "ingested_at", "2025-09-29")


@q("r15_value_counts", f"SELECT source, count(*) AS rows FROM {C} GROUP BY source")
def r15(s, d):
    return corpus(s, d).groupBy("source").agg(F.count(F.lit(1)).alias("rows"))


@q("r16_stub_rate", f"SELECT subreddit, sum(CAST({STUB} AS INT)) AS hits, count(*) AS rows, round(avg(CAST({STUB} AS INT)), 4) AS rate FROM {C} GROUP BY subreddit")
def r16(s, d):
    return relational.rate_by(corpus(s, d), "subreddit", clean.is_stub(F.col("body")))


@q("r17_not_blank", f"SELECT row_id FROM {C} WHERE body IS NOT NULL AND trim(body) <> ''")
def r17(s, d):
    return corpus(s, d).where(F.col("body").isNotNull() & (F.trim(F.col("body")) != "")).select("row_id")


_TAGS = f"FROM {C} c JOIN seed_terms_round_2 t ON contains(lower(c.body), lower(t.term))"


@q("t02_term_tagging", f"SELECT row_id, string_agg(DISTINCT term, '|' ORDER BY term) AS matched {_TAGS} GROUP BY row_id")
def t02(s, d):
    t = tagging.tag(corpus(s, d).select("row_id", "body"), "body", tagging.read_terms(table(s, d, "seed_terms_round_2")))
    return t.where(F.size("matched") > 0).select("row_id", F.array_join(F.array_sort("matched"), "|").alias("matched"))


@q("t03_hit_counts", f"SELECT t.term, count(h.row_id) AS hits FROM (SELECT DISTINCT term FROM seed_terms_round_2) t LEFT JOIN (SELECT DISTINCT row_id, term {_TAGS}) h USING (term) GROUP BY t.term")
def t03(s, d):
    terms = table(s, d, "seed_terms_round_2")
    hits = tagging.tag(corpus(s, d).select("row_id", "body"), "body", tagging.read_terms(terms)).select(F.explode("matched").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("hits"))
    return terms.select("term").distinct().join(hits, "term", "left").select("term", F.coalesce("hits", F.lit(0)).alias("hits"))


@q("t04_first_match", f"SELECT row_id, min(term) AS retrieval_term FROM (SELECT row_id, term {_TAGS} WHERE t.confidence = 'high') GROUP BY row_id")
def t04(s, d):
    terms = [t for t in tagging.read_terms(table(s, d, "seed_terms_round_2")) if t["confidence"] == "high"]
    return tagging.first_match(tagging.tag(corpus(s, d).select("row_id", "body"), "body", terms)).select("row_id", "retrieval_term")


@q("t06_stratified_sample", f"WITH g AS (SELECT type, count(*) AS g, sum(count(*)) OVER () AS n FROM {C} GROUP BY type), r AS (SELECT row_id, type, md5('42|' || row_id) AS h, row_number() OVER (PARTITION BY type ORDER BY md5('42|' || row_id), row_id) AS r FROM {C}) SELECT r.row_id, r.type FROM r JOIN g ON r.type IS NOT DISTINCT FROM g.type ORDER BY CASE WHEN r.r > greatest(1, floor(least(30, n) * g / n)) THEN 1 ELSE 0 END, h, row_id LIMIT 30")
def t06(s, d):
    return relational.stratified_sample(corpus(s, d).select("row_id", "type"), "type", "row_id", 30)


@q("t08_precision", f"SELECT subreddit, round(avg(CASE WHEN body IS NULL OR trim(body) = '' THEN 0.0 WHEN contains(lower(body), 'seek professional help') OR contains(lower(body), 'talk to a therapist') THEN 1.0 ELSE 0.5 END), 4) AS prec FROM {C} GROUP BY subreddit")
def t08(s, d):
    code, _ = tagging.auto_code(F.col("body"), ["seek professional help", "talk to a therapist"])
    return corpus(s, d).groupBy("subreddit").agg(F.round(tagging.precision(code), 4).alias("prec"))


@q("t11_term_shape", "SELECT term, CASE WHEN len(regexp_split_to_array(trim(term), '\\s+')) >= 4 THEN 'phrasal (long)' WHEN len(regexp_split_to_array(trim(term), '\\s+')) >= 2 THEN 'phrasal' WHEN contains(term, '-') THEN 'compound' ELSE 'unigram' END AS shape FROM seed_terms_round_2")
def t11(s, d):
    return table(s, d, "seed_terms_round_2").select("term", tagging.shape(F.col("term")).alias("shape"))


_A, _B = "(?i)across sessions|from an earlier chat|saved memory", "(?i)professional help|therapist|grounded in reality"


@q("x01_proximity", f"WITH m AS (SELECT row_id, body, strpos(body, regexp_extract(body, '{_A}')) AS a, strpos(body, regexp_extract(body, '{_B}')) AS b, regexp_extract(body, '{_A}') AS match_a, regexp_extract(body, '{_B}') AS match_b FROM {C} WHERE regexp_matches(body, '{_A}') AND regexp_matches(body, '{_B}')) SELECT row_id, match_a, match_b, substring(body, greatest(least(a, b) - 150, 1), least(greatest(a + length(match_a), b + length(match_b)) - 1 + 150, length(body)) - greatest(least(a, b) - 150, 1) + 1) AS context FROM m WHERE abs(a - b) <= 1500")
def x01(s, d):
    return tagging.proximity(corpus(s, d), "body", _A, _B, keep=["row_id"])


@q("x03_pattern_counts", "SELECT pattern_id, count(*) AS n FROM yield_search_candidates GROUP BY pattern_id")
def x03(s, d):
    return table(s, d, "yield_search_candidates").groupBy("pattern_id").agg(F.count(F.lit(1)).alias("n"))


@q("x04_merge_intervals", "WITH w AS (SELECT user_id, epoch(ts)::BIGINT - 1100 AS lo, epoch(ts)::BIGINT + 500 AS hi FROM events), r AS (SELECT *, max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM w), i AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS isle FROM r) SELECT user_id, min(lo) AS lo, max(hi) AS hi FROM i GROUP BY user_id, isle")
def x04(s, d):
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000 + 0.5)
    return tagging.merge_intervals(table(s, d, "events").select("user_id", (at - 1100).alias("lo"), (at + 500).alias("hi")), "user_id", "lo", "hi")


@q("x05_feature_flags", f"SELECT row_id, contains(body, '```') OR regexp_matches(body, '(?m)^    \\S') AS has_code, regexp_matches(body, '(?i)\\b(?:seek|talk to|get) \\w+') AS imperative FROM {C}")
def x05(s, d):
    return corpus(s, d).select("row_id", (F.contains(F.col("body"), F.lit("```")) | F.col("body").rlike(r"(?m)^    \S")).alias("has_code"), F.col("body").rlike(r"(?i)\b(?:seek|talk to|get) \w+").alias("imperative"))


_FREQ = f"SELECT term, count(*) AS n FROM (SELECT unnest({BODY}) AS term FROM {C}) GROUP BY term"


@q("f01_token_counts", f"SELECT row_id, len({BODY}) AS n_tokens FROM {C}")
def f01(s, d):
    return corpus(s, d).select("row_id", F.size(tokens.words(F.col("body"))).alias("n_tokens"))


@q("f05_loose_denominator", f"SELECT row_id, len(list_filter(regexp_split_to_array(coalesce(body, ''), '[^a-zA-Z]+'), lambda x: length(x) >= 3)) AS n FROM {C}")
def f05(s, d):
    return corpus(s, d).select("row_id", F.size(F.filter(F.split(F.coalesce(F.col("body"), F.lit("")), "[^a-zA-Z]+"), lambda x: F.length(x) >= 3)).alias("n"))


@q("f08_variants", f"WITH w AS (SELECT unnest({BODY}) AS w FROM {C}), l AS (SELECT w, CASE WHEN regexp_matches(w, '[^aeiou]ies$') AND length(w) > 4 THEN regexp_replace(w, 'ies$', 'y') WHEN regexp_matches(w, '(?:ss|sh|ch|x|z)es$') THEN regexp_replace(w, 'es$', '') WHEN regexp_matches(w, '[^sui]s$') AND length(w) > 3 THEN regexp_replace(w, 's$', '') ELSE w END AS m FROM w) SELECT variant, count(*) AS total, count(DISTINCT term) AS types FROM (SELECT 'raw' AS variant, w AS term FROM l UNION ALL SELECT 'stop', w FROM l WHERE w NOT IN ({STOP}) UNION ALL SELECT 'lemma', m FROM l UNION ALL SELECT 'lemma_stop', m FROM l WHERE m NOT IN ({STOP})) GROUP BY variant")
def f08(s, d):
    t = corpus(s, d).select(F.explode(tokens.words(F.col("body"))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).withColumn("m", tokens.lemma(F.col("w")))
    stop = lambda c: ~F.col(c).isin(*tokens.STOPWORDS)
    v = F.explode(F.array(F.struct(F.lit("raw").alias("variant"), F.col("w").alias("term")), F.struct(F.lit("stop").alias("variant"), F.when(stop("w"), F.col("w")).alias("term")), F.struct(F.lit("lemma").alias("variant"), F.col("m").alias("term")), F.struct(F.lit("lemma_stop").alias("variant"), F.when(stop("m"), F.col("m")).alias("term")))).alias("v")
    g = t.select("n", v).where("v.term IS NOT NULL").groupBy("v.variant", "v.term").agg(F.sum("n").alias("n"))
    return g.groupBy("variant").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("types"))


@q("f09_unigram_topn", f"SELECT source, rank, term, n FROM (SELECT source, term, n, row_number() OVER (PARTITION BY source ORDER BY n DESC, term) AS rank FROM (SELECT source, term, count(*) AS n FROM (SELECT source, unnest({TEXT}) AS term FROM documents) WHERE term NOT IN ({STOP}) GROUP BY source, term)) WHERE rank <= 20")
def f09(s, d):
    t = tokens.content(tokens.words(F.col("text")))
    return tokens.top(tokens.frequency(docs(s, d), t, ["source"]), 20, ["source"]).select("source", "rank", "term", "n")


def _ngram_sql(n: int, k: int) -> str:
    return f"SELECT term, count(*) AS n FROM (SELECT unnest([array_to_string(w[i:i+{n - 1}], ' ') FOR i IN range(1, len(w) - {n - 2})]) AS term FROM (SELECT {BODY} AS w FROM {C}) WHERE len(w) >= {n}) GROUP BY term ORDER BY n DESC, term LIMIT {k}"


for _n in (2, 3, 4):
    q(f"f10_ngrams_{_n}", _ngram_sql(_n, 200))(lambda s, d, n=_n: tokens.top(tokens.frequency(corpus(s, d).select(tokens.words(F.col("body")).alias("w")), tokens.ngrams(F.col("w"), n)), 200))


@q("f11_skipgrams", f"WITH t AS (SELECT row_id, {BODY} AS w FROM {C}), p AS (SELECT row_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM t) SELECT a.x AS first, b.x AS second, count(*) AS n FROM p a JOIN p b ON a.row_id = b.row_id AND b.i - a.i BETWEEN 1 AND 2 GROUP BY 1, 2 ORDER BY n DESC, first, second LIMIT 200")
def f11(s, d):
    return tokens.skipgrams(corpus(s, d), tokens.words(F.col("body")), 1).orderBy(F.desc("n"), "first", "second").limit(200)


@q("f13_collocation_pmi", f"WITH t AS (SELECT row_id, {BODY} AS w FROM {C}), p AS (SELECT row_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM t), f AS (SELECT x, count(*) AS n FROM p GROUP BY x), c AS (SELECT a.x AS anchor, width, b.x AS term, count(*) AS cooc FROM p a JOIN p b ON a.row_id = b.row_id AND a.i <> b.i JOIN (SELECT unnest([5, 10]) AS width) ON abs(a.i - b.i) <= width WHERE a.x IN ('warning', 'therapist', 'reminder') AND b.x <> a.x AND b.x NOT IN ({STOP}) GROUP BY ALL HAVING count(*) >= 5), s AS (SELECT anchor, width, term, cooc, fa.n AS anchor_n, fb.n AS freq, round(log2(cooc * (SELECT sum(n) FROM f)::DOUBLE / (fa.n * fb.n)), 4) AS pmi FROM c JOIN f fa ON fa.x = anchor JOIN f fb ON fb.x = term) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor, width ORDER BY pmi DESC, term) AS rank FROM s) WHERE rank <= 50")
def f13(s, d):
    return tokens.collocations(corpus(s, d), tokens.words(F.col("body")), ["warning", "therapist", "reminder"], [5, 10])


_CMP = f"WITH f AS (SELECT type, term, count(*) AS n FROM (SELECT type, unnest({BODY}) AS term FROM {C} WHERE type IS NOT NULL) GROUP BY type, term), x AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY n DESC, term) AS r, sum(n) OVER (PARTITION BY type) AS t FROM f), a AS (SELECT * FROM x WHERE type = 'post' AND r <= 200), b AS (SELECT * FROM x WHERE type = 'comment' AND r <= 200), z AS (SELECT coalesce(a.term, b.term) AS term, coalesce(a.n, 0) AS a, coalesce(b.n, 0) AS b, (SELECT max(t) FROM x WHERE type = 'post') AS ta, (SELECT max(t) FROM x WHERE type = 'comment') AS tb FROM a FULL JOIN b USING (term)), r AS (SELECT term, a, b, round(a / ta * 1000, 4) AS a_per_1k, round(b / tb * 1000, 4) AS b_per_1k, round((a / ta) / greatest(b / tb, 1e-9), 4) AS ratio FROM z) "


def _compared(s, d):
    f = materialize(tokens.frequency(corpus(s, d).where("type IS NOT NULL"), tokens.words(F.col("body")), ["type"]), "frequency")
    return tokens.compare(f.where("type = 'post'").select("term", "n"), f.where("type = 'comment'").select("term", "n"))


q("f14_corpus_compare", _CMP + "SELECT * FROM r")(_compared)
q("f15_elevated", _CMP + "SELECT term, a, ratio FROM r WHERE ratio >= 1.05 AND a >= 20")(lambda s, d: _compared(s, d).where("ratio >= 1.05 AND a >= 20").select("term", "a", "ratio"))
q("f16_only_in_a", _CMP + "SELECT term FROM r WHERE b = 0")(lambda s, d: _compared(s, d).where("b = 0").select("term"))


@q("f17_stop_candidates", f"SELECT row_number() OVER (ORDER BY n DESC, term) AS rank, term, n, round(100.0 * n / sum(n) OVER (), 3) AS pct, term IN ({STOP}) AS in_stop FROM ({_FREQ}) ORDER BY n DESC, term LIMIT 50")
def f17(s, d):
    f = tokens.frequency(corpus(s, d), tokens.words(F.col("body")))
    total = f.agg(F.sum("n").alias("total"))
    t = attach(tokens.top(f, 50), total)
    return t.select(F.row_number().over(Window.orderBy(F.desc("n"), "term")).alias("rank"), "term", "n", F.round(100.0 * F.col("n") / F.col("total"), 3).alias("pct"), F.col("term").isin(*tokens.STOPWORDS).alias("in_stop"))


@q("k01_kwic", f"WITH t AS (SELECT row_id, {BODY} AS w FROM {C}), p AS (SELECT row_id, w, unnest(range(len(w))) AS pos FROM t) SELECT row_id, 'professional help' AS seed, pos, array_to_string(w[greatest(pos - 4, 1):pos], ' ') AS left_context, array_to_string(w[pos + 3:pos + 7], ' ') AS right_context FROM p WHERE w[pos + 1] = 'professional' AND w[pos + 2] = 'help'")
def k01(s, d):
    seeds = s.createDataFrame([("professional help", ["professional", "help"])], "seed string, seed_tokens array<string>")
    return tokens.kwic(corpus(s, d), tokens.words(F.col("body")), seeds, 5, ["row_id"])


@q("k02_hit_counts", f"SELECT term AS seed, count(*) AS total, count_if(type = 'post') AS posts, count_if(type = 'comment') AS comments FROM (SELECT type, unnest({BODY}) AS term FROM {C}) WHERE term IN ('warning', 'therapist', 'reminder', 'memory') GROUP BY term")
def k02(s, d):
    seeds = s.createDataFrame([(w, [w]) for w in ("warning", "therapist", "reminder", "memory")], "seed string, seed_tokens array<string>")
    return tokens.kwic(corpus(s, d), tokens.words(F.col("body")), seeds, 5, ["type"]).groupBy("seed").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("type") == "post").alias("posts"), F.count_if(F.col("type") == "comment").alias("comments"))


@q("k03_group_sample", f"SELECT subreddit, row_id FROM (SELECT subreddit, row_id, row_number() OVER (PARTITION BY subreddit ORDER BY md5('42|' || row_id), row_id) AS n FROM {C}) WHERE n <= 20")
def k03(s, d):
    return relational.sample_per_group(corpus(s, d).select("subreddit", "row_id"), "subreddit", "row_id", 20)


@q("k05_dup_prefix", f"SELECT coalesce(sum(CASE WHEN c > 1 THEN c - 1 END), 0) AS repeats, count(*) AS prefixes, sum(s) AS short FROM (SELECT trim(lower(substring(coalesce(body, ''), 1, 200))) AS k, count(*) AS c, count_if(length(trim(coalesce(body, ''))) < 30) AS s FROM {C} GROUP BY 1)")
def k05(s, d):
    return graph.duplicate_prefixes(corpus(s, d), "body")


_VOC = f"SELECT term, count(*) AS n FROM (SELECT unnest(list_distinct(list_filter({BODY}, lambda x: x NOT IN ({STOP})))) AS term FROM {C}) GROUP BY term ORDER BY n DESC, term LIMIT 150"
_EDGES = f"v AS ({_VOC}), h AS (SELECT row_id, term FROM (SELECT row_id, unnest(list_distinct({BODY})) AS term FROM {C}) WHERE term IN (SELECT term FROM v)), e AS (SELECT a.term AS src, b.term AS dst, count(*) AS weight FROM h a JOIN h b ON a.row_id = b.row_id AND a.term < b.term GROUP BY 1, 2 HAVING count(*) >= 5)"


def _edges(s, d):
    c = corpus(s, d).select("row_id", tokens.content(tokens.words(F.col("body"))).alias("w"))
    return graph.edges(c, F.col("w"), graph.vocabulary(c, F.col("w"), 150), "row_id")


def whole_edges(s, d, kind=None):
    """Edges over the reference's 2,000 terms, of tokenizer B (F03), in all rows or in those of one type."""
    c = corpus(s, d) if kind is None else corpus(s, d).where(F.col("type") == kind)
    c = c.select("row_id", tokens.content(tokens.loose_words(F.col("body"))).alias("w"))
    return graph.edges(c, F.col("w"), graph.vocabulary(c, F.col("w")), "row_id")


@q("k06_vocabulary", _VOC)
def k06(s, d):
    return graph.vocabulary(corpus(s, d).select(tokens.content(tokens.words(F.col("body"))).alias("w")), F.col("w"), 150)


@q("k07_cooccurrence", f"WITH {_EDGES} SELECT * FROM e")
def k07(s, d):
    return _edges(s, d)


@q("k09_graph_stats", f"WITH {_EDGES}, x AS (SELECT count(*) AS edges FROM e), n AS (SELECT count(DISTINCT t) AS nodes FROM (SELECT src AS t FROM e UNION ALL SELECT dst FROM e)) SELECT nodes, edges, round(2.0 * edges / (nodes * (nodes - 1)), 4) AS density, round(2.0 * edges / nodes, 4) AS avg_degree FROM x, n")
def k09(s, d):
    return graph.stats(_edges(s, d))


@q("k10_degrees", f"WITH {_EDGES} SELECT term, count(*) AS degree FROM (SELECT src AS term FROM e UNION ALL SELECT dst FROM e) GROUP BY term")
def k10(s, d):
    return graph.degrees(_edges(s, d))


@q("k11_communities")
def k11(s, d):
    return graph.communities(whole_edges(s, d), [0.5, 1.0, 2.0])


@q("k14_ego_graph", f"WITH {_EDGES}, a AS (SELECT min(src) AS t FROM e), n AS (SELECT src AS t FROM e WHERE dst = (SELECT t FROM a) UNION SELECT dst FROM e WHERE src = (SELECT t FROM a) UNION SELECT t FROM a) SELECT src, dst, weight FROM e WHERE src IN (SELECT t FROM n) AND dst IN (SELECT t FROM n)")
def k14(s, d):
    e = _edges(s, d)
    first = e.agg(F.min("src").alias("t")).head()["t"]
    return graph.ego(e, first or "")


_LAB = "SELECT vec_id, label AS a, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS b FROM embeddings"


def _labels(s, d):
    return table(s, d, "embeddings").select("vec_id", F.col("label").alias("a"), F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("b"))


@q("d06_cluster_sizes", "SELECT count(DISTINCT label) FILTER (WHERE label <> -1) AS clusters, round(avg(CASE WHEN label = -1 THEN 1 ELSE 0 END), 4) AS noise FROM embeddings")
def d06(s, d):
    return clusters.cluster_sizes(table(s, d, "embeddings"), "label")


@q("d07_ari", f"WITH l AS ({_LAB}), t AS (SELECT a, b, count(*) AS n FROM l GROUP BY a, b), s AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS n FROM t), ra AS (SELECT sum(n * (n - 1) / 2) AS sa FROM (SELECT sum(n) AS n FROM t GROUP BY a)), rb AS (SELECT sum(n * (n - 1) / 2) AS sb FROM (SELECT sum(n) AS n FROM t GROUP BY b)) SELECT round((s - sa * sb / (n * (n - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2)), 4) AS ari FROM s, ra, rb")
def d07(s, d):
    return clusters.adjusted_rand(_labels(s, d), "a", "b")


@q("d08_nmi", f"WITH l AS ({_LAB}), t AS (SELECT a, b, count(*)::DOUBLE AS n FROM l GROUP BY a, b), p AS (SELECT a, b, n / sum(n) OVER () AS p, sum(n) OVER (PARTITION BY a) / sum(n) OVER () AS pa, sum(n) OVER (PARTITION BY b) / sum(n) OVER () AS pb FROM t) SELECT round(2 * sum(p * ln(p / (pa * pb))) / (-sum(p * ln(pa)) - sum(p * ln(pb))), 4) AS nmi FROM p")
def d08(s, d):
    return clusters.normalized_mutual_information(_labels(s, d), "a", "b")


@q("d11_exemplars")
def d11(s, d):
    return clusters.exemplars(table(s, d, "embeddings"), "vec_id", "embedding", "label")


@q("d05_density_clusters")
def d05(s, d):
    return clusters.density_clusters(table(s, d, "embeddings").select(F.lit("all").alias("seed"), "vec_id", "embedding"), "seed", "vec_id", "embedding")


@q("rp09_cohen_kappa", f"WITH l AS ({_LAB}), t AS (SELECT a, b, count(*)::DOUBLE AS n FROM l GROUP BY a, b), o AS (SELECT sum(n) AS n, sum(CASE WHEN a = b THEN n ELSE 0 END) / sum(n) AS po FROM t), e AS (SELECT sum(x.n * y.n) AS bb FROM (SELECT a, sum(n) AS n FROM t GROUP BY a) x JOIN (SELECT b, sum(n) AS n FROM t GROUP BY b) y ON a = b) SELECT round(po, 4) AS agreement, round((po - bb / (n * n)) / (1 - bb / (n * n)), 4) AS kappa FROM o, e")
def p09(s, d):
    return clusters.kappa(_labels(s, d), "a", "b")


@q("v01_row_labels")
def v01(s, d):
    return corpus(s, d).select("row_id", segments.classify(F.coalesce(F.col("body"), F.lit(""))).alias("c")).select("row_id", "c.*")


@q("v02_spans")
def v02(s, d):
    return segments.segment(corpus(s, d), "body", "row_id")


@q("v09_span_metrics")
def v09(s, d):
    return segments.metrics(segments.segment(corpus(s, d), "body", "row_id"))


@q("v10_dominant_label")
def v10(s, d):
    return segments.dominant(segments.segment(corpus(s, d), "body", "row_id"), "row_id")


@q("v14_tiers")
def v14(s, d):
    return segments.tiers(segments.segment(corpus(s, d), "body", "row_id"), "row_id")


_RAW = "SELECT l_orderkey AS k, 400 AS length, CAST(l_suppkey % 200 AS INT) AS start, CAST(l_suppkey % 200 + 1 + l_partkey % 190 AS INT) AS \"end\", CAST(l_linenumber % 4 AS INT) AS label_rank, CAST(l_quantity % 3 AS INT) AS conf_rank, CAST(l_linenumber AS INT) AS ord FROM lineitem"


@q("v04_overlap_resolution", f"WITH s AS ({_RAW}), c AS (SELECT DISTINCT k, unnest([0, length, start, \"end\"]) AS lo FROM s), e AS (SELECT * FROM (SELECT k, lo, lead(lo) OVER (PARTITION BY k ORDER BY lo) AS hi FROM c) WHERE hi IS NOT NULL), b AS (SELECT e.k, lo, hi, arg_min(ord, label_rank * 10000 + conf_rank * 1000 + ord) AS winner FROM e LEFT JOIN s ON e.k = s.k AND start <= lo AND \"end\" >= hi GROUP BY e.k, lo, hi), n AS (SELECT *, CASE WHEN winner IS NOT DISTINCT FROM lag(winner) OVER (PARTITION BY k ORDER BY lo) AND lo > 0 THEN 0 ELSE 1 END AS new FROM b), r AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY lo ROWS UNBOUNDED PRECEDING) AS run FROM n) SELECT k, min(lo) AS lo, max(hi) AS hi, min(winner) AS winner FROM r GROUP BY k, run")
def v04(s, d):
    i = lambda c: F.col(c).cast("int")
    raw = table(s, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.lit(400).alias("length"), (i("l_suppkey") % 200).alias("start"), (i("l_suppkey") % 200 + 1 + i("l_partkey") % 190).alias("end"), (i("l_linenumber") % 4).alias("label_rank"), (i("l_quantity") % 3).alias("conf_rank"), i("l_linenumber").alias("ord"))
    return segments.resolve(raw, "k")


@q("rp01_composition_rollup", f"SELECT coalesce(subreddit, CASE WHEN grouping(subreddit) = 1 THEN 'Total' ELSE '(none)' END) AS subreddit, count(*) AS rows, count_if(type = 'post') AS posts, count_if(type = 'comment') AS comments, count_if(coalesce(r2_any_match, false)) AS tagged, count_if(ingested_at < {MS}) AS pre, count_if(ingested_at >= {MS}) AS post FROM {C} GROUP BY ROLLUP (subreddit)")
def p01(s, d):
    at = F.lit("2025-09-29").cast("timestamp")
    g = corpus(s, d).rollup("subreddit").agg(F.grouping("subreddit").alias("g"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col("type") == "post").alias("posts"), F.count_if(F.col("type") == "comment").alias("comments"), F.count_if("r2_any_match").alias("tagged"), F.count_if(F.col("ingested_at") < at).alias("pre"), F.count_if(F.col("ingested_at") >= at).alias("post"))
    return g.withColumn("subreddit", F.coalesce("subreddit", F.when(F.col("g") == 1, "Total").otherwise("(none)"))).drop("g")


@q("rp04_category_pivot", f"WITH f AS (SELECT type, CASE WHEN term IN ('warning', 'reminder', 'layer') THEN 'mechanism' WHEN term IN ('therapist', 'help', 'patient') THEN 'care' END AS category FROM (SELECT type, unnest({BODY}) AS term FROM {C})), t AS (SELECT type, count(*) AS total FROM f GROUP BY type) SELECT category, round(1000.0 * count_if(type = 'post') / (SELECT total FROM t WHERE type = 'post'), 4) AS post, round(1000.0 * count_if(type = 'comment') / (SELECT total FROM t WHERE type = 'comment'), 4) AS comment FROM f WHERE category IS NOT NULL GROUP BY category")
def p04(s, d):
    cat = F.when(F.col("term").isin("warning", "reminder", "layer"), "mechanism").when(F.col("term").isin("therapist", "help", "patient"), "care")
    f = tokens.frequency(corpus(s, d), tokens.words(F.col("body")), ["type"])
    total = f.groupBy("type").agg(F.sum("n").alias("total"))
    g = f.withColumn("category", cat).where("category IS NOT NULL").groupBy("type", "category").agg(F.sum("n").alias("n")).join(F.broadcast(total), "type")  # two types
    return g.groupBy("category").pivot("type", ["post", "comment"]).agg(F.round(1000.0 * F.sum("n") / F.first("total"), 4))


_DAILY = f"d AS (SELECT CAST(ingested_at AS DATE) AS day, count_if(contains(lower(body), 'therapist')) AS hits, sum(len({BODY})) AS tokens FROM {C} WHERE ingested_at IS NOT NULL GROUP BY 1), s AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM d), (SELECT max(day) FROM d), INTERVAL 1 DAY)) AS DATE) AS day), r AS (SELECT day, coalesce(hits, 0) AS hits, coalesce(tokens, 0) AS tokens, CASE WHEN tokens >= 50 THEN round(1000.0 * hits / tokens, 4) END AS rate FROM s LEFT JOIN d USING (day))"


def _daily(s, d):
    g = corpus(s, d).where("ingested_at IS NOT NULL").groupBy(F.to_date("ingested_at").alias("day")).agg(F.count_if(F.contains(F.lower(F.col("body")), F.lit("therapist"))).alias("hits"), F.sum(F.size(tokens.words(F.col("body")))).alias("tokens"))
    spine = g.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 DAY"))).alias("day"))
    z = spine.join(g, "day", "left")
    return z.select("day", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.when(F.col("tokens") >= 50, F.round(1000.0 * F.col("hits") / F.col("tokens"), 4)).alias("rate"))


@q("rp05_daily_rate", f"WITH {_DAILY} SELECT CAST(day AS VARCHAR) AS day, hits, tokens, rate FROM r")
def p05(s, d):
    return _daily(s, d).withColumn("day", F.col("day").cast("string"))


@q("rp06_rolling_mean", f"WITH {_DAILY} SELECT CAST(day AS VARCHAR) AS day, CASE WHEN count(rate) OVER w >= 3 THEN round(avg(rate) OVER w, 4) END AS mean7 FROM r WINDOW w AS (ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)")
def p06(s, d):
    w = Window.orderBy("day").rowsBetween(-3, 3)  # one row a day
    return _daily(s, d).select(F.col("day").cast("string").alias("day"), F.when(F.count("rate").over(w) >= 3, F.round(F.avg("rate").over(w), 4)).alias("mean7"))


@q("rp07_panel_counts", "SELECT v AS value, count(pattern_type) AS n FROM (SELECT unnest(['phrasal', 'user_reaction', 'grammatical', 'none']) AS v) LEFT JOIN seed_terms_round_2 ON pattern_type = v GROUP BY v")
def p07(s, d):
    v = s.createDataFrame([("phrasal",), ("user_reaction",), ("grammatical",), ("none",)], "value string")
    t = table(s, d, "seed_terms_round_2").groupBy(F.col("pattern_type").alias("value")).agg(F.count(F.lit(1)).alias("c"))
    return v.join(t, "value", "left").select("value", F.coalesce("c", F.lit(0)).alias("n"))


@q("rp08_matrix", "SELECT term, 'pattern_type' AS property, pattern_type AS value FROM seed_terms_round_2 UNION ALL SELECT term, 'confidence', confidence FROM seed_terms_round_2 UNION ALL SELECT term, 'retrieval_action', retrieval_action FROM seed_terms_round_2")
def p08(s, d):
    return table(s, d, "seed_terms_round_2").unpivot("term", ["pattern_type", "confidence", "retrieval_action"], "property", "value")


@q("rp11_completeness", "SELECT row_id, CAST(source_csv IS NOT NULL AS INT) + CAST(post_id IS NOT NULL AS INT) + CAST(full_context IS NOT NULL AS INT) + CAST(why_positive IS NOT NULL AS INT) AS filled FROM round_1_positive_cases")
def p11(s, d):
    cols = ["source_csv", "post_id", "full_context", "why_positive"]
    return table(s, d, "round_1_positive_cases").select("row_id", F.size(F.array_compact(F.array(*cols))).alias("filled"))


@q("rp13_upper_median", "SELECT event_type, list_sort(list(value))[count(value) // 2 + 1] AS upper_median, min(value) AS least, max(value) AS most FROM events GROUP BY event_type")
def p13(s, d):
    return relational.value_at_half(table(s, d, "events"), "event_type", "value")


@q("s18_json_field", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def s18(s, d):
    return table(s, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))

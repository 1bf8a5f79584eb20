"""Further queries over the corpus operators: set operations, term tables, strata of graphs, sampling and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.operators import clean, clusters, graph, relational, segments, tagging, tokens
from wordloom.plans.catalog import Catalog, table
from wordloom.plans.corpus import _EDGES, BODY, STOP, C, _edges, corpus, docs
from wordloom.storage import attach

catalog = Catalog()
q = catalog.add


@q("c01_title_concat", "SELECT row_id, trim(coalesce(match, '') || ' ' || coalesce(context, '')) AS body FROM yield_search_candidates")
def c01(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "yield_search_candidates").select("row_id", clean.title_and_text(F.col("match"), F.col("context")).alias("body"))


@q("c02_epoch_to_utc", "SELECT l_orderkey, l_linenumber, epoch_us(make_timestamp(CAST(l_partkey AS BIGINT) * 1000000)) AS us FROM lineitem")
def c02(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.unix_micros(clean.epoch_to_utc(F.col("l_partkey"))).alias("us"))


@q("r03_dedupe_ids", f"SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY comment_id ORDER BY row_id) AS n FROM {C} WHERE type = 'comment' AND comment_id IS NOT NULL) WHERE n = 1")
def r03(s, d):
    return relational.keep_first(corpus(s, d).where("type = 'comment' AND comment_id IS NOT NULL").select("row_id", "comment_id"), ["comment_id"], ["row_id"]).select("row_id")


@q("r11_outer_union", "SELECT coalesce(a.lang, b.lang) AS lang, coalesce(a.n, 0) AS docs, coalesce(b.n, 0) AS items FROM (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang) a FULL JOIN (SELECT lang, count(*) AS n FROM eval_items GROUP BY lang) b ON a.lang = b.lang")
def r11(s, d):
    a = docs(s, d).where("lang IS NOT NULL").groupBy("lang").agg(F.count(F.lit(1)).alias("docs"))
    return a.join(table(s, d, "eval_items").groupBy("lang").agg(F.count(F.lit(1)).alias("items")), "lang", "full_outer").na.fill(0, ["docs", "items"])


@q("r12_set_ops", f"SELECT 'minus' AS op, subreddit FROM (SELECT subreddit FROM {C} EXCEPT SELECT subreddit FROM documents) UNION ALL SELECT 'both', subreddit FROM (SELECT subreddit FROM {C} INTERSECT SELECT subreddit FROM documents)")
def r12(s, d):
    a, b = corpus(s, d).select("subreddit"), docs(s, d).select("subreddit")
    return a.subtract(b).select(F.lit("minus").alias("op"), "subreddit").unionByName(a.intersect(b).select(F.lit("both").alias("op"), "subreddit"))


@q("t07_auto_code", f"SELECT row_id, CASE WHEN body IS NULL OR trim(body) = '' THEN '' WHEN contains(lower(body), 'seek professional help') OR contains(lower(body), 'your wellbeing') THEN 'TP' ELSE 'borderline' END AS code, CASE WHEN body IS NULL OR trim(body) = '' THEN NULL WHEN contains(lower(body), 'seek professional help') THEN 'seek professional help' WHEN contains(lower(body), 'your wellbeing') THEN 'your wellbeing' END AS phrase FROM {C}")
def t07(s, d):
    code, phrase = tagging.auto_code(F.col("body"), ["seek professional help", "your wellbeing"])
    return corpus(s, d).select("row_id", code.alias("code"), phrase.alias("phrase"))


@q("t09_saturation", f"WITH n AS (SELECT count(*) AS posts, count_if(post_id NOT IN (SELECT post_id FROM {C} WHERE post_id IS NOT NULL)) AS net FROM memory_lcr_candidates WHERE post_id IS NOT NULL) SELECT net, posts, CASE WHEN 0.8 < 0.5 THEN true ELSE net / posts <= 0.10 END AS saturated FROM n")
def t09(s, d):
    m = table(s, d, "memory_lcr_candidates").where("post_id IS NOT NULL").select("post_id")
    net = m.join(corpus(s, d).select("post_id"), "post_id", "left_anti").agg(F.count(F.lit(1)).alias("net"))
    x = attach(net, m.agg(F.count(F.lit(1)).alias("posts")))
    return x.select("net", "posts", tagging.saturated(F.col("net"), F.col("posts"), F.lit(0.8)).alias("saturated"))


@q("t10_term_function", "SELECT term, CASE WHEN contains(lower(pattern_type), 'reaction') OR contains(lower(pattern_type), 'grammat') THEN 'retrieval_anchor' ELSE 'validated_detector' END AS function FROM seed_terms_round_2")
def t10(s, d):
    return table(s, d, "seed_terms_round_2").select("term", F.when(clean.contains_any(F.col("pattern_type"), ["reaction", "grammat"]), "retrieval_anchor").otherwise("validated_detector").alias("function"))


@q("t13_multi_key_sort", "SELECT row_number() OVER (ORDER BY TRY_CAST(regexp_extract(c_name, '[1-5]{3}$') AS INT) DESC NULLS LAST, c_acctbal DESC, c_custkey) AS place, c_custkey FROM customer")
def t13(s, d):
    num = F.regexp_extract("c_name", "[1-5]{3}$", 0).try_cast("int")
    rows = table(s, d, "customer").select("c_custkey", "c_acctbal", num.alias("num"))
    return relational.global_rank(rows, [F.col("num").desc_nulls_last(), F.desc("c_acctbal"), F.col("c_custkey")]).select("place", "c_custkey")


LOOSE = "list_filter(regexp_split_to_array(regexp_replace(translate(lower(regexp_replace(coalesce(body, ''), 'https?://\\S+|www\\.\\S+', ' ', 'g')), '‘’“”', '''''\"\"'), '[^a-z0-9 ''\\-]', ' ', 'g'), ' +'), lambda x: x <> '')"


@q("f02_loose_tokens", f"SELECT row_id, len({LOOSE}) AS n, list_aggregate({LOOSE}, 'string_agg', ' ') AS joined FROM {C}")
def f02(s, d):
    t = tokens.loose_words(F.col("body"))
    return corpus(s, d).select("row_id", F.size(t).alias("n"), F.nullif(F.array_join(t, " "), F.lit("")).alias("joined"))


@q("f03_content_tokens", f"SELECT row_id, len(list_filter({BODY}, lambda x: x NOT IN ({STOP}))) AS n FROM {C}")
def f03(s, d):
    return corpus(s, d).select("row_id", F.size(tokens.content(tokens.words(F.col("body")))).alias("n"))


@q("f12_pmi", "WITH a AS (SELECT l_partkey, count(*) AS fa FROM lineitem GROUP BY 1), b AS (SELECT l_suppkey, count(*) AS fb FROM lineitem GROUP BY 1), c AS (SELECT l_partkey, l_suppkey, count(*) AS c FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 2) SELECT l_partkey, l_suppkey, round(log2(c * (SELECT count(*) FROM lineitem)::DOUBLE / (fa * fb)), 4) AS pmi FROM c JOIN a USING (l_partkey) JOIN b USING (l_suppkey)")
def f12(s, d):
    t = table(s, d, "lineitem")
    n = t.agg(F.count(F.lit(1)).alias("total"))
    c = t.groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("c")).where("c >= 2")
    x = attach(c.join(t.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("fa")), "l_partkey").join(t.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("fb")), "l_suppkey"), n)
    return x.select("l_partkey", "l_suppkey", F.round(tokens.pmi(F.col("c"), F.col("total"), F.col("fa"), F.col("fb")), 4).alias("pmi"))


@q("f18_summary", f"SELECT count(*) AS rows, sum(len({BODY})) AS tokens, count_if(type = 'post') AS posts, count(DISTINCT subreddit) AS groups FROM {C}")
def f18(s, d):
    return corpus(s, d).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size(tokens.words(F.col("body")))).alias("tokens"), F.count_if(F.col("type") == "post").alias("posts"), F.count_distinct("subreddit").alias("groups"))


@q("k04_seed_distribution", f"SELECT subreddit, type, count(*) AS hits, count(DISTINCT row_id) AS rows FROM (SELECT row_id, subreddit, type, unnest({BODY}) AS w FROM {C}) WHERE w = 'therapist' GROUP BY subreddit, type")
def k04(s, d):
    hits = corpus(s, d).select("row_id", "subreddit", "type", F.explode(tokens.words(F.col("body"))).alias("w")).where("w = 'therapist'")
    return hits.groupBy("subreddit", "type").agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("row_id").alias("rows"))


@q("k12_modularity", f"WITH {_EDGES}, l AS (SELECT t, length(t) % 3 AS c FROM (SELECT src AS t FROM e UNION SELECT dst FROM e)), m AS (SELECT sum(weight) AS m FROM e), i AS (SELECT a.c, sum(weight) AS w FROM e JOIN l a ON a.t = src JOIN l b ON b.t = dst WHERE a.c = b.c GROUP BY a.c), k AS (SELECT c, sum(weight) AS k FROM (SELECT src AS t, weight FROM e UNION ALL SELECT dst, weight FROM e) JOIN l USING (t) GROUP BY c) SELECT round(sum(coalesce(w, 0)::DOUBLE / m - (k / (2.0 * m)) * (k / (2.0 * m))), 4) AS modularity FROM k LEFT JOIN i USING (c), m")
def k12(s, d):
    e = _edges(s, d)
    return graph.modularity(e, graph.degrees(e).select("term", (F.length("term") % 3).alias("community")))


@q("k13_document_frequency", f"SELECT term, count(DISTINCT row_id) AS df FROM (SELECT row_id, unnest({BODY}) AS term FROM {C}) WHERE term IN ('warning', 'therapist', 'reminder') GROUP BY term")
def k13(s, d):
    t = corpus(s, d).select(F.explode(F.array_distinct(tokens.words(F.col("body")))).alias("term")).where(F.col("term").isin("warning", "therapist", "reminder"))
    return t.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _stratum_degrees(s, d, kind):
    c = corpus(s, d).where(F.col("type") == kind).select("row_id", tokens.content(tokens.words(F.col("body"))).alias("w"))
    return graph.degrees(graph.edges(c, F.col("w"), graph.vocabulary(c, F.col("w"), 80), "row_id"))


def _stratum_sql(kind: str) -> str:
    voc = f"SELECT term FROM (SELECT term, count(*) AS n FROM (SELECT unnest(list_distinct(list_filter({BODY}, lambda x: x NOT IN ({STOP})))) AS term FROM {C} WHERE type = '{kind}') GROUP BY term ORDER BY n DESC, term LIMIT 80)"
    held = f"(SELECT row_id, term FROM (SELECT row_id, unnest(list_distinct({BODY})) AS term FROM {C} WHERE type = '{kind}') WHERE term IN ({voc}))"
    e = f"(SELECT a.term AS src, b.term AS dst FROM {held} a JOIN {held} b ON a.row_id = b.row_id AND a.term < b.term GROUP BY 1, 2 HAVING count(*) >= 5)"
    return f"SELECT '{kind}' AS stratum, term, count(*) AS degree FROM (SELECT unnest([src, dst]) AS term FROM {e}) GROUP BY term"


@q("k15_stratum_networks", f"{_stratum_sql('post')} UNION ALL {_stratum_sql('comment')}")
def k15(s, d):
    parts = [_stratum_degrees(s, d, k).select(F.lit(k).alias("stratum"), "term", "degree") for k in ("post", "comment")]
    return parts[0].unionByName(parts[1])


@q("k16_degree_overlap", f"WITH a AS (SELECT term FROM ({_stratum_sql('post')}) ORDER BY degree DESC, term LIMIT 40), b AS (SELECT term FROM ({_stratum_sql('comment')}) ORDER BY degree DESC, term LIMIT 40), i AS (SELECT count(*) AS i FROM (SELECT term FROM a INTERSECT SELECT term FROM b)), u AS (SELECT count(*) AS u FROM (SELECT term FROM a UNION SELECT term FROM b)) SELECT i AS shared, round(CASE WHEN u = 0 THEN 0.0 ELSE i / u END, 4) AS jaccard FROM i, u")
def k16(s, d):
    a, b = (tokens.top(_stratum_degrees(s, d, k), 40, n="degree").select("term") for k in ("post", "comment"))
    both = attach(a.intersect(b).agg(F.count(F.lit(1)).alias("shared")), a.union(b).distinct().agg(F.count(F.lit(1)).alias("u")))
    return both.select("shared", F.round(F.when(F.col("u") == 0, 0.0).otherwise(F.col("shared") / F.col("u")), 4).alias("jaccard"))


@q("v13_confidence_distribution")
def v13(s, d):
    rows = corpus(s, d).select("type", segments.classify(F.coalesce("body", F.lit(""))).alias("c")).groupBy("type", "c.label", "c.confidence").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2))


@q("v11_validation_sample")
def v11(s, d):
    rows = segments.dominant(segments.segment(corpus(s, d), "body", "row_id"), "row_id")
    return relational.sample_per_group(rows, "dominant", "row_id", 9)


@q("rp02_signature", "SELECT count(*) AS cases, count_if(source_csv IS NOT NULL) AS sourced, count_if(why_positive IS NOT NULL AND contains(why_positive, 'Refusal')) AS refused, count_if(seed_terms_matched = 'null') AS literal_null FROM round_1_positive_cases")
def p02(s, d):
    return table(s, d, "round_1_positive_cases").agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.col("source_csv").isNotNull()).alias("sourced"), F.count_if(F.coalesce(F.contains("why_positive", F.lit("Refusal")), F.lit(False))).alias("refused"), F.count_if(F.coalesce(F.col("seed_terms_matched") == "null", F.lit(False))).alias("literal_null"))


@q("rp03_seed_terms_by_case", "SELECT term, count(*) AS cases FROM (SELECT unnest(string_split(seed_terms_matched, '|')) AS term FROM round_1_positive_cases WHERE seed_terms_matched IS NOT NULL) GROUP BY term")
def p03(s, d):
    return table(s, d, "round_1_positive_cases").where("seed_terms_matched IS NOT NULL").select(F.explode(F.split("seed_terms_matched", r"\|")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("cases"))


@q("rp10_routing", "SELECT row_id, CASE WHEN source_csv IS NOT NULL THEN why_positive END AS why_positive FROM round_1_positive_cases")
def p10(s, d):
    return table(s, d, "round_1_positive_cases").select("row_id", F.when(F.col("source_csv").isNotNull(), F.col("why_positive")).alias("why_positive"))


@q("rp12_composed_notes", "SELECT row_id, concat_ws('; ', why_positive, CASE WHEN source_csv IS NULL THEN 'no source' END, CASE WHEN full_context IS NULL THEN 'no context' END) AS notes FROM round_1_positive_cases")
def p12(s, d):
    missing = lambda c, t: F.when(F.col(c).isNull(), t)
    return table(s, d, "round_1_positive_cases").select("row_id", F.concat_ws("; ", "why_positive", missing("source_csv", "no source"), missing("full_context", "no context")).alias("notes"))


@q("rp15_shorten", f"SELECT row_id, CASE WHEN length(body) > 60 THEN substring(body, 1, 57) || '...' ELSE body END AS short FROM {C}")
def p15(s, d):
    return corpus(s, d).select("row_id", F.when(F.length("body") > 60, F.concat(F.substring("body", 1, 57), F.lit("..."))).otherwise(F.col("body")).alias("short"))

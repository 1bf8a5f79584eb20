"""Queries of the language-model training-data problems and the SQL of those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.encoding import encode_texts
from wordloom.llm.frequency import TermLedger, marked_terms
from wordloom.llm.leakage import ShardIndex, leaked
from wordloom.llm.markup import clean_markup, find_markup
from wordloom.llm.pages import difference_pages
from wordloom.llm.pii import find_kinds, redact
from wordloom.llm.residue import find_residue, fit
from wordloom.llm.sentences import split_sentences
from wordloom.llm.spans import SharedSpans, thread_key
from wordloom.plans import general
from wordloom.plans.catalog import Catalog, table, texts
from wordloom.storage import materialize

catalog = Catalog()
#: Folder of the public vocabularies.
TOKENIZERS = os.environ.get("WORDLOOM_TOKENIZERS", "/opt/tokenizers")


def _p4_ledger(spark: SparkSession, sf_dir: str) -> TermLedger:
    """The table in two changes: what had arrived by the middle batch, and the rest."""
    rows = texts(spark, sf_dir, "lcr_pass1b_canonical").select("body", "subreddit", "batch_id")
    middle = table(spark, sf_dir, "lcr_pass1b_canonical").agg(F.percentile_approx("batch_id", 0.5, 100)).head()[0]
    early = F.coalesce(F.col("batch_id") <= F.lit(middle), F.lit(False))
    ledger = TermLedger(spark)
    for part in (rows.where(early), rows.where(~early)):
        ledger.apply("body", added=part, value="body", tokenized=True)
        ledger.apply("subreddit", added=part, value="subreddit", tokenized=False)
    return ledger


_P4_SQL = """
    WITH words AS (
      SELECT row_id, unnest(regexp_extract_all(lower(body), '[\\p{L}\\p{N}_]+')) AS term FROM lcr_pass1b_canonical WHERE body IS NOT NULL),
    counts AS (
      SELECT 'body' AS field, term, count(*) AS occurrences, count(DISTINCT row_id) AS records FROM words
      WHERE regexp_full_match(term, '[a-z]{3,}') GROUP BY term
      UNION ALL
      SELECT 'subreddit', subreddit, count(*), count(*) FROM lcr_pass1b_canonical WHERE subreddit IS NOT NULL GROUP BY subreddit),
    totals AS (
      SELECT 'body' AS field, count(body) AS total FROM lcr_pass1b_canonical
      UNION ALL SELECT 'subreddit', count(subreddit) FROM lcr_pass1b_canonical),
    marked AS (
      SELECT field, term, occurrences, records,
             CASE WHEN field = 'body' AND (records < 3 OR occurrences < 5) THEN 'rare'
                  WHEN field = 'subreddit' AND records < 5 THEN 'rare'
                  WHEN records > 0.25 * total THEN 'common' END AS mark
      FROM counts JOIN totals USING (field))
"""
_P4_RULES = {"body": (3, 5), "subreddit": (5, 0)}


@catalog.add("p4_found", _P4_SQL + "SELECT field, term, mark FROM marked WHERE mark IS NOT NULL")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked_terms(_p4_ledger(spark, sf_dir), _P4_RULES).where(F.col("mark").isNotNull()).select("field", "term", "mark")


@catalog.add("p4_frequency", _P4_SQL + "SELECT field, term, occurrences, records, mark FROM marked")
def p4_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked_terms(_p4_ledger(spark, sf_dir), _P4_RULES)


_P4_UNIQUE = f"""
    WITH superfluous AS ({general.catalog.sql["p2_found"]}),
    kept AS (SELECT row_id, body, lower(trim(subreddit)) AS subreddit FROM lcr_pass1b_canonical WHERE row_id NOT IN (SELECT row_id FROM superfluous)),
"""


@catalog.add("p4_unique", _P4_UNIQUE + _P4_SQL.replace("lcr_pass1b_canonical", "kept").replace("WITH words", "words", 1) + "SELECT field, term, occurrences, records, mark FROM marked")
def p4_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counts after superfluous deliveries were deleted and other spellings of a subreddit changed, as two more changes."""
    rows = texts(spark, sf_dir, "lcr_pass1b_canonical").select("row_id", "body", "subreddit")
    ledger = _p4_ledger(spark, sf_dir)
    gone = general.catalog.queries["p2_found"](spark, sf_dir)
    dropped = materialize(rows.join(gone, "row_id"), "dropped")
    ledger.apply("body", removed=dropped, value="body", tokenized=True)
    ledger.apply("subreddit", removed=dropped, value="subreddit", tokenized=False)
    plain = F.lower(F.trim("subreddit"))
    changed = rows.where(F.col("subreddit") != plain).join(dropped.select("row_id"), "row_id", "left_anti").select("subreddit", plain.alias("plain"))
    ledger.apply("subreddit", removed=changed, value="subreddit", tokenized=False)
    ledger.apply("subreddit", added=changed, value="plain", tokenized=False)
    return marked_terms(ledger, _P4_RULES)


def _p5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        table(spark, sf_dir, name).select(F.col("row_id").cast("long").alias("row"), thread_key(F.col("post_id"), F.col("row_id")).alias("thread"), F.col(field).alias("text"))
        for name, field in (("lcr_pass1b_canonical", "body"), ("memory_lcr_candidates", "context"))
    ]
    return parts[0].unionByName(parts[1])


_P5_SQL = """
    WITH t AS (
      SELECT row_id, post_id, body AS x FROM lcr_pass1b_canonical UNION ALL SELECT row_id, post_id, context FROM memory_lcr_candidates),
    k AS (
      SELECT row_id, x, coalesce('p:' || nullif(regexp_replace(lower(trim(post_id)), '^t3_', ''), ''), 'r:' || row_id) AS thread FROM t WHERE length(x) >= 240),
    w AS MATERIALIZED (SELECT DISTINCT row_id, thread, md5(substring(x, i, 240)) AS h FROM (SELECT row_id, thread, x, unnest(range(1, length(x) - 238)) AS i FROM k)),
    s AS (SELECT h FROM w GROUP BY h HAVING min(thread) <> max(thread)),
    m AS MATERIALIZED (SELECT row_id, thread, h FROM w SEMI JOIN s USING (h))
    SELECT DISTINCT a.row_id AS row_a, b.row_id AS row_b FROM m a JOIN m b ON a.h = b.h AND a.row_id < b.row_id AND a.thread <> b.thread
"""


@catalog.add("p5_found", _P5_SQL)
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SharedSpans(_p5_records(spark, sf_dir)).pairs()


@catalog.add("p5_classes")
def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each span that is shared: how many records and threads have it, and how many pairs it links."""
    return SharedSpans(_p5_records(spark, sf_dir)).classes()


@catalog.add("p5_members")
def p5_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SharedSpans(_p5_records(spark, sf_dir)).members().select("class", F.col("row").alias("row_id"))


@catalog.add("p5_extent")
def p5_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _p5_records(spark, sf_dir)
    shared = SharedSpans(records).extents()
    sizes = records.select(F.col("row").alias("row_id"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))
    shared = shared.withColumnRenamed("row", "row_id")
    return sizes.join(shared, "row_id", "left").select("row_id", "n_chars", F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"), F.round(F.coalesce(F.col("shared_chars") / F.col("n_chars"), F.lit(0.0)), 4).alias("share"))


P3_FIELDS = (("lcr_pass1b_canonical", "body"), ("memory_lcr_candidates", "context"), ("round_1_positive_cases", "full_context"))


def _union(parts: list[DataFrame]) -> DataFrame:
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    return df


@catalog.add("p3_found")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "name_lexicon")
    return _union([find_kinds(texts(spark, sf_dir, t), names, text=c).select(F.lit(t).alias("src"), "row_id", "kind") for t, c in P3_FIELDS])


@catalog.add("p3_redacted")
def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "name_lexicon")
    return _union([redact(texts(spark, sf_dir, t), names, text=c).select(F.lit(t).alias("src"), "row_id", "redacted") for t, c in P3_FIELDS])


@catalog.add("p8_ids")
def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(texts(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


_GRAMS = "SELECT {k}, array_to_string(w[i + 1:i + 12], ' ') AS g FROM (SELECT {k}, w, unnest(range(len(w) - 11)) AS i FROM (SELECT {k}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}]+') AS w FROM {t} WHERE text IS NOT NULL) WHERE len(w) >= 12)"


@catalog.add("p9_found", f"SELECT DISTINCT doc_id, item_id FROM ({_GRAMS.format(k='doc_id', t='documents')}) JOIN ({_GRAMS.format(k='item_id', t='eval_items')}) USING (g)")
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked(texts(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id").distinct()


@catalog.add("p9_second_benchmark")
def p9_second_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One index of the documents, opened again for the answers after the texts: spans of eight words."""
    path = ShardIndex.build(texts(spark, sf_dir, "documents")).path
    items = table(spark, sf_dir, "eval_items")
    parts = [ShardIndex.open(spark, path).search(items.select("item_id", F.col(c).alias("text")), n=8).select(F.lit(c).alias("field"), "doc", "item_id", "from_word", "to_word") for c in ("text", "answer")]
    return parts[0].unionByName(parts[1]).withColumnRenamed("doc", "doc_id")


@catalog.add("p10_found")
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_sentences(texts(spark, sf_dir, "documents")).select("doc_id", "end_char")


@catalog.add("p10_sentences")
def p10_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_sentences(texts(spark, sf_dir, "documents"))


P6_FIELDS = (("lcr_pass1b_canonical", "body"), ("yield_search_candidates", "context"))


@catalog.add("p6_found")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _union([find_markup(texts(spark, sf_dir, t), text=c).select(F.lit(t).alias("src"), "row_id", "markup") for t, c in P6_FIELDS])


@catalog.add("p6_clean")
def p6_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _union([clean_markup(texts(spark, sf_dir, t), text=c).select(F.lit(t).alias("src"), "row_id", "clean_text") for t, c in P6_FIELDS])


_LINK = r"https?://[^\s)\]}>\"'|]+"


@catalog.add("p6_differenced")
def p6_differenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The named method on what is nearest to a page's address here: the first link in a text. It doesn't find markup."""
    rows = texts(spark, sf_dir, "lcr_pass1b_canonical").select("row_id", "body", F.nullif(F.regexp_extract("body", _LINK, 0), F.lit("")).alias("link"))
    return difference_pages(rows, url="link", text="body", id_col="row_id").where("removed > 0")


@catalog.add("p7_found")
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = texts(spark, sf_dir, "lcr_pass1b_canonical")
    return find_residue(rows, fit(rows, text="body"), text="body")

"""Declared schemas; nothing is inferred."""

from pyspark.sql import types as T

_s = lambda *names: [T.StructField(n, T.StringType()) for n in names]

CORPUS = T.StructType(_s("post_id", "body", "createdAt", "subreddit", "type", "comment_id", "parent_id", "source", "retrieval_provenance") + [T.StructField("r2_any_match", T.BooleanType())])
TERMS = T.StructType(_s("term", "provenance_case_id", "pattern_type", "confidence", "retrieval_action"))
PAGE_ITEM = T.StructType([T.StructField("id", T.StringType()), T.StructField("parent", T.StringType()), T.StructField("text", T.StringType()), T.StructField("created_utc", T.LongType())])

import json

import pytest
from pyspark.sql import functions as F

from wordloom import schemas
from wordloom.sources import files, sinks
from wordloom.sources.paged import PagedSource, Rejected, Transient, check_status, fetch_with_retry
from wordloom.streaming import ingest


def test_csv_round_trip(spark, tmp_path):
    rows = [("a", 'line\nbreak "q"', "null", "high", None)]
    df = spark.createDataFrame(rows, schemas.TERMS)
    files.write_csv(df, str(tmp_path / "c"))
    back = files.read_csv(spark, str(tmp_path / "c"), schemas.TERMS).head()
    assert back["provenance_case_id"] == 'line\nbreak "q"' and back["pattern_type"] == "null"


def test_append_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    for _ in range(2):
        files.append(df, str(tmp_path / "p"), "k")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2


def test_tables_gexf_bibtex_state(spark, tmp_path):
    df = spark.createDataFrame([("a_b", "c|d", 3)], "src string, dst string, weight int")
    assert files.report_table(df).splitlines()[2] == r"| a_b | c\|d | 3 |" and r"a\_b" in files.report_table(df, "latex")
    files.write_gexf(df, str(tmp_path / "g.gexf"))
    assert 'source="a_b"' in (tmp_path / "g.gexf").read_text()
    (tmp_path / "r.bib").write_text("@article{k1,\n author = {A {B}},\n year = {2020}\n}\n@book{k2, title=\"T\"}\n")
    got = {r["key"]: r["fields"] for r in files.read_bibtex(spark, str(tmp_path / "r.bib")).collect()}
    assert got == {"k1": {"author": "A {B}", "year": "2020"}, "k2": {"title": "T"}}
    s = spark.createDataFrame([(1, '{"m": ["x", "y"], "n": "z"}'), (2, None)], "id int, j string")
    assert files.merge_json_state(s, "id", F.col("j"), ["m", "n"]).orderBy("id").head().asDict() | {"j": 0} == {"id": 1, "j": 0, "m": "x|y", "n": "z"}


def test_paged_source(spark, tmp_path):
    for feed in "ab":
        (tmp_path / f"{feed}.jsonl").write_text("".join(json.dumps({"id": f"{feed}{i}", "text": "t", "created_utc": i // 3}) + "\n" for i in range(25)))
    spark.dataSource.register(PagedSource)
    df = spark.read.format("paged").option("feeds", "a,b").option("pages", str(tmp_path)).option("limit", 4).load()
    assert df.count() == 50 and df.distinct().count() == 50


def test_paged_modes(spark, tmp_path):
    items = [{"id": f"i{i}", "parent": f"t{i % 4}", "text": "x", "created_utc": 100 + i // 2} for i in range(40)]
    (tmp_path / "a.jsonl").write_text("".join(json.dumps(x) + "\n" for x in items))
    spark.dataSource.register(PagedSource)
    read = lambda **o: [r["id"] for r in spark.read.format("paged").options(feeds="a", pages=str(tmp_path), limit="3", **o).load().collect()]
    of = lambda *ts: sorted(x["id"] for x in items if x["parent"] in ts)
    assert sorted(read()) == sorted(x["id"] for x in items)
    assert sorted(read(mode="threads", ids="t1,t3,zz", idsperpartition="1")) == of("t1", "t3")
    assert sorted(read(mode="threads", ids="t1,t3", maxpages="99")) == of("t1", "t3")  # by pages
    assert read(mode="first", ids="t2") == ["i38", "i34", "i30"]
    assert read(maxpages="1") == ["i38", "i39", "i36", "i37"]  # the page keeps both of its last second


def test_retry():
    waits, left = [], [Transient("rate"), Transient("rate"), Transient("server"), Transient("network"), "page"]

    def call():
        x = left.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    assert fetch_with_retry(call, sleep=waits.append) == "page" and waits == [60, 120, 30, 10]
    left = [Transient("network")] * 3 + ["page"]
    with pytest.raises(Transient):
        fetch_with_retry(call, sleep=lambda _: None)
    left = [Rejected("400")]
    with pytest.raises(Rejected):
        fetch_with_retry(call)
    for status, error in ((429, "rate"), (422, "rate"), (503, "server")):
        with pytest.raises(Transient, match=error):
            check_status(status)
    with pytest.raises(Rejected):
        check_status(400, "unknown parameter")
    check_status(200)


def test_json_lines_and_embeddings(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", [0.5, 1.5]), (2, None, None)], "k int, v string, e array<double>")
    sinks.write_jsonl(df.select("k", "v"), str(tmp_path / "j"))
    assert sorted(tuple(r) for r in sinks.read_jsonl(spark, str(tmp_path / "j"), "k int, v string").collect()) == [(1, "a"), (2, None)]
    sinks.write_embeddings(df, str(tmp_path / "e"), "k", "e")
    back = sinks.read_embeddings(spark, str(tmp_path / "e"), spark.createDataFrame([(3,), (1,)], "k int"), "k")
    assert {r["k"]: r["vector"] for r in back.collect()} == {1: [0.5, 1.5], 3: None}
    with pytest.raises(ValueError):
        sinks.write_embeddings(df.union(df), str(tmp_path / "f"), "k", "e")


def test_state_gate(spark):
    t = spark.createDataFrame([("a",), ("b",), ("c",)], "case string")
    s = spark.createDataFrame([("a", '{"x": "1", "l": ["p", "q"]}'), ("b", '{"x": "2"}')], "case string, j string")
    filled = sinks.fill_from_state(t, s, "case", "j", {"x": "string", "l": "array<string>"})
    assert sorted(tuple(r) for r in filled.collect()) == [("a", "1", "p|q", True), ("b", "2", None, False), ("c", None, None, False)]
    with pytest.raises(ValueError, match="2 rows"):
        sinks.completeness_gate(filled)
    assert sinks.completeness_gate(filled, partial=True).count() == 3


def test_graph_files(spark, tmp_path):
    e = spark.createDataFrame([("a", "b", 2, "post"), ("a", "c", 1, "comment")], "src string, dst string, weight int, kind string")
    files.write_graph(e, str(tmp_path / "g"), by="kind")
    assert {(r["kind"], r["id"]): r["degree"] for r in spark.read.parquet(str(tmp_path / "g/nodes")).collect()} == {("post", "a"): 1, ("post", "b"): 1, ("comment", "a"): 1, ("comment", "c"): 1}
    paths = files.write_gexf(e, str(tmp_path / "x"), by="kind")
    assert [p.rpartition("/")[2] for p in paths] == ["comment.gexf", "post.gexf"] and 'target="c"' in open(paths[0]).read()


def test_reference_lines(spark, tmp_path):
    (tmp_path / "r.bib").write_text("@article{z, author = {Doe, Jane Ann and {The Group}}, title = {On {X}}, journal = {J}, volume = {3}, number = {2}, pages = {1--9}, year = {2021}, doi = {10.1/x}}\n@misc{a, author = {Ann Zu}, title = {Only}}\n@misc{n, title = {Unseen}}\n")
    bib = files.read_bibtex(spark, str(tmp_path / "r.bib"))
    assert files.references(bib, ["z", "a"]) == ["Zu, A. (n.d.). Only.", "Doe, J. A., & The Group (2021). On X. J, 3(2), 1–9. https://doi.org/10.1/x"]


def test_streaming(spark, tmp_path):
    src = spark.createDataFrame([("p1", None, "hello there friend", "2025-01-01 10:00:00"), ("t3_P1 ", None, "hello there friend", "2025-01-01 11:00:00"), ("p2", "c1", "[removed]", "2025-01-01 12:00:00")], "post_id string, comment_id string, body string, ts string").select("post_id", "comment_id", "body", F.col("ts").cast("timestamp").alias("ingested_at"))
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = ingest.to_parquet(ingest.arriving(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    assert ingest.daily_terms(stream, ["friend"]).isStreaming

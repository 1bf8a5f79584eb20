import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from wordloom.operators.redelivery import DeliveryIndex, redelivered

SCHEMA = "row_id long, post_id string, comment_id string, ingested_at timestamp, key string, order string"


def brute(rows):
    best = {}
    for r, p, c, t, *_ in rows:
        clean = lambda x, k: (x or "").strip().lower().removeprefix(k)
        key = ("c", clean(c, "t1_")) if clean(c, "t1_") else ("p", clean(p, "t3_")) if clean(p, "t3_") else None
        if key:
            best.setdefault(key, []).append((t or datetime.max, r))
    return {r for v in best.values() for _, r in sorted(v)[1:]}


def test_against_brute_force(spark):
    rnd = random.Random(1)
    t0 = datetime(2025, 1, 1)
    rows = []
    for i in range(600):
        k = "hot" if rnd.random() < 0.34 else f"k{rnd.randrange(150)}"
        pid = rnd.choice([k, k.upper(), f" t3_{k} ", None, "", "  "])
        cid = rnd.choice([None, None, "", f"t1_{k}", k])
        at = rnd.choice([None, t0 + timedelta(hours=rnd.randrange(40))])
        rows.append((i, pid, cid, at, "a", "b"))
    df = spark.createDataFrame(rows, SCHEMA)
    for batches, merge_after in ((1, 8), (5, 2)):
        got = {r[0] for r in redelivered(df, batches=batches, index=DeliveryIndex(spark, prefixes=5, merge_after=merge_after)).collect()}
        assert got == brute(rows)


def test_index_over_later_batches(spark):
    index = DeliveryIndex(spark, prefixes=3, merge_after=2)
    for batch in (["a", "b", "a"], ["b", "c"], ["c", "d", None]):
        df = spark.createDataFrame([(k, i) for i, k in enumerate(batch)], "key string, row long")
        index.add(df.select("key", F.struct("row").alias("order")))
    assert index.winners().count() == 4


def test_empty(spark):
    assert redelivered(spark.createDataFrame([], SCHEMA)).count() == 0


def _batch(spark, keys):
    return spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key string, row long").select("key", F.struct("row").alias("order"))


def test_an_index_is_taken_up_again_and_grows(spark, tmp_path):
    path, rnd, seen = f"file://{tmp_path}/index", random.Random(2), set()
    DeliveryIndex(spark, path, prefixes=2, merge_after=3, parts=2, per_prefix=20)._commit()
    for _ in range(7):
        keys = [f"k{rnd.randrange(900)}" for _ in range(150)]
        index = DeliveryIndex.open(spark, path)  # another object each time, as in another session
        before = {x for r in index._read().select("ids").collect() for x in r[0]} if index.runs else set()
        assert before == seen
        index.add(_batch(spark, keys))
        seen |= set(keys)
    index = DeliveryIndex.open(spark, path)
    assert sum(r["ids"] for r in index.runs) == len(seen) and index.prefixes >= 16 and len(index.runs) < 3
    for r in index._read().collect():
        assert r["ids"] == sorted(r["ids"])


def test_a_batch_reads_only_its_parts(spark):
    index = DeliveryIndex(spark, prefixes=16)
    index.add(_batch(spark, [f"k{i}" for i in range(400)]))
    part = index._placed(_batch(spark, ["k7"]).select("key", F.col("order.row").alias("row")), 16).head()["part"]
    plan = index._read([part])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(part" in plan or "PartitionFilters: [part" in plan.replace("isnotnull(part#", "isnotnull(part#")
    assert {r["part"] for r in index._read([part]).collect()} == {part}


def test_opening_nothing_fails(spark, tmp_path):
    import pytest

    with pytest.raises(FileNotFoundError):
        DeliveryIndex.open(spark, f"file://{tmp_path}/none")

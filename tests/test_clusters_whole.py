"""Density clusters of groups that are larger than a block."""

import math
import random

from wordloom.operators import clusters


def labels(spark, rows, **k):
    df = spark.createDataFrame(rows, "g string, id int, v array<double>")
    return {(r["g"], r["id"]): r["cluster"] for r in clusters.density_clusters(df, "g", "id", "v", **k).collect()}


def test_blocks_give_what_one_task_gives(spark):
    rnd = random.Random(7)
    at = [(rnd.randrange(0, 90, 30), rnd.randrange(0, 60, 30)) for _ in range(240)]
    rows = [("a", i, [x + rnd.randrange(12) / 4, y + rnd.randrange(12) / 4]) for i, (x, y) in enumerate(at)]  # a grid, so many distances are equal
    rows += [("b", i, [float(i % 2) * 50 + i / 100, 0.0]) for i in range(30)] + [("c", i, [0.0, 0.0]) for i in range(3)]
    whole = labels(spark, rows)
    assert len({v for (g, _), v in whole.items() if g == "a"}) >= 6 and {v for (g, _), v in whole.items() if g == "c"} == {-1}
    assert labels(spark, rows, block=35, fold=2) == whole


def test_a_group_above_20000_is_clustered(spark):
    n = 20_001
    rows = [("g", i, [math.cos(i) + (100 if i % 2 else 0), math.sin(i)]) for i in range(n)] + [("g", n, [5000.0, 5000.0])]
    got = labels(spark, rows)
    assert len(got) == n + 1 and got["g", n] == -1
    even, odd = ({got["g", i] for i in range(k, n, 2)} - {-1} for k in (0, 1))
    assert even and odd and not even & odd

"""Order-dependent operators across the borders of ranges, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from loamworks.operators import ranges


@pytest.fixture()
def apart(spark):
    """Ranges stay apart, so that values must cross borders."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def table(spark, n=400, hot=0.5, seed=1):
    r = random.Random(seed)
    rows = [(i, "hot" if r.random() < hot else None if r.random() < 0.1 else f"k{r.randrange(20)}", None if r.random() < 0.7 else f"v{i}") for i in range(n)]
    r.shuffle(rows)
    return rows, spark.createDataFrame(rows, "i int, k string, v string")


@pytest.mark.parametrize("backward", [False, True])
@pytest.mark.parametrize("keyed", [False, True])
def test_fill(apart, keyed, backward):
    rows, df = table(apart)
    assert ranges.ranged(df, [F.col("i")]).select(ranges.RANGE).distinct().count() > 1
    want = {}
    for key in {r[1] for r in rows} if keyed else {0}:
        own = sorted(r for r in rows if not keyed or r[1] == key)
        last = None
        for i, _, v in own:
            last = want[i] = v if v is not None else last
        if backward:
            later = None
            for i, _, v in own[::-1]:
                later = v if v is not None else later
                want[i] = want[i] if want[i] is not None else later
    got = {r["i"]: r["v"] for r in ranges.fill(df, "v", ["i"], ["k"] if keyed else [], backward).collect()}
    assert got == want


def test_running(apart):
    rows, df = table(apart)
    got = {r["i"]: (r["n"], r["s"]) for r in ranges.running(df, [F.desc("i")], {"n": F.lit(1), "s": F.col("i")}).collect()}
    assert got == {i: (400 - i, sum(range(i, 400))) for i in range(400)}


def test_previous(apart):
    rows, df = table(apart)
    want = {}
    for key in {r[1] for r in rows}:
        before = (None, None)
        for i, _, v in sorted(r for r in rows if r[1] == key):
            want[i], before = before, (i, v)
    got = {r["i"]: (r["pi"], r["pv"]) for r in ranges.previous(df, {"i": "pi", "v": "pv"}, ["i"], ["k"]).collect()}
    assert got == want


def test_empty(spark):
    df = spark.createDataFrame([], "i int, k string, v string")
    assert ranges.fill(df, "v", ["i"]).count() == ranges.running(df, [F.col("i")], {"n": F.lit(1)}).count() == ranges.previous(df, {"v": "p"}, ["i"], ["k"]).count() == 0

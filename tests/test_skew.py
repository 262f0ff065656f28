"""Running columns with cut keys equal a plain replay, also with one hot key and bursts."""

import random

from pyspark.sql import functions as F

from trailmark.operators import skew


def _replay(rows):
    want, count, last = {}, {}, {}
    for key, ts, i, v in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        c = count.get(key, (0, 0))
        want[(key, i)] = (c[0] + 1, c[1], last.get(key))
        count[key] = (c[0] + 1, c[1] + v)
        last[key] = v
    return want


def _check(spark, rows, target):
    df = spark.createDataFrame(rows, "k string, ts long, i long, v long").repartition(5)
    out = skew.running(
        df, ["k"], {"ts": F.col("ts"), "i": F.col("i")},
        {
            "rn": skew.row_number(),
            "before": skew.Running("sum_before", F.col("v")),
            "prev": skew.Running("previous", F.col("v")),
        },
        target_rows=target,
    )
    got = {(r.k, r.i): (r.rn, r.before, r.prev) for r in out.collect()}
    assert got == _replay(rows)


def test_hot_key(spark):
    rng = random.Random(1)
    rows = [("hot", rng.randrange(10**9), i, i % 7) for i in range(900)]
    rows += [(f"k{i % 40}", rng.randrange(10**9), 900 + i, i % 5) for i in range(400)]
    rows += [(None, rng.randrange(100), 1300 + i, 1) for i in range(60)]
    _check(spark, rows, 50)


def test_burst_and_ties(spark):
    # Most rows share one instant; the second axis takes over there.
    rows = [("hot", 5, i, 1) for i in range(500)] + [("hot", 10**12, 1000 + i, 2) for i in range(50)] + [("hot", -3, 2000, 3)]
    _check(spark, rows, 40)


def test_plain_path_when_nothing_is_hot(spark):
    rows = [(f"k{i % 3}", i, i, i) for i in range(30)]
    _check(spark, rows, 1000)
    df = spark.createDataFrame(rows, "k string, ts long, i long, v long")
    _, cuts = skew.cut_hot_keys(df, ["k"], ["ts"], 1000)
    assert cuts == []


def test_cuts_bound_the_largest_group(spark):
    rows = [("hot", (i * i) % 10_007, i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, ts long, i long")
    cut, cuts = skew.cut_hot_keys(df, ["k"], ["ts", "i"], 100)
    assert cut.groupBy("k", *cuts).count().agg(F.max("count")).first()[0] <= 100


def test_global_positions(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1009).alias("pos"))
    out = skew.running(df, [], {"pos": F.col("pos")}, {"rn": skew.row_number()}, target_rows=60).orderBy("pos").collect()
    assert [r.rn for r in out] == list(range(1, 1001))
    assert skew.running(df.limit(0), [], {"pos": F.col("pos")}, {"rn": skew.row_number()}).count() == 0


def test_latest(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 9, "b"), (2, 1, "c")], "k int, p int, v string")
    assert {r.k: r.v for r in skew.latest(df, ["k"], F.col("p")).collect()} == {1: "b", 2: "c"}
    assert {r.k: r.v for r in skew.latest(df, ["k"], F.col("p"), "first").collect()} == {1: "a", 2: "c"}

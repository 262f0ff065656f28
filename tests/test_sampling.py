"""Selection of the first rows without ordering the table."""

import random

import pytest
from pyspark.sql import functions as F

from trailmark.operators import sampling, skew


@pytest.mark.parametrize("slots", [4, 4096])
def test_first_rows(spark, monkeypatch, slots):
    monkeypatch.setattr(skew, "SELECT_SLOTS", slots)
    rng = random.Random(4)
    values = [rng.choice([None, 5, 5, 5, 7, -(1 << 62), 1 << 62, rng.randrange(100)]) for _ in range(200)]
    rows = [(v, rng.randrange(3), i) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "a long, b long, c long").repartition(5)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for n in (0, 1, 100, 199, 200) if slots == 4096 else (150,):
        got = sorted(skew.first_rows(df, n, [F.col("a"), F.col("b")]).select("a", "b").collect(), key=repr)
        assert [tuple(r) for r in got] == sorted([r[:2] for r in order[:n]], key=repr), n


def test_equal_rows_and_one_key(spark):
    df = spark.range(1000).select(F.lit(1).alias("src_pos"), F.lit("x").alias("idx"))
    assert sampling.limit_samples(df, 333).count() == 333
    assert sampling.sample_random(df, 10).count() == 10
    assert sampling.limit_samples(df.limit(0), 5).count() == 0


def test_no_window_over_the_table(spark):
    df = spark.range(5000).select(F.col("id").alias("src_pos"), F.col("id").cast("string").alias("idx"), F.create_map(F.lit("k"), F.col("id")).alias("m"))
    for out in (sampling.limit_samples(df, 77), sampling.sample_random(df, 77)):
        assert out.count() == 77 and out.columns == df.columns
        assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.src_pos for r in sampling.limit_samples(df, 77).collect()) == list(range(77))
    again = [sorted(r.idx for r in sampling.sample_random(df.repartition(p), 50, 3).collect()) for p in (2, 7)]
    assert again[0] == again[1]

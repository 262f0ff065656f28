"""The hash index: recall against the exact search, filters before the cut, right scores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.operators import approximate, search


@pytest.fixture(scope="module")
def clustered(spark):
    """Ninety tight groups, one of which holds a third of all rows, and some odd rows."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(90, 32))
    group = np.where(rng.random(3000) < 1 / 3, 0, rng.integers(0, 90, 3000))
    x = centres[group] + 0.15 * rng.normal(size=(3000, 32))
    v = [(i, "task", [float(a) for a in e]) for i, e in enumerate(x)] + [(3000, "task", [0.0] * 32), (3001, "task", None)]
    m = [(i, f"t{i}", 0, i % 10, "e", "correct") for i in range(3002)]
    q = [(i, "task", v[i][2]) for i in range(0, 3000, 25)] + [(9000, "task", [0.0] * 32), (9001, "other", v[0][2])]
    return (
        spark.createDataFrame(q, "query_id long, view string, embedding array<float>"),
        spark.createDataFrame(m, "bank_row long, task_id string, state int, q_value int, experience string, source string"),
        spark.createDataFrame(v, "bank_row long, view string, embedding array<float>").repartition(4),
    )


def rows(hits):
    return {(r.query_id, r.bank_row): r.score for r in hits.collect()}


def test_recall_on_clusters_with_few_pairs(spark, clustered):
    q, m, v = clustered
    index = approximate.fit_cells(v, tables=10, bits=6)
    got = rows(approximate.search_states_approximate(q, m, v, index, 5, 0.2, min_q=3))
    want = rows(search.search_states(q, m, v, 5, 0.2, min_q=3, overfetch=None))
    assert len(want) > 500
    assert len(set(got) & set(want)) >= 0.9 * len(want)
    assert all(abs(got[p] - want[p]) < 1e-9 for p in set(got) & set(want))
    assert all(b % 10 >= 3 for _, b in got)
    # the index, not the tiles, does the work: the cells of a table hold a small part of all pairs
    pairs = index.cells(q).select("query_id", "cell").join(index.cells(v).select("bank_row", "cell"), "cell")
    assert pairs.select("query_id", "bank_row").distinct().count() < 0.35 * q.count() * v.count()


def test_small_tiles_and_excluded_pairs_agree(spark, clustered):
    q, m, v = clustered
    index = approximate.fit_cells(v, tables=4, bits=4)
    out = spark.createDataFrame([(f"t{i}", 0) for i in range(0, 3000, 2)], "task_id string, state int")
    ways = [
        rows(approximate.search_states_approximate(q, m, v, index, 3, 0.0, exclude=out, **tiles))
        for tiles in ({}, {"bank_tile": 37, "query_tile": 11})
    ]
    assert ways[0].keys() == ways[1].keys() and all(b % 2 for _, b in ways[0])


def test_same_cells_again(clustered):
    _, _, v = clustered
    a, b = (sorted(map(tuple, approximate.fit_cells(v, 3, 2).cells(v).select("bank_row", "cell").collect())) for _ in range(2))
    assert a == b and len(a) == 3 * 3001


def test_every_score_of_the_index_is_checked(spark, tmp_path, monkeypatch):
    """The scores of the hits of lowest rank in the exact search are checked as well."""
    from trailmark.plans import vectors as plans

    rng = np.random.default_rng(5)
    rows = [(i, [float(a) for a in rng.normal(size=8)], 2 + i % 8) for i in range(60)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    right = {r.view: r.all_scores_right for r in plans.approximate_recall(spark, str(tmp_path)).collect()}
    assert len(right) == 3 and all(right.values())
    best = approximate.search_states_approximate

    def with_far_ones(q, meta, vec, index, *args, **options):
        far = search.search_states(q, meta, vec, 60, -1.0, 2, overfetch=None).where("rank > 45").withColumn("score", F.col("score") + 0.5)
        return best(q, meta, vec, index, *args, **options).unionByName(far)

    monkeypatch.setattr(approximate, "search_states_approximate", with_far_ones)
    wrong = {r.view: r.all_scores_right for r in plans.approximate_recall(spark, str(tmp_path)).collect()}
    assert len(wrong) == 3 and not any(wrong.values())

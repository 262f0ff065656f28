"""Findings of the third review, each with rows of its own."""

import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from trailmark.session import checkpoint_dir


@pytest.fixture
def folder(spark):
    return f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"


@pytest.mark.parametrize("as_folder", [False, True])
def test_a_table_of_several_files_is_streamed(spark, folder, as_folder, tmp_path):
    from trailmark.plans import streams

    rows = spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(9)], "doc_id long, quality long, toxic long")
    if as_folder:
        rows.repartition(3).write.parquet(f"{folder}/labels.parquet")
    else:
        folder = str(tmp_path)
        rows.toPandas().to_parquet(f"{folder}/labels.parquet")
    rows.write.parquet(f"{folder}/labels.parquet.old")  # another table beside it
    assert streams.stream_results(spark, folder).count() == 9
    assert sorted((r.flagged, r.total) for r in streams.running_accuracy(spark, folder).collect()) == [(False, 6), (True, 3)]


def clustered(n=10_000, dim=32):
    """Vectors in tight groups, groups of groups far apart: a walk over near centroids does not leave its own."""
    import numpy as np

    rng = np.random.default_rng(5)
    top, mid, low = rng.normal(size=(8, dim)), 0.3 * rng.normal(size=(40, dim)), 0.05 * rng.normal(size=(400, dim))
    at = rng.integers(0, 400, n)
    return top[at // 50] + mid[at // 10] + low[at] + 0.01 * rng.normal(size=(n, dim))


def test_nearest_finds_neighbours_in_far_groups(spark, monkeypatch):
    import numpy as np
    import pandas as pd

    from trailmark.llm import nearest as N
    from trailmark.llm.common import prepare

    monkeypatch.setattr(N, "LIST_ROWS", 40)  # 250 lists
    v = clustered()
    rows = prepare(spark).createDataFrame(pd.DataFrame({"vec_id": range(len(v)), "embedding": v.tolist()}))
    found = N.nearest(rows).toPandas().groupby("query_id")["vec_id"].apply(set)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    ids = np.arange(0, len(v), 50)
    near = unit[ids] @ unit.T
    near[np.arange(len(ids)), ids] = -2
    true = np.argpartition(-near, 5, axis=1)[:, :5]
    assert np.mean([len(found[q] & set(t)) / 5 for q, t in zip(ids, true.tolist())]) >= 0.95


def test_a_query_on_a_centroid_has_finite_ratios():
    import numpy as np

    from trailmark.llm.nearest import CentroidGraph

    c = np.eye(3)
    assert np.isfinite(CentroidGraph.ratios(c, c)).all()


def test_reindex_orders_ranges_of_positions(spark):
    from trailmark.operators.trajectories import reindex

    places = [None, -5, *range(0, 60_000, 2), 59_998, 1 << 40]
    rows = spark.createDataFrame([(p, "text") for p in places], "src_pos long, text string")
    out = reindex(rows)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_range" in plan  # whole rows are dealt by range, not to one task
    got = sorted((r.idx, -1e9 if r.src_pos is None else r.src_pos) for r in out.collect())
    assert got == list(enumerate(sorted(-1e9 if p is None else p for p in places)))
    crowded = reindex(rows, target_rows=100).select("idx").collect()
    assert sorted(r.idx for r in crowded) == list(range(len(places)))


def test_loose_options_of_bare_labels(spark):
    from trailmark.functions.choices import loose_option_lines

    texts = ["A\nB\nC. three\nD", "A.\nred\nB) blue", "A\n", "a one\nb two", "", None, "A\nB\nC\n", "A x B: y"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", loose_option_lines("t").alias("c")).orderBy("i")
    assert [r.c for r in got.collect()] == [["B", "three"], ["red", "blue"], [""], ["one", "two"], [], [], ["B", ""], ["x"]]


def test_small_tiles_travel_together(spark):
    """Rows handed to the tasks grow with the input, not with the number of small tiles."""
    import numpy as np

    from trailmark.operators import search, topk

    rng = np.random.default_rng(3)
    rows = [(i, "task", [float(x) for x in rng.integers(-3, 4, 8)]) for i in range(400)]
    bank = spark.createDataFrame(rows, "bank_row long, view string, embedding array<float>").repartition(2)
    asked = bank.withColumnRenamed("bank_row", "query_id")
    seen, scan = [], topk._scan
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(topk, "_merged", lambda lists, keys, width, per_task, merge=topk._merged: (seen.append(lists.count()), merge(lists, keys, width, per_task))[1])
        small = search.candidates(asked, bank, 5, 0.1, bank_tile=7, query_tile=9)
        got = sorted(map(tuple, small.collect()))
    assert seen[0] <= 400  # one list per query
    assert got == sorted(map(tuple, search.candidates(asked, bank, 5, 0.1).collect())) and scan


def test_models_get_small_parts_of_a_batch(spark):
    import numpy as np

    from trailmark.functions import models

    class Checked(models.HashEncoder):
        def encode(self, texts, images):
            assert len(texts) <= 4
            return super().encode(texts, images)

    schema = "i int, text string, images array<string>, steps array<struct<a:int,b:string>>"
    rows = spark.createDataFrame([(i, None if i == 3 else f"t{i}", None if i % 2 else ["p", None, "q"], [(i, "x")]) for i in range(30)], schema).coalesce(1)
    out = models.embed(rows, Checked, images="images", batch_size=4).orderBy("i").collect()
    assert [tuple(r)[:4] for r in out] == [tuple(r) for r in rows.orderBy("i").collect()]
    one = models.HashEncoder()
    assert all(np.allclose(r.embedding, one.encode([r.text or ""], [[p for p in r.images or [] if p]])[0]) for r in out)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(8 << 20)


def test_json_ranges_are_small_enough_to_outline():
    import inspect
    import tracemalloc

    from trailmark.sources import ranges

    size = inspect.signature(ranges.read_json_list).parameters["range_bytes"].default
    tracemalloc.start()
    ranges._marks((b'{"a": "x,\\"y"},' * (size // 15 + 1))[:size], ranges.OUTSIDE)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400e6


def test_texts_of_a_bank_do_not_come_back_from_the_models(spark):
    import inspect

    import numpy as np

    from trailmark.functions import models

    assert all(inspect.getsource(models).count(f"\n{what}(") == 1 for what in ("def embed", "def annotate", "def _retry"))
    rows = spark.createDataFrame([(i, f"t{i}" * i, [f"p{j}" for j in range(i % 5)]) for i in range(40)], "i int, text string, images array<string>").coalesce(1)
    out = models.embed(rows, models.HashEncoder, images="images", batch_size=7, keep=["i"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan and out.columns == ["i", "embedding"]

    def one(text):
        raw = np.frombuffer(hashlib.md5(text.encode()).digest(), np.uint8)
        return (raw.astype(np.float64) / 255.0 - 0.5).astype(np.float32)

    for r, asked in zip(out.orderBy("i").collect(), rows.orderBy("i").collect()):
        want = np.mean([one(f"{asked.text}|{p}") for p in asked.images], axis=0) if asked.images else one(asked.text)
        assert np.array_equal(np.float32(r.embedding), want)

"""Arrays and JSON lists of one file, read in many ranges."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.sources import ranges


@pytest.mark.parametrize("dtype", ["<f4", "<f8", "<i2", "?"])
def test_rows_of_arrays(spark, tmp_path, dtype):
    rng = np.random.default_rng(1)
    one, two = (rng.normal(size=(1001, 5)) * 3).astype(dtype), rng.integers(0, 2, 77).astype(dtype)
    np.save(tmp_path / "a.npy", one)
    np.save(tmp_path / "b_mask.npy", two)
    np.save(tmp_path / "empty.npy", np.zeros((0, 5), dtype))
    df = ranges.read_arrays(spark, f"{tmp_path}/*.npy", 1000)
    assert df.rdd.getNumPartitions() >= one.nbytes // 1000
    got = {(r.name, r.bank_row): r.embedding for r in df.collect()}
    assert len(got) == 1078
    assert all(np.allclose(got["a", i], one[i].astype(np.float32)) for i in range(1001))
    assert [got["b_mask", i][0] for i in range(77)] == two.astype(float).tolist()


def test_arrays_that_are_no_tables(spark, tmp_path):
    np.save(tmp_path / "f.npy", np.asfortranarray(np.ones((3, 4))))
    with pytest.raises(Exception, match="stored by rows"):
        ranges.read_arrays(spark, f"{tmp_path}/f.npy").collect()
    with pytest.raises(Exception):
        ranges.read_arrays(spark, f"{tmp_path}/none.npy").collect()


def _value(rng, depth=0):
    text = "".join(rng.choice(['"', "\\", "]", "[", "{", "}", ",", "é", "中", "a", " ", "\n", "\\\\", '\\"']) for _ in range(rng.randrange(9)))
    kind = rng.randrange(5 if depth < 3 else 2)
    if kind < 2:
        return text
    if kind == 2:
        return rng.choice([None, True, 1.5, -7])
    if kind == 3:
        return [_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {text + str(i): _value(rng, depth + 1) for i in range(rng.randrange(4))}


@pytest.mark.parametrize("size,indent,ascii_", [(7, None, True), (64, 2, False), (1 << 20, None, False)])
def test_elements_of_json_lists(spark, tmp_path, size, indent, ascii_):
    rng = random.Random(size)
    items = [{"task_id": f"t{i}", "experience": _value(rng), "n": i} for i in range(120)]
    (tmp_path / "x.json").write_text(" \n" + json.dumps(items, indent=indent, ensure_ascii=ascii_) + "\n ")
    df = ranges.read_json_list(spark, f"{tmp_path}/x.json", size)
    got = {r.position: r.raw for r in df.collect()}
    assert sorted(got) == list(range(120))
    assert [json.loads(got[i]) for i in range(120)] == items


def test_texts_and_empty_lists(spark, tmp_path):
    texts = ["plain", 'with "quotes", commas and ] brackets', "", "back\\slash\\", "é\n中"]
    (tmp_path / "t.json").write_text(json.dumps(texts))
    for size in (1, 5, 1000):
        assert [r.raw for r in ranges.read_json_list(spark, f"{tmp_path}/t.json", size).orderBy("position").collect()] == texts
    for text in ("[]", " [ \n ] "):
        (tmp_path / "e.json").write_text(text)
        assert ranges.read_json_list(spark, f"{tmp_path}/e.json", 1).collect() == []


def test_one_element_over_many_ranges(spark, tmp_path):
    long = ["a", "b" * 5000 + ',"]', {"x": "c"}]
    (tmp_path / "l.json").write_text(json.dumps(long))
    got = ranges.read_json_list(spark, f"{tmp_path}/l.json", 100).orderBy("position").select("position", F.length("raw").alias("n")).collect()
    assert [(r.position, r.n) for r in got] == [(0, 1), (1, 5003), (2, 9)]


def test_a_file_has_one_writer_when_its_rows_are_many(spark, tmp_path):
    """A join that becomes a broadcast join while it runs must not give the rows of one file to several tasks."""
    small = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "4k",
        "spark.sql.autoBroadcastJoinThreshold": "1k", "spark.sql.adaptive.autoBroadcastJoinThreshold": "20k",
    }
    before = {k: spark.conf.get(k, None) for k in small}
    rows = spark.range(0, 24_000, 1, 8).select(
        F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("id") % 3 + 1).cast("int")).alias("name"),
        F.floor(F.col("id") / 3).alias("bank_row"), F.array(F.col("id").cast("float"), F.rand(1).cast("float")).alias("embedding"),
    )
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        written = ranges.write_arrays(rows, str(tmp_path))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert written == 24_000
    for i, name in enumerate("abc"):
        assert np.load(tmp_path / f"{name}.npy")[:, 0].tolist() == [3.0 * n + i for n in range(8_000)]

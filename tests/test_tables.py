"""Files, banks, media, samples, comparisons and regions on small fixtures."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.functions import choices as C
from trailmark.functions import geometry as G
from trailmark.functions import jsons as J
from trailmark.functions import models, tools
from trailmark.operators import banks, compare, filters, regions, reports, sampling, scoring
from trailmark.operators import samples as S
from trailmark.sources import banks as SB
from trailmark.sources import media, tables


def one(spark, text):
    return spark.createDataFrame([(text,)], "t string")


@pytest.mark.parametrize("dialect,text,want", [
    ("choices_block", "Q\nChoices:\nA:1\nB: 2\n\nplain", ["1", "2", "plain"]),
    ("choices_block", "no block", []),
    ("comma_options", "Q Options: A: x, y, B: z", ["x, y", "z"]),
    ("split_options", "Options: A: one, B: two.; C: three", ["one", "two", "three"]),
    ("colon_option_lines", " A) x\nb: y \nE: no\nA: ", ["x", "y"]),
    ("paren_option_lines", "Q\n(A) x\n(B) \nAnswer with the letter\n(C) no", ["x", ""]),
    ("semicolon_options", "A. x;B. y;;z", ["x", "y", "z"]),
    ("dotted_option_lines", "Q\nB. two\nA. one\n C. no", ["one", "two"]),
    ("labelled_list", "(A): x (B): y, z", ["x", "y, z"]),
    ("lettered_lines", "A. x\nf) y\nG. no", ["x", "y"]),
    ("loose_option_lines", "Q?\nA. x\nB) y", ["x", "y"]),
    ("prompt_option_lines", "Q\nA: 65%\n B. b", ["65%", "b"]),
    ("literal_options", "['a', \"b's\"]", ["a", "b's"]),
    ("literal_options", "(A) x (B) y", ["x", "y"]),
    ("literal_options", "x\n\ny", ["x", "y"]),
    ("literal_options", "['a', None, 'b']", ["a", "b"]),
    ("literal_options", "[1.50, True]", ["1.5", "True"]),
    ("literal_options", "['x', 'y',]", ["x", "y"]),
    ("literal_options", "['a' 'b', 'c']", ["ab", "c"]),
    ("literal_options", "[r'\\frac{1}{2}', 'b']", ["\\frac{1}{2}", "b"]),
    ("literal_options", "[open('x')]", ["[open('x')]"]),
    ("literal_options", None, []),
])
def test_parse_choices(spark, dialect, text, want):
    assert one(spark, text).select(C.parse_choices("t", dialect)).first()[0] == want


def test_answers(spark):
    df = spark.createDataFrame(
        [("(b)",), ("hidden",), ("D",), ("B)",), (None,), ("['x']",), (" c ",)], "a string"
    ).withColumn("c", F.array(F.lit("one"), F.lit("two"), F.lit("three")))
    got = df.select(
        C.answer_text("a", "c", hidden=True), C.literal_answer("a", "c"), C.single_letter_answer("a", "c"),
        C.answer_text("a", "c", strip_answer=True),
    ).collect()
    assert [g[0] for g in got] == ["two", "", "D", "two", "", "['x']", " c "]
    assert [g[1] for g in got] == ["two", "hidden", "D", "two", "", "x", "three"]
    assert [g[2] for g in got][:3] == ["(B)", "HIDDEN", "D"]
    assert got[6][3] == "three"
    raw = spark.createDataFrame([("(B)",), ("(A) x",), ("zz",), ("",)], "a string").withColumn("r", F.array(F.lit("(A) x"), F.lit("B. y")))
    assert [r[0] for r in raw.select(C.bracketed_answer("a", "r")).collect()] == ["y", "x", "zz", ""]


def test_samples_keep_and_number(spark):
    df = spark.createDataFrame(
        [(0, "Q", None, "A", "open"), (1, "Q", "['x', 'y']", "B", None), (2, "Q", "['x', 'y']", "(A)", "multiple-choice")],
        "src_pos long, question string, options string, answer string, question_type string",
    ).withColumns({"subfield": F.lit(""), "topic_difficulty": F.lit("t"), "images": F.array().cast("array<string>")})
    rows = S.to_samples(df, "mmmu").orderBy("idx").collect()
    assert [(r.idx, r.src_pos, r.answer, r.sub_task) for r in rows] == [(0, 1, "y", "t"), (1, 2, "x", "t")]
    gaps = S.to_samples(df, "mmmu", idx_mode="source").orderBy("idx").collect()
    assert [r.idx for r in gaps] == [1, 2]


def test_json(spark):
    texts = ['x ```json\n{"a": 1}\n``` {', "say [1, 2] ok", '{"a": {"b": 1}, "c": 2}', "none", "12"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.j for r in df.select(J.extract_json("t").alias("j")).collect()]
    assert [(g.kind, g.raw) for g in got] == [
        ("object", '{"a": 1}'), ("array", "[1, 2]"), ("text", texts[2]), ("text", "none"), ("scalar", "12"),
    ]
    assert [r[0] for r in df.select(J.extract_json_object("t")).collect()] == ['{"a": 1}', "{}", texts[2], "{}", "12"]


def test_bank_import_and_merge(spark, tmp_path):
    root = tmp_path / "bank"
    (root / "views").mkdir(parents=True)
    meta = [{"task_id": "a", "state": i, "experience": f"e{i}", "q_value": 7, "available_views": ["task"], "source": "correct"} for i in range(3)]
    (root / "state_meta.json").write_text(json.dumps(meta))
    np.save(root / "views" / "question+task.npy", np.eye(3, dtype=np.float32))
    np.save(root / "views" / "question+task_mask.npy", np.array([True, False, True]))
    np.save(root / "views" / "task.npy", np.ones((3, 3), dtype=np.float32))
    m, v = SB.import_state_bank(spark, str(root))
    assert sorted((r.view, r.bank_row) for r in v.collect()) == [("question+task", 0), ("question+task", 2), ("task", 0), ("task", 1), ("task", 2)]
    assert m.orderBy("bank_row").first().experience == "e0"
    assert banks.validate_bank(m, v).count() == 0
    mm, mv = banks.merge_banks([("x", m, v), ("y", m, v)])
    assert sorted(r.bank_row for r in mm.collect()) == list(range(6)) and mm.where("bank_row = 4").first().task_id == "y_a"
    assert mv.count() == 10
    gaps = [(p, m.where("bank_row <> 1"), v.where("bank_row <> 1")) for p in ("x", "y")]
    mm, mv = banks.merge_banks(gaps)
    assert sorted(r.bank_row for r in mm.collect()) == [0, 2, 3, 5]
    assert banks.validate_bank(mm, mv).count() == 0
    with pytest.raises(ValueError, match="bank y has vectors"):
        banks.merge_banks([("x", m, v), ("y", m, v.withColumn("embedding", F.slice("embedding", 1, 2)))])
    np.save(root / "views" / "images.npy", np.ones((2, 3), dtype=np.float32))
    with pytest.raises(ValueError, match="images has 2 rows"):
        SB.import_state_bank(spark, str(root))


def test_old_trace_bank(spark, tmp_path):
    (tmp_path / "experiences.json").write_text(json.dumps(["old one", {"experience": "new", "source": "incorrect", "task_id": "t"}]))
    np.save(tmp_path / "embeddings.npy", np.eye(2, dtype=np.float32))
    rows = SB.import_trace_bank(spark, str(tmp_path)).orderBy("bank_row").collect()
    assert [(r.experience, r.source, r.task_id) for r in rows] == [("old one", "correct", ""), ("new", "incorrect", "t")]
    assert rows[1].embedding == [0.0, 1.0]


def test_result_and_stats_files(spark, tmp_path):
    (tmp_path / "results.jsonl").write_text('{"idx": 1, "is_correct": true, "sub_task": "a"}\n\n{"idx": 2, "is_correct": false}\n')
    r = tables.read_results(spark, str(tmp_path / "results.jsonl"))
    assert r.count() == 2
    s = r.select("idx", F.col("idx").alias("src_pos"), F.lit("multi-choice").alias("type"), "sub_task")
    meta = {"model_name": "m", "qa_type": "tool"}
    tables.write_stats(scoring.eval_stats(r), scoring.stats_by(s, r, "type"), scoring.stats_by(s, r, "sub_task"), str(tmp_path / "stats"), meta)
    row = tables.read_stats(spark, str(tmp_path / "stats")).first()
    assert row.label == "m (tool)" and row.accuracy == 0.5 and row.by_subtask["unknown"].total == 1


def test_sources(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("index\tquestion\n1\t\"a\tb\"\n2\tc\n")
    rows = tables.read_source(spark, str(tmp_path / "t.tsv"), "tsv").collect()
    assert [r.question for r in rows] == ["a\tb", "c"]
    (tmp_path / "l.json").write_text('[{"a": 1}, {"a": 2}]')
    assert tables.read_source(spark, str(tmp_path / "l.json"), "json").count() == 2
    p = tables.profile_tables({"one": spark.createDataFrame([(1, "x" * 200)], "a int, b string")}).first()
    assert (p.n_rows, p.column_names) == (1, "a,b") and p.sample.endswith("...")


def test_media(spark):
    files = spark.createDataFrame([("/m/t/img_0.png", 1), ("/m/t/img_0.jpg", 1), ("/m/t/a.webp", 1)], "path string, length long")
    refs = spark.createDataFrame([("t", "img_0"), ("t", "img_9")], "task_id string, ref_id string")
    assert {r.ref_id: r.path for r in media.resolve_media(refs, files).collect()} == {"img_0": "/m/t/img_0.jpg", "img_9": None}
    asked = spark.createDataFrame([("/m/t/a.png",), ("/m/t/none.png",)], "p string")
    assert {r.p: r.found for r in media.find_images(asked, "p", files).collect()} == {"/m/t/a.png": "/m/t/a.webp", "/m/t/none.png": None}


def test_read_pixels(spark, tmp_path):
    # A 2 x 1 binary pixmap would need a decoder; BMP is read by the JVM.
    import struct

    rows = bytes([10, 20, 30, 40, 50, 60, 0, 0])  # blue green red, two pixels, padded
    head = b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54)
    info = struct.pack("<IiiHHIIiiII", 40, 2, 1, 1, 24, 0, len(rows), 0, 0, 0, 0)
    (tmp_path / "a.bmp").write_bytes(head + info + rows)
    px = media.read_pixels(spark, str(tmp_path / "a.bmp")).orderBy("x").collect()
    assert [(p.x, p.y, p.r, p.g, p.b) for p in px] == [(0, 0, 30.0, 20.0, 10.0), (1, 0, 60.0, 50.0, 40.0)]


def test_regions(spark):
    px = spark.createDataFrame(
        [(1, x, y, float(x * 10), float(y * 20), 0.0, float(x + y)) for x in range(4) for y in range(4)],
        "image_id int, x int, y int, r double, g double, b double, depth double",
    )
    box = G.box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    rg = spark.createDataFrame([(1, 0, 0, 0, 1, 1), (1, 1, 1, 1, 4, 3), (1, 2, 2, 2, 2, 4)], "image_id int, region_id int, x1 int, y1 int, x2 int, y2 int")
    rg = rg.select("image_id", "region_id", box.alias("box"))
    for cell in (1, 3, 64):
        out = {r.region_id: r for r in regions.region_properties(px, rg, cell=cell).collect()}
        assert out[0].n_pixels == 1 and out[0].saturation == 0.0 and out[1].n_pixels == 6 and 2 not in out
        lum = np.array([0.299 * x * 10 + 0.587 * y * 20 for x in range(1, 4) for y in range(1, 3)])
        assert out[1].brightness == pytest.approx(round(lum.mean() / 255, 4)) and out[1].contrast == pytest.approx(round(lum.std() / 255, 4))
        d = {r.region_id: (r.mean_depth, r.min_depth, r.max_depth) for r in regions.region_depth(px, rg, cell).collect()}
        assert d[0] == (6.0, 6.0, 6.0) and d[1] == (2.5, 1.0, 4.0)
    det = spark.createDataFrame([(1, "car", 0, 0.5), (1, "car", 1, 0.9), (1, "car", 2, 0.9), (1, "dog", 3, 0.49)], "image_id int, object string, det_pos int, score double")
    assert [r.label for r in regions.label_detections(det).orderBy("det_pos").collect()] == ["car", "car-2", "car-3", "dog"]
    assert filters.filter_detections(det).count() == 3 and {r.object: r.det_pos for r in regions.best_region(det).collect()}["car"] == 1


def test_boxes(spark):
    b = spark.createDataFrame([(10.0, 10.0, 30.0, 20.0)], "x1 double, y1 double, x2 double, y2 double").select(F.struct("x1", "y1", "x2", "y2").alias("b"))
    r = b.select(
        G.expand_box("b", F.lit(35), F.lit(100), 0.5).alias("e"), G.expand_box("b", F.lit(100), F.lit(100), 10.0).alias("p"),
        G.normalize_box("b", F.lit(30), F.lit(40)).alias("n"), G.box_error("b").alias("err"),
    ).first()
    assert tuple(r.e) == (5, 7, 35, 22) and tuple(r.p) == (5, 5, 35, 25) and tuple(r.n) == (0.3333, 0.25, 1.0, 0.5)
    assert r.err == "bbox_2d values must be between 0 and 1"


def _run(spark, rows):
    return spark.createDataFrame(rows, "idx long, src_pos long, is_correct boolean, sub_task string, ground_truth string, predicted string")


def test_compare(spark):
    a = _run(spark, [(1, 0, False, "s", "g", "p"), (1, 1, True, "s", "g", "p"), (2, 2, False, "", "g", "p"), (3, 3, True, "s", "g", "p"), (4, 4, False, "s", "g", "p")])
    b = _run(spark, [(1, 0, True, "s", "g", "q"), (2, 1, False, "s", "g", "q"), (3, 2, False, "s", "g", "q"), (4, 3, True, "s", "g", "q")])
    cats = {r.idx: r.category for r in compare.categorise(a, b).collect()}
    assert cats == {1: "both_correct", 2: "both_wrong", 3: "only_b_wrong", 4: "only_a_wrong"}
    assert sorted(r.idx for r in compare.disagreements(a, b).collect()) == [3, 4]
    compare.assert_same_samples(a, b)
    with pytest.raises(ValueError):
        compare.assert_same_samples(a, b.where("idx < 4"))


def test_error_report(spark):
    e = spark.createDataFrame(
        [(1, 0, "s", ["no_answer", "other"]), (2, 1, None, ["no_answer"]), (3, 2, "s", ["other", "reasoning_error"]), (4, 3, "s", [])],
        "idx long, src_pos long, sub_task string, error_categories array<string>",
    ).withColumns({"question": F.lit("Q"), "image_paths": F.array(F.lit("i")), "ground_truth": F.lit("g"), "predicted": F.lit("p"), "analysis": F.lit("why")})
    dist = {r.category: (r.errors, r.pct) for r in compare.error_distribution(e).collect()}
    assert dist["no_answer"] == (2, 50.0) and dist["visual_perception"] == (0, 0.0) and len(dist) == 6
    over = {r.sub_task: (r.errors, r.top_categories) for r in compare.subtask_overview(e).collect()}
    assert over == {"s": (3, "other (2), no_answer (1), reasoning_error (1)"), "Unknown": (1, "no_answer (1)")}
    text = "\n".join(r.text for r in reports.error_report(e, 10).collect())
    assert "| Incorrect | 4 (40.0%) |" in text and "#### #2 [idx=3]" in text and text.index("Sub-task: Unknown") < text.index("Sub-task: s")
    flat = "\n".join(r.text for r in reports.error_report(e.withColumn("sub_task", F.lit("")), 10).collect())
    assert "## Case Details\n" in flat and "### #4 [idx=4]" in flat and "Sub-task" not in flat


def test_balanced_sample(spark):
    rows = [(i, "big" if i < 60 else "small" if i < 63 else None) for i in range(100)]
    df = spark.createDataFrame(rows, "idx long, sub_task string")
    for target in (10**6, 8):
        got = sampling.sample_balanced(df, 20, target_rows=target)
        counts = {r.sub_task: r.n for r in sampling.group_counts(got).collect()}
        assert counts == {"big": 7, "small": 3, "unknown": 6}
    a = sorted(r.idx for r in sampling.sample_random(df, 15).collect())
    assert len(a) == 15 and a == sorted(r.idx for r in sampling.sample_random(df.repartition(7), 15).collect())
    assert sampling.sample_random(df, 500).count() == 100


def test_tools(spark):
    calls = spark.createDataFrame(
        [
            ("crop", '{"image": "img_0", "bbox_2d": [0.1, 0.1, 0.5, 0.5]}'), ("crop", '{"image": "img_0", "bbox_2d": [0.6, 0.1, 0.5, 0.5]}'),
            ("zoom_in", '```\n{"image": "img_0", "bbox_2d": [0, 0, 1, 1], "zoom_factor": 0.5}\n```'), ("nope", "{}"), ("get_images", "not json"),
        ],
        "tool string, params string",
    )
    got = [r.result for r in tools.call_tools(calls).collect()]
    assert got[0].startswith("Cropped img_0 at bbox_2d") and got[1] == "Error: invalid bbox_2d: left >= right or top >= bottom"
    assert "'zoom_factor' is below 1.0" in got[2] and got[3] == "Tool nope does not exist!" and "not a JSON object" in got[4]
    assert tools.describe_tool("crop", zh=True) == "裁剪图像区域"


def test_annotate(spark):
    class Flaky:
        def __init__(self):
            self.n = 0

        def annotate(self, prompt, images):
            self.n += 1
            if prompt == "no":
                raise models.Refused()
            if self.n % 2:
                raise TimeoutError()
            return '{"experience": "x"}'

    df = spark.createDataFrame([("a",), ("no",), ("b",)], "prompt string").coalesce(1)
    out = models.annotate(df, Flaky, models.is_json_object, concurrency=1)
    assert sorted(r.prompt for r in out.collect()) == ["a", "b"]
    assert models.annotate(df, Flaky, lambda r: False).count() == 0


def test_mean_pool(spark):
    v = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 4.0])], "k int, embedding array<float>")
    t = spark.createDataFrame([(1, [9.0, 9.0]), (2, [5.0, 6.0])], "k int, embedding array<float>")
    got = {r.k: r.embedding for r in banks.with_fallback_text(t.select("k"), v, t, "k").collect()}
    assert got == {1: [2.0, 3.0], 2: [5.0, 6.0]}


def test_nested_ids(spark):
    df = spark.createDataFrame(
        [('{"image":"img_0","regions":[{"of":"img_1"},"img_9"],"note":"see img_0"}', [("img_0", "/m/a.png"), ("img_1", "/m/b.png")])],
        "props string, media array<struct<ref_id:string,path:string>>",
    )
    out = media.media_maps(df).select(
        media.replace_in_json(F.col("props"), F.col("id_to_path")).alias("there"), "path_to_id", "props"
    )
    row = out.withColumn("back", media.replace_in_json(F.col("there"), F.col("path_to_id"))).first()
    assert json.loads(row.there) == {"image": "/m/a.png", "regions": [{"of": "/m/b.png"}, "img_9"], "note": "see img_0"}
    assert row.back == row.props
    chain = spark.createDataFrame([('{"img_0": ["img_0", "a\\"b"], "n": 1}',)], "t string").select(
        media.replace_in_json("t", F.create_map(F.lit("img_0"), F.lit("img_1"), F.lit("img_1"), F.lit("x"), F.lit('a"b'), F.lit("q")))
    )
    assert chain.first()[0] == '{"img_0": ["img_1", "q"], "n": 1}'


def test_profile_of_map_columns(spark):
    df = spark.createDataFrame([({"a": 1},)], "m map<string,int>")
    assert tables.profile_tables({"m": df, "none": df.limit(0)}).collect()[0]["sample"] == "m: {a -> 1}"


def test_source_configs(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "a"))
    with pytest.warns(UserWarning, match="config b"):
        assert tables.read_source(spark, str(tmp_path), "parquet", ["a", "b"]).count() == 2
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "x.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        tables.read_source(spark, str(tmp_path), "parquet", ["a", "c"]).count()


def test_listed_questions(spark):
    df = spark.createDataFrame(
        [(0, [" ", "Which?\nA. x\nB. y", "more"], ["B"], "Multi Choice", ["i.png"]), (1, [], ["A"], "Multi Choice", ["i.png"])],
        "src_pos long, question array<string>, answer array<string>, question_type string, images array<string>",
    )
    rows = S.to_samples(df, "chartqa").collect()
    assert [(r.idx, r.choices, r.answer) for r in rows] == [(0, ["x", "y"], "y")]


def test_item_rules(spark):
    from trailmark.functions.tools import Param, params_error

    rules = {"box": Param("array", items="number", min_items=4, max_items=4), "of": Param("array", item_enum=("a", "b"))}
    texts = ['{"box": [1, 2.5, 3, 4]}', '{"box": [1, 2, 3]}', '{"box": [1, 2, 3, 4, 5]}', '{"box": [1, "2", 3, 4]}', '{"of": ["a", "c"]}', '{"of": []}']
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(params_error("t", rules).alias("e"))
    assert [r.e for r in df.collect()] == [
        None, "'box' has less than 4 items", "'box' has more than 4 items", "'box' has an item that is not of type 'number'",
        "'of' has an item that is not one of ['a', 'b']", None,
    ]


def test_numbered_by_ranges(spark):
    from trailmark.operators.skew import number_ranges

    ids = [f"MMMU_val_{i:06d}" for i in range(200)]
    df = spark.createDataFrame([(t,) for t in ids], "task_id string").repartition(7)
    out = number_ranges(df, ["task_id"], "n", lambda x: x.checkpoint())
    assert [(r.task_id, r.n) for r in out.orderBy("n").collect()] == [(t, i) for i, t in enumerate(ids)]

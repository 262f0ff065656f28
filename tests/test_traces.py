"""Trace files, steps, trajectories, states, views, messages and turn budgets."""

import json

import pytest
from pyspark.sql import functions as F

from trailmark.functions import steps as S
from trailmark.functions import text as X
from trailmark.functions import views as V
from trailmark.operators import messages as M
from trailmark.operators import trajectories as T
from trailmark.schemas import TRACE_FILE
from trailmark.sources import tables

LOG = {"experience_for_step_2": [{"round": 1, "view": "question", "experiences": [{"experience": "e", "score": 0.5}]}]}
TRACES = {
    "000001": {
        "dataset_id": "7", "sub_task": "color", "is_correct": True, "extra": 1,
        "input": {"question": "Colour?", "images": [{"id": "img_0", "path": "a.png"}, "b.png", {"id": "img_2"}]},
        "trace": [
            {"step": 1, "type": "think", "content": "look"},
            LOG,
            {"step": 2, "type": "action", "tool": "localize_objects", "properties": {"image": "img_0", "n": [1, 2]}, "observation": "Found 3 cars."},
            {"step": 3, "type": "answer", "content": "Red"},
        ],
    },
    "000002": {
        "dataset_id": 8, "sub_task": "depth", "input": {"question": "Near?"},
        "trace": [
            {"step": 1, "type": "think", "content": "first"}, {"step": 2, "type": "think", "content": "second"},
            {"step": 3, "type": "action", "tool": "crop", "properties": {}, "observation": {"id": "img_1", "description": "a crop"}},
            {"step": 4, "type": "action", "tool": "ocr", "properties": {"x": "y"}, "observation": None},
            {"step": "bad", "type": "odd"},
            {"step": 5, "type": "answer", "content": "The dog"},
        ],
    },
    "000003": {"input": {"question": ""}, "trace": []},
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("memory")
    for task, doc in TRACES.items():
        (root / "tasks" / task).mkdir(parents=True)
        (root / "tasks" / task / "trace.json").write_text(json.dumps({"task_id": "wrong", **doc}, indent=2))
    (root / "tasks" / "000009").mkdir()
    (root / "tasks" / "000009" / "trace.json").write_text('{"task_id": "x", "trace": [')
    return str(root)


@pytest.fixture(scope="module")
def traces(spark, folder):
    return tables.read_traces(spark, folder).cache()


def test_read_traces(traces):
    rows = {r.task_id: r for r in traces.collect()}
    assert sorted(rows) == ["000001", "000002", "000003"]
    assert rows["000001"].images == ["a.png", "b.png"] and rows["000001"].image_ids == ["img_0", "img_2"]
    assert rows["000002"].dataset_id == "8" and rows["000002"].is_correct is None
    steps = rows["000001"].steps
    assert [s.type for s in steps] == ["think", "", "action", "answer"]
    assert steps[1].log_step == 2 and json.loads(steps[1].log_rounds)[0]["view"] == "question"
    assert json.loads(steps[2].properties) == {"image": "img_0", "n": [1, 2]}
    assert rows["000002"].steps[2].observation == "a crop" and rows["000002"].steps[3].observation == ""


def test_trace_files_are_listed_by_tasks(spark, folder):
    """The driver holds no list of the files."""
    assert tables.read_traces(spark, folder).inputFiles() == [] and tables.unreadable_traces(spark, folder).inputFiles() == []


def test_odd_trace_files(spark, tmp_path):
    """Files are judged and read as Spark's reader does."""
    texts = {
        "layout": b'{"task_id": "x",\r\n "input": {"question" : 1.50, "images": [1e400, "a b"]}, "answer": 1e5, "is_correct": true}',
        "list": b'[{"answer": "1"},\n {"answer": {"a" : "\\u00e9\\/"}}]', "no list": b'[{"answer": "1"}, 2]', "none": b"[]", "empty": b"", "blank": b" \n",
        "null": b"null", "number": b"12", "rest": b'{"answer": "1"} rest', "open": b'{"answer": [', "comma": b'{"answer": "1",}', "type": b'{"success": "abc"}',
        "control": b'{"answer": "a\x01"}', "quotes": b"{'answer': 'x'}", "twice": b'{"answer": "1", "answer": "2"}', "nan": b'{"answer": NaN}',
        "bytes": b'{"answer": "\xff"}', "mark": b'\xef\xbb\xbf{"answer": "x"}', "wide": '{"answer": "\u00e9"}'.encode("utf-16"), "a+b c%20[x]": b'{"answer": "x"}', "q#?": b"{",
    }
    for task, data in texts.items():
        (tmp_path / "tasks" / task).mkdir(parents=True)
        (tmp_path / "tasks" / task / "trace.json").write_bytes(data)
    (tmp_path / "tasks" / "no file").mkdir()
    raw = spark.read.schema(TRACE_FILE).option("multiLine", True).json(f"{tmp_path}/tasks/*/trace.json")
    good = tables.keyed_by_folder(raw)
    got = tables.read_traces(spark, str(tmp_path)).select(good.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, good.collect()))
    bad = raw.select("*", F.col("_metadata.file_path").alias("file")).collect()  # all columns, so that types count
    found = sorted(r.file for r in tables.unreadable_traces(spark, str(tmp_path)).collect())
    assert found == sorted(r.file for r in bad if r["_corrupt_record"] is not None) and len(found) > 5


def test_trajectory(traces):
    rows = {r.task_id: r.entries for r in T.with_trajectory(traces).collect()}
    assert [(e.state_index, e.thinking, e.tool, e.observation) for e in rows["000001"]] == [
        (0, "look", "localize_objects", "Found 3 cars."), (1, "", "answer", None),
    ]
    assert [(e.thinking, e.tool) for e in rows["000002"]] == [("second", "crop"), ("", "ocr"), ("", "answer")]
    assert rows["000003"] == []


def test_step_table_agrees_with_documents(traces):
    doc = T.with_trajectory(traces).select("task_id", F.explode("entries").alias("e")).select("task_id", "e.state_index", "e.thinking", "e.tool")
    for target in (1000, 2):
        long = T.step_trajectory(T.step_rows(traces).select("task_id", "pos", "type", "tool", "content", "properties", "observation"), target_rows=target)
        assert sorted(map(tuple, long.select("task_id", "state_index", "thinking", "tool").collect())) == sorted(map(tuple, doc.collect()))


def test_states_and_views(traces):
    states = T.to_states(T.with_trajectory(traces))
    rows = {(r.task_id, r.state_index): r.elements for r in states.collect()}
    assert rows[("000002", 2)].observations == ['crop({}) -> a crop', 'ocr({"x":"y"}) -> ']
    assert rows[("000001", 0)].observations == [] and rows[("000001", 0)].images == ["a.png", "b.png"]
    views = {(r.task_id, r.state_index): r.v for r in states.select("task_id", "state_index", V.available_views("elements").alias("v")).collect()}
    assert views[("000002", 0)] == ["question", "task", "question+task"]
    assert len(views[("000001", 1)]) == 15
    texts = {(r.task_id, r.state_index, r.view): (r.text, r.view_images) for r in T.explode_views(states).collect()}
    assert texts[("000001", 1, "task+images+observations")] == (
        'Task: color\nImages are provided.\nObservation: localize_objects({"image":"img_0","n":[1,2]}) -> Found 3 cars.', ["a.png", "b.png"],
    )
    assert texts[("000002", 2, "question")] == ("Question: Near?", [])


def test_texts(traces):
    rows = {r.task_id: r for r in T.with_trajectory(traces).select(
        "task_id", X.format_trace("steps").alias("f"), S.trajectory_text("entries").alias("t"), X.used_tools("steps").alias("u"),
        T.next_step(F.col("steps")).alias("n"),
    ).collect()}
    assert rows["000001"].f == "1. look\n2. [localize_objects]\n3. Red" and rows["000003"].f == "N/A"
    assert rows["000002"].u and not rows["000003"].u
    assert [rows[t].n for t in sorted(rows)] == [4, 6, 1]
    assert rows["000001"].t == (
        "State s_0:\n  - The question and input images shown above.\n\nAction a_0:\n  Think: look\n"
        '  Tool: localize_objects({"image":"img_0","n":[1,2]})\n  Observation: Found 3 cars.\n\nState s_1\n\n'
        "Action a_1:\n  Tool: answer\n  Answer content: Red"
    )


def test_retrieval_logs(traces):
    logs = T.attach_retrieval_logs(traces)
    row = logs.first()
    assert (row.task_id, row.step, row.follows, row.consistent) == ("000001", 2, 2, True)
    used = T.rounds_of_states(logs, T.step_rows(traces)).first()
    assert (used.view, used.tool, used.n_experiences) == ("question", "localize_objects", 1)


def test_number_steps(spark):
    e = spark.createDataFrame([("t", 0, True), ("t", 1, False), ("t", 2, True), ("t", 3, True)], "task_id string, pos int, numbered boolean")
    got = [r.next_step for r in T.number_steps(e, numbered=F.col("numbered")).orderBy("pos").collect()]
    assert got == [1, 2, 2, 3]


def test_ref_ids(spark):
    m = spark.createDataFrame([("t", "img", True, 0), ("t", "img", False, 1), ("t", "vid", False, 2), ("t", "img", False, 0)], "task_id string, modality string, is_output boolean, pos int")
    got = {(r.is_output, r.modality, r.pos): r.ref_id for r in T.assign_ref_ids(m).collect()}
    assert got == {(False, "img", 0): "img_0", (False, "img", 1): "img_1", (True, "img", 0): "img_2", (False, "vid", 2): "vid_0"}


def test_prune_messages(spark):
    p = "content array<struct<type:string,text:string,ref:string>>"
    text, img, vid = ("text", "hi", None), ("image", None, "a"), ("video", None, "v")
    rows = [("c", 0, "user", [text, img]), ("c", 1, "assistant", [text, img]), ("c", 2, "user", [img]), ("c", 3, "user", [text, img, vid]), ("c", 4, "user", [text, vid])]
    out = {r.turn: [x.type for x in r.content] for r in M.prune_message_images(spark.createDataFrame(rows, f"conv_id string, turn long, role string, {p}")).collect()}
    assert out == {0: ["text"], 1: ["text", "image"], 3: ["text", "image", "video"], 4: ["text"]}


def test_turn_budget(spark):
    rows = [("many", i, 1, False) for i in range(15)] + [("idle", i, 0, False) for i in range(30)]
    rows += [("done", 0, 2, False), ("done", 1, 0, True), ("done", 2, 1, False), ("multi", 0, 9, False), ("multi", 1, 3, False), ("multi", 2, 1, False)]
    t = T.apply_turn_budget(spark.createDataFrame(rows, "task_id string, turn int, n_actions int, answered boolean"))
    got = {r.task_id: (r.turns, r.actions, r.outcome) for r in T.turn_outcomes(t).collect()}
    assert got == {"many": (10, 10, "max_iterations"), "idle": (20, 0, "safety_stop"), "done": (2, 2, "answered"), "multi": (2, 12, "max_iterations")}


def test_small_texts(spark):
    one = spark.createDataFrame([(["img_0", "img_1", "img_2"], "prefix: /a:b ", "x" * 151)], "ids array<string>, spec string, long string")
    r = one.select(
        X.view_message("ids").alias("v"), X.bank_spec("spec").alias("b"), X.truncate_text("long").alias("t"),
        X.describe_input(F.lit(0), F.lit("img")).alias("d0"), X.describe_input(F.lit(10), F.lit("vid")).alias("d10"),
        X.task_id_text(F.lit(1234567)).alias("id"),
        X.format_observation(F.create_map(F.lit("éa"), F.lit("1"), F.lit("b c"), F.lit("2"))).alias("o"),
        X.format_regions(F.array(F.struct(F.lit("car").alias("label"), F.array(F.lit(0.1), F.lit(0.5)).alias("bbox")))).alias("g"),
    ).first()
    assert r.v == "You can now view 3 images in order: img_0, img_1 and img_2."
    assert (r.b.prefix, r.b.path) == ("prefix", "/a:b") and r.t == "x" * 150 + "..."
    assert r.d0 == "The first input image" and r.d10 == "Input video 11" and r.id == "1234567"
    assert r.o == "Éa: 1, B c: 2" and r.g == "car at [0.1, 0.5]"

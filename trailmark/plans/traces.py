"""Traces, trajectories, states, views and messages."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trailmark.functions import steps as S
from trailmark.functions import text as X
from trailmark.functions import views as V
from trailmark.operators import messages as M
from trailmark.operators import trajectories as T
from trailmark.plans import bindings as B
from trailmark.plans.registry import query
from trailmark.session import checkpoint_dir
from trailmark.sources import tables as files
from trailmark.streaming import live

_NL = "chr(10)"


@query("trajectory_of_documents", B.sql("entries", body="""
SELECT task_id, state_index, thinking, CASE WHEN type = 'answer' THEN 'answer' ELSE tool END AS tool,
  CASE WHEN type = 'action' THEN observation END AS observation, CASE WHEN type = 'answer' THEN x END AS content
FROM entries"""))
def trajectory_of_documents(spark, d):
    t = T.with_trajectory(B.traces(spark, d)).select("task_id", F.explode_outer("entries").alias("e"))
    return t.where("e is not null").select("task_id", "e.state_index", "e.thinking", "e.tool", "e.observation", "e.content")


@query("trajectory_of_events", B.sql("event_entries", body="""
SELECT task_id, event_id, state_index, thinking, CASE WHEN type = 'answer' THEN 'answer' ELSE event_type END AS tool,
  CASE WHEN type = 'answer' THEN '{"content":"' || value || '"}' ELSE props END AS parameters,
  CASE WHEN type = 'action' THEN value END AS observation FROM event_entries"""))
def trajectory_of_events(spark, d):
    return T.step_trajectory(B.step_events(spark, d), axes=B.micros()).drop("ts")


_HISTORY = B.sql("event_entries", body="""
SELECT task_id, event_id, state_index, coalesce(sum((type = 'action')::BIGINT) OVER w, 0)::BIGINT AS n_observations,
  coalesce(sum(CASE WHEN type = 'action' THEN length(event_type || '(' || props || ') -> ' || value) ELSE 0 END) OVER w, 0)::BIGINT AS observation_chars
FROM event_entries WINDOW w AS (PARTITION BY task_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")


@query("state_history", _HISTORY)
def state_history(spark, d):
    t = T.step_trajectory(B.step_events(spark, d), axes=B.micros())
    return T.state_history(t).select("task_id", "event_id", "state_index", "n_observations", "observation_chars")


@query("state_history_in_ranges", _HISTORY)
def state_history_in_ranges(spark, d):
    """The same with every user cut into ranges of at most 40 events."""
    t = T.step_trajectory(B.step_events(spark, d), axes=B.micros(), target_rows=40)
    out = T.state_history(t, axes=B.micros(), target_rows=40)
    return out.select("task_id", "event_id", "state_index", "n_observations", "observation_chars")


_PRIOR = """list_transform(list_filter(entries_of, lambda e: e.si < s.state_index AND e.type = 'action'),
  lambda e: e.tool || '(' || e.properties || ') -> ' || e.observation)"""
B.cte("states", f"""
SELECT s.task_id, s.state_index, t.question, t.sub_task, t.images, {_PRIOR} AS observations
FROM entries s
JOIN (SELECT task_id, list({{'si': state_index, 'type': type, 'tool': tool, 'properties': properties, 'observation': observation}} ORDER BY state_index) AS entries_of
      FROM entries GROUP BY task_id) e ON s.task_id = e.task_id
JOIN traces t ON s.task_id = t.task_id""", ("entries",))


@query("state_elements", B.sql("states", body=f"""
SELECT task_id, state_index, question, sub_task AS task, len(images) AS n_images, len(observations) AS n_observations,
  md5(array_to_string(observations, {_NL})) AS digest FROM states"""))
def state_elements(spark, d):
    states = T.to_states(T.with_trajectory(B.traces(spark, d)))
    return states.select(
        "task_id", "state_index", "elements.question", "elements.task",
        F.size("elements.images").alias("n_images"), F.size("elements.observations").alias("n_observations"),
        F.md5(F.array_join("elements.observations", "\n")).alias("digest"),
    )


_HAVE = "(1 + 2 + CASE WHEN len(images) > 0 THEN 4 ELSE 0 END + CASE WHEN len(observations) > 0 THEN 8 ELSE 0 END)"
_VIEWS_SQL = "[" + ",".join(f"{{'v': '{v}', 'm': {m}}}" for v, m in V.VIEW_MASKS) + "]"


@query("available_views", B.sql("states", body=f"""
SELECT task_id, state_index, array_to_string(list_transform(list_filter({_VIEWS_SQL}, lambda v: v.m & {_HAVE} = v.m), lambda v: v.v), ' ') AS views
FROM states"""))
def available_views(spark, d):
    states = T.to_states(T.with_trajectory(B.traces(spark, d)))
    return states.select("task_id", "state_index", F.array_join(V.available_views("elements"), " ").alias("views"))


@query("explode_views", B.sql("states", body=f"""
SELECT task_id, state_index, v.v AS view, CASE WHEN v.m & 4 > 0 THEN len(images) ELSE 0 END AS n_images,
  md5(concat_ws({_NL}, CASE WHEN v.m & 1 > 0 THEN 'Question: ' || question END, CASE WHEN v.m & 2 > 0 THEN 'Task: ' || sub_task END,
    CASE WHEN v.m & 4 > 0 THEN 'Images are provided.' END,
    CASE WHEN v.m & 8 > 0 THEN array_to_string(list_transform(observations, lambda o: 'Observation: ' || o), {_NL}) END)) AS digest
FROM (SELECT *, unnest(list_filter({_VIEWS_SQL}, lambda v: v.m & {_HAVE} = v.m)) AS v FROM states)"""))
def explode_views(spark, d):
    rows = T.explode_views(T.to_states(T.with_trajectory(B.traces(spark, d))))
    return rows.select(
        "task_id", "state_index", "view", F.size("view_images").alias("n_images"), F.md5("text").alias("digest")
    )


@query("view_counts", B.sql("states", body=f"""
SELECT v.v AS view, count(*) AS n_states, sum(len(observations) * (v.m & 8) // 8)::BIGINT AS n_observations
FROM (SELECT *, unnest(list_filter({_VIEWS_SQL}, lambda v: v.m & {_HAVE} = v.m)) AS v FROM states) GROUP BY 1"""))
def view_counts(spark, d):
    states = T.to_states(T.with_trajectory(B.traces(spark, d)))
    rows = states.select(
        V.available_views("elements").alias("views"), F.size("elements.observations").alias("n")
    ).select(F.explode_outer("views").alias("view"), "n")
    used = F.when(F.array_contains(F.split("view", r"\+"), "observations"), F.col("n")).otherwise(0)
    return rows.groupBy("view").agg(F.count(F.lit(1)).alias("n_states"), F.sum(used).alias("n_observations"))


@query("format_trace", B.sql("steps", "traces", body=f"""
SELECT t.task_id, coalesce(f.trace_text, 'N/A') AS trace_text FROM traces t LEFT JOIN (
  SELECT task_id, string_agg(rn || '. ' || txt, {_NL} ORDER BY pos) AS trace_text FROM (
    SELECT task_id, pos, txt, row_number() OVER (PARTITION BY task_id ORDER BY pos) AS rn FROM (
      SELECT task_id, pos, CASE WHEN type IN ('think', 'answer') AND x <> '' THEN x WHEN type = 'action' THEN '[' || tool || ']' END AS txt
      FROM steps) WHERE txt IS NOT NULL) GROUP BY task_id) f ON t.task_id = f.task_id"""))
def format_trace(spark, d):
    return B.traces(spark, d).select("task_id", X.format_trace("steps").alias("trace_text"))


@query("trajectory_text", B.sql("entries", body=f"""
SELECT task_id, md5('State s_0:' || {_NL} || '  - The question and input images shown above.' || {_NL} || {_NL} ||
  string_agg(concat_ws({_NL}, 'Action a_' || state_index || ':', CASE WHEN thinking <> '' THEN '  Think: ' || thinking END,
      CASE WHEN type = 'answer' THEN '  Tool: answer' ELSE '  Tool: ' || tool || '(' || properties || ')' END,
      CASE WHEN type = 'answer' THEN '  Answer content: ' || x WHEN observation <> '' THEN '  Observation: ' || observation END)
    || CASE WHEN state_index + 1 < n_states THEN {_NL} || {_NL} || 'State s_' || (state_index + 1) ELSE '' END,
    {_NL} || {_NL} ORDER BY state_index)) AS digest FROM entries GROUP BY task_id"""))
def trajectory_text(spark, d):
    acted = F.exists("steps", lambda s: s["type"].isin("action", "answer"))
    t = T.with_trajectory(B.traces(spark, d).where(acted))
    return t.select("task_id", F.md5(S.trajectory_text("entries")).alias("digest"))


@query("used_tools", B.sql("used", "traces", body="""
SELECT t.task_id, coalesce(u.used_tools, false) AS used_tools FROM traces t LEFT JOIN used u ON t.doc_id = u.doc_id"""))
def used_tools(spark, d):
    return B.traces(spark, d).select("task_id", X.used_tools("steps").alias("used_tools"))


_NUMBERED = B.sql("step_events", body="""
SELECT task_id, event_id, 1 + coalesce(sum((type <> '')::BIGINT) OVER (PARTITION BY task_id ORDER BY ts, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS next_step FROM step_events""")


@query("number_steps", _NUMBERED)
def number_steps(spark, d):
    e = B.step_events(spark, d)
    return T.number_steps(e, axes=B.micros(), numbered=F.col("type") != "").select("task_id", "event_id", "next_step")


@query("next_step", B.sql("steps", body="""
SELECT task_id, coalesce(max(CASE WHEN code <> 5 THEN pos + 1 END), 0) + 1 AS next_step FROM steps GROUP BY task_id"""))
def next_step(spark, d):
    return B.traces(spark, d).select("task_id", T.next_step("steps").alias("next_step"))


@query("attach_retrieval_logs", B.sql("steps", body="""
SELECT task_id, pos, pos + 2 AS step, coalesce(nxt + 1, -1) AS follows, coalesce(pos + 1 = nxt, false) AS consistent FROM (
  SELECT *, min(CASE WHEN code <> 5 THEN pos END) OVER (PARTITION BY task_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt
  FROM steps) WHERE code = 5"""))
def attach_retrieval_logs(spark, d):
    return T.attach_retrieval_logs(B.traces(spark, d)).select("task_id", "pos", "step", F.coalesce("follows", F.lit(-1)).alias("follows"), "consistent")


@query("rounds_of_states", B.sql("steps", body="""
SELECT l.task_id, l.pos + 2 AS step, 1::BIGINT AS round, 'question' AS view, 1::BIGINT AS n_experiences, s.type, s.tool
FROM steps l JOIN steps s ON l.task_id = s.task_id AND s.pos = l.pos + 1 WHERE l.code = 5 AND s.code <> 5"""))
def rounds_of_states(spark, d):
    t = B.traces(spark, d)
    return T.rounds_of_states(T.attach_retrieval_logs(t), T.step_rows(t))


@query("assign_ref_ids", B.sql("step_events", body="""
SELECT task_id, event_id, modality || '_' || (row_number() OVER (PARTITION BY task_id, modality ORDER BY is_output, ts, event_id) - 1) AS ref_id
FROM (SELECT task_id, event_id, ts, CASE WHEN event_type IN ('click', 'view') THEN 'img' ELSE 'vid' END AS modality,
  event_type IN ('purchase', 'click') AS is_output FROM step_events)"""))
def assign_ref_ids(spark, d):
    e = B.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    media = e.select(
        F.col("user_id").alias("task_id"), "event_id", "ts",
        F.when(F.col("event_type").isin("click", "view"), "img").otherwise("vid").alias("modality"),
        F.col("event_type").isin("purchase", "click").alias("is_output"),
    )
    axes = {"output": F.col("is_output").cast("int"), **B.micros()}
    return T.assign_ref_ids(media, axes=axes).select("task_id", "event_id", "ref_id")


@query("describe_inputs", """
SELECT conv_id, turn, CASE WHEN turn + n < 10 THEN 'The ' || ['first','second','third','fourth','fifth','sixth','seventh','eighth','ninth','tenth'][(turn + n + 1)::INT] || ' input ' || noun
  ELSE 'Input ' || noun || ' ' || (turn + n + 1) END AS description
FROM (SELECT conv_id, turn, length(text) % 9 AS n, CASE WHEN role = 'user' THEN 'video' ELSE 'image' END AS noun FROM conversations)""")
def describe_inputs(spark, d):
    c = B.table(spark, d, "conversations").select(
        "conv_id", "turn", (F.col("turn") + F.length("text") % 9).alias("pos"),
        F.when(F.col("role") == "user", "vid").otherwise("img").alias("modality"),
    )
    return T.describe_inputs(c).select("conv_id", "turn", "description")


@query("index_text", B.sql("traces", body=f"SELECT task_id, 'Question: ' || question || {_NL} || 'Task: ' || sub_task AS index_text FROM traces"))
def index_text(spark, d):
    return B.traces(spark, d).select("task_id", X.index_text("question", "sub_task").alias("index_text"))


@query("source_tag", B.sql("traces", body="""
SELECT task_id, CASE WHEN coalesce(is_correct, false) THEN '[Learned from success]' ELSE '[Learned from failure]' END AS tag FROM traces"""))
def source_tag(spark, d):
    source = F.when(F.coalesce("is_correct", F.lit(False)), "correct").otherwise("incorrect")
    return B.traces(spark, d).select("task_id", X.source_tag(source).alias("tag"))


@query("non_empty_trajectories", B.sql("entries", body="SELECT task_id, count(*) AS n_states FROM entries GROUP BY task_id"))
def non_empty_trajectories(spark, d):
    acted = F.exists("steps", lambda s: s["type"].isin("action", "answer"))
    t = T.with_trajectory(B.traces(spark, d).where(acted))
    return t.select("task_id", F.size("entries").cast("long").alias("n_states"))


@query("prune_message_images", B.sql("messages", body="""
SELECT m.conv_id, m.turn, m.role, (CASE WHEN touched THEN has_text::INT ELSE has_text::INT + has_image::INT + has_video::INT END)::BIGINT AS n_parts,
  (has_image AND NOT touched) AS keeps_image
FROM (SELECT m.*, m.role = 'user' AND m.turn IS DISTINCT FROM l.latest AS touched FROM messages m LEFT JOIN (
    SELECT conv_id, max(turn) AS latest FROM messages WHERE role = 'user' AND has_image GROUP BY conv_id) l ON m.conv_id = l.conv_id) m
WHERE NOT touched OR has_text"""))
def prune_message_images(spark, d):
    p = M.prune_message_images(B.messages(spark, d))
    return p.select(
        "conv_id", "turn", "role", F.size("content").alias("n_parts"),
        F.exists("content", lambda x: x["type"] == "image").alias("keeps_image"),
    )


@query("relabel_first_message", B.sql("messages", body=f"""
SELECT conv_id, turn, CASE WHEN turn = 0 AND role = 'user' THEN 'Images in memory:' ELSE 'Available images:' END
  || ' img_0' || {_NL} || {_NL} || text AS text FROM messages WHERE has_text"""))
def relabel_first_message(spark, d):
    m = M.relabel_first_message(B.messages(spark, d))
    first = F.get(F.filter("content", lambda p: p["type"] == "text"), 0)["text"]
    return m.select("conv_id", "turn", first.alias("text")).where("text is not null")


@query("with_refs", B.sql("traces", body=f"""
SELECT task_id, CASE WHEN len(images) > 0 THEN 'Available images: ' || array_to_string(list_transform(range(len(images)), lambda i: 'img_' || i), ', ')
  || {_NL} || {_NL} ELSE '' END || question AS query FROM traces"""))
def with_refs(spark, d):
    ids = F.transform("images", lambda p, i: F.concat(F.lit("img_"), i.cast("string")))
    return B.traces(spark, d).select("task_id", X.with_refs("question", ids).alias("query"))


_BUDGET = """
SELECT *, row_number() OVER w AS turn_no,
  coalesce(sum(n_actions) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS actions_before,
  coalesce(sum(answered::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS answers
FROM turns WINDOW w AS (PARTITION BY task_id ORDER BY ts, event_id)"""
B.cte("budget", f"SELECT * FROM ({_BUDGET}) WHERE actions_before < 10 AND turn_no <= 20 AND answers = 0", ("turns",))


@query("turn_budget", B.sql("budget", body="SELECT task_id, event_id, turn_no, actions_before FROM budget"))
def turn_budget(spark, d):
    return T.apply_turn_budget(B.turns(spark, d), axes=B.micros()).select("task_id", "event_id", "turn_no", "actions_before")


@query("turn_outcomes", B.sql("budget", body="""
SELECT task_id, turns, actions, answered, CASE WHEN answered THEN 'answered' WHEN turns >= 20 THEN 'safety_stop'
  WHEN actions >= 10 THEN 'max_iterations' ELSE 'open' END AS outcome
FROM (SELECT task_id, count(*) AS turns, sum(n_actions)::BIGINT AS actions, bool_or(answered) AS answered FROM budget GROUP BY task_id)"""))
def turn_outcomes(spark, d):
    return T.turn_outcomes(T.apply_turn_budget(B.turns(spark, d), axes=B.micros()))


# ---- trace files ------------------------------------------------------------


def _trace_files(spark, d) -> str:
    """A file per trace, and a broken one for every tenth document; returns the folder."""
    path = f"{checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"
    t = B.traces(spark, d)
    # images as objects, plain paths and blanks
    items = F.transform("images", lambda p, i: F.when(i == 0, F.to_json(F.struct(F.lit("x").alias("id"), p.alias("path")))).otherwise(F.to_json(F.array(p))))
    images = F.concat(F.lit("["), F.array_join(F.transform(items, lambda x: F.regexp_replace(x, r"^\[(.*)\]$", "$1")), ","), F.when(F.size("images") > 0, ",").otherwise(""), F.lit('""]'))
    steps = F.to_json(F.transform(F.filter("steps", lambda s: s["type"] != ""), lambda s: F.struct(
        s["step"].alias("step"), s["type"].alias("type"), s["tool"].alias("tool"), s["content"].alias("content"),
        s["properties"].alias("properties"), s["observation"].alias("observation"))))
    document = F.concat(
        F.lit('{"task_id": "written elsewhere", "is_correct": '), F.coalesce(F.col("is_correct").cast("string"), F.lit("null")),
        F.lit(', "input": {"question": '), F.to_json(F.array("question")).substr(F.lit(2), F.length(F.to_json(F.array("question"))) - 2),
        F.lit(', "images": '), images, F.lit('}, "trace": '), steps, F.lit("}"),
    )
    good = t.select("task_id", document.alias("document"))
    bad = t.where("doc_id % 10 = 0").select(F.concat(F.lit("broken "), "task_id").alias("task_id"), F.substring(document, 1, 60).alias("document"))
    files.write_traces(good.unionByName(bad), path)
    return path


_FILE_SQL = """
SELECT t.task_id, t.question, array_to_string(t.images, ' ') AS images, coalesce(t.is_correct::VARCHAR, 'missing') AS is_correct,
  coalesce(s.n, 0) AS n_steps, md5(coalesce(s.said, '')) AS digest
FROM traces t LEFT JOIN (
  SELECT task_id, count(*) AS n, string_agg((pos + 1) || ' ' || type || ' ' || coalesce(tool, '') || ' ' || properties || ' ' ||
    CASE WHEN type = 'action' THEN observation ELSE x END, chr(10) ORDER BY pos) AS said FROM steps WHERE type <> '' GROUP BY task_id) s USING (task_id)"""


def _of_files(traces):
    said = F.transform("steps", lambda s: F.concat_ws(
        " ", s["step"], s["type"], F.coalesce(s["tool"], F.lit("")), s["properties"], F.when(s["type"] == "action", s["observation"]).otherwise(s["content"])))
    return traces.select(
        "task_id", "question", F.array_join("images", " ").alias("images"), F.coalesce(F.col("is_correct").cast("string"), F.lit("missing")).alias("is_correct"),
        F.size("steps").alias("n_steps"), F.md5(F.array_join(said, "\n")).alias("digest"),
    )


@query("read_traces", B.sql("traces", "steps", body=_FILE_SQL))
def read_traces(spark, d):
    """Traces written as files and read back, the broken ones left out."""
    return _of_files(files.read_traces(spark, _trace_files(spark, d)))


@query("unreadable_traces", "SELECT 'broken ' || printf('%06d', doc_id) AS task_id FROM documents WHERE doc_id % 10 = 0")
def unreadable_traces(spark, d):
    return files.unreadable_traces(spark, _trace_files(spark, d)).select("task_id")


@query("stream_traces", B.sql("traces", "steps", body=_FILE_SQL))
def stream_traces(spark, d):
    """The same files as a stream, some hundred per batch."""
    path = _trace_files(spark, d)
    out = live.stream_traces(spark, path, 400).select("task_id", "question", "images", "is_correct", "steps")
    writer = out.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    writer.start(f"{path}/out").awaitTermination()
    return _of_files(spark.read.schema(out.schema).parquet(f"{path}/out"))

"""Prompts, annotation and bank building over the trace binding."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from trailmark.functions import models, prompts
from trailmark.functions import steps as S
from trailmark.functions import text as X
from trailmark.operators import banks
from trailmark.operators import compare as C
from trailmark.operators.trajectories import with_trajectory
from trailmark.plans import bindings as B
from trailmark.plans.registry import query
from trailmark.plans.traces import _HAVE, _VIEWS_SQL
from trailmark.session import checkpoint_dir

_NL = "chr(10)"
TOOLS = {"crop": "Cut a region", "ocr": "Read text"}


def _quoted(t: str) -> str:
    return "'" + t.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


B.cte("traj_text", f"""
SELECT task_id, 'State s_0:' || {_NL} || '  - The question and input images shown above.' || {_NL} || {_NL} ||
  string_agg(concat_ws({_NL}, 'Action a_' || state_index || ':', CASE WHEN thinking <> '' THEN '  Think: ' || thinking END,
      CASE WHEN type = 'answer' THEN '  Tool: answer' ELSE '  Tool: ' || tool || '(' || properties || ')' END,
      CASE WHEN type = 'answer' THEN '  Answer content: ' || x WHEN observation <> '' THEN '  Observation: ' || observation END)
    || CASE WHEN state_index + 1 < n_states THEN {_NL} || {_NL} || 'State s_' || (state_index + 1) ELSE '' END,
    {_NL} || {_NL} ORDER BY state_index) AS trajectory FROM entries GROUP BY task_id""", ("entries",))


def _prompt_sql(level: str) -> str:
    rules = prompts.STATE_RULES if level == "state" else prompts.TRACE_RULES
    truth = "CASE WHEN ground_truth IS NOT NULL THEN chr(10) || 'Correct answer: ' || ground_truth ELSE '' END" if level == "state" else "''"
    return f"""SELECT t.task_id, t.is_correct, t.question, t.sub_task, t.images, CASE WHEN coalesce(is_correct, false) THEN 'The agent solved this task correctly.'
    ELSE 'The agent solved this task incorrectly.' || {truth} END || {_quoted(chr(10) * 2 + '## Task' + chr(10))}
  || CASE WHEN len(images) > 0 THEN 'The input images are shown above.' || chr(10) ELSE '' END || 'Question: ' || question
  || chr(10) || 'Type: ' || sub_task || chr(10) || {_quoted(prompts.tools_section(TOOLS))} || {_quoted(chr(10) + '## Trajectory' + chr(10))}
  || trajectory || {_quoted(chr(10) * 2 + '## Reply' + chr(10) + rules)} AS prompt
FROM traces t JOIN traj_text x ON t.task_id = x.task_id"""


B.cte("state_prompts", _prompt_sql("state"), ("traj_text", "traces"))
B.cte("trace_prompts", _prompt_sql("trace"), ("traj_text", "traces"))


@query("hindsight_prompt", B.sql("state_prompts", body="SELECT task_id, md5(prompt) AS digest FROM state_prompts"))
def hindsight_prompt(spark, d):
    acted = F.exists("steps", lambda s: s["type"].isin("action", "answer"))
    t = with_trajectory(B.traces(spark, d).where(acted))
    p = prompts.hindsight_prompt(
        "question", "sub_task", "images", S.trajectory_text("entries"), "is_correct", "ground_truth", "state", TOOLS
    )
    return t.select("task_id", F.md5(p).alias("digest"))


def _error_rules() -> str:
    from trailmark.schemas import ERROR_CATEGORIES

    return "Name every category that applies: " + ", ".join(ERROR_CATEGORIES) + '.\nReply with a JSON object: {"error_categories": ["..."], "analysis": "..."}'


@query("analysis_prompt", B.sql("run_a", "steps", body=f"""
SELECT r.idx, md5('- Question: ' || question || {_NL} || '- Choices: en, de, fr, es' || {_NL} || '- Ground truth: ' || ground_truth || {_NL}
  || '- Images: img_0' || {_NL} || '- Answer given: ' || predicted || {_quoted(chr(10) * 2 + '## Trace' + chr(10))} || coalesce(trace_text, 'N/A')
  || {_quoted(chr(10) * 2 + '## Reply' + chr(10) + _error_rules())}) AS digest
FROM run_a r LEFT JOIN (SELECT doc_id, string_agg(rn || '. ' || txt, {_NL} ORDER BY pos) AS trace_text FROM (
    SELECT doc_id, pos, txt, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn FROM (
      SELECT doc_id, pos, CASE WHEN type IN ('think', 'answer') AND x <> '' THEN x WHEN type = 'action' THEN '[' || tool || ']' END AS txt
      FROM steps) WHERE txt IS NOT NULL) GROUP BY doc_id) f ON r.idx = f.doc_id WHERE NOT r.is_correct"""))
def analysis_prompt(spark, d):
    from trailmark.operators.filters import incorrect_results

    wrong = incorrect_results(B.runs(spark, d)[0])
    t = C.attach_traces(C.with_trace_only(wrong, B.traces(spark, d)), B.traces(spark, d))
    ready = t.withColumn("image_paths", F.array(F.lit("img/0.png"))).withColumn("formatted_trace", X.format_trace("steps"))
    return ready.select("idx", F.md5(prompts.analysis_prompt("error")).alias("digest"))


class LengthAnnotator:
    """Test annotator: quality from the prompt length for the first state; fails on the first attempt."""

    def __init__(self) -> None:
        self.calls = 0

    def annotate(self, prompt: str, images: list[str]) -> str:
        self.calls += 1
        if self.calls == 1:
            raise TimeoutError("first call")
        n = len(prompt)
        if n % 13 == 0:
            raise models.Refused("filtered")
        if "Reply with a JSON object" in prompt:
            body = json.dumps({"experience": "" if n % 7 == 0 else f" advice {n} "})
        else:
            body = json.dumps([{"state": 0, "q_value": n % 11, "experience": f"advice {n}"}])
        return f"```json\n{body}\n```"


def _saved(spark):
    """Tables are written compressed and by columns, so that a later step reads the columns it needs."""
    folder = checkpoint_dir(spark).rstrip("/")

    def save(df):
        path = f"{folder}/bank-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return save


B.cte("built", f"""
SELECT s.*, row_number() OVER (ORDER BY s.task_id, s.state_index) - 1 AS bank_row, length(p.prompt) AS n, coalesce(p.is_correct, false) AS ok
FROM states s JOIN state_prompts p ON s.task_id = p.task_id WHERE length(p.prompt) % 13 <> 0""", ("states", "state_prompts"))


def _state_bank(spark, d):
    return banks.build_state_bank(
        B.traces(spark, d), LengthAnnotator, models.HashEncoder, _saved(spark), "both", TOOLS
    )


@query("build_state_bank", B.sql("built", body=f"""
SELECT bank_row, task_id, state_index AS state, CASE WHEN state_index = 0 THEN n % 11 ELSE 5 END AS q_value,
  CASE WHEN state_index = 0 THEN 'advice ' || n ELSE '' END AS experience, CASE WHEN ok THEN 'correct' ELSE 'incorrect' END AS source,
  len(list_filter({_VIEWS_SQL}, lambda v: v.m & {_HAVE} = v.m)) AS n_views FROM built"""))
def build_state_bank(spark, d):
    meta, _ = _state_bank(spark, d)
    return meta.select("bank_row", "task_id", "state", "q_value", "experience", "source", F.size("available_views").alias("n_views"))


_HEX = "(strpos('0123456789abcdef', substr(h, 1, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(h, 2, 1)) - 1"


@query("bank_embeddings", B.sql("built", body=f"""
SELECT bank_row, view, round(avg(({_HEX}) / 255.0::DOUBLE - 0.5), 4) + 0.0 AS first_value FROM (
  SELECT bank_row, view, md5(txt || CASE WHEN img = '' THEN '' ELSE '|' || img END) AS h FROM (
    SELECT bank_row, v.v AS view, concat_ws({_NL}, CASE WHEN v.m & 1 > 0 THEN 'Question: ' || question END, CASE WHEN v.m & 2 > 0 THEN 'Task: ' || sub_task END,
      CASE WHEN v.m & 4 > 0 THEN 'Images are provided.' END,
      CASE WHEN v.m & 8 > 0 THEN array_to_string(list_transform(observations, lambda o: 'Observation: ' || o), {_NL}) END) AS txt,
      unnest(CASE WHEN v.m & 4 > 0 THEN images ELSE [''] END) AS img
    FROM (SELECT *, unnest(list_filter({_VIEWS_SQL}, lambda v: v.m & {_HAVE} = v.m)) AS v FROM built))) GROUP BY 1, 2"""))
def bank_embeddings(spark, d):
    _, vectors = _state_bank(spark, d)
    return vectors.select("bank_row", "view", F.round(F.get("embedding", 0).cast("double"), 4).alias("first_value"))


@query("build_trace_bank", B.sql("trace_prompts", body="""
SELECT row_number() OVER (ORDER BY task_id) - 1 AS bank_row, task_id, 'advice ' || length(prompt) AS experience, 'correct' AS source
FROM trace_prompts WHERE is_correct AND length(prompt) % 13 <> 0 AND length(prompt) % 7 <> 0"""))
def build_trace_bank(spark, d):
    bank = banks.build_trace_bank(
        B.traces(spark, d), LengthAnnotator, models.HashEncoder, _saved(spark), "correct", TOOLS
    )
    return bank.select("bank_row", "task_id", "experience", "source")


@query("annotate", B.sql("trace_prompts", body="""
SELECT task_id, 'advice ' || length(prompt) AS experience FROM trace_prompts WHERE length(prompt) % 13 <> 0 AND length(prompt) % 7 <> 0"""))
def annotate(spark, d):
    """Replies whose advice is not blank; a refused or blank prompt yields no row."""
    t = banks._prompted(B.traces(spark, d), "trace", TOOLS).select("task_id", "prompt")
    out = models.annotate(t, LengthAnnotator, banks._is_object_reply)
    from trailmark.functions.jsons import extract_json_object

    experience = X.strip(F.get_json_object(extract_json_object("reply"), "$.experience"))
    return out.select("task_id", experience.alias("experience"))

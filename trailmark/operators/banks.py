"""Building, merging and checking experience banks.

A state bank is two tables: ``meta`` (one row per state) and ``vectors`` (one
row per state and view that has an embedding; a missing row is a masked one).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions import models, prompts
from trailmark.functions import steps as S
from trailmark.functions import views as V
from trailmark.functions.jsons import extract_json, extract_json_object
from trailmark.functions.text import index_text, prefix_task_id, strip
from trailmark.operators.filters import filter_outcome, is_correct, non_empty
from trailmark.operators.skew import number_ranges
from trailmark.operators.trajectories import explode_views, to_states, with_trajectory
from trailmark.schemas import VIEWS

# ---- embeddings -------------------------------------------------------------


def mean_pool(df: DataFrame, key: str, embedding: str = "embedding") -> DataFrame:
    """Element-wise mean of the vectors of a key, combined before the shuffle."""
    vectors = df.where(F.col(embedding).isNotNull()).select(key, array_to_vector(embedding).alias("_v"))
    means = vectors.groupBy(key).agg(Summarizer.mean(F.col("_v")).alias("_m"))
    return means.select(key, vector_to_array("_m", "float32").alias(embedding))


def with_fallback_text(
    keys: DataFrame, image_vectors: DataFrame, text_vectors: DataFrame, key: str
) -> DataFrame:
    """Mean image vector per key, the text vector where a key has no image."""
    pooled = mean_pool(image_vectors, key).withColumnRenamed("embedding", "_img")
    return (
        keys.select(key)
        .join(pooled, key, "left")
        .join(text_vectors.select(key, F.col("embedding").alias("_txt")), key, "left")
        .select(key, F.coalesce("_img", "_txt").alias("embedding"))
    )


# ---- merge and checks -------------------------------------------------------


def merge_banks(banks: list[tuple[str, DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Append banks ``(prefix, meta, vectors)``; task ids get the prefix, rows follow the earlier banks' last row.

    A view a bank lacks simply has no rows there, which is what masked means. Raises when vectors differ in length.
    """
    metas, vectors, offset, dim = [], [], 0, None
    for prefix, meta, vec in banks:
        shift = (F.col("bank_row") + F.lit(offset)).cast("long")
        metas.append(meta.withColumn("task_id", prefix_task_id(prefix, "task_id")).withColumn("bank_row", shift))
        vectors.append(vec.withColumn("bank_row", shift))
        rows = meta.select("bank_row", F.lit(None).cast("int").alias("n")).unionByName(
            vec.select("bank_row", F.size("embedding").alias("n"))
        )
        last, low, high = rows.agg(F.max("bank_row"), F.min("n"), F.max("n")).first()
        if low is not None and (low != high or low != (dim or low)):
            raise ValueError(f"bank {prefix} has vectors of {low} to {high} numbers, expected {dim or low}")
        dim = dim or low
        offset += 0 if last is None else last + 1
    out_meta, out_vec = metas[0], vectors[0]
    for m, v in zip(metas[1:], vectors[1:]):
        out_meta = out_meta.unionByName(m, allowMissingColumns=True)
        out_vec = out_vec.unionByName(v)
    return out_meta, out_vec


def validate_bank(meta: DataFrame, vectors: DataFrame) -> DataFrame:
    """Violations of a bank: ``(problem, view, n)``; empty for a sound one."""
    dims = vectors.groupBy("view").agg(
        F.min(F.size("embedding")).alias("lo"), F.max(F.size("embedding")).alias("hi")
    )
    # At most 15 views: what is compared here is one row per view.
    overall = dims.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    mixed = overall.where("lo <> hi").select(
        F.lit("mixed dimension").alias("problem"), F.lit("").alias("view"), (F.col("hi") - F.col("lo")).cast("long").alias("n")
    )
    orphans = vectors.select("bank_row", "view").join(meta.select("bank_row"), "bank_row", "left_anti")
    twice = vectors.groupBy("view", "bank_row").count().where("count > 1")
    meta_twice = meta.groupBy("bank_row").count().where("count > 1")
    unknown = vectors.where(~F.col("view").isin(*VIEWS))

    def count_by_view(df: DataFrame, problem: str) -> DataFrame:
        return df.groupBy("view").agg(F.count(F.lit(1)).alias("n")).select(F.lit(problem).alias("problem"), "view", "n")

    return (
        mixed.unionByName(count_by_view(orphans, "vector without meta row"))
        .unionByName(count_by_view(twice, "duplicate vector"))
        .unionByName(count_by_view(meta_twice.withColumn("view", F.lit("")), "duplicate meta row"))
        .unionByName(count_by_view(unknown, "unknown view"))
    )


def bank_stats(meta: DataFrame, vectors: DataFrame) -> DataFrame:
    """Valid and total states per view of the bank."""
    return vectors.groupBy("view").agg(
        F.count(F.lit(1)).alias("valid"), F.lit(meta.count()).alias("total")
    )


def q_value_counts(meta: DataFrame) -> DataFrame:
    """How often each quality value occurs per trace."""
    return meta.groupBy("task_id", "q_value").agg(F.count(F.lit(1)).alias("n"))


# ---- end to end -------------------------------------------------------------


def _prompted(traces: DataFrame, level: str, tools: dict[str, str] | None) -> DataFrame:
    acted = F.exists("steps", lambda s: s["type"].isin("action", "answer"))
    with_entries = with_trajectory(traces.where(acted))
    text = S.trajectory_text("entries")
    prompt = prompts.hindsight_prompt(
        "question", "sub_task", "images", text, "is_correct", "ground_truth", level, tools
    )
    return with_entries.withColumn("prompt", prompt)


def _source() -> Column:
    return F.when(is_correct(), "correct").otherwise("incorrect")


def annotated_states(
    traces: DataFrame,
    annotator: Callable[[], models.Annotator],
    mode: str = "both",
    tools: dict[str, str] | None = None,
) -> DataFrame:
    """States of the wanted traces with quality and advice from the annotator.

    A trace whose annotation fails yields no states. Annotations stay in the
    trace's row, so attaching them needs no join: the last one per state wins,
    a state without one gets quality 5.
    """
    needed = ["task_id", "question", "sub_task", "images", "is_correct", "entries"]
    asked = _prompted(filter_outcome(traces, mode), "state", tools).select(*needed, "prompt")
    replied = models.annotate(asked, annotator, _is_list_reply, images="images", keep=needed)
    notes = F.from_json(
        extract_json("reply")["raw"], "array<struct<state:int,state_index:int,q_value:int,experience:string>>"
    )
    states = to_states(replied.withColumn("_notes", notes))
    mine = F.filter("_notes", lambda a: F.coalesce(a["state"], a["state_index"]) == F.col("state_index"))
    last = F.try_element_at(mine, F.lit(-1))
    return states.select(
        "task_id", F.col("state_index").alias("state"), "elements",
        F.when(last.isNotNull(), F.coalesce(last["experience"], F.lit(""))).otherwise("").alias("experience"),
        F.when(last.isNotNull(), F.coalesce(last["q_value"], F.lit(5))).otherwise(5).alias("q_value"),
        _source().alias("source"),
    )


def _is_list_reply(reply: str) -> bool:
    """A fenced or bare JSON list somewhere in the reply."""
    import json
    import re

    fenced = re.search(r"```(?:json)?\s*(\[.*?\])\s*```", reply, re.S)
    bare = re.search(r"\[.*?\]", reply, re.S)
    text = fenced.group(1) if fenced else bare.group(0) if bare else reply
    try:
        return isinstance(json.loads(text), list)
    except ValueError:
        return False


def build_state_bank(
    traces: DataFrame,
    annotator: Callable[[], models.Annotator],
    encoder: Callable[[], models.Encoder],
    save: Callable[[DataFrame], DataFrame],
    mode: str = "both",
    tools: dict[str, str] | None = None,
    batch_size: int = 32,
) -> tuple[DataFrame, DataFrame]:
    """Bank tables from traces: filter, annotate, split into states and views, embed.

    ``save`` writes a table and reads it back (or checkpoints it). It is applied
    to the annotated states, because annotations are not repeatable and both
    bank tables derive from them, and to the vectors, so that a payload is encoded once.
    """
    states = annotated_states(traces, annotator, mode, tools)
    state_text = V.compose_view("elements", F.lit(VIEWS[-1]))["text"]
    kept = save(states.withColumn("state_text", state_text).withColumn("available_views", V.available_views("elements")))
    meta = save(number_ranges(kept, ["task_id", "state"], "bank_row", save))
    payload = explode_views(meta.select("bank_row", "elements"))
    return meta, save(models.embed(payload, encoder, images="view_images", batch_size=batch_size, keep=["bank_row", "view"]))


def build_trace_bank(
    traces: DataFrame,
    annotator: Callable[[], models.Annotator],
    encoder: Callable[[], models.Encoder],
    save: Callable[[DataFrame], DataFrame],
    mode: str = "correct",
    tools: dict[str, str] | None = None,
    batch_size: int = 32,
) -> DataFrame:
    """Trace bank table: one row per wanted trace with advice and a non-blank index text."""
    needed = ["task_id", "question", "sub_task", "images", "is_correct"]
    asked = _prompted(filter_outcome(traces, mode), "trace", tools).select(*needed, "prompt")
    replied = models.annotate(asked, annotator, _is_object_reply, images="images", keep=needed)
    experience = strip(F.get_json_object(extract_json_object("reply"), "$.experience"))
    rows = replied.select(
        "task_id", experience.alias("experience"), _source().alias("source"),
        index_text("question", "sub_task").alias("text"), "images",
    )
    kept = save(non_empty(rows, "experience", "text"))
    ranked = number_ranges(kept, ["task_id"], "bank_row", save)
    return save(models.embed(ranked, encoder, images="images", batch_size=batch_size, keep=["bank_row", "task_id", "experience", "source"]))


def _is_object_reply(reply: str) -> bool:
    import json
    import re

    fenced = re.search(r"```(?:json)?\s*(\{.*?\})\s*```", reply, re.S)
    bare = re.search(r"\{.*?\}", reply, re.S)
    text = fenced.group(1) if fenced else bare.group(0) if bare else reply
    try:
        parsed = json.loads(text)
    except ValueError:
        return False
    return isinstance(parsed, dict) and bool(str(parsed.get("experience", "")).strip())

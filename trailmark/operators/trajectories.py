"""Traces, step tables and state trajectories.

A trace document is one row with a ``steps`` array: its operators work inside
the row and never shuffle. A step table is one row per step, in any number per
task: its operators order rows per task through ``skew.running``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions import steps as S
from trailmark.functions import views as V
from trailmark.functions.text import describe_input
from trailmark.operators.skew import TARGET_ROWS, Running, row_number, running

RANGE_BITS = 13  # 8,192 positions are numbered together

# ---- trace documents --------------------------------------------------------


def with_trajectory(traces: DataFrame, steps: str = "steps") -> DataFrame:
    """Add ``entries``: the trajectory of every trace."""
    return traces.withColumn("entries", S.trajectory(steps))


def to_states(traces: DataFrame) -> DataFrame:
    """One row per state of a trace with its elements.

    Needs ``question``, ``sub_task``, ``images`` and ``entries``.
    """
    other = [c for c in traces.columns if c not in ("entries", "steps")]
    lined = traces.select(*other, "entries", S.tool_lines("entries").alias("_lines"))
    # ``explode`` would add a filter on the array's size that Spark pushes to the scan
    # together with a second copy of the array's expression.
    exploded = lined.select(*other, "_lines", F.explode_outer("entries").alias("entry")).where("entry is not null")
    index = F.col("entry.state_index")
    return exploded.select(
        *other,
        index.alias("state_index"),
        F.col("entry").alias("entry"),
        S.state_elements("question", "sub_task", "images", "_lines", index).alias("elements"),
    )


def explode_views(states: DataFrame) -> DataFrame:
    """One row per state and available view with the payload to embed."""
    keep = [c for c in states.columns if c != "elements"]
    e = F.col("elements")
    # a state's parts are composed once and carried through the views, which join them
    parts = states.select(
        *keep, V.element_mask("elements").alias("_have"), *[t.alias(f"_t{i}") for i, t in enumerate(V.element_texts(e))],
        V.filled_images(e).alias("_images"),
    )
    listed = parts.withColumn("view", F.explode_outer(V.views_of_mask(F.col("_have")))).where("view is not null")
    views = listed.withColumn("_mask", V.view_mask("view"))
    used = [F.when(F.col("_mask").bitwiseAND(1 << i) != 0, F.col(f"_t{i}")) for i in range(len(V.ELEMENTS))]
    images = F.when(F.col("_mask").bitwiseAND(1 << V.ELEMENTS.index("images")) != 0, F.col("_images"))
    none = F.array().cast("array<string>")
    return views.select(*keep, "view", F.concat_ws("\n", *used).alias("text"), F.coalesce(images, none).alias("view_images"))


def step_rows(traces: DataFrame, key: str = "task_id") -> DataFrame:
    """Step table of trace documents."""
    return traces.select(key, F.explode_outer("steps").alias("s")).where("s is not null").select(key, "s.*")


def attach_retrieval_logs(traces: DataFrame, key: str = "task_id") -> DataFrame:
    """Retrieval-log entries with the step they announce.

    The step number comes from the entry's own key; ``follows`` is the next
    numbered step in the trace, ``consistent`` tells whether both agree.
    """
    later = F.filter("steps", lambda s: s["step"].try_cast("int").isNotNull())
    found = traces.select(
        key,
        F.filter("steps", lambda s: s["log_step"].isNotNull()).alias("_logs"),
        F.transform(later, lambda s: F.struct(s["pos"].alias("pos"), s["step"].try_cast("int").alias("step"))).alias("_later"),
    )
    one = found.select(key, "_later", F.explode_outer("_logs").alias("g")).where("g is not null")
    after = F.get(F.filter("_later", lambda s: s["pos"] > F.col("g.pos")), 0)
    logs = one.select(
        key, F.col("g.pos").alias("pos"), F.col("g.log_step").alias("step"), F.col("g.log_rounds").alias("rounds"),
        after["step"].alias("follows"),
    )
    return logs.withColumn("consistent", F.coalesce(F.col("step") == F.col("follows"), F.lit(False)))


def rounds_of_states(logs: DataFrame, steps: DataFrame, key: str = "task_id") -> DataFrame:
    """Which views were searched before which step: logs joined to their steps."""
    round_schema = "array<struct<round:int,view:string,experiences:array<string>>>"
    rounds = logs.select(
        key, F.col("step"), F.explode(F.from_json("rounds", round_schema)).alias("r")
    ).select(key, "step", F.col("r.round").alias("round"), F.col("r.view").alias("view"),
             F.size("r.experiences").alias("n_experiences"))
    target = steps.where(F.col("step").try_cast("int").isNotNull()).select(
        key, F.col("step").try_cast("int").alias("step"), "type", "tool"
    )
    return rounds.join(target, [key, "step"])


# ---- step tables ------------------------------------------------------------


def step_trajectory(
    steps: DataFrame,
    key: str = "task_id",
    axes: dict[str, Column] | None = None,
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Trajectory rows of a step table (``type, tool, content, properties, observation``).

    A terminal step (action or answer) takes the content of the step right
    before it when that is a think; other step types are ignored.
    """
    axes = axes or {"pos": F.col("pos")}
    relevant = steps.where(F.col("type").isin("think", "action", "answer"))
    terminal = F.col("type") != "think"
    marked = running(
        relevant, [key], axes,
        {
            "_before": Running("previous", F.struct("type", "content")),
            "state_index": Running("sum_before", terminal.cast("int")),
        },
        target_rows=target_rows,
    )
    answer = F.col("type") == "answer"
    return marked.where(terminal).select(
        key,
        *[c for c in steps.columns if c not in (key, "type", "tool", "content", "properties", "observation")],
        F.col("state_index").cast("int").alias("state_index"),
        F.when(F.col("_before.type") == "think", F.coalesce("_before.content", F.lit("")))
        .otherwise("").alias("thinking"),
        F.when(answer, "answer").otherwise(F.coalesce("tool", F.lit(""))).alias("tool"),
        F.when(answer, F.to_json(F.struct(F.coalesce("content", F.lit("")).alias("content"))))
        .otherwise(F.coalesce("properties", F.lit("{}"))).alias("parameters"),
        F.when(~answer, F.coalesce("observation", F.lit(""))).alias("observation"),
    )


def state_history(
    trajectory: DataFrame,
    key: str = "task_id",
    axes: dict[str, Column] | None = None,
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Size of the observation history each state can see.

    ``n_observations`` tool observations and ``observation_chars`` characters
    precede the state. The texts stay in the trajectory rows: a state sees the
    tool rows with a lower ``state_index``, so nothing is copied per state.
    """
    axes = axes or {"state": F.col("state_index")}
    seen = F.col("tool") != "answer"
    line = S.observation_line(F.struct("tool", "parameters", "observation"))
    return running(
        trajectory, [key], axes,
        {
            "n_observations": Running("sum_before", seen.cast("long")),
            "observation_chars": Running("sum_before", F.when(seen, F.length(line)).otherwise(0).cast("long")),
        },
        target_rows=target_rows,
    )


def number_steps(
    events: DataFrame,
    key: str = "task_id",
    axes: dict[str, Column] | None = None,
    numbered: Column | None = None,
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Step numbers for appended entries: one more than the numbered entries before.

    Entries that carry no step id (retrieval logs) get the number of the step
    that follows and consume none.
    """
    axes = axes or {"pos": F.col("pos")}
    flag = F.lit(True) if numbered is None else numbered
    out = running(
        events, [key], axes, {"_prior": Running("sum_before", flag.cast("long"))}, target_rows=target_rows
    )
    return out.withColumn("next_step", F.col("_prior") + 1).drop("_prior")


def next_step(steps: Column | str) -> Column:
    """Highest numeric step of a trace so far plus one; entries without a usable step are ignored."""
    numbers = F.transform(steps, lambda s: s["step"].try_cast("int"))
    return F.coalesce(F.array_max(F.filter(numbers, lambda n: n > 0)), F.lit(0)) + 1


def assign_ref_ids(
    media: DataFrame,
    key: str = "task_id",
    axes: dict[str, Column] | None = None,
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """``img_0, img_1, vid_0`` per task and modality: inputs first, then outputs, in order."""
    axes = axes or {"output": F.col("is_output").cast("int"), "pos": F.col("pos")}
    out = running(media, [key, "modality"], axes, {"_rn": row_number()}, target_rows=target_rows)
    return out.withColumn(
        "ref_id", F.concat("modality", F.lit("_"), (F.col("_rn") - 1).cast("string"))
    ).drop("_rn")


def describe_inputs(inputs: DataFrame) -> DataFrame:
    """Description per input from its 0-based position in its modality."""
    return inputs.withColumn("description", describe_input("pos", "modality"))


def reindex(
    df: DataFrame, position: str = "src_pos", name: str = "idx", target_rows: int = TARGET_ROWS
) -> DataFrame:
    """Dense 0-based index in source order, without moving the table to one task.

    Rows are whole texts, so a task orders the rows of a short range of positions; what comes before a range is summed
    over one narrow row per range. Rows of one position stay together and are cut when they are too many.
    """
    pos = F.col(position).cast("long")
    ranged = df.withColumn("_range", F.coalesce(F.shiftright(pos, RANGE_BITS), F.lit(-(1 << 63))))  # nulls come first
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).persist()  # narrow, read three times
    before = running(sizes, [], {"range": F.col("_range")}, {"_before": Running("sum_before", F.col("_n"))}, target_rows=target_rows)
    if sizes.where(F.col("_n") > target_rows).limit(1).count():
        numbered = running(ranged, ["_range"], {"pos": pos}, {name: row_number()}, target_rows=target_rows)
    else:
        numbered = ranged.withColumn(name, F.row_number().over(Window.partitionBy("_range").orderBy(pos)).cast("long"))
    out = numbered.join(before.select("_range", "_before"), "_range")
    return out.withColumn(name, F.col(name) - 1 + F.col("_before")).drop("_range", "_before")


def apply_turn_budget(
    turns: DataFrame,
    max_iterations: int = 10,
    max_epoch: int = 1,
    key: str = "task_id",
    axes: dict[str, Column] | None = None,
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Turns an agent would really run.

    ``turns`` has ``n_actions`` (tool calls that count) and ``answered``. A turn
    starts while earlier actions are below ``max_iterations``, earlier turns
    below the safety limit and no earlier turn answered. Adds ``actions_before``
    and ``turn_no``.
    """
    limit = max_iterations * (1 + max(1, max_epoch))
    axes = axes or {"turn": F.col("turn")}
    out = running(
        turns, [key], axes,
        {
            "actions_before": Running("sum_before", F.col("n_actions").cast("long")),
            "_answers": Running("sum_before", F.col("answered").cast("long")),
            "turn_no": row_number(),
        },
        target_rows=target_rows,
    )
    return out.where(
        (F.col("actions_before") < max_iterations) & (F.col("turn_no") <= limit) & (F.col("_answers") == 0)
    ).drop("_answers")


def turn_outcomes(
    turns: DataFrame, max_iterations: int = 10, max_epoch: int = 1, key: str = "task_id"
) -> DataFrame:
    """How each task ended: ``answered``, ``safety_stop``, ``max_iterations`` or ``open``.

    ``turns`` is the output of ``apply_turn_budget``.
    """
    limit = max_iterations * (1 + max(1, max_epoch))
    done = turns.groupBy(key).agg(
        F.count(F.lit(1)).alias("turns"), F.sum("n_actions").cast("long").alias("actions"),
        F.bool_or("answered").alias("answered"),
    )
    return done.withColumn(
        "outcome",
        F.when(F.col("answered"), "answered")
        .when(F.col("turns") >= limit, "safety_stop")
        .when(F.col("actions") >= max_iterations, "max_iterations")
        .otherwise("open"),
    )

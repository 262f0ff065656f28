"""Expressions over the step array of one trace document."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailmark.functions.text import col


def parse_steps(raw: Column | str) -> Column:
    """Step array of a raw JSON trace.

    Each element keeps its position. A retrieval-log entry has no type; its
    step number is read from its own key.
    """
    elements = F.from_json(col(raw), "array<string>")

    def step(e: Column, i: Column) -> Column:
        v = F.try_parse_json(e)

        def text(path: str) -> Column:
            return F.try_variant_get(v, path, "string")

        described = text("$.observation.description")
        keys = F.json_object_keys(e)
        log_key = F.get(F.filter(keys, lambda k: k.rlike(r"^experience_for_step_\d+$")), 0)
        is_log = text("$.type").isNull() & log_key.isNotNull()
        return F.struct(
            i.cast("int").alias("pos"),
            text("$.step").alias("step"),
            F.coalesce(text("$.type"), F.lit("")).alias("type"),
            text("$.tool").alias("tool"),
            text("$.content").alias("content"),
            F.coalesce(text("$.properties"), F.lit("{}")).alias("properties"),
            F.coalesce(described, text("$.observation"), F.lit("")).alias("observation"),
            text("$.state_experience").alias("state_experience"),
            F.when(is_log, F.regexp_extract(log_key, r"(\d+)$", 1).try_cast("int")).alias("log_step"),
            F.when(is_log, F.try_element_at(F.from_json(e, "map<string,string>"), log_key)).alias("log_rounds"),
        )

    return F.transform(elements, step)


def trajectory(steps: Column | str) -> Column:
    """Trajectory entries of a trace: each action or answer with the think right before it.

    Thinks and terminal steps are looked at in order; the thought of a terminal
    is the relevant step before it when that is a think, else ''.
    """
    relevant = F.filter(col(steps), lambda s: s["type"].isin("think", "action", "answer"))

    def with_thought(s: Column, before: Column) -> Column:
        return F.struct(
            s["type"].alias("type"),
            F.when(before["type"] == "think", F.coalesce(before["content"], F.lit("")))
            .otherwise(F.lit(""))
            .alias("thinking"),
            F.when(s["type"] == "answer", F.lit("answer"))
            .otherwise(F.coalesce(s["tool"], F.lit("")))
            .alias("tool"),
            F.when(
                s["type"] == "answer",
                F.to_json(F.struct(F.coalesce(s["content"], F.lit("")).alias("content"))),
            )
            .otherwise(F.coalesce(s["properties"], F.lit("{}")))
            .alias("parameters"),
            F.when(s["type"] == "action", F.coalesce(s["observation"], F.lit(""))).alias("observation"),
            F.when(s["type"] == "answer", F.coalesce(s["content"], F.lit(""))).alias("content"),
        )

    # The list is paired with itself one place later: a lambda that looked the
    # neighbour up would evaluate the whole list again for every element.
    paired = F.zip_with(relevant, F.array_prepend(relevant, F.lit(None)), with_thought)
    terminal = F.filter(paired, lambda t: t["type"].isin("action", "answer"))
    return F.transform(
        terminal,
        lambda t, i: F.struct(
            i.cast("int").alias("state_index"), t["thinking"].alias("thinking"), t["tool"].alias("tool"),
            t["parameters"].alias("parameters"), t["observation"].alias("observation"),
            t["content"].alias("content"),
        ),
    )


def observation_line(entry: Column) -> Column:
    return F.concat(
        entry["tool"], F.lit("("), entry["parameters"], F.lit(") -> "),
        F.coalesce(entry["observation"], F.lit("")),
    )


def tool_lines(entries: Column | str) -> Column:
    """Observation lines of the tool entries of a trajectory, in order."""
    tools = F.filter(col(entries), lambda t: t["tool"] != "answer")
    return F.transform(
        tools, lambda t: F.struct(t["state_index"].alias("state_index"), observation_line(t).alias("line"))
    )


def lines_before(lines: Column | str, state_index: Column) -> Column:
    """Lines of the tool entries before a state; ``lines`` comes from ``tool_lines``."""
    indexes = F.transform(col(lines), lambda t: t["state_index"])
    n = F.size(F.filter(indexes, lambda i: i < state_index))
    return F.slice(F.transform(col(lines), lambda t: t["line"]), F.lit(1), n)


def state_elements(
    question: Column | str, task: Column | str, images: Column | str, lines: Column | str, state_index: Column
) -> Column:
    """Struct (question, task, images, observations) of one state."""
    return F.struct(
        F.coalesce(col(question), F.lit("")).alias("question"),
        F.coalesce(col(task), F.lit("")).alias("task"),
        F.filter(col(images), lambda p: p.isNotNull() & (p != "")).alias("images"),
        lines_before(lines, state_index).alias("observations"),
    )


# The words of the texts below are fixed values.


def trajectory_text(entries: Column | str) -> Column:
    """Readable ``State s_i`` / ``Action a_i`` blocks of a trajectory."""
    e = col(entries)
    last = F.size(e) - 1

    def block(t: Column) -> Column:
        idx = t["state_index"].cast("string")
        action = F.concat_ws(
            "\n",
            F.concat(F.lit("Action a_"), idx, F.lit(":")),
            F.when(t["thinking"] != "", F.concat(F.lit("  Think: "), t["thinking"])),
            F.when(t["tool"] == "answer", F.lit("  Tool: answer")).otherwise(
                F.concat(F.lit("  Tool: "), t["tool"], F.lit("("), t["parameters"], F.lit(")"))
            ),
            F.when(t["tool"] == "answer", F.concat(F.lit("  Answer content: "), t["content"])).when(
                F.coalesce(t["observation"], F.lit("")) != "",
                F.concat(F.lit("  Observation: "), t["observation"]),
            ),
        )
        after = F.when(
            t["state_index"] < last,
            F.concat(F.lit("State s_"), (t["state_index"] + 1).cast("string")),
        )
        return F.concat_ws("\n\n", action, after)

    start = F.array(F.lit("State s_0:\n  - The question and input images shown above."))
    return F.array_join(F.concat(start, F.transform(e, block)), "\n\n")


def image_paths(raw: Column | str) -> Column:
    """Paths of a JSON list whose items are strings or objects with a path; blanks dropped."""
    items = F.from_json(col(raw), "array<string>")

    def path(e: Column) -> Column:
        return F.when(e.startswith("{"), F.get_json_object(e, "$.path")).otherwise(e)

    return F.coalesce(
        F.filter(F.transform(items, path), lambda p: p.isNotNull() & (p != "")),
        F.array().cast("array<string>"),
    )

"""Prompt texts for annotators, composed as columns. The wording is this library's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailmark.functions.text import col
from trailmark.schemas import ERROR_CATEGORIES

STATE_RULES = (
    "Rate every action from 0 (harmful) to 10 (decisive) and give one or two sentences of "
    "advice that another agent in the same state can use. Do not reveal the answer.\n"
    'Reply with a JSON list: [{"state": 0, "q_value": 7, "experience": "..."}]'
)
TRACE_RULES = (
    "Sum up in one or two sentences what an agent facing a similar task should do. "
    "Do not reveal the answer.\n"
    'Reply with a JSON object: {"experience": "..."}'
)


def tools_section(tools: dict[str, str] | None) -> str:
    """``- name: description`` lines under a heading; '' without tools."""
    if not tools:
        return ""
    return "\n".join(["", "## Tools"] + [f"- {n}: {d}" for n, d in tools.items()]) + "\n"


def hindsight_prompt(
    question: Column | str,
    sub_task: Column | str,
    images: Column | str,
    trajectory: Column | str,
    is_correct: Column | str,
    ground_truth: Column | str,
    level: str = "state",
    tools: dict[str, str] | None = None,
) -> Column:
    """Prompt to judge a finished trace; wrong traces name the right answer at state level."""
    ok = F.coalesce(col(is_correct), F.lit(False))
    truth = F.coalesce(col(ground_truth), F.lit(""))
    verdict = F.when(ok, F.lit("The agent solved this task correctly.")).otherwise(
        F.concat(
            F.lit("The agent solved this task incorrectly."),
            F.when((truth != "") & F.lit(level == "state"), F.concat(F.lit("\nCorrect answer: "), truth)).otherwise(""),
        )
    )
    task = F.coalesce(col(sub_task), F.lit(""))
    return F.concat(
        verdict,
        F.lit("\n\n## Task\n"),
        F.when(F.coalesce(F.size(col(images)), F.lit(0)) > 0, "The input images are shown above.\n").otherwise(""),
        F.lit("Question: "), F.coalesce(col(question), F.lit("")),
        F.when(task != "", F.concat(F.lit("\nType: "), task)).otherwise(""),
        F.lit("\n" + tools_section(tools) + "\n## Trajectory\n"),
        col(trajectory),
        F.lit("\n\n## Reply\n" + (STATE_RULES if level == "state" else TRACE_RULES)),
    )


def _facts(pairs: list[tuple[str, Column]]) -> Column:
    return F.concat_ws("\n", *[F.concat(F.lit(f"- {n}: "), F.coalesce(c, F.lit(""))) for n, c in pairs])


def analysis_prompt(kind: str, trace: Column | str = "formatted_trace") -> Column:
    """Prompt over a result row (``error``) or a pair of results (``compare``)."""
    question = F.coalesce(F.nullif(F.col("query"), F.lit("")), F.col("question"))
    facts = [
        ("Question", question),
        ("Choices", F.array_join("choices", ", ")),
        ("Ground truth", F.col("ground_truth")),
        ("Images", F.array_join(F.transform("image_paths", lambda p, i: F.concat(F.lit("img_"), i.cast("string"))), ", ")),
    ]
    if kind == "error":
        facts.append(("Answer given", F.col("predicted")))
        rules = (
            "Name every category that applies: " + ", ".join(ERROR_CATEGORIES)
            + '.\nReply with a JSON object: {"error_categories": ["..."], "analysis": "..."}'
        )
    elif kind == "compare":
        facts += [
            ("Direct answer", F.col("predicted")),
            ("Direct reasoning", F.col("response")),
            ("Tool answer", F.col("predicted_b")),
        ]
        rules = (
            "Explain why only one of the two approaches is right.\nReply with a JSON object: "
            '{"correct_approach": "direct|tool", "key_difference": "...", "explanation": "..."}'
        )
    else:
        raise ValueError(f"unknown prompt kind {kind!r}")
    return F.concat(_facts(facts), F.lit("\n\n## Trace\n"), col(trace), F.lit("\n\n## Reply\n" + rules))

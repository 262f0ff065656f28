"""Queries, results and accuracy of evaluation runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions.text import (
    build_query, extract_answer, is_answer_correct, scoring_error,
)
from trailmark.operators.filters import is_correct
from trailmark.operators.skew import latest, row_number, running
from trailmark.schemas import ANSWER_TOKEN


def with_query(samples: DataFrame, zh: bool = False, token: str = ANSWER_TOKEN) -> DataFrame:
    """Add the text a sample is asked with."""
    return samples.withColumn("query", build_query("prompt", "question", "choices", "type", zh, token))


def to_results(
    answered: DataFrame, use_tools: bool = False, zh: bool = False, token: str = ANSWER_TOKEN
) -> DataFrame:
    """Samples with a ``response`` to result rows.

    A task type that cannot be scored gives an error row with emptied query,
    prediction and response. Tool runs keep their text in the trace instead.
    """
    scored = answered.withColumn("_pred", extract_answer("response", token)).withColumn(
        "_error", scoring_error("_pred", "type")
    )
    ok = F.col("_error").isNull()
    blank = F.lit("")
    return scored.select(
        "idx",
        "question",
        F.coalesce(F.col("choices"), F.array().cast("array<string>")).alias("choices"),
        F.when(ok, build_query("prompt", "question", "choices", "type", zh, token)).otherwise(blank).alias("query"),
        F.col("answer").alias("ground_truth"),
        F.when(ok, F.col("_pred")).otherwise(blank).alias("predicted"),
        (ok & is_answer_correct("_pred", "answer", "type", "choices")).alias("is_correct"),
        (blank if use_tools else F.when(ok, F.col("response")).otherwise(blank)).alias("response"),
        F.coalesce(F.col("type"), F.lit("unknown")).alias("type"),
        F.coalesce(F.col("sub_task"), blank).alias("sub_task"),
        F.coalesce(F.col("dataset"), blank).alias("dataset"),
        F.col("_error").alias("error"),
    )


def accuracy(correct: Column, total: Column) -> Column:
    """Rounded share; 0 for an empty run."""
    return F.round(F.coalesce(F.try_divide(correct.cast("double"), total), F.lit(0.0)), 4)


def eval_stats(results: DataFrame) -> DataFrame:
    """Total, correct and accuracy of a run."""
    counts = results.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(is_correct()).alias("correct")
    )
    return counts.withColumn("accuracy", accuracy(F.col("correct"), F.col("total")))


def results_with_samples(results: DataFrame, samples: DataFrame, position: str = "src_pos") -> DataFrame:
    """Results with the group columns of their first matching sample."""
    first = latest(samples.select("idx", "type", "sub_task", position), ["idx"], F.col(position), keep="first")
    return results.select("idx", "is_correct").join(first, "idx")


def stats_by(samples: DataFrame, results: DataFrame, group: str, position: str = "src_pos") -> DataFrame:
    """Accuracy per group: totals from the samples, correct answers from the results.

    A sample without sub_task counts as ``unknown``; an empty one keeps its name.
    """
    key = F.coalesce(F.col(group), F.lit("unknown")).alias(group)
    totals = samples.groupBy(key).agg(F.count(F.lit(1)).alias("total"))
    hits = (
        results_with_samples(results, samples, position)
        .where(is_correct())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("correct"))
    )
    return totals.join(hits, group, "left").select(
        group, "total", F.coalesce("correct", F.lit(0)).alias("correct"),
        accuracy(F.coalesce("correct", F.lit(0)), F.col("total")).alias("accuracy"),
    )


def run_stats(samples: DataFrame, results: DataFrame, position: str = "src_pos") -> DataFrame:
    """Overall, per-type and per-sub-task accuracy in one pass: rows ``(level, name, total, correct, accuracy)``."""
    named = lambda c: F.coalesce(F.col(c), F.lit("unknown")).alias(c)
    sides = samples.select(
        named("type"), named("sub_task"), F.lit(1).alias("n"), F.lit(0).alias("hit")
    ).unionByName(
        results_with_samples(results, samples, position).where(is_correct())
        .select(named("type"), named("sub_task"), F.lit(0).alias("n"), F.lit(1).alias("hit"))
    )
    grouped = sides.groupingSets([[], [F.col("type")], [F.col("sub_task")]], "type", "sub_task").agg(
        F.grouping_id().alias("g"), F.sum("n").alias("total"), F.sum("hit").alias("correct")
    )
    return grouped.select(
        F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "type").otherwise("sub_task").alias("level"),
        F.when(F.col("g") == 3, "").when(F.col("g") == 1, F.col("type")).otherwise(F.col("sub_task")).alias("name"),
        "total", "correct", accuracy(F.col("correct"), F.col("total")).alias("accuracy"),
    )


def batch_stats(results: DataFrame, batch_size: int, position: str = "idx") -> DataFrame:
    """Correct answers and percentage per batch of ``batch_size`` rows in order."""
    ranked = running(
        results.select(position, "is_correct"), [], {"pos": F.col(position)}, {"rn": row_number()}
    )
    counts = ranked.groupBy(F.floor((F.col("rn") - 1) / batch_size).cast("long").alias("batch")).agg(
        F.count_if(is_correct()).alias("correct"), F.count(F.lit(1)).alias("total")
    )
    return counts.withColumn("pct", F.round(F.col("correct") * F.lit(100.0) / F.col("total"), 1))


def sort_results(results: DataFrame) -> DataFrame:
    return results.orderBy("idx")


def run_label(model: Column | str, qa_type: Column | str) -> Column:
    """``model (qa_type)``."""
    name = F.col(model) if isinstance(model, str) else model
    kind = F.col(qa_type) if isinstance(qa_type, str) else qa_type
    return F.concat(name, F.lit(" ("), F.coalesce(kind, F.lit("unknown")), F.lit(")"))


def call_stats(calls: DataFrame, by: str = "instance") -> DataFrame:
    """Calls, errors and retries per client instance of a call log."""
    return calls.groupBy(by).agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
        F.coalesce(F.sum("retries"), F.lit(0)).alias("retries"),
    )

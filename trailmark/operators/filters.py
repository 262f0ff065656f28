"""Row filters on traces, results, samples and detections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions.geometry import box_error
from trailmark.functions.text import col, is_blank, strip
from trailmark.schemas import UNANSWERABLE


def is_correct(c: Column | str = "is_correct") -> Column:
    """Outcome of a trace or result; a missing one counts as incorrect."""
    return F.coalesce(col(c), F.lit(False))


def filter_outcome(df: DataFrame, mode: str = "both") -> DataFrame:
    """Traces of the wanted outcome: ``correct``, ``incorrect`` or ``both``."""
    if mode == "both":
        return df
    if mode not in ("correct", "incorrect"):
        raise ValueError(f"unknown mode {mode!r}")
    return df.where(is_correct() if mode == "correct" else ~is_correct())


def outcome_counts(df: DataFrame) -> DataFrame:
    """Number of correct, incorrect and all traces."""
    return df.agg(
        F.count_if(is_correct()).alias("n_correct"),
        F.count_if(~is_correct()).alias("n_incorrect"),
        F.count(F.lit(1)).alias("n_traces"),
    )


def incorrect_results(df: DataFrame) -> DataFrame:
    """Results marked incorrect; a missing mark counts as correct here."""
    return df.where(~F.coalesce(F.col("is_correct"), F.lit(True)))


def is_multi_choice_type(question_type: Column | str, choices: Column | str) -> Column:
    """Declared type decides when it is known, else at least two choices."""
    declared = F.lower(F.coalesce(col(question_type), F.lit("")))
    return (
        F.when(declared.isin("multiple-choice", "multi-choice", "multiple_choice"), F.lit(True))
        .when(declared.isin("open", "open-ended", "fill-in", "free-form"), F.lit(False))
        .otherwise(F.coalesce(F.size(col(choices)), F.lit(0)) >= 2)
    )


def keep_multi_choice(df: DataFrame, question_type: str = "question_type", choices: str = "choices") -> DataFrame:
    return df.where(is_multi_choice_type(question_type, choices))


def is_answerable(answer: Column | str, choices: Column | str) -> Column:
    """Answer is given, not one of the fixed unanswerable words, and among the choices if any."""
    a = F.coalesce(col(answer), F.lit(""))
    known = (a != "") & ~F.lower(a).isin(*UNANSWERABLE)
    listed = (F.coalesce(F.size(col(choices)), F.lit(0)) <= 0) | F.array_contains(col(choices), a)
    return known & listed


def drop_unanswerable(df: DataFrame, answer: str = "answer", choices: str = "choices") -> DataFrame:
    return df.where(is_answerable(answer, choices))


def keep_first_cycle(df: DataFrame, cycle: str = "cycle_category") -> DataFrame:
    """One variant per item: cycle 0, stored as number or text."""
    return df.where(F.col(cycle).cast("string") == "0")


def require_image(df: DataFrame, policy: str = "drop", images: str = "images") -> DataFrame:
    """Rows without image: ``drop`` them, ``keep`` with an empty list, or give a ``placeholder`` path."""
    paths = F.coalesce(F.col(images), F.array().cast("array<string>"))
    if policy == "drop":
        return df.where(F.size(paths) > 0)
    if policy == "keep":
        return df.withColumn(images, paths)
    if policy == "placeholder":
        name = F.format_string("%05d/00000.png", F.col("idx").cast("long"))
        return df.withColumn(images, F.when(F.size(paths) > 0, paths).otherwise(F.array(name)))
    raise ValueError(f"unknown image policy {policy!r}")


def non_empty(df: DataFrame, *cols: str) -> DataFrame:
    """Rows whose texts are all more than whitespace."""
    return df.where(reduce(lambda a, b: a & b, [F.length(strip(c)) > 0 for c in cols]))


def non_blank_question(df: DataFrame, question: str = "question") -> DataFrame:
    return df.where(~is_blank(question))


def validate_boxes(df: DataFrame, box: str = "box") -> DataFrame:
    """Add ``error`` (null when usable) and ``ok``."""
    return df.withColumn("error", box_error(box)).withColumn("ok", F.col("error").isNull())


def filter_detections(df: DataFrame, threshold: float = 0.5, score: str = "score") -> DataFrame:
    return df.where(F.col(score) >= threshold)


def filter_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows before and after a filter, dropped rows and the kept share in percent."""
    counts = (
        before.agg(F.count(F.lit(1)).alias("n"))
        .withColumn("side", F.lit("before"))
        .unionByName(after.agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit("after")))
        .agg(
            F.max(F.when(F.col("side") == "before", F.col("n"))).alias("total"),
            F.max(F.when(F.col("side") == "after", F.col("n"))).alias("kept"),
        )
    )
    return counts.select(
        "total", "kept", (F.col("total") - F.col("kept")).alias("dropped"),
        F.round(F.coalesce(F.try_divide(F.col("kept") * F.lit(100.0), F.col("total")), F.lit(0.0)), 1).alias("kept_pct"),
    )


def unanswerable_report(df: DataFrame, answer: str = "answer") -> DataFrame:
    """Unanswerable rows and their share in percent."""
    word = F.lower(strip(F.coalesce(F.col(answer), F.lit(""))))
    n_bad = F.count_if(word.isin(*UNANSWERABLE))
    total = F.count(F.lit(1))
    return df.agg(
        total.alias("total"),
        n_bad.alias("unanswerable"),
        F.round(F.coalesce(F.try_divide(n_bad * F.lit(100.0), total), F.lit(0.0)), 1).alias("unanswerable_pct"),
    )

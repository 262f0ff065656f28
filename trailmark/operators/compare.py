"""Joins between runs, traces and samples; comparison of two runs; error summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions.jsons import extract_json_object
from trailmark.functions.text import used_tools
from trailmark.operators.filters import is_correct
from trailmark.operators.scoring import eval_stats
from trailmark.operators.skew import latest
from trailmark.schemas import ERROR_CATEGORIES

# ---- outcome and ground truth on traces -------------------------------------


def backfill_ground_truth(traces: DataFrame, results: DataFrame, position: str = "src_pos") -> DataFrame:
    """Fill missing ground truth of traces from results.

    The last usable result per key wins. ``backfill`` tells what happened:
    ``skipped`` (had one), ``updated`` or ``unmatched``.
    """
    usable = results.where(
        (F.coalesce(F.col("ground_truth"), F.lit("")) != "")
        & (F.coalesce(F.col("idx").cast("string"), F.lit("")) != "")
    )
    known = usable.groupBy(F.col("idx").cast("string").alias("_key")).agg(
        F.max_by("ground_truth", position).alias("_found")
    )
    key = F.coalesce(F.col("dataset_id").cast("string"), F.lit(""))
    joined = traces.join(known, key == F.col("_key"), "left")
    had = F.col("ground_truth").isNotNull()
    return joined.withColumn(
        "backfill",
        F.when(had, "skipped").when(F.col("_found").isNotNull(), "updated").otherwise("unmatched"),
    ).withColumn("ground_truth", F.coalesce("ground_truth", "_found")).drop("_key", "_found")


def backfill_report(backfilled: DataFrame) -> DataFrame:
    return backfilled.agg(
        F.count_if(F.col("backfill") == "updated").alias("updated"),
        F.count_if(F.col("backfill") == "skipped").alias("skipped"),
    )


def apply_outcomes(traces: DataFrame, results: DataFrame, position: str = "src_pos") -> DataFrame:
    """Write correctness (and non-empty ground truth) of results onto traces.

    Of several traces of one sample the first task takes the result.
    """
    outcome = latest(
        results.select(
            F.col("idx").cast("string").alias("_key"), F.col("is_correct").alias("_ok"),
            F.col("ground_truth").alias("_gt"), F.col(position).alias("_pos"),
        ),
        ["_key"], F.col("_pos"),
    )
    first = traces.groupBy(F.col("dataset_id").cast("string").alias("_did")).agg(F.min("task_id").alias("_first"))
    target = first.join(outcome, F.col("_did") == F.col("_key")).select(
        F.col("_first"), F.col("_did"), "_ok", "_gt"
    )
    joined = traces.join(
        target,
        (F.col("task_id") == F.col("_first")) & (F.col("dataset_id").cast("string") == F.col("_did")),
        "left",
    )
    return (
        joined.withColumn("is_correct", F.coalesce("_ok", "is_correct"))
        .withColumn("ground_truth", F.coalesce(F.nullif("_gt", F.lit("")), "ground_truth"))
        .drop("_first", "_did", "_ok", "_gt")
    )


def attach_annotations(states: DataFrame, annotations: DataFrame, key: str = "task_id") -> DataFrame:
    """Quality and advice onto trajectory rows; the last duplicate wins; defaults 5 and ''."""
    index = F.coalesce(F.col("state"), F.col("state_index")) if "state" in annotations.columns else F.col("state_index")
    last = latest(
        annotations.select(
            key, index.cast("int").alias("state_index"), F.col("q_value").alias("_q"),
            F.col("experience").alias("_e"), F.col("ann_pos"),
        ),
        [key, "state_index"], F.col("ann_pos"),
    ).withColumn("_hit", F.lit(True))
    joined = states.join(last, [key, "state_index"], "left")
    return (
        joined.withColumn("q_value", F.coalesce(F.col("_q").cast("int"), F.lit(5)))
        .withColumn("experience", F.coalesce("_e", F.lit("")))
        .drop("_q", "_e", "_hit", "ann_pos")
    )


# ---- traces of results ------------------------------------------------------


def trace_index(traces: DataFrame, keep: str = "last") -> DataFrame:
    """One trace per non-empty ``dataset_id``, the last or first by task id."""
    keyed = traces.withColumn("dataset_id", F.col("dataset_id").cast("string")).where(
        F.coalesce(F.col("dataset_id"), F.lit("")) != ""
    )
    return latest(keyed, ["dataset_id"], F.col("task_id"), keep)


def attach_traces(results: DataFrame, traces: DataFrame) -> DataFrame:
    """Results with the steps of their first trace; without one the response text stands in."""
    index = trace_index(traces.select("dataset_id", "task_id", "steps"), keep="first")
    joined = results.join(index, results["idx"].cast("string") == index["dataset_id"], "left").drop("dataset_id")
    return joined.withColumn("used_tools", used_tools("steps")).withColumn(
        "trace_text", F.when(F.col("task_id").isNull(), F.coalesce("response", F.lit("")))
    )


def with_tool_use(results: DataFrame, traces: DataFrame) -> DataFrame:
    """Results with ``used_tools`` of their first trace; only a flag per trace is shuffled."""
    flags = (
        traces.select(F.col("dataset_id").cast("string").alias("_key"), "task_id", used_tools("steps").alias("_u"))
        .where("_key <> ''").groupBy("_key").agg(F.min_by("_u", "task_id").alias("_used"))
    )
    joined = results.join(flags, results["idx"].cast("string") == flags["_key"], "left")
    return joined.withColumn("used_tools", F.coalesce("_used", F.lit(False))).drop("_key", "_used")


def with_trace_only(results: DataFrame, traces: DataFrame) -> DataFrame:
    """Results that have a trace."""
    keys = traces.select(F.col("dataset_id").cast("string").alias("_key")).where("_key <> ''").distinct()
    return results.join(keys, F.col("idx").cast("string") == F.col("_key"), "left_semi")


# ---- two runs ---------------------------------------------------------------


def _per_sample(run: DataFrame, position: str) -> DataFrame:
    return latest(run, ["idx"], F.col(position))


def join_runs(a: DataFrame, b: DataFrame, position: str = "src_pos") -> DataFrame:
    """One row per sample of both runs; columns of run b get the suffix ``_b``."""
    left, right = _per_sample(a, position), _per_sample(b, position)
    names = [c for c in right.columns if c != "idx"]
    return left.join(right.withColumnsRenamed({c: f"{c}_b" for c in names}), "idx")


def disagreements(a: DataFrame, b: DataFrame, position: str = "src_pos") -> DataFrame:
    """Samples on which the two runs differ in correctness, null-aware."""
    return join_runs(a, b, position).where(~F.col("is_correct").eqNullSafe(F.col("is_correct_b")))


def sample_mismatch(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sample ids in one run only, with the side they are in; empty when the runs match."""
    left, right = a.select("idx").distinct(), b.select("idx").distinct()
    return left.join(right, "idx", "left_anti").withColumn("only_in", F.lit("a")).unionByName(
        right.join(left, "idx", "left_anti").withColumn("only_in", F.lit("b"))
    )


def assert_same_samples(a: DataFrame, b: DataFrame) -> None:
    """Raise when the runs do not cover the same samples."""
    if sample_mismatch(a, b).limit(1).count():
        raise ValueError("the two runs do not cover the same samples")


def matched_count(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct samples of each run and of both."""
    sides = a.select("idx", F.lit(1).alias("s")).unionByName(b.select("idx", F.lit(2).alias("s")))
    per = sides.groupBy("idx").agg(F.bit_or("s").alias("m"))
    return per.agg(
        F.count_if(F.col("m").bitwiseAND(1) > 0).alias("samples_a"),
        F.count_if(F.col("m").bitwiseAND(2) > 0).alias("samples_b"),
        F.count_if(F.col("m") == 3).alias("matched"),
    )


def outcome_category(ok_a: Column, ok_b: Column) -> Column:
    return (
        F.when(ok_a & ok_b, "both_correct")
        .when(~ok_a & ~ok_b, "both_wrong")
        .when(~ok_a & ok_b, "only_a_wrong")
        .otherwise("only_b_wrong")
    )


def categorise(a: DataFrame, b: DataFrame, position: str = "src_pos") -> DataFrame:
    """Paired results (with ``used_tools`` on each side) and their outcome category."""
    return join_runs(a, b, position).withColumn(
        "category", outcome_category(is_correct("is_correct"), is_correct("is_correct_b"))
    )


def compare_runs(paired: DataFrame) -> DataFrame:
    """Samples and tool use per outcome category; all four categories are present."""
    tools_a, tools_b = F.col("used_tools"), F.col("used_tools_b")
    aggs = []
    for name in ("both_correct", "both_wrong", "only_a_wrong", "only_b_wrong"):
        here = F.col("category") == name
        aggs += [
            F.struct(
                F.lit(name).alias("category"),
                F.count_if(here).alias("total"),
                F.count_if(here & tools_a).alias("a_with_tools"),
                F.count_if(here & ~tools_a).alias("a_without_tools"),
                F.count_if(here & tools_b).alias("b_with_tools"),
                F.count_if(here & ~tools_b).alias("b_without_tools"),
            ).alias(name)
        ]
    one = paired.agg(*aggs)
    return one.select(F.explode(F.array(*one.columns)).alias("r")).select("r.*")


def comparison_totals(categories: DataFrame) -> DataFrame:
    return categories.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"))


def tool_usage_stats(results: DataFrame) -> DataFrame:
    """Correct and wrong results with and without tools; ``results`` has ``used_tools``."""
    ok, tools = is_correct(), F.col("used_tools")
    return results.agg(
        F.count_if(ok & tools).alias("correct_with_tools"),
        F.count_if(ok & ~tools).alias("correct_without_tools"),
        F.count_if(~ok & tools).alias("wrong_with_tools"),
        F.count_if(~ok & ~tools).alias("wrong_without_tools"),
    )


def accuracy_delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """Accuracy of b minus accuracy of a, both rounded first."""
    sides = eval_stats(a).withColumn("s", F.lit("a")).unionByName(eval_stats(b).withColumn("s", F.lit("b")))
    pick = lambda s: F.max(F.when(F.col("s") == s, F.col("accuracy")))
    return sides.agg(
        pick("a").alias("accuracy_a"), pick("b").alias("accuracy_b"),
        F.round(pick("b") - pick("a"), 4).alias("delta_accuracy"),
    )


# ---- error records and summaries --------------------------------------------


def to_error_records(analysed: DataFrame) -> DataFrame:
    """Error records from results with ``reply`` (model text) and ``failure`` (call error) columns."""
    body = extract_json_object("reply")
    failed = F.col("failure").isNotNull()
    return analysed.select(
        "idx", "dataset", "sub_task", "question", "image_paths", "ground_truth", "predicted",
        F.when(failed, F.array().cast("array<string>"))
        .otherwise(
            F.coalesce(
                F.from_json(F.get_json_object(body, "$.error_categories"), "array<string>"),
                F.array().cast("array<string>"),
            )
        ).alias("error_categories"),
        F.when(failed, F.concat(F.lit("FAILED: "), F.col("failure")))
        .otherwise(F.coalesce(F.get_json_object(body, "$.analysis"), F.lit(""))).alias("analysis"),
    )


def to_compare_records(analysed: DataFrame) -> DataFrame:
    """Comparison records from paired results with ``reply`` and ``failure`` columns."""
    body = extract_json_object("reply")
    failed = F.col("failure").isNotNull()
    text = lambda p: F.coalesce(F.get_json_object(body, p), F.lit(""))
    return analysed.select(
        "idx", "dataset", "sub_task", "question", "image_paths", "ground_truth",
        F.col("predicted").alias("direct_predicted"), is_correct("is_correct").alias("direct_is_correct"),
        F.col("predicted_b").alias("tool_predicted"), is_correct("is_correct_b").alias("tool_is_correct"),
        F.when(failed, "unknown").otherwise(text("$.correct_approach")).alias("correct_approach"),
        F.when(failed, F.concat(F.lit("FAILED: "), F.col("failure")))
        .otherwise(text("$.key_difference")).alias("key_difference"),
        F.when(failed, "").otherwise(text("$.explanation")).alias("explanation"),
    )


def sub_task_name(c: str = "sub_task") -> Column:
    return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("Unknown"))


def _times(category: str) -> Column:
    """How often a record names a category."""
    return F.size(F.filter("error_categories", lambda x: x == category))


def error_distribution(errors: DataFrame) -> DataFrame:
    """Count and share of errors per category; the six fixed categories, zeros included."""
    hits = [F.coalesce(F.sum(_times(c)), F.lit(0)).cast("long").alias(c) for c in ERROR_CATEGORIES]
    one = errors.agg(F.count(F.lit(1)).alias("n"), *hits)
    rows = F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("errors")) for c in ERROR_CATEGORIES])
    return one.select("n", F.explode(rows).alias("r")).select(
        "r.category", "r.errors",
        F.round(F.coalesce(F.try_divide(F.col("r.errors") * F.lit(100.0), F.col("n")), F.lit(0.0)), 1).alias("pct"),
    )


def error_distribution_by(errors: DataFrame, by: str = "sub_task") -> DataFrame:
    """``error_distribution`` per sub-task."""
    counts = [F.sum(_times(c)).cast("long").alias(c) for c in ERROR_CATEGORIES]
    per = errors.groupBy(sub_task_name(by).alias(by)).agg(F.count(F.lit(1)).alias("n"), *counts)
    rows = F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("errors")) for c in ERROR_CATEGORIES])
    return per.select(by, "n", F.explode(rows).alias("r")).select(
        by, "r.category", "r.errors",
        F.round(F.col("r.errors") * F.lit(100.0) / F.col("n"), 1).alias("pct"),
    )


def subtask_overview(errors: DataFrame, position: str = "src_pos", top: int = 3) -> DataFrame:
    """Errors per sub-task with its most frequent categories ``cat (n)``; ties go to the first seen.

    Counts are combined before the shuffle; what is ranked is one row per
    sub-task and category.
    """
    st = sub_task_name().alias("sub_task")
    totals = errors.groupBy(st).agg(F.count(F.lit(1)).alias("errors"))
    seen = errors.select(st, F.col(position).alias("p"), F.posexplode("error_categories").alias("i", "category"))
    counts = seen.groupBy("sub_task", "category").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("p", "i")).alias("first")
    )
    from pyspark.sql import Window

    w = Window.partitionBy("sub_task").orderBy(F.desc("n"), "first")
    best = (
        counts.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= top)
        .groupBy("sub_task")
        .agg(F.array_sort(F.collect_list(F.struct("rn", "category", "n"))).alias("top"))
    )
    text = F.array_join(
        F.transform("top", lambda t: F.concat(t["category"], F.lit(" ("), t["n"].cast("string"), F.lit(")"))), ", "
    )
    return totals.join(best, "sub_task", "left").select(
        "sub_task", "errors", F.coalesce(text, F.lit("")).alias("top_categories")
    )


def win_counts(records: DataFrame) -> DataFrame:
    """Direct and tool wins overall: each side counts its own correct answers."""
    return records.agg(
        F.count_if(F.coalesce(F.col("direct_is_correct"), F.lit(False))).alias("direct_wins"),
        F.count_if(F.coalesce(F.col("tool_is_correct"), F.lit(False))).alias("tool_wins"),
        F.count(F.lit(1)).alias("total"),
    )


def win_counts_by(records: DataFrame, by: str = "sub_task") -> DataFrame:
    """Wins per sub-task; a record without a direct win is a tool win."""
    direct = F.coalesce(F.col("direct_is_correct"), F.lit(False))
    return records.groupBy(sub_task_name(by).alias(by)).agg(
        F.count_if(direct).alias("direct_wins"), F.count_if(~direct).alias("tool_wins"),
        F.count(F.lit(1)).alias("total"),
    )

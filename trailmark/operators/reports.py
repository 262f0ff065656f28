"""Markdown reports as ordered line tables.

A report is a DataFrame of lines with a sort key, so cases of any number are
written by Spark (one sorted text table) and never gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.operators.compare import (
    error_distribution, error_distribution_by, sub_task_name, subtask_overview, win_counts, win_counts_by,
)
from trailmark.operators.skew import row_number, running
from trailmark.schemas import ERROR_CATEGORIES


def _percent(part: Column, whole: Column) -> Column:
    return F.format_string("%.1f%%", F.coalesce(F.try_divide(part * F.lit(100.0), whole), F.lit(0.0)))


def _lines(df: DataFrame, section: int, group: Column, sub: int, no: Column, lines: list[Column]) -> DataFrame:
    """Line rows of one report part: (section, sub_task, part, case, line, text)."""
    pairs = F.array(*lines)
    return df.select(
        F.lit(section).alias("section"), group.alias("sub_task"), F.lit(sub).alias("part"),
        no.cast("long").alias("case_no"), F.posexplode(pairs).alias("line", "text"),
    )


def number_cases(records: DataFrame, position: str = "src_pos") -> DataFrame:
    """Case number per sub-task in record order."""
    named = records.withColumn("_st", sub_task_name())
    return running(named, ["_st"], {"pos": F.col(position)}, {"case_no": row_number()})


def _order(lines: DataFrame) -> DataFrame:
    return lines.orderBy("section", "sub_task", "part", "case_no", "line")


def _has_sub_tasks(records: DataFrame) -> bool:
    """False when there are records and none names a sub-task: then the cases form one flat list."""
    named = sub_task_name() != "Unknown"
    return records.where(named).limit(1).count() > 0 or records.limit(1).count() == 0


def _case_mark(nested: bool) -> Column:
    return F.concat(
        F.lit("#### #" if nested else "### #"), F.col("case_no").cast("string"),
        F.lit(" [idx="), F.col("idx").cast("string"), F.lit("]"),
    )


def _category_rank() -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in ERROR_CATEGORIES]), F.col("category")).cast("long")


# The headings, table heads and line texts of both reports are fixed values.


def error_report(errors: DataFrame, total: int, generated: str = "") -> DataFrame:
    """Error report lines in order.

    The line ``Incorrect`` counts analysed records. ``errors`` has error records
    and ``src_pos``.
    """
    none, zero = F.lit(""), F.lit(0)
    nested = _has_sub_tasks(errors)
    n = errors.agg(F.count(F.lit(1)).alias("n"))
    head = _lines(n, 0, none, 0, zero, [
        F.lit("# Error Analysis Report\n"), F.lit("| Metric | Value |"), F.lit("|--------|-------|"),
        F.lit(f"| Total samples | {total} |"),
        F.concat(F.lit("| Incorrect | "), F.col("n").cast("string"),
                 F.concat(F.lit(" ("), _percent(F.col("n"), F.lit(total)), F.lit(")")) if total else none, F.lit(" |")),
        F.concat(F.lit("| Analyzed | "), F.col("n").cast("string"), F.lit(" |")),
        F.lit(f"| Generated | {generated} |"), none,
        F.lit("## Overall Error Category Distribution\n"), F.lit("| Category | Count | % of Errors |"),
        F.lit("|----------|-------|-------------|"),
    ])
    row = F.concat(F.lit("| "), F.col("category"), F.lit(" | "), F.col("errors").cast("string"), F.lit(" | "),
                   F.format_string("%.1f%%", "pct"), F.lit(" |"))
    table = _lines(error_distribution(errors), 1, none, 0, _category_rank(), [row])
    note = _lines(n, 2, none, 0, zero, [none, F.lit("> Percentages may sum to >100% due to multi-label annotation."), none])
    over_head = _lines(n, 3, none, 0, zero, [
        F.lit("## Sub-task Overview\n"), F.lit("| Sub-task | Errors | Top Categories |"),
        F.lit("|----------|--------|----------------|"),
    ])
    overview = subtask_overview(errors)
    over = _lines(overview, 4, F.col("sub_task"), 0, zero, [
        F.concat(F.lit("| "), F.col("sub_task"), F.lit(" | "), F.col("errors").cast("string"), F.lit(" | "),
                 F.col("top_categories"), F.lit(" |")),
    ])
    gap = _lines(n, 5, none, 0, zero, [none])
    sec_head = _lines(overview, 6, F.col("sub_task"), 0, zero, [
        F.concat(F.lit("## Sub-task: "), F.col("sub_task"), F.lit(" ("), F.col("errors").cast("string"), F.lit(" errors)\n")),
        F.lit("| Category | Count | % of Errors |"), F.lit("|----------|-------|-------------|"),
    ])
    sec_table = _lines(error_distribution_by(errors), 6, F.col("sub_task"), 1, _category_rank(), [row])
    sec_cases = _lines(overview, 6, F.col("sub_task"), 2, zero, [none, F.lit("### Cases\n")])
    cats = F.coalesce(F.nullif(F.array_join("error_categories", ", "), none), F.lit("N/A"))
    cases = _lines(number_cases(errors), 6, F.col("_st"), 3, F.col("case_no"), [
        _case_mark(nested),
        F.concat(F.lit("- **Question**: "), F.col("question")),
        F.concat(F.lit("- **Images**: "), F.array_join("image_paths", ", ")),
        F.concat(F.lit("- **Ground Truth**: "), F.col("ground_truth"), F.lit(" | **Predicted**: "), F.col("predicted")),
        F.concat(F.lit("- **Categories**: "), cats),
        F.concat(F.lit("- **Analysis**: "), F.col("analysis")),
        none,
    ])
    flat_head = _lines(n, 5, none, 0, zero, [F.lit("## Case Details\n")])
    sections = [over_head, over, gap, sec_head, sec_table, sec_cases] if nested else [flat_head]
    parts = [table, note, *sections, cases]
    out = head
    for p in parts:
        out = out.unionByName(p)
    return _order(out)


def comparison_report(records: DataFrame, total: int, generated: str = "") -> DataFrame:
    """Comparison report lines in order; ``records`` has compare records and ``src_pos``."""
    none, zero = F.lit(""), F.lit(0)
    nested = _has_sub_tasks(records)
    wins = win_counts(records)
    text = lambda c: F.col(c).cast("string")
    head = _lines(wins, 0, none, 0, zero, [
        F.lit("# Comparison Analysis Report\n"), F.lit("| Metric | Value |"), F.lit("|--------|-------|"),
        F.lit(f"| Total samples | {total} |"),
        F.concat(F.lit("| Disagreements | "), text("total"),
                 F.concat(F.lit(" ("), _percent(F.col("total"), F.lit(total)), F.lit(")")) if total else none, F.lit(" |")),
        F.concat(F.lit("| Direct wins | "), text("direct_wins"), F.lit(" |")),
        F.concat(F.lit("| Tool wins | "), text("tool_wins"), F.lit(" |")),
        F.lit(f"| Generated | {generated} |"), none,
        *([
            F.lit("## Sub-task Overview\n"), F.lit("| Sub-task | Direct Wins | Tool Wins | Total |"),
            F.lit("|----------|-------------|-----------|-------|"),
        ] if nested else [F.lit("## Case Details\n")]),
    ])
    by = win_counts_by(records)
    over = _lines(by, 1, F.col("sub_task"), 0, zero, [
        F.concat(F.lit("| "), F.col("sub_task"), F.lit(" | "), text("direct_wins"), F.lit(" | "), text("tool_wins"),
                 F.lit(" | "), text("total"), F.lit(" |")),
    ])
    gap = _lines(wins, 2, none, 0, zero, [none])
    sec = _lines(by, 3, F.col("sub_task"), 0, zero, [
        F.concat(F.lit("## Sub-task: "), F.col("sub_task"), F.lit(" (Direct "), text("direct_wins"), F.lit(", Tool "),
                 text("tool_wins"), F.lit(", Total "), text("total"), F.lit(")\n")),
        F.lit("### Cases\n"),
    ])
    verdict = lambda c: F.when(F.col(c), "correct").otherwise("wrong")
    cases = _lines(number_cases(records), 3, F.col("_st"), 1, F.col("case_no"), [
        F.concat(_case_mark(nested), F.lit(" — "),
                 F.when(F.col("direct_is_correct"), "Direct").otherwise("Tool"), F.lit(" wins")),
        F.concat(F.lit("- **Question**: "), F.col("question")),
        F.concat(F.lit("- **Images**: "), F.array_join("image_paths", ", ")),
        F.concat(F.lit("- **Ground Truth**: "), F.col("ground_truth")),
        F.concat(F.lit("- **Direct**: "), F.col("direct_predicted"), F.lit(" ("), verdict("direct_is_correct"), F.lit(")")),
        F.concat(F.lit("- **Tool**: "), F.col("tool_predicted"), F.lit(" ("), verdict("tool_is_correct"), F.lit(")")),
        F.concat(F.lit("- **Key Difference**: "), F.col("key_difference")),
        F.concat(F.lit("- **Explanation**: "), F.col("explanation")),
        none,
    ])
    out = head.unionByName(over).unionByName(gap).unionByName(sec) if nested else head
    return _order(out.unionByName(cases))


def write_report(lines: DataFrame, path: str) -> None:
    """Write the ordered lines as text files; file order is line order."""
    lines.select("text").write.mode("overwrite").text(path)

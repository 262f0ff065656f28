"""Joins of runs and traces, comparisons and error summaries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trailmark.operators import compare as C
from trailmark.operators import reports
from trailmark.plans import bindings as B
from trailmark.plans.registry import QUERIES, query
from trailmark.session import checkpoint_dir
from trailmark.sources.versions import publish, read_version


def _union(df):
    """Every result twice, at two source positions, so that the last one decides."""
    early = df.withColumn("src_pos", F.col("src_pos") * 2).withColumn("ground_truth", F.lit("early"))
    late = df.withColumn("src_pos", F.col("src_pos") * 2 + 1).withColumn(
        "ground_truth", F.when(F.col("is_correct"), F.col("ground_truth")).otherwise("")
    )
    return early.unionByName(late)


B.cte("found", "SELECT idx, CASE WHEN is_correct THEN ground_truth ELSE 'early' END AS gt FROM run_b", ("run_b",))


@query("backfill_ground_truth", B.sql("traces", "found", body="""
SELECT t.task_id, coalesce(t.ground_truth, f.gt) AS ground_truth, CASE WHEN t.ground_truth IS NOT NULL THEN 'skipped'
  WHEN f.gt IS NOT NULL THEN 'updated' ELSE 'unmatched' END AS backfill
FROM traces t LEFT JOIN found f ON t.dataset_id = f.idx::VARCHAR"""))
def backfill_ground_truth(spark, d):
    out = C.backfill_ground_truth(B.traces(spark, d), _union(B.runs(spark, d)[1]))
    return out.select("task_id", "ground_truth", "backfill")


@query("backfill_report", B.sql("traces", "found", body="""
SELECT count(*) FILTER (t.ground_truth IS NULL AND f.gt IS NOT NULL) AS updated, count(*) FILTER (t.ground_truth IS NOT NULL) AS skipped
FROM traces t LEFT JOIN found f ON t.dataset_id = f.idx::VARCHAR"""))
def backfill_report(spark, d):
    return C.backfill_report(C.backfill_ground_truth(B.traces(spark, d), _union(B.runs(spark, d)[1])))


@query("apply_outcomes", B.sql("traces", "run_b", body="""
SELECT t.task_id, coalesce(coalesce(r.is_correct, t.is_correct)::VARCHAR, 'missing') AS is_correct,
  coalesce(CASE WHEN r.is_correct THEN r.ground_truth END, t.ground_truth) AS ground_truth
FROM traces t LEFT JOIN run_b r ON t.dataset_id = r.idx::VARCHAR"""))
def apply_outcomes(spark, d):
    out = C.apply_outcomes(B.traces(spark, d), _union(B.runs(spark, d)[1]))
    ok = F.coalesce(F.col("is_correct").cast("string"), F.lit("missing"))
    return out.select("task_id", ok.alias("is_correct"), "ground_truth")


@query("attach_annotations", B.sql("event_entries", body="""
SELECT e.task_id, e.event_id, e.state_index, coalesce(a.q, 5)::BIGINT AS q_value, coalesce(a.x, '') AS experience
FROM event_entries e LEFT JOIN (
  SELECT user_id, label_state, arg_max(q, event_id) AS q, arg_max(x, event_id) AS x FROM (
    SELECT user_id, event_id, event_id % 40 AS label_state, (floor(value)::BIGINT % 11)::INT AS q, props AS x FROM events) GROUP BY 1, 2
) a ON e.task_id = a.user_id AND e.state_index = a.label_state"""))
def attach_annotations(spark, d):
    from trailmark.operators.trajectories import step_trajectory

    states = step_trajectory(B.step_events(spark, d), axes=B.micros())
    notes = B.table(spark, d, "events").select(
        F.col("user_id").alias("task_id"), (F.col("event_id") % 40).cast("int").alias("state_index"),
        (F.floor("value") % 11).cast("int").alias("q_value"), F.col("props").alias("experience"),
        F.col("event_id").alias("ann_pos"),
    )
    return C.attach_annotations(states, notes).select("task_id", "event_id", "state_index", "q_value", "experience")


@query("join_runs", B.sql("run_a", "run_b", body="""
SELECT a.idx, a.ground_truth, a.sub_task, a.dataset, a.predicted, a.is_correct, b.predicted AS predicted_b, b.is_correct AS is_correct_b
FROM run_a a JOIN run_b b ON a.idx = b.idx"""))
def join_runs(spark, d):
    return C.join_runs(*B.runs(spark, d)).select(
        "idx", "ground_truth", "sub_task", "dataset", "predicted", "is_correct", "predicted_b", "is_correct_b"
    )


@query("disagreements", B.sql("run_a", "run_b", body="""
SELECT a.idx, a.is_correct, b.is_correct AS is_correct_b FROM run_a a JOIN run_b b ON a.idx = b.idx WHERE a.is_correct <> b.is_correct"""))
def disagreements(spark, d):
    return C.disagreements(*B.runs(spark, d)).select("idx", "is_correct", "is_correct_b")




@query("sample_mismatch", """
SELECT doc_id AS idx, 'a' AS only_in FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 'b' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def sample_mismatch(spark, d):
    ids = lambda t: B.table(spark, d, t).select(F.col("doc_id").alias("idx"))
    return C.sample_mismatch(ids("documents"), ids("labels"))


@query("matched_count", """
SELECT (SELECT count(DISTINCT doc_id) FROM documents) AS samples_a, (SELECT count(DISTINCT doc_id) FROM labels) AS samples_b,
  (SELECT count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)) AS matched""")
def matched_count(spark, d):
    ids = lambda t: B.table(spark, d, t).select(F.col("doc_id").alias("idx"))
    return C.matched_count(ids("documents"), ids("labels"))


@query("attach_traces", B.sql("run_a", "used", "traces", body="""
SELECT r.idx, t.task_id, coalesce(u.used_tools, false) AS used_tools FROM run_a r
LEFT JOIN traces t ON r.idx::VARCHAR = t.dataset_id LEFT JOIN used u ON t.doc_id = u.doc_id"""))
def attach_traces(spark, d):
    return C.attach_traces(B.runs(spark, d)[0], B.traces(spark, d)).select("idx", "task_id", "used_tools")


@query("with_trace_only", B.sql("run_a", "traces", body="SELECT idx FROM run_a WHERE idx::VARCHAR IN (SELECT dataset_id FROM traces WHERE len(lines) > 0)"))
def with_trace_only(spark, d):
    return C.with_trace_only(B.runs(spark, d)[0], B.traces(spark, d)).select("idx")


_USED_A = "run_a a JOIN used u ON a.idx = u.doc_id"


@query("tool_usage_stats", B.sql("run_a", "used", body=f"""
SELECT count(*) FILTER (is_correct AND used_tools) AS correct_with_tools, count(*) FILTER (is_correct AND NOT used_tools) AS correct_without_tools,
  count(*) FILTER (NOT is_correct AND used_tools) AS wrong_with_tools, count(*) FILTER (NOT is_correct AND NOT used_tools) AS wrong_without_tools
FROM {_USED_A}"""))
def tool_usage_stats(spark, d):
    return C.tool_usage_stats(C.with_tool_use(B.runs(spark, d)[0], B.traces(spark, d)))


def _paired(spark, d):
    a, b = B.runs(spark, d)
    tool = C.with_tool_use(a.select("idx", "src_pos", "is_correct", "sub_task"), B.traces(spark, d))
    # run b left its traces one sample earlier, the last sample has none
    traces_b = B.traces(spark, d).withColumn("dataset_id", (F.col("doc_id") - 1).cast("string"))
    return C.categorise(tool, C.with_tool_use(b.select("idx", "src_pos", "is_correct"), traces_b))


_COMPARED = """
SELECT c.category, count(p.idx) AS total, count(*) FILTER (used_tools) AS a_with_tools, count(*) FILTER (NOT used_tools) AS a_without_tools,
  count(*) FILTER (b_used) AS b_with_tools, count(*) FILTER (NOT b_used) AS b_without_tools
FROM (VALUES ('both_correct'), ('both_wrong'), ('only_a_wrong'), ('only_b_wrong')) c(category) LEFT JOIN (
  SELECT a.idx, u.used_tools, coalesce(v.used_tools, false) AS b_used, CASE WHEN a.is_correct AND b.is_correct THEN 'both_correct' WHEN NOT a.is_correct AND NOT b.is_correct THEN 'both_wrong'
    WHEN b.is_correct THEN 'only_a_wrong' ELSE 'only_b_wrong' END AS category
  FROM run_a a JOIN run_b b ON a.idx = b.idx JOIN used u ON a.idx = u.doc_id LEFT JOIN used v ON v.doc_id = a.idx + 1) p ON c.category = p.category GROUP BY 1"""


@query("compare_runs", B.sql("run_a", "run_b", "used", body=_COMPARED))
def compare_runs(spark, d):
    return C.compare_runs(_paired(spark, d))


@query("comparison_totals", B.sql("run_a", "run_b", "used", body=f"SELECT sum(total)::BIGINT AS total FROM ({_COMPARED})"))
def comparison_totals(spark, d):
    return C.comparison_totals(C.compare_runs(_paired(spark, d)))


@query("accuracy_delta", """
SELECT round(a, 4) AS accuracy_a, round(b, 4) AS accuracy_b, round(round(b, 4) - round(a, 4), 4) AS delta_accuracy FROM (
  SELECT count(*) FILTER (quality = 1) / count(*) AS a, count(*) FILTER (toxic = 0) / count(*) AS b FROM labels)""")
def accuracy_delta(spark, d):
    return C.accuracy_delta(*B.runs(spark, d))


@query("error_distribution", B.sql("errors", body=f"""
SELECT c.category, count(e.idx) AS errors, round(count(e.idx) * 100.0 / (SELECT count(*) FROM errors), 1)::DOUBLE AS pct
FROM (SELECT unnest({B.CATEGORIES_SQL}) AS category) c LEFT JOIN (SELECT idx, unnest(cats) AS category FROM errors) e ON c.category = e.category GROUP BY 1"""))
def error_distribution(spark, d):
    return C.error_distribution(B.errors(spark, d))


@query("error_distribution_by_sub_task", B.sql("errors", body=f"""
SELECT s.st AS sub_task, c.category, count(e.idx) AS errors, round(count(e.idx) * 100.0 / any_value(s.n), 1)::DOUBLE AS pct
FROM (SELECT st, count(*) AS n FROM errors GROUP BY st) s, (SELECT unnest({B.CATEGORIES_SQL}) AS category) c
LEFT JOIN (SELECT idx, st, unnest(cats) AS category FROM errors) e ON c.category = e.category AND e.st = s.st GROUP BY 1, 2"""))
def error_distribution_by_sub_task(spark, d):
    return C.error_distribution_by(B.errors(spark, d))


@query("subtask_overview", B.sql("errors", body="""
SELECT t.st AS sub_task, t.errors, coalesce(o.top, '') AS top_categories FROM (SELECT st, count(*) AS errors FROM errors GROUP BY st) t LEFT JOIN (
  SELECT st, string_agg(category || ' (' || n || ')', ', ' ORDER BY rn) AS top FROM (
    SELECT st, category, n, row_number() OVER (PARTITION BY st ORDER BY n DESC, first_idx, first_i) AS rn FROM (
      SELECT st, category, count(*) AS n, min(idx) AS first_idx, arg_min(i, idx) AS first_i FROM (
        SELECT st, idx, unnest(cats) AS category, generate_subscripts(cats, 1) AS i FROM errors) GROUP BY 1, 2)) WHERE rn <= 3 GROUP BY st) o ON t.st = o.st"""))
def subtask_overview(spark, d):
    return C.subtask_overview(B.errors(spark, d))


def _records(spark, d):
    """Comparison records of all disagreements with a model reply derived from the row."""
    pairs = C.disagreements(*B.runs(spark, d))
    reply = F.concat(
        F.lit('Here: ```json\n{"correct_approach": "'), F.when(F.col("is_correct"), "direct").otherwise("tool"),
        F.lit('", "key_difference": "row '), F.col("idx").cast("string"), F.lit('"}\n```'),
    )
    # src_pos rides along as the last path so that the record keeps it.
    pos = F.col("src_pos").cast("string")
    analysed = pairs.withColumn("image_paths", F.array(pos)).withColumn("reply", reply).withColumn(
        "failure", F.when(F.col("idx") % 7 == 0, "timeout")
    )
    return C.to_compare_records(analysed).withColumn("src_pos", F.element_at("image_paths", -1).cast("long"))


B.cte("records", """
SELECT a.idx, CASE WHEN a.sub_task = '' THEN 'Unknown' ELSE a.sub_task END AS st, a.is_correct AS direct_is_correct, b.is_correct AS tool_is_correct,
  CASE WHEN a.idx % 7 = 0 THEN 'unknown' WHEN a.is_correct THEN 'direct' ELSE 'tool' END AS correct_approach,
  CASE WHEN a.idx % 7 = 0 THEN 'FAILED: timeout' ELSE 'row ' || a.idx END AS key_difference
FROM run_a a JOIN run_b b ON a.idx = b.idx WHERE a.is_correct <> b.is_correct""", ("run_a", "run_b"))


@query("to_compare_records", B.sql("records", body="""
SELECT idx, direct_is_correct, tool_is_correct, correct_approach, key_difference, '' AS explanation FROM records"""))
def to_compare_records(spark, d):
    return _records(spark, d).select(
        "idx", "direct_is_correct", "tool_is_correct", "correct_approach", "key_difference", "explanation"
    )


@query("to_error_records", B.sql("errors", body="""
SELECT idx, CASE WHEN idx % 5 = 0 THEN '' ELSE array_to_string(cats, ',') END AS categories,
  CASE WHEN idx % 5 = 0 THEN 'FAILED: timeout' ELSE 'analysis of ' || idx END AS analysis FROM errors"""))
def to_error_records(spark, d):
    e = B.errors(spark, d).withColumn(
        "reply", F.concat(F.lit("Sure. "), F.to_json(F.struct("error_categories", "analysis")), F.lit(" done"))
    ).withColumn("failure", F.when(F.col("idx") % 5 == 0, "timeout"))
    r = C.to_error_records(e)
    return r.select("idx", F.array_join("error_categories", ",").alias("categories"), "analysis")


@query("win_counts", B.sql("records", body="""
SELECT count(*) FILTER (direct_is_correct) AS direct_wins, count(*) FILTER (tool_is_correct) AS tool_wins, count(*) AS total FROM records"""))
def win_counts(spark, d):
    return C.win_counts(_records(spark, d))


@query("win_counts_by_sub_task", B.sql("records", body="""
SELECT st AS sub_task, count(*) FILTER (direct_is_correct) AS direct_wins, count(*) FILTER (NOT direct_is_correct) AS tool_wins, count(*) AS total
FROM records GROUP BY st"""))
def win_counts_by_sub_task(spark, d):
    return C.win_counts_by(_records(spark, d))


@query("case_numbers", B.sql("errors", body="SELECT st AS sub_task, idx, row_number() OVER (PARTITION BY st ORDER BY idx) AS case_no FROM errors"))
def case_numbers(spark, d):
    return reports.number_cases(B.errors(spark, d)).select(F.col("_st").alias("sub_task"), "idx", "case_no")


def _listed(section: int, lines: list[str], sub_task: str = "''", part: int = 0, case_no: str = "0", source: str = "(SELECT 1)") -> str:
    """SQL of report lines: one list of texts per row of ``source``."""
    items = ", ".join(lines)
    return f"""SELECT {section}::BIGINT AS section, {sub_task} AS sub_task, {part}::BIGINT AS part, ({case_no})::BIGINT AS case_no,
  unnest(range({len(lines)}))::BIGINT AS line, unnest([{items}]) AS text FROM {source}"""


def _share(part: str) -> str:
    return f"printf('%.1f%%', round({part} * 100.0 / (SELECT count(*) FROM labels), 1))"


_NL = "chr(10)"
_RANK = f"list_position({B.CATEGORIES_SQL}, category)"
_ROW = "'| ' || category || ' | ' || errors || ' | ' || printf('%.1f%%', pct) || ' |'"
_CATEGORY_HEAD = ["'| Category | Count | % of Errors |'", "'|----------|-------|-------------|'"]
_ERROR_LINES = " UNION ALL ".join([
    _listed(0, [
        f"'# Error Analysis Report' || {_NL}", "'| Metric | Value |'", "'|--------|-------|'",
        "'| Total samples | ' || (SELECT count(*) FROM labels) || ' |'", f"'| Incorrect | ' || n || ' (' || {_share('n')} || ') |'",
        "'| Analyzed | ' || n || ' |'", "'| Generated |  |'", "''", f"'## Overall Error Category Distribution' || {_NL}", *_CATEGORY_HEAD,
    ], source="(SELECT count(*) AS n FROM errors)"),
    _listed(1, [_ROW], case_no=_RANK, source=f"({QUERIES['error_distribution'].sql})"),
    _listed(2, ["''", "'> Percentages may sum to >100% due to multi-label annotation.'", "''"]),
    _listed(3, [f"'## Sub-task Overview' || {_NL}", "'| Sub-task | Errors | Top Categories |'", "'|----------|--------|----------------|'"]),
    _listed(4, ["'| ' || sub_task || ' | ' || errors || ' | ' || top_categories || ' |'"], "sub_task", source=f"({QUERIES['subtask_overview'].sql})"),
    _listed(5, ["''"]),
    _listed(6, [f"'## Sub-task: ' || st || ' (' || n || ' errors)' || {_NL}", *_CATEGORY_HEAD], "st", source="(SELECT st, count(*) AS n FROM errors GROUP BY st)"),
    _listed(6, [_ROW], "sub_task", 1, _RANK, f"({QUERIES['error_distribution_by_sub_task'].sql})"),
    _listed(6, ["''", f"'### Cases' || {_NL}"], "st", 2, source="(SELECT DISTINCT st FROM errors)"),
    _listed(6, [
        "'#### #' || no || ' [idx=' || idx || ']'", "'- **Question**: ' || text", "'- **Images**: img/' || idx || '.png'",
        "'- **Ground Truth**: ' || ground_truth || ' | **Predicted**: ' || predicted",
        "'- **Categories**: ' || CASE WHEN len(cats) = 0 THEN 'N/A' ELSE array_to_string(cats, ', ') END", "'- **Analysis**: analysis of ' || idx", "''",
    ], "st", 3, "no", "(SELECT e.*, d.text, row_number() OVER (PARTITION BY st ORDER BY idx) AS no FROM errors e JOIN documents d ON d.doc_id = e.idx)"),
])
_WINS = "count(*) FILTER (direct_is_correct) AS direct, count(*) FILTER (NOT direct_is_correct) AS tool, count(*) AS n"
_COMPARISON_LINES = " UNION ALL ".join([
    _listed(0, [
        f"'# Comparison Analysis Report' || {_NL}", "'| Metric | Value |'", "'|--------|-------|'",
        "'| Total samples | ' || (SELECT count(*) FROM labels) || ' |'", f"'| Disagreements | ' || n || ' (' || {_share('n')} || ') |'",
        "'| Direct wins | ' || direct || ' |'", "'| Tool wins | ' || tool || ' |'", "'| Generated |  |'", "''", f"'## Sub-task Overview' || {_NL}",
        "'| Sub-task | Direct Wins | Tool Wins | Total |'", "'|----------|-------------|-----------|-------|'",
    ], source=f"(SELECT {_WINS} FROM records)"),
    _listed(1, ["'| ' || st || ' | ' || direct || ' | ' || tool || ' | ' || n || ' |'"], "st", source=f"(SELECT st, {_WINS} FROM records GROUP BY st)"),
    _listed(2, ["''"]),
    _listed(3, [f"'## Sub-task: ' || st || ' (Direct ' || direct || ', Tool ' || tool || ', Total ' || n || ')' || {_NL}", f"'### Cases' || {_NL}"],
            "st", source=f"(SELECT st, {_WINS} FROM records GROUP BY st)"),
    _listed(3, [
        "'#### #' || no || ' [idx=' || idx || '] — ' || CASE WHEN direct_is_correct THEN 'Direct' ELSE 'Tool' END || ' wins'",
        "'- **Question**: ' || text", "'- **Images**: ' || idx", "'- **Ground Truth**: ' || ground_truth",
        "'- **Direct**: ' || direct_said || CASE WHEN direct_is_correct THEN ' (correct)' ELSE ' (wrong)' END",
        "'- **Tool**: ' || tool_said || CASE WHEN tool_is_correct THEN ' (correct)' ELSE ' (wrong)' END",
        "'- **Key Difference**: ' || key_difference", "'- **Explanation**: '", "''",
    ], "st", 1, "no", """(SELECT r.*, d.text, a.ground_truth, a.predicted AS direct_said, b.predicted AS tool_said,
    row_number() OVER (PARTITION BY st ORDER BY r.idx) AS no
  FROM records r JOIN run_a a ON a.idx = r.idx JOIN run_b b ON b.idx = r.idx JOIN documents d ON d.doc_id = r.idx)"""),
])


@query("error_report", B.sql("errors", body=_ERROR_LINES))
def error_report(spark, d):
    return reports.error_report(B.errors(spark, d), B.table(spark, d, "labels").count())


@query("comparison_report", B.sql("records", body=_COMPARISON_LINES))
def comparison_report(spark, d):
    return reports.comparison_report(_records(spark, d), B.table(spark, d, "labels").count())


@query("outcome_versions", B.sql("traces", "run_b", body="""
SELECT task_id, before, after, coalesce(before, 'missing') <> coalesce(after, 'missing') AS changed FROM (
  SELECT t.task_id, t.is_correct::VARCHAR AS before, coalesce(r.is_correct, t.is_correct)::VARCHAR AS after
  FROM traces t LEFT JOIN run_b r ON t.dataset_id = r.idx::VARCHAR)"""))
def outcome_versions(spark, d):
    """Outcomes written back as the second version of a stored table; both versions are read and compared."""
    path = f"{checkpoint_dir(spark)}/traces-{uuid.uuid4().hex}"
    publish(B.traces(spark, d).select("task_id", "dataset_id", "is_correct", "ground_truth"), path, note="as recorded")
    publish(C.apply_outcomes(read_version(spark, path, 1), _union(B.runs(spark, d)[1])), path, base=1, note="outcomes of run b")
    before = read_version(spark, path, 1).select("task_id", F.col("is_correct").cast("string").alias("before"))
    after = read_version(spark, path).select("task_id", F.col("is_correct").cast("string").alias("after"))
    return before.join(after, "task_id").withColumn("changed", ~F.col("before").eqNullSafe(F.col("after")))


@query("error_report_cases", B.sql("errors", body="""
SELECT st AS sub_task, case_no, line::BIGINT AS line, text FROM (SELECT *, row_number() OVER (PARTITION BY st ORDER BY idx) AS case_no FROM errors),
  LATERAL (SELECT unnest(['#### #' || case_no || ' [idx=' || idx || ']', '- **Ground Truth**: ' || ground_truth || ' | **Predicted**: ' || predicted,
      '- **Categories**: ' || CASE WHEN len(cats) = 0 THEN 'N/A' ELSE array_to_string(cats, ', ') END]) AS text, unnest([0, 3, 4]) AS line)"""))
def error_report_cases(spark, d):
    lines = reports.error_report(B.errors(spark, d), B.table(spark, d, "labels").count())
    return lines.where((F.col("section") == 6) & (F.col("part") == 3) & F.col("line").isin(0, 3, 4)).select(
        "sub_task", "case_no", "line", "text"
    )

"""Queries, answers, scores and accuracy."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.functions import text as X
from trailmark.operators import filters, sampling, scoring, skew
from trailmark.plans import bindings as B
from trailmark.plans.registry import query
from trailmark.schemas import INSTRUCTIONS

_EN = INSTRUCTIONS["multi-choice"]["en"].format(token="\nAnswer:").replace("'", "''").replace("\n", "' || chr(10) || '")
_OPEN = INSTRUCTIONS["open-ended"]["en"].format(token="\nAnswer:").replace("'", "''").replace("\n", "' || chr(10) || '")
_ZH = INSTRUCTIONS["yes-no"]["zh"].format(token="\nAnswer:").replace("'", "''").replace("\n", "' || chr(10) || '")

_OPTIONS = "list_transform(choices, lambda c, i: '(' || chr((64 + i)::INT) || ') ' || c)"
_QUERY = f"""{B.strip_sql("CASE WHEN prompt <> '' THEN prompt ELSE question END")}
  || CASE WHEN prompt = '' THEN chr(10) || chr(10) || array_to_string({_OPTIONS}, chr(10)) ELSE '' END
  || chr(10) || chr(10) || CASE type WHEN 'multi-choice' THEN '{_EN}' ELSE '{_OPEN}' END"""
B.cte("queried", f"SELECT *, {_QUERY} AS query FROM answered", ("answered",))


@query("make_options", B.sql("samples", body=f"""
SELECT idx, array_to_string({_OPTIONS}, ' ') AS letters,
  array_to_string(list_transform(choices, lambda c, i: '(' || i || ') ' || c), ' ') AS numbers FROM samples"""))
def make_options(spark, d):
    return B.samples(spark, d).select(
        "idx", F.array_join(X.make_options("choices"), " ").alias("letters"),
        F.array_join(X.make_options("choices", "numeric"), " ").alias("numbers"),
    )


@query("build_query", B.sql("queried", body="SELECT idx, length(query) AS n_chars, md5(query) AS digest FROM queried"))
def build_query(spark, d):
    q = scoring.with_query(B.samples(spark, d))
    return q.select("idx", F.length("query").cast("long").alias("n_chars"), F.md5("query").alias("digest"))


@query("task_instruction", B.sql("samples", body=f"""
SELECT idx, CASE type WHEN 'multi-choice' THEN '{_EN}' WHEN 'open-ended' THEN '{_OPEN}' ELSE '' END AS instruction,
  '{_ZH}' AS instruction_zh FROM samples"""))
def task_instruction(spark, d):
    return B.samples(spark, d).select(
        "idx", X.task_instruction("type").alias("instruction"),
        X.task_instruction(F.lit("yes-no"), zh=True).alias("instruction_zh"),
    )


@query("extract_answer", B.sql("predicted", body="SELECT idx, predicted FROM predicted"))
def extract_answer(spark, d):
    return B.answered(spark, d).select("idx", X.extract_answer("response").alias("predicted"))


@query("match_choice", B.sql("matched", body="SELECT idx, matched FROM matched"))
def match_choice(spark, d):
    p = B.answered(spark, d).withColumn("predicted", X.extract_answer("response"))
    return p.select("idx", X.match_choice("predicted", "choices").alias("matched"))


@query("match_choice_numeric", """
SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 12 THEN 'option ' || (p_size - 1) ELSE NULL END AS matched FROM part""")
def match_choice_numeric(spark, d):
    choices = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.concat(F.lit("option "), i.cast("string")))
    said = F.concat(F.lit("("), F.col("p_size").cast("string"), F.lit(") it is"))
    return B.table(spark, d, "part").select(
        "p_partkey", X.match_choice(said, choices, "numeric").alias("matched")
    )


@query("score_answer", B.sql("results", body="SELECT idx, is_correct, error FROM results"))
def score_answer(spark, d):
    p = B.answered(spark, d).withColumn("predicted", X.extract_answer("response"))
    return p.select(
        "idx", X.is_answer_correct("predicted", "answer", "type", "choices").alias("is_correct"),
        X.scoring_error("predicted", "type").alias("error"),
    )


@query("to_results", B.sql("results", "queried", body="""
SELECT r.idx, r.answer AS ground_truth, CASE WHEN r.error IS NULL THEN r.predicted ELSE '' END AS predicted, r.is_correct,
  md5(CASE WHEN r.error IS NULL THEN q.query ELSE '' END) AS query_digest,
  md5(CASE WHEN r.error IS NULL THEN r.response ELSE '' END) AS response_digest,
  r.type, coalesce(r.sub_task, '') AS sub_task, r.error
FROM results r JOIN queried q ON r.idx = q.idx"""))
def to_results(spark, d):
    return scoring.to_results(B.answered(spark, d)).select(
        "idx", "ground_truth", "predicted", "is_correct", F.md5("query").alias("query_digest"),
        F.md5("response").alias("response_digest"), "type", "sub_task", "error",
    )


_ACC = "round(count(*) FILTER (is_correct) / count(*), 4)"


@query("eval_stats", B.sql("results", body=f"""
SELECT count(*) AS total, count(*) FILTER (is_correct) AS correct, {_ACC} AS accuracy FROM results"""))
def eval_stats(spark, d):
    return scoring.eval_stats(scoring.to_results(B.answered(spark, d)))


@query("accuracy_by_type", B.sql("results", body=f"""
SELECT type, count(*) AS total, count(*) FILTER (is_correct) AS correct, {_ACC} AS accuracy FROM results GROUP BY type"""))
def accuracy_by_type(spark, d):
    a = B.answered(spark, d)
    return scoring.stats_by(a, scoring.to_results(a), "type")


@query("accuracy_by_sub_task", B.sql("results", body=f"""
SELECT coalesce(sub_task, 'unknown') AS sub_task, count(*) AS total, count(*) FILTER (is_correct) AS correct,
  {_ACC} AS accuracy FROM results GROUP BY 1"""))
def accuracy_by_sub_task(spark, d):
    a = B.answered(spark, d)
    return scoring.stats_by(a, scoring.to_results(a), "sub_task")


@query("run_stats", B.sql("results", body=f"""
SELECT level, name, total, correct, accuracy FROM (
  SELECT 'all' AS level, '' AS name, count(*) AS total, count(*) FILTER (is_correct) AS correct, {_ACC} AS accuracy FROM results
  UNION ALL SELECT 'type', type, count(*), count(*) FILTER (is_correct), {_ACC} FROM results GROUP BY type
  UNION ALL SELECT 'sub_task', coalesce(sub_task, 'unknown'), count(*), count(*) FILTER (is_correct), {_ACC} FROM results GROUP BY 2)"""))
def run_stats(spark, d):
    a = B.answered(spark, d)
    return scoring.run_stats(a, scoring.to_results(a))


@query("results_with_samples", B.sql("run_a", "samples", body="""
SELECT r.idx, r.is_correct, s.type, s.sub_task, s.src_pos FROM run_a r JOIN samples s ON r.idx = s.idx"""))
def results_with_samples(spark, d):
    return scoring.results_with_samples(B.runs(spark, d)[0], B.samples(spark, d))


@query("batch_stats", B.sql("run_a", body="""
SELECT batch, correct, total, round(correct * 100.0 / total, 1)::DOUBLE AS pct FROM (
  SELECT (rn - 1) // 32 AS batch, count(*) FILTER (is_correct) AS correct, count(*) AS total
  FROM (SELECT *, row_number() OVER (ORDER BY idx) AS rn FROM run_a) GROUP BY 1)"""))
def batch_stats(spark, d):
    return scoring.batch_stats(B.runs(spark, d)[0], 32)


@query("sort_results", B.sql("run_a", body="SELECT idx, predicted, is_correct FROM run_a ORDER BY idx"))
def sort_results(spark, d):
    return scoring.sort_results(B.runs(spark, d)[0].select("idx", "predicted", "is_correct"))


@query("call_stats", """
SELECT user_id AS instance, count(*) AS calls, count(*) FILTER (value > 100) AS errors,
  sum(floor(value)::BIGINT % 3)::BIGINT AS retries FROM events GROUP BY user_id""")
def call_stats(spark, d):
    calls = B.table(spark, d, "events").select(
        F.col("user_id").alias("instance"), F.when(F.col("value") > 100, "timeout").alias("error"),
        (F.floor("value") % 3).alias("retries"),
    )
    return scoring.call_stats(calls)


# ---- filters ----------------------------------------------------------------


@query("filter_outcome", B.sql("traces", body="""
SELECT 'correct' AS mode, task_id FROM traces WHERE coalesce(is_correct, false)
UNION ALL SELECT 'incorrect', task_id FROM traces WHERE NOT coalesce(is_correct, false)"""))
def filter_outcome(spark, d):
    t = B.traces(spark, d)
    parts = [filters.filter_outcome(t, m).select(F.lit(m).alias("mode"), "task_id") for m in ("correct", "incorrect")]
    return parts[0].unionByName(parts[1])


@query("outcome_counts", B.sql("traces", body="""
SELECT count(*) FILTER (coalesce(is_correct, false)) AS n_correct,
  count(*) FILTER (NOT coalesce(is_correct, false)) AS n_incorrect, count(*) AS n_traces FROM traces"""))
def outcome_counts(spark, d):
    return filters.outcome_counts(B.traces(spark, d))


@query("incorrect_results", B.sql("traces", body="SELECT task_id FROM traces WHERE NOT coalesce(is_correct, true)"))
def incorrect_results(spark, d):
    return filters.incorrect_results(B.traces(spark, d)).select("task_id")


@query("keep_multi_choice", """
SELECT doc_id FROM documents WHERE CASE source WHEN 'src0' THEN true WHEN 'src2' THEN false
  ELSE len(string_split(text, chr(10))) >= 2 END""")
def keep_multi_choice(spark, d):
    docs = B.table(spark, d, "documents").select(
        "doc_id",
        F.when(F.col("source") == "src0", "Multi-Choice").when(F.col("source") == "src2", "open").alias("question_type"),
        F.split("text", "\n").alias("choices"),
    )
    return filters.keep_multi_choice(docs).select("doc_id")


_ANS = """CASE doc_id % 5 WHEN 0 THEN 'N/A' WHEN 1 THEN 'Unanswerable' WHEN 2 THEN lang WHEN 3 THEN 'es' ELSE '' END"""


def _answers(spark, d):
    return B.table(spark, d, "documents").select(
        "doc_id", F.array(F.col("lang"), F.lit("x")).alias("choices"),
        F.when(F.col("doc_id") % 5 == 0, "N/A").when(F.col("doc_id") % 5 == 1, "Unanswerable")
        .when(F.col("doc_id") % 5 == 2, F.col("lang")).when(F.col("doc_id") % 5 == 3, "es").otherwise("").alias("answer"),
    )


@query("drop_unanswerable", f"""
SELECT doc_id FROM (SELECT doc_id, lang, {_ANS} AS answer FROM documents)
WHERE answer <> '' AND lower(answer) NOT IN ('unanswerable', 'n/a', 'none') AND answer IN (lang, 'x')""")
def drop_unanswerable(spark, d):
    return filters.drop_unanswerable(_answers(spark, d)).select("doc_id")


@query("unanswerable_report", f"""
SELECT total, unanswerable, round(unanswerable * 100.0 / total, 1)::DOUBLE AS unanswerable_pct FROM (
  SELECT count(*) AS total, count(*) FILTER (lower(answer) IN ('unanswerable', 'n/a', 'none')) AS unanswerable
  FROM (SELECT {_ANS} AS answer FROM documents))""")
def unanswerable_report(spark, d):
    return filters.unanswerable_report(_answers(spark, d))


@query("filter_report", f"""
SELECT total, kept, total - kept AS dropped, round(kept * 100.0 / total, 1)::DOUBLE AS kept_pct FROM (
  SELECT count(*) AS total, count(*) FILTER (answer IN (lang, 'x')) AS kept
  FROM (SELECT lang, {_ANS} AS answer FROM documents))""")
def filter_report(spark, d):
    a = _answers(spark, d)
    return filters.filter_report(a, filters.drop_unanswerable(a))


@query("has_option_block", r"""
SELECT doc_id, regexp_matches(text || chr(10) || CASE WHEN lang = 'en' THEN 'Choices :' || chr(10) WHEN lang = 'fr' THEN ' B) oui' ELSE 'none' END,
  '(?is)\bchoices\s*:\s*\n') OR regexp_matches(text || chr(10) || CASE WHEN lang = 'en' THEN 'Choices :' || chr(10)
  WHEN lang = 'fr' THEN ' B) oui' ELSE 'none' END, '(?m)^\s*([A-D])\s*[:\)]\s*.+$') AS has_options FROM documents""")
def has_option_block(spark, d):
    from trailmark.functions.choices import has_option_block as has

    tail = F.when(F.col("lang") == "en", "Choices :\n").when(F.col("lang") == "fr", " B) oui").otherwise("none")
    return B.table(spark, d, "documents").select(
        "doc_id", has(F.concat("text", F.lit("\n"), tail)).alias("has_options")
    )


@query("keep_first_cycle", "SELECT p_partkey FROM part WHERE p_type = 'ECONOMY'")
def keep_first_cycle(spark, d):
    p = B.table(spark, d, "part").withColumn("cycle_category", F.when(F.col("p_type") == "ECONOMY", "0").otherwise("1"))
    return filters.keep_first_cycle(p).select("p_partkey")


@query("require_image", B.sql("traces", body="""
SELECT 'drop' AS policy, doc_id, images[1] AS first_image FROM traces WHERE len(images) > 0
UNION ALL SELECT 'keep', doc_id, images[1] FROM traces
UNION ALL SELECT 'placeholder', doc_id, coalesce(images[1], printf('%05d/00000.png', doc_id)) FROM traces"""))
def require_image(spark, d):
    t = B.traces(spark, d).select("doc_id", "images", F.col("doc_id").alias("idx"))
    parts = [
        filters.require_image(t, p).select(F.lit(p).alias("policy"), "doc_id", F.get("images", 0).alias("first_image"))
        for p in ("drop", "keep", "placeholder")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("non_empty_lines", f"""
SELECT doc_id, count(*) AS n_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents)
WHERE length({B.strip_sql('x')}) > 0 GROUP BY doc_id""")
def non_empty_lines(spark, d):
    lines = B.table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("x"))
    return filters.non_empty(lines, "x").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"))


@query("non_blank_question", f"SELECT doc_id FROM documents WHERE length({B.strip_sql('text')}) > 0")
def non_blank_question(spark, d):
    return filters.non_blank_question(B.table(spark, d, "documents"), "text").select("doc_id")


@query("validate_boxes", B.sql("detections", body="""
SELECT image_id, det_pos, CASE WHEN NOT (x1 BETWEEN 0 AND 1 AND y1 BETWEEN 0 AND 1 AND x2 BETWEEN 0 AND 1 AND y2 BETWEEN 0 AND 1)
    THEN 'bbox_2d values must be between 0 and 1'
  WHEN x1 >= x2 OR y1 >= y2 THEN 'invalid bbox_2d: left >= right or top >= bottom' END AS error FROM detections"""))
def validate_boxes(spark, d):
    return filters.validate_boxes(B.detections(spark, d)).select("image_id", "det_pos", "error")


@query("filter_detections", B.sql("detections", body="SELECT image_id, det_pos, score FROM detections WHERE score >= 0.5"))
def filter_detections(spark, d):
    return filters.filter_detections(B.detections(spark, d)).select("image_id", "det_pos", "score")


# ---- sampling ---------------------------------------------------------------


@query("limit_samples", B.sql("samples", body="SELECT idx, dataset FROM samples ORDER BY src_pos LIMIT 100"))
def limit_samples(spark, d):
    return sampling.limit_samples(B.samples(spark, d), 100).select("idx", "dataset")


@query("sample_random", B.sql("samples", body="SELECT idx FROM samples ORDER BY md5('42:' || idx) LIMIT 100"))
def sample_random(spark, d):
    return sampling.sample_random(B.samples(spark, d), 100).select("idx")


_BALANCED = """
SELECT idx, grp FROM (SELECT idx, grp, row_number() OVER (PARTITION BY grp ORDER BY md5('42:' || idx)) AS rn,
    dense_rank() OVER (ORDER BY grp) - 1 AS gi, (SELECT count(DISTINCT coalesce(sub_task, 'unknown')) FROM samples) AS g
  FROM (SELECT idx, coalesce(sub_task, 'unknown') AS grp FROM samples))
WHERE rn <= 203 // g + (CASE WHEN gi < 203 % g THEN 1 ELSE 0 END)"""


@query("sample_balanced", B.sql("samples", body=_BALANCED))
def sample_balanced(spark, d):
    s = sampling.slice_samples(B.samples(spark, d), 203)
    return s.select("idx", sampling.group_name("sub_task").alias("grp"))


@query("group_counts", B.sql("samples", body="SELECT coalesce(sub_task, 'unknown') AS sub_task, count(*) AS n FROM samples GROUP BY 1"))
def group_counts(spark, d):
    return sampling.group_counts(B.samples(spark, d))


@query("reindex", B.sql("samples", body="""
SELECT src_pos, row_number() OVER (ORDER BY src_pos) - 1 AS idx FROM samples WHERE type = 'multi-choice'"""))
def reindex(spark, d):
    from trailmark.operators.trajectories import reindex as dense

    kept = B.samples(spark, d).where(F.col("type") == "multi-choice").select("src_pos")
    return dense(kept)


@query("reindex_in_ranges", B.sql("step_events", body="""
SELECT task_id, event_id, row_number() OVER (ORDER BY ts, event_id) AS pos,
  row_number() OVER (PARTITION BY task_id ORDER BY ts, event_id) AS task_pos FROM step_events"""))
def reindex_in_ranges(spark, d):
    """Positions over all events and per task, with keys cut at 1,000 and 20 rows."""
    e = B.step_events(spark, d).select("task_id", "ts", "event_id")
    placed = skew.running(e, [], B.micros(), {"pos": skew.row_number()}, target_rows=1_000)
    return skew.running(placed, ["task_id"], B.micros(), {"task_pos": skew.row_number()}, target_rows=20).drop("ts")

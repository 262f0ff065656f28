"""Traces, samples, runs, banks and pixels derived from the test tables.

Each binding exists twice: as a DataFrame and as a SQL common table expression
of the same rows. All rows and whole texts of a table take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- SQL side ---------------------------------------------------------------

CTE: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, needs: tuple[str, ...] = ()) -> None:
    CTE[name] = (needs, body)


def sql(*names: str, body: str) -> str:
    """``body`` led by the named expressions and what they need."""
    done: list[str] = []

    def add(n: str) -> None:
        for d in CTE[n][0]:
            add(d)
        if n not in done:
            done.append(n)

    for n in names:
        add(n)
    head = ",\n".join(f"{n} AS ({CTE[n][1]})" for n in done)
    return f"WITH {head}\n{body}" if done else body


SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160)"


def strip_sql(e: str) -> str:
    return f"trim({e}, {SPACES})"


def vector_digest(v) -> Column:
    """Digest of all values of an array of floats, as whole millionths."""
    return F.md5(F.array_join(F.transform(v, lambda x: F.floor(x.cast("double") * 1_000_000).cast("string")), ","))


def vector_digest_sql(v: str) -> str:
    return f"md5(array_to_string(list_transform({v}, lambda x: floor(x::DOUBLE * 1000000)::BIGINT), ','))"


# ---- traces from documents --------------------------------------------------

TOOLS = ["crop", "zoom_in", "ocr", "localize_objects"]


def _step(x: Column, i: Column) -> Column:
    code = (F.length(x) + i) % 6
    kind = (
        F.when(code < 2, "think").when(code < 4, "action").when(code == 4, "answer").otherwise("")
    )
    tool = F.get(F.array(*[F.lit(t) for t in TOOLS]), F.length(x) % 4)
    action, log = (code >= 2) & (code < 4), code == 5
    return F.struct(
        i.cast("int").alias("pos"),
        F.when(~log, (i + 1).cast("string")).alias("step"),
        kind.alias("type"),
        F.when(action, tool).alias("tool"),
        F.when(~action & ~log, x).alias("content"),
        F.when(action, F.concat(F.lit('{"image":"img_'), (i % 3).cast("string"), F.lit('"}')))
        .otherwise("{}").alias("properties"),
        F.when(action, F.when(F.length(x) % 5 == 0, "").otherwise(x)).otherwise("").alias("observation"),
        F.lit(None).cast("string").alias("state_experience"),
        F.when(log, (i + 2).cast("int")).alias("log_step"),
        F.when(
            log,
            F.concat(F.lit('[{"round":1,"view":"question","experiences":["'), (i % 7).cast("string"), F.lit('"]}]')),
        ).alias("log_rounds"),
    )


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trace per document: its lines are the steps."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    d = docs.join(labels, "doc_id", "left")
    images = F.when(
        F.col("doc_id") % 3 > 0,
        F.transform(
            F.sequence(F.lit(1), (F.col("doc_id") % 3).cast("int")),
            lambda i: F.concat(F.lit("img/"), F.col("doc_id").cast("string"), F.lit("_"), i.cast("string"), F.lit(".png")),
        ),
    ).otherwise(F.array().cast("array<string>"))
    return d.select(
        F.format_string("%06d", "doc_id").alias("task_id"),
        F.col("doc_id").cast("string").alias("dataset_id"),
        F.col("lang").alias("sub_task"), F.col("source").alias("dataset"),
        F.concat(F.lit("Which language is document "), F.col("doc_id").cast("string"), F.lit(" written in?")).alias("question"),
        images.alias("images"),
        F.transform(F.split("text", "\n"), _step).alias("steps"),
        (F.col("quality") == 1).alias("is_correct"),
        F.when(F.col("toxic") == 1, F.col("lang")).alias("ground_truth"),
        "doc_id",
    )


cte("traces", f"""
SELECT printf('%06d', d.doc_id) AS task_id, d.doc_id::VARCHAR AS dataset_id, d.lang AS sub_task, d.source AS dataset,
  'Which language is document ' || d.doc_id || ' written in?' AS question,
  list_transform(range(1, (d.doc_id % 3) + 1), lambda i: 'img/' || d.doc_id || '_' || i || '.png') AS images,
  l.quality = 1 AS is_correct, CASE WHEN l.toxic = 1 THEN d.lang END AS ground_truth, d.doc_id,
  string_split(d.text, chr(10)) AS lines
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
cte("steps", f"""
SELECT task_id, doc_id, pos, x, code, len, type, tool, properties,
  CASE WHEN type = 'action' THEN CASE WHEN len % 5 = 0 THEN '' ELSE x END ELSE '' END AS observation
FROM (SELECT *, CASE WHEN code < 2 THEN 'think' WHEN code < 4 THEN 'action' WHEN code = 4 THEN 'answer' ELSE '' END AS type,
        CASE WHEN code IN (2, 3) THEN {TOOLS}[len % 4 + 1] END AS tool,
        CASE WHEN code IN (2, 3) THEN '{{"image":"img_' || (pos % 3) || '"}}' ELSE '{{}}' END AS properties
      FROM (SELECT *, length(x) AS len, (length(x) + pos) % 6 AS code
            FROM (SELECT task_id, doc_id, unnest(lines) AS x, generate_subscripts(lines, 1) - 1 AS pos FROM traces)))""", ("traces",))
cte("entries", """
SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY pos) - 1 AS state_index,
  count(*) OVER (PARTITION BY task_id) AS n_states
FROM (SELECT *, CASE WHEN lag(type) OVER w = 'think' THEN lag(x) OVER w ELSE '' END AS thinking
      FROM steps WHERE type <> '' WINDOW w AS (PARTITION BY task_id ORDER BY pos))
WHERE type <> 'think'""", ("steps",))


# ---- step table from events -------------------------------------------------


def micros() -> dict[str, Column]:
    """Order of events: time, then id."""
    return {"ts": F.unix_micros(F.col("ts")), "id": F.col("event_id")}


def step_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step table: the events of a user are one task."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    kind = (
        F.when(F.col("event_type") == "view", "think")
        .when(F.col("event_type").isin("click", "purchase"), "action")
        .when(F.col("event_type") == "signup", "answer").otherwise("")
    )
    value = F.col("value").cast("string")
    return e.select(
        F.col("user_id").alias("task_id"), "ts", "event_id", kind.alias("type"),
        F.when(kind == "action", F.col("event_type")).alias("tool"),
        F.when(kind.isin("think", "answer"), value).alias("content"),
        F.col("props").alias("properties"),
        F.when(kind == "action", value).alias("observation"),
    )


cte("step_events", """
SELECT user_id AS task_id, ts, event_id, event_type, value::VARCHAR AS value, props,
  CASE event_type WHEN 'view' THEN 'think' WHEN 'click' THEN 'action' WHEN 'purchase' THEN 'action'
    WHEN 'signup' THEN 'answer' ELSE '' END AS type
FROM events""")
cte("event_entries", """
SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ts, event_id) - 1 AS state_index
FROM (SELECT *, CASE WHEN lag(type) OVER w = 'think' THEN lag(value) OVER w ELSE '' END AS thinking
      FROM step_events WHERE type <> '' WINDOW w AS (PARTITION BY task_id ORDER BY ts, event_id))
WHERE type <> 'think'""", ("step_events",))


# ---- samples, responses and runs --------------------------------------------

LANGS = ["en", "de", "fr", "es"]


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One language question per document."""
    d = table(spark, sf_dir, "documents")
    twice = F.array(*[F.lit(x) for x in LANGS * 2])
    return d.select(
        F.col("doc_id").alias("idx"), F.col("doc_id").alias("src_pos"),
        F.array().cast("array<string>").alias("images"),
        F.col("source").alias("dataset"),
        F.when(F.col("source") == "src0", "open-ended").otherwise("multi-choice").alias("type"),
        F.when(F.col("source") != "src1", F.col("lang")).alias("sub_task"),
        F.col("text").alias("question"),
        F.slice(twice, (F.col("doc_id") % 4 + 1).cast("int"), F.lit(4)).alias("choices"),
        F.col("lang").alias("answer"),
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("Name the language.\n"), F.col("text"))).otherwise("").alias("prompt"),
    )


cte("samples", f"""
SELECT doc_id AS idx, doc_id AS src_pos, source AS dataset,
  CASE WHEN source = 'src0' THEN 'open-ended' ELSE 'multi-choice' END AS type,
  CASE WHEN source <> 'src1' THEN lang END AS sub_task, text AS question,
  list_slice({LANGS * 2}, doc_id % 4 + 1, doc_id % 4 + 4) AS choices, lang AS answer,
  CASE WHEN doc_id % 5 = 0 THEN 'Name the language.' || chr(10) || text ELSE '' END AS prompt
FROM documents""")


def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with a free-text response in one of eight answer styles."""
    s = samples(spark, sf_dir)
    right = F.char(F.array_position("choices", F.col("answer")) + 64)
    style = F.col("idx") % 8
    tail = (
        F.when(style == 0, F.concat(F.lit("("), right, F.lit(")")))
        .when(style == 1, F.concat(F.lower(right), F.lit(".")))
        .when(style == 2, F.col("answer"))
        .when(style == 3, F.concat(F.lit("I think it is "), F.col("answer")))
        .when(style == 4, F.lit("A"))
        .when(style == 6, F.concat(right, F.lit(", because of the words\nand more")))
        .when(style == 7, F.concat(F.lit("  "), F.upper("answer"), F.lit("  ")))
    )
    return s.withColumn(
        "response",
        F.when(style == 5, F.col("question")).otherwise(F.concat("question", F.lit("\nAnswer: "), tail)),
    )


cte("answered", """
SELECT *, CASE WHEN idx % 8 = 5 THEN question ELSE question || chr(10) || 'Answer: ' || CASE idx % 8
    WHEN 0 THEN '(' || chr((64 + list_position(choices, answer))::INT) || ')'
    WHEN 1 THEN lower(chr((64 + list_position(choices, answer))::INT)) || '.'
    WHEN 2 THEN answer WHEN 3 THEN 'I think it is ' || answer WHEN 4 THEN 'A'
    WHEN 6 THEN chr((64 + list_position(choices, answer))::INT) || ', because of the words' || chr(10) || 'and more'
    WHEN 7 THEN '  ' || upper(answer) || '  ' END END AS response
FROM samples""", ("samples",))
_LAST = "string_split(response, 'Answer:')[-1]"
cte("predicted", f"""
SELECT *, CASE WHEN contains(response, 'Answer:')
  THEN {strip_sql(f"string_split({strip_sql(_LAST)}, chr(10))[1]")} ELSE '' END AS predicted
FROM answered""", ("answered",))
cte("matched", f"""
SELECT *, CASE WHEN pred = '' THEN NULL ELSE coalesce(
    CASE WHEN regexp_matches(pred, '^\\(?([a-z])\\)?([^a-z0-9]|$)')
      THEN choices[unicode(regexp_extract(pred, '^\\(?([a-z])', 1)) - 96] END,
    list_filter(choices, lambda c: lower(c) = pred)[1],
    list_filter(choices, lambda c: length(c) > 1 AND length(pred) > 1
      AND (contains(pred, lower(c)) OR contains(lower(c), pred)))[1]) END AS matched
FROM (SELECT *, lower({strip_sql('predicted')}) AS pred FROM predicted)""", ("predicted",))
cte("results", """
SELECT *, CASE WHEN predicted <> '' AND type <> 'multi-choice'
    THEN 'Task type ''' || type || ''' is not implemented yet' END AS error,
  predicted <> '' AND type = 'multi-choice' AND coalesce(matched, '') <> '' AND lower(matched) = lower(answer) AS is_correct
FROM matched""", ("matched",))


def runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Run a (with tools) and run b (direct) over the labelled documents."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    base = table(spark, sf_dir, "labels").join(d, "doc_id")

    def run(ok: Column) -> DataFrame:
        return base.select(
            F.col("doc_id").alias("idx"), F.col("doc_id").alias("src_pos"),
            F.col("text").alias("question"), F.array(*[F.lit(x) for x in LANGS]).alias("choices"),
            F.lit("").alias("query"), F.col("lang").alias("ground_truth"),
            F.when(ok, F.col("lang")).otherwise("none").alias("predicted"), ok.alias("is_correct"),
            F.col("text").alias("response"), F.lit("multi-choice").alias("type"),
            F.when(F.col("source") != "src1", F.col("lang")).otherwise("").alias("sub_task"),
            F.col("source").alias("dataset"),
        )

    return run(F.col("quality") == 1), run(F.col("toxic") == 0)


for _name, _ok in (("run_a", "quality = 1"), ("run_b", "toxic = 0")):
    cte(_name, f"""
SELECT l.doc_id AS idx, d.text AS question, d.lang AS ground_truth, CASE WHEN {_ok} THEN lang ELSE 'none' END AS predicted,
  {_ok} AS is_correct, CASE WHEN source <> 'src1' THEN lang ELSE '' END AS sub_task, source AS dataset
FROM labels l JOIN documents d ON l.doc_id = d.doc_id""")
cte("used", "SELECT doc_id, bool_or(type = 'action') AS used_tools FROM steps GROUP BY doc_id", ("steps",))


CATEGORIES_SQL = (
    "['visual_perception','ineffective_tool_use','tool_misinterpretation',"
    "'reasoning_error','instruction_following','no_answer']"
)


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error records of run a's wrong answers; labels follow from the id."""
    from trailmark.operators.filters import incorrect_results
    from trailmark.schemas import ERROR_CATEGORIES

    wrong = incorrect_results(runs(spark, sf_dir)[0])
    six = F.array(*[F.lit(c) for c in ERROR_CATEGORIES])
    mine = F.filter(six, lambda c, i: (F.col("idx") + i * i) % 4 == 0)
    other = F.when(F.col("idx") % 9 == 0, F.array(F.lit("other"))).otherwise(F.array().cast("array<string>"))
    return wrong.select(
        "idx", "src_pos", "dataset", "sub_task", "question",
        F.array(F.concat(F.lit("img/"), F.col("idx").cast("string"), F.lit(".png"))).alias("image_paths"),
        "ground_truth", "predicted", F.concat(mine, other).alias("error_categories"),
        F.concat(F.lit("analysis of "), F.col("idx").cast("string")).alias("analysis"),
    )


cte("errors", f"""
SELECT idx, dataset, sub_task, CASE WHEN sub_task = '' THEN 'Unknown' ELSE sub_task END AS st, ground_truth, predicted,
  list_concat(list_filter({CATEGORIES_SQL}, lambda c, i: (idx + (i - 1) * (i - 1)) % 4 = 0),
    CASE WHEN idx % 9 = 0 THEN ['other'] ELSE [] END) AS cats
FROM run_a WHERE NOT is_correct""", ("run_a",))


# ---- banks from embeddings --------------------------------------------------

BANK_VIEWS = ["question", "task", "images"]


def bank(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """State bank over all embeddings; rows of label 0 have no vector."""
    e = table(spark, sf_dir, "embeddings")
    view = F.get(F.array(*[F.lit(v) for v in BANK_VIEWS]), (F.col("vec_id") % 3).cast("int"))
    meta = e.select(
        F.col("vec_id").alias("bank_row"), (F.col("vec_id") % 97).cast("string").alias("task_id"),
        F.floor(F.col("vec_id") / 97).cast("int").alias("state"),
        F.when(F.col("label") == 3, "").otherwise(F.concat(F.lit("advice "), F.col("vec_id").cast("string"))).alias("experience"),
        F.col("label").alias("q_value"),
        F.when(F.col("label") >= 5, "correct").otherwise("incorrect").alias("source"),
    )
    vectors = e.where(F.col("label") != 0).select(F.col("vec_id").alias("bank_row"), view.alias("view"), "embedding")
    return meta, vectors


def bank_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding asks in its own view."""
    view = F.get(F.array(*[F.lit(v) for v in BANK_VIEWS]), (F.col("vec_id") % 3).cast("int"))
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("query_id"), view.alias("view"), "embedding"
    )


cte("emb", f"""
SELECT vec_id, label, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm,
  {BANK_VIEWS}[vec_id % 3 + 1] AS view, (vec_id % 97)::VARCHAR AS task_id, vec_id // 97 AS state
FROM embeddings""")
# In a bank search every meta row takes part in every view; only rows with a vector of that view score.
cte("scored", """
SELECT q.vec_id AS query_id, q.view, b.vec_id AS bank_row, b.task_id, b.state, b.label AS q_value,
  (b.view = q.view AND b.label <> 0) AS has_vector,
  CASE WHEN b.view = q.view AND b.label <> 0
    THEN round(list_dot_product(q.v, b.v) / ((q.norm + 1e-8) * (b.norm + 1e-8)), 9) ELSE 0.0 END AS score
FROM emb q, emb b""", ("emb",))


# ---- pixels, regions, detections, media -------------------------------------


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 image per embedding."""
    p = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("i", "v"))
    a = F.abs(F.col("v").cast("double"))
    return p.select(
        "image_id", (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"),
        (F.floor(a * 1000) % 256).cast("double").alias("r"), (F.floor(a * 3000) % 256).cast("double").alias("g"),
        (F.floor(a * 7000) % 256).cast("double").alias("b"), F.col("v").cast("double").alias("depth"),
    )


cte("pixels", """
SELECT image_id, i % 8 AS x, i // 8 AS y, v AS depth, (floor(abs(v) * 1000) % 256)::DOUBLE AS r,
  (floor(abs(v) * 3000) % 256)::DOUBLE AS g, (floor(abs(v) * 7000) % 256)::DOUBLE AS b
FROM (SELECT vec_id AS image_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)""")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One region per event, on the image of its user."""
    e = table(spark, sf_dir, "events")
    x1, y1 = F.col("event_id") % 4, F.floor(F.col("event_id") / 4) % 4
    return e.select(
        F.col("user_id").alias("image_id"), F.col("event_id").alias("region_id"),
        F.struct(
            x1.cast("int").alias("x1"), y1.cast("int").alias("y1"),
            (x1 + 1 + F.floor("value") % 4).cast("int").alias("x2"), (y1 + 2).cast("int").alias("y2"),
        ).alias("box"),
    )


cte("regions", """
SELECT user_id AS image_id, event_id AS region_id, event_id % 4 AS x1, (event_id // 4) % 4 AS y1,
  event_id % 4 + 1 + floor(value)::BIGINT % 4 AS x2, (event_id // 4) % 4 + 2 AS y2 FROM events""")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as detections; ``det_pos`` orders them within an order."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("image_id"), F.col("l_returnflag").alias("object"),
        det_pos().alias("det_pos"), (F.col("l_quantity") / 50).alias("score"),
        F.struct(
            (F.col("l_discount") * 5).alias("x1"), (F.col("l_tax") * 5).alias("y1"),
            (F.col("l_discount") * 5 + F.col("l_quantity") / 100).alias("x2"), (F.col("l_tax") * 5 + 0.3).alias("y2"),
        ).alias("box"),
    )


def det_pos() -> Column:
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return (F.col("l_linenumber").cast("long") * 1_000_000 + F.col("l_partkey")) * 100_000_000 + cents % 100_000_000


cte("detections", """
SELECT l_orderkey AS image_id, l_returnflag AS object, l_quantity / 50 AS score,
  (l_linenumber::BIGINT * 1000000 + l_partkey) * 100000000 + round(l_extendedprice * 100)::BIGINT % 100000000 AS det_pos,
  l_discount * 5 AS x1, l_tax * 5 AS y1, l_discount * 5 + l_quantity / 100 AS x2, l_tax * 5 + 0.3 AS y2
FROM lineitem""")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with image and video parts on some messages."""
    c = table(spark, sf_dir, "conversations")
    part = lambda t, text, ref: F.struct(
        F.lit(t).alias("type"), text.cast("string").alias("text"), ref.cast("string").alias("ref")
    )
    n = F.length("text")
    ref = F.concat_ws("_", "conv_id", "turn")
    none = F.array().cast("array<struct<type:string,text:string,ref:string>>")
    return c.select(
        "conv_id", "turn", "role",
        F.concat(
            F.when(n % 3 != 0, F.array(part("text", F.concat(F.lit("Available images: img_0\n\n"), F.col("text")), F.lit(None)))).otherwise(none),
            F.when((n % 2 == 0) | (n % 3 == 0), F.array(part("image", F.lit(None), ref))).otherwise(none),
            F.when(n % 5 == 0, F.array(part("video", F.lit(None), ref))).otherwise(none),
        ).alias("content"),
    )


cte("messages", """
SELECT conv_id, turn, role, length(text) AS n, text, length(text) % 3 <> 0 AS has_text,
  (length(text) % 2 = 0 OR length(text) % 3 = 0) AS has_image, length(text) % 5 = 0 AS has_video FROM conversations""")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as agent turns of a user."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.select(
        F.col("user_id").alias("task_id"), "ts", "event_id",
        F.col("event_type").isin("click", "purchase").cast("int").alias("n_actions"),
        ((F.col("event_type") == "signup") & (F.col("value") > 40)).alias("answered"),
    )


cte("turns", """
SELECT user_id AS task_id, ts, event_id, (event_type IN ('click', 'purchase'))::BIGINT AS n_actions,
  event_type = 'signup' AND value > 40 AS answered FROM events""")

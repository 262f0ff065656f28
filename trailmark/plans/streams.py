"""Streaming operators run to completion over the tables as file streams.

Output goes to a new folder below the shared checkpoint folder and is read back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.operators import search
from trailmark.plans import bindings as B
from trailmark.plans.registry import query
from trailmark.plans.vectors import _REQ_VIEW, _search_sql
from trailmark.session import checkpoint_dir
from trailmark.streaming import live


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a file stream, whether it is one file or a folder of files."""
    schema = B.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")  # a pattern: the reader takes no single file by name


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


def _finish(out: DataFrame, spark: SparkSession) -> DataFrame:
    """Run an append stream until its input is used up and read what it wrote."""
    folder = _folder(spark)
    writer = out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint")
    writer.trigger(availableNow=True).start(f"{folder}/data").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/data")


def _step_stream(spark, d):
    kind = (
        F.when(F.col("event_type") == "view", "think").when(F.col("event_type") == "signup", "answer")
        .when(F.col("event_type") == "error", "search").otherwise("action")
    )
    return _stream(spark, d, "events").select(
        F.col("user_id").cast("string").alias("task_id"), F.col("event_id").alias("event_seq"),
        kind.alias("kind"), F.col("event_type").alias("tool"), F.lit("").alias("view"),
        F.col("value").cast("string").alias("payload"),
    )


# A task ends at its first answer; what comes later belongs to no task.
B.cte("live_steps", """
SELECT * FROM (SELECT user_id AS task_id, event_id AS event_seq, event_type, value::VARCHAR AS value,
  CASE event_type WHEN 'view' THEN 'think' WHEN 'signup' THEN 'answer' WHEN 'error' THEN 'search' ELSE 'action' END AS kind,
  min(CASE WHEN event_type = 'signup' THEN event_id END) OVER (PARTITION BY user_id) AS answer_at FROM events)
WHERE answer_at IS NULL OR event_seq <= answer_at""")


@query("stream_trajectory", B.sql("live_steps", body="""
SELECT task_id::VARCHAR AS task_id, event_seq, row_number() OVER w AS step, kind,
  CASE WHEN kind <> 'think' THEN coalesce(sum((kind <> 'think')::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE -1 END::BIGINT AS state_index,
  CASE WHEN kind <> 'think' AND lag(kind) OVER w = 'think' THEN lag(value) OVER w ELSE '' END AS thinking,
  coalesce(sum((kind = 'action')::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS n_observations
FROM live_steps WHERE kind <> 'search' WINDOW w AS (PARTITION BY task_id ORDER BY event_seq)"""))
def stream_trajectory(spark, d):
    live.use_rocksdb(spark)
    out = _finish(live.stream_trajectory(_step_stream(spark, d)), spark)
    return live.current_rows(out, ["task_id", "event_seq"], "kind").select(
        "task_id", "event_seq", "step", "kind", F.coalesce("state_index", F.lit(-1)).alias("state_index"),
        F.coalesce("thinking", F.lit("")).alias("thinking"), "n_observations",
    )


@query("stream_retrieval", B.sql("plan", body="""
SELECT state_key::VARCHAR AS task_id, request_no, view, outcome, round FROM plan"""))
def stream_retrieval(spark, d):
    live.use_rocksdb(spark)
    view = F.create_map(*[F.lit(x) for kv in _REQ_VIEW.items() for x in kv])
    have = F.when(F.col("user_id") % 2 == 0, F.array(*[F.lit(v) for v in ("question", "task", "images", "question+task")])).otherwise(
        F.array(*[F.lit(v) for v in ("question", "task", "question+task")])
    )
    asked = _stream(spark, d, "events").select(
        F.col("user_id").cast("string").alias("task_id"), F.lit(0).alias("state_index"),
        F.col("event_id").alias("request_no"), view[F.col("event_type")].alias("view"), have.alias("available_views"),
    )
    out = live.current_rows(_finish(live.stream_retrieval(asked, 2), spark), ["task_id", "request_no"], "outcome")
    return out.select("task_id", "request_no", "view", "outcome", "round")


@query("stream_turn_budget", """
SELECT user_id::VARCHAR AS task_id, turn_no AS turns, actions, outcome, outcome = 'answered' AS success FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS first FROM (
    SELECT user_id, event_id, turn_no, actions, CASE WHEN event_type = 'signup' AND value > 40 THEN 'answered' WHEN turn_no >= 20 THEN 'safety_stop'
        WHEN actions >= 10 THEN 'max_iterations' END AS outcome FROM (
      SELECT *, row_number() OVER w AS turn_no, sum((event_type IN ('click', 'purchase'))::INT) OVER w::BIGINT AS actions
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))) WHERE outcome IS NOT NULL) WHERE first = 1""")
def stream_turn_budget(spark, d):
    live.use_rocksdb(spark)
    turns = _stream(spark, d, "events").select(
        F.col("user_id").cast("string").alias("task_id"), F.col("event_id").alias("turn"),
        F.col("event_type").isin("click", "purchase").cast("int").alias("n_actions"),
        ((F.col("event_type") == "signup") & (F.col("value") > 40)).alias("answered"),
    )
    out = live.current_rows(_finish(live.stream_turn_budget(turns, 10, 1), spark), ["task_id", "last_turn"], "outcome")
    return out.drop("last_turn")


@query("stream_search", _search_sql(5, 0.05, 5, 25))
def stream_search(spark, d):
    folder = _folder(spark)
    live.publish_bank(*B.bank(spark, d), f"{folder}/bank")
    view = F.get(F.array(*[F.lit(v) for v in B.BANK_VIEWS]), (F.col("vec_id") % 3).cast("int"))
    asked = _stream(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), view.alias("view"), "embedding")
    writer = live.stream_search(asked, f"{folder}/bank", f"{folder}/hits", f"{folder}/checkpoint", k=5, min_score=0.05, min_q=5)
    writer.trigger(availableNow=True).start().awaitTermination()
    hits = spark.read.parquet(f"{folder}/hits")
    return hits.select("query_id", "view", "rank", "bank_row", "task_id", F.col("state").cast("long").alias("state"),
                       F.col("q_value").cast("long").alias("q_value"), F.round("score", 4).alias("score"))


def _result_stream(spark, d):
    return _stream(spark, d, "labels").select(
        F.col("doc_id").alias("idx"), (F.col("quality") == 1).alias("is_correct"), (F.col("toxic") == 1).alias("flagged")
    )


@query("stream_results", "SELECT doc_id AS idx, quality = 1 AS is_correct FROM labels")
def stream_results(spark, d):
    folder = _folder(spark)
    writer = live.stream_results(_result_stream(spark, d), f"{folder}/results", f"{folder}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("idx long, is_correct boolean").json(f"{folder}/results").select("idx", "is_correct")


@query("running_accuracy", """
SELECT toxic = 1 AS flagged, count(*) AS total, count(*) FILTER (quality = 1) AS correct, round(count(*) FILTER (quality = 1) / count(*), 4) AS accuracy
FROM labels GROUP BY 1""")
def running_accuracy(spark, d):
    """Latest row per group of the update stream."""
    folder = _folder(spark)
    counts = live.running_accuracy(_result_stream(spark, d), ["flagged"])

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{folder}/counts/batch_id={batch_id}")

    writer = counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{folder}/counts")
    last = rows.groupBy("flagged").agg(F.max_by(F.struct("total", "correct", "accuracy"), "batch").alias("r"))
    return last.select("flagged", "r.*")


def _purchases(spark, d):
    return _stream(spark, d, "events").select(
        "event_id", "user_id", F.col("ts").cast("timestamp").alias("event_ts"), (F.col("event_type") == "purchase").alias("is_correct")
    )


# A window is given once it ends an hour or more before the newest event.
B.cte("over", "SELECT epoch_ms(max(ts)) * 1000 - 3600000000 AS until FROM events")
_SHARES = """count(*) AS total, count(*) FILTER (event_type = 'purchase') AS correct,
  round(count(*) FILTER (event_type = 'purchase') / count(*), 4) AS accuracy"""


def _spans():
    return [F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us")]


@query("accuracy_per_window", B.sql("over", body=f"""
SELECT start_us, start_us + 21600000000 AS end_us, {_SHARES} FROM (SELECT *, epoch_us(ts) // 21600000000 * 21600000000 AS start_us FROM events)
WHERE start_us + 21600000000 <= (SELECT until FROM over) GROUP BY start_us"""))
def accuracy_per_window(spark, d):
    out = _finish(live.windowed_accuracy(_purchases(spark, d), "event_ts", window="6 hours"), spark)
    return out.select(*_spans(), "total", "correct", "accuracy")


@query("accuracy_per_sliding_window", B.sql("over", body=f"""
SELECT start_us, start_us + 21600000000 AS end_us, {_SHARES}
FROM (SELECT *, epoch_us(ts) // 7200000000 * 7200000000 - i * 7200000000 AS start_us FROM events, (SELECT unnest([0, 1, 2]) AS i))
WHERE start_us + 21600000000 <= (SELECT until FROM over) GROUP BY start_us"""))
def accuracy_per_sliding_window(spark, d):
    out = _finish(live.windowed_accuracy(_purchases(spark, d), "event_ts", window="6 hours", slide="2 hours"), spark)
    return out.select(*_spans(), "total", "correct", "accuracy")


@query("accuracy_per_session", B.sql("over", body=f"""
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 14400000000 AS end_us, {_SHARES}
FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (
  SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 14400000000, true)::INT AS fresh FROM events))
GROUP BY user_id, session HAVING epoch_us(max(ts)) + 14400000000 <= (SELECT until FROM over)"""))
def accuracy_per_session(spark, d):
    out = _finish(live.windowed_accuracy(_purchases(spark, d), "event_ts", gap="4 hours", by=["user_id"]), spark)
    return out.select("user_id", *_spans(), "total", "correct", "accuracy")


@query("stream_distinct_events", "SELECT DISTINCT event_id, user_id, event_type = 'purchase' AS is_correct FROM events")
def stream_distinct_events(spark, d):
    """Every event arrives twice."""
    twice = _purchases(spark, d).unionByName(_purchases(spark, d))
    out = _finish(live.distinct_events(twice, ["event_id"], "event_ts", "2 days"), spark)
    return out.select("event_id", "user_id", "is_correct")


@query("stream_open_tasks", """
SELECT user_id::VARCHAR AS task_id FROM (
  SELECT user_id, max(ts) AS last, count(*) AS turns, count(*) FILTER (event_type IN ('click', 'purchase')) AS actions,
    bool_or(event_type = 'signup' AND value > 95) AS answered FROM events GROUP BY user_id)
WHERE epoch_ms(last) + CASE WHEN turns >= 200 OR actions >= 100 OR answered THEN 0 ELSE 21600000 END > (SELECT epoch_ms(max(ts)) - 3600000 FROM events)""")
def stream_open_tasks(spark, d):
    """What the state store holds at the end: open tasks not silent for six hours, closed ones with an event in the last hour."""
    live.use_rocksdb(spark)
    folder = _folder(spark)
    turns = _stream(spark, d, "events").select(
        F.col("user_id").cast("string").alias("task_id"), F.col("event_id").alias("turn"), F.col("ts").cast("timestamp").alias("event_ts"),
        F.col("event_type").isin("click", "purchase").cast("int").alias("n_actions"),
        ((F.col("event_type") == "signup") & (F.col("value") > 95)).alias("answered"),
    )
    clock = live.Clock("event_ts", "1 hour", silence_ms=21_600_000, linger_ms=0)
    ended = live.stream_turn_budget(turns, 100, 1, clock=clock)
    writer = ended.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint")
    writer.trigger(availableNow=True).start(f"{folder}/data").awaitTermination()
    return live.held_tasks(spark, f"{folder}/checkpoint").select("task_id")

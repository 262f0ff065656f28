"""Exact filtered cosine search over experience banks.

Scores come from blocked matrix products inside tasks (``topk``): both sides meet tile by tile, a tile keeps a bounded
list per query, and the lists are merged, so no pair table is ever written. The plan is the same for any number of
queries and bank rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.config import RetrievalConfig
from trailmark.functions.text import source_tag
from trailmark.functions.vectors import plain_cosine
from trailmark.functions.views import remaining_views, view_position
from trailmark.operators.skew import TARGET_ROWS, Running, running
from trailmark.operators.topk import SCORE_DECIMALS, best_rows
from trailmark.schemas import FULL_VIEW, VIEWS

OVERFETCH = 5  # fixed value: how many times top_k the raw window holds


def candidates(
    queries: DataFrame, vectors: DataFrame, width: int, min_score: float = -math.inf, per_task: bool = False,
    one_view: bool = False, **tiles: int,
) -> DataFrame:
    """The best ``width`` rows per query in its view: ``(query_id, view, bank_row, score, masked)``.

    ``queries`` has ``query_id, view, embedding``, ``vectors`` has ``bank_row, view, embedding`` (and ``task_id`` with
    ``per_task``); a row without vector is masked and scores 0. With ``one_view`` all rows of both sides are of one
    view. ``tiles``: the tile sizes of ``best_rows``.
    """
    bank = vectors.select(
        "bank_row", "view", "embedding", F.col("embedding").isNull().alias("masked"), *(["task_id"] if per_task else [])
    )
    return best_rows(queries.select("query_id", "view", "embedding"), bank, [] if one_view else ["view"], width, min_score, per_task, **tiles)


# ---- searches ---------------------------------------------------------------


def _rank(by: list[str], name: str = "_rn"):
    return F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "bank_row")).alias(name)


def exclude_pairs(bank: DataFrame, pairs: DataFrame) -> DataFrame:
    """Bank rows whose (task_id, state) is not listed."""
    return bank.join(pairs.select("task_id", "state").distinct(), ["task_id", "state"], "left_anti")


def _masked_rows(meta: DataFrame, vectors: DataFrame, width: int) -> DataFrame:
    """First ``width`` rows per view that have no vector; they score 0."""
    views = vectors.select("view").distinct()
    have = vectors.select("bank_row", "view")
    all_rows = meta.select("bank_row", F.explode(F.array(*[F.lit(v) for v in VIEWS])).alias("view")).join(
        F.broadcast(views), "view", "left_semi"  # at most the 15 views
    )
    w = Window.partitionBy("view").orderBy("bank_row")
    return (
        all_rows.join(have, ["bank_row", "view"], "left_anti")
        .withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= width)
        .select("view", "bank_row")
    )


def search_states(
    queries: DataFrame,
    meta: DataFrame,
    vectors: DataFrame,
    k: int = 5,
    min_score: float = 0.0,
    min_q: int = 0,
    exclude: DataFrame | None = None,
    overfetch: int | None = OVERFETCH,
    one_view: bool = False,
    **tiles: int,
) -> DataFrame:
    """Best states per query in its view: at most one per task, at most ``k``.

    With ``overfetch`` the filters look only at the best ``k * overfetch`` rows,
    in which rows without a vector take part with score 0, so fewer than ``k``
    may remain. With ``overfetch=None`` the filters come first. Ties go to the
    lower bank row. ``tiles``: the tile sizes of ``topk.best_rows``.
    """
    info = meta.select("bank_row", "task_id", "state", "q_value", "experience", "source")
    allowed = info.where(F.coalesce("q_value", F.lit(0)) >= min_q)
    if exclude is not None:
        allowed = exclude_pairs(allowed, exclude)
    if overfetch is None:
        usable = vectors.join(allowed.select("bank_row", "task_id"), "bank_row")
        found = candidates(queries, usable, k, min_score, True, one_view, **tiles)
    else:
        width = k * overfetch
        bank = vectors.select("bank_row", "view", "embedding")
        if min_score <= 0:
            idle = _masked_rows(meta, vectors, width)
            bank = bank.unionByName(idle.withColumn("embedding", F.lit(None).cast(bank.schema["embedding"].dataType)))
        found = candidates(queries, bank, width, min_score, False, one_view, **tiles)
    return _best_states(found.where(~F.col("masked")).drop("masked").join(allowed, "bank_row"), k)


def _best_states(hits: DataFrame, k: int) -> DataFrame:
    """The best hit of each task, then the best ``k`` tasks per query and view."""
    task = F.when(F.coalesce("task_id", F.lit("")) == "", F.concat(F.lit("\0"), F.col("bank_row").cast("string"))).otherwise(F.col("task_id"))
    return (
        hits.withColumn("_task", task)
        .withColumn("_t", _rank(["query_id", "view", "_task"])).where(F.col("_t") == 1)
        .withColumn("rank", _rank(["query_id", "view"])).where(F.col("rank") <= k)
        .drop("_task", "_t")
    )


def default_view(vectors: DataFrame) -> str | None:
    """The full view when the bank has it, else its first view in view order."""
    first = vectors.agg(
        F.min(F.when(F.col("view") == FULL_VIEW, -1).otherwise(view_position("view"))).alias("p")
    ).first()["p"]
    return None if first is None else FULL_VIEW if first == -1 else VIEWS[first]


def search_default(queries: DataFrame, meta: DataFrame, vectors: DataFrame, **options) -> DataFrame:
    """``search_states`` in the bank's default view for queries without view."""
    view = default_view(vectors) or FULL_VIEW
    one = vectors.where(F.col("view") == view)
    return search_states(queries.withColumn("view", F.lit(view)), meta, one, one_view=True, **options)


def search_traces(queries: DataFrame, bank: DataFrame, min_score: float = 0.0) -> DataFrame:
    """Nearest trace per query; no row when it scores below ``min_score``.

    ``bank`` has ``bank_row, task_id, experience, source, embedding``.
    """
    one = F.lit("trace").alias("view")
    found = candidates(queries.select("query_id", one, "embedding"), bank.select("bank_row", one, "embedding"), 1, min_score, one_view=True)
    return found.select("query_id", "bank_row", "score").join(bank.drop("embedding"), "bank_row")


def retrieve_trace_experience(queries: DataFrame, bank: DataFrame, min_score: float = 0.1) -> DataFrame:
    """Tagged experience of the nearest trace; '' without a hit or text."""
    hits = search_traces(queries, bank, min_score).select("query_id", "bank_row", "score", "experience", "source")
    text = F.when(
        F.coalesce("experience", F.lit("")) != "", F.concat(source_tag("source"), F.lit("\n"), F.col("experience"))
    )
    return queries.select("query_id").join(hits, "query_id", "left").select(
        "query_id", F.coalesce(text, F.lit("")).alias("trace_experience")
    )


# ---- multi-view retrieval with a budget per state ---------------------------

LIMIT_TEXT = "Retrieval limit reached for this state. Proceed with your action or answer."  # fixed value


def plan_requests(
    requests: DataFrame, states: DataFrame, max_epoch: int = 1, target_rows: int = TARGET_ROWS
) -> DataFrame:
    """Decide every search request of a state in order.

    ``requests`` has ``state_key, request_no, view``; ``states`` has ``state_key,
    available_views``. ``outcome`` is ``search`` (with its ``round``),
    ``unavailable`` (view missing or used before) or ``limit``. Adds ``remaining``,
    the unused views after the request, and the fixed ``message`` of a refusal.
    """
    joined = requests.join(states.select("state_key", "available_views"), "state_key", "left")
    known = F.coalesce(F.array_contains("available_views", F.col("view")), F.lit(False))
    first = requests.groupBy("state_key", "view").agg(F.min("request_no").alias("_first"))
    fresh = joined.join(first, ["state_key", "view"]).withColumn(
        "_new", known & (F.col("request_no") == F.col("_first"))
    )
    counted = running(
        fresh, ["state_key"], {"no": F.col("request_no")},
        {"_before": Running("sum_before", F.col("_new").cast("long"))}, target_rows=target_rows,
    )
    limit = F.col("_before") >= max_epoch
    outcome = F.when(limit, "limit").when(F.col("_new"), "search").otherwise("unavailable")
    decided = counted.withColumn("outcome", outcome).withColumn(
        "round", F.least("_before", F.lit(max_epoch)).cast("int") + (F.col("outcome") == "search").cast("int")
    )
    # At most 15 searches per state, one per view.
    used = (
        decided.where(F.col("outcome") == "search").groupBy("state_key")
        .agg(F.collect_list(F.struct("request_no", "view")).alias("_used"))
    )
    taken = F.transform(
        F.filter("_used", lambda u: u["request_no"] <= F.col("request_no")), lambda u: u["view"]
    )
    out = decided.join(used, "state_key", "left").withColumn("remaining", remaining_views("available_views", taken))
    left = F.when(F.size("remaining") > 0, F.array_join("remaining", ", ")).otherwise("(none)")
    return out.withColumn(
        "message",
        F.when(F.col("available_views").isNull(), "State context is not initialized. Proceed with your action or answer.")
        .when(F.col("outcome") == "limit", LIMIT_TEXT)
        .when(
            F.col("outcome") == "unavailable",
            F.concat(
                F.lit("View '"), F.col("view"), F.lit("' is unavailable for this round. Not-yet-used views: "), left,
                F.lit(". Proceed with your action or answer if guidance is sufficient."),
            ),
        ),
    ).withColumn(
        "is_final", (F.col("round") >= max_epoch) | (F.coalesce(F.size("remaining"), F.lit(0)) <= 0)
    ).drop("_new", "_first", "_before", "_used", "available_views")


def retrieve_states(
    requests: DataFrame,
    states: DataFrame,
    embeddings: DataFrame,
    meta: DataFrame,
    vectors: DataFrame,
    cfg: RetrievalConfig = RetrievalConfig(),
    overfetch: int | None = OVERFETCH,
) -> tuple[DataFrame, DataFrame]:
    """Decided requests and the hits of those that search.

    ``embeddings`` holds the query vector per ``(state_key, view)``.
    """
    plan = plan_requests(requests, states, cfg.max_epoch)
    queries = (
        plan.where(F.col("outcome") == "search")
        .select("state_key", "view")
        .join(embeddings, ["state_key", "view"])
        .select(F.col("state_key").alias("query_id"), "view", "embedding")
    )
    hits = search_states(
        queries, meta, vectors, cfg.experience_top_n, cfg.min_score, cfg.min_q_value, overfetch=overfetch
    )
    return plan, hits


HEADER = (  # fixed value
    "[Experiences from similar reasoning states]\n"
    "Ranked by relevance. Critically evaluate whether these experiences "
    "are helpful for making a good decision."
)
NOTHING_FOUND = "No relevant experiences were found for this view."  # fixed value
DONE = "Retrieval complete. Proceed with your action or answer."  # fixed value
MORE = (  # fixed value
    "Consider searching with a different view for additional insights "
    "before acting, unless you are confident enough to make the best decision. "
    "Not-yet-used views:\n"
)


def format_experiences(plan: DataFrame, hits: DataFrame) -> DataFrame:
    """Text shown for every search request: header, numbered experiences, footer.

    Hits per request are at most the top-k, so the ordered list is small.
    """
    tag = F.when(F.coalesce("source", F.lit("correct")) == "correct", "Learned from success").otherwise("Learned from failure")
    line = F.concat(F.lit("#"), F.col("rank").cast("string"), F.lit(" ["), tag, F.lit("]\n"), F.col("experience"))
    shown = (
        hits.where(F.coalesce("experience", F.lit("")) != "")
        .groupBy(F.col("query_id").alias("state_key"), "view")
        .agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("text")))).alias("_e"))
    )
    joined = plan.where(F.col("outcome") == "search").join(shown, ["state_key", "view"], "left")
    body = F.coalesce(F.array_join(F.transform("_e", lambda e: e["text"]), "\n\n"), F.lit(NOTHING_FOUND))
    views = F.array_join(F.transform("remaining", lambda v: F.concat(F.lit("- "), v)), "\n")
    footer = F.when(F.col("is_final"), DONE).otherwise(F.concat(F.lit(MORE), views))
    return joined.select(
        "state_key", "request_no", "view", "round", F.concat_ws("\n\n", F.lit(HEADER), body, footer).alias("text")
    )


def to_log_entry(plan: DataFrame, hits: DataFrame) -> DataFrame:
    """Log entry per request: round, view and its non-empty experiences in rank order."""
    entry = F.struct(
        "rank", "experience", F.coalesce("source", F.lit("correct")).alias("source"),
        F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("task_id", F.lit("")).alias("task_id"),
        F.coalesce(F.col("state").cast("int"), F.lit(-1)).alias("state"),
    )
    shown = (
        hits.where(F.coalesce("experience", F.lit("")) != "")
        .groupBy(F.col("query_id").alias("state_key"), "view")
        .agg(F.array_sort(F.collect_list(entry)).alias("experiences"))
        .withColumn("outcome", F.lit("search"))
    )
    joined = plan.join(shown, ["state_key", "view", "outcome"], "left")
    none = F.array().cast(shown.schema["experiences"].dataType)
    return joined.select(
        "state_key", "request_no", "round", "view", F.coalesce("experiences", none).alias("experiences")
    )


# ---- pairwise similarity of listed candidates -------------------------------


def similarity_scores(pairs: DataFrame) -> DataFrame:
    """Cosine of given (reference, candidate) pairs; ``similarity`` is rounded to 2 decimals."""
    return pairs.withColumn("_s", F.round(plain_cosine("ref_embedding", "embedding"), SCORE_DECIMALS)).withColumn(
        "similarity", F.round("_s", 2)
    )


def best_matches(scored: DataFrame) -> DataFrame:
    """Best candidate per reference on the unrounded score; the first on a tie."""
    return scored.groupBy("ref_id").agg(
        F.max_by("candidate", F.struct(F.col("_s"), -F.col("cand_pos"))).alias("best_match"),
        F.count(F.lit(1)).alias("n_candidates"),
        F.max("similarity").alias("best_similarity"),
    )

"""Vector search, banks and retrieval with a budget."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trailmark.config import RetrievalConfig
from trailmark.functions import models
from trailmark.functions import vectors as VX
from trailmark.operators import banks, search
from trailmark.plans import bindings as B
from trailmark.plans.registry import query
from trailmark.session import checkpoint_dir
from trailmark.sources import banks as stored

_DOT = "round(list_dot_product(q.v, b.v) / ((q.norm + 1e-8) * (b.norm + 1e-8)), 9)"


@query("l2_normalize", B.sql("emb", body="""
SELECT vec_id, i - 1 AS i, round(x / (norm + 1e-8), 6) + 0.0 AS value FROM (SELECT vec_id, norm, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM emb)"""))
def l2_normalize(spark, d):
    unit = F.posexplode(VX.l2_normalize("embedding")).alias("i", "value")
    return B.table(spark, d, "embeddings").select("vec_id", unit).select("vec_id", "i", F.round("value", 6).alias("value"))


_BACK = "round(list_dot_product(list_reverse(q.v), b.v) / ((q.norm + 1e-8) * (b.norm + 1e-8)), 9)"


@query("search_traces", B.sql("emb", body=f"""
SELECT query_id, bank_row, round(score, 4) AS score, 'advice ' || bank_row AS experience FROM (
  SELECT q.vec_id AS query_id, b.vec_id AS bank_row, {_BACK} AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY {_BACK} DESC, b.vec_id) AS rn FROM emb q, emb b)
WHERE rn = 1 AND score >= 0.3"""))
def search_traces(spark, d):
    """Every vector, read backwards, asks the bank of all traces."""
    e = B.table(spark, d, "embeddings")
    bank = e.select(
        F.col("vec_id").alias("bank_row"), (F.col("vec_id") % 97).cast("string").alias("task_id"),
        F.concat(F.lit("advice "), F.col("vec_id").cast("string")).alias("experience"),
        F.lit("correct").alias("source"), "embedding",
    )
    hits = search.search_traces(e.select(F.col("vec_id").alias("query_id"), F.reverse("embedding").alias("embedding")), bank, 0.3)
    return hits.select("query_id", "bank_row", F.round("score", 4).alias("score"), "experience")


_OUT = ["query_id", "view", "rank", "bank_row", "task_id", "state", "q_value"]


def _shown(hits):
    return hits.select(*_OUT, F.round("score", 4).alias("score"))


def _search_sql(k: int, min_score: float, min_q: int, window: int | None, excluded: str = "false") -> str:
    keep = f"has_vector AND score >= {min_score} AND q_value >= {min_q} AND NOT ({excluded})"
    pool = "scored" if window is None else f"""(SELECT * FROM (SELECT *, row_number() OVER (
      PARTITION BY query_id, view ORDER BY score DESC, bank_row) AS w FROM scored) WHERE w <= {window})"""
    return B.sql("scored", body=f"""
SELECT query_id, view, rank, bank_row, task_id, state::BIGINT AS state, q_value::BIGINT AS q_value, round(score, 4) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, view ORDER BY score DESC, bank_row) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, view, task_id ORDER BY score DESC, bank_row) AS t FROM {pool} WHERE {keep})
  WHERE t = 1) WHERE rank <= {k}""")


@query("search_states", _search_sql(5, 0.05, 5, 25))
def search_states(spark, d):
    return _shown(search.search_states(B.bank_queries(spark, d), *B.bank(spark, d), 5, 0.05, 5))


@query("search_states_all_scores", _search_sql(5, -1.0, 9, 25))
def search_states_all_scores(spark, d):
    """Negative scores allowed: rows without vector take part in the window with score 0."""
    return _shown(search.search_states(B.bank_queries(spark, d), *B.bank(spark, d), 5, -1.0, 9))


@query("search_states_filter_first", _search_sql(3, 0.0, 7, None))
def search_states_filter_first(spark, d):
    return _shown(search.search_states(B.bank_queries(spark, d), *B.bank(spark, d), 3, 0.0, 7, overfetch=None))


@query("search_states_by_tiles", _search_sql(5, 0.05, 5, 25))
def search_states_by_tiles(spark, d):
    """The same over many small tiles: lists of a query from several tiles are merged."""
    return _shown(search.search_states(
        B.bank_queries(spark, d), *B.bank(spark, d), 5, 0.05, 5, bank_tile=64, query_tile=100
    ))


@query("search_states_excluding", _search_sql(4, 0.05, 0, 20, "task_id IN (SELECT (doc_id % 50)::VARCHAR FROM labels WHERE toxic = 1) AND state = 1"))
def search_states_excluding(spark, d):
    pairs = B.table(spark, d, "labels").where("toxic = 1").select(
        (F.col("doc_id") % 50).cast("string").alias("task_id"), F.lit(1).alias("state")
    )
    return _shown(search.search_states(B.bank_queries(spark, d), *B.bank(spark, d), 4, 0.05, 0, exclude=pairs))


@query("search_default", B.sql("emb", body=f"""
SELECT query_id, rank, bank_row, round(score, 4) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, bank_row) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, task_id ORDER BY score DESC, bank_row) AS t FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, bank_row) AS w FROM (
        SELECT q.vec_id AS query_id, b.vec_id AS bank_row, b.task_id, {_DOT} AS score FROM emb q, emb b WHERE b.view = 'question' AND b.label <> 0))
    WHERE w <= 10 AND score >= 0.1) WHERE t = 1) WHERE rank <= 2"""))
def search_default(spark, d):
    q = B.bank_queries(spark, d).drop("view")
    hits = search.search_default(q, *B.bank(spark, d), k=2, min_score=0.1)
    return hits.select("query_id", "rank", "bank_row", F.round("score", 4).alias("score"))


@query("exclude_pairs", B.sql("emb", body="""
SELECT vec_id AS bank_row FROM emb WHERE NOT (state = 1 AND task_id IN (SELECT (doc_id % 50)::VARCHAR FROM labels WHERE toxic = 1))"""))
def exclude_pairs(spark, d):
    pairs = B.table(spark, d, "labels").where("toxic = 1").select(
        (F.col("doc_id") % 50).cast("string").alias("task_id"), F.lit(1).alias("state")
    )
    return search.exclude_pairs(B.bank(spark, d)[0], pairs).select("bank_row")


# ---- retrieval with a budget ------------------------------------------------

# A request per event: the user is the state, the event type names the view.
_REQ_VIEW = {"view": "question", "click": "task", "purchase": "images", "signup": "question+task", "error": "observations"}
_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _REQ_VIEW.items()) + " END"


def _requests(spark, d):
    view = F.create_map(*[F.lit(x) for kv in _REQ_VIEW.items() for x in kv])
    return B.table(spark, d, "events").select(
        F.col("user_id").alias("state_key"), F.col("event_id").alias("request_no"), view[F.col("event_type")].alias("view")
    )


def _request_states(spark, d):
    """Users whose id is no vector's label list lack images."""
    have = F.when(F.col("state_key") % 2 == 0, F.array(*[F.lit(v) for v in ("question", "task", "images", "question+task")])).otherwise(
        F.array(*[F.lit(v) for v in ("question", "task", "question+task")])
    )
    return _requests(spark, d).select("state_key").distinct().withColumn("available_views", have)


B.cte("requests", f"""
SELECT user_id AS state_key, event_id AS request_no, {_CASE} AS view,
  CASE WHEN user_id % 2 = 0 THEN ['question', 'task', 'images', 'question+task'] ELSE ['question', 'task', 'question+task'] END AS avail FROM events""")
B.cte("plan_before", """
SELECT *, coalesce(sum(fresh::BIGINT) OVER (PARTITION BY state_key ORDER BY request_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
FROM (SELECT *, list_contains(avail, view) AND row_number() OVER (PARTITION BY state_key, view ORDER BY request_no) = 1 AS fresh FROM requests)""", ("requests",))
B.cte("plan", """
SELECT state_key, request_no, view, avail, CASE WHEN before >= 2 THEN 'limit' WHEN fresh THEN 'search' ELSE 'unavailable' END AS outcome,
  least(before, 2)::BIGINT + (CASE WHEN before < 2 AND fresh THEN 1 ELSE 0 END) AS round FROM plan_before""", ("plan_before",))
B.cte("plan_left", """
SELECT p.*, list_filter(avail, lambda v: NOT list_contains(coalesce(used, []), v)) AS remaining FROM (
  SELECT p.state_key, p.request_no, any_value(p.view) AS view, any_value(p.avail) AS avail, any_value(p.outcome) AS outcome, any_value(p.round) AS round,
    list(s.view) FILTER (s.view IS NOT NULL) AS used
  FROM plan p LEFT JOIN (SELECT * FROM plan WHERE outcome = 'search') s ON p.state_key = s.state_key AND s.request_no <= p.request_no
  GROUP BY 1, 2) p""", ("plan",))


@query("plan_requests", B.sql("plan_left", body="""
SELECT state_key, request_no, view, outcome, round, array_to_string(remaining, ',') AS remaining,
  CASE outcome WHEN 'limit' THEN 'Retrieval limit reached for this state. Proceed with your action or answer.'
    WHEN 'unavailable' THEN 'View ''' || view || ''' is unavailable for this round. Not-yet-used views: ' ||
      CASE WHEN len(remaining) > 0 THEN array_to_string(remaining, ', ') ELSE '(none)' END || '. Proceed with your action or answer if guidance is sufficient.' END AS message
FROM plan_left"""))
def plan_requests(spark, d):
    p = search.plan_requests(_requests(spark, d), _request_states(spark, d), 2)
    return p.select(
        "state_key", "request_no", "view", "outcome", "round", F.array_join("remaining", ",").alias("remaining"), "message"
    )


@query("remaining_views", B.sql("plan_left", body="SELECT state_key, request_no, len(remaining) AS n_remaining FROM plan_left"))
def remaining_views(spark, d):
    p = search.plan_requests(_requests(spark, d), _request_states(spark, d), 2)
    return p.select("state_key", "request_no", F.size("remaining").alias("n_remaining"))


def _retrieved(spark, d):
    """Each state searches with the vector of its own number in the asked view."""
    req, states = _requests(spark, d), _request_states(spark, d)
    e = B.table(spark, d, "embeddings").select(F.col("vec_id").alias("state_key"), "embedding")
    vectors = states.select("state_key", F.explode("available_views").alias("view")).join(e, "state_key")
    meta, vec = B.bank(spark, d)
    cfg = RetrievalConfig(min_score=0.05, min_q_value=4, experience_top_n=2, max_epoch=2)
    return search.retrieve_states(req, states, vectors, meta, vec, cfg)


B.cte("hits", f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY state_key, view ORDER BY score DESC, bank_row) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY state_key, view, task_id ORDER BY score DESC, bank_row) AS t FROM (
    SELECT p.state_key, p.view, b.vec_id AS bank_row, b.task_id, b.state, b.label, {_DOT} AS score,
      row_number() OVER (PARTITION BY p.state_key, p.view ORDER BY {_DOT} DESC, b.vec_id) AS w
    FROM plan p JOIN emb q ON p.state_key = q.vec_id JOIN emb b ON b.view = p.view AND b.label <> 0 WHERE p.outcome = 'search')
  WHERE w <= 10 AND score >= 0.05 AND label >= 4) WHERE t = 1) WHERE rank <= 2""", ("plan", "emb"))


@query("retrieve_states", B.sql("hits", body="SELECT state_key, view, rank, bank_row, round(score, 4) AS score FROM hits"))
def retrieve_states(spark, d):
    hits = _retrieved(spark, d)[1]
    return hits.select(F.col("query_id").alias("state_key"), "view", "rank", "bank_row", F.round("score", 4).alias("score"))


def _sql_text(t: str) -> str:
    return "'" + t.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@query("format_experiences", B.sql("plan_left", "hits", body=f"""
SELECT p.state_key, p.request_no, md5({_sql_text(search.HEADER)} || chr(10) || chr(10) || coalesce(h.body, {_sql_text(search.NOTHING_FOUND)})
  || chr(10) || chr(10) || CASE WHEN round >= 2 OR len(remaining) = 0 THEN {_sql_text(search.DONE)}
    ELSE {_sql_text(search.MORE)} || array_to_string(list_transform(remaining, lambda v: '- ' || v), chr(10)) END) AS digest
FROM plan_left p LEFT JOIN (SELECT state_key, view, string_agg('#' || rank || ' [' || CASE WHEN label >= 5 THEN 'Learned from success' ELSE 'Learned from failure' END
    || ']' || chr(10) || 'advice ' || bank_row, chr(10) || chr(10) ORDER BY rank) AS body FROM hits WHERE label <> 3 GROUP BY 1, 2) h
  ON p.state_key = h.state_key AND p.view = h.view WHERE p.outcome = 'search'"""))
def format_experiences(spark, d):
    t = search.format_experiences(*_retrieved(spark, d))
    return t.select("state_key", "request_no", F.md5("text").alias("digest"))


@query("to_log_entry", B.sql("plan", "hits", body="""
SELECT p.state_key, p.request_no, p.round, p.view, CASE WHEN p.outcome = 'search' THEN coalesce(h.n, 0) ELSE 0 END AS n_experiences,
  CASE WHEN p.outcome = 'search' THEN coalesce(h.first, '') ELSE '' END AS first_experience
FROM plan p LEFT JOIN (SELECT state_key, view, count(*) AS n, 'advice ' || arg_min(bank_row, rank) AS first FROM hits WHERE label <> 3 GROUP BY 1, 2) h
  ON p.state_key = h.state_key AND p.view = h.view"""))
def to_log_entry(spark, d):
    log = search.to_log_entry(*_retrieved(spark, d))
    return log.select(
        "state_key", "request_no", "round", "view", F.size("experiences").alias("n_experiences"),
        F.coalesce(F.get("experiences", 0)["experience"], F.lit("")).alias("first_experience"),
    )


# ---- encoder based ----------------------------------------------------------

_BYTE = "((strpos('0123456789abcdef', substr(h, 2 * i - 1, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(h, 2 * i, 1)) - 1)"
B.cte("hashed", f"""
SELECT doc_id, list_transform(range(1, 17), lambda i: (({_BYTE}) / 255.0::DOUBLE - 0.5)::FLOAT) AS e
FROM (SELECT doc_id, md5('Question: ' || question || chr(10) || 'Task: ' || sub_task) AS h FROM traces)""", ("traces",))


@query("embed_texts", B.sql("hashed", body="""
SELECT doc_id, len(e) AS dim, """ + B.vector_digest_sql("e") + """ AS digest FROM hashed"""))
def embed_texts(spark, d):
    from trailmark.functions.text import index_text

    t = B.traces(spark, d).select("doc_id", index_text("question", "sub_task").alias("text"))
    e = models.embed(t, models.HashEncoder)
    return e.select("doc_id", F.size("embedding").alias("dim"), B.vector_digest("embedding").alias("digest"))


@query("retrieve_trace_experience", B.sql("hashed", "traces", body="""
SELECT query_id, CASE WHEN rn_score >= 0.1 AND exp <> '' THEN CASE WHEN ok THEN '[Learned from success]' ELSE '[Learned from failure]' END || chr(10) || exp ELSE '' END AS trace_experience
FROM (SELECT q.doc_id AS query_id, max(struct_pack(s := s, r := -b.doc_id)).s AS rn_score, arg_max(b.exp, struct_pack(s := s, r := -b.doc_id)) AS exp,
    arg_max(b.ok, struct_pack(s := s, r := -b.doc_id)) AS ok
  FROM (SELECT q.doc_id, b.doc_id AS bid, round(list_dot_product(q.v, b.v) / ((q.n + 1e-8) * (b.n + 1e-8)), 9) AS s
        FROM (SELECT doc_id, e::DOUBLE[] AS v, sqrt(list_dot_product(e::DOUBLE[], e::DOUBLE[])) AS n FROM hashed) q,
             (SELECT h.doc_id, e::DOUBLE[] AS v, sqrt(list_dot_product(e::DOUBLE[], e::DOUBLE[])) AS n FROM hashed h JOIN labels l ON h.doc_id = l.doc_id) b) q
  JOIN (SELECT l.doc_id, quality = 1 AS ok, CASE WHEN toxic = 1 THEN '' ELSE 'advice ' || l.doc_id END AS exp FROM labels l) b ON q.bid = b.doc_id GROUP BY 1)"""))
def retrieve_trace_experience(spark, d):
    from trailmark.functions.text import index_text

    t = B.traces(spark, d).select("doc_id", index_text("question", "sub_task").alias("text"))
    q = models.embed(t, models.HashEncoder).select(F.col("doc_id").alias("query_id"), "embedding")
    lab = B.table(spark, d, "labels").withColumnRenamed("doc_id", "query_id")
    bank = q.join(lab, "query_id").select(
        F.col("query_id").alias("bank_row"), F.format_string("%06d", "query_id").alias("task_id"),
        F.when(F.col("toxic") == 1, "").otherwise(F.concat(F.lit("advice "), F.col("query_id").cast("string"))).alias("experience"),
        F.when(F.col("quality") == 1, "correct").otherwise("incorrect").alias("source"), "embedding",
    )
    return search.retrieve_trace_experience(q, bank, 0.1)


@query("mean_pool", B.sql("emb", body="""
SELECT label::BIGINT AS label, i, round(avg(x), 5) + 0.0 AS mean FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM emb) GROUP BY 1, 2"""))
def mean_pool(spark, d):
    pooled = banks.mean_pool(B.table(spark, d, "embeddings"), "label")
    one = pooled.select("label", F.posexplode("embedding").alias("i", "m"))
    return one.select(F.col("label").cast("long").alias("label"), (F.col("i") + 1).cast("long").alias("i"), F.round(F.col("m").cast("double"), 5).alias("mean"))


@query("pool_with_fallback", B.sql("emb", body="""
SELECT r_regionkey, i - 1 AS i, round(coalesce(pooled, plain), 5) + 0.0 AS value FROM (
  SELECT r.r_regionkey::BIGINT AS r_regionkey, t.i, t.x AS plain, p.m AS pooled FROM region r
  JOIN (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM emb) t ON r.r_regionkey = t.vec_id
  LEFT JOIN (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM emb WHERE label < 3) GROUP BY 1, 2) p
    ON p.label = r.r_regionkey AND p.i = t.i)"""))
def pool_with_fallback(spark, d):
    e = B.table(spark, d, "embeddings")
    keys = B.table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("r_regionkey"))
    images = e.where("label < 3").select(F.col("label").cast("long").alias("r_regionkey"), "embedding")
    texts = e.select(F.col("vec_id").alias("r_regionkey"), "embedding")
    out = banks.with_fallback_text(keys, images, texts, "r_regionkey")
    one = out.select("r_regionkey", F.posexplode("embedding").alias("i", "x"))
    return one.select("r_regionkey", "i", F.round(F.col("x").cast("double"), 5).alias("value"))


# Every event compares the vector of its user with the vector of its own number.
B.cte("pairs", f"""
SELECT e.user_id AS ref_id, e.event_id AS cand_pos, round(list_dot_product(q.v, b.v) / (q.norm * b.norm), 9) AS s
FROM events e JOIN emb q ON e.user_id = q.vec_id JOIN emb b ON e.event_id = b.vec_id""", ("emb",))


def _pairs(spark, d):
    v = B.table(spark, d, "embeddings").select("vec_id", "embedding")
    e = B.table(spark, d, "events").select(F.col("user_id").alias("ref_id"), F.col("event_id").alias("cand_pos"))
    refs = v.select(F.col("vec_id").alias("ref_id"), F.col("embedding").alias("ref_embedding"))
    cands = v.select(F.col("vec_id").alias("cand_pos"), "embedding")
    pairs = e.join(refs, "ref_id").join(cands, "cand_pos").withColumn("candidate", F.col("cand_pos").cast("string"))
    return search.similarity_scores(pairs)


@query("similarity_scores", B.sql("pairs", body="SELECT ref_id, cand_pos, round(s, 2) + 0.0 AS similarity FROM pairs"))
def similarity_scores(spark, d):
    return _pairs(spark, d).select("ref_id", "cand_pos", "similarity")


@query("best_matches", B.sql("pairs", body="""
SELECT ref_id, arg_max(cand_pos, struct_pack(s := s, p := -cand_pos))::VARCHAR AS best_match, count(*) AS n_candidates, max(round(s, 2)) + 0.0 AS best_similarity
FROM pairs GROUP BY 1"""))
def best_matches(spark, d):
    return search.best_matches(_pairs(spark, d))


# ---- bank upkeep ------------------------------------------------------------


def _halves(spark, d):
    """Two banks of the same table: good and poor rows, each numbered from 0."""
    from trailmark.sources.banks import number_rows

    meta, vec = B.bank(spark, d)
    out = []
    for name, cond in (("good", F.col("q_value") >= 5), ("poor", F.col("q_value") < 5)):
        part = number_rows(meta.where(cond).withColumnRenamed("bank_row", "old"), "old", "bank_row")
        vectors = vec.withColumnRenamed("bank_row", "old").join(part.select("old", "bank_row"), "old")
        out.append((name, part.drop("old"), vectors.select("bank_row", "view", "embedding")))
    return out


B.cte("merged", """
SELECT bank_row, prefix || '_' || task_id AS task_id, state, label, view FROM (
  SELECT *, row_number() OVER (ORDER BY label < 5, vec_id) - 1 AS bank_row, CASE WHEN label >= 5 THEN 'good' ELSE 'poor' END AS prefix FROM emb)""", ("emb",))


@query("merge_banks", B.sql("merged", body="""
SELECT bank_row, task_id, state::BIGINT AS state, label::BIGINT AS q_value, CASE WHEN label <> 0 THEN view ELSE '' END AS view FROM merged"""))
def merge_banks(spark, d):
    meta, vec = banks.merge_banks(_halves(spark, d))
    return meta.join(vec.select("bank_row", "view"), "bank_row", "left").select(
        "bank_row", "task_id", F.col("state").cast("long").alias("state"), F.col("q_value").cast("long").alias("q_value"),
        F.coalesce("view", F.lit("")).alias("view"),
    )


@query("bank_stats", B.sql("emb", body="""
SELECT view, count(*) FILTER (label <> 0) AS valid, (SELECT count(*) FROM emb) AS total FROM emb GROUP BY 1"""))
def bank_stats(spark, d):
    return banks.bank_stats(*B.bank(spark, d))


@query("q_value_counts", B.sql("emb", body="SELECT task_id, label::BIGINT AS q_value, count(*) AS n FROM emb GROUP BY 1, 2"))
def q_value_counts(spark, d):
    return banks.q_value_counts(B.bank(spark, d)[0])


@query("validate_bank", B.sql("emb", body="""
SELECT 'vector without meta row' AS problem, view, count(*) AS n FROM emb WHERE label = 7 GROUP BY view
UNION ALL SELECT 'duplicate vector', view, count(*) FROM emb WHERE label = 8 GROUP BY view"""))
def validate_bank(spark, d):
    """A bank with missing meta rows (label 7) and repeated vectors (label 8)."""
    meta, vec = B.bank(spark, d)
    again = vec.join(meta.where("q_value = 8").select("bank_row"), "bank_row", "left_semi")
    return banks.validate_bank(meta.where("q_value <> 7"), vec.unionByName(again))


@query("prefix_task_id", B.sql("emb", body="SELECT vec_id, 'bank_' || task_id AS task_id FROM emb"))
def prefix_task_id(spark, d):
    from trailmark.functions.text import prefix_task_id as prefix

    return B.bank(spark, d)[0].select(F.col("bank_row").alias("vec_id"), prefix("bank", "task_id").alias("task_id"))


@query("bank_spec", """
SELECT page_id, trim(split_part(url, ':', 1)) AS prefix, trim(substr(url, strpos(url, ':') + 1)) AS path FROM pages""")
def bank_spec(spark, d):
    from trailmark.functions.text import bank_spec as spec

    return B.table(spark, d, "pages").select("page_id", spec("url").alias("s")).select("page_id", "s.prefix", "s.path")


@query("approximate_recall", B.sql("emb", body="""
SELECT view, count(*) AS n_queries, true AS nine_of_ten_found, true AS all_scores_right FROM emb GROUP BY view"""))
def approximate_recall(spark, d):
    """All rows ask the index and the exact search: are nine of ten neighbours found, and is every score the exact one?

    The bank is the whole table in each of the three views. Each score the index gives is held against the cosine of
    its two vectors, whatever rank the exact search gives the pair.
    """
    from trailmark.operators import approximate

    q, (meta, _) = B.bank_queries(spark, d), B.bank(spark, d)
    every = F.explode(F.array(*[F.lit(v) for v in B.BANK_VIEWS])).alias("view")
    vec = B.table(spark, d, "embeddings").select(F.col("vec_id").alias("bank_row"), every, "embedding")
    near = approximate.search_states_approximate(q, meta, vec, approximate.fit_cells(vec), 5, -1.0, 2)
    exact = search.search_states(q, meta, vec, 5, -1.0, 2, overfetch=None)
    hit = near.select("query_id", "view", "bank_row", F.col("score").alias("near"))
    found = exact.join(hit, ["query_id", "view", "bank_row"], "left").groupBy("view").agg(
        F.countDistinct("query_id").alias("n_queries"), (F.count("near") >= 0.9 * F.count(F.lit(1))).alias("nine_of_ten_found")
    )
    return found.join(_scores_right(hit, q, vec), "view")


def _scores_right(hit, queries, vectors):
    """Per view: is the score of every hit the cosine of its two vectors? Where an id has several vectors one must give it."""
    asked = queries.select("query_id", "view", VX.l2_normalize("embedding").alias("_q"))
    stored_units = vectors.select("bank_row", "view", VX.l2_normalize("embedding").alias("_b"))
    pairs = hit.join(asked, ["query_id", "view"]).join(stored_units, ["bank_row", "view"])
    right = F.abs(F.col("near") - F.round(VX.dot("_q", "_b"), 9)) < 1e-8
    one = pairs.groupBy("query_id", "view", "bank_row").agg(F.bool_or(right).alias("_right"))
    return one.groupBy("view").agg(F.bool_and("_right").alias("all_scores_right"))


@query("import_state_bank", B.sql("emb", body=f"""
SELECT vec_id AS bank_row, task_id, state::BIGINT AS state, label::BIGINT AS q_value, CASE WHEN label <> 0 THEN view ELSE '' END AS view,
  CASE WHEN label <> 0 THEN {B.vector_digest_sql('v')} ELSE '' END AS digest FROM emb"""))
def import_state_bank(spark, d):
    """The bank written as one JSON list and one array and mask per view, and read back by ranges."""
    path = f"{checkpoint_dir(spark)}/arrays-{uuid.uuid4().hex}"
    stored.export_state_bank(*B.bank(spark, d), path)
    meta, vec = stored.import_state_bank(spark, path)
    found = vec.select("bank_row", "view", B.vector_digest("embedding").alias("digest"))
    return meta.join(found, "bank_row", "left").select(
        "bank_row", "task_id", F.col("state").cast("long").alias("state"), F.col("q_value").cast("long").alias("q_value"),
        F.coalesce("view", F.lit("")).alias("view"), F.coalesce("digest", F.lit("")).alias("digest"),
    )


@query("import_trace_bank", B.sql("emb", body=f"""
SELECT vec_id AS bank_row, task_id, 'say "' || vec_id || '", ]' AS experience, 'correct' AS source, {B.vector_digest_sql('v')} AS digest FROM emb"""))
def import_trace_bank(spark, d):
    path = f"{checkpoint_dir(spark)}/arrays-{uuid.uuid4().hex}"
    said = F.concat(F.lit('say "'), F.col("vec_id").cast("string"), F.lit('", ]'))
    bank = B.table(spark, d, "embeddings").select(
        F.col("vec_id").alias("bank_row"), (F.col("vec_id") % 97).cast("string").alias("task_id"), said.alias("experience"),
        F.lit("correct").alias("source"), "embedding",
    )
    stored.export_trace_bank(bank, path)
    return stored.import_trace_bank(spark, path).select(
        "bank_row", "task_id", "experience", "source", B.vector_digest("embedding").alias("digest")
    )

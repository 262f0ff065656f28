"""Searches against a one-row-at-a-time replay of the rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.config import RetrievalConfig
from trailmark.operators import search, topk


def _replay(queries, meta, vectors, k, min_score, min_q, exclude=(), overfetch=5):
    out = []
    for qid, view, q in queries:
        q = np.asarray(q, dtype=float)
        q = q / (np.linalg.norm(q) + 1e-8)
        scored = []
        for row, m in meta.items():
            v = vectors.get((row, view))
            if v is None:
                scored.append((0.0, row, False))
            else:
                b = np.asarray(v, dtype=float)
                scored.append((round(float(q @ (b / (np.linalg.norm(b) + 1e-8))), 9), row, True))
        scored.sort(key=lambda s: (-s[0], s[1]))
        if overfetch:
            scored = scored[: k * overfetch]
        seen, hits = set(), []
        for score, row, on in scored:
            task, state, quality = meta[row]
            if not on:
                continue
            if score < min_score:
                break
            if (task, state) in exclude or quality < min_q or (task and task in seen):
                continue
            seen.add(task)
            hits.append((qid, view, len(hits) + 1, row, score))
            if len(hits) == k:
                break
        out += hits
    return sorted(out)


@pytest.fixture(scope="module")
def world():
    rng = np.random.default_rng(7)
    meta = {i: (["", "t1", "t2", "t3", "t4", "t5"][i % 6], i // 6, int(rng.integers(0, 11))) for i in range(120)}
    vectors = {}
    for i in meta:
        for view in ("question", "task"):
            if rng.random() < 0.7:
                vectors[(i, view)] = rng.integers(-2, 3, 4).tolist()  # many ties, some zero vectors
    queries = [(n, ("question", "task")[n % 2], rng.integers(-2, 3, 4).tolist()) for n in range(25)]
    return meta, vectors, queries


def _frames(spark, world):
    meta, vectors, queries = world
    m = spark.createDataFrame(
        [(r, t, s, q, f"e{r}", "correct") for r, (t, s, q) in meta.items()],
        "bank_row long, task_id string, state int, q_value int, experience string, source string",
    )
    v = spark.createDataFrame(
        [(r, view, [float(x) for x in e]) for (r, view), e in vectors.items()], "bank_row long, view string, embedding array<float>"
    ).repartition(3)
    q = spark.createDataFrame(
        [(n, view, [float(x) for x in e]) for n, view, e in queries], "query_id long, view string, embedding array<float>"
    )
    return q, m, v


@pytest.mark.parametrize("min_score,min_q,overfetch,tile", [
    (0.1, 3, 5, 16_384), (-1.0, 0, 5, 16_384), (-1.0, 6, 2, 7), (0.0, 4, 5, 16), (0.2, 5, None, 16_384), (-1.0, 2, None, 9),
])
def test_search_states(spark, world, min_score, min_q, overfetch, tile):
    q, m, v = _frames(spark, world)
    meta, vectors, queries = world
    exclude = {("t1", 2), ("t3", 5)}
    pairs = spark.createDataFrame(list(exclude), "task_id string, state int")
    hits = search.search_states(q, m, v, 3, min_score, min_q, pairs, overfetch, bank_tile=tile, query_tile=tile)
    got = sorted((r.query_id, r.view, r["rank"], r.bank_row, r.score) for r in hits.collect())
    want = _replay(queries, meta, vectors, 3, min_score, min_q, exclude, overfetch)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4] for g in got], [w[4] for w in want], atol=1e-8)


def test_tiles_agree(spark, world):
    q, m, v = _frames(spark, world)
    ways = [
        sorted(map(tuple, search.search_states(q, m, v, 4, 0.0, 2, overfetch=o, bank_tile=n, query_tile=t).collect()))
        for o in (5, None) for n, t in ((16_384, 65_536), (16, 4), (3, 100))
    ]
    assert ways[0] == ways[1] == ways[2] and ways[3] == ways[4] == ways[5]


def test_rows_that_leave_the_tiles(spark, world):
    """One list per query and bank tile, none longer than the width."""
    q, m, v = _frames(spark, world)
    seen = []

    def tap(lists, keys, width, per_task, merge=topk._merged):
        seen.append(lists.select("query_id", "view", F.size("best").alias("n")).collect())
        return merge(lists, keys, width, per_task)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(topk, "_merged", tap)
        search.candidates(q, v, 3, bank_tile=16, query_tile=4).count()
    per_view = {r["view"]: -(-r["count"] // 16) for r in v.groupBy("view").count().collect()}
    assert max(r["n"] for r in seen[0]) <= 3
    assert len(seen[0]) <= sum(per_view[view] for _, view, _ in world[2])


def test_search_traces(spark):
    bank = spark.createDataFrame(
        [(0, "a", "go", "correct", [1.0, 0.0]), (1, "b", "stop", "incorrect", [0.0, 1.0]), (2, "c", "", "correct", [0.0, 1.0])],
        "bank_row long, task_id string, experience string, source string, embedding array<float>",
    )
    q = spark.createDataFrame([(1, [2.0, 0.1]), (2, [0.0, 3.0]), (3, [0.0, 0.0])], "query_id long, embedding array<float>")
    got = {r.query_id: r.bank_row for r in search.search_traces(q, bank, 0.1).collect()}
    assert got == {1: 0, 2: 1}  # equal scores: lower row; zero vector: below the limit
    assert search.search_traces(q, bank, 1.1).count() == 0
    text = {r.query_id: r.trace_experience for r in search.retrieve_trace_experience(q, bank, 0.1).collect()}
    assert text == {1: "[Learned from success]\ngo", 2: "[Learned from failure]\nstop", 3: ""}


def test_request_budget(spark):
    states = spark.createDataFrame([("s", ["question", "task", "question+task"])], "state_key string, available_views array<string>")
    asked = ["question", "question", "task", "question+task+images+observations"]
    req = spark.createDataFrame(
        [("s", i, v) for i, v in enumerate(asked)] + [("x", 0, "question")], "state_key string, request_no long, view string"
    )
    plan = {(r.state_key, r.request_no): r for r in search.plan_requests(req, states, 2).collect()}
    assert [plan[("s", i)].outcome for i in range(4)] == ["search", "unavailable", "search", "limit"]
    assert [plan[("s", i)]["round"] for i in range(4)] == [1, 1, 2, 2]
    assert "Not-yet-used views: task, question+task." in plan[("s", 1)].message
    assert plan[("x", 0)].message.startswith("State context is not initialized.")
    # The same when the state's requests are cut into ranges.
    many = spark.createDataFrame(
        [("s", i, asked[i % 4]) for i in range(60)], "state_key string, request_no long, view string"
    )
    a = sorted((r.request_no, r.outcome, r["round"]) for r in search.plan_requests(many, states, 2).collect())
    b = sorted((r.request_no, r.outcome, r["round"]) for r in search.plan_requests(many, states, 2, target_rows=7).collect())
    assert a == b


def test_retrieval_text(spark):
    states = spark.createDataFrame([("s", ["question", "task"])], "state_key string, available_views array<string>")
    req = spark.createDataFrame([("s", 0, "question"), ("s", 1, "task")], "state_key string, request_no long, view string")
    emb = spark.createDataFrame([("s", "question", [1.0, 0.0]), ("s", "task", [0.0, 1.0])], "state_key string, view string, embedding array<float>")
    meta = spark.createDataFrame(
        [(0, "t", 0, 9, "do it", "correct"), (1, "u", 1, 9, "", "incorrect")],
        "bank_row long, task_id string, state int, q_value int, experience string, source string",
    )
    vec = spark.createDataFrame([(0, "question", [1.0, 0.0]), (1, "task", [0.0, 1.0])], "bank_row long, view string, embedding array<float>")
    plan, hits = search.retrieve_states(req, states, emb, meta, vec, RetrievalConfig(max_epoch=2, experience_top_n=2))
    text = {r.request_no: r.text for r in search.format_experiences(plan, hits).collect()}
    assert "#1 [Learned from success]\ndo it" in text[0] and text[0].endswith("Not-yet-used views:\n- task")
    assert search.NOTHING_FOUND in text[1] and text[1].endswith(search.DONE)
    logs = {r.request_no: r.experiences for r in search.to_log_entry(plan, hits).collect()}
    assert [e.experience for e in logs[0]] == ["do it"] and logs[1] == []


def test_similarity(spark):
    pairs = spark.createDataFrame(
        [(1, 0, "x", [1.0, 0.0], [1.0, 1.0]), (1, 1, "y", [1.0, 0.0], [2.0, 2.0]), (1, 2, "z", [1.0, 0.0], [0.0, 1.0])],
        "ref_id int, cand_pos int, candidate string, ref_embedding array<float>, embedding array<float>",
    )
    scored = search.similarity_scores(pairs)
    assert [r.similarity for r in scored.orderBy("cand_pos").collect()] == [0.71, 0.71, 0.0]
    assert search.best_matches(scored).first().best_match == "x"


def test_default_view(spark):
    v = spark.createDataFrame([(0, "task"), (1, "question+task")], "bank_row long, view string")
    assert search.default_view(v) == "task"
    full = v.withColumn("view", F.lit("question+task+images+observations"))
    assert search.default_view(full.unionByName(v)) == "question+task+images+observations"
    assert search.default_view(v.limit(0)) is None

"""Each operator against brute force, and on odd and empty tables."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trailmark.llm import elias_fano, fingerprints, language_model, near_dedup, nearest, quality, suffix_dedup, toxicity
from trailmark.llm.line_dedup import drop_repeated_lines
from trailmark.llm.mixing import mix
from trailmark.llm.near_dedup import near_duplicates
from trailmark.llm.packing import pack, plan_packs
from trailmark.llm.quality import resample

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# ---- packing ----


@pytest.mark.parametrize("size", [4096, 16])
def test_packing_places_every_id_once(odd, size):
    reader = Tokenizer.from_file(TOKENIZER)
    want = collections.Counter()
    for r in odd.collect():
        want[(r["doc_id"], tuple(reader.encode(r["text"] or "", add_special_tokens=False).ids + [2]))] += 1
    got = rows_of(pack(odd, TOKENIZER, size))
    texts = {(d, len(ids)): ids for d, ids in want}
    for p in got:
        ids = np.frombuffer(bytes(p["ids"]), "<u4").tolist()
        assert any(list(t[p["start"] : p["start"] + p["length"]]) == ids for (d, n), t in texts.items() if d == p["doc_id"] and n == p["doc_tokens"])
    assert sum(p["length"] for p in got) == sum(len(i) * n for (_, i), n in want.items())
    filled = collections.defaultdict(list)
    for p in got:
        filled[p["sequence_id"]].append((p["offset"], p["length"]))
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size


def test_packing_of_nothing(none):
    assert rows_of(pack(none, TOKENIZER)) == []


def test_plan_counts_and_padding():
    rng = np.random.default_rng(1)
    histogram = {int(k): int(v) for k, v in zip(*np.unique(np.minimum(rng.geometric(0.003, 200_000), 4096), return_counts=True))}
    plan = plan_packs(histogram, 4096, 64)
    total = sum(k * v for k, v in histogram.items())
    ends = np.append(plan.group_base[1:], plan.group_base[-1])
    assert int((plan.group_used[:-1] * ((ends - plan.group_base)[:-1] // np.array([len(c) - 1 for c in plan.group_cuts[:-1]]))).sum()) <= total
    assert len(plan.step_key) < 50_000  # follows the number of lengths, not of documents


# ---- line deduplication ----


def test_lines(odd):
    docs = [(r["doc_id"], r["text"] or "") for r in odd.collect()]

    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(LOW)

    held = collections.defaultdict(list)
    for i, t in docs:
        for k in {key(x) for x in t.split("\n")}:
            if len(k) >= 20:
                held[k].append(i)
    last = {k: max((i for i in v if i is not None), default=None) for k, v in held.items() if len(v) >= 3}
    want = collections.Counter()
    for i, t in docs:
        kept = [x for x in t.split("\n") if key(x) not in last or last[key(x)] == i]
        want[(i, len(t.split("\n")), len(t.split("\n")) - len(kept), "\n".join(kept))] += 1
    got = collections.Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in rows_of(drop_repeated_lines(odd)))
    assert got == want


# ---- nearest neighbours ----


def test_nearest(llm):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[100:120] = x[0]  # equal vectors
    rows = [(int(i), [float(v) for v in r], 1) for i, r in enumerate(x)]
    rows += [(5000, None, 1), (5050, [0.0] * 16, 1), (5100, [float("nan")] * 16, 1), (5150, [None] * 16, 1), (5200, [1.0], 1), (None, [1.0] * 16, 1), (5250, [], 1)]
    df = llm.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = collections.defaultdict(list)
    for r in sorted(rows_of(nearest.nearest(df)), key=lambda r: r["rank"]):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = 0
    assert set(got) == set(range(0, 3000, 50))
    for q, found in got.items():
        near = unit @ unit[q]
        near[q] = -2
        want = np.lexsort((np.arange(len(near)), -near.round(12)))[:5]
        hits += len({i for i, _ in found} & set(want.tolist()))
        assert all(abs(s - near[i]) < 1e-12 for i, s in found) and len(found) == 5
        assert [s for _, s in found] == sorted((s for _, s in found), reverse=True)
    assert hits >= 0.9 * 5 * len(got)
    assert [i for i, _ in got[0]] == [100, 101, 102, 103, 104]


def test_nearest_of_few(llm):
    df = llm.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["vec_id"], r["rank"]) for r in rows_of(nearest.nearest(df))] == [(0, 1, 1)]
    assert rows_of(nearest.nearest(df.limit(0))) == []


def test_block_keeps_smallest_ids_and_every_id_once():
    direction = np.array([3.0, 4.0, 0.0])
    v = np.vstack([direction * 2.0**i for i in range(30)] + [[0.0, 1.0, 1.0], [0.0, 0.0, 1.0]])
    ids = [[100 - i] for i in range(30)] + [[7], [8]]
    got = nearest._best(np.array([0]), direction[None], ids, v, 5)
    assert [x for _, x, _ in got] == [71, 72, 73, 74, 75]
    got = nearest._best(np.array([0]), direction[None], [[50]] * 30 + [[7], [8]], v, 5)
    assert [x for _, x, _ in got] == [50, 7, 8]


# ---- near duplicates ----


def brute_components(docs, n):
    sets = []
    for _, t in docs:
        w = WORD.findall((t or "").translate(LOW))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    group = list(range(len(docs)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                group[root(i)] = root(j)
    first = {}
    for i, (d, _) in enumerate(docs):
        r = root(i)
        if d is not None:
            first[r] = min(d, first.get(r, d))
    return collections.Counter((d, len(sets[i]), first.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(docs))


@pytest.mark.parametrize("words", [4, 5])
def test_near_duplicates(odd, small, words):
    for df in (odd, small):
        docs = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows_of(near_duplicates(df, words)))
        assert got == brute_components(docs, words)


@pytest.mark.parametrize(("edits", "wide"), [(4, 4096), (3, 130)])
def test_large_group_of_near_copies(llm, monkeypatch, edits, wide):
    monkeypatch.setattr(near_dedup, "BLOCK", 64)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(150)]
    docs = []
    for i in range(250):
        w = base[: 150 - 25 * (i % 2)]  # half of the sets are wider than the second limit
        for at in rng.integers(0, len(w), edits):
            w[at] = f"n{i}_{at}"
        docs.append((i, " ".join(w)))
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows_of(near_duplicates(llm.createDataFrame(docs, "doc_id long, text string"), wide=wide)))
    assert got == brute_components(docs, 4)


def test_folded_sets_lose_no_link():
    rng = np.random.default_rng(7)
    sets = [np.unique(rng.integers(0, 1 << 63, 60, dtype=np.int64).astype(np.uint64)) for _ in range(3)]
    sets[0][:2] = [1, 1 << 32]  # these two fold to one number
    sets += [np.unique(np.concatenate([sets[0][:k], sets[1]])) for k in (58, 30, 2)]
    for s in sets:
        s.sort()
    folds = [np.frombuffer(near_dedup._fold(s, 4096), np.uint32) for s in sets]
    sizes = np.array([len(s) for s in sets])
    assert len(folds[0]) == sizes[0] - 1
    for percent in (10, 30, 48, 80, 100):
        for x, f in zip(sets, folds):
            got = near_dedup._may_link(f, folds, len(x), sizes, percent)
            for y, may in zip(sets, got):
                both = len(np.intersect1d(x, y))
                assert may or 100 * both < percent * (len(x) + len(y) - both)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 1 << 63, 200).astype(np.uint64)])
    x, y = (near_dedup.circulant_signature(np.unique(s), 2000) for s in (a, b))
    assert abs((x == y).mean() - 800 / 1200) < 0.06


# ---- repeated byte strings ----


def brute_repeats(docs):
    seen, out = {}, collections.Counter()
    for i, t in docs:
        b = (t or "").encode()
        for j in range(len(b) - 49):
            if i is not None:
                seen[b[j : j + 50]] = min(i, seen.get(b[j : j + 50], i))
    for i, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - 49):
            if i is not None and seen[b[j : j + 50]] < i:
                gone[j : j + 50] = True
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0
        out[(i, len(b), int(gone.sum()), spans, bytes(x for x, g in zip(b, gone) if not g))] += 1
    return out


def test_repeats(odd, small):
    for df in (odd, small):
        docs = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        got = collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in rows_of(suffix_dedup.remove_repeats(df)))
        assert got == brute_repeats(docs)


def test_windows_of_frequent_seeds_are_dealt_further(llm, monkeypatch):
    rng = np.random.default_rng(10)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    docs = [(i, "".join("".join(rng.choice(letters, 20)) + " of the, " for _ in range(40))) for i in range(40)]
    docs += [(100 + i, docs[i][1][5:400] + "aaaa" * 20) for i in range(5)]
    df = llm.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(suffix_dedup, "HOT", 2000)
    hot = suffix_dedup.hot_keys(df, 50_000)
    data = np.frombuffer("".join(t for _, t in docs).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for _, t in docs])])

    def largest(hot):
        _, count, key, _ = suffix_dedup.super_windows(data, offsets, hot)
        return np.bincount(np.unique(key, return_inverse=True)[1], count).max()

    assert len(hot) and largest(()) > 2000 > largest(hot)
    keys = hot[0], np.unique(suffix_dedup.super_windows(data, offsets, hot)[2])  # as if two seeds parted nothing
    for some in (hot, keys):
        monkeypatch.setattr(suffix_dedup, "hot_keys", lambda rows, size: some)
        got = collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in rows_of(suffix_dedup.remove_repeats(df)))
        assert got == brute_repeats(docs)


def test_equal_hashes_of_unequal_runs_are_told_apart():
    text = np.frombuffer(b"a" * 60 + b"b" * 60 + b"a" * 60, np.uint8)
    at, count = np.array([0, 60, 120]), np.array([5, 5, 5])
    got = suffix_dedup.told_apart(text, at, count, np.zeros(3, np.uint64))
    assert got[0] == got[2] != got[1]


def test_questions_of_all_parts_are_answered_at_once(monkeypatch):
    """A shard searches each level of its trie once, however many parts ask, and the arrays that travel come back as they were."""
    class Task:
        get = classmethod(lambda cls: cls)
        partitionId = classmethod(lambda cls: 0)

    monkeypatch.setattr(language_model, "TaskContext", Task)
    texts = ["a b a b c", "b a\nb", "", None, "d d d d", "a b c a b c"]
    none = np.empty(0, np.uint64), np.empty(0, np.int64)
    asked = []
    for i, text in enumerate(texts):
        batch = pa.RecordBatch.from_pydict({"doc_id": [i], "train": [i != 5], "text": pa.array([text], pa.string())})
        for found in language_model._ask(iter([batch]), 4, none):
            asked += found.to_pandas().assign(part=i).to_dict("records")
    searched, plain = [], language_model.Level.find

    def counted(self, low, end, key):
        searched.append(len(key))
        return plain(self, low, end, key)

    monkeypatch.setattr(language_model.Level, "find", counted)
    asked = pd.DataFrame(asked)
    answers = pd.concat([language_model._answer(rows) for _, rows in asked.groupby("shard")])
    assert len(searched) == 3 * asked[asked["kind"] == 1]["shard"].nunique()
    # the last text: begin, end, a, b, c in the order of their hashes; "a b" occurs three times in the others, "b c" once
    merged = language_model._merge(answers[answers["part"] == 5], 4)
    count, count2, count3, length, _ = language_model.unpack_arrays(merged["blob"].iat[0])
    assert length.tolist() == [7]
    assert language_model.joined(count, np.int64).tolist() == [3, 4, 1, 3, 4, 1, 5]
    assert language_model.joined(count2, np.int64).tolist() == [1, 3, 1, 0, 3, 1, 1]
    assert language_model.joined(count3, np.int64).tolist() == [0, 1, 1, 0, 0, 1, 1]
    keys = np.array([5, 9, 2**32 - 1, 0, 7], np.uint32)
    assert language_model._keys(language_model._steps(keys)).tolist() == keys.tolist()
    ids = np.array([3, 0, 3, 3, 1, 0])
    travelled = language_model.unpack_arrays(language_model.pack_arrays(*language_model._ranks(ids, 4)))
    assert language_model._ids(*travelled, 4).tolist() == ids.tolist()


def test_small_buckets_share_a_call():
    """Blocks of several buckets at once give the pairs of each alone, and rows of different buckets never meet."""
    rng = np.random.default_rng(5)
    base, rows = rng.integers(0, 256, (3, 200), np.uint8), []
    folded = [np.unique(rng.integers(0, 2**32, 300, np.uint32)) for _ in base]
    for key, ci, cj, size in ((3, 0, 0, 2), (7, 0, 0, 40), (8, 0, 1, 30), (9, 1, 1, 9)):
        for x in range(size):
            kind, small = x % 3, base[x % 3].copy()
            small[rng.random(200) < 0.3 * rng.random()] += 1
            rows.append({
                "key": key, "ci": ci, "cj": cj, "chunk": ci if x % 2 else cj, "n": 300 + x % 5, "comp": x % 7, "hi": x, "lo": key,
                "small": small.tobytes(), "bands": np.array([100 + x % 4, *range(1000 + 50 * x, 1038 + 50 * x), key]), "folded": folded[kind].tobytes(),
            })
    rows = pd.DataFrame(rows)
    for best in (True, False):
        alone = [near_dedup._across(r, 80, best, 302) for _, r in rows.groupby("key")]
        got = near_dedup._across(rows.sample(frac=1, random_state=1), 80, best, 302)
        assert len(got) and (got["alo"] == got["blo"]).all()
        assert len(got) == sum(map(len, alone))
    # the plain way: every two rows of a bucket once, the first common band decides
    pairs = set()
    for (key, ci, cj), r in rows.groupby(["key", "ci", "cj"]):
        r = r.to_dict("records")
        for i, a in enumerate(r):
            for b in r[i + 1 :]:
                like = np.mean(np.frombuffer(a["small"], np.uint8) == np.frombuffer(b["small"], np.uint8))
                meet = ci == cj or a["chunk"] != b["chunk"]
                same = a["folded"] == b["folded"] or max(a["n"], b["n"]) > 302
                if meet and same and a["comp"] != b["comp"] and like >= 0.65 and a["bands"][a["bands"] == b["bands"]][0] == key:
                    pairs.add((key, min(a["hi"], b["hi"]), max(a["hi"], b["hi"])))
    assert {(r.alo, min(r.ahi, r.bhi), max(r.ahi, r.bhi)) for r in got.itertuples()} == pairs


def test_frequent_words_travel_as_codes(llm, monkeypatch):
    """Questions name listed words by 16-bit codes, the others as before, and shards read the same from both."""
    rng = np.random.default_rng(4)
    docs = [(i, " ".join(f"w{x}" for x in rng.zipf(1.3, 400) % 5000)) for i in range(200)]
    df = llm.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(language_model, "COMMON", 300)
    none, common = language_model._frequent(df, 400_000, 4)
    assert not len(none[0]) and len(common.words) == 300
    batch = pa.RecordBatch.from_pydict({"doc_id": [d for d, _ in docs], "text": [t for _, t in docs], "train": [True] * len(docs)})
    monkeypatch.setattr(language_model.TaskContext, "get", lambda: type("T", (), {"partitionId": lambda self: 0})())
    plain, coded = (next(language_model._ask(iter([batch]), 4, none, c)).to_pandas() for c in (language_model.NO_WORDS, common))
    assert coded["blob"].map(len).sum() < 0.85 * plain["blob"].map(len).sum()
    for x, y in zip(plain["blob"][1:], coded["blob"][1:]):
        for a, b in zip(language_model._question(x, language_model.NO_WORDS), language_model._question(y, common)):
            assert a.tolist() == b.tolist()
    # a batch a little over the size of a part is one part
    monkeypatch.setattr(language_model, "ASK_BYTES", sum(len(t) for _, t in docs) - 10)
    assert len(list(language_model._ask(iter([batch]), 4, none, common))) == 1


def test_windows_are_hashed_at_the_ends_of_their_runs(monkeypatch):
    """A run of some twenty windows takes two hashes, and the count of hot seeds those of frequent seeds alone."""
    hashed, plain = [], suffix_dedup._window_hashes

    def counted(*given):
        out = plain(*given)
        hashed.append(len(out))
        return out

    monkeypatch.setattr(suffix_dedup, "_window_hashes", counted)
    data = np.random.default_rng(5).integers(97, 123, 20_000).astype(np.uint8)
    start, count, _, content = suffix_dedup.super_windows(data, np.array([0, 30, 9000, 20_000]))
    assert count.sum() == (9000 - 30 - 49) + (11_000 - 49) and len(np.unique(content)) == len(start)
    assert sum(hashed) <= 2 * len(start) < count.sum() / 5
    hashed.clear()
    batch = pa.RecordBatch.from_pydict({"text": [data.tobytes().decode()]})
    (counts,) = suffix_dedup._seed_counts(iter([batch]), 1000, ())
    assert counts.num_rows == 0 and sum(hashed) == 0


def test_suffix_sort_is_a_sort():
    rng = np.random.default_rng(2)
    data = np.concatenate([rng.integers(97, 99, 4000).astype(np.uint8), np.zeros(60, np.uint8)])
    data[2000:3000] = data[:1000]
    at = rng.permutation(3900)[:1500]
    order, new = suffix_dedup.suffix_sort(data, at, 50)
    strings = [data[p : p + 50].tobytes() for p in at[order]]
    assert strings == sorted(strings)
    assert new.tolist() == [i == 0 or strings[i] != strings[i - 1] for i in range(len(strings))]


# ---- quality ----


def test_quality_keeps_clean_and_rejects_junk(llm):
    rng = np.random.default_rng(4)
    words = [f"word{i}" for i in range(300)]
    docs = [(i, " ".join(rng.choice(words, 80)) if i % 4 else " ".join(w + "###" for w in rng.choice(words, 80))) for i in range(800)]
    labels = llm.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 800, 3)] + [(1, None, None)], "doc_id long, quality int, toxic int")
    got = rows_of(resample(llm.createDataFrame(docs, "doc_id long, text string"), labels))
    assert sum(r["kept"] for r in got if r["doc_id"] % 4) >= 590 and not any(r["kept"] for r in got if r["doc_id"] % 4 == 0)


def test_quality_of_odd_and_no_rows(llm, odd, none):
    labels = llm.createDataFrame([(1, 1, 0), (1, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert len(rows_of(resample(odd, labels))) == odd.count()
    assert all(r["kept"] for r in rows_of(resample(odd, labels.limit(0))))
    assert rows_of(resample(none, labels)) == []


def test_quality_learns_from_every_labelled_document(llm, monkeypatch):
    rng = np.random.default_rng(9)
    docs = [(i, " ".join(rng.choice([f"w{j}" for j in range(40 + i % 50)], 30))) for i in range(300)]
    good = [i for i in range(300) if i % 3]
    df = llm.createDataFrame(docs, "doc_id long, text string")
    labels = llm.createDataFrame([(i, 1) for i in good], "doc_id long, quality int")
    monkeypatch.setattr(quality, "TARGETS", 20, raising=False)  # no bound on them is left
    monkeypatch.setattr(quality, "BROADCAST_IDS", 50, raising=False)  # ids meet the texts by a shuffle
    raw, target, own = np.ones(quality.BUCKETS), np.zeros(quality.BUCKETS), {}
    for i, t in docs:
        data = np.frombuffer(t.encode(), np.uint8)
        own[i] = np.bincount(quality.ngram_buckets(data, np.array([0, len(data)]))[0], minlength=quality.BUCKETS)
        raw += own[i]
        target += own[i] * (i % 3 > 0)
    target += raw / raw.sum() * max(1.0, quality.PRIOR * target.sum())
    got = {r["doc_id"]: r for r in rows_of(resample(df, labels))}
    for i, n in own.items():
        mine = target - n * (i % 3 > 0)
        ratio = np.log(mine, where=n > 0, out=np.zeros(len(n))) - np.log(mine.sum()) - np.log(raw / raw.sum())
        assert abs(got[i]["log_weight"] - n @ ratio) < 1e-6
    least = sorted(got[i]["key"] for i in good)[int(len(good) * quality.LOSS)]
    assert all(r["kept"] == (r["key"] >= least) for r in got.values())


@pytest.mark.parametrize("k", [0, 1, 37, 500])
def test_quality_draws_a_given_number(llm, k):
    docs = llm.range(300).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("a"), F.col("id") % 7, F.col("id") % 11).alias("text"))
    got = rows_of(resample(docs, docs.where("doc_id % 2 = 0").select("doc_id", F.lit(1).alias("quality")), k))
    assert sorted((r["key"] for r in got if r["kept"]), reverse=True) == sorted((r["key"] for r in got), reverse=True)[:k]


# ---- mixing ----


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    rest, full = 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in full]
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return full | share
        for s in over:
            full[s] = 2 * sizes[s]
            rest -= 2 * sizes[s]


def test_mixing(small, odd):
    for df in (small, odd):
        got = rows_of(mix(df))
        docs = collections.Counter((r["doc_id"], r["source"], len(WORD.findall(r["text"] or ""))) for r in df.collect())
        assert collections.Counter((r["doc_id"], r["source"], r["size"]) for r in got) == docs
        sizes = collections.Counter()
        for r in got:
            sizes[r["source"]] += r["size"]
        targets = brute_targets({s: n for s, n in sizes.items()})
        taken = collections.Counter()
        for r in got:
            assert abs(r["target"] - targets[r["source"]]) < 1e-6 * max(1, r["target"]) and 0 <= r["copies"] <= 2
            taken[r["source"]] += r["copies"] * r["size"]
        for s in targets:
            assert abs(taken[s] - targets[s]) <= max(r["size"] for r in got if r["source"] == s) / 2 + 1


# ---- toxicity ----


def test_toxicity(llm, odd, none):
    rng = np.random.default_rng(6)
    words = [f"{a}{b}" for a in ("ba", "ko", "li", "mu", "te") for b in ("ra", "so", "ni", "du", "pe", "fa")]
    docs, labels = [], []
    for i in range(1200):
        w = list(rng.choice(words, 60))
        if i % 8 == 0:
            for at in rng.integers(0, 60, 4):
                w[at] = rng.choice(["vilex", "grubby,", "NASTOR"])
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 8 == 0)))
    df, lab = llm.createDataFrame(docs, "doc_id long, text string"), llm.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, lab, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    held = [r for r in rows_of(toxicity.score(df, model)) if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert sum((r["score"] >= 0.3) == (r["doc_id"] % 8 == 0) for r in held) >= 0.98 * len(held)
    assert len(rows_of(toxicity.score(odd, model))) == odd.count() and rows_of(toxicity.score(none, model)) == []
    empty = toxicity.fit(none, lab.limit(0), F.lit(True))
    assert all(r["score"] == 0.5 for r in rows_of(toxicity.score(odd, empty)))


# ---- language model ----


def test_language_model(odd, small):
    for df in (odd, small):
        docs = [(r["doc_id"], r["text"]) for r in df.collect()]
        tokens = [WORD.findall((t or "").translate(LOW)) + [None] for _, t in docs]
        held = [zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d, _ in docs]
        c = collections.Counter(x for t, h in zip(tokens, held) if not h for x in t)
        n, v = sum(c.values()), len(c)
        want = sorted(
            (d is None, d or 0, h, len(t), sum(c[x] > 0 for x in t), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t), 6))
            for (d, _), h, t in zip(docs, held, tokens)
        )
        got = rows_of(language_model.score_all(df))
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
        assert all(r["score"] <= 1e-9 for r in got)


def test_language_model_of_nothing(none):
    assert rows_of(language_model.score_all(none)) == []


def test_elias_fano():
    rng = np.random.default_rng(7)
    for values in (np.array([], np.uint64), np.array([0], np.uint64), np.unique(rng.integers(0, 1 << 62, 5000)).astype(np.uint64), np.arange(3000, dtype=np.uint64), np.sort(rng.integers(0, 50, 900)).astype(np.uint64)):
        coded = elias_fano.EliasFano(values)
        asked = np.concatenate([values, values + np.uint64(1), np.array([0, 1 << 63], np.uint64)])
        at, same = coded.successor(asked)
        assert at.tolist() == np.searchsorted(values, asked).tolist()
        assert same.tolist() == np.isin(asked, values).tolist()
    assert elias_fano.EliasFano(np.arange(100_000, dtype=np.uint64)).nbytes() < 100_000


def test_trie_shares_sum_to_one():
    trie = language_model.Trie(np.array([5, 9], np.uint64), np.array([3, 4]), np.array([0, 0, 1]), np.array([1, 2, 7], np.uint32), np.array([1, 2, 4]))
    p = language_model.dequantise(trie.probability(np.array([0, 0, 1, 1]), np.array([1, 2, 7, 8], np.uint32)))
    assert abs(p[:2].sum() - 1) < 0.06 and abs(p[2] - 1) < 0.03 and p[3] == 0


def brute_scores(docs):
    """Pair score and score of each document, counted with dictionaries."""
    tokens = [WORD.findall((t or "").translate(LOW)) + [None] for _, t in docs]
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d, _ in docs]
    c, two, three, before, before2 = (collections.Counter() for _ in range(5))
    for t, h in zip(tokens, held):
        for i, w in enumerate(t if not h else []):
            c[w] += 1
            v, u = t[i - 1] if i else "\n", (t[i - 2] if i > 1 else "\n") if i else None
            two[v, w] += 1
            before[v] += 1
            if i:
                three[u, v, w] += 1
                before2[u, v] += 1
    n, v = sum(c.values()), len(c)

    def weights(grams, contexts, chance=None):
        hits, all_ = collections.Counter(), collections.Counter()
        for g, k in grams.items():
            if contexts[g[:-1] if len(g) > 2 else g[0]] > 1:
                total = contexts[g[:-1] if len(g) > 2 else g[0]] - 1
                hits[total.bit_length()] += k * (k - 1) / total
                all_[total.bit_length()] += k
        return {b: min(max((hits[b] / all_[b] - chance) / (1 - chance), 0), 0.95) for b in all_}, sum(hits.values()) / sum(all_.values())

    mix, chance = weights(two, before, sum(k * k for k in c.values()) / n**2)
    mix3, _ = weights(three, before2, chance)
    out = []
    for t in tokens:
        pair = score = 0
        for i, w in enumerate(t):
            v_, u = t[i - 1] if i else "\n", (t[i - 2] if i > 1 else "\n") if i else None
            a = mix.get(before[v_].bit_length(), 0)
            p = a * two[v_, w] / max(before[v_], 1) + (1 - a) * (c[w] + 1) / (n + v + 1)
            a = mix3.get(before2[u, v_].bit_length(), 0) if i else 0
            pair += math.log10(p)
            score += math.log10(a * three[u, v_, w] / max(before2[u, v_], 1) + (1 - a) * p)
        out.append((len(t), round(pair, 6), round(score, 6)))
    return sorted(out)


def test_longer_contexts_count(odd, small):
    for df in (odd, small):
        got = rows_of(language_model.score(df.select(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "text", (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 != 2).alias("train")), F.col("train")))
        want = brute_scores([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])
        for g, w in zip(sorted((r["n_tokens"], round(r["pair_score"], 6), round(r["score"], 6)) for r in got), want):
            assert g == pytest.approx(w, abs=1e-5)


def test_hot_contexts_are_dealt_to_several_shards(llm, monkeypatch):
    rng = np.random.default_rng(9)
    docs = [(i, " ".join(f"hot {x}" for x in rng.integers(0, 1500, 200))) for i in range(60)]
    df = llm.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    seen = []
    monkeypatch.setattr(language_model, "HOT", 1 << 10)
    monkeypatch.setattr(language_model, "SHARD_BYTES", 8192)
    hot = language_model._hot(df, 100_000, 16)
    assert len(hot[0]) and max(hot[1]) == 16
    for some in (hot, (hot[0][:0], hot[1][:0])):
        import pyarrow as pa

        batch = pa.RecordBatch.from_pydict({"doc_id": [d for d, _ in docs], "text": [t for _, t in docs], "train": [True] * len(docs)})
        monkeypatch.setattr(language_model.TaskContext, "get", lambda: type("T", (), {"partitionId": lambda self: 0})())
        rows = next(language_model._ask(iter([batch]), 16, some)).to_pandas()
        sizes = [len(language_model.unpack_arrays(b)[3]) for b in rows[rows["kind"] == 1]["blob"]]
        seen.append(max(sizes) / sum(sizes))
    assert seen[0] < 0.25 < seen[1]
    monkeypatch.undo()
    monkeypatch.setattr(language_model, "HOT", 1 << 10)
    monkeypatch.setattr(language_model, "SHARD_BYTES", 8192)
    got = sorted((r["n_tokens"], round(r["pair_score"], 6), round(r["score"], 6)) for r in rows_of(language_model.score(df.select("*", train.alias("train")), F.col("train"))))
    for g, w in zip(got, brute_scores(docs)):
        assert g == pytest.approx(w, abs=1e-5)


def test_level_searches_inside_the_range_of_its_parent():
    level = language_model.Level(3, np.array([0, 0, 2, 2]), np.array([4, 9, 4, 8], np.uint32), np.array([1, 2, 3, 300]))
    parent, key = np.array([0, 0, 1, 2, 2, 2]), np.array([9, 8, 4, 4, 8, 9], np.uint32)
    assert level.count(*level.range(parent), key).tolist() == [2, 0, 0, 3, 300, 0]
    values = np.sort(np.random.default_rng(8).integers(0, 1 << 40, 3000)).astype(np.uint64)
    assert elias_fano.EliasFano(values).at(np.arange(3000)).tolist() == values.tolist()


# ---- fingerprints ----


def test_fingerprints(odd, none):
    got = rows_of(fingerprints.fingerprints(odd).withColumn("s", fingerprints.as_string("fp")))
    by_text = collections.defaultdict(set)
    for r in got:
        by_text[r["text"]].add(r["s"])
    assert all(len(v) == 1 for v in by_text.values()) and by_text[""] == {""} and len(got) == odd.count()
    assert rows_of(fingerprints.fingerprints(none)) == []


def test_fingerprints_follow_order(llm):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join(words[:390] + ["x"]), " ".join(words[200:] + words[:200]), " ".join(f"v{i}" for i in range(400)), "w1 w2 " * 50, "w1 w2 " * 10]
    df = fingerprints.fingerprints(llm.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    pairs = df.alias("a").join(df.alias("b"), F.col("a.doc_id") < F.col("b.doc_id")).select(
        F.col("a.doc_id").alias("i"), F.col("b.doc_id").alias("j"), fingerprints.likeness("a.fp", "b.fp").alias("s")
    )
    s = {(r["i"], r["j"]): r["s"] for r in pairs.collect()}
    assert s[0, 1] > 0.8 > s[0, 2] > s[0, 3] == 0  # moved blocks change tuples whose parts swap places
    assert 0 < s[4, 5] < 1  # occurrence numbers tell repeats apart


def test_next_document(odd, small):
    for df in (odd, small):
        rows = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("of", F.xxhash64("text"))
        docs = sorted(((r["doc_id"] is None, -(r["doc_id"] or 0), r["of"], r["text"]) for r in rows.collect()))
        got = {(r["doc_id"], r["of"]): r["next_text"] for r in fingerprints.with_next(rows, ["text"]).collect()}
        for a, b in zip(docs, docs[1:] + docs[:1]):
            if a[:3] != b[:3]:
                assert got[(None if a[0] else -a[1], a[2])] in (b[3], a[3])


def test_edited_hash_of_query(llm):
    from trailmark.llm.fingerprints import op10_fingerprints

    docs = llm.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    docs = sorted(((r["doc_id"], r["text"]) for r in docs), reverse=True)
    want = {}
    for (i, t), (_, n) in zip(docs, docs[1:] + docs[:1]):
        half = len(t) // 2
        want[i] = hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest()
    assert {r["doc_id"]: r["edited_sha256"] for r in op10_fingerprints(llm, "/root/testdata/sf0.001").collect()} == want


def test_nearest_of_one_id_with_two_vectors(llm):
    """The same row asks, whatever the order of the rows."""
    rng = np.random.default_rng(8)
    x = [(int(i), [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(60, 8)))]
    x += [(0, [-v for v in x[0][1]])]
    schema = "vec_id long, embedding array<double>"
    ways = [sorted(map(tuple, nearest.nearest(llm.createDataFrame(rows, schema)).collect())) for rows in (x, x[::-1])]
    assert ways[0] == ways[1]

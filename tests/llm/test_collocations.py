"""Collocations against a plain count."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from trailmark.llm import collocations

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts_of(docs):
    f = collections.Counter()
    for lang, text in docs:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\t]+", piece)
            for k in range(1, 5):
                f.update((lang or ("und" if lang is None else ""), tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    return f


def brute(docs, min_count, top):
    f = counts_of(docs)
    rows = collections.defaultdict(list)
    longer = collections.Counter()
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= min_count}
    for (lang, p), a in candidates.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                longer[lang, p[i : i + k]] = max(longer[lang, p[i : i + k]], a)
    for (lang, p), a in candidates.items():
        if 100 * longer[lang, p] >= 80 * a:
            continue
        score, _, l, r = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        rows[lang].append((-score, -a, " ".join(p).encode(), l, r))
    total = collections.Counter()
    for (lang, p), a in f.items():
        total[lang] += a * (len(p) == 1)
    return sorted((lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for lang, x in rows.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top]))


def check(df, min_count=30, top=2000):
    want = brute([(r["lang"], r["text"]) for r in df.select("lang", "text").collect()], min_count, top)
    assert sorted(tuple(r) for r in collocations.collocations(df, min_count, top).collect()) == want
    return want


@pytest.mark.parametrize("min_count", [2, 30])
def test_against_plain_counts(odd, small, min_count):
    assert check(small, min_count)
    check(odd, min_count)


def test_long_pieces_ties_and_languages(llm):
    rng = random.Random(5)
    letters = ["a", "B", "c", "é", "x\x1cy", "中", "d'"]
    rows = [(rng.choice([None, "", "en", "de fr"]), "".join(rng.choice([*letters, " ", " ", "  ", "\t"]) + rng.choice(["", " ", " ", " ", "\x0b", "."][: rng.choice([2, 6])]) for _ in range(300))) for _ in range(40)]
    rows += [("en", "one two three four five " * 200), ("en", "same " * 300), ("en", None), ("en", " . , ; \n"), ("fr", "one two three " * 50)]
    df = llm.createDataFrame(rows, "lang string, text string")
    check(df, 3)
    check(df, 3, 7)


def test_parts_and_rehash(small, monkeypatch):
    """Text cut at separators into parts, and every hash equal to another one in its low bits."""
    before = counts_of([(r["lang"], r["text"]) for r in small.collect()])
    monkeypatch.setattr(collocations, "PART_BYTES", 500)
    chunks = collocations.parse(small).collect()
    got = collections.Counter()
    for c in chunks:
        w = c["chunk"].split(" ")
        for k in range(1, 5):
            for i in range(len(w) - k + 1 if c["last"] else min(len(w) - 3, len(w) - k + 1)):
                got[c["lang"], tuple(w[i : i + k])] += c["n"]
    assert got == before


def test_filter_lets_all_frequent_through(small):
    chunks = collocations.parse(small).cache()
    single = collocations.count_phrases(chunks, (1,)).where("n >= 5")
    found = collocations._filter(single, 1)
    plain = collocations.count_phrases(chunks, (2,)).where("n >= 5")
    sifted = collocations.count_phrases(chunks, (2,), found).where("n >= 5")
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, sifted.collect()))


def test_nothing(none):
    assert collocations.collocations(none).collect() == []
    assert none.select(F.lit(1)).count() == 0

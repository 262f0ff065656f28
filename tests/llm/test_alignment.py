"""Alignment of two tokenizers against a plain reading of whole texts."""

import bisect
import collections
import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from trailmark.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def readers():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def brute(docs, readers):
    """(doc_id, text) to sorted result rows, from whole texts."""
    a_reader, b_reader = readers
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in printable]
    letter = {chr(x): x for x in printable} | {chr(256 + i): x for i, x in enumerate(rest)}
    per_doc, held = [], collections.Counter()
    for doc_id, text in docs:
        links, groups, n_a, n_b = collections.Counter(), [], 0, 0
        if text:
            e = a_reader.encode(" " + text, add_special_tokens=False)
            a = [(i, bytes(letter[c] for c in t)) for i, t in zip(e.ids, e.tokens)]
            b = [(i, bytes([int(b_reader.id_to_piece(i)[3:5], 16)]) if b_reader.is_byte(i) else b_reader.id_to_piece(i).replace("▁", " ").encode())
                 for i in b_reader.encode(text)]
            if b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode():
                ends = [np.cumsum([len(x) for _, x in t]).tolist() for t in (a, b)]
                common = sorted(set(ends[0]) & set(ends[1]))
                groups = [([], []) for _ in common]
                for side, (t, end) in enumerate(zip((a, b), ends)):
                    for (i, _), x in zip(t, end):
                        groups[bisect.bisect_left(common, x)][side].append(i)
                for x, y in groups:
                    links.update((i, j) for i in x for j in y)
                n_a, n_b = len(a), len(b)
        held.update(set(links))
        per_doc.append((doc_id, n_a, n_b, groups, links))
    most = collections.Counter()
    for (i, _), n in held.items():
        most[i] = max(most[i], n)
    rows = []
    for doc_id, n_a, n_b, groups, links in per_doc:
        best = sum(m for (i, j), m in links.items() if held[i, j] == most[i])
        total = sum(m * held[x] for x, m in links.items())
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((doc_id, n_a, n_b, len(groups), sum(links.values()), best, total, text))
    return sorted(rows, key=repr)


def check(df, readers):
    want = brute([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()], readers)
    assert sorted((tuple(r) for r in alignment.align(df, A, B).collect()), key=repr) == want


def test_against_whole_texts(odd, small, readers):
    check(odd, readers)
    check(small, readers)


def test_odd_texts(llm, readers):
    texts = ["foo ", " foo", "  foo   bar  ", "a ▁ b", "▁", " ", "\n", "x\n  y", "é à  l'été ", "中文 文字 中", "<s> <0x41> <|endoftext|> </s>",
             "a  b 　 c", "\x00 z", "don't we'll", "́ é", "🙂🙂 🙂", "a" * 5000, "ab" * 3000 + " ab", "1 2  3   4    5" * 40, "\t\tx\r\n y", "tab\t end", ""]
    check(llm.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), readers)


def test_nothing(none):
    assert alignment.align(none, A, B).collect() == []


def test_many_blocks_and_wide_groups(small, readers, monkeypatch):
    monkeypatch.setattr(alignment, "WIDE_GROUP", 2)
    v = alignment.load(A, B)
    docs = [(r["doc_id"], r["text"]) for r in small.collect()][:20]
    plain, other = alignment.Block(0), alignment.Block(0)
    for d in docs:
        plain.add(*d)
        other.add(*d)
    wide = list(plain.rows(v, False))
    monkeypatch.setattr(alignment, "WIDE_GROUP", 1 << 16)
    assert list(other.rows(v, False)) == wide


ascending = st.sets(st.integers(0, 60)).map(lambda x: np.array(sorted(x), np.int64))


@given(ascending, ascending, st.integers(1, 9))
@settings(max_examples=200, deadline=None)
def test_pieces_find_every_common_end(a, b, work):
    i, j = alignment.diagonals(a, b, work)
    assert i[0] == j[0] == 0 and i[-1] == len(a) and j[-1] == len(b)
    assert all(0 <= x <= work for x in np.diff(i + j))
    x, y = alignment.common_ends(a, b, work)
    assert a[x].tolist() == b[y].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_query(llm, small, readers):
    want = {r[0]: r for r in brute([(r["doc_id"], r["text"]) for r in small.collect()], readers)}
    got = alignment.op11_alignment(llm, "/root/testdata/sf0.001").collect()
    assert len(got) == len(want)
    for r in got:
        w = want[r["doc_id"]]
        assert tuple(r)[:7] == w[:7]
        assert r["groups_sha256"] == (hashlib.sha256(w[7].encode()).hexdigest() if w[7] else "")

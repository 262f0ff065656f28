"""Byte-level BPE against the library that the rank file belongs to, and back to bytes."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from trailmark.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = byte_bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def check(df, library):
    want = sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()), key=repr)
    want = sorted([(i, library.encode_ordinary(t), t.encode()) for i, t in want], key=repr)
    found = byte_bpe.encode(df, PATH, public_tokenizers.PATTERN).withColumn("back", byte_bpe.decode(F.col("ids"), PATH))
    got = sorted([(r["doc_id"], list(r["ids"]), bytes(r["back"])) for r in found.collect()], key=repr)
    assert got == want


def test_ids_and_bytes(odd, small, library):
    check(odd, library)
    check(small, library)


def test_hard_words(llm, library):
    rng = random.Random(3)
    texts = ["a" * n for n in (1, 2, 3, 7, 1023, 1024, 1025, 20_000)]
    texts += ["".join(rng.choice("ab ") for _ in range(500)), "中文" * 700, "\U0001f600‍\U0001f600", "\x00\x1c 　 x"]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 0x3000), rng.randrange(0xE000, 0x2FA20)])) for _ in range(400)) for _ in range(20)]
    texts += ["<|endoftext|>", "  \n\n  x\t y   ", "I'll we've 12345 !?"]
    check(llm.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), library)


def test_every_piece_folds_to_itself(library):
    """What lets a fold step merge all pairs of one rank at once."""
    for piece, rank in RANKS.items():
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            lowest, at = min((RANKS.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
            assert lowest <= rank
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        assert byte_bpe.heap_merges(piece, RANKS) == [rank]


def test_nothing_and_empty_blocks(llm, none, monkeypatch):
    assert byte_bpe.encode(none, PATH, public_tokenizers.PATTERN).collect() == []
    empty = llm.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["ids"]) for r in byte_bpe.encode(empty, PATH, public_tokenizers.PATTERN).collect()) == [(1, []), (2, [])]


def test_small_blocks(small, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "DOCS_PER_ROW", 3)
    check(small, library)


def test_query(llm, library):
    got = {r["doc_id"]: r for r in byte_bpe.op13_byte_bpe(llm, "/root/testdata/sf0.001").collect()}
    docs = llm.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode_ordinary(d["text"] or "")
        r = got[d["doc_id"]]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((d["text"] or "").encode()).hexdigest()

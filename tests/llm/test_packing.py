"""Words that the packing tokenizer gives to the model itself."""

import public_tokenizers

from trailmark.llm import packing
from trailmark.llm.packing import WordCache


def test_latin_words_take_the_model_alone():
    """Letters with marks as well; their ids are those of the whole tokenizer."""
    cache = WordCache(public_tokenizers.path("word_bpe_49k.json"))
    letters = [chr(c) for c in range(0xC0, 0x180) if chr(c) not in "\u00d7\u00f7\u0130"]
    words = [w for a in letters for w in (a, f"x{a}y", f"{a}{a.lower()}sch,", f"An{a}?!")] + ["plain", "Stra\u00dfe;", "\u00c9LAN"]
    encode, seen = cache._encode, []
    cache._encode = lambda given: seen.extend(given) or encode(given)
    cache.learn(set(words))
    assert not any(c.isalpha() for w in seen for c in w)
    assert [cache.words[w] for w in words] == encode(words)


def test_other_words_take_the_tokenizer():
    cache = WordCache(public_tokenizers.path("word_bpe_49k.json"))
    words = ["e\u0301lan", "\u0130stanbul", "\u212aelvin", "it's", "don't,", "\u03a3\u03a3", "a1b2", "\u00aa\u00ba\u00b5", "x\u00d7y", "\u4e2d\u6587", "na\u00efve\u0301", "\u01c5x"]
    cache.learn(set(words))
    assert [cache.words[w] for w in words] == cache._encode(words)


def test_full_cache_keeps_the_words_at_hand(monkeypatch):
    """A cache that starts anew learns no word of the same texts again."""
    cache = WordCache(public_tokenizers.path("word_bpe_49k.json"))
    monkeypatch.setattr(packing, "CACHE_WORDS", 4)
    learnt, learn = [], cache.learn

    def counted(words):
        learnt.append(set(words))
        learn(words)

    cache.learn = counted
    texts = ["one two three", "three été, four two", "five"]
    got = [cache.ids([t], b"") for t in texts]
    assert learnt == [{"one", "two", "three"}, {"été,", "four"}, {"five"}]
    assert set(cache.words) == {"five"}
    assert got == [[cache._encode([t])[0]] for t in texts]

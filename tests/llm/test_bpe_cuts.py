import random

from public_tokenizers import PATTERN, path

from llm import bpe


def _coder():
    return bpe.coder.__wrapped__(path("byte_bpe_50k.tiktoken"), PATTERN)


def test_neighbours_are_apart_as_their_bytes_say():
    own, draw = _coder(), random.Random(5)
    short = [i for i, raw in own.bytes_of.items() if len(raw) < 4]
    for _ in range(20_000):
        x, y = draw.choice(short), draw.choice(short)
        assert own.apart(x, y) == (own._merge(own.bytes_of[x] + own.bytes_of[y]) == (x, y))


def test_new_words_are_mostly_cut_between_two_tokens(monkeypatch):
    own, draw, merged = _coder(), random.Random(7), []
    merge = own._merge
    monkeypatch.setattr(own, "_merge", lambda raw: merged.append(raw) or merge(raw))
    words = [" " + "".join(draw.choice(("be", "ver", "lich", "en", "tesch", "ung", "zu", "st", "ge")) for _ in range(4)) for _ in range(3_000)]
    for word in set(words):
        assert list(memoryview(own.match(word)).cast("i")) == list(merge(word.encode()))
    assert len(merged) < len(set(words)) / 10

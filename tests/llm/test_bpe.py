import hashlib
import random

import pytest
import tiktoken
from public_tokenizers import PATTERN, path

from llm import bpe
from tests.llm.texts import SHAPE, documents

RANKS = path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.coder(RANKS, PATTERN).ranks, special_tokens={})


def test_every_token_is_the_encoding_of_its_bytes():
    own = bpe.coder(RANKS, PATTERN)
    assert all(own._halves(raw) == (rank,) for raw, rank in own.ranks.items())


@pytest.mark.parametrize("leaf", [1, 2, 3, 8, 8192])
def test_any_cut_of_the_text_gives_the_library_s_ids(library, leaf, monkeypatch):
    monkeypatch.setattr(bpe, "LEAF_CHARS", leaf)
    own, draw = bpe.coder(RANKS, PATTERN), random.Random(leaf)
    pieces = ["a", "b", "'", "re", "ll", "'s", " ", "  ", "\n", "\t", "\r\n", "1", "23", "é", "é", "中", "\x00", "\x1c", "\x85", "🙂", "!", "...", "The", " the", "aaaa", "<|endoftext|>"]
    for _ in range(1500):
        text = "".join(draw.choice(pieces) for _ in range(draw.randint(0, 40)))
        ids = own.encode(text).tolist()
        assert ids == library.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 30_000, "ab" * 20_000, " " * 20_001 + "x", "'" * 9_000, "é" * 20_001, "=-" * 12_000 + "\n" * 3_000, "中" * 10_000])
def test_long_matches(library, text):
    assert bpe.coder(RANKS, PATTERN).encode(text).tolist() == library.encode_ordinary(text)


def test_joining_is_associative_and_grows_its_window():
    own = bpe.coder(RANKS, PATTERN)
    a, b, c = (own._halves(x) for x in (b"a" * 37, b"a" * 11, b"aaab"))
    assert own.join(own.join(a, b), c) == own.join(a, own.join(b, c)) == own._merge(b"a" * 51 + b"b")


def test_documents(spark, library):
    rows = documents()
    docs = spark.createDataFrame(rows, SHAPE).repartition(3)
    out = bpe.decode_ids(bpe.encode_texts(docs, RANKS, PATTERN), RANKS, PATTERN)
    assert out.columns == [*docs.columns, "ids", "decoded"]
    key = lambda i, t: (i is None, i or 0, t or "")
    got = sorted(((r["doc_id"], r["text"], r["ids"], bytes(r["decoded"])) for r in out.collect()), key=lambda r: key(*r[:2]))
    want = sorted(((r[0], r[1], library.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in rows), key=lambda r: key(*r[:2]))
    assert got == want
    clash = docs.withColumnsRenamed({"lang": "ids", "source": "decoded"})
    assert sum(len(r["ids"]) for r in bpe.encode_texts(clash, RANKS, PATTERN).collect()) == sum(len(r[2]) for r in want)
    assert bpe.decode_ids(bpe.encode_texts(docs.limit(0), RANKS, PATTERN), RANKS, PATTERN).count() == 0
    null = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert bytes(bpe.decode_ids(null, RANKS, PATTERN).first()["decoded"]) == b""


def test_query(spark, library, tmp_path):
    from llm.registry import Q

    rows = documents()
    spark.createDataFrame(rows, SHAPE).write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, text, *_ in rows:
        ids = library.encode_ordinary(text or "")
        want.append((i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((text or "").encode())))
    got = [tuple(r) for r in Q["op11_bpe"][0](spark, str(tmp_path)).collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(got, key=order) == sorted(want, key=order)

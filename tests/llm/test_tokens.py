import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from llm import tokens
from tests.llm import texts

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def _plain(text):
    return tokens._tokenizer(PATH).encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("aA'sS 1.,é́ \x1c<|>dT\n", max_size=40)))
def test_words_encode_as_whole_texts_do(text):
    assert np.frombuffer(tokens.encode([text], PATH)[0], "<u2").tolist() == _plain(text)


_LITERALS = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|endoftext", "|>", "<|"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*_LITERALS, " ", "\n", "x", "Y", "é", "É", "\u0301", "'s", "don't", "7", "\u212a"]), max_size=12))
def test_added_tokens_are_those_of_whole_texts(parts):
    text = "".join(parts)
    assert np.frombuffer(tokens.encode([text], PATH)[0], "<u2").tolist() == _plain(text)


def test_added_tokens_glued_spaced_and_in_upper_case():
    texts_ = [f"{a}{x}{b}" for x in _LITERALS[:4] for a in ("", "x", "x ", "é", "don't") for b in ("", "y", " Y", "é", "'s")]
    for text, ids in zip(texts_ * 2, tokens.encode(texts_ * 2, PATH), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == _plain(text)
    assert np.frombuffer(tokens.encode(["x<|startoftext|>y"], PATH)[0], "<u2").tolist() == [343, 49406, 344]


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 10**6))
def test_perfect_hash_is_minimal_and_refuses_strangers(n, seed):
    r = np.random.default_rng(seed)
    keys = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
    bits, slot = tokens.build_mph(keys)
    assert sorted(slot) == list(range(len(keys)))
    assert (tokens.find_slots(bits, keys) == slot).all()


def test_equal_hashes_are_refused():
    with pytest.raises(ValueError):
        tokens.build_mph(np.array([5, 5], np.uint64))


def test_store_reads_back_every_document(spark):
    rows = texts.documents()
    store = tokens.write_store(spark.createDataFrame(rows, texts.SHAPE), PATH, shard_chars=20_000, bucket_keys=5)
    out = tokens.read_documents(store, store.keys, payload=True).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, want = 0, []
    for i, text, *_ in ordered:
        ids = [*_plain(text), 1]
        want.append((str(i), start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    assert sorted((str(r["doc_id"]), r["start"], r["n_tokens"], r["ids_crc32"], r["ids"]) for r in out) == sorted(want)
    assert store.shards.count() > 1 and store.index.count() > 1
    absent = spark.createDataFrame([(10**9 + i, 0) for i in range(500)], "doc_id long, nth long")
    assert tokens.look_up(store, absent).count() == 0


def test_empty_table(spark):
    assert tokens.encode_documents(spark, spark.createDataFrame([], texts.SHAPE), PATH).collect() == []

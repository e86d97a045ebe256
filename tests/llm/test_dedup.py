import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from llm import dedup, suffixes
from tests.llm import texts


def test_difference_cover_has_every_difference():
    for v in (7, 13, 32, 64):
        cover = suffixes.difference_cover(v)
        assert {int(a - b) % v for a in cover for b in cover} == set(range(v))
        assert len(cover) <= 2.2 * v**0.5 + 1


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([1, 2, 3]))
def test_names_agree_with_the_bytes(seed, letters):
    r = np.random.default_rng(seed)
    text = np.tile(r.integers(0, letters, 150), 8).astype(np.uint8)
    text[r.integers(0, len(text), 3)] = 7
    start = np.arange(0, len(text) - 200, 32)
    names = suffixes.CoverRanks(text).names(start, 200)
    raw = text.tobytes()
    for i in range(len(start)):
        for j in range(i):
            assert (names[i] == names[j]) == (raw[start[i] : start[i] + 200] == raw[start[j] : start[j] + 200])


def _check(spark, rows, **options):
    df = spark.createDataFrame(rows, texts.SHAPE)
    got = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["n_bytes"], r["kept_sha256"]), [(s["start"], s["end"]) for s in r["removed"]]) for r in dedup.remove_repeats(df, **options).collect())
    want = []
    for row, gone in zip(rows, texts.removed([r[1] for r in rows], dedup.LENGTH), strict=True):
        raw = (row[1] or "").encode()
        padded = [False, *gone, False]
        edge = [i for i in range(len(raw) + 1) if padded[i] != padded[i + 1]]
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        want.append(((row[0] is not None, row[0] or 0, len(raw), hashlib.sha256(kept).hexdigest()), list(zip(edge[::2], edge[1::2], strict=True))))
    assert got == sorted(want)


def test_removes_what_brute_force_removes(spark):
    _check(spark, texts.documents())


def test_large_buckets_are_dealt_out_alike(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BUCKET", 1)
    _check(spark, texts.documents())


def test_a_passage_in_many_documents(spark):
    passage = texts.prose(60, 99)
    rows = [(i, texts.prose(20, 100 + i) + " " + passage + " " + texts.prose(20, 300 + i), "en", "s", 0) for i in range(40)]
    _check(spark, rows)


def test_parts_hold_every_window_once(monkeypatch):
    monkeypatch.setattr(dedup, "PART", 1024)
    text = np.arange(5000) % 251
    starts = [s + i for s, part in dedup._parts(text, 200) for i in range(len(part) - 200 + 1)]
    assert sorted(starts) == list(range(5000 - 200 + 1))


def test_empty_table_and_bad_length(spark):
    empty = spark.createDataFrame([], texts.SHAPE)
    assert dedup.remove_repeats(empty).collect() == []
    with pytest.raises(ValueError):
        dedup.remove_repeats(empty, length=100)

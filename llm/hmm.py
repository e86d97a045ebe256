"""A hidden Markov language model: Baum-Welch over all partitions, exact likelihoods by the scaled forward recursion.

A word is emitted in two steps: a state emits a symbol, the symbol a word. Every word of at least
1 / ``FREQUENT`` of all training tokens is a symbol of its own (at most ``FREQUENT`` of them); other words
share ``CLASSES`` symbols by a hash of their last bytes and are told apart by their counts; words
met once share one symbol, which also covers unknown words. So the model's tables have a
fixed size, while word counts stay in tables that Spark joins to the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.bytehash import Hashes, lower, mix, word_bounds
from scenelake.session import settle, shared_folder

STATES = 8
ROUNDS = 5
FREQUENT = 2000
CLASSES = 2048
SEGMENT = 1024
GROUP_CHARS = 12_000_000
HELD_WORDS = 1_500_000
SLICE_BYTES = 1 << 21
UNSEEN = 0.5
END, RARE, OWN = 0, 1, 2


def _word_rows(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of about ``SLICE_BYTES``: first row, then row in the slice, hash and class of each word of its texts."""
    held, size, first = [], 0, 0
    cells = [t.as_buffer() for t in texts]
    for i, cell in enumerate([*cells, None]):
        if i == len(cells) or (held and size > SLICE_BYTES):
            length = np.array([len(h) + 1 for h in held], np.int64)
            raw = lower(np.frombuffer(b" ".join([*held, b""]), np.uint8))
            start, end = word_bounds(raw)
            row = np.searchsorted(np.cumsum(length), start, side="right")
            tail = raw[end - 1].astype(np.uint64) + (raw[np.maximum(end - 2, start)].astype(np.uint64) << np.uint64(8)) + (raw[np.maximum(end - 3, start)].astype(np.uint64) << np.uint64(16))
            yield first, row, Hashes(raw).ranges(start, end).view(np.int64), (mix(tail) % np.uint64(CLASSES)).astype(np.int64)
            held, size, first = [], 0, i
        held.append(cell.to_pybytes() if cell is not None else b"")
        size += len(held[-1])


def _local_counts(grouped: DataFrame) -> DataFrame:
    """(grp, hash, class, n): the words of each group of documents and how often its training texts have them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def reduced() -> tuple[np.ndarray, ...]:
            return _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))

        for batch in batches:
            grp, train = batch.column("grp").to_numpy(), batch.column("train").to_numpy(zero_copy_only=False).astype(np.int64)
            for first, row, h, c in _word_rows(batch.column("text")):
                if len(h):
                    held.append(_summed(grp[first + row], h, c, train[first + row]))
                    size += len(held[-1][0])
                if size > HELD_WORDS:
                    held = [reduced()]
                    size = len(held[0][0])
                    if 2 * size > HELD_WORDS:  # a word may come twice in a group, as counts are summed over all rows of its hash
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["grp", "hash", "class", "n"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in reduced()], ["grp", "hash", "class", "n"])

    return grouped.mapInArrow(count, "grp long, hash long, class long, n long")


def _summed(g: np.ndarray, h: np.ndarray, c: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.lexsort((h, g))
    g, h, c, n = g[order], h[order], c[order], n[order]
    new = np.append(True, (g[1:] != g[:-1]) | (h[1:] != h[:-1]))
    return g[new], h[new], c[new], np.add.reduceat(n, np.flatnonzero(new))


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def _first_model(prior: np.ndarray, states: int) -> Model:
    noise = np.random.Generator(np.random.PCG64(11)).normal(0, 1, (states, len(prior)))
    emit = prior * np.exp(noise)
    move = np.full((states, states), 0.04 / states) + np.eye(states) * 0.96
    return Model(np.full(states, 1 / states), move, emit / emit.sum(1, keepdims=True))


def _layout(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sequences of falling length: how many are alive at each step, and where each step's rows begin."""
    alive = len(lengths) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), side="right")
    return alive, np.append(0, np.cumsum(alive))


def _by_step(sequences: list[np.ndarray], alive: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.empty(at[-1], np.int64)
    for i, s in enumerate(sequences):
        out[at[: len(s)] + i] = s
    return out


def log_likelihoods(sequences: list[np.ndarray], model: Model) -> np.ndarray:
    """log10 of each sequence's probability, exactly, by the forward recursion scaled at every step."""
    out = np.zeros(len(sequences))
    emit = np.ascontiguousarray(model.emit.T)
    order = np.argsort([-len(s) for s in sequences], kind="stable")
    for part in _batches([len(sequences[i]) for i in order]):
        rows = order[part]
        seqs = [sequences[i] for i in rows]
        alive, at = _layout(np.array([len(s) for s in seqs]))
        symbols = _by_step(seqs, alive, at)
        total, a = np.zeros(len(seqs)), None
        for t, n in enumerate(alive):
            b = emit[symbols[at[t] : at[t + 1]]]
            a = b * model.start if a is None else (a[:n] @ model.move) * b
            scale = a.sum(1)
            a /= scale[:, None]
            total[:n] += np.log10(scale)
        out[rows] = total
    return out


def _batches(lengths: list[int], tokens: int = 600_000) -> Iterator[slice]:
    first = size = 0
    for i, n in enumerate(lengths):
        if size and size + n > tokens:
            yield slice(first, i)
            first, size = i, 0
        size += n
    if size:
        yield slice(first, len(lengths))


def expected_counts(sequences: list[np.ndarray], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch's expected starts, moves and emissions of the sequences."""
    k, m = model.emit.shape
    starts, moves, emits = np.zeros(k), np.zeros((k, k)), np.zeros((k, m))
    emit, move = np.ascontiguousarray(model.emit.T).astype(np.float32), model.move.astype(np.float32)
    start = model.start.astype(np.float32)
    sequences = sorted(sequences, key=len, reverse=True)
    for part in _batches([len(s) for s in sequences]):
        seqs = sequences[part]
        alive, at = _layout(np.array([len(s) for s in seqs]))
        symbols = _by_step(seqs, alive, at)
        b = emit[symbols]
        alpha, scale = np.empty_like(b), np.empty(len(b), np.float32)
        for t, n in enumerate(alive):
            here = slice(at[t], at[t + 1])
            a = b[here] * start if t == 0 else (alpha[at[t - 1] : at[t - 1] + n] @ move) * b[here]
            scale[here] = s = a.sum(1)
            alpha[here] = a / s[:, None]
        beta = np.ones((alive[-1], k), np.float32)
        gamma = np.empty_like(alpha)
        back = move.T.copy()
        for t in range(len(alive) - 1, -1, -1):
            here = slice(at[t], at[t + 1])
            gamma[here] = alpha[here] * beta
            if t:
                step = b[here] * beta / scale[here][:, None]
                moves += alpha[at[t - 1] : at[t - 1] + alive[t]].T @ step
                beta = np.ones((alive[t - 1], k), np.float32)
                beta[: alive[t]] = step @ back
        starts += gamma[: alive[0]].sum(0)
        for s in range(k):
            emits[s] += np.bincount(symbols, gamma[:, s], minlength=m)
    return starts, moves * model.move, emits


def _symbols(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(s.as_buffer(), "<u2") for s in batch.column("symbols")]


def fit(encoded: DataFrame, prior: np.ndarray, states: int = STATES, rounds: int = ROUNDS, doubt: float = 100.0) -> Model:
    """Baum-Welch on the rows with ``train``: each round one pass, whose counts Spark sums over partitions.

    Texts are trained in segments of ``SEGMENT`` symbols. What reaches the driver is the summed table of
    states * (1 + states + symbols) numbers, of fixed size.
    """
    model, m = _first_model(prior, states), len(prior)
    for _ in range(rounds):

        def expect(batches: Iterator[pa.RecordBatch], model: Model = model) -> Iterator[pa.RecordBatch]:
            total = np.zeros(states * (1 + states + m))
            held, size = [], 0

            def add() -> None:
                nonlocal total
                total += np.concatenate([x.ravel() for x in expected_counts(held, model)])

            for batch in batches:
                for s in _symbols(batch):
                    held += [s[i : i + SEGMENT] for i in range(0, len(s), SEGMENT)]
                    size += len(s)
                    if size > 3_000_000:
                        add()
                        held, size = [], 0
            if held:
                add()
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

        total = np.zeros(states * (1 + states + m))
        for r in encoded.where("train").select("symbols").mapInArrow(expect, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).collect():
            total[r["at"]] = r["n"]
        starts, moves, emits = total[:states] + 1, total[states : states * (1 + states)].reshape(states, states) + 1, total[states * (1 + states) :].reshape(states, m) + doubt * prior
        model = Model(starts / starts.sum(), moves / moves.sum(1, keepdims=True), emits / emits.sum(1, keepdims=True))
    return model


def _settle_small(df: DataFrame) -> DataFrame:
    """As ``settle``, with stronger compression for packed numbers."""
    import uuid

    path = f"{shared_folder(df.sparkSession)}/symbols/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def score_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", is_training: Column | None = None, states: int = STATES, rounds: int = ROUNDS, group_chars: int = GROUP_CHARS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Learns from the rows where ``is_training`` holds (default: crc32 of the id's text mod 7 is not 2). Null
    texts are empty and hold the end token alone; a null id trains; repeated rows count each; without
    training rows all is unknown; other columns are ignored; an empty table gives no rows.
    """
    if is_training is None:
        is_training = F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 != 2
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.coalesce(is_training, F.lit(True)).alias("train"))
    size = source.agg(F.sum(F.length("text")).alias("chars"), F.sum(F.col("train").cast("long")).alias("train")).first()
    train_docs = size["train"] or 0
    n_groups = max(1, -(-(size["chars"] or 0) // group_chars))
    grouped = source.withColumn("grp", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_groups)))
    local = _local_counts(grouped.select("grp", "text", "train").repartition(n_groups, "grp"))
    words = settle(local.withColumn("c", F.sum("n").over(Window.partitionBy("hash"))).withColumn("one", F.row_number().over(Window.partitionBy("hash").orderBy("grp"))))

    vocabulary = words.where("one = 1 and c > 0")
    totals = vocabulary.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("c") == 1, 1).otherwise(0)).alias("once")).first()
    n, v, once = (totals["n"] or 0) + train_docs, totals["v"] + (train_docs > 0), totals["once"] or 0
    least = max(2, -(-n // FREQUENT))
    own = sorted((r["hash"], r["c"]) for r in vocabulary.where(F.col("c") >= least).select("hash", "c").collect())
    own_hash = np.array([h for h, _ in own], np.int64)
    shared = np.zeros(CLASSES, np.int64)
    for r in vocabulary.where((F.col("c") > 1) & (F.col("c") < least)).groupBy("class").agg(F.sum("c").alias("c")).collect():
        shared[r["class"]] = r["c"]
    counts = np.concatenate([[train_docs, once], [c for _, c in own], shared]).astype(float)
    prior = (counts + 1) / (counts + 1).sum()
    first_class = OWN + len(own)

    id_type = source.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {id_type}, train boolean, n_tokens long, n_known long, base_score double, word_score double, symbols binary"

    def encode(key: tuple, texts: pa.Table, lexicon: pa.Table) -> pa.Table:
        h, c, cls = (lexicon.column(x).to_numpy() for x in ("hash", "c", "class"))
        order = np.argsort(h)
        h, c, cls = h[order], c[order], cls[order]
        place = np.minimum(np.searchsorted(own_hash, h), max(0, len(own_hash) - 1))
        is_own = (own_hash[place] == h) if len(own_hash) else np.zeros(len(h), bool)
        symbol = np.where(c < 2, RARE, np.where(is_own, OWN + place, first_class + cls)).astype("<u2")
        rare = np.log10(np.where(c == 0, UNSEEN, (1 - UNSEEN) / max(1, once))) if once else np.zeros(len(h))
        inner = np.where(c < 2, rare, np.where(is_own, 0.0, np.log10(np.maximum(c, 1) / np.maximum(1, shared[cls]))))
        base = np.log10((c + 1) / (n + v + 1))
        end_base = np.log10((train_docs + 1) / (n + v + 1))
        out: list[tuple] = []
        starts = np.append(0, np.cumsum([len(chunk) for chunk in texts.column("text").chunks]))
        for first, row, words, _ in ((start + f, *x) for start, chunk in zip(starts.tolist(), texts.column("text").chunks, strict=False) for f, *x in _word_rows(chunk)):
            rows = (row.max() + 1) if len(row) else 0
            at = np.searchsorted(h, words)
            cut = np.searchsorted(row, np.arange(rows + 1))
            sums = [np.append(0.0, np.cumsum(x[at])) for x in (base, inner, c > 0)]
            while len(out) < first:
                out.append((1, int(train_docs > 0), end_base, 0.0, np.zeros(1, "<u2").tobytes()))
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                packed = symbol[at[a:b]].tobytes() + b"\0\0"
                out.append((int(b - a) + 1, int(sums[2][b] - sums[2][a]) + int(train_docs > 0), float(base[at[a:b]].sum() + end_base), float(sums[1][b] - sums[1][a]), packed))
        while len(out) < texts.num_rows:
            out.append((1, int(train_docs > 0), end_base, 0.0, np.zeros(1, "<u2").tobytes()))
        columns = list(zip(*out, strict=True)) or [[]] * 5
        types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())
        return pa.table([texts.column("doc_id"), texts.column("train"), *(pa.array(x, t) for x, t in zip(columns, types, strict=True))], ["doc_id", "train", "n_tokens", "n_known", "base_score", "word_score", "symbols"])

    encoded = _settle_small(grouped.groupBy("grp").cogroup(words.select("grp", "hash", "c", "class").groupBy("grp")).applyInArrow(encode, shape))
    model = fit(encoded, prior, states, rounds)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = log_likelihoods(_symbols(batch), model) + batch.column("word_score").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "train", "n_tokens", "n_known", "base_score")] + [pa.array(total)], ["doc_id", "train", "n_tokens", "n_known", "base_score", "score"])

    scored = encoded.mapInArrow(score, f"doc_id {id_type}, train boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")

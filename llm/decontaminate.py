"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may lie in a document with up to k = floor(max_error * m) edits. Cut into
k + 1 pieces, at least one piece then occurs unchanged. All pieces of a block of items are looked for
at once (Aho-Corasick); around each piece found, Myers' bit-parallel recurrence gives the item's
distance to the best place of the text. Nothing is shuffled: documents stream past each block.

An item too short for an edit is looked for as it stands, and only at word borders.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm.rows import packed, unpacked

MAX_ERROR = 0.05
MIN_WORDS = 1
BLOCK_CHARS = 2_000_000


def normal(text: str | None) -> str:
    """Lower case, each run of white space one space."""
    return " ".join((text or "").lower().split())


def _joined(a: str, b: str) -> bool:
    """Whether two neighbours are inside one word, as far as their scripts put blanks between words."""
    return all(c.isalnum() and (c < "\u0e00" or "\u1e00" <= c < "\u2000") for c in (a, b))


def at_borders(text: str, start: int, end: int) -> bool:
    """Whether ``text[start:end]`` cuts no word of ``text``."""
    return not (start > 0 and _joined(text[start - 1], text[start])) and not (end < len(text) and _joined(text[end - 1], text[end]))


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """``budget + 1`` pieces of near-equal length with their offsets."""
    cut = [i * len(item) // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cut, cut[1:], strict=False) if b > a]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        out[c] |= 1 << i
    return dict(out)


def myers(item_masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """The least edit distance of the item to a substring of ``text``, and where the first best one ends."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text, 1):
        eq = item_masks.get(c, 0)
        cross = (((eq & up) + up) ^ up) | eq | down
        rise, fall = down | (full & ~(cross | up)), up & cross
        score += 1 if rise & top else -1 if fall & top else 0
        rise, fall = (rise << 1) & full, (fall << 1) & full
        vertical = eq | down
        up, down = fall | (full & ~(vertical | rise)), rise & vertical
        if score < best:
            best, end = score, j
    return best, end


class Matcher:
    """Finds a block of normalised (id, item, budget) in normalised texts."""

    def __init__(self, items: list[tuple]):
        import ahocorasick

        self.items = [(key, text, budget, masks(text)) for key, text, budget in items]
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, (_, text, budget) in enumerate(items):
            for offset, piece in pieces(text, budget):
                places[piece].append((n, offset))
        self.pieces = ahocorasick.Automaton()
        for piece, where in places.items():
            self.pieces.add_word(piece, (len(piece), where))
        if places:
            self.pieces.make_automaton()

    def find(self, text: str) -> list[tuple]:
        """(id, distance, start, end) of every item within its budget, at its best place; start is the piece's estimate."""
        spans: dict[int, list[list[int]]] = defaultdict(list)
        exact: dict[int, tuple[int, int]] = {}
        if not len(self.pieces):
            return []
        for last, (size, where) in self.pieces.iter(text):
            for n, offset in where:
                _, item, budget, _ = self.items[n]
                start = last + 1 - size - offset
                if budget == 0:
                    if n not in exact and at_borders(text, start, last + 1):
                        exact[n] = (start, last + 1)
                    continue
                low, high = max(0, start - budget), start + len(item) + budget
                known = spans[n]
                if known and low <= known[-1][1]:
                    known[-1][0], known[-1][1] = min(known[-1][0], low), max(known[-1][1], high)
                else:
                    known.append([low, high])
        out = [(self.items[n][0], 0, start, end) for n, (start, end) in sorted(exact.items())]
        for n, regions in sorted(spans.items()):
            key, item, budget, mask = self.items[n]
            best = None
            for low, high in regions:
                distance, end = myers(mask, len(item), text[low:high])
                if distance <= budget and (best is None or distance < best[0]):
                    best = (distance, low + end)
            if best:
                out.append((key, best[0], max(0, best[1] - len(item)), best[1]))
        return out


def _hits(
    docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", max_error: float = MAX_ERROR, min_words: int = MIN_WORDS, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """``row``, ``text`` and ``hits`` of every document."""
    known = items.select(F.col(item_id).alias("id"), F.col(item_text).alias("text")).where("text is not null")
    blocks = max(1, -(-(known.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))
    id_type = known.schema["id"].dataType
    hit_type = T.ArrayType(T.StructType([T.StructField("item_id", id_type), *(T.StructField(c, T.LongType()) for c in ("distance", "start", "end"))]))
    known = known.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)))
    out = packed(docs, text=F.col(text), hits=F.array().cast(hit_type))
    for block in range(blocks):
        rows = sorted(((normal(r["text"]), r["id"]) for r in known.where(F.col("block") == block).collect()), key=lambda x: (x[0], str(x[1])))
        part = [(key, t, int(max_error * len(t))) for t, key in rows if len(t.split()) >= max(1, min_words)]

        def scan(batches: Iterator[pa.RecordBatch], part: list[tuple] = part) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(part)
            for batch in batches:
                at, old = batch.schema.get_field_index("hits"), batch.column("hits")
                found = [[dict(zip(("item_id", "distance", "start", "end"), h, strict=True)) for h in matcher.find(normal(t))] for t in batch.column("text").to_pylist()]
                if any(found):
                    both = pa.array([(a or []) + b for a, b in zip(old.to_pylist(), found, strict=True)], old.type)
                    batch = batch.set_column(at, batch.schema.field(at), both)
                yield batch

        out = out.mapInArrow(scan, out.schema)
    return out


def find_items(docs: DataFrame, items: DataFrame, *, hits: str = "hits", **options) -> DataFrame:
    """``docs`` with ``hits``: one struct (item_id, distance, start, end) per test item that the text holds.

    Positions are code points of the normalised text, end exclusive. Items (``item_id``, ``item_text``) are compared in blocks of about
    ``block_chars`` characters, each sent to the workers for one pass over the documents. Every item with
    a word is tested; one whose budget is 0 (under 20 characters at 5 %) is matched exactly and where it cuts
    no word of a script with blanks. A caller may hold items under ``min_words`` words to be ordinary phrases.
    Null texts, null and blank items match nothing; equal items each get their own hit; an empty table of either kind gives empty hits; ``hits``
    replaces a column of its name.
    """
    return unpacked(_hits(docs, items, **options), docs.columns, **{hits: F.col("hits")})


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no test item, with their columns; options as in ``find_items``."""
    return unpacked(_hits(docs, items, **options).where(F.size("hits") == 0), docs.columns)

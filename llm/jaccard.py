"""Exact n-gram Jaccard join by signature trees.

1. Documents with equal shingle sets form a class. A fixed order of all shingles puts frequent ones
   last; two sets of Jaccard similarity >= t share one of their first ``n - ceil(t n) + 1`` shingles
   whatever the order, so classes meet in the buckets of these prefixes. Buckets of the same members
   are kept once.
2. A bucket is walked by a signature tree: leaves are token bitmaps, a node holds the OR of its
   children, its range of set sizes, its least bit count and its range of components. A dual traversal
   drops node pairs whose largest possible overlap is below what the sizes ask for, and those within
   one component. It is done twice: with small bitmaps, after which only members that have a possible
   partner stay, and then with wide ones and the whole sets at hand: a surviving pair is tested unless
   it is joined already. So a walk hands on a spanning forest of true links and never pairs of candidates.
3. First walk: every class in its largest bucket alone, in blocks that all hold the bucket's best
   connected member. That joins groups of near copies, however large, in one pass over their rows.
4. Second walk: every bucket that still holds two components. One of more than ``BLOCK`` members is dealt
   into blocks by size; each pair of blocks whose sizes can link and that hold two components is a task of
   its own. Both walks together lose no pair of components that some link joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.bytehash import mix, shingles
from llm.graph import apart, components
from llm.quality import among
from llm.rows import packed, unpacked
from llm.streams import groups, runs
from scenelake.session import settle

CELLS = 1 << 17
FAN = 8
DENSITY = 8
DENSE = 4096
WIDE = 16
BITMAP_CELLS = 1 << 26
BLOCK = 512
FILTER_BITS = 1 << 24
PAIR_CHUNK = 1 << 15


def _need(a, b, percent: int):
    """The least overlap with which sets of these sizes reach ``percent``."""
    return -(-percent * (a + b) // (100 + percent))


def _shingles(text: pa.StringScalar, width: int) -> np.ndarray:
    raw = text.as_buffer()
    return shingles(raw, width) if raw is not None and raw.size else np.zeros(0, np.uint64)


def _cells(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(40)).astype(np.int64) & (CELLS - 1)


def signature(tokens: np.ndarray, bits: int = 0) -> np.ndarray:
    """A bitmap with a bit per token; unless ``bits`` says how many places, ``DENSITY`` a token for the first ``DENSE`` of them, two at least for all. A power of two of 64-bit words."""
    bits = max(64, bits or 1 << int(max(2 * len(tokens), DENSITY * min(len(tokens), DENSE)) - 1).bit_length())
    out = np.zeros(bits, bool)
    out[(tokens & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").view(np.uint64)


def _fold(sig: np.ndarray, words: int) -> np.ndarray:
    while len(sig) > words:
        half = len(sig) // 2
        sig = sig[:half] | sig[half:]
    return sig


class SignatureTree:
    """Leaves in the given order; level k + 1 has one node for each ``FAN`` nodes of level k.

    ``component`` numbers what is joined already and ``side`` the block a leaf is from; without them every leaf
    is alone, on one side.
    """

    def __init__(self, sigs: list[np.ndarray], sizes: np.ndarray, component: np.ndarray | None = None, side: np.ndarray | None = None):
        words = min(map(len, sigs))
        bits = np.stack([_fold(s, words) for s in sigs])
        count = np.bitwise_count(bits).sum(1).astype(np.int64)
        component = np.arange(len(sigs)) if component is None else component
        side = np.zeros(len(sigs), np.int64) if side is None else side
        self.two = bool(side.min() != side.max())
        ranges = np.stack([sizes, component, side])
        self.levels = [(bits, count, ranges, ranges)]
        while len(bits) > FAN:
            cut = np.arange(0, len(bits), FAN)
            _, _, low, high = self.levels[-1]
            bits, count = np.bitwise_or.reduceat(bits, cut, axis=0), np.minimum.reduceat(count, cut)
            self.levels.append((bits, count, np.minimum.reduceat(low, cut, axis=1), np.maximum.reduceat(high, cut, axis=1)))

    def pairs(self, percent: int, settled: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Chunks of leaf pairs i < j of different components (and sides, if there are two) that may reach ``percent``.

        With ``settled``, leaves that have come up once are settled, and pairs of two such leaves are left out.
        """
        top = len(self.levels) - 1
        work = [(top, *np.triu_indices(len(self.levels[top][0])))]
        while work:
            level, i, j = work.pop()
            if len(i) > PAIR_CHUNK:
                work += [(level, i[k : k + PAIR_CHUNK], j[k : k + PAIR_CHUNK]) for k in range(0, len(i), PAIR_CHUNK)]
                continue
            bits, count, low, high = self.levels[level]
            apart_ = ~((low[1, i] == high[1, j]) & (high[1, i] == low[1, j]))
            if self.two:
                apart_ &= ~((low[2, i] == high[2, j]) & (high[2, i] == low[2, j]))
            size_ok = (100 * high[0, i] >= percent * low[0, j]) & (100 * high[0, j] >= percent * low[0, i])
            if settled is not None and level == 0:
                apart_ &= ~(settled[i] & settled[j])
            i, j = i[apart_ & size_ok], j[apart_ & size_ok]
            both = np.bitwise_count(bits[i] & bits[j]).sum(1).astype(np.int64)
            most = np.minimum(high[0, i] - np.maximum(0, count[i] - both), high[0, j] - np.maximum(0, count[j] - both))
            ok = most >= _need(low[0, i], low[0, j], percent)
            if level == 0:
                ok &= i < j
            i, j = i[ok], j[ok]
            if level == 0:
                if len(i):
                    if settled is not None:
                        settled[i] = settled[j] = True
                    yield i, j
                continue
            below = len(self.levels[level - 1][0])
            step = np.arange(FAN)
            ci = (i[:, None, None] * FAN + step[None, :, None] + 0 * step[None, None, :]).ravel()
            cj = (j[:, None, None] * FAN + 0 * step[None, :, None] + step[None, None, :]).ravel()
            keep = (ci <= cj) & (ci < below) & (cj < below)
            work.append((level - 1, ci[keep], cj[keep]))


def _reach(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    place = np.minimum(np.searchsorted(b, a), len(b) - 1)
    shared = int((b[place] == a).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def possible(sigs: list[np.ndarray], size: np.ndarray, component: np.ndarray, side: np.ndarray, percent: int) -> np.ndarray:
    """Which leaves may reach some leaf of another component (and side). Linked sets have bitmaps of one width or of neighbouring ones."""
    number = np.unique(component, return_inverse=True)[1]
    words = np.array([len(s) for s in sigs])
    marked = np.zeros(len(sigs), bool)
    for width in np.unique(words).tolist():
        some = np.flatnonzero((words == width) | (words == 2 * width))
        some = some[np.lexsort((size[some], number[some], side[some]))]
        if len(some) > 1 and number[some].min() != number[some].max():
            for i, j in SignatureTree([_fold(sigs[k], width) for k in some.tolist()], size[some], number[some], side[some]).pairs(percent, marked[some]):
                marked[some[i]] = marked[some[j]] = True
    return marked


def forest(sets: list[np.ndarray], component: np.ndarray, side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest, over the components, of the links between them (and across the sides): places in ``sets``."""
    size = np.array([len(s) for s in sets])
    number = np.unique(component, return_inverse=True)[1]
    order = np.lexsort((size, number, side))
    bits = min(1 << int(WIDE * int(size.max()) - 1).bit_length(), max(64, 1 << (BITMAP_CELLS // len(sets)).bit_length() - 1))
    tree = SignatureTree([signature(sets[k], bits) for k in order.tolist()], size[order], number[order], side[order])
    parent = list(range(int(number.max()) + 1))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out, of, place = [], number[order].tolist(), order.tolist()
    for i, j in tree.pairs(percent):
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            x, y = root(of[a]), root(of[b])
            if x != y and _reach(sets[place[a]], sets[place[b]], percent):
                parent[y] = x
                out.append((place[a], place[b]))
    return out


def _frequency_levels(texts: DataFrame, width: int) -> np.ndarray:
    """For each hash cell how far its shingles' count lies above that of a usual cell, in halves of a standard deviation; ``CELLS`` small numbers, whatever the input.

    A shingle of many documents stands out of the cell's other ones, the more the larger the input is.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                np.add.at(total, _cells(_shingles(text, width)), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["cell", "n"])

    out = np.zeros(CELLS, np.int64)
    for r in texts.select("text").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    usual = max(1.0, float(out.mean()))
    return np.clip(2 * (out - usual) / np.sqrt(usual), 0, 65_535).astype(np.uint16)


def _sets(docs: DataFrame, levels: np.ndarray, width: int, percent: int) -> DataFrame:
    """Per document: its class (hash of the set, null without words), set size, bitmap and prefix."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, size, sig, prefix = [], [], [], []
            for text in batch.column("text"):
                t = _shingles(text, width)
                n = len(t)
                size.append(n)
                if not n:
                    for column in (cls, sig, prefix):
                        column.append(None)
                    continue
                sig.append(signature(t).tobytes())
                cls.append(int(mix(np.array([np.add.reduce(mix(t ^ np.uint64(0xA5A5A5A5))) + np.uint64(n)], np.uint64)).view(np.int64)[0]))
                rank = levels[_cells(t)]
                first = t[np.argsort(rank, kind="stable")] if rank.any() else t
                prefix.append(first[: n + (-percent * n) // 100 + 1].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("print"), pa.array(cls, pa.int64()), pa.array(size, pa.int64()), pa.array(sig, pa.binary()), pa.array(prefix, pa.list_(pa.int64()))],
                ["doc_id", "print", "class", "n", "sig", "prefix"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(scan, f"doc_id {id_type}, print long, class long, n long, sig binary, prefix array<long>")


def _once(rows: DataFrame, group: str = "token", *member: str) -> DataFrame:
    """The rows of one group, with its ``size``, for each set of members (class, and more columns) that is met in a group of two or more."""
    of = lambda salt: F.bit_xor(F.xxhash64("class", *member, F.lit(salt)))
    met = rows.groupBy(group).agg(F.count("*").alias("size"), of(0).alias("m1"), of(1).alias("m2")).where("size > 1")
    kept = settle(met.groupBy("size", "m1", "m2").agg(F.min(group).alias(group)).select(group, "size"))
    return among(rows, kept, group, FILTER_BITS).join(apart(kept, group), group)


def _texts(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(class, text) of one row of each of the classes (class, rep). Rows of one id and text are met once."""
    met = classes.select("class", F.col("rep.doc_id").alias("_i"), F.col("rep.print").alias("_p"), F.xxhash64("rep.doc_id", "rep.print").alias("row"))
    rows = among(docs, met.select(F.col("_p").alias("print")), "print").withColumn("row", F.xxhash64("doc_id", "print"))
    return rows.join(met, "row").where("doc_id <=> _i and print = _p").select("row", "class", "text").dropDuplicates(["row"]).drop("row")


def _walked(cells: DataFrame, sigs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The links (a, b: components) that trees find in cells (cell, side, class, component), each cell a group of bounded size."""
    cells = cells.dropDuplicates(["cell", "side", "class"])
    light = cells.join(sigs, "class").select("cell", "side", "class", "component", "n", "sig").repartition("cell").sortWithinPartitions("cell", "class")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "cell"):
            cell, side, component, n = (table.column(c).to_numpy() for c in ("cell", "side", "component", "n"))
            sigs = [np.frombuffer(s.as_buffer(), np.uint64) for chunk in table.column("sig").chunks for s in chunk]
            stays = np.zeros(len(cell), bool)
            for first, end in runs(cell):
                stays[first:end] = possible(sigs[first:end], n[first:end], component[first:end], side[first:end], percent)
            yield from table.select(["cell", "side", "class", "component"]).filter(pa.array(stays)).combine_chunks().to_batches()

    # What is left of a cell is often left of others too, as near copies share most of their buckets.
    left = settle(_once(settle(light.mapInArrow(mark, "cell long, side int, class long, component long")), "cell", "side").drop("size"))
    texts = _texts(classes.join(left.select("class").distinct(), "class", "left_semi"), docs)
    met = left.join(texts, "class").select("cell", "side", "component", "text").repartition("cell").sortWithinPartitions("cell")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "cell"):
            cell, side, component = (table.column(c).to_numpy() for c in ("cell", "side", "component"))
            sets = [_shingles(text, width) for chunk in table.column("text").chunks for text in chunk]
            links: list[tuple[int, int]] = []
            for first, end in runs(cell):
                links += [(first + a, first + b) for a, b in forest(sets[first:end], component[first:end], side[first:end], percent)]
            if links:
                pairs = component[np.array(links)]
                yield pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1)), pa.array(pairs.max(axis=1))], ["a", "b"])

    return met.mapInArrow(walk, "a long, b long").distinct()


def _home_cells(buckets: DataFrame) -> DataFrame:
    """Each class in its largest bucket, in blocks of some ``BLOCK`` members; the member that meets most others is in all of them."""
    home = buckets.groupBy("class").agg(F.max(F.struct("size", "token")).alias("home"), F.sum("size").alias("score")).select("class", "score", "home.token")
    hubs = home.groupBy("token").agg(F.count("*").alias("members"), F.max(F.struct("score", "class")).alias("hub")).where("members > 1")
    hubs = hubs.select("token", F.col("hub.class").alias("hub"), F.ceil(F.col("members") / BLOCK).alias("blocks"))
    dealt = home.join(apart(hubs, "token"), "token").where("class <> hub").select("token", "class", F.pmod(F.xxhash64("class"), "blocks").alias("block"))
    shared = hubs.select("token", F.col("hub").alias("class"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    return dealt.unionByName(shared).select(F.xxhash64("token", "block").alias("cell"), F.lit(0).alias("side"), "class", F.col("class").alias("component"))


def _bands(n: Column, percent: int) -> Column:
    """Sizes of linked sets lie in one band or in neighbouring ones."""
    return F.floor(F.ln(n) / F.lit(float(np.log(100 / percent)) if percent < 100 else 1.0) + F.lit(1e-9)).cast("int")


def _mixed_cells(rows: DataFrame, percent: int) -> DataFrame:
    """Block pairs of the buckets in ``rows`` (token, class, n, component) whose sizes can link and that hold two components."""
    banded = rows.withColumn("band", _bands(F.col("n"), percent)).withColumn("at", F.explode(F.array("band", F.col("band") + 1)))
    holds = banded.groupBy("token", "at").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max(F.col("at") == F.col("band")).alias("own")).where("lo <> hi and own")
    kept = banded.join(holds.select("token", "at").repartition(F.xxhash64("token", "at")), ["token", "at"], "left_semi").select("token", "class", "component", "band").distinct()
    mixed = settle(_once(kept))
    blocked = mixed.select("token", "class", "component", F.when(F.col("size") > BLOCK, F.col("band")).otherwise(0).alias("band"), F.pmod(F.xxhash64("class"), F.ceil(F.col("size") / BLOCK)).alias("sub"))
    blocks = settle(blocked.groupBy("token", "band", "sub").agg(F.min("component").alias("lo"), F.max("component").alias("hi")))
    left = blocks.select("token", F.col("band").alias("at"), F.col("sub").alias("sub1"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1"))
    right = blocks.withColumn("at", F.explode(F.array("band", F.col("band") - 1)))
    pairs = left.join(right, ["token", "at"]).where("(at <> band or sub1 <= sub) and least(lo, lo1) <> greatest(hi, hi1)")
    cell = F.xxhash64("token", "at", "sub1", "band", "sub").alias("cell")
    sides = pairs.select("token", cell, F.explode(F.when((F.col("at") == F.col("band")) & (F.col("sub1") == F.col("sub")), F.array(F.struct(F.col("at").alias("band"), F.col("sub1").alias("sub"), F.lit(0).alias("side")))).otherwise(
        F.array(F.struct(F.col("at").alias("band"), F.col("sub1").alias("sub"), F.lit(0).alias("side")), F.struct("band", "sub", F.lit(1).alias("side"))))).alias("s")).select("token", "cell", "s.*")
    return blocked.join(sides.repartition(F.xxhash64("token", "band", "sub")), ["token", "band", "sub"]).select("cell", "side", "class", "component")


def _placed(docs: DataFrame, doc_id: str, text: str, width: int, percent: int) -> DataFrame:
    """doc_id, print, n_shingles, component (a class, null without shingles) and component_id of every row."""
    if not 0 < percent <= 100 or width < 1:
        raise ValueError("percent must lie in 1..100 and width be at least 1")
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("print"))
    sets = settle(_sets(source, _frequency_levels(source, width), width, percent))
    filled = sets.where("class is not null")
    classes = settle(filled.groupBy("class").agg(F.min(F.struct("doc_id", "print")).alias("rep"), F.min("doc_id").alias("id")))
    rep = filled.select("class", "n", "prefix").dropDuplicates(["class"])
    buckets = settle(_once(rep.select(F.explode("prefix").alias("token"), "class", "n")))
    met = settle(buckets.select("class").distinct())
    sigs = settle(among(filled.select("class", "n", "sig"), met, "class").join(met, "class", "left_semi").dropDuplicates(["class"]))
    first = settle(components(_walked(_home_cells(buckets), sigs, classes, source, width, percent)))
    placed = buckets.select("token", "class", "n").join(first.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    second = components(_walked(_mixed_cells(placed, percent), sigs, classes, source, width, percent))
    second = second.select(F.col("node").alias("component"), F.col("component").alias("whole"))

    joined = classes.select("class", "id").join(first.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    joined = joined.join(second, "component", "left").select("class", "id", F.coalesce("whole", "component").alias("component"))
    named = joined.groupBy("component").agg(F.min("id").alias("component_id"))
    of_class = joined.join(named, "component").select("class", "component", "component_id")
    return sets.select("doc_id", "print", "class", F.col("n").alias("n_shingles")).join(of_class, "class", "left").select(
        "doc_id", "print", "n_shingles", "component", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def jaccard_components(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``.

    The set of a text is its distinct ``width``-word shingles, A-Z lower-cased (its whole word sequence
    if shorter). Two rows link when ``100 * intersection >= percent * union``; component_id is the
    smallest id reachable. Null texts and texts without words have no shingles and their own id. A null id
    is a row like any other, but never the smallest; rows of one id are rows of their own. Equal texts
    meet in one class and are not paired. Other columns are ignored; an empty table gives no rows.
    """
    return _placed(docs, doc_id, text, width, percent).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component of ``docs``, that of the smallest id (then of the least text hash), with its columns.

    Rows without shingles all stay; nulls and repeated rows as in ``jaccard_components``.
    """
    placed = settle(_placed(docs, doc_id, text, width, percent))
    best = placed.where("n_shingles > 0").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "print")).alias("k")).select("k.doc_id", "k.print")
    rows = packed(docs, id=F.col(doc_id), print=F.xxhash64(text), bare=~F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    stays = best.select(F.col("doc_id").alias("_i"), F.col("print").alias("_p"))
    kept = rows.where("not bare").join(stays, F.col("id").eqNullSafe(F.col("_i")) & (F.col("print") == F.col("_p")), "left_semi").dropDuplicates(["id", "print"])
    return unpacked(kept.unionByName(rows.where("bare")), docs.columns)

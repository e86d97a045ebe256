"""Token ids in binary shard files, with a minimal perfect hash index for keyed access.

A store is a folder with payload files (ids as little-endian unsigned 16-bit integers, documents in
ascending key order, nothing between them) and index files. A document's key is the 64-bit hash of its
id and of its number among rows of that id. ``key mod buckets`` names an index file; in it a minimal
perfect hash (bit arrays by level, rank by prefix count) gives the slot that holds a 32-bit
fingerprint, the shard, and the place in it: constant time per key, absent keys are refused.

Every task attempt writes a file of a new name and reports it; only names reported by the attempt that
Spark counted get into the manifest, so lost executors and speculative copies leave no half-written shard.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.bytehash import mix
from scenelake.session import settle, shared_folder

END_ID = 1
SHARD_CHARS = 16_000_000
BUCKET_KEYS = 50_000
CACHED_WORDS = 1_000_000
_PLAIN = re.compile(rb"[a-z]+|[0-9]|[^\sa-z0-9]+")
_words: dict[bytes, bytes] = {}
_pieces: dict[bytes, bytes] = {}


@cache
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    _words.clear()
    _pieces.clear()
    return Tokenizer.from_file(path)


@cache
def _added(path: str) -> tuple[re.Pattern | None, bool]:
    """What finds the tokenizer's added tokens in lower-cased bytes, and whether words can be encoded alone.

    They cannot where an added token holds white space, reaches over its ends or is looked for in
    normalised text.
    """
    added = _tokenizer(path).get_added_tokens_decoder().values()
    alone = not any(t.normalized or t.single_word or t.lstrip or t.rstrip or len(t.content.split()) != 1 for t in added)
    literals = [re.escape(t.content.encode().lower()) for t in added]
    return re.compile(b"|".join(literals)) if literals else None, alone


def _word_ids(tok, word: bytes, literal: re.Pattern | None) -> bytes:
    """Ids of one white-space-free word. Plain ASCII splits into runs whose ids are remembered too."""
    if not word.isascii() or b"'" in word or literal and literal.search(word.lower()):
        return np.array(tok.encode(word.decode(), add_special_tokens=False).ids, "<u2").tobytes()
    out = []
    for piece in _PLAIN.findall(word):
        ids = _pieces.get(piece)
        if ids is None:
            ids = _pieces[piece] = np.array([t.id for t in tok.model.tokenize(piece.decode())] if piece.isalpha() else tok.encode(piece.decode(), add_special_tokens=False).ids, "<u2").tobytes()
        out.append(ids)
    return b"".join(out)


def encode(texts: list[str | None], path: str) -> list[bytes]:
    """The ids of each whole text as packed 16-bit integers, without an end id.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its words in
    turn; words are encoded once and remembered, up to ``CACHED_WORDS`` in a worker. Added tokens are
    literals of one case: words that hold one in any case keep theirs.
    """
    tok, out = _tokenizer(path), []
    literal, alone = _added(path)
    for text in texts:
        if not alone:
            out.append(np.array(tok.encode(text or "", add_special_tokens=False).ids, "<u2").tobytes())
            continue
        raw = (text or "").encode()
        low = raw.lower()
        words = low.split()
        if literal and literal.search(low):
            words = [w if literal.search(lower) else lower for w, lower in zip(raw.split(), words, strict=True)]
        try:
            out.append(b"".join(map(_words.__getitem__, words)))
        except KeyError:
            if len(_words) > CACHED_WORDS:
                _words.clear()
                _pieces.clear()
            for w in words:
                if w not in _words:
                    _words[w] = _word_ids(tok, w, literal)
            out.append(b"".join(map(_words.__getitem__, words)))
    return out


def _open(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def _create(uri: str):
    fs, path = _open(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    return fs.open_output_stream(path)


# The minimal perfect hash -------------------------------------------------------------------


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)
    return (mix(keys + salt) % np.uint64(size)).astype(np.int64)


def build_mph(keys: np.ndarray, levels: int = 48) -> tuple[list[np.ndarray], np.ndarray]:
    """Bit arrays by level, and each key's slot in 0 .. n-1. Keys must be distinct."""
    bits, slot, left, base = [], np.zeros(len(keys), np.int64), np.arange(len(keys)), 0
    while len(left):
        if len(bits) == levels:
            raise ValueError("two keys have one hash")
        size = max(64, 2 * len(left))
        at = _place(keys[left], len(bits), size)
        alone = np.bincount(at, minlength=size) == 1
        fits = alone[at]
        rank = np.cumsum(alone) - 1
        slot[left[fits]] = base + rank[at[fits]]
        base += int(alone.sum())
        bits.append(alone)
        left = left[~fits]
    return bits, slot


def find_slots(bits: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The slot of each key, or of some other key where it is absent; -1 where no level has it."""
    slot, left, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for level, bit in enumerate(bits):
        at = _place(keys[left], level, len(bit))
        hit = bit[at]
        slot[left[hit]] = base + (np.cumsum(bit) - 1)[at[hit]]
        base += int(bit.sum())
        left = left[~hit]
    return slot


_ENTRY = np.dtype([("print", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("length", "<u8")])


def _print(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)


def write_index(uri: str, keys: np.ndarray, shard: np.ndarray, offset: np.ndarray, length: np.ndarray) -> None:
    """Layout: number of levels, bits of each, the packed bits, then one entry per slot."""
    bits, slot = build_mph(keys)
    rows = np.zeros(len(keys), _ENTRY)
    rows["print"][slot], rows["shard"][slot], rows["offset"][slot], rows["length"][slot] = _print(keys), shard, offset, length
    with _create(uri) as f:
        f.write(np.array([len(bits), *map(len, bits)], "<u8").tobytes() + b"".join(np.packbits(b).tobytes() for b in bits) + rows.tobytes())


def read_index(uri: str) -> tuple[list[np.ndarray], np.ndarray]:
    fs, path = _open(uri)
    with fs.open_input_stream(path) as f:
        raw = f.read()
    n = int(np.frombuffer(raw, "<u8", 1)[0])
    at, bits = 8 * (n + 1), []
    for size in map(int, np.frombuffer(raw, "<u8", n, 8)):
        bits.append(np.unpackbits(np.frombuffer(raw, np.uint8, -(-size // 8), at), count=size).astype(bool))
        at += -(-size // 8)
    return bits, np.frombuffer(raw, _ENTRY, -1, at)


# The store ----------------------------------------------------------------------------------


@dataclass
class TokenStore:
    """``shards`` (shard, path, base), ``index`` (bucket, path) and ``keys`` (doc_id, nth), all tables in the shared folder."""

    shards: DataFrame
    index: DataFrame
    keys: DataFrame
    buckets: int


def _key() -> Column:
    return F.xxhash64("doc_id", "nth")


def write_store(docs: DataFrame, tokenizer: str, *, folder: str | None = None, doc_id: str = "doc_id", text: str = "text", order: list[str] | None = None, end_id: int = END_ID, shard_chars: int = SHARD_CHARS, bucket_keys: int = BUCKET_KEYS) -> TokenStore:
    """Encode every whole text, append ``end_id``, and write shards and index.

    Documents lie in the shards by ascending id, or by the columns of ``order``; these also number the rows of one id then.
    Null texts are empty and hold the end id alone. A null id sorts first and is a key like any other;
    rows of one id are numbered ``nth`` from 0 by their text. Other columns are ignored; an empty table
    gives a store without shards.
    """
    spark = docs.sparkSession
    root = folder or f"{shared_folder(spark)}/tokens/{uuid.uuid4().hex}"
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    shards_wanted = max(1, -(-chars // shard_chars))
    if order:
        keyed = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.struct(*order).alias("order"))
        numbered = keyed.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("order")).cast("long") - 1)
        ordered = numbered.repartitionByRange(shards_wanted, "order").sortWithinPartitions("order").drop("order")
    else:
        ordered = rows.repartitionByRange(shards_wanted, "doc_id").sortWithinPartitions("doc_id", "text").withColumn("nth", F.lit(None).cast("long"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, path, out = TaskContext.get().partitionId(), f"{root}/ids-{uuid.uuid4().hex}.bin", None
        offset, nth, last = 0, -1, object()
        end = np.array([end_id], "<u2").tobytes()
        for batch in batches:
            if batch.num_rows == 0:
                continue
            out = out or _create(path)
            cells: list[tuple[int, int, int]] = []
            ids = batch.column("doc_id").to_pylist()
            for key, given, packed in zip(ids, batch.column("nth").to_pylist(), encode(batch.column("text").to_pylist(), tokenizer), strict=True):
                nth, last = given if given is not None else nth + 1 if key == last else 0, key
                out.write(packed + end)
                length = len(packed) // 2 + 1
                cells.append((nth, offset, length))
                offset += length
            columns = [pa.array(c, pa.int64()) for c in zip(*cells, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, pa.array([shard] * len(ids), pa.int64()), pa.array([path] * len(ids))], ["doc_id", "nth", "offset", "length", "shard", "path"])
        if out:
            out.close()

    meta = settle(ordered.mapInArrow(write, f"doc_id {id_type}, nth long, offset long, length long, shard long, path string"))
    sizes = meta.groupBy("shard", "path").agg(F.sum("length").alias("n"), F.count("*").alias("docs"))
    shards = settle(sizes.select("shard", "path", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"), "docs"))
    buckets = max(1, -(-(shards.agg(F.sum("docs")).first()[0] or 0) // bucket_keys))

    def index(bucket: tuple, group: pa.Table) -> pa.Table:
        path = f"{root}/index-{uuid.uuid4().hex}.mph"
        cols = {c: group.column(c).to_numpy() for c in ("key", "shard", "offset", "length")}
        write_index(path, cols["key"].view(np.uint64), cols["shard"], cols["offset"], cols["length"])
        return pa.table({"bucket": [bucket[0].as_py()], "index_path": [path]})

    keyed = meta.select("shard", "offset", "length", _key().alias("key")).withColumn("bucket", F.pmod("key", F.lit(buckets)))
    written = settle(keyed.groupBy("bucket").applyInArrow(index, "bucket long, index_path string"))
    return TokenStore(shards, written, meta.select("doc_id", "nth"), buckets)


def look_up(store: TokenStore, keys: DataFrame) -> DataFrame:
    """doc_id, nth, shard, offset and length of the asked (doc_id, nth) that the store has, from its index files."""
    id_type = keys.schema["doc_id"].dataType.simpleString()
    asked = keys.withColumn("key", _key()).withColumn("bucket", F.pmod("key", F.lit(store.buckets))).join(store.index, "bucket")
    parted = asked.repartition("bucket").sortWithinPartitions("bucket")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, index = None, None
        for batch in batches:
            paths = np.array(batch.column("index_path").to_pylist(), object)
            for first, end in _runs(paths):
                if paths[first] != held:
                    held, index = paths[first], read_index(paths[first])
                part = batch.slice(first, end - first)
                key = part.column("key").to_numpy().view(np.uint64)
                slot = find_slots(index[0], key)
                entry = index[1][np.maximum(slot, 0)]
                ok = (slot >= 0) & (entry["print"] == _print(key))
                got = [part.column("doc_id"), part.column("nth"), *(pa.array(entry[c].astype(np.int64)) for c in ("shard", "offset", "length"))]
                yield pa.RecordBatch.from_arrays(got, ["doc_id", "nth", "shard", "offset", "length"]).filter(pa.array(ok))

    return parted.mapInArrow(find, f"doc_id {id_type}, nth long, shard long, offset long, length long")


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    if not len(values):
        return []
    cut = np.flatnonzero(values[1:] != values[:-1]) + 1
    return list(zip([0, *cut.tolist()], [*cut.tolist(), len(values)], strict=True))


def read_documents(store: TokenStore, keys: DataFrame, payload: bool = False) -> DataFrame:
    """doc_id, nth, start, n_tokens, ids_crc32, and with ``payload`` the ids, read from the shard files through the index."""
    id_type = keys.schema["doc_id"].dataType.simpleString()
    placed = look_up(store, keys).join(store.shards, "shard").repartition("shard").sortWithinPartitions("shard", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, file = None, None
        for batch in batches:
            crc, ids = [], []
            for path, offset, length in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length")), strict=True):
                if path != held:
                    if file:
                        file.close()
                    fs, local = _open(path)
                    held, file = path, fs.open_input_file(local)
                file.seek(2 * offset)
                got = np.frombuffer(file.read(2 * length), "<u2")
                if len(got) != length:
                    raise OSError(f"{path} ends before {offset + length}")
                wide = got.astype("<u4")
                crc.append(zlib.crc32(wide.tobytes()))
                if payload:
                    ids.append(wide.astype(np.int32))
            start = pa.array(batch.column("base").to_numpy() + batch.column("offset").to_numpy())
            columns = [batch.column("doc_id"), batch.column("nth"), start, batch.column("length"), pa.array(crc, pa.int64())] + ([pa.array(ids, pa.list_(pa.int32()))] if payload else [])
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "nth", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])
        if file:
            file.close()

    return placed.mapInArrow(read, f"doc_id {id_type}, nth long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * payload)


def encode_documents(spark: SparkSession, docs: DataFrame, tokenizer: str, order: list[str] | None = None) -> DataFrame:
    """Write a store of ``docs`` and read every document back from its files."""
    store = write_store(docs, tokenizer, order=order)
    return read_documents(store, store.keys)

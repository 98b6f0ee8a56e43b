"""Token ids in binary files: ids ranked by frequency, in a byte-aligned code with separate control bytes.

A file's ids are replaced by their rank in that file (the most frequent is 0), so common ids take one
byte.  Four ranks share one control byte (two bits each: length 1 to 4); control bytes and data bytes are
separate streams, which numpy decodes by table lookup without a loop over values.

Documents are dealt to ranges of (doc_id, hash of the text), one range a task, sorted, and cut into files
of about FILE_IDS ids, each with its own rank table, so that a file decodes by itself and one pass over
the texts suffices.  Files travel in a Parquet column (one file per row), as Spark's committer makes
writing safe against lost executors.

Tokenising: a text is cut where the tokenizer's own pre-splitting cuts for certain (before a single space
or line feed between visible characters, and before punctuation that follows a letter or digit), and each
distinct piece is encoded once per worker and kept, within a bound.  The tokenizer's added token stands for its
single id; no cut falls inside it.
"""

from __future__ import annotations

import json
import math
import os
import struct
import uuid
import zlib
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_batches, documents, small_enough, shared_dir, span_hashes

FILE_IDS = 1 << 20
#: Bytes of text of a range: at least so many; beyond that both a range and their number grow with the root of all bytes
#: (1 GB each, 100,000 of them, at 100 TB), so that neither a task's share nor the list of bounds gets out of hand.
RANGE_BYTES, RANGE_ROOT = 16 << 20, 10_000
#: Pieces that a worker keeps, and how many are found before they are sorted in with the rest.
CACHED_PIECES, MERGED_PIECES = 1_500_000, 50_000
END_ID = 0

_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = True
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_LEAD = np.zeros(256, bool)
_LEAD[0xC3:0xE0] = True  # two-byte letters and marks: none of them is white space
_POINT = np.zeros(256, bool)
_POINT[list(b".,!?;:%#*$&")] = True


def piece_starts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where pieces begin: each non-empty text's start, and places at which the pre-splitting cuts for certain."""
    if not len(data):
        return np.zeros(0, np.int64)
    prev, prev2, after = np.zeros_like(data), np.zeros_like(data), np.zeros_like(data)
    prev[1:], prev2[2:], after[:-1] = data[:-1], data[:-2], data[1:]
    two = _LEAD[prev2] & ((prev & 0xC0) == 0x80)
    gap = ((data == 32) | (data == 10)) & (_VISIBLE[prev] | two) & (_VISIBLE[after] | _LEAD[after])
    letter = _ALNUM[prev] | ((prev2 == 0xC3) & (prev >= 0x80) & (prev < 0xC0) & (prev != 0x97) & (prev != 0xB7))
    cut = gap | (_POINT[data] & letter)
    edges = off[off < len(data)]
    cut[edges] = False  # what stands before or after an edge belongs to another text
    cut[off[1:][off[1:] > 0] - 1] &= ~gap[off[1:][off[1:] > 0] - 1]
    cut[edges] = True
    return np.flatnonzero(cut)


class _Table:
    """Sorted keys with a check, a place and a size by key, in as few bytes as they need."""

    def __init__(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.values = [np.zeros(0, t) for t in (np.int64, np.uint32, np.uint32)]

    def look_up(self, key: np.ndarray, out: np.ndarray) -> None:
        """Set the columns of out whose key is known."""
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = np.flatnonzero(self.keys[at] == key)
            for row, values in zip(out, self.values):
                row[known] = values[at[known]]

    def insert(self, key: np.ndarray, values: list[np.ndarray]) -> None:
        """Add keys, which are in order and new."""
        at = np.searchsorted(self.keys, key) + np.arange(len(key))
        old = np.ones(len(self.keys) + len(key), bool)
        old[at] = False

        def merged(have: np.ndarray, new: np.ndarray) -> np.ndarray:
            out = np.empty(len(old), have.dtype)
            out[at], out[old] = new, have
            return out

        self.keys = merged(self.keys, key)
        self.values = [merged(have, new) for have, new in zip(self.values, values)]


def cuts_as_known(tokenizer) -> bool:
    """Whether a tokenizer splits as piece_starts supposes: byte-level pieces by the usual pattern, nothing changed before."""
    told = json.loads(tokenizer.to_str())
    before = told.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    return plain and told.get("normalizer") is None and all(not t["lstrip"] and not t["rstrip"] for t in told["added_tokens"])


class Pieces:
    """Ids of distinct pieces of text, found by hash and checked by a second hash; kept in a worker between batches.

    With a tokenizer that splits otherwise than piece_starts supposes, a piece is a whole text.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.starts = piece_starts if cuts_as_known(self.tokenizer) else lambda data, off: np.unique(off[:-1][off[:-1] < off[1:]])
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.clear()

    def clear(self) -> None:
        self.tables = [_Table(), _Table()]  # many pieces, and those found since
        self.pool, self.used = np.full(1 << 16, END_ID, self.dtype), 1  # the first id is the end id

    def places(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each piece, where its ids lie in the pool and how many they are."""
        if sum(len(t.keys) for t in self.tables) > CACHED_PIECES:
            self.clear()
        inverse, key = pd.factorize(span_hashes(data, start, end))
        order = np.argsort(key)
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        inverse, key = rank[inverse], key[order]  # keys in order are found faster
        at = np.empty(len(key), np.int64)
        at[inverse[::-1]] = np.arange(len(inverse) - 1, -1, -1)  # the first piece of each key
        check = span_hashes(data, start, end, second=True)
        found = np.full((3, len(key)), -1, np.int64)  # check, first, size
        for table in self.tables:
            table.look_up(key, found)
        new = np.flatnonzero(found[2] < 0)
        if len(new):
            first, size = self.add(data, start[at[new]], end[at[new]])
            found[:, new] = check[at[new]].view(np.int64), first, size
            many, fresh = self.tables
            fresh.insert(key[new], list(found[:, new]))
            if len(fresh.keys) > max(MERGED_PIECES, len(many.keys) // 8):
                many.insert(fresh.keys, fresh.values)
                self.tables[1] = _Table()
        sums, first, size = (x[inverse] for x in found)
        other = np.flatnonzero(check.view(np.int64) != sums)  # two pieces with one hash: encoded each time
        if len(other):
            first[other], size[other] = self.add(data, start[other], end[other])
        return first, size

    def add(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(start.tolist(), end.tolist())]
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), self.dtype, int(size.sum()))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        first = self.used + np.cumsum(size) - size
        self.pool[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        return first, size

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of a batch of texts, an end id after each."""
        start = self.starts(data, off)
        doc = np.searchsorted(off, start, "right") - 1
        end = np.minimum(np.concatenate([start[1:], [len(data)]]), off[doc + 1]) if len(start) else start
        first, size = self.places(data, start, end) if len(start) else (start, start)
        at = np.searchsorted(doc, np.arange(len(off) - 1), "right")  # the end id stands in the pool's first place
        first, size = np.insert(first, at, 0), np.insert(size, at, 1)
        stop = np.cumsum(size)
        ids = self.pool[np.repeat(first - (stop - size), size) + np.arange(stop[-1])]
        return np.concatenate([[0], stop[at + np.arange(len(at))]]), ids


_PIECES: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def binary_column(values: np.ndarray, off: np.ndarray) -> pa.Array:
    """values[off[i]:off[i + 1]] as the bytes of row i."""
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer((off * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def range_numbers(docs: pa.Array, hashes: np.ndarray, edges: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many of the bounds (doc_id, hash), in order, are at or below each (doc_id, hash); null ids come first."""
    ids = docs.fill_null(_FIRST).to_numpy(zero_copy_only=False)
    low, high = np.searchsorted(edges[0], ids), np.searchsorted(edges[0], ids, "right")
    for i in np.flatnonzero(low < high):  # bounds within one doc_id
        high[i] = low[i] + np.searchsorted(edges[1][low[i] : high[i]], hashes[i], "right")
    return high


_FIRST = -(1 << 63)


def tokenised(docs: DataFrame, path: str, bounds: list[tuple[int | None, int]]) -> DataFrame:
    """(doc_id, hash, part, ids): ids as little-endian bytes, part the range by bounds, sorted (doc_id, hash of the text)."""
    edges = (np.array([_FIRST if d is None else d for d, _ in bounds], np.int64), np.array([h for _, h in bounds], np.int64))

    def run(batches):
        tool = pieces(path)
        for rows, data, off in byte_batches(batches, "text"):
            ids, hashes = (rows.column(rows.schema.get_field_index(c)) for c in ("doc_id", "hash"))
            part = range_numbers(ids, hashes.to_numpy(), edges)
            stops, values = tool.encode(data, off)
            yield pa.RecordBatch.from_arrays([ids, hashes, pa.array(part, pa.int32()), binary_column(values, stops)], names=["doc_id", "hash", "part", "ids"])

    return docs.select("doc_id", "hash", "text").mapInArrow(run, "doc_id bigint, hash bigint, part int, ids binary")


# The file format ----------------------------------------------------------------------------------

_LENGTHS = np.array([[1 + (c >> 2 * k & 3) for k in range(4)] for c in range(256)], np.int64)  # by control byte


def pack(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    ranks = ranks.astype("<u4")
    size = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    four = np.zeros((len(ranks) + 3) // 4 * 4, np.uint8)
    four[: len(ranks)] = size
    four = four.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    return control, ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= size[:, None]]


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The n values behind control and data bytes."""
    size = _LENGTHS[control].reshape(-1)[:n]
    out = np.zeros((n, 4), np.uint8)
    out[np.arange(4) < size[:, None]] = data
    return out.view("<u4").reshape(-1)


def write_file(doc_ids: list, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """Header, documents (ids, null flags, sizes), rank table, control bytes, data bytes."""
    count = np.bincount(ids)
    ranked = np.argsort(-count, kind="stable")[: np.count_nonzero(count)]
    rank = np.zeros(len(count), np.uint32)
    rank[ranked] = np.arange(len(ranked))
    control, data = pack(rank[ids])
    head = struct.pack("<4sIQII", b"SLT1", len(doc_ids), len(ids), len(ranked), len(data))
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8")
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    return b"".join([head, keys.tobytes(), nulls.tobytes(), sizes.astype("<u4").tobytes(), ranked.astype("<u4").tobytes(), control.tobytes(), data.tobytes()])


def read_file(blob: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(doc_ids, sizes, ids) of a file."""
    magic, docs, n, ranks, size = struct.unpack_from("<4sIQII", blob)
    if magic != b"SLT1":
        raise ValueError("not a token file")
    at = struct.calcsize("<4sIQII")
    parts = []
    for kind, count in (("<i8", docs), ("u1", docs), ("<u4", docs), ("<u4", ranks), ("u1", (n + 3) // 4), ("u1", size)):
        parts.append(np.frombuffer(blob, kind, count, at))
        at += parts[-1].nbytes
    keys, nulls, sizes, ranked, control, data = parts
    return [None if z else int(k) for k, z in zip(keys, nulls)], sizes, ranked[unpack(control, data, n)]


def to_files(batches, dtype: str, most: int = FILE_IDS):
    """Files of sorted (doc_id, part, ids) rows; a file ends with its part or when it holds `most` ids."""
    part, seq, held, docs, n = None, 0, [], [], 0

    def flush():
        ids = np.concatenate([np.frombuffer(x, dtype) for x in held])
        sizes = np.array([len(x) // np.dtype(dtype).itemsize for x in held])
        blob = write_file(docs, sizes, ids)
        return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_docs": pa.array([len(docs)], pa.int64()), "n_ids": pa.array([n], pa.int64()), "file": pa.array([blob], pa.binary())})

    for batch in batches:
        for doc, p, ids in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if held and (p != part or n >= most):
                yield flush()
                seq, held, docs, n = (seq + 1 if p == part else 0), [], [], 0
            part = p
            held.append(ids)
            docs.append(doc)
            n += len(ids) // np.dtype(dtype).itemsize
    if held:
        yield flush()


def _bounds(docs: DataFrame) -> list[tuple[int | None, int]]:
    """Where ranges of (doc_id, hash) begin, but for the first: as many as the bytes of the texts ask for."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = math.ceil(size / max(RANGE_BYTES, math.sqrt(size * RANGE_ROOT)))
    if ranges < 2:
        return []
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash")]
    dealt = docs.select("doc_id", "hash").repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id())
    least = dealt.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "hash")).alias("x"))
    rows = least.orderBy("part").select("x.doc_id", "x.hash").collect()  # one row a range
    return [tuple(r) for r in rows[1:]]


def write_token_files(docs: DataFrame, out: str, tokenizer: str) -> None:
    """Write the ids of every row of docs under `out`, in ascending doc_id order (nulls first; rows with one doc_id by a hash of the text).

    Null texts count as empty and hold the end id alone. An empty table gives no files. Columns other
    than doc_id and text are not looked at. A very long text is one batch by itself. Rows of one doc_id may lie in several ranges.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), "text")
    bounds = _bounds(docs)
    dtype = np.dtype(pieces(tokenizer).dtype).newbyteorder("<").str
    rows = tokenised(docs, tokenizer, bounds).repartitionById(len(bounds) + 1, "part")
    rows = rows.sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "hash").drop("hash")
    files = rows.mapInArrow(lambda batches: to_files(batches, dtype), "part int, seq int, n_docs bigint, n_ids bigint, file binary")
    files.write.mode("overwrite").option("compression", "zstd").parquet(out)


def read_token_files(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files: start counts the ids of all documents before it."""
    files = spark.read.schema("part int, seq int, n_docs bigint, n_ids bigint, file binary").parquet(path)
    inner = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    blocks = files.select("part", "seq", "n_ids")
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row a range
    parts = parts.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    begins = blocks.withColumn("inner", F.coalesce(F.sum("n_ids").over(inner), F.lit(0))).join(F.broadcast(parts), "part")
    begins = begins.select("part", "seq", (F.col("base") + F.col("inner")).alias("base"))

    def run(batches):
        for batch in batches:
            for part, seq, blob in zip(*(batch.column(i).to_pylist() for i in range(3))):
                docs, sizes, ids = read_file(blob)
                stop = np.cumsum(sizes.astype(np.int64))
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (b - s) : 4 * b]) for b, s in zip(stop.tolist(), sizes.tolist())]
                k = len(docs)
                yield pa.RecordBatch.from_pydict({"part": pa.array([part] * k, pa.int32()), "seq": pa.array([seq] * k, pa.int32()), "doc_id": pa.array(docs, pa.int64()), "inner": pa.array(stop - sizes, pa.int64()), "n_tokens": pa.array(sizes, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    rows = files.select("part", "seq", "file").mapInArrow(run, "part int, seq int, doc_id bigint, inner bigint, n_tokens bigint, ids_crc32 bigint")
    begins = F.broadcast(begins) if small_enough(begins) else begins
    return rows.join(begins, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def write_and_read(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """What read_token_files gives for docs, written to a new folder in the shared one."""
    out = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, out, tokenizer or tokenizer_path())
    return read_token_files(docs.sparkSession, out)


def op5_token_files(spark, sf_dir: str) -> DataFrame:
    return write_and_read(documents(spark, sf_dir))

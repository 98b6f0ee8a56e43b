"""Texts as pieces of a trained model, and back: each distinct marked word is segmented once.

A word is what follows one white-space marker up to the next marker behind a visible character (longer runs of markers stay with
the word behind them).  If no piece of the model has a marker behind another character, no merge crosses such a place, so words
are segmented apart.  A batch of texts is one byte buffer: words are found by a scan, told apart by
hash (a second hash checks), looked up in the worker's table of distinct words, and their ids joined back by position in one gather.
Only words that are new to the table reach the library.  The table is bounded in words and in ids; when full it starts anew.

The way back gathers the bytes of ids by position from a table of the model's pieces.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, byte_batches, documents
from .token_files import Pieces, binary_column

MARKER = "▁"
#: Ids that a worker's table keeps at most, before the words of the next batch.
TABLE_IDS = 16 << 20


def marked_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of each word of a batch of texts, without the one marker in front (the first word's is put there by the model)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b, c = MARKER.encode()
    wide = np.zeros(len(data), bool)
    wide[:-2] = (data[:-2] == a) & (data[1:-1] == b) & (data[2:] == c)
    space = data == 32
    marker = space | wide
    behind = np.zeros(len(data), bool)  # the character before is a marker
    behind[1:] = space[:-1]
    behind[3:] |= wide[:-3]
    begin = marker & ~behind
    begin[off[:-1][off[:-1] < len(data)]] = False
    edges = off[:-1][off[:-1] < off[1:]]
    cut = begin.copy()
    cut[edges] = True
    at = np.flatnonzero(cut)
    # a marker at a text's start belongs to its first word, whose own marker is not in the text
    start = at + np.where(begin[at], np.where(wide[at], 3, 1), 0)
    return start, np.concatenate([at[1:], [len(data)]])


def words_apart(processor) -> bool:
    """Whether a model segments marked words apart: byte-pair merges over texts taken as they are, a marker put in front, and no
    piece with a marker behind another character."""
    from sentencepiece import sentencepiece_model_pb2 as model

    told = model.ModelProto()
    told.ParseFromString(processor.serialized_model_proto())
    how, taught = told.normalizer_spec, told.trainer_spec
    plain = not how.precompiled_charsmap and how.add_dummy_prefix and not how.remove_extra_whitespaces and how.escape_whitespaces and not taught.treat_whitespace_as_suffix
    kinds = model.ModelProto.SentencePiece
    inner = any(MARKER in p.piece.lstrip(MARKER) or p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in told.pieces)
    return plain and taught.model_type == model.TrainerSpec.BPE and taught.byte_fallback and not inner and not processor.is_unknown(processor.piece_to_id(MARKER))


class WordTable(Pieces):
    """Ids of distinct marked words. With a model that does not segment words apart, a word is a whole text."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.processor = SentencePieceProcessor(model_file=path)
        self.apart = words_apart(self.processor)
        self.dtype = np.uint16 if self.processor.get_piece_size() <= 1 << 16 else np.uint32
        self.clear()
        self.bytes, self.kind = self._pieces()

    def clear(self) -> None:
        super().clear()
        self.pool[:2] = self.processor.bos_id(), self.processor.eos_id()
        self.used = 2

    def add(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(start.tolist(), end.tolist())]
        ids = self.processor.encode(texts, out_type=int, num_threads=1)
        if self.apart:  # a marker without a word; the library puts none in front of nothing
            ids = [i if t else [self.processor.piece_to_id(MARKER)] for t, i in zip(texts, ids)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), self.dtype, int(size.sum()))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        first = self.used + np.cumsum(size) - size
        self.pool[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        return first, size

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of a batch of texts, the begin id before and the end id after each."""
        if self.used > TABLE_IDS:
            self.clear()
        if self.apart:
            start, end = marked_words(data, off)
        else:
            start, end = off[:-1][off[:-1] < off[1:]], off[1:][off[:-1] < off[1:]]
        first, size = self.places(data, start, end) if len(start) else (start, start)
        # a word behind the last marker may be empty and begin where its text ends
        doc = np.searchsorted(off, end - 1, "right") - 1 if len(start) else start
        docs = np.arange(len(off) - 1)
        edges = np.stack([np.searchsorted(doc, docs), np.searchsorted(doc, docs, "right")], 1).reshape(-1)
        first = np.insert(first, edges, np.tile([0, 1], len(docs)))
        size = np.insert(size, edges, 1)
        stop = np.cumsum(size)
        ids = self.pool[np.repeat(first - (stop - size), size) + np.arange(stop[-1])]
        last = edges[1::2] + 2 * docs + 1
        return np.concatenate([[0], stop[last]]), ids

    def _pieces(self) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
        """The bytes of each id's piece as (bytes, offsets), and its kind: 0 a piece, 1 a byte, 2 control, 3 anything else."""
        tool, texts, kind = self.processor, [], []
        for k in range(tool.get_piece_size()):
            piece = tool.id_to_piece(k)
            kind.append(2 if tool.is_control(k) else 1 if tool.is_byte(k) else 3 if tool.is_unknown(k) or tool.is_unused(k) else 0)
            texts.append([piece.replace(MARKER, " ").encode(), bytes([int(piece[3:5], 16)]) if kind[-1] == 1 else b"", b"", b""][kind[-1]])
        return (np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])), np.array(kind)

    def decode(self, ids: np.ndarray, off: np.ndarray) -> list[bytes] | tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of the texts behind ids[off[i]:off[i + 1]]."""
        data, places = self.bytes
        size = places[ids + 1] - places[ids]
        stop = np.concatenate([[0], np.cumsum(size)])
        out = data[np.repeat(places[ids] - stop[:-1], size) + np.arange(stop[-1])]
        # the marker that the model put in front of a text goes: that of the first id that is no control
        kind = self.kind[ids]
        seen = np.flatnonzero(kind != 2)
        doc = np.searchsorted(off, seen, "right") - 1
        lead = seen[np.unique(doc, return_index=True)[1]]
        lead = lead[(kind[lead] == 0) & (size[lead] > 0)]
        lead = lead[out[stop[lead]] == 32]
        keep = np.ones(len(out), bool)
        keep[stop[lead]] = False
        edges = stop[off] - np.searchsorted(stop[lead], stop[off])
        return out[keep], edges


_TABLES: dict[str, WordTable] = {}


def word_table(path: str) -> WordTable:
    if path not in _TABLES:
        _TABLES[path] = WordTable(path)
    return _TABLES[path]


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, ids) of every row of docs: the model's ids with begin and end ids, as little-endian unsigned 32-bit integers.

    Null texts count as empty and have the begin and the end id. Repeated rows and null ids are rows like others; an empty table gives no rows;
    texts are encoded whole, a very long one is a batch by itself; other columns are not looked at.
    """
    bound_batches(docs.sparkSession)
    path = model or model_path()

    def run(batches):
        table = word_table(path)
        for rows, data, off in byte_batches(batches, "text"):
            stops, ids = table.encode(data, off)
            yield pa.RecordBatch.from_arrays([rows.column(0), binary_column(ids.astype("<u4"), stops)], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, ids binary")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """encoded (column ids, as `encode` gives it, and any others) with `text`: what the library's decode gives for the ids.

    Null ids give an empty text. Texts with unknown ids, or whose byte pieces are no characters, go through the library one by one.
    """
    path, names = model or model_path(), encoded.columns
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in encoded.schema.fields)

    def run(batches):
        table = word_table(path)
        for rows, data, off in byte_batches(batches, "ids"):
            ids, off = data.view("<u4").astype(np.int64), off // 4
            raw, edges = table.decode(ids, off)
            texts = pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(raw)])
            try:
                if (table.kind[ids] == 3).any():
                    raise pa.ArrowInvalid("unknown ids")
                texts = texts.cast(pa.string())
            except pa.ArrowInvalid:
                texts = pa.array([table.processor.decode(ids[a:b].tolist()) for a, b in zip(off[:-1].tolist(), off[1:].tolist())], pa.string())
            yield pa.RecordBatch.from_arrays([*rows.columns, texts], names=[*names, "text"])

    return encoded.mapInArrow(run, f"{fields}, text string")


def op13_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = decode(encode(documents(spark, sf_dir)))
    ids, decoded = F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text"), 256).alias("decoded_sha256")
    return done.select("doc_id", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), ids, decoded)

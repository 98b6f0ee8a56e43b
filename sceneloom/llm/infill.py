"""Fill-in-the-middle: a text is cut in three and written with its middle last, and back.

A batch of texts is one byte buffer.  Cuts are found by one scan for line ends; each cut puts the change of
the output's displacement into a difference array, whose running sum tells every byte where it goes, and one scatter builds all
outputs of the batch.  The way back scans outputs for the three marks and gathers by the inverse displacements.
No loop runs over texts; draws come from a hash of doc_id, so that reruns and lost executors change nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, byte_batches, documents

SEED, RATE, SUFFIX_FIRST = 7, 100, 50
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
_MARKS = np.frombuffer(PREFIX + SUFFIX + MIDDLE, np.uint8).reshape(3, 3)
_WIDTH = 3
PLAIN, PSM, SPM = 0, 1, 2
_FORMS = pa.array(["plain", "psm", "spm"])


def marks_at(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of marks that lie in one text, and those texts' numbers."""
    if len(data) < _WIDTH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = data[1:-1]
    at = np.flatnonzero((data[:-2] == _MARKS[0, 0]) & (data[2:] == _MARKS[0, 2]) & ((kind == _MARKS[0, 1]) | (kind == _MARKS[1, 1]) | (kind == _MARKS[2, 1])))
    doc = np.searchsorted(off, at, "right") - 1
    inside = at + _WIDTH <= off[doc + 1]
    return at[inside], doc[inside]


def displacements(at: np.ndarray, shift: np.ndarray, n: int) -> np.ndarray:
    """The shift of each of n bytes: from place at[k] on it is shift[k] (places in order; of equal places the last counts)."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, at, np.diff(shift, prepend=0))
    return np.cumsum(change[:n])


def line_cuts(data: np.ndarray, off: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines, end of the prefix, end of the middle) of each text, in bytes of the batch, by two draws a text."""
    begin, end = off[:-1], off[1:]
    ends = np.flatnonzero(data == 10) + 1
    before = np.searchsorted(ends, begin, "right")
    n = np.searchsorted(ends, end, "right") - before
    open_end = end > begin
    open_end[open_end] = data[end[open_end] - 1] != 10
    n += open_end
    a, b = first % (n + 1), second % (n + 1)

    def place(units: np.ndarray) -> np.ndarray:
        out = np.where(units == n, end, begin)
        inner = np.flatnonzero((units > 0) & (units < n))
        out[inner] = ends[before[inner] + units[inner] - 1]
        return out

    return n, place(np.minimum(a, b)), place(np.maximum(a, b))


def rearranged(data: np.ndarray, off: np.ndarray, p: np.ndarray, m: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the outputs: texts cut at p and m and put together by form."""
    begin, end = off[:-1], off[1:]
    cut = form != PLAIN
    size = end - begin + 3 * _WIDTH * cut
    out_off = np.concatenate([[0], np.cumsum(size)])
    base, a, c = out_off[:-1], p - begin, end - m
    prefix = base + np.where(form == PSM, _WIDTH, 2 * _WIDTH + c)
    suffix = base + np.where(form == PSM, 2 * _WIDTH + a, _WIDTH)
    middle = base + 3 * _WIDTH + a + c
    prefix, middle, suffix = (np.where(cut, x, base + y) for x, y in ((prefix, 0), (middle, a), (suffix, m - begin)))
    places, goals = np.stack([begin, p, m], 1).reshape(-1), np.stack([prefix, middle, suffix], 1).reshape(-1)
    out = np.empty(out_off[-1], np.uint8)
    out[np.arange(len(data)) + displacements(places, goals - places, len(data))] = data
    for goal, mark in zip((prefix, suffix, middle), _MARKS):
        out[(goal[cut, None] - _WIDTH) + np.arange(_WIDTH)] = mark
    return out, out_off


def put_back(data: np.ndarray, off: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts behind outputs: segments are found by their marks."""
    cut = np.flatnonzero(form != PLAIN)
    at, doc = marks_at(data, off)
    at = at[form[doc] != PLAIN]
    if len(at) != 3 * len(cut) or (doc[form[doc] != PLAIN].reshape(-1, 3) != cut[:, None]).any():
        raise ValueError("an output that is not plain holds each mark once")
    marks = at.reshape(-1, 3)
    size = np.diff(off)
    size[cut] -= 3 * _WIDTH
    out_off = np.concatenate([[0], np.cumsum(size)])
    # where prefix, middle and suffix begin in the output and in the text; a plain text is its own prefix
    source = np.repeat(off[:-1, None], 3, 1)
    goal = np.repeat(out_off[:-1, None], 3, 1)
    psm = form[cut] == PSM
    begins = marks + _WIDTH
    lengths = np.stack([marks[:, 1] - begins[:, 0], marks[:, 2] - begins[:, 1]], 1)  # of the two segments before the middle
    source[cut] = np.stack([np.where(psm, begins[:, 0], begins[:, 1]), begins[:, 2], np.where(psm, begins[:, 1], begins[:, 0])], 1)
    a = np.where(psm, lengths[:, 0], lengths[:, 1])
    m = size[cut] - np.where(psm, lengths[:, 1], lengths[:, 0])
    goal[cut] += np.stack([np.zeros_like(a), a, m], 1)
    places = goal.reshape(-1)
    n = out_off[-1]
    return data[np.arange(n) + displacements(places, source.reshape(-1) - places, n)], out_off


def _strings(data: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.string(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row of docs: texts cut at line ends, the middle last.

    n counts lines. The draws come from sha256 of the seed and doc_id; `rate` of 100 documents are cut, `suffix_first` of 100 of those
    are written suffix first. Empty and null texts and texts that hold a mark are plain: output is the text, the counts of
    characters are null. A null doc_id draws like an empty one; rows that repeat a doc_id draw alike. Texts are
    cut whole, a very long one is a batch by itself; an empty table gives no rows; other columns are not looked at.
    """
    bound_batches(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", digest.alias("digest"))
    rows = rows.select("doc_id", "text", *(F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)))

    def run(batches):
        for batch, data, off in byte_batches(batches, "text"):
            h1, h2, h3, h4 = (batch.column(k).to_numpy() for k in range(2, 6))
            n, p, m = line_cuts(data, off, h1, h2)
            form = np.where(h4 % 100 < suffix_first, SPM, PSM)
            form[(off[1:] == off[:-1]) | (h3 % 100 >= rate)] = PLAIN
            form[marks_at(data, off)[1]] = PLAIN
            letters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            plain = form == PLAIN
            counts = [pa.array(letters[hi] - letters[lo], pa.int64(), mask=plain) for lo, hi in ((off[:-1], p), (p, m))]
            out = _strings(*rearranged(data, off, p, m, form))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), _FORMS.take(pa.array(form)), *counts, out], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(run, "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restore(outputs: DataFrame) -> DataFrame:
    """outputs (columns output, form and any others) with `restored`: the texts behind the outputs, from these two columns alone.

    A null output gives an empty text, a null form counts as plain. An output that is not plain and does not hold each mark once is an error.
    """
    names = outputs.columns
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in outputs.schema.fields)

    def run(batches):
        for batch, data, off in byte_batches(batches, "output"):
            told = batch.column(batch.schema.get_field_index("form")).to_pylist()
            form = np.array([{"psm": PSM, "spm": SPM}.get(f, PLAIN) for f in told])
            yield pa.RecordBatch.from_arrays([*batch.columns, _strings(*put_back(data, off, form))], names=[*names, "restored"])

    return outputs.mapInArrow(run, f"{fields}, restored string")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = restore(transform(documents(spark, sf_dir)))
    digests = [F.sha2(F.col(c), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


OP12_SQL = f"""
WITH hashed AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (
    SELECT doc_id, text, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') AS units, CAST('0x' || h[1:8] AS BIGINT) AS h1,
        CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM hashed),
cut AS (
    SELECT doc_id, text, units, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {RATE} THEN 'plain'
            WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM drawn),
split AS (
    SELECT doc_id, text, n, form, coalesce(array_to_string(units[1 : a], ''), '') AS prefix, coalesce(array_to_string(units[a + 1 : b], ''), '') AS middle,
        coalesce(array_to_string(units[b + 1 : n], ''), '') AS suffix FROM cut)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM split
"""

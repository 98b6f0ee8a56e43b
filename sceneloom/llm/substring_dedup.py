"""Removal of repeated byte strings, by column-wise construction over the contexts of shared anchors.

Every string of WIDTH bytes has one anchor: the leftmost of its KEY-byte strings with the smallest hash.
Equal strings have equal anchors at equal offsets, so

1. anchors are counted over all documents (by hash bucket; what repeats within one batch is answered there
   and sent on twice at most); strings whose anchor is unique cannot repeat;
2. the strings of a repeated anchor are sent as one short context, to the bucket of the anchor's hash.
   Equal contexts are one, whose first place is kept; all strings of its other places repeat. An
   anchor that holds more than one ten-thousandth of all places is sent by longer keys (94 bytes);
3. a bucket's contexts are a collection of short documents, aligned at their anchors. From the last
   column to the first, each round inserts one symbol per document: the symbols, in the order of the
   suffixes so far, are the round's part of the collection's Burrows-Wheeler transform; a stable sort by
   them gives the next order, and minima over the ranges between equal symbols give the common
   prefixes. Suffixes with a common prefix of WIDTH are equal strings: all but the first repeat;
4. covered bytes are merged into runs and cut.

The columns of a bucket stay in memory: buckets are of bounded size, and a cluster's local disks are not
for files.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_batches, documents, mix, span_hashes, written

WIDTH, KEY, CELL = 100, 32, 7
REACH = WIDTH - KEY  # an anchor lies at most so far behind the start of its string
BUCKET_BYTES, SLICE = 12 << 20, 1 << 20
_SEGMENT = 1 << 22
_NONE = -(1 << 63)


def anchors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, first, last) of each anchor: its place in data, and the starts of the strings that have it."""
    out = [_anchors(data[a : a + _SEGMENT + WIDTH], off - a, a) for a in range(0, max(len(data), 1), _SEGMENT)]
    place, h, first, last = map(np.concatenate, zip(*out))
    return place, h, first, last


def _anchors(data: np.ndarray, off: np.ndarray, base: int):
    n = len(data) - WIDTH + 1
    if n <= 0:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    at = np.arange(len(data) - KEY + 1)
    h = span_hashes(data, at, at + KEY)
    low = (h & ~np.uint64(0xFFFFFF)) | at.astype(np.uint64)
    width = 1
    while 2 * width <= REACH + 1:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = REACH + 1 - width
    low = np.minimum(low[:-rest], low[rest:])[:n] if rest else low[:n]
    edges = off[(off > 0) & (off < len(data) + WIDTH)]
    cross = np.zeros(n + 1, np.int32)  # starts whose string crosses an edge
    lo = np.clip(edges - WIDTH + 1, 0, n)
    np.add.at(cross, lo, 1)
    np.add.at(cross, np.clip(edges, 0, n), -1)
    valid = np.cumsum(cross)[:n] == 0
    start = np.flatnonzero(valid[: min(n, _SEGMENT)])
    place = (low[start] & np.uint64(0xFFFFFF)).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = place[1:] != place[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1 if len(start) else first
    return place[first] + base, h[place[first]], start[first] + base, start[last] + base


#: Bytes of an anchor's hash that are sent on: two hashes that agree in them cost a needless look, no more.
SENT = 6


def _count(buckets: int):
    def run(batches):
        for rows, data, off in byte_batches(batches, "text", SLICE):
            place, key, _, _ = anchors(data, off)
            owner = np.searchsorted(off, place, "right") - 1
            ids = rows.column(rows.schema.get_field_index("d")).to_numpy(zero_copy_only=False)
            pos = (place - off[owner]).astype(np.uint32)
            key >>= np.uint64(64 - 8 * SENT)
            order = np.argsort(key, kind="stable")
            key, pos, owner = key[order], pos[order], owner[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            count = np.diff(np.append(first, len(key)))
            group = np.repeat(np.arange(len(first)), count)
            nth = np.arange(len(key)) - first[group]
            local = count[group] > 1  # answered here; two places still tell the others
            weight = np.where(nth == 0, np.maximum(count[group] - 1, 1), 1).astype(np.uint32)
            send, told = np.flatnonzero(nth < 2), np.flatnonzero(local)
            sent = _split((mix(key[send]) % np.uint64(buckets)).astype(np.int64), buckets)
            said = _split(owner[told] % buckets, buckets)
            full, blobs = [], []
            for k in range(buckets):
                a, b = send[sent[k]], told[said[k]]
                if len(a) or len(b):
                    full.append(k)
                    doc, at = np.unique(owner[np.concatenate([a, b])], return_inverse=True)
                    parts = [ids[doc], key[a].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SENT], pos[a], weight[a], local[a], at.astype(np.uint32), pos[b]]
                    blobs.append(np.array([len(doc), len(a), len(b)], np.int64).tobytes() + b"".join(x.tobytes() for x in parts))
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(full, pa.int32()), "places": pa.array(blobs, pa.binary())})

    return run


def _split(bucket: np.ndarray, n: int) -> list[np.ndarray]:
    order = np.argsort(bucket, kind="stable")
    edge = np.searchsorted(bucket[order], np.arange(n + 1))
    return [order[a:b] for a, b in zip(edge[:-1], edge[1:])]


def _read(blob: bytes, at: int, *kinds) -> list[np.ndarray]:
    """Arrays of (type, length) that lie one after the other in blob."""
    out = []
    for kind, n in kinds:
        out.append(np.frombuffer(blob, kind, n, at))
        at += out[-1].nbytes
    return out


def _repeated(groups: int, hot_above: float):
    """Of one bucket: places (document, position) of anchors that several places have, by group of documents; in group -1 the hashes of the most frequent ones."""

    def run(table: pa.Table) -> pa.Table:
        cols = ([], [], [], [], [], [], [])
        for blob in table.column("places").to_pylist():
            t, n, m = np.frombuffer(blob, np.int64, 3).tolist()
            ids, raw, pos, weight, quiet, at, more = _read(blob, 24, (np.int64, t), (np.uint8, n * SENT), (np.uint32, n), (np.uint32, n), (bool, n), (np.uint32, n + m), (np.uint32, m))
            key = np.zeros((n, 8), np.uint8)
            key[:, :SENT] = raw.reshape(-1, SENT)
            doc = ids[at]
            for col, x in zip(cols, (key.view("<u8").reshape(-1), doc[:n], pos, weight, quiet, doc[n:], more)):
                col.append(x)
        key, doc, pos, weight, quiet, more_doc, more_pos = map(np.concatenate, cols)
        order = np.argsort(key, kind="stable")
        key, doc, pos, weight, quiet = (x[order] for x in (key, doc, pos, weight, quiet))
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(key)))
        reply = np.repeat(count > 1, count) & ~quiet
        hot = key[first][np.add.reduceat(weight.astype(np.int64), first) > hot_above] if len(key) else key
        doc, pos = np.concatenate([doc[reply], more_doc]), np.concatenate([pos[reply], more_pos])
        full, blobs = [-1], [hot.tobytes()]
        for g, rows in enumerate(_split((mix(doc.view(np.uint64)) % np.uint64(groups)).astype(np.int64), groups)):
            if len(rows):
                full.append(g)
                blobs.append(np.int64(len(rows)).tobytes() + doc[rows].tobytes() + pos[rows].tobytes())
        return pa.table({"part": pa.array(full, pa.int32()), "places": pa.array(blobs, pa.binary())})

    return run


def _by_document(table: pa.Table) -> pa.Table:
    """Of one group of documents: each document's places."""
    docs, places = [], []
    for blob in table.column("places").to_pylist():
        n = int(np.frombuffer(blob, np.int64, 1)[0])
        doc, pos = _read(blob, 8, (np.int64, n), (np.uint32, n))
        docs.append(doc), places.append(pos)
    doc, pos = np.concatenate(docs), np.concatenate(places)
    order = np.argsort(doc, kind="stable")
    ids, start = np.unique(doc[order], return_index=True)
    pos = pos[order]
    return pa.table({"d": pa.array(ids), "places": pa.array([pos[a:b].tobytes() for a, b in zip(start, np.append(start[1:], len(pos)))], pa.binary())})


def _gather(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of data[start:stop] of each row."""
    size = stop - start
    off = np.concatenate([[0], np.cumsum(size)])
    return off, data[np.repeat(start - off[:-1], size) + np.arange(off[-1])]


def _contexts(buckets: int, hot: np.ndarray):
    """Contexts of the repeated anchors of each document, and stretches whose strings all repeat within the batch."""

    def run(batches):
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        for rows, data, off in byte_batches(batches, "text", SLICE):
            names = rows.schema.names
            place, key, first, last = anchors(data, off)
            owner = np.searchsorted(off, place, "right") - 1
            lists = rows.column(names.index("places")).to_pylist()
            wanted = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, np.uint32).astype(np.int64) + off[i] for i, x in enumerate(lists) if x)])
            keep = np.isin(place, wanted)
            place, key, first, last, owner = place[keep], key[keep], first[keep], last[keep], owner[keep]
            is_hot = np.isin(key >> np.uint64(64 - 8 * SENT), hot)
            cells = np.where(is_hot, (place - first) // CELL - (place - last) // CELL + 1, 1)
            take = np.repeat(np.arange(len(place)), cells)
            nth = np.arange(len(take)) - np.repeat(np.cumsum(cells) - cells, cells)
            place, key, first, last, owner, is_hot = (x[take] for x in (place, key, first, last, owner, is_hot))
            cell = (place - last) // CELL + nth  # cell c: starts from 7c + 6 to 7c bytes before the anchor
            first = np.where(is_hot, np.maximum(first, place - CELL * cell - (CELL - 1)), first)
            last = np.where(is_hot, np.minimum(last, place - CELL * cell), last)
            a = np.flatnonzero(is_hot)
            longer = place[a] - CELL * cell[a]
            key[a] = mix(span_hashes(data, longer, longer + WIDTH - (CELL - 1)) + cell[a].astype(np.uint64))
            d = rows.column(names.index("d")).to_numpy(zero_copy_only=False)[owner]
            digest = rows.column(names.index("digest")).to_numpy(zero_copy_only=False)[owner]
            stop, left = last + WIDTH, place - first
            one, two = span_hashes(data, first, stop), span_hashes(data, first, stop, second=True)
            pos = first - off[owner]
            order = np.lexsort((pos, d, left, two, one))
            new = np.ones(len(order), bool)
            new[1:] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]]) | (left[order[1:]] != left[order[:-1]])
            tie = np.zeros(len(order), bool)  # the same place of a repeated row
            tie[1:] = ~new[1:] & (d[order[1:]] == d[order[:-1]]) & (pos[order[1:]] == pos[order[:-1]])
            lead = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
            same = (d[order] == d[order[lead]]) & (pos[order] == pos[order[lead]])
            rest, head = order[~same], order[same & (new | tie | same)]
            ids, marks = (rows.column(names.index(c)).to_numpy(zero_copy_only=False) for c in ("d", "digest"))
            sent = _split(((key[head] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), buckets)
            said = _split(owner[rest] % buckets, buckets)
            full, blobs = [], []
            for k in range(buckets):
                x, y = head[sent[k]], rest[said[k]]
                if len(x) or len(y):
                    both = np.concatenate([x, y])
                    doc, at = np.unique(owner[both], return_inverse=True)
                    flat = _gather(data, first[x], stop[x])[1]
                    parts = [ids[doc], marks[doc], at.astype(np.uint32), pos[both].astype(np.uint32), (stop - first)[both].astype(np.uint16), left[x].astype(np.uint8), flat]
                    full.append(k)
                    blobs.append(press.compress(np.array([len(doc), len(x), len(y), len(flat)], np.int64).tobytes() + b"".join(p.tobytes() for p in parts)))
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(full, pa.int32()), "contexts": pa.array(blobs, pa.binary())})

    return run


def repeated_starts(data: np.ndarray, off: np.ndarray, left: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which strings of aligned contexts repeat one of smaller rank: a flag for each context and each of the REACH + 1 distances to the anchor."""
    m = len(left)
    end, flags = np.diff(off) - left, np.zeros((m, REACH + 1), bool)
    order, common, zero = np.arange(m), np.zeros(m + 1, np.uint8), off[:-1] + left
    padded = np.append(data, np.uint8(0))
    for x in range(int(end.max(initial=0)) - 1, -int(left.max(initial=0)) - 1, -1):
        here = (x < end) & (x >= -left)
        symbol = np.where(here, padded[np.where(here, zero + x, 0)].astype(np.uint16) + np.uint16(1), np.uint16(0))
        column = symbol[order]  # this round's symbols of the transform
        by = np.argsort(column, kind="stable")
        column = column[by]
        pair = np.empty(2 * (m - 1), np.int64)
        pair[0::2], pair[1::2] = by[:-1] + 1, by[1:] + 1
        least = np.minimum.reduceat(common, pair)[0::2] if m > 1 else np.zeros(0, np.uint8)
        fresh = np.zeros(m + 1, np.uint8)
        fresh[1:m] = np.where((column[1:] == column[:-1]) & (column[1:] > 0), np.minimum(least, 250) + 1, 0)
        order, common = order[by], fresh
        if x <= 0:
            run = np.flatnonzero(common[:m] < WIDTH)
            least_rank = np.repeat(np.minimum.reduceat(rank[order], run), np.diff(np.append(run, m)))
            flags[order, -x] = rank[order] != least_rank
    return flags


def _covered(table: pa.Table) -> pa.Table:
    """Of one bucket: covered stretches (start, stop) by document."""
    import zstandard

    tool, cols = zstandard.ZstdDecompressor(), tuple([] for _ in range(10))
    for blob in table.column("contexts").to_pylist():
        blob = tool.decompress(blob)
        t, n, m, size = np.frombuffer(blob, np.int64, 4).tolist()
        ids, marks, at, pos, long, left, flat = _read(blob, 32, (np.int64, t), (np.int64, t), (np.uint32, n + m), (np.uint32, n + m), (np.uint16, n + m), (np.uint8, n), (np.uint8, size))
        d, digest, pos, long = ids[at], marks[at], pos.astype(np.int64), long.astype(np.int64)
        for col, x in zip(cols, (d[:n], digest[:n], pos[:n], long[:n], left.astype(np.int64), flat, d[n:], digest[n:], pos[n:], pos[n:] + long[n:])):
            col.append(x)
    d, digest, pos, size, left, data, *rest = map(np.concatenate, cols)
    doc, mark, start, stop = ([x] for x in rest)
    if len(d):
        off = np.concatenate([[0], np.cumsum(size)])
        one, two = span_hashes(data, off[:-1], off[1:]), span_hashes(data, off[:-1], off[1:], second=True)
        order = np.lexsort((pos, d, left, two, one))
        new = np.ones(len(order), bool)
        new[1:] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]]) | (left[order[1:]] != left[order[:-1]])
        lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        same = (d[order] == d[lead]) & (pos[order] == pos[lead])  # the first place, also of repeated rows
        rest = order[~same]
        doc.append(d[rest]), mark.append(digest[rest]), start.append(pos[rest]), stop.append(pos[rest] + size[rest])
        head = order[new]
        anchor = pos[head] + left[head]
        o, flat = _gather(data, off[head], off[head + 1])
        place = np.lexsort((anchor, d[head]))
        rank = np.empty(len(head), np.int64)
        rank[place] = np.arange(len(head))
        flags = repeated_starts(flat, o, left[head].astype(np.int64), rank)
        # Runs of flagged starts; distance y stands for the start anchor - y.
        wide = np.zeros((len(head), REACH + 3), bool)
        wide[:, 1:-1] = flags[:, ::-1]
        change = np.diff(wide.astype(np.int8), axis=1)
        (i, a), (_, b) = np.nonzero(change == 1), np.nonzero(change == -1)
        first, last = anchor[i] - REACH + a, anchor[i] - REACH + b - 1
        group = np.cumsum(new) - 1
        twins = order[same]  # repeated rows share what their first row has
        tg = group[same]
        where = np.searchsorted(i, np.arange(len(head) + 1))
        many = where[tg + 1] - where[tg]
        t = np.repeat(np.arange(len(tg)), many)
        k = np.repeat(where[tg] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        doc.append(d[twins[t]]), mark.append(digest[twins[t]]), start.append(first[k]), stop.append(last[k] + WIDTH)
    doc, mark, start, stop = map(np.concatenate, (doc, mark, start, stop))
    order = np.lexsort((start, mark, doc))
    doc, mark = doc[order], mark[order]
    edge = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])])) if len(doc) else np.zeros(0, np.int64)
    pairs = np.stack([start[order], stop[order]], 1).astype(np.int64)
    blobs = [pairs[a:b].tobytes() for a, b in zip(edge, np.append(edge[1:], len(doc)))]
    return pa.table({"d": pa.array(doc[edge], pa.int64()), "digest": pa.array(mark[edge], pa.int64()), "runs": pa.array(blobs, pa.binary())})


def merged(blobs: list[bytes] | None) -> list[tuple[int, int]]:
    """Maximal runs of covered stretches."""
    pairs = sorted(map(tuple, np.frombuffer(b"".join(blobs or []), np.int64).reshape(-1, 2).tolist()))
    out: list[list[int]] = []
    for a, b in pairs:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _cut():
    def run(batches):
        for batch in batches:
            names = batch.schema.names
            ids, texts, runs = (batch.column(names.index(c)) for c in ("doc_id", "text", "runs"))
            cols = ([], [], [], [], [])
            for text, blobs in zip(texts.cast(pa.large_binary()).to_pylist(), runs.to_pylist()):
                raw, at, kept = text or b"", 0, []
                spans = merged(blobs)
                for a, b in spans:
                    kept.append(raw[at:a])
                    at = b
                kept = b"".join([*kept, raw[at:]])
                for col, v in zip(cols, (len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept)):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def drop_repeated_strings(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (remaining bytes) of every row of docs.

    A byte goes if a WIDTH-byte string over it also starts earlier: in a smaller doc_id (a null one is
    smallest), or earlier in the same document. Null texts count as empty. Rows with one doc_id and text
    are one document and judged alike. Columns other than doc_id and text are not looked at; an empty
    table gives an empty table. What stays of a text may end within a character, so it is bytes.
    """
    keyed = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)).alias("d"), F.xxhash64("text").alias("digest"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    places = size / ((REACH + 2) / 2)
    buckets = max(64, math.ceil(places * 24 / BUCKET_BYTES))
    found = keyed.where(F.octet_length("text") >= WIDTH).select("d", "text").mapInArrow(_count(buckets), "bucket int, places binary")
    found = written(found.groupBy("bucket").applyInArrow(_repeated(buckets, max(64.0, places / 10_000)), "part int, places binary"))
    hot = [np.frombuffer(r[0], np.uint64) for r in found.where("part = -1 and octet_length(places) > 0").select("places").collect()]  # about ten thousand at most
    hot = np.unique(np.concatenate([np.zeros(0, np.uint64), *hot]))
    lists = found.where("part >= 0").groupBy("part").applyInArrow(_by_document, "d bigint, places binary").select(F.col("d").alias("_d"), "places")
    # Both joins read the documents from one shuffle by d: the same rows and columns, so that it is reused.
    dealt = keyed.repartition("d")
    spots = dealt.join(lists, F.col("d") == F.col("_d"), "left").select("doc_id", "text", "d", "digest", "places")
    contexts = spots.mapInArrow(_contexts(2 * buckets, hot), "bucket int, contexts binary")
    runs = contexts.groupBy("bucket").applyInArrow(_covered, "d bigint, digest bigint, runs binary")
    runs = runs.groupBy(F.col("d").alias("_d"), F.col("digest").alias("_digest")).agg(F.collect_list("runs").alias("runs"))
    runs = runs.groupBy("_d").agg(F.collect_list(F.struct("_digest", "runs")).alias("by_text"))
    mine = F.flatten(F.transform(F.filter("by_text", lambda x: x["_digest"] == F.col("digest")), lambda x: x["runs"]))
    rows = dealt.join(runs, F.col("d") == F.col("_d"), "left").select("doc_id", "text", "d", "digest", mine.alias("runs"))
    kind = dict(docs.dtypes)["doc_id"]
    return rows.mapInArrow(_cut(), f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return drop_repeated_strings(documents(spark, sf_dir)).drop("kept")


#: Every string by its 128-bit hash, cut from stretches of 256 starts; bytes as hex digits, since texts are cut within characters.
OP6_SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
piece AS (SELECT doc_id, o, n, substr(x, 2 * o + 1, 2 * ({WIDTH} + 255)) AS x FROM (SELECT doc_id, x, n, unnest(range(0, n, 256)) AS o FROM d)),
w AS (
    SELECT doc_id, o + k AS s, md5_number(substr(x, 2 * k + 1, {2 * WIDTH})) AS h
    FROM (SELECT *, unnest(range(0, least(256, n - {WIDTH - 1} - o))) AS k FROM piece)),
again AS (SELECT doc_id, s FROM w QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, s) > 1),
edge AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + {WIDTH} THEN 0 ELSE 1 END AS fresh FROM again),
run AS (
    SELECT doc_id, min(s) AS a, max(s) + {WIDTH} AS b
    FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM edge) GROUP BY doc_id, g),
gap AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM run),
gone AS (
    SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(b) AS till,
        string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept
    FROM gap JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
    sha256(unhex(coalesce(kept || substr(x, 2 * till + 1), x))) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""

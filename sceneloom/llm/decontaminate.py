"""Decontamination: rare n-gram seeds join passages to test items, and local alignment scores them.

Words are runs of letters and digits, lower-cased.  With match 2, mismatch -1 and gap -2, an alignment of
at least 0.7 of an item's best score 2 L loses at most 0.6 L of the item's three-word n-grams.  So
such a passage holds one of the item's 0.6 L + 1 rarest n-grams (the seeds, ranked by their count of
documents in the corpus), and 0.4 L - 2 of its n-grams in all: both are tested before the alignment, and
neither loses a passage.  For items of at most five words that guarantee is empty, so they go by all their
pairs of words (a single word by itself): their passages miss one word or hold one more at most, and
keep two words that stand together.  The alignment is a Smith-Waterman recurrence over word hashes of the
stretch around the hits, a row of the table at a time.

Items are taken in blocks of bounded size; each block is searched for in all documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_batches, documents, windows, words

SEED = 3
#: Items of at most so many words have shorter n-grams.
SHORT = 5
#: Items of one block: about so many bytes of text at most.
BLOCK_BYTES = 16 << 20
MATCH, MISMATCH, GAP, NEEDED = 2, -1, -2, 0.7


def alignment(item: np.ndarray, passage: np.ndarray) -> int:
    """The best local alignment score of two sequences of hashes."""
    row, best = np.zeros(len(passage) + 1, np.int64), 0
    step = np.arange(len(passage) + 1) * -GAP
    for word in item:
        new = np.maximum(row + GAP, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(passage == word, MATCH, MISMATCH))
        row = np.maximum.accumulate(new + step) - step
        best = max(best, int(row.max()))
    return best


def grams_of(h: np.ndarray, doc: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, hashes and lengths of the n-grams of every length asked for."""
    found = [windows(h, doc, n) for n in lengths]
    return np.concatenate([at for at, _ in found]), np.concatenate([grams for _, grams in found]), np.repeat(lengths, [len(at) for at, _ in found])


class Items:
    """A block of items: word hashes, n-grams in order of hash with the places they come from."""

    def __init__(self, texts: list[str | None]) -> None:
        raw = [(t or "").encode() for t in texts]
        off = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        _, _, doc, h = words(np.frombuffer(b"".join(raw), np.uint8), off, True, True)
        edge = np.searchsorted(doc, np.arange(len(raw) + 1))
        self.words = [h[a:b] for a, b in zip(edge[:-1], edge[1:])]
        size = np.diff(edge)
        length = np.where(size > SHORT, SEED, np.minimum(size, 2))
        self.lengths = sorted({SEED, *length[length > 0].tolist()})
        at, grams, n = grams_of(h, doc, self.lengths)
        own = n == length[doc[at]]
        at, grams = at[own], grams[own]
        order = np.argsort(grams, kind="stable")
        self.grams, first = np.unique(grams[order], return_index=True)
        self.first, self.item = np.append(first, len(order)), doc[at[order]]
        self.place = (at - edge[doc[at]])[order]
        self.seed = np.zeros(len(order), bool)

    def rank(self, frequency: np.ndarray) -> None:
        """Mark each item's rarest n-grams as its seeds. frequency: documents with each n-gram."""
        df = np.repeat(frequency, np.diff(self.first))
        order = np.lexsort((np.arange(len(df)), df, self.item))
        start = np.searchsorted(self.item[order], np.arange(len(self.words)))
        rank = np.arange(len(order)) - start[self.item[order]]
        size = np.array([len(w) for w in self.words])
        self.seed[order] = rank <= (6 * size[self.item[order]]) // 10

    def find(self, grams: np.ndarray) -> np.ndarray:
        """Index of each n-gram in self.grams, or -1."""
        if not len(self.grams):
            return np.full(len(grams), -1)
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        return np.where(self.grams[at] == grams, at, -1)


def hits_of(found: np.ndarray, at: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hits as (word position, item, position the item would start at, is a seed)."""
    known = np.flatnonzero(found >= 0)
    many = np.diff(items.first)[found[known]]
    to = np.repeat(items.first[found[known]] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    at = np.repeat(at[known], many)
    return at, items.item[to], at - items.place[to], items.seed[to]


def best_items(h: np.ndarray, doc: np.ndarray, items: Items, texts: int) -> list[tuple[int, int, int]]:
    """(text number, item, score) of every item that reaches the threshold somewhere in a text."""
    at, grams, _ = grams_of(h, doc, items.lengths)
    pos, item, start, seed = hits_of(items.find(grams), at, items)
    if not len(pos):
        return []
    edge = np.searchsorted(doc, np.arange(texts + 1))
    size = np.array([len(w) for w in items.words])
    order = np.lexsort((start, item, doc[pos]))
    pos, item, start, seed, owner = pos[order], item[order], start[order], seed[order], doc[pos[order]]
    new = np.ones(len(pos), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (item[1:] != item[:-1]) | (start[1:] - start[:-1] > size[item[1:]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(pos))
    enough = (last - first) * 10 >= 4 * size[item[first]] - 20  # repeated hits only add
    enough &= np.add.reduceat(seed.astype(np.int64), first) > 0
    out: dict[tuple[int, int], int] = {}
    for a, b in zip(first[enough].tolist(), last[enough].tolist()):
        i, d = int(item[a]), int(owner[a])
        slack = size[i]
        lo, hi = max(edge[d], start[a] - slack), min(edge[d + 1], start[b - 1] + size[i] + slack)
        score = alignment(items.words[i], h[lo:hi])
        if score * 10 >= NEEDED * 10 * MATCH * size[i] and score > out.get((d, i), 0):
            out[d, i] = score
    return [(d, i, s) for (d, i), s in out.items()]


def _blocks(items: DataFrame):
    """Lists of (item_id, text), in order of a hash, each of about BLOCK_BYTES at most."""
    size = items.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).select("item_id", "text").orderBy("item_id").collect()
        if rows:
            yield [r[0] for r in rows], [r[1] for r in rows]


def find_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, item_id (best, ties to the smallest), score (share of the item's best) and n_items of every row.

    Null and empty texts are clean; very long ones are searched whole; an empty table of documents gives an empty table. Items without words match nothing; one of a single word matches wherever it stands.
    Repeated rows are judged alike, repeated items counted one by one. Columns other than doc_id, item_id
    and text are not looked at; without items every row is clean. Each row has one result for each block
    of items, and blocks are merged by a grouped maximum over a row number that is fixed beforehand.
    """
    docs, kind = docs.select("doc_id", "text"), dict(benchmark.dtypes)["item_id"]
    results = [_search(docs, ids, texts, kind) for ids, texts in _blocks(benchmark)]
    if not results:
        none = F.lit(None)
        return docs.select("doc_id", F.lit(False).alias("contaminated"), none.cast(kind).alias("item_id"), none.cast("double").alias("score"), F.lit(0).cast("long").alias("n_items"))
    if len(results) == 1:
        return results[0].drop("digest")
    merged = results[0]
    for r in results[1:]:
        merged = merged.unionByName(r)
    # Rows equal in doc_id and text have equal results in every block: one of each is kept per block.
    best = F.min(F.when(F.col("score").isNotNull(), F.struct((-F.col("score")).alias("less"), "item_id", "score")))
    keyed = merged.groupBy("doc_id", "digest").agg(best.alias("x"), (F.sum("n_items") / (F.count(F.lit(1)) / len(results))).cast("long").alias("n_items"), (F.count(F.lit(1)) / len(results)).cast("int").alias("copies"))
    keyed = keyed.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return keyed.select("doc_id", (F.col("n_items") > 0).alias("contaminated"), F.col("x.item_id").alias("item_id"), F.col("x.score").alias("score"), "n_items")


def _search(docs: DataFrame, ids: list, texts: list, kind: str) -> DataFrame:
    items = Items(texts)

    def count(batches):
        for _, data, off in byte_batches(batches, "text"):
            _, _, doc, h = words(data, off, True, True)
            at, grams, _ = grams_of(h, doc, items.lengths)
            found = items.find(grams)
            pair = np.unique(doc[at[found >= 0]].astype(np.int64) * max(len(items.grams), 1) + found[found >= 0])
            gram, n = np.unique(pair % max(len(items.grams), 1), return_counts=True)
            yield pa.RecordBatch.from_pydict({"gram": pa.array(gram, pa.int64()), "n": pa.array(n, pa.int64())})

    sums = docs.select("text").mapInArrow(count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n")).collect()  # at most the block's n-grams
    frequency = np.zeros(len(items.grams), np.int64)
    for gram, n in sums:
        frequency[gram] = n
    items.rank(frequency)

    def search(batches):
        for rows, data, off in byte_batches(batches, "text"):
            _, _, doc, h = words(data, off, True, True)
            n = len(off) - 1
            best: list = [None] * n
            score, many = [None] * n, np.zeros(n, np.int64)
            for d, i, s in sorted(best_items(h, doc, items, n), key=lambda x: (x[0], ids[x[1]] is None, ids[x[1]])):
                many[d] += 1
                share = s / (MATCH * len(items.words[i]))
                if score[d] is None or share > score[d]:
                    best[d], score[d] = ids[i], share
            names = rows.schema.names
            yield pa.RecordBatch.from_arrays(
                [rows.column(names.index("doc_id")), rows.column(names.index("digest")), pa.array(many > 0), pa.array(best, pa.int64() if kind == "bigint" else None), pa.array(score, pa.float64()), pa.array(many, pa.int64())],
                names=["doc_id", "digest", "contaminated", "item_id", "score", "n_items"],
            )

    id_kind = dict(docs.dtypes)["doc_id"]
    return docs.withColumn("digest", F.xxhash64("text")).mapInArrow(search, f"doc_id {id_kind}, digest bigint, contaminated boolean, item_id {kind}, score double, n_items bigint")


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    return find_contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

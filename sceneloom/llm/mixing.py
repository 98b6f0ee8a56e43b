"""Mixing sources to target weights by hash thresholds.

Sizes (words) are summed by source and bucket of a document's hash.  A running sum over the buckets shows
in which one a source's budget runs out; only that boundary bucket is summed again by the next bits of
the hash, until 36 bits are fixed.  A document is then taken by comparing its hash with its source's
threshold: nothing is sorted by document, and thresholds are nested (a larger budget takes a superset).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sceneloom.functions.ranking import numbered

from .common import byte_batches, documents, small_enough, words, written

#: Fixed by the contract: weights by code point of the source, repeating; share of all sizes; most times a document is taken.
WEIGHTS, SHARE, EPOCHS = (5, 2, 1), 1.5, 2
LEVELS, BITS = 3, 12


def count_words(df: DataFrame, text: str = "text", out: str = "size") -> DataFrame:
    """df with the text column replaced by its number of words (null: 0)."""
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c != text) + f", `{out}` bigint"

    def run(batches):
        for rows, data, off in byte_batches(batches, text):
            n = np.bincount(words(data, off)[2], minlength=len(off) - 1)
            keep = [i for i, name in enumerate(rows.schema.names) if name != text]
            yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in keep), pa.array(n, pa.int64())], names=[*(rows.schema.names[i] for i in keep), out])

    return df.mapInArrow(run, schema)


def targets(sizes: DataFrame, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target): budgets by weight, stopped at `epochs` times a source's size, the excess reshared by weight.

    Sources are numbered by ranges. The level (words a unit of weight) rises from that of all sources: those that are full below it leave,
    the rest share what they leave, until none is full below the level. A round sums over the table of sources; two numbers reach the
    driver. A round more is needed only if the last filled sources, so rounds are few (as many as sources at worst). An empty table gives no rows.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_last", F.col("source").isNull())
    per = numbered(per, ["_last", "source"], "number", start=0)
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("number") % len(WEIGHTS) + 1).cast("int")))
    per = written(per.withColumn("ratio", epochs * F.col("source_size") / F.col("w")).drop("_last", "number"))
    budget = share * (per.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, None
    while True:
        left = F.col("ratio") < level
        filled, weight, n = per.agg(F.sum(F.when(left, epochs * F.col("source_size"))), F.sum(F.when(~left, F.col("w"))), F.count_if(left)).first()
        if n == full:
            break
        full, level = n, (budget - (filled or 0)) / weight if weight else float("inf")
    target = F.when(F.col("ratio") <= level, (epochs * F.col("source_size")).cast("double")).otherwise(F.lit(level) * F.col("w"))
    return per.select("source", "source_size", target.alias("target"))


def thresholds(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """goals with `full` (times that every document is taken) and `threshold` (36-bit: smaller hashes are taken once more).

    sizes: source, size, h (36-bit hash).  Each level sums only the bucket in which a budget ran out.
    """
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = goals.withColumn("full", full).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    state = written(state.withColumn("prefix", F.lit(0).cast("long")).withColumn("spent", F.lit(0).cast("long")))
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        inside = with_source(sizes, state.select("source", "prefix")).where(F.shiftright("h", shift + BITS) == F.col("prefix"))
        sums = inside.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("m"))
        rows = with_source(sums, state)
        upto = F.col("spent") + F.sum("m").over(Window.partitionBy("source").orderBy("bucket"))
        rows = rows.withColumn("upto", upto).where(F.col("upto") > F.col("rest"))
        first = rows.groupBy("source").agg(F.min(F.struct("bucket", "upto", "m")).alias("x"))
        out = with_source(state, first, "left")
        out = out.withColumn("spent", F.coalesce(F.col("x.upto") - F.col("x.m"), F.col("spent")))
        # Without a boundary (a source without words), an empty prefix; at the last level, whichever side of the boundary is nearer.
        state = written(out.withColumn("prefix", F.coalesce("x.bucket", F.shiftleft("prefix", BITS))).withColumn("last", F.coalesce("x.m", F.lit(0))).drop("x"))
    over, under = F.col("spent") + F.col("last") - F.col("rest"), F.col("rest") - F.col("spent")
    above = ((F.col("last") > 0) & (under > 0) & (over <= under)).cast("long")
    return state.withColumn("threshold", F.col("prefix") + above).drop("rest", "prefix", "spent", "last")


def with_source(rows: DataFrame, per_source: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined with a table of one row per source; broadcast within its measured bound, else shuffled (skew is left to adaptive joins)."""
    right = per_source.withColumnRenamed("source", "_source")
    if small_enough(right):
        right = F.broadcast(right)
    return rows.join(right, rows["source"].eqNullSafe(right["_source"]), how).drop("_source")


def document_hash(column: str = "doc_id", text: str = "text"):
    """36 bits of the md5 of an id's digits, the same in any SQL engine; without an id, of the text, and without that, of nothing."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(column).cast("string"), F.col(text), F.lit(""))), 1, 9), 16, 10).cast("long")


def source_thresholds(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sizes of every row of docs, one row of budget and threshold per source)."""
    sizes = written(count_words(docs.select("doc_id", "source", "text", document_hash().alias("h"))))
    return sizes, thresholds(sizes, targets(sizes))


def copies():
    return F.col("full") + (F.col("h") < F.col("threshold")).cast("long")


def take(docs: DataFrame) -> DataFrame:
    """docs as the mix takes them: each row 0, 1 or 2 times, whole, with its own columns (doc_id, source and text among them).

    Rows with one doc_id share one decision, rows without one by their text. A null source is the last source;
    null and empty texts have no words and are not taken; an empty table stays empty; texts are counted whole.
    """
    names = docs.columns
    state = source_thresholds(docs)[1].select("source", "full", "threshold")
    rows = docs.select(F.struct(*names).alias("row"), F.col("source").alias("source"), document_hash().alias("h"))
    rows = with_source(rows, state).select("row", F.explode(F.array_repeat(F.lit(0), copies().cast("int"))))
    return rows.select("row.*").select(*names)


def mix_sources(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, h, source_size, target, copies (0 to 2), taken of every row of docs.

    Rows with one doc_id share one decision, rows without one by their text, so repeated rows are taken alike. Null sources are one source,
    the last. Empty and null texts have size 0 and take nothing. An empty table gives an empty table.
    """
    sizes, state = source_thresholds(docs)
    return with_source(sizes, state).withColumn("copies", copies()).withColumn("taken", F.col("copies") * F.col("size")).drop("full", "threshold")


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 9))::BIGINT AS h FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size,
             CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s GROUP BY source),
r AS (SELECT *, 2 * source_size / w::DOUBLE AS ratio FROM p),
l AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(2 * source_size) OVER b, 0)::DOUBLE)
                / ((sum(w) OVER ()) - coalesce(sum(w) OVER b, 0))::DOUBLE AS level
      FROM r WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1),
g AS (SELECT source, source_size, CASE WHEN coalesce((SELECT level FROM k), 'inf'::DOUBLE) >= ratio
             THEN (2 * source_size)::DOUBLE ELSE (SELECT level FROM k) * w END AS target FROM l),
f AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS full_ FROM g),
c AS (SELECT source, h, sum(size) AS m FROM s GROUP BY ALL),
u AS (SELECT c.*, sum(m) OVER (PARTITION BY source ORDER BY h) AS upto FROM c),
t AS (SELECT s.doc_id, s.size, f.source_size, f.target, f.full_, f.target - f.full_ * f.source_size AS rest, u.upto, u.m
      FROM s JOIN f ON s.source IS NOT DISTINCT FROM f.source JOIN u ON u.source IS NOT DISTINCT FROM s.source AND u.h = s.h)
SELECT doc_id, size, source_size, target,
       (size * (full_ + CASE WHEN upto <= rest OR (upto - m < rest AND upto - rest <= rest - (upto - m)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM t
"""

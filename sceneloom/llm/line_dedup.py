"""Line de-duplication by overlapping three-line windows (DataFrame operations only).

Each run of three consecutive lines is hashed to 128 bits.  Windows found more than once anywhere keep
their first occurrence (smallest doc_id, then earliest line); the lines that later occurrences cover are
merged into runs and removed.  The search moves hashes only; the text is moved once, to be cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, written

WIDTH = 3


def line_windows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, digest, pos, w1, w2) of each run of `width` lines; runs of blank lines only are left out."""
    line = F.split("text", "\n")
    hashes = lambda seed: F.transform(F.col("lines"), lambda x: F.xxhash64(F.lit(seed), x))
    df = docs.select("doc_id", F.xxhash64("text").alias("digest"), line.alias("lines"), F.transform(line, lambda x: F.trim(x) != "").alias("seen"))
    df = df.where(F.size("lines") >= width).select("doc_id", "digest", "seen", hashes(1).alias("a"), hashes(2).alias("b"))

    def window(i):
        at = lambda c, k: F.get(F.col(c), i + k)
        some = at("seen", 0)
        for k in range(1, width):
            some = some | at("seen", k)
        return F.struct(i.alias("pos"), F.xxhash64(*(at("a", k) for k in range(width))).alias("w1"), F.xxhash64(*(at("b", k) for k in range(width))).alias("w2"), some.alias("some"))

    all_ = F.transform(F.sequence(F.lit(0), F.size("a") - width), window)
    return df.select("doc_id", "digest", F.explode(all_).alias("w")).where("w.some").select("doc_id", "digest", "w.pos", "w.w1", "w.w2")


def covered_runs(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, digest, runs): maximal runs [start, stop) of lines that later occurrences of a repeated window cover."""
    spots = written(line_windows(docs, width))
    firsts = spots.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "digest", "pos")).alias("first"))
    later = spots.join(firsts.where("n > 1").drop("n"), ["w1", "w2"]).where(~F.struct("doc_id", "digest", "pos").eqNullSafe(F.col("first")))
    later = later.select("doc_id", "digest", "pos").distinct()
    order = Window.partitionBy("doc_id", "digest").orderBy("pos")
    gap = F.col("pos") > F.coalesce(F.lag("pos").over(order) + width, F.lit(-1))
    runs = later.withColumn("run", F.sum(gap.cast("int")).over(order)).groupBy("doc_id", "digest", "run").agg(F.min("pos").alias("start"), (F.max("pos") + width).alias("stop"))
    return runs.groupBy("doc_id", "digest").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("runs"))


def drop_repeated_lines(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, text, n_lines, n_removed, n_runs, kept (the text without the removed lines) of every row.

    Rows equal in doc_id and text are one document and judged alike. A null text stays null, without
    lines; a text of fewer than three lines has no window and stays whole. When all lines go, kept is ''.
    Other columns of docs are not looked at; an empty table gives an empty table; a very long text goes through whole.
    """
    runs = covered_runs(docs, width).select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "runs")
    rows = docs.select("doc_id", "text").withColumn("digest", F.xxhash64("text"))
    rows = rows.join(runs, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    lines = F.split("text", "\n")
    starts = F.concat(F.array(F.lit(0)), F.transform("runs", lambda r: r["stop"]))
    stops = F.concat(F.transform("runs", lambda r: r["start"]), F.array(F.size("lines")))
    rows = rows.withColumn("lines", lines)
    gaps = F.arrays_zip(starts.alias("a"), stops.alias("b"))
    kept = F.array_join(F.flatten(F.transform(gaps, lambda g: F.slice(F.col("lines"), g["a"] + 1, g["b"] - g["a"]))), "\n")
    removed = F.aggregate("runs", F.lit(0), lambda t, r: t + r["stop"] - r["start"])
    return rows.select(
        "doc_id", "text", F.greatest(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"),
        F.greatest(F.coalesce(F.size("runs"), F.lit(0)), F.lit(0)).cast("long").alias("n_runs"), F.when(F.col("runs").isNull(), F.col("text")).otherwise(kept).alias("kept"),
    )


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
w AS (SELECT doc_id, unnest(range(0, len(l) - 2)) AS pos, l FROM d WHERE len(l) >= 3),
v AS (SELECT doc_id, pos, l[pos + 1] AS a, l[pos + 2] AS b, l[pos + 3] AS c FROM w),
x AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS k FROM v
      WHERE trim(a) <> '' OR trim(b) <> '' OR trim(c) <> ''),
y AS (SELECT DISTINCT doc_id, pos + k AS p FROM (SELECT doc_id, pos FROM x WHERE k > 1), (VALUES (0), (1), (2)) AS t(k)),
n AS (SELECT doc_id, count(*) AS n_removed, sum(CASE WHEN q THEN 0 ELSE 1 END) AS n_runs
      FROM (SELECT *, coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) = 1, false) AS q FROM y) GROUP BY doc_id),
e AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS p FROM d),
k AS (SELECT e.doc_id, string_agg(line, chr(10) ORDER BY e.p) AS kept FROM e LEFT JOIN y ON y.doc_id = e.doc_id AND y.p = e.p WHERE y.p IS NULL GROUP BY e.doc_id)
SELECT d.doc_id, coalesce(len(l), 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_runs, 0)::BIGINT AS n_runs,
       CASE WHEN d.text IS NULL THEN NULL ELSE sha256(coalesce(kept, '')) END AS kept_sha256
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id
"""

"""A training corpus from raw documents: quality rules, near-duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.  All but the last
return the columns of docs. Rows are told apart by doc_id and text, so repeated rows are judged alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sceneloom.llm import decontaminate, mixing, ngram_join, quality, token_files
from sceneloom.llm.common import documents, drop_written, free_name, small_enough, written

#: Near-duplicates: five words and a similarity of 0.8.
WORDS, SIMILARITY = 5, (4, 5)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id replaced by (doc_id, hash of the text), which operators carry through."""
    return docs.select(F.struct("doc_id", F.xxhash64("text").alias("digest")).alias("doc_id"), "text")


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """docs without the rows that rejected (column doc_id: a key as _keyed makes them) names."""
    key, digest = free_name(docs, "_id"), free_name(docs, "_digest")
    keys = written(rejected.select(F.col("doc_id.doc_id").alias(key), F.col("doc_id.digest").alias(digest)).distinct())
    keys = F.broadcast(keys) if small_enough(keys) else keys
    return docs.join(keys, docs["doc_id"].eqNullSafe(F.col(key)) & (F.xxhash64(docs["text"]) == F.col(digest)), "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base test and whose posterior probability of being good is at least one half.

    Null, empty and short texts fail the base test. Rows that repeat doc_id and text are judged alike and all stay or go;
    other columns, whatever their names, are carried through; an empty table stays empty; texts are read whole.
    """
    return _without(docs, quality.judge(_keyed(docs)).where("not kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: its oldest text, by doc_id (null last).

    Rows are told apart by doc_id and text: different texts under one doc_id are judged by themselves, rows without a
    doc_id like others. Of rows that repeat both, the smallest in order of the other columns stays. Rows
    without words link with nothing and all stay. An empty table stays empty; a very long text costs what its words cost.
    """
    linked = ngram_join.link_documents(docs, WORDS, *SIMILARITY)
    standing = linked.where("key = first_key or n_shingles = 0").groupBy("key", "n_shingles").agg(F.count(F.lit(1)).alias("rows"))
    standing = written(standing.select("key", (F.col("n_shingles") > 0).alias("worded"), (F.col("rows") > 1).alias("repeated")))
    key, worded, repeated = (free_name(docs, x) for x in ("_key", "_worded", "_repeated"))
    keys = standing.select(F.col("key").alias(key), F.col("worded").alias(worded), F.col("repeated").alias(repeated))
    keys = F.broadcast(keys) if small_enough(keys) else keys
    found = docs.withColumn(free_name(docs, "_of"), F.xxhash64(F.col("doc_id").cast("long"), "text"))
    found = found.join(keys, F.col(free_name(docs, "_of")) == F.col(key))
    once = found.where(~(F.col(worded) & F.col(repeated))).select(*docs.columns)
    if standing.where("worded and repeated").isEmpty():
        return once
    rows = found.where(F.col(worded) & F.col(repeated)).groupBy(key).agg(F.min(F.struct(*docs.columns)).alias(worded))
    return once.unionByName(rows.select(*(F.col(worded)[c].alias(c) for c in docs.columns)))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a test item.

    Null and empty texts hold none and stay; rows that repeat doc_id and text all stay or go; other columns are
    carried through; without items all stay; an empty table stays empty; very long texts are searched whole.
    """
    found = decontaminate.find_contamination(_keyed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.where("contaminated"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them: not at all, once or twice.

    A null source is a source of its own. Rows without words have no size and are not taken. Rows that repeat doc_id and text
    are mixed one by one; other columns are carried through; an empty table stays empty.
    """
    return mixing.take(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the documents in ascending doc_id order, read back: doc_id, start, n_tokens, ids_crc32.

    Null texts count as empty and have the end id alone; null ids come first; repeated rows are written one by one; an
    empty table gives no rows; other columns are not looked at.
    """
    return token_files.write_and_read(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixture),
    ("token_output", token_output),
]
#: No SQL: expectation-maximisation and the tokenizer cannot be written in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            out = written(out)
            if k:
                drop_written(docs)
        docs = out
    return docs

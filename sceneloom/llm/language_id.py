"""Language identification of web pages by fusing evidence.

A page's text gives a likelihood for each language (hashed byte trigrams, fitted on labelled documents).
Three more sources add to it: the language that the markup declares, the address suffix, and a prior of
the page's host.  The first is weighed by a table of how often each declaration went with each language;
the priors are grouped sums of the text posteriors, smoothed from the whole corpus to the suffix, to the
domain, to the host, each level by pseudo-counts of the level above.  A page's own share is taken out of
its host's, domain's and suffix's sums, so no evidence counts twice.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_batches, mix, small_enough, written

BUCKETS = 1 << 14
#: The classifier is fitted on labelled documents whose id hashes below a threshold; about so many of them.
SAMPLE_DOCUMENTS = 20_000
#: Trigrams of a text depend on each other: a text counts as so many independent ones at most.
INDEPENDENT = 60.0
#: Pseudo-counts of the level above.
STRENGTH = {"suffix": 20.0, "domain": 10.0, "host": 5.0}

_DROP = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>", re.S | re.I)
_TAG = re.compile(r"<[^>]*>")
_LETTER = np.arange(256, dtype=np.uint8)
_LETTER[65:91] += 32
_LETTER[[*range(0, 65), *range(91, 97), *range(123, 128)]] = 32  # what is no letter counts as a space


def visible_text(markup: str | None) -> str:
    return html.unescape(_TAG.sub(" ", _DROP.sub(" ", markup or "")))


def trigrams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of each byte trigram with at most one space in it."""
    x = _LETTER[data].astype(np.uint64)
    if len(x) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero((x[:-2] == 32).astype(np.int8) + (x[1:-1] == 32) + (x[2:] == 32) < 2)
    doc = np.searchsorted(off, at, "right") - 1
    at, doc = at[(inside := at + 2 < off[doc + 1])], doc[inside]
    return doc, (mix(x[at] << np.uint64(16) | x[at + 1] << np.uint64(8) | x[at + 2]) % np.uint64(BUCKETS)).astype(np.int64)


def fit(docs: DataFrame, sample: int = SAMPLE_DOCUMENTS) -> tuple[list[str], np.ndarray]:
    """Languages and the log-likelihoods (languages x BUCKETS) of trigram buckets, from docs' text and lang.

    sample bounds the rows (by a hash of doc_id, so the choice is the same in every run). Rows without a
    language or text teach nothing.
    """
    n = docs.where("lang is not null and text is not null").count()
    share = min(1.0, sample / max(n, 1))
    part = docs.where("lang is not null and text is not null").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)

    def run(batches):
        for rows, data, off in byte_batches(batches, "text"):
            doc, bucket = trigrams(data, off)
            names = np.array(rows.column(rows.schema.get_field_index("lang")).to_pylist(), object)
            found, number = np.unique(names.astype(str), return_inverse=True)
            count = np.bincount(number[doc] * BUCKETS + bucket, minlength=len(found) * BUCKETS)
            at = np.flatnonzero(count)
            yield pa.RecordBatch.from_pydict({"lang": pa.array(found[at // BUCKETS].tolist(), pa.string()), "bucket": pa.array(at % BUCKETS, pa.int32()), "n": pa.array(count[at], pa.int64())})

    sums = part.select("lang", "text").mapInArrow(run, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n")).collect()  # languages x BUCKETS at most
    langs = sorted({r[0] for r in sums})
    table = np.zeros((len(langs), BUCKETS))
    for lang, bucket, count in sums:
        table[langs.index(lang), bucket] = count
    table += 0.1
    return langs, np.log(table / table.sum(1, keepdims=True))


def text_evidence(pages: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """page_id, url, declared, n_trigrams and logp (log-likelihood by language, tempered) of every page."""

    tag = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]{2,3})", re.I)

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            markup = batch.column(names.index("html")).to_pylist()
            said = [m.group(1).lower() if (m := tag.search(x or "")) else None for x in markup]
            texts = pa.RecordBatch.from_pydict({"text": pa.array(map(visible_text, markup), pa.large_string())})
            scores, sizes = [], []
            for _, data, off in byte_batches(iter([texts]), "text"):
                doc, bucket = trigrams(data, off)
                n = np.bincount(doc, minlength=len(off) - 1)
                sums = np.stack([np.bincount(doc, row[bucket], minlength=len(n)) for row in table], 1) if len(langs) else np.zeros((len(n), 0))
                scores.append(sums * (np.minimum(n, INDEPENDENT) / np.maximum(n, 1))[:, None])
                sizes.append(n)
            flat = np.concatenate(scores)
            logp = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * len(langs), pa.int32()), pa.array(flat.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(names.index("page_id")), batch.column(names.index("url")), pa.array(said, pa.string()), pa.array(np.concatenate(sizes), pa.int64()), logp], names=["page_id", "url", "declared", "n_trigrams", "logp"])

    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, declared string, n_trigrams bigint, logp array<double>")


def _softmax(logp: Column) -> Column:
    shifted = F.transform(logp, lambda x: F.exp(x - F.array_max(logp)))
    return F.transform(shifted, lambda x: x / F.aggregate(shifted, F.lit(0.0), lambda a, b: a + b))


def _per_key(rows: DataFrame, sums: DataFrame, key: str) -> DataFrame:
    """rows joined with one row per key (null-safe); broadcast within its measured bound, else shuffled, where skew is left to adaptive joins."""
    right = sums.withColumnRenamed(key, "_key")
    right = F.broadcast(right) if small_enough(right) else right
    return rows.join(right, rows[key].eqNullSafe(right["_key"]), "left").drop("_key")


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, url, declared, suffix, domain, host, text_lang, lang, confidence of every page.

    docs gives the labelled text. Without any labelled text there is no language: lang, text_lang and
    confidence are null. A page without text has only the other evidence; a null address has a null host,
    domain and suffix, which are groups of their own. Ties go to the first language in order of code. Repeated
    rows are judged one by one, alike; other columns are not looked at; an empty table gives an empty table; very long
    pages are read whole.
    """
    langs, table = fit(docs)
    found = text_evidence(pages, langs, table)
    host = F.nullif(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))
    found = found.withColumn("host", host).withColumn("suffix", F.element_at(F.split("host", r"\."), -1)).withColumn("domain", F.concat_ws(".", F.slice(F.split("host", r"\."), -2, 2)))
    found = found.withColumn("domain", F.when(F.size(F.split("host", r"\.")) > 1, F.col("domain")).otherwise(F.col("host")))
    named = F.array(*map(F.lit, langs)) if langs else F.array().cast("array<string>")
    if not langs:
        none = F.lit(None).cast("string")
        return found.select("page_id", "url", "declared", "suffix", "domain", "host", none.alias("text_lang"), none.alias("lang"), F.lit(None).cast("double").alias("confidence"))
    found = written(found.withColumn("p", _softmax(F.col("logp"))))
    size = len(langs)
    total = [F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(size)]
    packed = lambda name: F.array(*(F.round(f"s{i}", 6) for i in range(size))).alias(name)  # noqa: E731  rounded: the order of a sum does not show
    sums = lambda key, name: found.groupBy(key).agg(*total).select(key, packed(name))
    rows = found.crossJoin(F.broadcast(found.agg(*total).select(packed("all_"))))  # one row
    for key in ("suffix", "domain", "host", "declared"):
        rows = _per_key(rows, sums(key, f"by_{key}"), key)
    own = lambda name: F.zip_with(F.coalesce(F.col(name), F.array(*[F.lit(0.0)] * size)), F.col("p"), lambda a, b: F.greatest(a - b, F.lit(0.0)))
    norm = lambda x, add: F.transform(x, lambda v: (v + add) / (F.aggregate(x, F.lit(0.0), lambda a, b: a + b) + add * size))
    prior = norm(own("all_"), 1.0)
    for key in ("suffix", "domain", "host"):
        rows = rows.withColumn("prior", prior).withColumn("own", own(f"by_{key}"))
        mass = F.aggregate("own", F.lit(0.0), lambda a, b: a + b) + STRENGTH[key]
        rows = rows.withColumn("prior2", F.zip_with("own", "prior", lambda n, p: (n + STRENGTH[key] * p) / mass))
        rows = rows.drop("prior", "own").withColumnRenamed("prior2", f"prior_{key}")
        prior = F.col(f"prior_{key}")
    # P(declaration | language), up to a constant: its own sums over all sums, smoothed; no declaration says nothing.
    rows = rows.withColumn("seen", own("by_declared")).withColumn("base", own("all_"))
    told = F.when(F.col("declared").isNull(), F.array_repeat(F.lit(0.0), size)).otherwise(F.zip_with("seen", "base", lambda n, m: F.log((n + 0.5) / (m + 0.5 * size))))
    score = F.zip_with(F.zip_with("logp", "prior_host", lambda a, b: a + F.log(b)), told, lambda a, b: a + b)
    rows = rows.withColumn("post", _softmax(score))
    best = lambda c: F.element_at(named, F.array_position(F.col(c), F.array_max(F.col(c))).cast("int"))
    return rows.select("page_id", "url", "declared", "suffix", "domain", "host", best("p").alias("text_lang"), best("post").alias("lang"), F.round(F.array_max("post"), 6).alias("confidence"))


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet"))

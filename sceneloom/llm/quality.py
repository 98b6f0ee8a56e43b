"""Quality rules by weak supervision.

Each rule votes good (2), bad (0) or abstains (1) on a document.  Documents are counted by their pattern
of votes (at most 3 ** rules patterns, whatever the corpus), expectation-maximisation over those counts
estimates each rule's accuracy on good and on bad documents and the share of good ones, and a document is
kept by the posterior probability of its pattern: no single rule decides, as all-must-pass filters do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_batches, documents, mix, span_hashes, windows, words, written

#: Common function words of the languages that the stop-word rule knows.
STOP_WORDS = (
    "the of and to in is that it was for on are with as be at by this have from or not "
    "le la les de des et un une du en est que qui dans pour pas sur au avec ce "
    "der die das und ist den von zu mit sich auf für nicht ein eine als auch dem "
    "el los las del y se por con una para su al lo como más pero sus"
).split()
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_UPPER, _LETTER, _LOUD = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = True
_LOUD[list(b"!?")] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_letters", "n_upper", "n_loud")


def _stop_hashes() -> np.ndarray:
    data = np.frombuffer(" ".join(STOP_WORDS).encode(), np.uint8)
    return np.unique(words(data, np.array([0, len(data)]))[3])


def text_counts(data: np.ndarray, off: np.ndarray, stop: np.ndarray) -> list[np.ndarray]:
    """COUNTS of each text of a batch."""
    n = len(off) - 1
    start, end, doc, h = words(data, off)
    per = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[off])
    inside = np.zeros(len(data) + 1, np.int8)
    inside[start] += 1
    np.subtract.at(inside, end, 1) if len(end) and len(np.unique(end)) != len(end) else inside.__setitem__(end, inside[end] - 1)
    inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
    chars = per(inside & ((data & 0xC0) != 0x80))
    # Lines with a word, hashed as they stand.
    cuts = np.flatnonzero(data == 10)
    first = np.sort(np.concatenate([off[:-1], cuts + 1]))
    owner = np.searchsorted(off, first, "right") - 1
    real = (owner < n) & (first < off[np.minimum(owner, n - 1) + 1])
    first, owner = first[real], owner[real]
    last = np.minimum(np.concatenate([first[1:], [len(data)]]), off[owner + 1])
    cut = (last > first) & (data[np.maximum(last, 1) - 1] == 10)
    last = last - cut
    worded = np.searchsorted(start, last, "left") > np.searchsorted(start, first, "left")
    lines, line_doc = span_hashes(data, first[worded], last[worded]), owner[worded]
    key = np.unique(lines ^ mix(line_doc.astype(np.uint64) + np.uint64(1)), return_index=True)[1]
    n_lines = np.bincount(line_doc, minlength=n)
    dup = n_lines - np.bincount(line_doc[key], minlength=n)
    # Words in three-word windows that the text has twice or more.
    at, grams = windows(h, doc, 3)
    _, inverse, count = np.unique(grams ^ mix(doc[at].astype(np.uint64) + np.uint64(1)), return_inverse=True, return_counts=True)
    covered = np.zeros(len(h) + 2, bool)
    again = at[count[inverse] > 1] if len(at) else at
    for k in range(3):
        covered[again + k] = True
    repeat = np.bincount(doc[covered[: len(h)]], minlength=n)
    low = words(data, off, True)[3]
    stops = np.bincount(doc[stop[np.minimum(np.searchsorted(stop, low), len(stop) - 1)] == low], minlength=n)
    return [np.bincount(doc, minlength=n), chars, per(SYMBOLS[data]), dup, repeat, n_lines, stops, per(_LETTER[data]), per(_UPPER[data]), per(_LOUD[data])]


def count_features(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS (long) of every row of docs, from its whole text; a null text counts as empty."""

    def run(batches):
        stop = _stop_hashes()
        for rows, data, off in byte_batches(batches, "text"):
            counts = [pa.array(x.astype(np.int64)) for x in text_counts(data, off, stop)]
            yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index("doc_id")), *counts], names=["doc_id", *COUNTS])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} bigint" for c in COUNTS))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, 0).when(good, 2).otherwise(1)


def rules() -> dict[str, Column]:
    """Votes over COUNTS. A rule that has nothing to judge abstains."""
    c, some = F.col, F.col("n_words") > 0
    per_word = lambda x: F.col(x) / F.greatest(F.col("n_words"), F.lit(1))
    upper = c("n_upper") / F.greatest(c("n_letters"), F.lit(1))
    long_words = c("word_chars") / F.greatest(c("n_words"), F.lit(1))
    dup = c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1))
    return {
        "length": _vote(c("n_words") < 50, c("n_words") >= 80),
        "symbols": _vote(some & (per_word("n_symbols") > 0.1), some & (per_word("n_symbols") < 0.02)),
        "repeats": _vote(some & (per_word("n_repeat_words") > 0.3), some & (per_word("n_repeat_words") < 0.1)),
        "lines": _vote((c("n_lines") > 1) & (dup > 0.3), (c("n_lines") > 1) & (dup < 0.1)),
        "case": _vote((c("n_letters") > 0) & (upper > 0.4), (c("n_letters") > 0) & (upper < 0.2)),
        "word_length": _vote(some & ((long_words < 2) | (long_words > 14)), some & long_words.between(3, 10)),
        "stop_words": _vote((c("n_words") >= 50) & (per_word("n_stop_words") < 0.005), (c("n_words") >= 50) & (per_word("n_stop_words") > 0.03)),
        "loud": _vote(some & (per_word("n_loud") > 0.3), some & (per_word("n_loud") < 0.05)),
    }


def fit(votes: np.ndarray, weight: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good for each pattern, accuracies (2 x rules: on bad, on good) and the prior of good.

    votes: patterns x rules in {0, 1, 2}; weight: documents of each pattern. Starts from rules that catch
    three bad documents in ten and wrong two good ones in a hundred: a bad document breaks few of the
    rules. The start also fixes which of the two classes is the good one.
    """
    start = np.array([[0.3], [0.98]])
    rights, prior = np.repeat(start, votes.shape[1], 1), 0.8
    post = np.full(len(votes), prior)
    for _ in range(rounds):
        said_good, said_bad = votes == 2, votes == 0
        like_good = np.log(prior) + said_good @ np.log(rights[1]) + said_bad @ np.log1p(-rights[1])
        like_bad = np.log1p(-prior) + said_bad @ np.log(rights[0]) + said_good @ np.log1p(-rights[0])
        new = 1 / (1 + np.exp(np.clip(like_bad - like_good, -700, 700)))
        good, bad = weight * new, weight * (1 - new)
        prior = float((good.sum() + 8) / (weight.sum() + 10))
        # Ten pseudo-documents of each class, as at the start.
        rights = np.stack([(bad @ said_bad + 10 * start[0]) / (bad @ (said_bad | said_good) + 10), (good @ said_good + 10 * start[1]) / (good @ (said_good | said_bad) + 10)])
        rights = np.clip(rights, 1e-6, 1 - 1e-6)
        if np.abs(new - post).max(initial=0) < 1e-9:
            break
        post = new
    return post, rights, prior


def judge(docs: DataFrame, keep: float = 0.5) -> DataFrame:
    """doc_id, COUNTS, base_failed, quality (posterior probability of good) and kept of every row of docs.

    base_failed: under 50 words, or over half of the words repeat in three-word windows; then kept is
    false. Null and empty texts have no words and so fail. Repeated rows are judged one by one, alike.
    Columns of docs other than doc_id and text are not looked at; an empty table gives an empty table; a very long
    text is counted whole, as a batch by itself.
    """
    named = rules()
    pattern = sum((v * 3**k for k, v in enumerate(named.values())), F.lit(0)).cast("int")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counted = written(count_features(docs).withColumn("pattern", pattern).withColumn("base_failed", failed))
    passed = F.sum((~F.col("base_failed")).cast("double"))  # what the base test rejects is decided and teaches nothing
    found = counted.groupBy("pattern").agg(passed).orderBy("pattern").collect()  # at most 3 ** rules rows
    codes = np.array([r[0] for r in found], np.int64)
    votes = codes[:, None] // 3 ** np.arange(len(named)) % 3
    post = fit(votes, np.array([r[1] for r in found], float))[0]
    table = docs.sparkSession.createDataFrame([(int(c), float(p)) for c, p in zip(codes, post)], "pattern int, quality double")
    out = counted.join(F.broadcast(table), "pattern").drop("pattern")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= keep))


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = judge(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality"))

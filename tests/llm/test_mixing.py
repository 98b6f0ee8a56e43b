"""Mixing against a plain reading of its contract."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sceneloom.llm import mixing

SCHEMA = "doc_id bigint, source string, text string, size string, H string"


def brute_targets(size, share_of_all=1.5):
    """Budgets by weight, the excess of full sources shared again until none is above."""
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    budget, full = share_of_all * sum(size.values()), set()
    while True:
        free = [s for s in order if s not in full]
        rest = budget - sum(2 * size[s] for s in full)
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * size[s]}
        if not over:
            return {s: 2.0 * size[s] if s in full else share[s] for s in order}
        full |= over


def rows_of(spark, docs):
    return [(i, s, t, "x", "y") for i, s, t in docs], SCHEMA


@pytest.mark.parametrize("skewed", [False, True])
def test_targets_and_totals(spark, skewed):
    docs = []
    for i in range(600):
        source = "hot" if skewed and i % 3 else (None if i % 11 == 0 else f"s{i % 7}")
        docs.append((i, source, None if i % 50 == 0 else "w " * (i * 7 % 23)))
    docs += [docs[5], docs[5], (None, "s1", "a b c")]
    out = mixing.mix_sources(spark.createDataFrame(*rows_of(spark, docs))).collect()
    size = Counter()
    for _, s, t in docs:
        size[s] += len((t or "").split())
    want, taken = brute_targets(size), defaultdict(int)
    assert len(out) == len(docs)
    for r in out:
        assert r["source_size"] == size[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, total in taken.items():
        assert abs(total - want[s]) <= 23 * 2


def test_take_repeats_rows(spark):
    docs = spark.createDataFrame([(i, f"s{i % 3}", "a b c d") for i in range(90)], "doc_id bigint, source string, text string")
    kept = mixing.take(docs)
    assert kept.columns == docs.columns
    assert abs(kept.count() - 135) <= 3
    assert kept.groupBy("doc_id").count().agg(F.max("count")).first()[0] == 2


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, source string, text string")
    assert mixing.mix_sources(docs).count() == 0
    assert mixing.take(docs).count() == 0


def test_no_words(spark):
    docs = spark.createDataFrame([(1, "a", ""), (2, None, None)], "doc_id bigint, source string, text string")
    assert {(r["doc_id"], r["taken"], r["target"]) for r in mixing.mix_sources(docs).collect()} == {(1, 0, 0.0), (2, 0, 0.0)}


@pytest.mark.parametrize("share", [1.5, 0.1, 2.5])
def test_targets_of_many_sources(spark, share):
    """Sources of geometric sizes fill up round after round; equal sizes tie; some are empty."""
    size = {f"s{k:04}": (2 ** (k % 40) if k % 3 else k % 7) for k in range(500)} | {None: 90}
    rows = spark.createDataFrame(list(size.items()), "source string, size bigint").repartition(5)
    out = {r["source"]: r for r in mixing.targets(rows, share=share).collect()}
    want = brute_targets(size, share)
    assert set(out) == set(size)
    for s, r in out.items():
        assert r["source_size"] == size[s] and r["target"] == pytest.approx(want[s])

"""Every operator and every stage of the pipeline on awkward tables: nulls in any column, empty and very long texts, ties, repeated rows, clashing names, no rows."""

import pytest

import corpus_pipeline
from sceneloom.llm import decontaminate, language_id, licenses, line_dedup, mixing, ngram_join, quality, sharding, substring_dedup, token_files

SF = "/root/testdata/sf0.001"
#: Names that the operators use for columns of their own.
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, `Row` string, digest string, pos string, h string, component_id string, n string, pattern int, shard int, slot string, _block string, part string, _id string, _digest string"
GOOD = "the town and the garden of the old house are on the hill with a view to the sea . " * 12


def row(doc_id, text, source="a"):
    return (doc_id, text, None, source, None, 3, "r", None, "p", "h", "c", "n", 1, 2, "s", "b", "p", None, "d")


@pytest.fixture(scope="module")
def awkward(spark):
    long = " ".join(f"w{i % 5003}x{i}" for i in range(60_000))
    rows = [row(1, GOOD), row(1, GOOD), row(2, GOOD), row(3, None), row(4, ""), row(None, GOOD), row(None, None, None), row(5, long), row(6, long + " end", None), row(7, "a b"), row(7, "c d e"), row(8, " \n\t "), row(9, "日本語 " * 70)]
    return spark.createDataFrame(rows, SCHEMA)


OPERATORS = {
    "ngram_join": ngram_join.link_documents,
    "sharding": lambda d: sharding.uniform_shards(d, 3),
    "quality": quality.judge,
    "token_files": token_files.write_and_read,
    "substring_dedup": substring_dedup.drop_repeated_strings,
    "mixing": mixing.mix_sources,
    "line_dedup": line_dedup.drop_repeated_lines,
    "licenses": licenses.scan,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(awkward, name):
    run = OPERATORS[name]
    got, want = run(awkward), sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in awkward.select("doc_id").collect())
    assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in got.collect()) == want
    assert run(awkward.where("false")).count() == 0
    assert run(awkward.where("text is null")).count() == 2


def test_decontamination(spark, awkward):
    items = spark.createDataFrame([(1, None, "x"), (None, "nothing that any text has at all", "y"), (3, "a view to the sea . the town and the garden of the old house", "z")], "item_id bigint, text string, doc_id string")
    out = decontaminate.find_contamination(awkward, items)
    assert out.count() == 13 and {r["doc_id"] for r in out.where("contaminated").collect()} == {None, 1, 2}
    assert decontaminate.find_contamination(awkward.where("false"), items).count() == 0
    assert not decontaminate.find_contamination(awkward, items.where("false")).where("contaminated").count()


def test_language_id(spark):
    docs = spark.createDataFrame([(1, "the house and the garden " * 5, "en", 1), (None, "das haus und der garten " * 5, "de", 2), (3, None, "fr", None), (4, "x", None, None)], "doc_id bigint, text string, lang string, p int")
    rows = [(1, "http://a.example.de/1", "<p>the house and the garden</p>", 1)] * 2 + [(None, None, None, None), (4, "", "", 0), (5, "http://u@[::1]:80/x", "<p>" + "das haus und der garten " * 20_000, 2), (6, "http://x", "<html lang=''>", 3)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, host int")
    out = language_id.identify(pages, docs).collect()
    assert len(out) == 6 and [r["lang"] for r in out if r["page_id"] == 1] == ["en", "en"] and [r["lang"] for r in out if r["page_id"] == 5] == ["de"]
    assert language_id.identify(pages.where("false"), docs).count() == 0


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stage(spark, awkward, k):
    name, stage = corpus_pipeline.STAGES[k]
    for docs in (awkward, awkward.where("text is null"), awkward.where("false")):
        out = stage(spark, docs, SF)
        rows = out.collect()
        if name == "token_output":
            assert len(rows) == docs.count()
            continue
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in docs.collect()}
    assert stage(spark, awkward.where("false"), SF).count() == 0


def test_stage_decisions(spark, awkward):
    kept = corpus_pipeline.quality_rules(spark, awkward, SF)
    assert {r["doc_id"] for r in kept.collect()}.isdisjoint({3, 4, 7, 8})
    alone = corpus_pipeline.near_duplicates(spark, awkward, SF)
    # Documents 1, 2 and one without an id are one text, 5 and 6 nearly; the two texts of 7 both stay; those without text link with nothing.
    assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in alone.collect()) == [-1, 1, 3, 4, 5, 7, 7, 8, 9]
    mixed = corpus_pipeline.mixture(spark, awkward, SF)
    assert max(n for _, n in mixed.groupBy("doc_id", "text").count().select("text", "count").collect()) <= 4

"""Vector codes, fill-in-the-middle and sentence pieces against brute force, the library and DuckDB; awkward rows; round trips."""

import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest

from sceneloom.llm import infill, sentence_pieces, vector_codes
from sceneloom.llm.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, n string, form int, `Output` string, ids string, digest string"
ALPHABET = ["a", "b", "the", " ", "  ", "▁", "\n", "é", "日本", "😀", "\x00", "<P>", "<", "S>", "word ", "ing", "\t", "▁▁", "x\n"]


def texts(n=120, seed=3):
    rng = random.Random(seed)
    made = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 25))) for _ in range(n)]
    return [None, "", " ", "\n", "\n\n\n", "▁", "<P>", "a<M>b", "no end", *made, *made[:5], "long words and lines\n" * 30_000, "x" * 20_000]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "n", 1, "o", "i", "d") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, [*enumerate(texts()), (None, "no id\nat all"), (None, None), (3, "\n")]).repartition(3)


@pytest.mark.parametrize("name", ["op6_suffix_dedup", "op11_vector_codes", "op12_fill_in_middle"])
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    rel = con.sql(SQL[name])
    got = QUERIES[name](spark, DATA)
    assert sorted(rel.columns) == sorted(got.columns)
    assert sorted(map(str, (tuple(r[c] for c in rel.columns) for r in got.collect()))) == sorted(map(str, rel.fetchall()))


def split(text, doc_id):
    """The forms, counts and output of one text, as the definition says."""
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text
    if h4 % 100 < 50:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(docs):
    rows = infill.restore(infill.transform(docs)).collect()
    want = sorted(str((r["doc_id"], *split(r["text"] or "", r["doc_id"]), r["text"] or "")) for r in docs.collect())
    assert sorted(str((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["restored"])) for r in rows) == want
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}
    assert infill.restore(infill.transform(docs.where("false"))).count() == 0
    assert {r["form"] for r in infill.transform(docs, rate=0).collect()} == {"plain"}
    assert {r["form"] for r in infill.transform(docs, suffix_first=0).collect()} == {"plain", "psm"}


def test_outputs_that_cannot_be_restored():
    data = np.frombuffer(b"<P>a<S>b", np.uint8)
    with pytest.raises(ValueError):
        infill.put_back(data, np.array([0, len(data)]), np.array([infill.PSM]))


def test_sentence_pieces(docs):
    from sentencepiece import SentencePieceProcessor

    tool = SentencePieceProcessor(model_file=sentence_pieces.model_path())
    rows = sentence_pieces.decode(sentence_pieces.encode(docs)).collect()
    want = []
    for r in docs.collect():
        ids = tool.encode(r["text"] or "", add_bos=True, add_eos=True)
        want.append(str((r["doc_id"], np.array(ids, "<u4").tobytes(), tool.decode(ids))))
    assert sorted(str((r["doc_id"], bytes(r["ids"]), r["text"])) for r in rows) == sorted(want)
    assert sentence_pieces.decode(sentence_pieces.encode(docs.where("false"))).count() == 0


def test_decoding_of_any_ids(spark):
    table = sentence_pieces.word_table(sentence_pieces.model_path())
    rng = random.Random(2)
    ids = [[rng.choice([rng.randrange(32_000), rng.randrange(3, 259), 0, 1, 2, 259]) for _ in range(rng.randint(0, 8))] for _ in range(300)]
    rows = spark.createDataFrame([(k, bytearray(np.array(i, "<u4").tobytes())) for k, i in enumerate(ids)] + [(300, None)], "doc_id bigint, ids binary")
    got = {r["doc_id"]: r["text"] for r in sentence_pieces.decode(rows).collect()}
    assert got == {**{k: table.processor.decode(i) for k, i in enumerate(ids)}, 300: ""}


def test_table_of_words_starts_anew(monkeypatch):
    monkeypatch.setattr(sentence_pieces, "TABLE_IDS", 40)
    table = sentence_pieces.WordTable(sentence_pieces.model_path())
    for k in range(30):
        raw = [f"word{k} and more{k * 7} of it".encode(), b"", b"the same words"]
        stops, ids = table.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        for j, text in enumerate(raw):
            assert ids[stops[j] : stops[j + 1]].tolist() == table.processor.encode(text.decode(), add_bos=True, add_eos=True)
    assert table.used < 200


def test_model_whose_pieces_cross_words_is_given_whole_texts():
    class Whole(sentence_pieces.WordTable):
        def __init__(self, path):
            super().__init__(path)
            self.apart = False

    table = Whole(sentence_pieces.model_path())
    raw = [b"a b  c", b"", b" d "]
    stops, ids = table.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert [ids[a:b].tolist() for a, b in zip(stops, stops[1:])] == [table.processor.encode(t.decode(), add_bos=True, add_eos=True) for t in raw]


@pytest.mark.parametrize("d,k", [(4, 64), (1, 5), (8, 3), (4, 1), (3, 40)])
def test_nearest_entry(d, k):
    rng = np.random.default_rng(d * k)
    for spread in (3, 30, 1 << 20):  # many ties, few, none
        book, x = rng.integers(-spread, spread, (k, d)), rng.integers(-spread, spread, (800, d))
        arg, best = vector_codes.nearest(x, book)
        away = ((x[:, None] - book) ** 2).sum(2)
        assert (arg == away.argmin(1)).all() and (best == away.min(1)).all()


def codes_of(rows, parts, entries, rounds):
    """Codes, errors and codebooks by brute force of (vec_id, vector) rows, all usable."""
    rows = sorted(rows)
    d = len(rows[0][1]) // parts
    cut = [[[math.floor(256 * x) for x in v[p * d : p * d + d]] for p in range(parts)] for _, v in rows]
    books = [[cut[k][p] for k in range(min(entries, len(rows)))] for p in range(parts)]

    def assign():
        away = [[[sum((a - b) ** 2 for a, b in zip(c[p], e)) for e in books[p]] for p in range(parts)] for c in cut]
        return [[(min(w), w.index(min(w))) for w in row] for row in away]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [c[p] for c, f in zip(cut, found) if f[p][1] == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine)]
    return {r[0]: ("".join("%02x" % e for _, e in f), sum(w for w, _ in f)) for r, f in zip(rows, assign())}, books


def test_vector_codes(spark):
    rng = random.Random(8)
    good = [(k, [rng.choice([-0.5, 0.1, 0.25, rng.uniform(-1, 1)]) for _ in range(8)]) for k in range(1, 90)]
    good = [(k, [float(np.float32(x)) for x in v]) for k, v in good] + [(90, good[3][1]), (91, good[3][1])]
    good = [(k, [float(np.float32(x)) for x in v]) for k, v in good]
    odd = [(0, None), (-1, [1.0, None] * 4), (-2, [math.nan] * 8), (-3, [math.inf] + [0.0] * 7), (100, [1.0] * 12), (101, []), (102, [1e30] + [0.0] * 7), (103, [1.0] * 3)]
    rows = [(k, v, None if k % 7 == 0 else k % 3, "c") for k, v in good + odd]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, code string").repartition(4)
    coded, books = vector_codes.compress(table, parts=4, entries=16, rounds=2)
    want, want_books = codes_of(good, 4, 16, 2)
    got = vector_codes.with_label_errors(coded).collect()
    assert books.tolist() == want_books
    assert {r["vec_id"]: (r["code"], r["error"]) for r in got} == {**want, **dict.fromkeys((100, 101, 102, 103), (None, None))}
    sums = {}
    for k, _, label, _ in rows:
        sums[label] = sums.get(label, 0) + want.get(k, ("", 0))[1]
    label = {k: x for k, _, x, _ in rows}
    assert all(r["label_error"] == sums[label[r["vec_id"]]] for r in got) and len(got) == 95


def test_vector_codes_without_or_with_few_rows(spark):
    table = spark.createDataFrame([(5, [0.5] * 4, 1), (5, [0.25] * 4, None), (None, [-0.5] * 4, None)], "vec_id bigint, embedding array<float>, label int")
    coded, books = vector_codes.compress(table, parts=2)
    assert books[0].tolist() == [[64, 64], [128, 128], [-128, -128]] and {r["error"] for r in coded.collect()} == {0}
    none, books = vector_codes.compress(table.where("false"))
    assert vector_codes.with_label_errors(none).count() == 0 and books.size == 0
    assert vector_codes.compress(table.where("false"))[0].count() == 0
    with pytest.raises(ValueError):
        vector_codes.compress(table, entries=257)


def test_hot_labels_without_a_broadcast_of_all_sums(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "small_enough", lambda df: False)
    monkeypatch.setattr(vector_codes, "HOT_SHARE", 0.05)
    coded = spark.createDataFrame([(k, None if k < 40 else 0 if k < 60 else k, f"{k:02x}", k) for k in range(100)] + [(100, 61, None, None)], "vec_id bigint, label int, code string, error bigint")
    got = {r["vec_id"]: r["label_error"] for r in vector_codes.with_label_errors(coded).collect()}
    want = {k: sum(range(40)) if k < 40 else sum(range(40, 60)) if k < 60 else k for k in range(100)} | {100: 61}
    assert got == want

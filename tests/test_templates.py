"""Templates, links and folding on small documents, with cycles, nulls and empty tables."""

import pytest
from pyspark.sql import functions as F

from sceneloom.functions.ranking import numbered
from sceneloom.functions.scalars import affine_text, number_text, position_char, preview, to_fixed
from sceneloom.operators import template, text, tree

SCHEMA = "id string, pid string, ord bigint, type string, name string, phase string, position string, symbol_id string, text string"
ROWS = [
    ("0:1", None, 0, "CANVAS", "Page", None, "!", None, None),
    ("0:2", "0:1", 1, "SLIDE_ROW", "row", None, "!", None, None),
    ("0:3", "0:2", 2, "SLIDE", "A", None, "!", None, None),
    ("0:4", "0:3", 3, "TEXT", "slot:text:title", None, "!", None, "old"),
    ("0:5", "0:3", 4, "GROUP", "gone", "REMOVED", "!", None, None),
    ("0:6", "0:5", 5, "TEXT", "below", None, "!", None, "kept"),
    ("0:7", "0:2", 6, "SLIDE", "B", None, "!", None, None),
    ("0:8", "0:7", 7, "INSTANCE", "i", None, "!", "0:9", None),
    ("0:9", None, 8, "SYMBOL", "s", None, "!", None, None),
    ("0:10", "0:9", 9, "INSTANCE", "j", None, "!", "0:9", None),
    ("0:11", "0:9", 10, "TEXT", "t", None, "!", None, None),
]


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_links_end_in_a_cycle(spark, nodes):
    got = [r["id"] for r in tree.walk_links(nodes, nodes.where("id = '0:7'")).orderBy("path").collect()]
    assert got == ["0:7", "0:8", "0:10", "0:11"]
    assert [r["id"] for r in tree.walk_links(nodes, nodes.where("id = '0:3'")).orderBy("path").collect()] == ["0:3", "0:4"]
    assert tree.walk_links(nodes, nodes.where("false")).count() == 0


def test_create_from_template(spark, nodes):
    layouts = spark.createDataFrame([("0:2", "0:3", "draft"), ("0:2", "0:7", "draft")], "row string, slide string, state string")
    wanted = spark.createDataFrame([(0, "0:3"), (1, "0:3")], "place bigint, root string")
    texts = spark.createDataFrame([(0, "title", "new"), (1, "#0:4", ""), (1, "slot:text:title", "never")], "place bigint, key string, text string")
    rows = nodes.where("type = 'SLIDE_ROW'").select("id", "ord")
    out = template.create_from_template(nodes, wanted, layouts, rows, texts).orderBy("ord").collect()
    got = [(r["id"], r["pid"], r["type"], r["text"]) for r in out if r["id"].startswith("200:")]
    # The live text below the removed group is cloned with its old parent.
    assert got == [
        ("200:12", "0:2", "SLIDE", None), ("200:13", "200:12", "TEXT", "new"), ("200:14", "0:5", "TEXT", "kept"),
        ("200:15", "0:2", "SLIDE", None), ("200:16", "200:15", "TEXT", " "), ("200:17", "0:5", "TEXT", "kept"),
    ]
    assert not {"0:3", "0:4", "0:5", "0:7", "0:8"} & {r["id"] for r in out} and {r["position"] for r in out if r["type"] == "SLIDE"} == {"!", '"'}
    with pytest.raises(ValueError, match="layout not found"):
        template.create_from_template(nodes, spark.createDataFrame([(0, "0:99")], "place bigint, root string"), layouts, rows, texts)
    with pytest.raises(ValueError, match="no slide row"):
        template.create_from_template(nodes, wanted, layouts, rows.where("false"), texts)


def test_errors(spark, nodes):
    with pytest.raises(ValueError, match="no draft"):
        template.publish(nodes.where("type <> 'SLIDE'"), nodes.where("false").select(F.col("id").alias("slide")))
    with pytest.raises(ValueError, match="node not found"):
        template.annotate(nodes, spark.createDataFrame([("9:9", "x")], "id string, name string"), "layout:")


def test_fold_up(spark, nodes):
    out = tree.fold_up(nodes, nodes.where("id in ('0:2', '0:9')"), lambda level: level.withColumn("text", F.concat("name", F.lit("("), "inner", F.lit(")"))))
    assert {r["id"]: r["text"] for r in out.collect()} == {"0:2": "row(A(slot:text:title())\nB(i()))", "0:9": "s(j()\nt())"}
    assert tree.fold_up(nodes, nodes.where("false"), lambda level: level).count() == 0


def test_paint_replacement(spark):
    kind = "array<struct<type:string,k:int>>"
    df = spark.createDataFrame([([("SOLID", 1), ("IMAGE", 2), ("IMAGE", 3)],), ([("SOLID", 1)],), (None,)], f"p {kind}")
    new = F.struct(F.lit("IMAGE").alias("type"), F.lit(9).alias("k"))
    assert [[x["k"] for x in r[0]] for r in df.select(template.with_paint(F.col("p"), new)).collect()] == [[1, 9, 3], [9], [9]]


def test_numbers(spark):
    values = [1.005, 0.125, -0.125, 2.675, 0.0, -0.0, 1234567.891, None, -2.5, 1e-9, 0.375]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select(to_fixed(F.col("x"), 2), number_text(F.col("x"))).collect()
    assert [r[0] for r in rows] == ["1.00", "0.13", "-0.13", "2.67", "0.00", "0.00", "1234567.89", None, "-2.50", "0.00", "0.38"]
    assert [r[1] for r in rows] == ["1.005", "0.125", "-0.125", "2.675", "0", "0", "1234567.891", None, "-2.5", "1e-9", "0.375"]
    big = [float("nan"), float("inf"), -float("inf"), 1e20, 1e21, 1.5e-7, 0.00025, 12345678.25, -1e15]
    shown = [r[0] for r in spark.createDataFrame([(v,) for v in big], "x double").select(number_text(F.col("x"))).collect()]
    assert shown == ["NaN", "Infinity", "-Infinity", "100000000000000000000", "1e+21", "1.5e-7", "0.00025", "12345678.25", "-1000000000000000"]


def test_utf16(spark):
    """Lengths, cuts and places count UTF-16 units; positions go on past ASCII."""
    texts = ["\U0001f600a\nb", "\U0001f600" * 30, "x" * 46 + "\U0001f600" * 3, "short"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    starts = {(r["doc_id"], r["line"]): (r["start"], r["length"]) for r in text.line_offsets(df).collect()}
    assert starts[0, 0] == (0, 3) and starts[0, 1] == (4, 1)
    cut = [r[0] for r in df.orderBy("doc_id").select(preview(F.col("text"))).collect()]
    assert cut == [texts[0], "\U0001f600" * 23 + "\ufffd...", "x" * 46 + "\ufffd...", "short"]
    places = [r[0] for r in spark.range(300).orderBy("id").select(position_char(F.col("id"))).collect()]
    assert places == [chr(33 + k) for k in range(300)]
    turn = spark.sql("select named_struct('m00', 0.0D, 'm01', -1.0D, 'm02', 3.0D, 'm10', 1.0D, 'm11', 0.0D, 'm12', 4.5D) t").select(affine_text(F.col("t"))).first()[0]
    assert turn == "matrix(0,1,-1,0,3,4.5)"


def test_numbered(spark):
    df = spark.range(1000).selectExpr("id", "cast(id * 7919 % 1009 as long) as k", "cast(null as string) as n").repartition(7)
    got = sorted((r["k"], r["i"]) for r in numbered(df, ["k"], "i", 5).collect())
    assert [i for _, i in got] == list(range(5, 1005))
    assert numbered(df.where("false"), ["k"], "i").count() == 0


LIBRARY = "id string, pid string, ord bigint, type string, name string, phase string, position string, symbol_id string, override_key string, component_key string"
ICON = [
    ("99:10", "99:1", 1, "SYMBOL", "IconButton", None, "!", None, None, "ck-icon-button"),
    ("99:11", "99:10", 2, "TEXT", "Label", None, "!", None, "99:11", None),
    ("99:12", "99:10", 3, "FRAME", "Container", None, '"', None, None, None),
    ("99:13", "99:12", 4, "ROUNDED_RECTANGLE", "Background", None, "!", None, "99:13", None),
    ("99:20", "99:1", 5, "SYMBOL", "CardWithIcon", None, "!", None, None, "ck-card-with-icon"),
    ("99:21", "99:20", 6, "INSTANCE", "NestedInstance", None, "!", "99:10", None, None),
]
TARGET = [("0:0", None, 0, "DOCUMENT", "d", None, "!", None, None, None), ("0:1", "0:0", 1, "CANVAS", "Internal Only Canvas", None, "!", None, None, None), ("0:5", "0:1", 2, "SYMBOL", "s", None, "!", None, None, "other")]


def test_import_symbols(spark):
    source, target = spark.createDataFrame(ICON, LIBRARY), spark.createDataFrame(TARGET, LIBRARY)
    ask = lambda *ids: spark.createDataFrame(list(enumerate(ids)), "place bigint, id string")
    mapping, new = template.import_symbols(source, target, ask("99:10"), "0:1")
    assert mapping.count() == 4
    got = {r["name"]: r for r in new.collect()}
    assert {r["id"]: r["pid"] for r in got.values()} == {"1:6": "0:1", "1:7": "1:6", "1:8": "1:6", "1:9": "1:8"}
    assert got["Label"]["override_key"] == "1:7" and got["Background"]["override_key"] == "1:9" and got["IconButton"]["position"] == '"'
    assert {r["phase"] for r in got.values()} == {"CREATED"}
    mapping, new = template.import_symbols(source, target, ask("99:10", "99:20", "99:10"), "0:1")
    got = {r["name"]: r for r in new.collect()}
    assert len(got) == 6 and got["NestedInstance"]["symbol_id"] == got["IconButton"]["id"]
    assert sorted(r["new"] for r in mapping.where("old = '99:10'").collect()) == ["1:6", "1:6"]
    both = target.unionByName(new)
    mapping, again = template.import_symbols(source, both, ask("99:10"), "0:1")
    assert again.count() == 0 and [(r["old"], r["new"]) for r in mapping.collect()] == [("99:10", "1:6")]
    assert template.import_symbols(source, target, ask("99:10").where("false"), "0:1")[0].count() == 0
    with pytest.raises(ValueError, match="SYMBOL not found in source deck: 999:999"):
        template.import_symbols(source, target, ask("999:999"), "0:1")

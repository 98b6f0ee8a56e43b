"""Tasks that do not grow with the document: what is dealt out by rows, and links that lead nowhere."""

from pyspark.sql import functions as F

from sceneloom.functions import tables
from sceneloom.operators import layouts, tree, validate


def test_drawings_are_put_together_by_so_many_rows_a_task(spark, monkeypatch):
    monkeypatch.setattr(tables, "ROWS", 100, raising=False)
    n = spark.range(1500).select(F.col("id").cast("string"), F.when(F.col("id") >= 500, (F.col("id") % 500).cast("string")).alias("pid"), F.col("id").alias("ord"), F.lit("CREATED").alias("phase"))
    got = tree.fold_up(n, n.where("pid is null"), lambda level: level.withColumn("text", F.concat("id", F.lit("("), "inner", F.lit(")"))))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # the pieces' own partitions show
    try:
        assert got.rdd.getNumPartitions() >= 15
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    rows = {r["id"]: r["text"] for r in got.collect()}
    assert len(rows) == 500 and all(rows[str(k)] == f"{k}({500 + k}()\n{1000 + k}())" for k in range(500))


NODE = "id string, pid string, ord bigint, type string, name string, phase string, symbol_id string, text string, shape_text string, holds_text boolean, width double, height double, fill_paints array<struct<type:string,r:double,g:double,b:double>>"


def document(spark):
    """Five slides, each with forty uses of an empty symbol, one of a symbol with a white and a removed text, and forty notes (every fourth fixed)."""
    white, rows = [("SOLID", 1.0, 1.0, 1.0)], []

    def put(id_, pid, kind, name="n", phase="CREATED", symbol=None, paints=None):
        rows.append((id_, pid, len(rows), kind, name, phase, symbol, None, None, None, None, None, paints))

    put("e", None, "SYMBOL"), put("t", None, "SYMBOL"), put("t1", "t", "TEXT", "slot:text:T", paints=white), put("t2", "t", "TEXT", "gone", "REMOVED", paints=white)
    for s in range(5):
        put(f"s{s}", None, "SLIDE")
        for k in range(40):
            put(f"i{s}-{k}", f"s{s}", "INSTANCE", symbol="e")
            put(f"n{s}-{k}", f"s{s}", "ELLIPSE", "fixed:image:F" if k % 4 == 0 else "slot:image:I")
        put(f"u{s}", f"s{s}", "INSTANCE", symbol="t")
    return spark.createDataFrame(rows, NODE)


def walked_on(monkeypatch):
    """The numbers of rows that rounds of a walk through links send on."""
    seen, plain = [], tree.written

    def counted(df, *args, **more):
        out = plain(df, *args, **more)
        seen.append(out.where("ids is not null").count() if "ids" in out.columns else 0)
        return out

    monkeypatch.setattr(tree, "written", counted)
    return seen


def test_contrast_walks_no_links_that_lead_to_no_text(spark, monkeypatch):
    seen = walked_on(monkeypatch)
    got = validate.slide_contrast(document(spark)).select("slide", "id", "ratio").collect()
    assert sorted(tuple(r) for r in got) == sorted((f"s{s}", t, 1.0) for s in range(5) for t in ("t1", "t2"))
    assert sum(seen) < 50  # not the 200 uses of the empty symbol, nor the 200 notes


def test_slots_without_anything_below_take_no_part_in_the_rounds(spark, monkeypatch):
    seen, n = walked_on(monkeypatch), document(spark)
    got = layouts.slots(n, n.where("type = 'SLIDE'").select(F.col("id").alias("layout"), F.col("id").alias("root"))).collect()
    want = [(f"s{s}", "text", "t1") for s in range(5)] + [(f"s{s}", "image", f"n{s}-{k}") for s in range(5) for k in range(40) if k % 4]
    assert sorted((r["layout"], r["kind"], r["id"]) for r in got) == sorted(want)
    assert sum(seen) < 50


def test_links_keep_first_paths_through_diamonds_and_cycles(spark):
    rows = [("r", None, 1, "SLIDE", None), ("a", "r", 3, "INSTANCE", "y"), ("b", "r", 2, "INSTANCE", "y"), ("y", None, 9, "SYMBOL", None), ("t", "y", 5, "TEXT", None), ("g", "y", 4, "INSTANCE", "z"), ("z", None, 8, "SYMBOL", None), ("h", "z", 6, "INSTANCE", "y"), ("l", "h", 7, "TEXT", None)]
    n = spark.createDataFrame([(i, p, o, k, "CREATED", s) for i, p, o, k, s in rows], "id string, pid string, ord bigint, type string, phase string, symbol_id string")
    below = {i: [(0, o, c) for c, p, o, _, _ in rows if s and p == s] + [(1, o, c) for c, p, o, _, _ in rows if p == i] for i, _, _, _, s in rows}
    first = {}

    def visit(id_, path, way):
        first[id_] = min(first.get(id_, path), path)
        for kind, o, c in below[id_]:
            if c not in way:
                visit(c, [*path, kind, o], [*way, c])

    visit("r", [1, 1], ["r"])
    plain = {r["id"]: r["path"] for r in tree.walk_links(n, n.where("id = 'r'")).collect()}
    assert plain == first
    wanted = {r["id"]: r["path"] for r in tree.walk_links(n, n.where("id = 'r'"), wanted=F.col("type") == "TEXT").collect()}
    assert {k: wanted[k] for k in ("t", "l")} == {k: first[k] for k in ("t", "l")} and all(first[k] == v for k, v in wanted.items())


def test_leaves_do_not_walk(spark, monkeypatch):
    """Only nodes with something below them are walked; leaves, repeated ids, starts inside starts and hidden nodes draw as ever."""
    rows = [("r", None, 0, None), ("a", "r", 1, None), ("b", "r", 2, None), ("c", "r", 3, "REMOVED"), ("a1", "b", 0, None), ("a1", "a", 1, None), ("a2", "a", 2, None), ("b1", "b", 1, None), ("c1", "c", 1, None)]
    n = spark.createDataFrame(rows, "id string, pid string, ord long, phase string")
    walked, real = [], tree.walk
    monkeypatch.setattr(tree, "walk", lambda nodes, *a, **k: walked.append(nodes.count()) or real(nodes, *a, **k))
    own = lambda level: level.withColumn("text", F.when(F.col("id") == "b", "b!").otherwise(F.concat("id", F.lit("("), "inner", F.lit(")"))))
    got = {r["id"]: r["text"] for r in tree.fold_up(n, n.where("id in ('r', 'a', 'b', 'a2', 'c')"), own).collect()}
    assert got == {"r": "r(a(a1()\na1()\na2())\nb!)", "a": "a(a1()\na1()\na2())", "b": "b!", "a2": "a2()"}
    assert walked == [3]

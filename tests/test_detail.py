"""Gradients, layouts inside instances, likeness of pictures as tiles, overrides of imports, positions and moves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sceneloom.functions.ranking import numbered_within
from sceneloom.functions.scalars import position_char
from sceneloom.operators import edit, fills, imagediff, instances, svg, template

# Gradients ----------------------------------------------------------------------------------------

SHAPE = (
    "id string, pid string, ord bigint, type string, phase string, opacity double, width double, height double, radius double, "
    "transform struct<m00:double,m01:double,m02:double,m10:double,m11:double,m12:double>, "
    f"fill_paints array<{fills.GRADIENT_PAINT}>, stroke_paints array<{svg.PAINT}>, stroke_weight double, stroke_align string, inner string"
)
STOPS = [(0.0, 1.0, 0.0, 0.0, None), (1.0, 0.0, 0.0, 1.0, 0.25)]


def gradient(kind, matrix=None, stops=STOPS, opacity=None, visible=None):
    return (kind, visible, opacity, None, None, None, None, None, None, None, None, None, stops, matrix)


def shape(spark, *paints, kind="RECTANGLE"):
    row = ("n", None, 1, kind, None, None, 200.0, 100.0, None, None, list(paints), None, None, None, "")
    return svg.fragments(spark.createDataFrame([row], SHAPE)).first()["text"]


def test_gradients_lie_as_their_matrices_say(spark):
    """Known cases: identity runs left to right, a quarter turn from top to bottom, halves of the square, a skewed radial one."""
    got = shape(spark, gradient(fills.LINEAR), gradient(fills.LINEAR, (0.0, 1.0, 0.0, -1.0, 0.0, 1.0)), gradient(fills.LINEAR, (2.0, 0.0, -0.5, 0.0, 1.0, 0.0)), gradient(fills.RADIAL, opacity=0.5), gradient(fills.RADIAL, (0.0, 2.0, -0.5, -1.0, 0.0, 1.0)))
    assert '<linearGradient id="grad-n-1" x1="0" y1="50" x2="200" y2="50" gradientUnits="userSpaceOnUse"><stop offset="0" stop-color="rgba(255,0,0,1.0000)"/><stop offset="1" stop-color="rgba(0,0,255,0.2500)"/></linearGradient>' in got
    assert '<linearGradient id="grad-n-2" x1="100" y1="0" x2="100" y2="100"' in got
    assert '<linearGradient id="grad-n-3" x1="50" y1="50" x2="150" y2="50"' in got
    assert '<radialGradient id="grad-n-4" cx="100" cy="50" rx="100" ry="50" gradientUnits="userSpaceOnUse" gradientTransform="rotate(0,100,50)">' in got
    assert '<radialGradient id="grad-n-5" cx="100" cy="50" rx="25" ry="100" gradientUnits="userSpaceOnUse" gradientTransform="rotate(90,100,50)">' in got
    assert got.count("<defs>") == 1 and 'fill="url(#grad-n-4)" opacity="0.5"/>' in got and got.count("<rect ") == 5


def test_gradients_that_cannot_be_drawn(spark):
    flat = (1.0, 1.0, 0.0, 1.0, 1.0, 0.0)
    for paint in (gradient(fills.LINEAR, flat), gradient(fills.RADIAL, stops=[]), gradient(fills.LINEAR, stops=None), gradient(fills.LINEAR, visible=False), gradient("GRADIENT_ANGULAR")):
        assert shape(spark, paint) == ""
    assert "grad-n-1" in shape(spark, gradient(fills.RADIAL), kind="FRAME") and "grad" not in shape(spark, gradient(fills.RADIAL), kind="ELLIPSE")


# Layouts inside instances -------------------------------------------------------------------------

NODE = "id string, pid string, ord bigint, type string, phase string, symbol_id string, override_key string, text string, stack_mode string, width double, height double, glyphs array<string>, baselines array<string>"
NODES = [
    ("s", None, 1, "SLIDE", None, None, None, None, None, None, None, None, None), ("i", "s", 2, "INSTANCE", None, "outer", None, None, None, 9.0, 9.0, None, None), ("j", "s", 3, "INSTANCE", None, "inner", None, None, None, 9.0, 9.0, None, None),
    ("outer", None, 4, "SYMBOL", None, None, None, None, "VERTICAL", 9.0, 9.0, None, None), ("n", "outer", 5, "INSTANCE", None, "inner", "kn", None, None, 5.0, 5.0, None, None),
    ("inner", None, 6, "SYMBOL", None, None, None, None, None, 5.0, 5.0, None, None), ("t", "inner", 7, "TEXT", None, None, "kt", "text", None, 1.0, 1.0, ["own"], ["own"]),
    ("other", None, 8, "SYMBOL", None, None, None, None, None, 5.0, 5.0, None, None), ("u", "other", 9, "TEXT", None, None, "ku", "other", None, 1.0, 1.0, ["u"], ["u"]),
]
OVERRIDE = "inst_id string, ov_ix bigint, path array<string>, text string, image string, symbol_id string"
ENTRY = "inst_id string, ix bigint, path array<string>, width double, height double, glyphs array<string>, baselines array<string>"


def laid(spark, entries, overrides=()):
    n = spark.createDataFrame(NODES, NODE)
    out = instances.expand(n, spark.createDataFrame(list(overrides), OVERRIDE), n.where("id = 's'").select("id"), entries=spark.createDataFrame(entries, ENTRY))
    return {r["id"]: r for r in out.collect()}


def test_last_entry_of_a_target_counts_by_unit(spark):
    """Two keys for one node: the later place wins, for size and text apart; an entry again takes over what its key said before, but not its place."""
    got = laid(spark, [("i", 1, ["kn", "t"], 100.0, 10.0, None, None), ("i", 2, ["t"], 50.0, 20.0, ["a"], None), ("i", 3, ["x", "t"], 40.0, None, None, None)])
    assert (got["i/n/t"]["width"], got["i/n/t"]["height"], got["i/n/t"]["glyphs"]) == (40.0, None, ["own"])
    got = laid(spark, [("i", 1, ["n"], 100.0, 10.0, None, None), ("i", 2, ["kn"], 50.0, 5.0, None, None)])
    assert got["i/n"]["width"] == 50.0
    got = laid(spark, [("i", 1, ["n"], 100.0, 10.0, None, None), ("i", 2, ["kn"], 50.0, 5.0, None, None), ("i", 3, ["n"], 70.0, 7.0, None, None)])
    assert got["i/n"]["width"] == 50.0


def test_sizes_count_only_where_the_symbol_lays_out(spark):
    """The entry's own instance decides, not the innermost; texts' layouts always count, glyphs and baselines together; the innermost instance wins."""
    got = laid(spark, [("i", 1, ["t"], 30.0, 3.0, ["g"], None), ("j", 1, ["t"], 60.0, 6.0, ["h"], ["b"])])
    assert (got["i/n/t"]["width"], got["i/n/t"]["glyphs"], got["i/n/t"]["baselines"]) == (30.0, ["g"], None)
    assert (got["j/t"]["width"], got["j/t"]["glyphs"], got["j/t"]["baselines"]) == (1.0, ["h"], ["b"])
    got = laid(spark, [("i", 1, ["t"], 30.0, 3.0, ["g"], ["g"]), ("n", 1, ["kt"], 80.0, 8.0, ["deep"], ["deep"])])
    assert (got["i/n/t"]["width"], got["i/n/t"]["glyphs"]) == (30.0, ["deep"])


def test_keys_of_swapped_symbols_are_laid_out(spark):
    got = laid(spark, [("i", 1, ["ku"], 33.0, 3.0, ["swapped"], None)], [("i", 1, ["kn"], None, None, "other")])
    assert got["i/n/u"]["width"] == 33.0 and got["i/n/u"]["glyphs"] == ["swapped"] and "i/n/t" not in got


# Likeness of pictures -----------------------------------------------------------------------------


def by_windows(a, b, window):
    out = []
    for y in range(a.shape[0] - window + 1):
        for x in range(a.shape[1] - window + 1):
            p, q = (c[y : y + window, x : x + window].reshape(-1) for c in (a, b))
            both = ((p - p.mean()) * (q - q.mean())).mean()
            out.append((2 * p.mean() * q.mean() + 6.5025) * (2 * both + 58.5225) / ((p.mean() ** 2 + q.mean() ** 2 + 6.5025) * (p.var() + q.var() + 58.5225)))
    return np.mean(out)


@pytest.mark.parametrize("tile", [5, 16, 64])
def test_likeness_by_tiles(spark, tile):
    rng = np.random.default_rng(tile)
    pictures = {}
    for key, (h, w) in {"same": (20, 31), "near": (33, 17), "far": (16, 48), "row": (1, 40), "small": (10, 10), "window": (11, 11)}.items():
        a = rng.integers(0, 256, (h, w, 3)).astype(float)
        pictures[key] = (a, np.clip(a + {"same": 0, "far": rng.normal(0, 90, a.shape)}.get(key, rng.normal(0, 9, a.shape)), 0, 255).round())
    rows = [(k, y, a[y].reshape(-1).tolist(), b[y].reshape(-1).tolist()) for k, (a, b) in pictures.items() for y in range(len(a))]
    df = spark.createDataFrame(rows + [("none", 0, [], []), ("lost", 0, None, [1.0]), ("lost", 1, [1.0], None)], "key string, y int, a array<double>, b array<double>").repartition(3)
    got = {r["key"]: r for r in imagediff.picture_likeness(df, tile=tile).collect()}
    assert set(got) == set(pictures)
    for key, (a, b) in pictures.items():
        r, delta = got[key], np.abs(a - b).max(2)
        if min(a.shape[:2]) < 11:
            assert r["ssim"] is None and r["tier"] == "FAIL"
        else:
            grey = np.array(imagediff.GREY)
            assert r["ssim"] == pytest.approx(by_windows(a @ grey, b @ grey, 11), abs=1e-9)
        off = delta[delta > 10]
        assert (r["n_pixels"], r["off_pixels"]) == (delta.size, off.size)
        assert r["mean_delta"] == pytest.approx(np.floor(delta.mean() * 100 + 0.5) / 100) and r["off_delta"] == pytest.approx(np.floor(off.mean() * 10 + 0.5) / 10 if off.size else 0)
    assert got["same"]["tier"] == "PASS" and got["far"]["tier"] == "FAIL"
    assert imagediff.picture_likeness(df.where("false")).count() == 0


def test_tiles_are_bounded(spark):
    """A picture of 300 by 500 pixels in tiles of 64: no group holds more than a tile with its margin."""
    rows = spark.range(300).select(F.lit(1).alias("key"), F.col("id").cast("int").alias("y"), F.array_repeat(F.lit(1.0), 500).alias("a"), F.array_repeat(F.lit(2.0), 500).alias("b"))
    cut = imagediff.tiles(rows, channels=1, tile=64, margin=10)
    sizes = cut.select("ty", "tx", F.size("rows").alias("n"), F.array_max(F.transform("rows", lambda r: F.size(r["a"]))).alias("w"), F.col("rows")[0]["y"].alias("first")).collect()
    assert len(sizes) == 5 * 8 and max(r["n"] for r in sizes) == 74 and max(r["w"] for r in sizes) == 74 and all(r["first"] == 64 * r["ty"] for r in sizes)


# Imports, positions, moves ------------------------------------------------------------------------


def test_overrides_of_imported_instances(spark):
    source = "id string, pid string, ord bigint, type string, name string, phase string, position string, symbol_id string, override_key string, component_key string"
    nodes = [("9:1", None, 1, "SYMBOL", "a", None, "!", None, None, "a"), ("9:2", "9:1", 2, "INSTANCE", "i", None, "!", "9:5", "9:2", None), ("9:3", "9:1", 3, "TEXT", "t", None, "!", None, "9:3", None), ("9:5", None, 5, "SYMBOL", "b", None, "!", None, None, "b"), ("9:6", "9:5", 6, "TEXT", "u", None, "!", None, "9:6", None)]
    frame = spark.createDataFrame(nodes, source)
    target = spark.createDataFrame([("0:1", None, 1, "CANVAS", "c", None, "!", None, None, None)], source)
    mapping, new = template.import_symbols(frame, target, spark.createDataFrame([(0, "9:5"), (1, "9:1")], "place bigint, id string"), "0:1")
    ids = {r["name"]: r["id"] for r in new.collect()}
    over = spark.createDataFrame([("9:2", 1, ["9:3", "9:6"], "x"), ("9:2", 2, ["9:2", "9:3"], None), ("9:2", 2, ["9:2", "9:3"], None), ("9:2", 3, [], "e"), ("9:2", 4, None, "n"), ("7:7", 1, ["9:3"], "lost")], "inst_id string, ov_ix bigint, path array<string>, text string")
    got = sorted(((r["ov_ix"], r["inst_id"], r["path"], r["text"]) for r in template.import_overrides(over, mapping, new).collect()), key=str)
    inst, text = ids["i"], ids["t"]
    assert got == [(1, inst, [text, "9:6"], "x"), (2, inst, [inst, text], None), (2, inst, [inst, text], None), (3, inst, [], "e"), (4, inst, None, "n")]


def test_positions_stand_in_order(spark):
    """70,000 places and far ones: all different, in the order of characters and of bytes, the first ones as documents have them."""
    far = [55_261, 55_262, 55_263, 55_262 + (1 << 15) - 1, 55_262 + (1 << 15), 55_262 + (1 << 30) - 1, 55_262 + (1 << 30), 55_262 + (1 << 45), 1 << 59]
    ks = spark.range(70_000).union(spark.createDataFrame([(k,) for k in far if k >= 70_000], "id bigint"))
    got = [(r["id"], r["p"]) for r in ks.select("id", position_char(F.col("id")).alias("p")).collect()]
    got.sort()
    places = [p for _, p in got]
    assert places[:55_262] == [chr(33 + k) for k in range(55_262)]
    assert all(a < b for a, b in zip(places, places[1:])) and all(a.encode() < b.encode() for a, b in zip(places, places[1:]))
    assert spark.range(1).select(position_char(F.lit(-1)), position_char(F.lit(None).cast("long"))).first() == (None, None)


def test_positions_are_code_points(spark):
    """Beyond the halves of pairs too a place is one character, the code point that many after "!", as the SQL of the queries has it."""
    ks = [55_262, 57_311, 60_000, 65_503, 90_000, 900_000, 1_114_078]
    got = {r["id"]: r["p"] for r in spark.createDataFrame([(k,) for k in (*ks, 57_310, 1_114_079)], "id bigint").select("id", position_char(F.col("id")).alias("p")).collect()}
    assert [got[k] for k in ks] == [chr(33 + k) for k in ks]
    assert chr(0xD7FF) < got[57_310] < chr(0xE000) and got[1_114_079] > chr(0x10FFFF)


def test_moves(spark):
    """One move is a removal and an insertion, as lists have them; many siblings; several moves; null parents; unknown ids."""
    n = 12
    nodes = spark.createDataFrame([(f"{p}:{k}", p, k, "old") for p in ("a", "b") for k in range(n)] + [("root", None, 0, "old")], "id string, pid string, ord bigint, position string").repartition(3)
    for k, to in ((0, 5), (5, 0), (11, 3), (4, 4), (2, 99), (7, -1), (7, -99), (0, 11)):
        out = edit.move_nodes(nodes, spark.createDataFrame([(f"a:{k}", to), ("nobody", 1)], "id string, to_index int"))
        rows = sorted(out.where("pid = 'a'").collect(), key=lambda r: r["place"])
        want = [f"a:{i}" for i in range(n) if i != k]
        want.insert(to, f"a:{k}")
        assert [r["id"] for r in rows] == want and [r["position"] for r in rows] == [chr(33 + i) for i in range(n)]
        assert out.count() == 2 * n + 1 and [r["place"] for r in out.where("id in ('root', 'b:0', 'b:11')").orderBy("id").collect()] == [0, 11, 0]
    many = edit.move_nodes(nodes, spark.createDataFrame([("a:9", 0), ("a:3", 0), ("a:1", 11), ("a:2", 11), ("b:0", 1)], "id string, to_index int"))
    assert [r["id"] for r in sorted(many.where("pid = 'a'").collect(), key=lambda r: r["place"])] == [f"a:{k}" for k in (3, 9, 0, 4, 5, 6, 7, 8, 10, 11, 1, 2)]


def test_moves_among_many_siblings(spark):
    nodes = spark.range(70_000).select(F.col("id").cast("string").alias("id"), F.lit("p").alias("pid"), F.col("id").alias("ord"))
    out = edit.move_nodes(nodes, spark.createDataFrame([("69999", 10), ("3", 60_000)], "id string, to_index int"))
    got = [r["id"] for r in out.orderBy(F.col("position").cast("binary")).collect()]
    want = [str(k) for k in range(70_000) if k not in (3, 69_999)]
    want.insert(10, "69999")
    want.insert(60_000, "3")
    assert got == want


def test_numbering_within_groups(spark):
    df = spark.range(2000).selectExpr("if(id < 1500, 'hot', if(id < 1990, cast(id % 37 as string), null)) as g", "id * 7919 % 2003 as k").repartition(5)
    rows = numbered_within(df, "g", ["k"], "i").collect()
    for g in {r["g"] for r in rows}:
        mine = sorted((r["k"], r["i"]) for r in rows if r["g"] == g)
        assert [i for _, i in mine] == list(range(len(mine)))
    assert len(rows) == 2000 and numbered_within(df.where("false"), "g", ["k"], "i").count() == 0


def test_texts_folded_around_children(spark):
    """Random forests against recursion: nodes that show nothing inside, draw only around something, or say nothing; equal ords; removed nodes."""
    import random

    from sceneloom.operators import tree

    rng, rows = random.Random(4), []
    for k in range(300):
        parent = None if k < 3 else f"n{rng.randrange(max(0, k - 40), k):03}"
        rows.append((f"n{k:03}", parent, rng.randrange(4), rng.choice(["bracket", "bracket", "only", "closed", "silent", "leaf"]), rng.choice([None, None, None, None, "REMOVED"]) if k > 2 else None))
    df = spark.createDataFrame(rows, "id string, pid string, ord bigint, kind string, phase string").repartition(3)
    kind = F.col("kind")

    def own(level):
        around = F.concat("id", F.lit("<"), "inner", F.lit(">"))
        text = F.when(kind == "bracket", around).when(kind == "only", F.when(F.col("inner") != "", around).otherwise("")).when(kind == "closed", F.when(F.col("inner") != "", F.concat("id", F.lit("!"))).otherwise(F.col("id")))
        return level.withColumn("text", text.when(kind == "leaf", F.concat("id", F.lit("."), "inner")))

    def told(row):
        inner = [] if row[3] == "silent" else [told(c) for c in sorted((r for r in rows if r[1] == row[0] and r[4] is None), key=lambda r: (r[2], r[0]))]
        inner = "\n".join(t for t in inner if t)
        return {"bracket": f"{row[0]}<{inner}>", "only": f"{row[0]}<{inner}>" if inner else "", "closed": row[0], "silent": "", "leaf": f"{row[0]}.{inner}"}[row[3]]

    got = {r["id"]: r["text"] for r in tree.fold_up(df, df.where("pid is null"), own).collect()}
    assert got == {r[0]: told(r) for r in rows[:3]} and max(map(len, got.values())) > 100


def test_font_files_by_parts_of_their_names(spark):
    """The look-up by part of the name finds what a look at every pair finds; short and empty families too."""
    from sceneloom.operators import fonts

    families = [("Noto Sans", 400), ("Noto Sans", 700), ("A", 400), ("", 700), ("Noto", 300), ("Open  Sans Pro", 600), ("ttc", 100), ("Missing", 400)]
    files = ["NotoSans-Bold.ttf", "noto-sans.otf", "NotoSansMono-Light.ttf", "a.ttf", "xnoto_sans-regular.ttf", "OpenSansPro-SemiBold.otf", "open_sans_pro.ttc", "readme.txt", "Ab.ttc"]
    got = {(r[0], r[1]): r[2] for r in fonts.system_fonts(spark.createDataFrame(families, "family string, weight int"), spark.createDataFrame(list(enumerate(files)), "ord int, file string")).collect()}
    want = {}
    for family, weight in families:
        slugs = {"".join(family.lower().split()), "-".join(family.lower().split()), "_".join(family.lower().split())}
        for file in files:
            low = file.lower()
            if not low.endswith((".ttf", ".otf", ".ttc")) or not any(s in low for s in slugs):
                continue
            import re

            plain = weight == 400 and not re.search(r"-\w+\.", low)
            if low.endswith(".ttc") or plain or any(n in low for n in fonts.WEIGHT_NAMES[weight]):
                want.setdefault((family, weight), file)
    assert got == want and len(want) > 5


def test_sums_before(spark):
    from sceneloom.functions.ranking import summed_before

    df = spark.range(500).selectExpr("id * 7919 % 503 as k", "id % 5 as v").repartition(6)
    rows = sorted(summed_before(df, ["k"], "v", "s").collect())
    total = 0
    for k, v, s in rows:
        assert s == total
        total += v
    assert summed_before(df.where("false"), ["k"], "v", "s").count() == 0


@pytest.mark.parametrize("depth", [None, 1, 2, 5])
@pytest.mark.parametrize("skip", [False, True])
def test_walks_against_recursion(spark, depth, skip):
    """Forests with nested starts, removed nodes, cycles with trees below them, a node that is its own parent, lost parents and repeated ids."""
    import random

    from sceneloom.operators import tree

    rng, rows = random.Random(6), []
    for k in range(400):
        pid = rng.choice([None, "lost", f"n{rng.randrange(max(k - 6, 0), k + 1)}"]) if rng.random() < 0.15 else f"n{max(0, k - rng.randint(1, 4))}"
        rows.append((f"n{k}", None if k == 0 else pid, k, rng.choice([None] * 9 + ["REMOVED"])))
    rows += [("c0", "c2", 900, None), ("c1", "c0", 901, None), ("c2", "c1", 902, None), ("d0", "c1", 903, None), ("d1", "d0", 904, None), ("self", "self", 905, None), ("n7", "n3", 906, None)]
    df = spark.createDataFrame(rows, "id string, pid string, ord bigint, phase string").repartition(3)
    last = {}
    for id_, pid, ord_, phase in rows:
        if not (skip and phase == "REMOVED"):
            last[id_] = (pid, ord_)
    below = {}
    for id_, (pid, ord_) in last.items():
        below.setdefault(pid, []).append((id_, ord_))
    starts = ["n0", "n5", "n9", "n120", "c1", "d1", "self", "nobody", "n7", "n399", "n7"]
    want = []
    for root in set(starts) & set(last):
        todo = [(root, last[root][0], (last[root][1],))]
        while todo:
            id_, pid, path = todo.pop()
            want.append((root, id_, pid, len(path) - 1, path))
            if depth is None or len(path) <= depth:
                todo += [(c, id_, (*path, o)) for c, o in below.get(id_, []) if c != root]
    got = tree.walk(df, spark.createDataFrame([(x,) for x in starts], "id string"), depth, skip_removed=skip).collect()
    assert sorted(map(str, ((r["root"], r["id"], r["pid"], r["depth"], tuple(r["path"])) for r in got))) == sorted(map(str, want))


def test_deep_chain(spark):
    """A chain of 3,000 nodes: a dozen joins, not one a level."""
    from sceneloom.operators import tree

    n = 3000
    df = spark.range(n).select(F.concat(F.lit("n"), "id").alias("id"), F.when(F.col("id") > 0, F.concat(F.lit("n"), F.col("id") - 1)).alias("pid"), F.col("id").alias("ord"), F.lit(None).cast("string").alias("phase"))
    out = tree.walk(df, df.where("ord in (0, 2000)").select("id"), path=False)
    assert {(r["root"], r["n"], r["deepest"]) for r in out.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("deepest")).collect()} == {("n0", n, n - 1), ("n2000", 1000, 999)}


def test_overrides_are_set_in_one_shuffle(spark):
    """Changes without a key or an instance are appended; a table is dealt out by so many rows a task; no join of overrides with themselves."""
    from sceneloom.functions.tables import spread
    from sceneloom.operators import overrides as O

    old = spark.createDataFrame([("a", 1, ["k"], "x", None), ("a", 2, ["k"], "y", None), ("a", 3, ["m", "n"], "z", None), ("a", 4, ["m"], None, "p"), (None, 7, ["k"], "w", None)], "inst_id string, ov_ix bigint, path array<string>, text string, image string")
    changes = spark.createDataFrame([("a", "k", "", "i"), ("a", "m", "M", "j"), ("a", None, "N", "l"), ("b", "k", "B", "b"), (None, "k", "O", "o")], "inst_id string, key string, text string, image string")
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    fresh = [("a", 5, [None], "N", None), ("a", 6, ["m"], "M", None), ("b", 1, ["k"], "B", None), (None, 1, ["k"], "O", None)]
    got = O.set_overrides(old, changes, "text")
    assert rows(got) == sorted([("a", 1, ["k"], " ", None), *(tuple(r) for r in old.collect()[1:]), *fresh], key=str)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    pictures = rows(O.set_overrides(old, changes, "image", exact=False))
    assert ("a", 4, ["m"], None, "j") in pictures and len(pictures) == 9
    assert len(rows(O.set_overrides(old, changes, "image", append=True))) == 10
    sizes = spread(spark.range(1000), "id", rows=50).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(sizes) == 20


def test_ids_of_a_document_are_merged(spark):
    """What grows with the document is not broadcast into every task: new ids, and nodes that go."""
    nodes = spark.createDataFrame([("1:1", None, 1, None, "REMOVED"), ("1:2", "1:1", 2, "1:1", None), ("1:3", "1:9", 3, "1:2", None)], "id string, pid string, ord bigint, symbol_id string, phase string")
    ids = spark.createDataFrame([("1:1", "9:1"), ("1:2", "9:2")], "old string, new string")
    out, left = edit.remap(nodes, ids), edit.prune(nodes, ids.select(F.col("old").alias("id")))
    assert sorted(tuple(r) for r in out.select("id", "pid", "symbol_id", "phase").collect()) == [("1:3", "1:9", "9:2", "CREATED"), ("9:1", None, None, "CREATED"), ("9:2", "9:1", "9:1", "CREATED")]
    assert [tuple(r) for r in left.collect()] == [("1:3", "1:9", 3, "1:2", None)]
    for df in (out, left):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def plain(spark):
    """A session without adaptive plans or broadcasts, in which a shuffle's partitions can be seen."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.adaptive.enabled")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_one_colour_is_spread(plain):
    """Asks that all have one colour do not meet in one task."""
    from sceneloom.operators import shapes

    variables = plain.createDataFrame([("v:1", 1, "White", 0.5, 0.25, 0.125), ("v:2", 2, "other", 0.0, 0.0, 0.0)], "id string, ord bigint, name string, r double, g double, b double")
    out = shapes.resolve_colours(plain.range(500).withColumn("colour", F.lit("White")), variables)
    assert out.count() == 500 and out.select("r", "g", "b", "colour_var").distinct().collect() == [(0.5, 0.25, 0.125, "v:1")]
    assert out.groupBy(F.spark_partition_id()).count().count() > 1


def test_graphics_of_one_parent_are_spread(spark):
    """The bytes of graphics are made without a window over all graphics of a parent."""
    from sceneloom.plans import making

    nodes, found = making._graphics(spark, "/root/testdata/sf0.001")
    assert "windowspecdefinition(parent" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(parent" not in nodes._jdf.queryExecution().optimizedPlan().toString()


def test_what_goes_from_a_template_is_merged(spark):
    """The nodes that go grow with the template, so they are not broadcast."""
    from sceneloom.plans import QUERIES

    plan = QUERIES["from_template"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert any("SortMergeJoin" in x and "LeftAnti" in x for x in plan.splitlines())

"""Registered queries that make and change shapes and slides of the stand-in document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneloom.operators import decks, shapes

from .catalogue import query
from .deck import NOTES_SQL, notes
from .drawing import TOP
from .graph import nodes, table

POSITION = "chr((33 + {})::INT)"


def _none():
    return F.lit(None).cast("string")


# Colours and styles -------------------------------------------------------------------------------

# The names of nations are colour variables; the first is called navy and has no value, so the colour of that name is another.
VARIABLES_SQL = """variables AS (SELECT 'v:' || n_nationkey AS id, n_nationkey AS ord, CASE n_nationkey WHEN 0 THEN 'navy' ELSE n_name END AS name,
 CASE WHEN n_nationkey <> 0 THEN n_nationkey / 25.0::DOUBLE END AS r, 0.5::DOUBLE AS g, 0.25::DOUBLE AS b FROM nation)"""
RGB_SQL = """CASE WHEN colour IS NULL THEN [0, 0, 0]::DOUBLE[] WHEN regexp_full_match(colour, '#[0-9a-f]{6}') THEN [('0x' || colour[2:3])::INT / 255::DOUBLE, ('0x' || colour[4:5])::INT / 255::DOUBLE, ('0x' || colour[6:7])::INT / 255::DOUBLE]
 WHEN v.r IS NOT NULL THEN [v.r, v.g, v.b] ELSE [30 / 255::DOUBLE, 39 / 255::DOUBLE, 97 / 255::DOUBLE] END"""


def variables(spark, d: str) -> DataFrame:
    key = F.col("n_nationkey")
    name = F.when(key == 0, "navy").otherwise(F.col("n_name"))
    red = F.when(key != 0, key / 25.0)
    return table(spark, d, "nation").select(F.concat(F.lit("v:"), key).alias("id"), key.cast("long").alias("ord"), name.alias("name"), red.alias("r"), F.lit(0.5).alias("g"), F.lit(0.25).alias("b"))


COLOURS_SQL = f"""{VARIABLES_SQL}, asks AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN printf('#%06x', (p_partkey * 7919) % 16777216) WHEN 1 THEN (SELECT n_name FROM nation WHERE n_nationkey = p_partkey % 24 + 1) WHEN 2 THEN 'NAVY' WHEN 3 THEN 'navy' END AS colour FROM part)"""


def colour_asks(spark, d: str) -> DataFrame:
    key = F.col("p_partkey")
    named = variables(spark, d).where("ord > 0").select((F.col("ord") - 1).alias("_at"), F.col("name").alias("_named"))
    digits = F.concat(F.lit("#"), F.lpad(F.lower(F.hex(key * 7919 % 16777216)), 6, "0"))
    rows = table(spark, d, "part").withColumn("_at", key % 24).join(F.broadcast(named), "_at", "left")  # one row a nation
    colour = F.when(key % 5 == 0, digits).when(key % 5 == 1, F.col("_named")).when(key % 5 == 2, "NAVY").when(key % 5 == 3, "navy")
    return rows.select("p_partkey", "p_size", colour.alias("colour"))


@query(f"WITH {COLOURS_SQL}, x AS (SELECT p_partkey, {RGB_SQL} AS c, CASE WHEN v.r IS NOT NULL THEN v.id END AS colour_var FROM asks LEFT JOIN variables v ON v.name = colour) SELECT p_partkey, round(c[1], 6) AS r, round(c[2], 6) AS g, round(c[3], 6) AS b, colour_var FROM x")
def colours_by_name(spark, d: str) -> DataFrame:
    out = shapes.resolve_colours(colour_asks(spark, d), variables(spark, d))
    return out.select("p_partkey", *(F.round(c, 6).alias(c) for c in "rgb"), "colour_var")


@query("""WITH t AS (SELECT s_suppkey AS id, 'S' || (s_suppkey % 6) AS name, CASE WHEN s_suppkey % 4 = 0 THEN 0 WHEN s_suppkey % 3 = 0 AND s_suppkey % 2 = 1 THEN 1 END AS rank, s_name FROM supplier)
SELECT name AS style, arg_min(id, rank * 1000000 + id)::VARCHAR AS id, arg_min(s_name, rank * 1000000 + id) AS font_family FROM t WHERE rank IS NOT NULL AND name IN ('S0', 'S2', 'S3', 'S4') GROUP BY name""")
def styles_by_name(spark, d: str) -> DataFrame:
    key, s = F.col("s_suppkey"), table(spark, d, "supplier")
    texts = s.select(
        key.cast("string").alias("id"), key.alias("ord"), F.lit("TEXT").alias("type"), F.concat(F.lit("S"), key % 6).alias("name"), (key % 4 == 0).alias("is_publishable"),
        (key % 3 == 0).alias("locked"), (key % 2 == 0).alias("visible"), F.col("s_name").alias("font_family"), _none().alias("font_style"), F.lit(12.0).alias("font_size"),
        F.lit(1.2).alias("line_height"), F.lit("RAW").alias("line_height_units"),
    )
    names = spark.createDataFrame([(f"S{k}",) for k in (0, 2, 3, 4)], "style string")
    return shapes.text_styles(texts, names).select("style", "id", "font_family")


# New shapes ---------------------------------------------------------------------------------------

KINDS = ("RECTANGLE", "TEXT", "LINE", "FRAME", "IMAGE", "ELLIPSE", "STAR", "DIAMOND")


@query(f"""WITH a AS (SELECT o_orderkey AS k, '3:' || o_custkey AS pid, ['RECTANGLE', 'TEXT', 'LINE', 'FRAME', 'IMAGE', 'ELLIPSE', 'STAR', 'DIAMOND'][o_orderkey % 8 + 1] AS kind, (o_orderkey % 100)::DOUBLE AS x, (o_custkey % 50)::DOUBLE AS y, (o_orderkey % 90 + 1)::DOUBLE AS w,
  row_number() OVER (ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place, o_orderstatus AS s FROM orders)
SELECT '1:' || ({TOP} + n) AS id, pid, {POSITION.format('place')} AS position, CASE WHEN kind IN ('RECTANGLE', 'IMAGE') THEN 'ROUNDED_RECTANGLE' WHEN kind IN ('TEXT', 'LINE', 'FRAME') THEN kind ELSE 'SHAPE_WITH_TEXT' END AS type,
 CASE kind WHEN 'RECTANGLE' THEN 'Rectangle' WHEN 'TEXT' THEN 'Text' WHEN 'LINE' THEN 'Line' WHEN 'FRAME' THEN 'Frame' WHEN 'IMAGE' THEN 'Image' ELSE 'Shape' END AS name,
 round(CASE kind WHEN 'LINE' THEN sqrt((100 - x) * (100 - x) + (50 - y) * (50 - y)) ELSE w END, 6) AS width, x, y, round(CASE WHEN kind <> 'LINE' THEN 1 WHEN x = 100 AND y = 50 THEN 1 ELSE (100 - x) / sqrt((100 - x) * (100 - x) + (50 - y) * (50 - y)) END, 6) AS m00,
 CASE kind WHEN 'TEXT' THEN s WHEN 'IMAGE' THEN 'IMAGE' WHEN 'RECTANGLE' THEN 'SOLID' END AS shown, CASE WHEN kind IN ('ELLIPSE', 'STAR', 'DIAMOND') THEN kind END AS shape_kind, CASE kind WHEN 'FRAME' THEN 24.0::DOUBLE END AS stack_spacing FROM a""", graph=True)  # fmt: skip
def added_shapes(spark, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (key % 8 + 1).cast("int"))
    asks = table(spark, d, "orders").select(
        key.alias("k"), F.concat(F.lit("3:"), F.col("o_custkey")).alias("parent"), kind.alias("kind"), (key % 100).cast("double").alias("x"), (F.col("o_custkey") % 50).cast("double").alias("y"),
        (key % 90 + 1).cast("double").alias("width"), F.lit(10.0).alias("height"), F.lit(100.0).alias("x2"), F.lit(50.0).alias("y2"), F.col("o_orderstatus").alias("text"),
    )
    out = shapes.add_shapes(nodes(spark, d), asks)
    shown = F.coalesce("text", F.get("fill_paints", F.lit(0))["type"])
    t = F.col("transform")
    return out.select("id", "pid", "position", "type", "name", F.round("width", 6).alias("width"), t["m02"].alias("x"), t["m12"].alias("y"), F.round(t["m00"], 6).alias("m00"), shown.alias("shown"), "shape_kind", "stack_spacing")


TABLES_SQL = f"""c AS (SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS r, o_orderstatus AS s FROM orders),
t AS (SELECT k, max(r) + 1 AS n_rows FROM c GROUP BY k), u AS (SELECT *, {TOP} + 1 + coalesce(sum(n_rows + 3) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS l FROM t)"""


def _tables(spark, d: str) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), rank.alias("row"), F.array("o_orderstatus", F.lit("")).alias("texts"))
    cells = rows.select("k", "row", F.posexplode("texts").alias("col", "text"))
    asked = rows.select("k").distinct().select("k", F.concat(F.lit("3:"), "k").alias("parent"), F.lit(1.0).alias("x"), F.lit(2.0).alias("y"), F.when(F.col("k") % 2 == 0, 10.0).alias("row_height"))
    return shapes.add_tables(nodes(spark, d), asked, cells)


@query(f"WITH {TABLES_SQL} SELECT '1:' || l AS id, '3:' || k AS pid, {POSITION.format('n_rows')} AS position, 384.0::DOUBLE AS width, n_rows * CASE WHEN k % 2 = 0 THEN 10.0 ELSE 44.0 END::DOUBLE AS height FROM u", graph=True)
def added_tables(spark, d: str) -> DataFrame:
    return _tables(spark, d)[0].select("id", "pid", "position", "width", "height")


@query(f"WITH {TABLES_SQL} SELECT '1:' || l AS \"table\", r AS row, j AS col, '1:' || (l + 1 + r) || '/1:' || (l + 1 + n_rows + j) AS path, CASE j WHEN 0 THEN s ELSE ' ' END AS text FROM c JOIN u USING (k), range(2) AS t(j)", graph=True)
def table_cells(spark, d: str) -> DataFrame:
    return _tables(spark, d)[1].select("table", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.array_join("path", "/").alias("path"), "text")


# Setters ------------------------------------------------------------------------------------------


def shape_nodes(spark, d: str) -> DataFrame:
    """A shape for each part: one that holds a text, a rectangle, a line in turn; each fifth without a matrix."""
    key, size = F.col("p_partkey"), F.col("p_size").cast("double")
    grey = F.array(shapes.paint(size / 100, F.lit(0.5), F.lit(0.5)))
    kind = F.element_at(F.array(F.lit("SHAPE_WITH_TEXT"), F.lit("ROUNDED_RECTANGLE"), F.lit("LINE")), (key % 3 + 1).cast("int"))
    return table(spark, d, "part").select(
        key.alias("id"), kind.alias("type"), F.when(key % 3 == 1, grey).alias("fill_paints"), F.when(key % 3 == 0, grey).alias("shape_paints"), F.when(key % 3 == 2, grey).alias("stroke_paints"),
        F.when(key % 3 == 2, 4.0).alias("stroke_weight"), F.lit("CENTER").alias("stroke_align"), F.when(key % 5 != 0, shapes.placed(size, size + 1)).alias("transform"),
        F.when(key % 7 != 0, size).alias("width"), F.lit(8.0).alias("height"), F.lit(None).cast("boolean").alias("visible"), F.when(key % 2 == 0, 0.5).alias("opacity"),
    )


def _shown(paints: str, what: str):
    return F.get(F.col(paints), F.lit(0))[what]


SHAPES_SQL = "s AS (SELECT p_partkey AS id, p_partkey % 3 AS kind, p_size AS size FROM part)"


@query(f"""WITH {COLOURS_SQL}, {SHAPES_SQL}, x AS (SELECT p_partkey AS id, {RGB_SQL} AS c FROM asks LEFT JOIN variables v ON v.name = colour WHERE p_partkey % 2 = 0)
SELECT s.id, CASE WHEN kind = 0 THEN NULL WHEN s.id % 4 = 2 THEN NULL WHEN c IS NOT NULL THEN round(c[1], 6) WHEN kind = 1 THEN size / 100::DOUBLE END AS fill, CASE WHEN kind <> 0 THEN NULL WHEN s.id % 4 = 2 THEN NULL WHEN c IS NOT NULL THEN round(c[1], 6) ELSE size / 100::DOUBLE END AS shape FROM s LEFT JOIN x USING (id)""")
def set_fills(spark, d: str) -> DataFrame:
    """Half of the shapes get the fills asked for; of those, every second loses its fills."""
    asks = colour_asks(spark, d).where("p_partkey % 2 = 0")
    asks = asks.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 4 == 2, "none").otherwise(F.col("colour")).alias("colour"), F.lit(0.5).alias("opacity"))
    out = shapes.set_fill(shape_nodes(spark, d), asks, variables(spark, d))
    return out.select("id", F.round(_shown("fill_paints", "r"), 6).alias("fill"), F.round(_shown("shape_paints", "r"), 6).alias("shape"))


@query(f"WITH {COLOURS_SQL} SELECT p_partkey AS id, CASE WHEN v.r IS NOT NULL THEN v.id END AS colour_var, CASE WHEN p_partkey % 2 = 0 THEN 0.25 ELSE 1 END::DOUBLE AS opacity FROM asks LEFT JOIN variables v ON v.name = colour WHERE p_partkey % 3 = 1")
def set_backgrounds(spark, d: str) -> DataFrame:
    asks = colour_asks(spark, d).select(F.col("p_partkey").alias("id"), "colour", F.when(F.col("p_partkey") % 2 == 0, 0.25).alias("opacity"))
    out = shapes.set_background(shape_nodes(spark, d).where("type = 'ROUNDED_RECTANGLE'"), asks, variables(spark, d))
    return out.select("id", _shown("fill_paints", "colour_var").alias("colour_var"), _shown("fill_paints", "opacity").alias("opacity"))


@query(f"""WITH {COLOURS_SQL}, {SHAPES_SQL}, x AS (SELECT p_partkey AS id, {RGB_SQL} AS c FROM asks LEFT JOIN variables v ON v.name = colour WHERE p_partkey % 2 = 0)
SELECT s.id, CASE WHEN s.id % 4 = 2 THEN NULL WHEN c IS NOT NULL THEN round(c[3], 6) WHEN kind = 2 THEN 0.5 END::DOUBLE AS blue, CASE WHEN s.id % 4 = 2 THEN 0 WHEN c IS NOT NULL THEN CASE WHEN s.id % 8 = 0 THEN 3 ELSE 2 END WHEN kind = 2 THEN 4 END::DOUBLE AS weight,
CASE WHEN s.id % 4 = 0 THEN 'INSIDE' ELSE 'CENTER' END AS align FROM s LEFT JOIN x USING (id)""")
def set_strokes(spark, d: str) -> DataFrame:
    key = F.col("p_partkey")
    asks = colour_asks(spark, d).where("p_partkey % 2 = 0")
    asks = asks.select(key.alias("id"), F.when(key % 4 == 2, "none").otherwise(F.col("colour")).alias("colour"), F.when(key % 8 == 0, 3.0).alias("weight"), _none().alias("align"))
    out = shapes.set_stroke(shape_nodes(spark, d), asks, variables(spark, d))
    return out.select("id", F.round(_shown("stroke_paints", "b"), 6).alias("blue"), F.col("stroke_weight").alias("weight"), F.col("stroke_align").alias("align"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 2 = 0 THEN sha1(p_name) END AS fill, CASE WHEN p_partkey % 6 = 0 THEN sha1(p_name) END AS shape, CASE WHEN p_partkey % 2 = 0 THEN CASE WHEN p_partkey % 4 = 0 THEN 'TILE' ELSE 'FILL' END END AS mode FROM part")
def set_image_fills(spark, d: str) -> DataFrame:
    key = F.col("p_partkey")
    asks = table(spark, d, "part").where("p_partkey % 2 = 0").select(
        key.alias("id"), F.sha1("p_name").alias("image"), F.sha1("p_type").alias("thumbnail"), F.lit(10.0).alias("image_width"), F.lit(20.0).alias("image_height"), F.when(key % 4 == 0, "TILE").alias("mode"))
    out = shapes.set_image_fill(shape_nodes(spark, d), asks)
    mode = F.coalesce(F.when(_shown("shape_paints", "image").isNotNull(), _shown("shape_paints", "mode")), _shown("fill_paints", "mode"))
    return out.select("id", _shown("fill_paints", "image").alias("fill"), _shown("shape_paints", "image").alias("shape"), mode.alias("mode"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 5 <> 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 7 ELSE p_size END ELSE 0 END::DOUBLE AS x, CASE WHEN p_partkey % 5 <> 0 THEN p_size + 1 ELSE 0 END::DOUBLE AS y, CASE WHEN p_partkey % 7 = 0 THEN 0 WHEN p_partkey % 2 = 0 THEN 9 ELSE p_size END::DOUBLE AS width,
p_partkey % 4 <> 0 AS visible, CASE WHEN p_partkey % 2 = 0 THEN 0.5 ELSE 1 END::DOUBLE AS opacity, CASE WHEN p_partkey % 5 <> 0 THEN CASE WHEN p_partkey % 3 = 0 THEN round(cos(radians(30)), 6) ELSE 1 END END AS m00 FROM part""")
def set_geometry(spark, d: str) -> DataFrame:
    """Places, sizes and turns, set where asked and read with what counts where a node has none."""
    key, p = F.col("p_partkey"), table(spark, d, "part")
    none = F.lit(None).cast("double")
    asks = p.where("p_partkey % 2 = 0").select(
        key.alias("id"), F.lit(7.0).alias("x"), none.alias("y"), F.lit(9.0).alias("width"), none.alias("height"), F.when(key % 4 == 0, F.lit(False)).alias("visible"), none.alias("opacity"))
    turns = p.where("p_partkey % 3 = 0").select(key.alias("id"), F.lit(30.0).alias("degrees"))
    out = shapes.set_rotation(shapes.set_geometry(shape_nodes(spark, d), asks), turns)
    read = shapes.geometry(out).drop("height")
    return read.join(out.select("id", F.round("transform.m00", 6).alias("m00")), "id")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 <> 2 THEN p_size / 100::DOUBLE END AS fill, CASE WHEN p_partkey % 3 = 2 THEN p_size / 100::DOUBLE END AS stroke, CASE WHEN p_partkey % 3 = 2 THEN 4.0::DOUBLE END AS weight FROM part")
def shape_colours(spark, d: str) -> DataFrame:
    return shapes.colours(shape_nodes(spark, d)).select("id", F.col("fill.r").alias("fill"), F.col("stroke.r").alias("stroke"), "weight")


# New slides ---------------------------------------------------------------------------------------

LIVE = "(SELECT count(*) FROM customer)"


def slide_nodes(spark, d: str) -> DataFrame:
    return nodes(spark, d).drop("variant_specs").withColumn("x", F.lit(None).cast("double"))


def _new(out: DataFrame, before: DataFrame) -> DataFrame:
    return out.join(before.select(F.col("id").alias("_id")), F.col("id") == F.col("_id"), "left_anti")


FIRST_SLIDE = "(SELECT arg_min(pid, ord) FROM nodes WHERE type = 'SLIDE')"


@query(f"""WITH a AS (SELECT n_name, n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation)
SELECT '1:' || ({TOP} + 1 + i) AS id, {FIRST_SLIDE} AS pid, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE ({LIVE} + i + 1)::VARCHAR END AS name, {POSITION.format(LIVE + ' + i')} AS position, (({LIVE} + i) * 2160)::DOUBLE AS x FROM a""", graph=True)
def blank_slides(spark, d: str) -> DataFrame:
    asks = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("name"))
    n = slide_nodes(spark, d)
    return _new(decks.add_blank_slides(n, asks), n).select("id", "pid", "name", "position", "x")


@query("""WITH a AS (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation)
SELECT '1:' || (5 + i) AS id, '0:3' AS pid, 'layout:' || n_name AS name, chr((33 + CASE i WHEN 0 THEN 1 ELSE i END)::INT) AS position, (CASE i WHEN 0 THEN 1 ELSE i END * 2160)::DOUBLE AS x, 'CREATED' AS phase FROM a
UNION ALL SELECT '0:4', '0:3', '1', '!', 0, 'REMOVED'""")
def draft_template(spark, d: str) -> DataFrame:
    """A new template: the blank slide that it starts with goes, its layouts follow."""
    layouts = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.concat(F.lit("layout:"), "n_name").alias("name"))
    return decks.draft_template(spark, layouts).where("type = 'SLIDE'").select("id", "pid", "name", "position", "x", "phase")


@query(f"""WITH b AS (SELECT i.symbol_id, arg_min(s.id, s.ord) AS slide FROM nodes s JOIN nodes i ON i.pid = s.id AND i.type = 'INSTANCE' WHERE s.type = 'SLIDE' GROUP BY 1),
f AS (SELECT pid, arg_min(id, ord) AS inst FROM nodes WHERE type = 'INSTANCE' GROUP BY 1),
a AS (SELECT y.id AS symbol, y.name, row_number() OVER (ORDER BY p_partkey) - 1 AS i, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 100 END AS after, coalesce(b.slide, (SELECT arg_min(id, ord) FROM nodes WHERE type = 'SLIDE')) AS source FROM part JOIN nodes y ON y.id = '5:' || p_partkey LEFT JOIN b ON b.symbol_id = y.id)
SELECT '1:' || ({TOP} + 1 + 2 * i) AS id, s.pid, 'SLIDE' AS type, a.name, {POSITION.format(f'coalesce(after + 1, {LIVE} + i)')} AS position, NULL AS symbol_id, (({LIVE} + i) * 2160)::DOUBLE AS x FROM a JOIN nodes s ON s.id = a.source
UNION ALL SELECT '1:' || ({TOP} + 2 + 2 * i), '1:' || ({TOP} + 1 + 2 * i), 'INSTANCE', a.name, '!', symbol, NULL FROM a""", graph=True)
def slides_from_symbols(spark, d: str) -> DataFrame:
    key = F.col("p_partkey")
    after = F.when(key % 3 == 0, F.concat(F.lit("3:"), key % 100))
    asks = table(spark, d, "part").select(key.alias("k"), F.concat(F.lit("5:"), key).alias("symbol"), _none().alias("name"), after.alias("after"))
    n = slide_nodes(spark, d)
    return _new(decks.add_slides(n, asks), n).select("id", "pid", "type", "name", "position", "symbol_id", "x")


# Every fifth slide stands in a module, as after publishing; notes stand on slides beside their instances.
CLONED_SQL = f"""{NOTES_SQL}, c AS (SELECT n.id, CASE WHEN type = 'SLIDE' AND (ord - 3000000000) % 5 = 0 THEN '9:' || (ord - 3000000000) ELSE pid END AS pid, ord, type, name, phase, position FROM nodes n
 UNION ALL SELECT '9:' || c_custkey, '2:' || c_nationkey, 9000000000 + c_custkey, 'MODULE', c_name, 'CREATED', '!' FROM customer WHERE c_custkey % 5 = 0
 UNION ALL SELECT id, pid, 8000000000 + split_part(id, ':', 2)::BIGINT, type, name, phase, '!' FROM notes)"""


def module_nodes(spark, d: str) -> DataFrame:
    key = F.col("ord") - 3_000_000_000
    in_module = (F.col("type") == "SLIDE") & (key % 5 == 0)
    n = slide_nodes(spark, d).withColumn("pid", F.when(in_module, F.concat(F.lit("9:"), key)).otherwise(F.col("pid")))
    c = table(spark, d, "customer").where("c_custkey % 5 = 0")
    modules = c.select(
        F.concat(F.lit("9:"), F.col("c_custkey")).alias("id"), F.concat(F.lit("2:"), F.col("c_nationkey")).alias("pid"), (F.col("c_custkey") + 9_000_000_000).alias("ord"),
        F.lit("MODULE").alias("type"), F.col("c_name").alias("name"), F.lit("CREATED").alias("phase"), F.lit("!").alias("position"))
    loose = notes(spark, d).select("id", "pid", "ord", "type", "name", "phase").withColumn("position", F.lit("!"))
    return n.unionByName(modules, allowMissingColumns=True).unionByName(loose, allowMissingColumns=True)


@query(f"""WITH {CLONED_SQL}, f AS (SELECT pid, arg_min(id, ord) AS inst FROM c WHERE type = 'INSTANCE' GROUP BY 1), live AS (SELECT count(*) AS n FROM c WHERE type = 'SLIDE'),
a AS (SELECT f.pid AS slide, inst, s.pid AS parent, split_part(f.pid, ':', 2)::BIGINT AS k, starts_with(s.pid, '9:') AS mod, row_number() OVER (ORDER BY split_part(f.pid, ':', 2)::BIGINT) - 1 AS i FROM f JOIN c s ON s.id = f.pid),
p AS (SELECT k, i, mod, parent AS old, 0 AS step, 0 AS o FROM a WHERE mod UNION ALL SELECT k, i, mod, slide, 1, 0 FROM a UNION ALL SELECT k, i, mod, inst, 2, 0 FROM a
 UNION ALL SELECT k, i, mod, c.id, 3, c.ord FROM a JOIN c ON c.pid = a.slide AND c.id <> a.inst AND c.phase <> 'REMOVED'),
q AS (SELECT *, '1:' || ((SELECT max(split_part(id, ':', 2)::BIGINT) FROM c) + row_number() OVER (ORDER BY k, step, o)) AS id FROM p)
SELECT q.id, coalesce(u.id, x.pid) AS pid, x.type, CASE WHEN q.step < 3 THEN 'Copy' ELSE x.name END AS name, CASE WHEN (q.mod AND q.step = 0) OR (NOT q.mod AND q.step = 1) THEN {POSITION.format('live.n + q.i')} WHEN q.step IN (1, 2) THEN '!' ELSE x.position END AS position
FROM q JOIN c x ON x.id = q.old LEFT JOIN q u ON u.k = q.k AND u.old = x.pid, live""", graph=True)
def cloned_slides(spark, d: str) -> DataFrame:
    n = module_nodes(spark, d)
    owners = n.where("type = 'INSTANCE'").select(F.col("pid").alias("slide")).distinct()
    asks = owners.select(F.split_part("slide", F.lit(":"), F.lit(2)).cast("long").alias("k"), "slide", F.lit("Copy").alias("name"))
    return _new(decks.clone_slides(n, asks)[0], n).select("id", "pid", "type", "name", "position")


# A deck from descriptions -------------------------------------------------------------------------

TYPES = ("title", "bullets", "two-column", "stat", "image-full", "closing")
ACCENT = round(202 / 255, 6)
SPECS_SQL = """s AS (SELECT p_partkey AS k, row_number() OVER (ORDER BY p_partkey) - 1 AS i, ['title', 'bullets', 'two-column', 'stat', 'image-full', 'closing'][p_partkey % 6 + 1] AS type, CASE WHEN p_partkey % 7 <> 0 THEN p_name END AS title, p_brand AS second, string_split(p_type, ' ') AS items FROM part),
h AS (SELECT i, type, title, second, items, type IN ('title', 'closing') AS cover FROM s),
r AS (SELECT i, 0 AS place, 'ROUNDED_RECTANGLE' AS type, NULL::VARCHAR AS text, 0::DOUBLE AS x, 0::DOUBLE AS y, 1920::DOUBLE AS width FROM h WHERE type <> 'image-full'
UNION ALL SELECT i, 1, 'TEXT', title, 80, CASE WHEN cover THEN 360 WHEN type = 'image-full' THEN 720 ELSE 80 END, 1760 FROM h WHERE title IS NOT NULL AND type <> 'image-full'
UNION ALL SELECT i, 2, 'TEXT', second, 80, 540, 1760 FROM h WHERE cover
UNION ALL SELECT i, 10 + 2 * j, 'ROUNDED_RECTANGLE', NULL, 80, 250 + 80 * j, 12 FROM h, unnest(range(len(items))) AS t(j) WHERE type = 'bullets'
UNION ALL SELECT i, 11 + 2 * j, 'TEXT', items[j + 1], 116, 240 + 80 * j, 1724 FROM h, unnest(range(len(items))) AS t(j) WHERE type = 'bullets'
UNION ALL SELECT i, 3, 'ROUNDED_RECTANGLE', NULL, 960, 200, 4 FROM h WHERE type = 'two-column' UNION ALL SELECT i, 4, 'TEXT', second, 80, 240, 840 FROM h WHERE type = 'two-column'
UNION ALL SELECT i, 5, 'ROUNDED_RECTANGLE', NULL, 1004, 200, 836 FROM h WHERE type = 'two-column'
UNION ALL SELECT i, 3, 'TEXT', second, 80, 300, 1760 FROM h WHERE type = 'stat' UNION ALL SELECT i, 0, 'ROUNDED_RECTANGLE', NULL, 0, 0, 1920 FROM h WHERE type = 'image-full'
UNION ALL SELECT i, 1, 'ROUNDED_RECTANGLE', NULL, 0, 680, 1920 FROM h WHERE type = 'image-full' AND title IS NOT NULL UNION ALL SELECT i, 2, 'TEXT', title, 80, 720, 1760 FROM h WHERE type = 'image-full' AND title IS NOT NULL)"""


@query(f"WITH {SPECS_SQL} SELECT '1:' || ((SELECT count(*) FROM part) + 4 + row_number() OVER (ORDER BY i, place)) AS id, '1:' || (5 + i) AS pid, type, text, x, y, width FROM r")
def created_deck(spark, d: str) -> DataFrame:
    key = F.col("p_partkey")
    second = lambda *kinds: F.when(F.col("type").isin(*kinds), F.col("p_brand"))
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (key % 6 + 1).cast("int"))
    p = table(spark, d, "part").withColumn("type", kind)
    specs = p.select(
        key.alias("k"), "type", F.when(key % 7 != 0, F.col("p_name")).alias("title"), F.col("p_brand").alias("subtitle"), _none().alias("body"), F.split("p_type", " ").alias("bullets"), F.col("p_brand").alias("stat"),
        _none().alias("caption"), F.sha1("p_name").alias("image"), second("two-column").alias("left_text"), _none().alias("right_text"), _none().alias("background"))
    named = ("Title", "Header 1", "Header 2", "Body 1")
    styles = spark.createDataFrame([(f"9:{k}", None, 0, "TEXT", n, True, "Inter", "Regular", 20.0, 1.2, "RAW") for k, n in enumerate(named)], "id string, pid string, ord bigint, type string, name string, is_publishable boolean, font_family string, font_style string, font_size double, line_height double, line_height_units string")
    out = decks.create_deck(spark, specs, styles, variables(spark, d))[1]
    t = F.col("transform")
    return out.select("id", "pid", "type", "text", t["m02"].alias("x"), t["m12"].alias("y"), "width")


@query("SELECT 1920.0::DOUBLE AS width, 1080.0::DOUBLE AS height, '3:' || (SELECT min(c_custkey) + 2 FROM customer) AS third")
def slide_size(spark, d: str) -> DataFrame:
    """Size of the slides, and the third of them."""
    from sceneloom.operators import catalog

    n = slide_nodes(spark, d).withColumns({"width": F.lit(None).cast("double"), "height": F.lit(None).cast("double")})
    third = decks.nth(catalog.active_slides(n), 3).select(F.col("id").alias("third"))
    return decks.slide_size(n).join(third, F.lit(True))


# Graphics and pictures ----------------------------------------------------------------------------

SVG = """'<svg viewBox="0 0 ' || w || ' ' || h || '"><path fill="x" d="M0 0 L' || w || ' ' || h || ' Z"/><g><path d="M1 1h2"/></g></svg>'"""


def _graphics(spark, d: str):
    from sceneloom.sources import pictures

    key = F.col("p_partkey")
    w, h = (F.pow(F.lit(2), key % n).cast("int").cast("string") for n in (4, 3))
    text = F.concat(F.lit('<svg viewBox="0 0 '), w, F.lit(" "), h, F.lit('"><path fill="x" d="M0 0 L'), w, F.lit(" "), h, F.lit(' Z"/><g><path d="M1 1h2"/></g></svg>'))
    asks = table(spark, d, "part").select(key.alias("k"), F.lit("2:0").alias("parent"), F.lit(3.0).alias("x"), F.lit(4.0).alias("y"), F.lit(64.0).alias("width"), text.alias("svg"), F.lit("#ff0000").alias("colour"), _none().alias("name"))
    return pictures.add_graphics(nodes(spark, d), asks, variables(spark, d))


@query(f"""WITH a AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS n, 64.0::DOUBLE * (1 << (p_partkey % 3)::INT) / (1 << (p_partkey % 4)::INT) AS height, (SELECT count(*) FROM customer WHERE c_nationkey = 0) AS c FROM part)
SELECT '1:' || ({TOP} + 1 + 2 * n) AS id, '2:0' AS pid, 'FRAME' AS type, {POSITION.format('c + n')} AS position, height, NULL::DOUBLE AS red FROM a UNION ALL SELECT '1:' || ({TOP} + 2 + 2 * n), '1:' || ({TOP} + 1 + 2 * n), 'VECTOR', '!', height, 1 FROM a""", graph=True)
def added_graphics(spark, d: str) -> DataFrame:
    return _graphics(spark, d)[0].select("id", "pid", "type", "position", "height", _shown("fill_paints", "r").alias("red"))


@query(f"""WITH a AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS n, (1 << (p_partkey % 4)::INT) AS w, (1 << (p_partkey % 3)::INT) AS h FROM part), b AS (SELECT *, 64 // w AS s FROM a)
SELECT '1:' || ({TOP} + 2 + 2 * n) AS id, 0 AS ix, 'M0,0L' || w * s || ',' || h * s || 'Z' AS path FROM b UNION ALL SELECT '1:' || ({TOP} + 2 + 2 * n), 1, 'M' || s || ',' || s || 'L' || 3 * s || ',' || s FROM b""", graph=True)
def graphic_paths(spark, d: str) -> DataFrame:
    """Fill regions of placed graphics, through the byte form that documents keep."""
    from sceneloom.operators import vectors
    from sceneloom.sources import paths

    fills = _graphics(spark, d)[1].where("kind = 'fill'")
    return fills.select("id", "ix", vectors.path_text(paths.decoded(F.col("bytes"))).alias("path"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN 0 ELSE p_size END::BIGINT AS width, CASE WHEN p_partkey % 3 = 2 THEN 0 ELSE p_size + 1 END::BIGINT AS height FROM part")
def picture_sizes(spark, d: str) -> DataFrame:
    """Sizes from the headers of PNG and JPEG files, and none from other files."""
    from sceneloom.sources import pictures

    number = lambda c, n: F.lpad(F.hex(c.cast("long")), n, "0")
    w, h = F.col("p_size"), F.col("p_size") + 1
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), number(w, 8), number(h, 8), F.lit("0806000000"))
    jpeg = F.concat(F.lit("FFD8FFE000104A46494600010100000100010000FFC0001108"), number(h, 4), number(w, 4), F.lit("03012200021101031101"))
    key = F.col("p_partkey") % 3
    data = F.unhex(F.when(key == 0, png).when(key == 1, jpeg).otherwise("47494638"))
    return table(spark, d, "part").select("p_partkey", data.alias("data")).select("p_partkey", pictures.sizes("data").alias("s")).select("p_partkey", "s.width", "s.height")


@query("""WITH p AS (SELECT vec_id, [floor((x + 1) / 2 * 255)::INT FOR x IN embedding[1:30]::DOUBLE[]] AS a, [floor((x + 1) / 2 * 255)::INT FOR x IN embedding[31:60]::DOUBLE[]] AS b, abs(embedding[1])::DOUBLE AS score FROM embeddings)
SELECT vec_id, CASE WHEN score >= 0.99 THEN 'PASS' WHEN score >= 0.9 THEN 'WARN' ELSE 'FAIL' END AS tier, array_to_string([floor(b[i] / 2 + (255 - a[i]) / 2 + 0.5)::INT FOR i IN range(1, 31)], ',') AS overlay FROM p""")
def report_overlays(spark, d: str) -> DataFrame:
    """Rows of a comparison report: tier and overlay of each pair of pictures."""
    from sceneloom.operators import imagediff

    channel = lambda first: F.transform(F.slice("embedding", first, 30), lambda x: F.floor((x.cast("double") + 1) / 2 * 255).cast("int"))
    rows = table(spark, d, "embeddings").select("vec_id", channel(1).alias("a"), channel(31).alias("b"), F.abs(F.col("embedding")[0].cast("double")).alias("score"))
    return imagediff.report_rows(rows, "vec_id", "a", "b", "score").select("vec_id", "tier", F.array_join("overlay", ",").alias("overlay"))


@query("""WITH b AS (SELECT p_partkey AS ix, 'M' || p_size || ',0L1,' || p_size || 'Z' AS d FROM part WHERE p_partkey % 3 <> 0)
SELECT o_orderkey AS id, coalesce(x.d, '-') || ' ' || coalesce(y.d, '-') AS paths FROM orders LEFT JOIN b x ON x.ix = o_orderkey % 50 LEFT JOIN b y ON y.ix = o_custkey % 50""")
def geometry_paths(spark, d: str) -> DataFrame:
    """Fill regions of shapes by the places of their byte strings; some are missing."""
    from sceneloom.operators import vectors
    from sceneloom.sources import paths

    size = F.col("p_size")
    text = F.concat(F.lit("M"), size, F.lit(" 0L1 "), size, F.lit("Z"))
    blobs = table(spark, d, "part").where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("ix"), paths.encoded_svg(text).alias("bytes"))
    region = lambda c: F.struct((F.col(c) % 50).alias("blob"), F.lit("NONZERO").alias("winding"), F.lit(0).cast("long").alias("style"))
    shapes_ = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.array(region("o_orderkey"), region("o_custkey")).alias("fill_geometry"))
    out = vectors.with_blobs(shapes_, blobs, paths.decoded)
    return out.select("id", F.array_join(F.transform("fill_geometry", lambda g: F.coalesce(g["d"], F.lit("-"))), " ").alias("paths"))


@query("""WITH t AS (SELECT doc_id, hex(encode(text)) AS x FROM documents WHERE text IS NOT NULL), w AS (SELECT doc_id, rpad(unnest(regexp_extract_all(x, '.{1,8}')), 8, '0') AS w FROM t)
SELECT t.doc_id, coalesce(sum(('0x' || w)::BIGINT), 0)::BIGINT % 4294967296 AS checksum FROM t LEFT JOIN w USING (doc_id) GROUP BY t.doc_id""")
def table_checksums(spark, d: str) -> DataFrame:
    """Checksums, as font tables have them, of whole texts."""
    from sceneloom.functions.scalars import table_checksum

    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", table_checksum(F.col("text").cast("binary")).alias("checksum"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'SOLID,new,IMAGE' WHEN 1 THEN 'new' ELSE 'new' END AS paints FROM part")
def paints_replaced(spark, d: str) -> DataFrame:
    """Paints in which a new picture takes the place of the first picture, or of all where there is none."""
    from sceneloom.operators import template

    key = F.col("p_partkey") % 3
    kinds = F.when(key == 0, F.array(F.lit("SOLID"), F.lit("IMAGE"), F.lit("IMAGE"))).when(key == 1, F.array(F.lit("SOLID"), F.lit("SOLID")))
    paints = F.transform(kinds, lambda k: F.struct(k.alias("type"), k.alias("name")))
    new = F.struct(F.lit("IMAGE").alias("type"), F.lit("new").alias("name"))
    rows = table(spark, d, "part").select("p_partkey", paints.alias("paints"))
    return rows.select("p_partkey", F.array_join(F.transform(template.with_paint(F.col("paints"), new), lambda p: p["name"]), ",").alias("paints"))

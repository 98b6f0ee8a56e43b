"""Registered queries for links, templates, fonts, formatting and drawing over the stand-in document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sceneloom.functions import scalars as S
from sceneloom.operators import edit, fonts, instances, svg, template, tree, vectors
from sceneloom.sources import paths

from .catalogue import query
from .graph import NODES_SQL, nodes, table

# A document whose symbols hold texts: suppliers stand below the symbols of the same number.
DEEP_SQL = (
    NODES_SQL
    + """,
deep AS (SELECT id, pid, ord, type, name, phase, symbol_id FROM nodes UNION ALL
SELECT '6:' || s_suppkey, '5:' || s_suppkey, 6000000000 + s_suppkey, 'TEXT', s_name, CASE WHEN s_nationkey = 3 THEN 'REMOVED' ELSE 'CREATED' END, NULL FROM supplier)"""
)


def deep_nodes(spark, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    key = F.col("s_suppkey").cast("string")
    texts = s.select(
        F.concat(F.lit("6:"), key).alias("id"), F.concat(F.lit("5:"), key).alias("pid"), (F.col("s_suppkey") + 6_000_000_000).alias("ord"), F.lit("TEXT").alias("type"), F.col("s_name").alias("name"),
        F.when(F.col("s_nationkey") == 3, "REMOVED").otherwise("CREATED").alias("phase"), F.lit(None).cast("string").alias("symbol_id"),
    )
    return nodes(spark, d).select(texts.columns).unionByName(texts)


@query("WITH RECURSIVE " + DEEP_SQL + """,
live AS (SELECT * FROM deep WHERE phase <> 'REMOVED'),
step AS (SELECT pid AS parent, id AS child FROM live UNION SELECT i.id, c.id FROM live i JOIN live c ON c.pid = i.symbol_id WHERE i.type = 'INSTANCE'),
w AS (SELECT id AS root, id FROM live WHERE type = 'SLIDE' UNION SELECT w.root, s.child FROM w JOIN step s ON s.parent = w.id)
SELECT w.root, count(*) AS n, count(*) FILTER (WHERE type = 'TEXT') AS n_texts, arg_min(w.id, ord) FILTER (WHERE type = 'TEXT') AS first_text FROM w JOIN live ON live.id = w.id GROUP BY w.root""")  # fmt: skip
def walk_through_instances(spark, d: str) -> DataFrame:
    n = deep_nodes(spark, d)
    found = tree.walk_links(n, n.where("type = 'SLIDE'")).join(n.select("id", "type", "ord"), "id")
    text = F.col("type") == "TEXT"
    return found.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.count_if(text).alias("n_texts"), F.min_by(F.when(text, F.col("id")), F.when(text, F.col("ord"))).alias("first_text"))


@query("WITH RECURSIVE " + DEEP_SQL + """,
step AS (SELECT pid AS parent, id AS child FROM deep WHERE pid IS NOT NULL UNION SELECT i.id, y.id FROM deep i JOIN deep y ON y.id = i.symbol_id WHERE i.type = 'INSTANCE'),
w AS (SELECT id AS root, id FROM deep WHERE type = 'SLIDE' UNION SELECT w.root, s.child FROM w JOIN step s ON s.parent = w.id)
SELECT w.root, w.id, s_acctbal AS shade FROM w JOIN supplier ON w.id = '6:' || s_suppkey WHERE s_acctbal < 5000""")  # fmt: skip
def walk_into_symbols(spark, d: str) -> DataFrame:
    n, s = deep_nodes(spark, d), table(spark, d, "supplier")
    found = tree.walk_links(n, n.where("type = 'SLIDE'"), skip_removed=False, enter_symbol=True)
    shades = s.where("s_acctbal < 5000").select(F.concat(F.lit("6:"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_acctbal").alias("shade"))
    return found.join(shades, "id").select("root", "id", "shade")


@query("WITH " + DEEP_SQL + " SELECT s.id AS symbol, 'k' || right(t.name, 1) AS override_key, arg_max(t.id, t.ord) AS id FROM deep s JOIN deep t ON t.pid = s.id WHERE s.type = 'SYMBOL' GROUP BY ALL")
def override_targets(spark, d: str) -> DataFrame:
    n = deep_nodes(spark, d)
    n = n.withColumn("override_key", F.when(F.col("type") == "TEXT", F.concat(F.lit("k"), F.right("name", F.lit(1)))))
    return tree.override_targets(n, n.where("type = 'SYMBOL'"))


# Templates ----------------------------------------------------------------------------------------

DRAFTS = "drafts AS (SELECT id, pid, ord, row_number() OVER (ORDER BY ord) AS k FROM nodes WHERE type = 'SLIDE')"
TOP = "(SELECT max(split_part(id, ':', 2)::BIGINT) FROM nodes)"


@query(f"""WITH {DRAFTS}, m AS (SELECT d.*, split_part(id, ':', 1) || ':' || ({TOP} + k) AS module FROM drafts d)
SELECT n.id, coalesce(m.module, n.pid) AS pid, n.type, n.name FROM nodes n LEFT JOIN m ON m.id = n.id UNION ALL SELECT m.module, m.pid, 'MODULE', n.name FROM m JOIN nodes n ON n.id = m.id""", graph=True)
def publish_drafts(spark, d: str) -> DataFrame:
    n = nodes(spark, d)
    return template.publish(n, n.where("type = 'SLIDE'").select(F.col("id").alias("slide"))).select("id", "pid", "type", "name")


@query(f"""WITH q AS (SELECT row_number() OVER (ORDER BY ord) - 1 AS place, id AS root FROM nodes WHERE type = 'SLIDE'),
t AS (SELECT q.place, q.root, n.id AS old_id, n.ord, n.type FROM q JOIN nodes n ON n.id = q.root UNION ALL SELECT q.place, q.root, n.id, n.ord, n.type FROM q JOIN nodes n ON n.pid = q.root WHERE n.phase <> 'REMOVED'),
k AS (SELECT *, '200:' || ({TOP} + row_number() OVER (ORDER BY place, old_id <> root, ord)) AS id FROM t)
SELECT k.id, CASE WHEN k.old_id = k.root THEN '2:0' ELSE p.id END AS pid, k.type, k.place, k.old_id FROM k JOIN k p ON p.place = k.place AND p.old_id = k.root""", graph=True)
def clone_layouts(spark, d: str) -> DataFrame:
    from sceneloom.functions.ranking import numbered

    n = nodes(spark, d)
    wanted = numbered(n.where("type = 'SLIDE'").select("ord", F.col("id").alias("root")), ["ord"], "place", 0).select("place", "root")
    return template.clone_layouts(n, wanted, "2:0").select("id", "pid", "type", "place", "old_id")


@query("""WITH s AS (SELECT id FROM nodes WHERE type = 'SLIDE' AND pid = '2:7'), f AS (SELECT arg_min(n.id, n.ord) AS id FROM nodes n JOIN s ON n.pid = s.id WHERE n.type = 'INSTANCE' GROUP BY n.pid)
SELECT id, CASE WHEN id IN (SELECT id FROM s) OR id IN (SELECT id FROM f) THEN 'REMOVED' ELSE phase END AS phase FROM nodes""", graph=True)
def remove_slides(spark, d: str) -> DataFrame:
    n = nodes(spark, d)
    return template.remove_slides(n, n.where("type = 'SLIDE' and pid = '2:7'"), all_children=False).select("id", "phase")


@query("WITH s AS (SELECT id FROM nodes WHERE type = 'SLIDE' AND pid = '2:7') SELECT n.id, CASE WHEN n.id IN (SELECT id FROM s) OR n.pid IN (SELECT id FROM s) THEN 'REMOVED' ELSE phase END AS phase FROM nodes n", graph=True)
def remove_slides_whole(spark, d: str) -> DataFrame:
    n = nodes(spark, d)
    return template.remove_slides(n, n.where("type = 'SLIDE' and pid = '2:7'")).select("id", "phase")


@query("""WITH b AS (SELECT i.symbol_id, arg_min(s.id, s.ord) AS slide FROM nodes s JOIN nodes i ON i.pid = s.id AND i.type = 'INSTANCE' WHERE s.type = 'SLIDE' GROUP BY 1)
SELECT y.id AS symbol_id, coalesce(b.slide, (SELECT arg_min(id, ord) FROM nodes WHERE type = 'SLIDE')) AS slide FROM nodes y LEFT JOIN b ON b.symbol_id = y.id WHERE y.type = 'SYMBOL'""", graph=True)
def slide_for_symbol(spark, d: str) -> DataFrame:
    return template.slide_for_symbol(nodes(spark, d))


@query("SELECT id, CASE WHEN type = 'SLIDE' THEN 'layout:' || name ELSE name END AS name FROM nodes", graph=True)
def annotate_layouts(spark, d: str) -> DataFrame:
    n = nodes(spark, d)
    names = n.where("type = 'SLIDE'").select("id", F.concat(F.lit("slot:text:"), "name").alias("name"))
    return template.annotate(n, names, "layout:").select("id", "name")


@query("SELECT sha1(text) AS sha1 FROM documents WHERE lang = 'en' UNION SELECT sha1(text) FROM documents WHERE source IS NOT NULL")
def put_images(spark, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("lang", "source", F.col("text").cast("binary").alias("bytes")).where("bytes is not null")
    have = t.where("lang = 'en'").select(F.sha1("bytes").alias("sha1"), "bytes").dropDuplicates(["sha1"])
    return edit.put_images(have, t.where("source is not null")).select("sha1")


# Fonts --------------------------------------------------------------------------------------------


@query("""WITH n AS (SELECT DISTINCT p_brand AS family, CASE p_size % 4 WHEN 0 THEN 400 WHEN 1 THEN 500 WHEN 2 THEN 700 ELSE 100 END AS weight FROM part WHERE p_brand NOT IN (SELECT min(p_brand) FROM part)),
h AS (SELECT DISTINCT p_brand || '-' || CASE p_size % 4 WHEN 0 THEN 400 WHEN 1 THEN 500 WHEN 2 THEN 700 ELSE 100 END || '-normal.ttf' AS key FROM part WHERE p_retailprice > 1500),
m AS (SELECT n.*, h.key IS NULL AS gone FROM n LEFT JOIN h ON h.key = family || '-' || weight || '-normal.ttf')
SELECT family, count(*) AS n_weights, count(*) FILTER (WHERE gone) AS n_missing, coalesce(string_agg(weight::VARCHAR, ' ' ORDER BY weight) FILTER (WHERE gone), '') AS missing,
CASE WHEN count(*) FILTER (WHERE gone) = 0 THEN 'resolved' WHEN count(*) FILTER (WHERE gone) = count(*) THEN 'failed' ELSE 'partial' END AS state FROM m GROUP BY family""")
def font_plan(spark, d: str) -> DataFrame:
    p = table(spark, d, "part")
    style = F.element_at(F.array(*map(F.lit, ("Regular", "Medium Italic", "Semi Bold", "Thin"))), (F.col("p_size") % 4 + 1).cast("int"))
    texts = p.select(F.col("p_brand").alias("family"), style.alias("style"), "p_retailprice")
    have = texts.where("p_retailprice > 1500").select(fonts.cache_key(F.col("family"), S.inventory_weight(F.col("style"))).alias("key"), F.lit("cache").alias("source"))
    plan = fonts.resolve(fonts.inventory(texts), p.agg(F.min("p_brand").alias("family")), have)
    return plan.withColumn("missing", F.array_join(F.col("missing").cast("array<string>"), " "))


# Formatting and drawing ---------------------------------------------------------------------------


@query("""WITH e AS (SELECT vec_id, [(x + 1) / 2 FOR x IN embedding[1:4]::DOUBLE[]] AS c, embedding::DOUBLE[] AS v FROM embeddings)
SELECT vec_id, printf('rgba(%d,%d,%d,%.4f)', floor(c[1] * 255 + 0.5)::INT, floor(c[2] * 255 + 0.5)::INT, floor(c[3] * 255 + 0.5)::INT, c[4]) AS colour,
printf('%.2f', v[5] * 1000) AS two, CASE WHEN vec_id % 3 = 0 THEN abs(v[6]) * 20 WHEN vec_id % 3 = 1 THEN abs(v[6]) / 100 * 20 ELSE abs(v[6]) END AS height FROM e""")
def css_format(spark, d: str) -> DataFrame:
    at = lambda k: F.col("embedding")[k].cast("double")
    c = [(at(k) + 1) / 2 for k in range(4)]
    units = F.element_at(F.array(*map(F.lit, ("RAW", "PERCENT", "PIXELS"))), (F.col("vec_id") % 3 + 1).cast("int"))
    return table(spark, d, "embeddings").select("vec_id", S.css_colour(*c).alias("colour"), S.to_fixed(at(4) * 1000, 2).alias("two"), S.line_height(units, F.abs(at(5)), F.lit(20.0)).alias("height"))


@query(r"""SELECT p_partkey, upper(p_name) AS shown, CASE WHEN p_type ILIKE '%bold%' THEN 700 WHEN p_type ILIKE '%medium%' THEN 500 ELSE 400 END AS weight, p_partkey || ':' || p_size AS id,
CASE WHEN p_size > 25 THEN p_size / 1920.0::DOUBLE WHEN p_size > 10 THEN 0.5::DOUBLE ELSE 1::DOUBLE END AS scale FROM part""")
def text_attributes(spark, d: str) -> DataFrame:
    size = F.col("p_size").cast("double")
    scale = S.render_scale(F.when(size > 25, size).otherwise(0.0), F.lit(None).cast("double"), F.when(size > 10, 0.5))
    return table(spark, d, "part").select("p_partkey", S.text_case(F.col("p_name"), F.lit("UPPER")).alias("shown"), S.style_weight(F.col("p_type")).alias("weight"), S.guid_id(F.col("p_partkey"), F.col("p_size")).alias("id"), scale.alias("scale"))


RED, BLUE = "rgba(255,0,0,1.0000)", "rgba(0,0,255,0.5000)"


def drawn_nodes(spark, d: str) -> DataFrame:
    """Slides (customers), groups (orders) and shapes (line items: rectangles, ellipses, lines, others) with sizes and paints."""
    none = F.lit(None)
    paint = lambda r, b, a: F.array(F.struct(F.lit("SOLID").alias("type"), none.cast("boolean").alias("visible"), F.lit(a).alias("opacity"), F.lit(r).alias("r"), F.lit(0.0).alias("g"), F.lit(b).alias("b"), F.lit(1.0).alias("a")))
    at = lambda x, y: F.struct(F.lit(1.0).alias("m00"), F.lit(0.0).alias("m01"), x.cast("double").alias("m02"), F.lit(0.0).alias("m10"), F.lit(1.0).alias("m11"), y.cast("double").alias("m12"))
    base = nodes(spark, d).select("id", "pid", "ord", "type", "phase")
    plain = {"opacity": none.cast("double"), "width": none.cast("double"), "height": none.cast("double"), "radius": none.cast("double"), "transform": at(F.lit(0), F.lit(0)), "fill_paints": none.cast(f"array<{svg.PAINT}>"), "stroke_paints": none.cast(f"array<{svg.PAINT}>"), "stroke_weight": none.cast("double"), "stroke_align": none.cast("string")}
    above = base.where("type <> 'SYMBOL'").withColumn("type", F.when(F.col("type") == "INSTANCE", "GROUP").otherwise(F.col("type"))).withColumns(plain)
    line = table(spark, d, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy(*["l_linenumber"] + [c for c in line.columns if c not in ("l_linenumber", "l_orderkey")])
    k = F.row_number().over(w)
    key, kind = F.col("l_orderkey").cast("string"), F.col("l_linenumber")
    leaf = line.withColumn("k", k).select(
        F.concat(F.lit("6:"), key, F.lit(":"), F.col("k").cast("string")).alias("id"), F.concat(F.lit("4:"), key).alias("pid"), F.col("k").cast("long").alias("ord"),
        F.when(kind == 1, "RECTANGLE").when(kind == 2, "ELLIPSE").when(kind == 3, "LINE").otherwise("WIDGET").alias("type"), F.lit("CREATED").alias("phase"), F.when(F.col("l_returnflag") == "R", 0.25).alias("opacity"),
        F.col("l_quantity").alias("width"), F.lit(8.0).alias("height"), F.lit(3.0).alias("radius"), at(F.col("l_partkey"), F.col("l_suppkey")).alias("transform"),
        paint(1.0, 0.0, 1.0).alias("fill_paints"), paint(0.0, 1.0, 0.5).alias("stroke_paints"), F.lit(2.0).alias("stroke_weight"), F.lit("INSIDE").alias("stroke_align"),
    )
    return above.unionByName(leaf)


@query(f"""WITH l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS k, l_linenumber AS kind, l_quantity::BIGINT AS w,
  regexp_replace((l_quantity / 2)::VARCHAR, '\\.0$', '') AS half, regexp_replace((l_quantity / 2 - 1)::VARCHAR, '\\.0$', '') AS inset, regexp_replace(least(3, l_quantity / 2)::VARCHAR, '\\.0$', '') AS r, regexp_replace(greatest(least(3, l_quantity / 2) - 1, 0)::VARCHAR, '\\.0$', '') AS ri, l_partkey AS x, l_suppkey AS y, l_returnflag AS flag FROM lineitem),
b AS (SELECT *, CASE kind
 WHEN 1 THEN '<g transform="translate(' || x || ',' || y || ')">' || chr(10) || '<rect x="0" y="0" width="' || w || '" height="8" rx="' || r || '" ry="' || r || '" fill="{RED}"/>' || CASE WHEN w > 2 THEN chr(10) || '<rect x="1" y="1" width="' || (w - 2) || '" height="6" rx="' || ri || '" ry="' || ri || '" fill="none" stroke="{BLUE}" stroke-width="2"/>' ELSE '' END || chr(10) || '</g>'
 WHEN 2 THEN '<g transform="translate(' || x || ',' || y || ')">' || chr(10) || '<ellipse cx="' || half || '" cy="4" rx="' || half || '" ry="4" fill="{RED}"/>' || CASE WHEN w > 2 THEN chr(10) || '<ellipse cx="' || half || '" cy="4" rx="' || inset || '" ry="3" fill="none" stroke="{BLUE}" stroke-width="2"/>' ELSE '' END || chr(10) || '</g>'
 WHEN 3 THEN '<line x1="' || x || '" y1="' || y || '" x2="' || (x + w) || '" y2="' || y || '" stroke="{BLUE}" stroke-width="2"/>'
 ELSE '<g transform="translate(' || x || ',' || y || ')"><rect x="0" y="0" width="' || w || '" height="8" fill="none" stroke="#ff00ff" stroke-width="2" stroke-dasharray="6" opacity="0.5"/><!-- WIDGET --></g>' END AS f FROM l),
o AS (SELECT l_orderkey, string_agg(CASE WHEN flag = 'R' THEN '<g opacity="0.25">' || f || '</g>' ELSE f END, chr(10) ORDER BY k) AS f FROM b GROUP BY 1),
s AS (SELECT o_custkey, string_agg('<g transform="translate(0,0)">' || chr(10) || f || chr(10) || '</g>', chr(10) ORDER BY o_orderkey) AS f FROM orders JOIN o ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'F' GROUP BY 1)
SELECT '3:' || c_custkey AS id, '<svg xmlns="http://www.w3.org/2000/svg" xmlns:xlink="http://www.w3.org/1999/xlink" width="1920" height="1080" viewBox="0 0 1920 1080">' || chr(10) || '  <defs>' || chr(10) || '    <clipPath id="slide-clip"><rect width="1920" height="1080"/></clipPath>' || chr(10) || '  </defs>' || chr(10)
 || '  <rect width="1920" height="1080" fill="white"/>' || chr(10) || '  <g clip-path="url(#slide-clip)">' || chr(10) || coalesce(f, '') || chr(10) || '  </g>' || chr(10) || '</svg>' AS svg FROM customer LEFT JOIN s ON o_custkey = c_custkey""")
def draw_slides(spark, d: str) -> DataFrame:
    n = drawn_nodes(spark, d)
    return svg.draw_slides(n, n.where("type = 'SLIDE'"))


@query("""WITH i AS (SELECT o_custkey AS k, o_orderkey % 300 - 100.0::DOUBLE AS x, o_orderkey % 200 - 50.0::DOUBLE AS y, o_orderkey % 90 + 1.0::DOUBLE AS w, o_orderkey % 70 + 1.0::DOUBLE AS h,
  o_orderkey % (SELECT count(*) + count(*) // 20 FROM part) AS symbol FROM orders WHERE o_orderstatus <> 'F'),
y AS (SELECT p_partkey, 50.0::DOUBLE AS w, 40.0::DOUBLE AS h, least(0, coalesce(s_acctbal / 100 - 30, 0)) AS x0, greatest(50, coalesce(s_acctbal / 100 - 30 + 20, 50)) AS x1 FROM part LEFT JOIN supplier ON s_suppkey = p_partkey AND s_nationkey <> 3),
b AS (SELECT k, x AS x0, y AS y0, x + w AS x1, y + h AS y1 FROM i UNION ALL SELECT k, i.x + y.x0 * (i.w / y.w), i.y, i.x + y.x1 * (i.w / y.w), i.y + 40 * (i.h / y.h) FROM i JOIN y ON p_partkey = symbol)
SELECT '3:' || c_custkey AS id, round(least(0, coalesce(min(x0), 0)), 6) AS min_x, round(least(0, coalesce(min(y0), 0)), 6) AS min_y, round(greatest(120, coalesce(max(x1), 120)), 6) AS max_x, round(greatest(80, coalesce(max(y1), 80)), 6) AS max_y
FROM customer LEFT JOIN b ON k = c_custkey GROUP BY c_custkey""".replace("least(0,", "least(0::DOUBLE,").replace("greatest(50,", "greatest(50::DOUBLE,").replace("greatest(120,", "greatest(120::DOUBLE,").replace("greatest(80,", "greatest(80::DOUBLE,"))
def overflow_bounds(spark, d: str) -> DataFrame:
    n, s = deep_nodes(spark, d), table(spark, d, "supplier")
    at = s.select(F.concat(F.lit("6:"), F.col("s_suppkey").cast("string")).alias("id"), (F.col("s_acctbal") / 100 - 30).alias("shift"))
    key = S.parse_id(F.col("id"))["local"]
    by = lambda slide, instance, symbol, text: F.when(F.col("type") == "SLIDE", slide).when(F.col("type") == "INSTANCE", instance).when(F.col("type") == "SYMBOL", symbol).otherwise(text).cast("double")
    none = F.lit(None)
    n = n.join(at, "id", "left").withColumns({
        "visible": none.cast("boolean"), "x": by(none, key % 300 - 100, none, F.col("shift")), "y": by(none, key % 200 - 50, none, none),
        "width": by(F.lit(120), key % 90 + 1, F.lit(50), F.lit(20)), "height": by(F.lit(80), key % 70 + 1, F.lit(40), F.lit(10)),
    })
    out = svg.content_bounds(n, n.where("type = 'SLIDE'"))
    return out.select("id", *(F.round(c, 6).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")))


@query(f"""WITH p AS (SELECT p_partkey AS id, p_partkey % 6 AS kind, p_size AS s, 'M0,0L' || p_size || ',0L' || p_size || ',8.5Z' AS d, 'M0,0C1.25,2 3,4 ' || p_size || ',6' AS e FROM part)
SELECT id, CASE kind WHEN 5 THEN '<g transform="translate(' || s || ',0)"><rect x="0" y="0" width="40" height="8" fill="none" stroke="#ff00ff" stroke-width="2" stroke-dasharray="6" opacity="0.5"/><!-- VECTOR --></g>'
ELSE '<g transform="matrix(1,0,0,1,' || s || ',0)">' || chr(10) || CASE kind WHEN 0 THEN '<path d="' || d || '" fill="{RED}" fill-rule="evenodd"/>'
 WHEN 1 THEN '<path d="' || d || '" fill="none" stroke="{BLUE}" stroke-width="4" stroke-linejoin="miter"/>' || chr(10) || '<path d="' || d || '" fill="{RED}"/>'
 WHEN 2 THEN '<path d="' || d || '" fill="{RED}"/>' || chr(10) || '<path d="' || d || e || '" fill="{BLUE}" fill-rule="evenodd"/>' WHEN 3 THEN '<path d="' || d || '" fill="{BLUE}"/>' || chr(10) || '<path d="' || e || '" fill="{RED}"/>'
 ELSE '<path d="' || d || '" fill="{RED}" fill-rule="evenodd"/>' END || chr(10) || '</g>' END AS text FROM p""")
def draw_vectors(spark, d: str) -> DataFrame:
    none, kind, size = F.lit(None), F.col("p_partkey") % 6, F.col("p_size").cast("string")
    paint = lambda r, b, a: F.array(F.struct(F.lit("SOLID").alias("type"), none.cast("boolean").alias("visible"), F.lit(a).alias("opacity"), F.lit(r).alias("r"), F.lit(0.0).alias("g"), F.lit(b).alias("b"), F.lit(1.0).alias("a")))
    p = table(spark, d, "part").select("p_partkey", "p_size", F.concat(F.lit("M0,0L"), size, F.lit(",0L"), size, F.lit(",8.5Z")).alias("d"), F.concat(F.lit("M0,0C1.25,2 3,4 "), size, F.lit(",6")).alias("e"))
    for c in ("d", "e"):  # through the byte form that documents keep
        p = p.withColumn(c, vectors.path_text(paths.decoded(paths.encoded_svg(F.col(c)))))
    piece = lambda c, style: F.struct(F.col(c).alias("d"), F.when(kind == 0, "EVENODD").otherwise("NONZERO").alias("winding"), F.lit(style).cast("long").alias("style"))
    n = p.select(
        F.col("p_partkey").alias("id"), F.lit("VECTOR").alias("type"), F.lit("CREATED").alias("phase"), none.cast("double").alias("opacity"), none.cast("double").alias("width"), F.lit(8.0).alias("height"), none.cast("double").alias("radius"), F.lit("").alias("inner"),
        F.struct(*(F.lit(v).alias(k) for k, v in (("m00", 1.0), ("m01", 0.0))), F.col("p_size").cast("double").alias("m02"), *(F.lit(v).alias(k) for k, v in (("m10", 0.0), ("m11", 1.0), ("m12", 0.0)))).alias("transform"),
        paint(1.0, 0.0, 1.0).alias("fill_paints"), F.when(kind.isin(1, 2), paint(0.0, 1.0, 0.5)).alias("stroke_paints"), F.lit(2.0).alias("stroke_weight"), F.when(kind == 1, "OUTSIDE").otherwise("CENTER").alias("stroke_align"),
        F.when(kind == 3, F.array(piece("d", 7), piece("e", 9))).when(kind < 3, F.array(piece("d", 0))).alias("fill_geometry"),
        F.when(kind == 2, F.array(*(F.struct(F.col(c).alias("d"), F.lit("NONZERO").alias("winding")) for c in ("d", "e")))).alias("stroke_geometry"),
        F.array(F.struct(F.lit(7).cast("long").alias("style"), paint(0.0, 1.0, 0.5).alias("paints"))).alias("style_fills"), F.when(kind == 4, F.col("d")).alias("network"),
    )
    return svg.fragments(n).select("id", "text")


# Texts and instances ------------------------------------------------------------------------------

WEIGHTS_SQL = "CASE WHEN p_size % 4 = 0 THEN 'Regular' WHEN p_size % 4 = 1 THEN 'SemiBold Italic' WHEN p_size % 4 = 2 THEN 'Bold' ELSE 'Medium' END"


def _text_nodes(spark, d: str) -> DataFrame:
    """A text node for each part, its name on lines of its words; every third has glyphs that fit, every third a layout that does not, the rest none."""
    key, size, none = F.col("p_partkey"), F.col("p_size").cast("double"), F.lit(None)
    words = F.concat_ws("\n", F.split("p_name", " "))
    n = F.length("p_name")
    glyph = lambda i: F.struct(i.alias("first"), (i * 10.0).alias("x"), F.lit(12.5).alias("y"), F.lit(20.0).alias("size"))
    glyphs = F.transform(F.sequence(F.lit(0), n - 1), glyph)
    line = F.array(F.struct(F.lit(0).alias("first"), F.lit(3).alias("end"), F.lit(4.0).alias("x"), F.lit(16.0).alias("y"), F.lit(24.0).alias("line_height"), F.lit(18.0).alias("ascent")))
    laid, old = key % 3 == 0, key % 3 == 1
    style = F.when(F.col("p_size") % 4 == 0, "Regular").when(F.col("p_size") % 4 == 1, "SemiBold Italic").when(F.col("p_size") % 4 == 2, "Bold").otherwise("Medium")
    kinds = F.transform(F.split(words, "\n"), lambda w, i: F.when(i % 3 == 2, "UNORDERED_LIST").otherwise("ORDERED_LIST"))
    ids = {"m00": 1.0, "m01": 0.0, "m10": 0.0, "m11": 1.0, "m12": 0.0}
    at = F.struct(*(F.lit(ids[k]).alias(k) if k in ids else size.alias(k) for k in ("m00", "m01", "m02", "m10", "m11", "m12")))
    return table(spark, d, "part").select(
        key.alias("id"), F.lit("TEXT").alias("type"), F.lit("CREATED").alias("phase"), none.cast("double").alias("opacity"), F.lit(300.0).alias("width"), F.lit(40.0).alias("height"), none.cast("double").alias("radius"),
        F.lit("").alias("inner"), at.alias("transform"), none.cast(f"array<{svg.PAINT}>").alias("fill_paints"), none.cast(f"array<{svg.PAINT}>").alias("stroke_paints"), none.cast("double").alias("stroke_weight"), none.cast("string").alias("stroke_align"),
        F.when(laid, F.col("p_name")).otherwise(words).alias("text"), F.when(key % 5 == 0, "UPPER").alias("text_case"), F.lit("Serif").alias("font_family"), style.alias("font_style"), F.lit(20.0).alias("font_size"),
        F.when(laid, glyphs).alias("glyphs"), F.when(old, line).alias("baselines"), F.when(~laid & ~old, kinds).alias("line_types"), F.when(~laid & ~old, F.transform(kinds, lambda k: F.lit(1))).alias("line_indents"),
        F.when(old, 10.0).alias("letter_spacing"), F.lit("PERCENT").alias("letter_units"), F.when(~laid & ~old, "CENTER").alias("align"),
    )


@query(f"""WITH b AS (SELECT p_partkey AS id, p_partkey % 3 AS kind, p_size, CASE WHEN p_partkey % 5 = 0 THEN upper(p_name) ELSE p_name END AS shown, {WEIGHTS_SQL} AS style FROM part),
w AS (SELECT *, string_split(shown, ' ') AS lines, list_max([length(x) FOR x IN string_split(shown, ' ')]) AS longest FROM b),
s AS (SELECT *, CASE WHEN kind = 1 THEN greatest(least(CASE WHEN longest > 3 THEN 3 / longest::DOUBLE ELSE 1 END, CASE WHEN len(lines) > 1 THEN 1 / len(lines)::DOUBLE ELSE 1 END), 0.15) ELSE 1 END::DOUBLE AS f FROM w),
l AS (SELECT id, i, line, kind, f, (i - 1) % 3 AS m FROM s, unnest(lines) WITH ORDINALITY AS t(line, i)),
g AS (SELECT id, i, substr(shown, i, 1) AS c, CASE WHEN substr(shown, i, 3) IN ('ffl', 'ffi') THEN 3 WHEN substr(shown, i, 2) IN ('ff', 'fi', 'fl') THEN 2 ELSE 1 END AS n, substr(shown, i, CASE WHEN substr(shown, i, 3) IN ('ffl', 'ffi') THEN 3 WHEN substr(shown, i, 2) IN ('ff', 'fi', 'fl') THEN 2 ELSE 1 END) AS said FROM b, unnest(range(1, length(shown) + 1)) AS t(i) WHERE kind = 0),
spans AS (SELECT id, string_agg('<tspan x="' || (i - 1) * 10 || '" y="12.5">' || said || '</tspan>', '' ORDER BY i) AS x FROM g WHERE c <> ' ' AND NOT EXISTS (SELECT 1 FROM g h WHERE h.id = g.id AND h.i < g.i AND h.i + h.n > g.i) GROUP BY id
UNION ALL SELECT id, string_agg(CASE kind WHEN 1 THEN '<tspan x="4.00" y="' || printf('%.2f', 16 * f + (i - 1) * (24 * f)) || '" text-anchor="start">' || line ELSE '<tspan x="166.00" y="' || printf('%.2f', 16.0 + (i - 1) * 24) || '" text-anchor="middle">' || CASE m WHEN 2 THEN '• ' ELSE (m + 1) || '. ' END || line END || '</tspan>', '' ORDER BY i) FROM l WHERE kind <> 0 GROUP BY id)
SELECT s.id, s.kind, '<g transform="translate(' || p_size || ',0)">' || chr(10) || '<text font-size="' AS head, round(20 * f, 6) AS size, CASE WHEN style LIKE 'Semi%' THEN '600' WHEN style = 'Bold' THEN '700' WHEN style = 'Medium' THEN '500' ELSE '400' END || ' ' || CASE WHEN style LIKE '%Italic' THEN 'italic' ELSE 'normal' END AS style,
CASE WHEN kind = 1 THEN printf('%.3f', 2 * f) END AS space, x || '</text>' || chr(10) || '</g>' AS tail FROM s JOIN spans USING (id)""")  # fmt: skip
def draw_texts(spark, d: str) -> DataFrame:
    """Texts drawn from glyphs, anew by an old layout, and anew as lists; told apart into their parts."""
    text = svg.fragments(_text_nodes(spark, d)).select("id", "text")
    part = lambda pattern: F.nullif(F.regexp_extract("text", pattern, 1), F.lit(""))
    style = F.concat(part('font-weight="(\\d+)"'), F.lit(" "), part('font-style="(\\w+)"'))
    tail = F.regexp_extract("text", '(?s)geometricPrecision">(.*)$', 1)
    return text.select("id", (F.col("id") % 3).alias("kind"), F.regexp_extract("text", '(?s)^(.*?font-size=")', 1).alias("head"), F.round(part('font-size="([^"]*)"').cast("double"), 6).alias("size"), style.alias("style"), part('letter-spacing="([^"]*)"').alias("space"), tail.alias("tail"))


# Symbols of suppliers with even numbers hold an instance of the next one; orders set texts by key, and some swap that instance's symbol.
NESTED_SQL = (
    DEEP_SQL
    + """,
nest AS (SELECT id, pid, ord, type, name, phase, symbol_id, CASE WHEN type = 'TEXT' THEN 'k' || right(name, 1) END AS key FROM deep
 UNION ALL SELECT '10:' || s_suppkey, '5:' || s_suppkey, 10000000000 + s_suppkey, 'INSTANCE', 'nested', 'CREATED', '5:' || (s_suppkey + 1), 'n' FROM supplier WHERE s_suppkey % 2 = 0),
sym AS (SELECT id FROM nest WHERE type = 'SYMBOL' AND phase <> 'REMOVED'),
top AS (SELECT i.id, i.symbol_id AS symbol, split_part(i.id, ':', 2)::BIGINT AS o FROM nest i WHERE i.id LIKE '4:%' AND i.phase <> 'REMOVED' AND i.symbol_id IN (SELECT id FROM sym)),
kid AS (SELECT pid AS symbol, id, type, name, symbol_id, key, phase, ord FROM nest WHERE type IN ('TEXT', 'INSTANCE') AND pid LIKE '5:%'),
swap AS (SELECT t.id, '5:1' AS to_ FROM top t JOIN kid k ON k.symbol = t.symbol AND k.key = 'n' WHERE t.o % 6 = 0),
aim AS (SELECT t.id, coalesce((SELECT arg_max(k.id, k.ord) FROM kid k, swap s WHERE s.id = t.id AND k.symbol = s.to_ AND k.key = 'k' || (t.o % 10)), (SELECT arg_max(k.id, k.ord) FROM kid k WHERE k.symbol = t.symbol AND k.key = 'k' || (t.o % 10))) AS target, CASE WHEN t.o % 4 = 0 THEN 'last' ELSE 'first' END AS text FROM top t),
one AS (SELECT t.id AS inst, t.id || '/' || k.id AS id, t.id AS pid, k.id AS node, k.type, k.name, CASE WHEN k.type = 'INSTANCE' THEN coalesce(s.to_, k.symbol_id) END AS shows FROM top t JOIN kid k ON k.symbol = t.symbol AND k.phase <> 'REMOVED' LEFT JOIN swap s ON s.id = t.id AND k.key = 'n'),
two AS (SELECT inst, o.id || '/' || k.id AS id, o.id AS pid, k.id AS node, k.type, k.name, k.symbol_id AS shows FROM one o JOIN kid k ON k.symbol = o.shows AND k.phase <> 'REMOVED' WHERE o.type = 'INSTANCE' AND o.shows <> (SELECT symbol FROM top WHERE top.id = o.inst)),
three AS (SELECT inst, o.id || '/' || k.id AS id, o.id AS pid, k.id AS node, k.type, k.name FROM two o JOIN kid k ON k.symbol = o.shows AND k.phase <> 'REMOVED' WHERE o.type = 'INSTANCE')"""
)


@query("WITH " + NESTED_SQL + """, every AS (SELECT inst, id, pid, node, type, name FROM one UNION ALL SELECT inst, id, pid, node, type, name FROM two UNION ALL SELECT * FROM three)
SELECT e.id, e.pid, e.node, e.type, CASE WHEN e.type = 'TEXT' THEN coalesce(a.text, e.name) END AS text FROM every e LEFT JOIN aim a ON a.id = e.inst AND a.target = e.node""")  # fmt: skip
def expanded_instances(spark, d: str) -> DataFrame:
    n, s, key = deep_nodes(spark, d), table(spark, d, "supplier"), F.col("s_suppkey")
    n = n.withColumn("override_key", F.when(F.col("type") == "TEXT", F.concat(F.lit("k"), F.right("name", F.lit(1)))))
    nested = s.where("s_suppkey % 2 = 0").select(
        F.concat(F.lit("10:"), key).alias("id"), F.concat(F.lit("5:"), key).alias("pid"), (key + 10_000_000_000).alias("ord"), F.lit("INSTANCE").alias("type"), F.lit("nested").alias("name"),
        F.lit("CREATED").alias("phase"), F.concat(F.lit("5:"), key + 1).alias("symbol_id"), F.lit("n").alias("override_key"))
    n = n.select(nested.columns).unionByName(nested).withColumn("text", F.when(F.col("type") == "TEXT", F.col("name")))
    o, order, none = table(spark, d, "orders"), F.col("o_orderkey"), F.lit(None).cast("string")
    row = lambda ix, path, text, symbol: (F.concat(F.lit("4:"), order).alias("inst_id"), F.lit(ix).cast("long").alias("ov_ix"), F.array(path).alias("path"), text.alias("text"), none.alias("image"), symbol.alias("symbol_id"))
    digit = F.concat(F.lit("k"), order % 10)
    over = o.select(*row(1, digit, F.lit("first"), none)).unionByName(o.where("o_orderkey % 4 = 0").select(*row(2, digit, F.lit("last"), none)))
    over = over.unionByName(o.where("o_orderkey % 6 = 0").select(*row(3, F.lit("n"), none, F.lit("5:1"))))
    out = instances.expand(n, over, n.where("type = 'SLIDE'").select("id"))
    return out.where("size(chain) > 0").select("id", "pid", "node", "type", "text")


def _shape_rows(spark, d: str, kind: str, **columns) -> DataFrame:
    """A node for each part, 40 by 20, shifted by its size, with more columns."""
    none, size = F.lit(None), F.col("p_size").cast("double")
    at = F.struct(*(F.lit(1.0 if k in ("m00", "m11") else 0.0).alias(k) if k != "m02" else size.alias(k) for k in ("m00", "m01", "m02", "m10", "m11", "m12")))
    plain = {"id": F.col("p_partkey"), "type": F.lit(kind), "phase": F.lit("CREATED"), "opacity": none.cast("double"), "width": F.lit(40.0), "height": F.lit(20.0), "radius": none.cast("double"), "inner": F.lit(""), "transform": at,
             "fill_paints": none.cast(f"array<{svg.PAINT}>"), "stroke_paints": none.cast(f"array<{svg.PAINT}>"), "stroke_weight": none.cast("double"), "stroke_align": none.cast("string")}
    return table(spark, d, "part").select(*(v.alias(k) for k, v in (plain | columns).items()))


def _red(on=None):
    none = F.lit(None)
    paint = F.array(F.struct(F.lit("SOLID").alias("type"), none.cast("boolean").alias("visible"), F.lit(1.0).alias("opacity"), F.lit(1.0).alias("r"), F.lit(0.0).alias("g"), F.lit(0.0).alias("b"), F.lit(1.0).alias("a")))
    return paint if on is None else F.when(on, paint)


PLAIN_RED = "rgba(255,0,0,1.0000)"


@query(f"""SELECT p_partkey AS id, '<g transform="translate(' || p_size || ',0)">' || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE chr(10) END || '<rect x="0" y="0" width="40" height="20" rx="10" ry="10" fill="{PLAIN_RED}" ' || CASE WHEN p_partkey % 2 = 0 THEN 'stroke="{PLAIN_RED}" stroke-width="2"' ELSE '' END || '/>' || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE
 chr(10) || '<text font-size="10" font-family="Inter, sans-serif"' || chr(10) || '  font-weight="' || CASE WHEN p_partkey % 3 = 0 THEN 'bold' ELSE 'normal' END || '" font-style="normal" fill="#000000"' || chr(10) || '  text-rendering="geometricPrecision"><tspan x="20" y="12.00" text-anchor="middle">' || p_brand || '</tspan></text>' || chr(10) END || '</g>' AS text FROM part""")
def draw_shape_texts(spark, d: str) -> DataFrame:
    """Pills with and without a text and a stroke."""
    key = F.col("p_partkey")
    n = _shape_rows(
        spark, d, "SHAPE_WITH_TEXT", shape_paints=_red(), shape_radius=F.lit(1e6), shape_stroke_weight=F.when(key % 2 == 0, 2.0), shape_stroke_paints=_red(key % 2 == 0),
        shape_text=F.when(key % 4 == 0, " ").otherwise(F.col("p_brand")), font_style=F.when(key % 3 == 0, "SemiBold"), font_size=F.lit(10.0))
    return svg.fragments(n).select("id", "text")


@query(f"""SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN '<defs><filter id="fx-' || p_partkey || '" x="-10%" y="-10%" width="120%" height="120%" color-interpolation-filters="sRGB"><feGaussianBlur in="SourceAlpha" stdDeviation="' || regexp_replace((p_size / 2)::VARCHAR, '\\.0$', '') || '" result="s0b"/><feOffset in="s0b" dx="1" dy="0" result="s0o"/><feFlood flood-color="rgb(128,0,0)" flood-opacity="0.2500" result="s0c"/><feComposite in="s0c" in2="s0o" operator="in" result="s0"/><feMerge><feMergeNode in="s0"/><feMergeNode in="SourceGraphic"/></feMerge></filter></defs>' || chr(10) || '<g filter="url(#fx-' || p_partkey || ')">' ELSE '' END
 || '<g transform="translate(' || p_size || ',0)">' || chr(10) || '<rect x="0" y="0" width="40" height="20" rx="0" ry="0" fill="{PLAIN_RED}"/>' || chr(10) || '</g>' || CASE WHEN p_partkey % 2 = 0 THEN '</g>' ELSE '' END AS text FROM part""")
def draw_shadows(spark, d: str) -> DataFrame:
    """Rectangles with a drop shadow, a hidden one, or another effect."""
    key, none = F.col("p_partkey"), F.lit(None)
    effect = lambda kind, visible: F.struct(kind.alias("type"), visible.alias("visible"), F.lit(0.5).alias("r"), F.lit(0.0).alias("g"), F.lit(0.0).alias("b"), F.lit(0.25).alias("a"), F.lit(1.0).alias("x"), none.cast("double").alias("y"), F.col("p_size").cast("double").alias("radius"))
    shadow, blur = F.lit("DROP_SHADOW"), F.lit("LAYER_BLUR")
    effects = F.array(effect(F.when(key % 2 == 0, shadow).otherwise(blur), none.cast("boolean")), effect(shadow, F.lit(False)))
    return svg.fragments(_shape_rows(spark, d, "RECTANGLE", fill_paints=_red(), effects=effects)).select("id", "text")


@query(f"""WITH a AS (SELECT p_partkey AS id, p_partkey % 4 AS k, p_size FROM part)
SELECT id, CASE WHEN k = 3 THEN '<g transform="translate(' || p_size || ',0)"><rect x="0" y="0" width="40" height="20" fill="none" stroke="#ff00ff" stroke-width="2" stroke-dasharray="6" opacity="0.5"/><!-- INSTANCE --></g>'
 ELSE '<g transform="translate(' || p_size || ',0)">' || chr(10) || CASE k WHEN 0 THEN '<g transform="scale(2,0.5)">' || chr(10) ELSE '' END || '<rect x="0" y="0" width="' || CASE k WHEN 0 THEN '20' ELSE '40' END || '" height="' || CASE k WHEN 0 THEN '40' ELSE '20' END || '" rx="0" ry="0" fill="{PLAIN_RED}"/>' || chr(10) || 'inside' ||
 CASE k WHEN 2 THEN chr(10) || '<rect x="1" y="1" width="38" height="18" rx="0" ry="0" fill="none" stroke="{PLAIN_RED}" stroke-width="2"/>' ELSE '' END || CASE k WHEN 0 THEN chr(10) || '</g>' ELSE '' END || chr(10) || '</g>' END AS text FROM a""")
def draw_instances(spark, d: str) -> DataFrame:
    """Instances that are scaled, laid out by their symbol, stroked by themselves, or without a symbol."""
    k = F.col("p_partkey") % 4
    n = _shape_rows(
        spark, d, "INSTANCE", inner=F.lit("inside"), expanded=k != 3, symbol_paints=_red(), symbol_width=F.lit(20.0), symbol_height=F.lit(40.0), stack_mode=F.when(k != 0, "VERTICAL"),
        stroke_paints=_red(k == 2), stroke_weight=F.lit(2.0), stroke_align=F.lit("INSIDE"))
    return svg.fragments(n).select("id", "text")


@query(f"""WITH r AS (SELECT o_custkey, o_orderkey, o_orderkey % 50 AS x, o_orderkey % 9 + 1 AS w FROM orders WHERE o_orderstatus <> 'F'),
b AS (SELECT o_custkey, string_agg('<g transform="translate(' || x || ',0)">' || chr(10) || '<rect x="0" y="0" width="' || w || '" height="8" rx="0" ry="0" fill="{PLAIN_RED}"/>' || chr(10) || '</g>', chr(10) ORDER BY o_orderkey) AS f, max(x + w) AS m FROM r GROUP BY 1),
s AS (SELECT c_custkey, f, CASE WHEN c_custkey % 2 = 0 THEN greatest(30, coalesce(m, 0)) ELSE 30 END AS w FROM customer LEFT JOIN b ON o_custkey = c_custkey)
SELECT '3:' || c_custkey AS id, '<svg xmlns="http://www.w3.org/2000/svg" xmlns:xlink="http://www.w3.org/1999/xlink" width="' || w || '" height="20" viewBox="0 0 ' || w || ' 20">' || chr(10) || '<rect x="0" y="0" width="30" height="20" fill="white"/>' || chr(10) || coalesce(f, '') || chr(10) || '</svg>' AS svg FROM s""")
def draw_frames(spark, d: str) -> DataFrame:
    """Frames as pictures of their own; every second one is as wide as its content."""
    none, key = F.lit(None), F.col("o_orderkey")
    paints = none.cast(f"array<{svg.PAINT}>")
    at = lambda x: F.struct(*(F.lit(1.0 if k in ("m00", "m11") else 0.0).alias(k) if k != "m02" else x.cast("double").alias(k) for k in ("m00", "m01", "m02", "m10", "m11", "m12")))
    shape = lambda id_, pid, ord_, kind, phase, w, h, x, fill, mask: (id_.alias("id"), pid.alias("pid"), ord_.alias("ord"), F.lit(kind).alias("type"), phase.alias("phase"), none.cast("boolean").alias("visible"), none.cast("double").alias("opacity"), w.cast("double").alias("width"), F.lit(h).alias("height"), none.cast("double").alias("radius"), at(x).alias("transform"), fill.alias("fill_paints"), paints.alias("stroke_paints"), none.cast("double").alias("stroke_weight"), none.cast("string").alias("stroke_align"), mask.alias("mask_disabled"), none.cast("string").alias("symbol_id"))
    c = table(spark, d, "customer").select(*shape(F.concat(F.lit("3:"), "c_custkey"), none.cast("string"), F.col("c_custkey"), "FRAME", F.lit("CREATED"), F.lit(30), 20.0, F.lit(0), paints, F.col("c_custkey") % 2 == 0))
    o = table(spark, d, "orders").select(*shape(F.concat(F.lit("4:"), key), F.concat(F.lit("3:"), "o_custkey"), key, "RECTANGLE", F.when(F.col("o_orderstatus") == "F", "REMOVED").otherwise("CREATED"), key % 9 + 1, 8.0, key % 50, _red(), F.lit(None).cast("boolean")))
    n = c.unionByName(o)
    return svg.draw_frames(n, n.where("type = 'FRAME'"))

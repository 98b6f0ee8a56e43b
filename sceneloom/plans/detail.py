"""Registered queries for gradients, laid out instances, likeness of pictures, imported overrides and moves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneloom.functions import scalars as S
from sceneloom.operators import catalog, decks, edit, fills, fonts, imagediff, instances, layouts, resolve, svg, template, vectors

from .catalogue import query
from .drawing import DEEP_SQL, NESTED_SQL, _shape_rows, deep_nodes
from .graph import nodes, table

# Gradients ----------------------------------------------------------------------------------------

#: Numbers of the gradient's matrix by part, in Spark and in DuckDB alike.
_MATRIX = {"m00": "0.5e0 + p_size / 100e0", "m01": "(p_partkey % 7) / 10e0 - 0.3e0", "m02": "0.1e0", "m10": "0.25e0 - (p_partkey % 5) / 10e0", "m11": "1.1e0", "m12": "0.05e0"}


def _two(x: str) -> str:
    """SQL of a number with two decimals at most; exact ties (odd eighths) go away from zero, where printf alone takes the even digit."""
    tied = f"CASE WHEN abs({x}) * 8 = floor(abs({x}) * 8) AND floor(abs({x}) * 8)::BIGINT % 2 = 1 THEN {x} + sign({x}) * 0.0009765625 ELSE {x} END"
    return f"regexp_replace(regexp_replace(printf('%.2f', {tied}), '\\.?0+$', ''), '^-0$', '0')"


def _point(u: str, v: str, name: str) -> str:
    return f"(m11 * ({u} - m02) - m01 * ({v} - m12)) / det * w AS {name}x, (m00 * ({v} - m12) - m10 * ({u} - m02)) / det * h AS {name}y"


@query(f"""WITH m AS (SELECT p_partkey AS id, p_partkey % 5 AS kind, p_size + 10.0::DOUBLE AS w, 20.0::DOUBLE AS h, {", ".join(f"({x})::DOUBLE AS {m}" for m, x in _MATRIX.items())} FROM part),
t AS (SELECT *, m00 * m11 - m01 * m10 AS det FROM m),
g AS (SELECT id, kind, w, h, {_point("0.0", "0.5", "s")}, {_point("1.0", "0.5", "e")}, {_point("0.5", "0.5", "c")}, {_point("0.5", "1.0", "t")} FROM t),
f AS (SELECT id, kind, w::BIGINT AS w, {_two("sx")} AS sx, {_two("sy")} AS sy, {_two("ex")} AS ex, {_two("ey")} AS ey, {_two("cx")} AS cx, {_two("cy")} AS cy,
  {_two("sqrt((ex - cx) * (ex - cx) + (ey - cy) * (ey - cy))")} AS rx, {_two("sqrt((tx - cx) * (tx - cx) + (ty - cy) * (ty - cy))")} AS ry, {_two("degrees(atan2(ey - cy, ex - cx))")} AS turn FROM g),
d AS (SELECT *, '<stop offset="0" stop-color="rgba(255,0,0,1.0000)"/><stop offset="0.25" stop-color="rgba(0,255,0,0.5000)"/><stop offset="1" stop-color="rgba(0,0,255,1.0000)"/>' AS stops,
  '<rect x="0" y="0" width="' || w || '" height="20" rx="3" ry="3" fill=' AS rect FROM f),
s AS (SELECT *, '<linearGradient id="grad-' || id || '-' || CASE kind WHEN 2 THEN 2 ELSE 1 END || '" x1="' || sx || '" y1="' || sy || '" x2="' || ex || '" y2="' || ey || '" gradientUnits="userSpaceOnUse">' || stops || '</linearGradient>' AS linear,
  '<radialGradient id="grad-' || id || '-' || CASE kind WHEN 2 THEN 3 ELSE 1 END || '" cx="' || cx || '" cy="' || cy || '" rx="' || rx || '" ry="' || ry || '" gradientUnits="userSpaceOnUse" gradientTransform="rotate(' || turn || ',' || cx || ',' || cy || ')">' || stops || '</radialGradient>' AS radial FROM d)
SELECT id, '<g transform="translate(0,0)">' || chr(10) || CASE kind
 WHEN 0 THEN '<defs>' || linear || '</defs>' || chr(10) || rect || '"url(#grad-' || id || '-1)"/>' || chr(10)
 WHEN 1 THEN '<defs>' || radial || '</defs>' || chr(10) || rect || '"url(#grad-' || id || '-1)" opacity="0.5"/>' || chr(10)
 WHEN 2 THEN '<defs>' || linear || radial || '</defs>' || chr(10) || rect || '"rgba(255,0,0,1.0000)"/>' || chr(10) || rect || '"url(#grad-' || id || '-2)"/>' || chr(10) || rect || '"url(#grad-' || id || '-3)" opacity="0.5"/>' || chr(10)
 WHEN 3 THEN rect || '"rgba(255,0,0,1.0000)"/>' || chr(10) END || '</g>' AS text FROM s WHERE kind < 4 UNION ALL SELECT id, '' FROM s WHERE kind = 4""")
def gradient_fills(spark, d: str) -> DataFrame:
    """Rectangles with linear and radial gradients by skewed matrices, alone and in stacks; some hidden, without stops, or with a matrix that has no inverse."""
    none, kind = F.lit(None), F.col("p_partkey") % 5
    matrix = F.struct(*(F.expr(f"cast({x} as double)").alias(m) for m, x in _MATRIX.items()))
    flat = F.struct(*(F.lit(1.0).alias(m) for m in fills.MATRIX))
    stop = lambda at, r, g, b, a: F.struct(*(F.lit(v).alias(k) for k, v in (("position", at), ("r", r), ("g", g), ("b", b), ("a", a))))
    stops = F.array(stop(0.0, 1.0, 0.0, 0.0, 1.0), stop(0.25, 0.0, 1.0, 0.0, 0.5), stop(1.0, 0.0, 0.0, 1.0, 1.0))

    def paint(type_: str, opacity=None, visible=None, stops_=stops, matrix_=matrix):
        colour = {c: F.lit(1.0 if c == "r" else None if c == "a" else 0.0).cast("double") for c in "rgba"}
        rest = {"image": none.cast("string"), "mode": none.cast("string"), **{c: none.cast("double") for c in ("image_width", "image_height", "scale")}}
        fields = {"type": F.lit(type_), "visible": F.lit(visible).cast("boolean"), "opacity": F.lit(opacity).cast("double"), **colour, **rest, "stops": stops_, "matrix": matrix_}
        return F.struct(*(v.alias(k) for k, v in fields.items()))

    without = F.array().cast(f"array<{fills.STOP}>")
    linear, faint, solid = paint(fills.LINEAR), paint(fills.RADIAL, opacity=0.5), paint("SOLID")
    paints = F.when(kind == 0, F.array(linear)).when(kind == 1, F.array(faint)).when(kind == 2, F.array(solid, linear, faint))
    paints = paints.when(kind == 3, F.array(paint(fills.LINEAR, matrix_=flat), solid, paint(fills.RADIAL, visible=False))).otherwise(F.array(paint(fills.LINEAR, stops_=without)))
    at = F.struct(*(F.lit(1.0 if k in ("m00", "m11") else 0.0).alias(k) for k in fills.MATRIX))
    rows = _shape_rows(spark, d, "RECTANGLE", fill_paints=paints, width=(F.col("p_size") + 10).cast("double"), radius=F.lit(3.0), transform=at)
    return svg.fragments(rows).select("id", "text")


# Runs of styles -----------------------------------------------------------------------------------


@query("""WITH b AS (SELECT p_partkey AS id, p_name AS t FROM part),
g AS (SELECT id, i, substr(t, i, 1) AS c, (length(substr(t, 1, i - 1)) - length(replace(substr(t, 1, i - 1), ' ', ''))) % 3 AS style, CASE WHEN substr(t, i, 3) IN ('ffl', 'ffi') THEN 3 WHEN substr(t, i, 2) IN ('ff', 'fi', 'fl') THEN 2 ELSE 1 END AS n FROM b, unnest(range(1, length(t) + 1)) AS x(i)),
s AS (SELECT id, string_agg('<tspan x="' || (i - 1) * 10 || '" y="12.5" font-family="' || CASE style WHEN 1 THEN 'Mono' ELSE 'Serif' END || ', sans-serif" font-weight="' || CASE style WHEN 1 THEN 700 ELSE 400 END || '" font-style="' || CASE style WHEN 2 THEN 'italic' ELSE 'normal' END || '">'
  || substr(t, i, n::INT) || '</tspan>', '' ORDER BY i) AS spans FROM g JOIN b USING (id) WHERE c <> ' ' AND NOT EXISTS (SELECT 1 FROM g h WHERE h.id = g.id AND h.i < g.i AND h.i + h.n > g.i) GROUP BY id)
SELECT id, '<g transform="translate(0,0)">' || chr(10) || '<text font-size="20" font-family="Serif, sans-serif"' || chr(10) || '  font-weight="400" font-style="normal" fill="#000000"' || chr(10) || '  text-rendering="geometricPrecision">' || spans || '</text>' || chr(10) || '</g>' AS text FROM s""")
def draw_styled_texts(spark, d: str) -> DataFrame:
    """Names of parts by their glyphs, every word in the next of three styles."""
    n, none = F.length("p_name"), F.lit(None)
    places = F.sequence(F.lit(0), n - 1)
    glyph = lambda i: F.struct(i.alias("first"), (i * 10.0).alias("x"), F.lit(12.5).alias("y"), F.lit(20.0).alias("size"))
    line = F.struct(F.lit(0).alias("first"), n.alias("end"), F.lit(0.0).alias("x"), F.lit(16.0).alias("y"), F.lit(24.0).alias("line_height"), F.lit(18.0).alias("ascent"))
    style = lambda k, family, name: F.struct(F.lit(k).alias("id"), F.lit(family).cast("string").alias("family"), F.lit(name).cast("string").alias("style"))
    words = F.transform(F.split("p_name", " "), lambda w, k: F.array_repeat((k % 3).cast("int"), F.length(w) + 1))
    at = F.struct(*(F.lit(1.0 if k in ("m00", "m11") else 0.0).alias(k) for k in fills.MATRIX))
    rows = _shape_rows(
        spark, d, "TEXT", text=F.col("p_name"), transform=at, font_family=F.lit("Serif"), font_style=F.lit("Regular"), font_size=F.lit(20.0), glyphs=F.transform(places, glyph), baselines=F.array(line),
        style_ids=F.slice(F.flatten(words), F.lit(1), n), styles=F.array(style(1, "Mono", "Bold"), style(2, None, "Italic")), letter_spacing=none.cast("double"), letter_units=none.cast("string"),
    )
    return svg.fragments(rows).select("id", "text")


# Layouts inside instances -------------------------------------------------------------------------


@query(f"""WITH {DEEP_SQL},
kid AS (SELECT t.id AS node, t.pid AS symbol, t.ord, split_part(t.id, ':', 2)::BIGINT AS k FROM deep t JOIN deep s ON s.id = t.pid WHERE t.type = 'TEXT' AND t.phase <> 'REMOVED'),
i AS (SELECT id, symbol_id, split_part(id, ':', 2)::BIGINT AS o FROM deep WHERE id LIKE '4:%' AND type = 'INSTANCE' AND phase <> 'REMOVED'),
c AS (SELECT i.id || '/' || node AS id, o, k % 2 = 0 AS auto FROM i JOIN kid ON symbol = symbol_id)
SELECT id, CASE WHEN auto THEN CASE WHEN o % 5 <> 0 THEN 50 WHEN o % 4 = 0 THEN 200 ELSE 100 END ELSE 20 END::DOUBLE AS width, CASE WHEN auto AND o % 4 <> 0 THEN o ELSE 0 END::DOUBLE AS x,
 CASE WHEN o % 3 = 0 THEN 'id' WHEN o % 4 = 0 THEN 'again' ELSE 'own' END AS glyphs, CASE WHEN o % 3 = 0 THEN NULL ELSE 1 END::BIGINT AS n_baselines FROM c""")
def laid_out_instances(spark, d: str) -> DataFrame:
    """Texts inside instances, laid out by entries: one key twice, and another path that means the same node; sizes and transforms, glyphs and baselines.

    Every text has the key "k". Orders give it a width and a transform by that key; by the text's id behind another key a width
    (but for every fifth) and glyphs (for every third); every fourth again by the first key, in place of what that said.
    """
    none, number = F.lit(None), F.split_part("id", F.lit(":"), F.lit(2)).cast("long")
    glyph = lambda name: F.array(F.struct(F.lit(name).alias("said")))
    line = F.array(F.struct(F.lit(0).alias("first")))
    move = lambda x: F.struct(*((x if k == "m02" else F.lit(1.0 if k in ("m00", "m11") else 0.0)).cast("double").alias(k) for k in fills.MATRIX))
    text = F.col("type") == "TEXT"
    n = deep_nodes(spark, d).withColumns({
        "override_key": F.when(text, "k"), "text": F.when(text, F.col("name")), "width": F.when(text, 20.0), "height": F.when(text, 10.0), "transform": F.when(text, move(F.lit(0))),
        "glyphs": F.when(text, glyph("own")), "baselines": F.when(text, line), "stack_mode": F.when((F.col("type") == "SYMBOL") & (number % 2 == 0), "VERTICAL"),
    })
    o, key = n.where("type = 'INSTANCE'").select("id", "symbol_id", number.alias("o")), F.col("o")

    def entry(ix: int, path, width, transform, glyphs):
        kinds = {"width": "double", "height": "double", "transform": "struct<" + ",".join(f"{m}:double" for m in fills.MATRIX) + ">", "glyphs": "array<struct<said:string>>", "baselines": "array<struct<first:int>>"}
        values = {"width": width, "height": F.when(width.isNotNull(), 10.0), "transform": transform, "glyphs": glyphs, "baselines": F.when(glyphs.isNotNull() & (ix == 3), line) if ix == 3 else none}
        return [F.col("id").alias("inst_id"), F.lit(ix).cast("long").alias("ix"), path.alias("path"), *(v.cast(kinds[c]).alias(c) for c, v in values.items())]

    own_id = F.concat(F.lit("6:"), F.split_part("symbol_id", F.lit(":"), F.lit(2)))
    entries = o.select(*entry(1, F.array(F.lit("k")), F.lit(100.0), move(key), none))
    entries = entries.unionByName(o.select(*entry(2, F.array(F.lit("x"), own_id), F.when(key % 5 != 0, 50.0), none, F.when(key % 3 == 0, glyph("id")))))
    entries = entries.unionByName(o.where("o % 4 = 0").select(*entry(3, F.array(F.lit("k")), F.lit(200.0), none, glyph("again"))))
    none_set = spark.createDataFrame([], "inst_id string, ov_ix bigint, path array<string>, text string, image string, symbol_id string")
    out = instances.expand(n, none_set, n.where("type = 'SLIDE'").select("id"), entries=entries).where("size(chain) > 0 and type = 'TEXT'")
    return out.select("id", "width", F.col("transform.m02").alias("x"), F.col("glyphs")[0]["said"].alias("glyphs"), F.when(F.col("baselines").isNotNull(), F.size("baselines").cast("long")).alias("n_baselines"))


# Likeness of pictures -----------------------------------------------------------------------------

#: Pictures of 8 x 8 grey pixels, in tiles of 3 with windows of 4.
_SIDE, _TILE, _WINDOW = 8, 3, 4


@query(f"""WITH p AS (SELECT vec_id, i - 1 AS i, floor((x::DOUBLE + 1) / 2 * 255) AS a FROM embeddings, unnest(embedding) WITH ORDINALITY AS t(x, i)),
q AS (SELECT vec_id, i // {_SIDE} AS y, i % {_SIDE} AS x, a, a + ((i * 7 + vec_id) % 5 - 2) * (vec_id % 4) * 2 AS b FROM p),
w AS (SELECT vec_id, wy, wx, avg(a) AS ma, avg(b) AS mb, avg(a * a) AS aa, avg(b * b) AS bb, avg(a * b) AS ab FROM q, range(0, {_SIDE - _WINDOW + 1}) AS u(wy), range(0, {_SIDE - _WINDOW + 1}) AS v(wx)
  WHERE y >= wy AND y < wy + {_WINDOW} AND x >= wx AND x < wx + {_WINDOW} GROUP BY ALL),
s AS (SELECT vec_id, avg((2 * ma * mb + 6.5025) * (2 * (ab - ma * mb) + 58.5225) / ((ma * ma + mb * mb + 6.5025) * (aa - ma * ma + bb - mb * mb + 58.5225))) AS ssim FROM w GROUP BY vec_id),
d AS (SELECT vec_id, count(*) AS n_pixels, count(*) FILTER (WHERE abs(a - b) > 10) AS off_pixels, floor(avg(abs(a - b)) * 100 + 0.5) / 100 AS mean_delta,
  coalesce(floor(avg(abs(a - b)) FILTER (WHERE abs(a - b) > 10) * 10 + 0.5) / 10, 0) AS off_delta FROM q GROUP BY vec_id)
SELECT vec_id, round(ssim, 6) AS ssim, CASE WHEN ssim >= 0.99 THEN 'PASS' WHEN ssim >= 0.9 THEN 'WARN' ELSE 'FAIL' END AS tier, n_pixels, off_pixels, mean_delta, off_delta FROM s JOIN d USING (vec_id)""")
def picture_likeness(spark, d: str) -> DataFrame:
    """Structural similarity, tier and pixel figures of each vector as a grey picture and a noisier one."""
    a = lambda y: F.transform(F.slice("embedding", y * _SIDE + 1, _SIDE), lambda x: F.floor((x.cast("double") + 1) / 2 * 255).cast("double"))
    rows = table(spark, d, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(_SIDE - 1))).alias("y"), "embedding").select(F.col("vec_id").alias("key"), "y", a(F.col("y")).alias("a"))
    noise = lambda x: ((F.col("y") * _SIDE + x) * 7 + F.col("key")) % 5 - 2
    rows = rows.withColumn("b", F.transform("a", lambda v, x: v + noise(x) * (F.col("key") % 4) * 2))
    out = imagediff.picture_likeness(rows, 1, _TILE, _WINDOW)
    return out.select(F.col("key").alias("vec_id"), F.round("ssim", 6).alias("ssim"), "tier", "n_pixels", "off_pixels", "mean_delta", "off_delta")


# Imports and moves --------------------------------------------------------------------------------


@query(f"""WITH {NESTED_SQL},
t AS (SELECT s_suppkey AS place, '5:' || s_suppkey AS old, 0 AS step, 0 AS o FROM supplier JOIN part ON p_partkey = s_suppkey
  UNION ALL SELECT split_part(pid, ':', 2)::BIGINT, id, 1, ord FROM nest WHERE pid LIKE '5:%' AND type IN ('TEXT', 'INSTANCE') AND phase <> 'REMOVED' AND split_part(pid, ':', 2)::BIGINT IN (SELECT p_partkey FROM part)),
n AS (SELECT place, old, '1:' || (1 + row_number() OVER (ORDER BY place, step, o)) AS new FROM t),
v AS (SELECT s_suppkey AS k, ix, CASE ix WHEN 1 THEN ['6:' || s_suppkey, '6:' || (s_suppkey + 1)] WHEN 2 THEN ['10:' || s_suppkey, '6:' || s_suppkey, '5:' || s_suppkey] WHEN 3 THEN ['library'] END AS path FROM supplier, range(1, 5) AS r(ix) WHERE s_suppkey % 2 = 0),
u AS (SELECT k, ix, unnest(path) AS x, generate_subscripts(path, 1) AS spot FROM v WHERE path IS NOT NULL), z AS (SELECT k, ix, string_agg(coalesce(m.new, x), '>' ORDER BY spot) AS path FROM u LEFT JOIN n m ON m.place = k AND m.old = x GROUP BY k, ix)
SELECT i.new AS inst_id, v.ix AS ov_ix, coalesce(z.path, '-') AS path FROM v JOIN n i ON i.place = v.k AND i.old = '10:' || v.k LEFT JOIN z ON z.k = v.k AND z.ix = v.ix""")
def imported_overrides(spark, d: str) -> DataFrame:
    """Overrides of instances inside imported symbols: keys of their own import follow, others stay."""
    number, none = F.split_part("id", F.lit(":"), F.lit(2)).cast("long"), F.lit(None).cast("string")
    n = deep_nodes(spark, d)
    even = table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("k"))
    nested = even.select(
        F.concat(F.lit("10:"), "k").alias("id"), F.concat(F.lit("5:"), "k").alias("pid"), (F.col("k") + 10_000_000_000).alias("ord"), F.lit("INSTANCE").alias("type"), F.lit("nested").alias("name"), F.lit("CREATED").alias("phase"), F.concat(F.lit("5:"), F.col("k") + 1).alias("symbol_id")
    )
    source = n.unionByName(nested).withColumns({"component_key": none, "override_key": none, "position": F.lit("!")})
    target = spark.createDataFrame([("0:0", None, 0, "DOCUMENT"), ("0:1", "0:0", 1, "CANVAS")], "id string, pid string, ord bigint, type string")
    target = target.select("*", *(F.lit(None).cast(t).alias(c) for c, t in source.dtypes if c not in target.columns))
    symbols = source.where("type = 'SYMBOL'").select(number.alias("place"), "id")
    wanted = symbols.join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("place")), "place", "left_semi")
    mapping, new = template.import_symbols(source, target, wanted, "0:1")
    key = lambda level, more=0: F.concat(F.lit(f"{level}:"), F.col("k") + more)
    paths = F.array(F.array(key(6), key(6, 1)), F.array(key(10), key(6), key(5)), F.array(F.lit("library")), F.lit(None).cast("array<string>"))
    over = even.select(key(10).alias("inst_id"), F.posexplode(paths).alias("ov_ix", "path")).withColumn("ov_ix", (F.col("ov_ix") + 1).cast("long"))
    return template.import_overrides(over, mapping, new).withColumn("path", F.coalesce(F.array_join("path", ">"), F.lit("-")))


@query("""WITH s AS (SELECT id, pid, ord, split_part(id, ':', 2)::BIGINT AS k FROM nodes WHERE type = 'SLIDE'), n AS (SELECT pid, count(*) AS n, count(*) FILTER (WHERE k % 6 = 0) AS m FROM s GROUP BY pid),
w AS (SELECT id, s.pid, ord, n, m, CASE WHEN k % 4 = 0 THEN -(k % 5) - 1 ELSE k % 9 END AS to_ FROM s JOIN n USING (pid) WHERE k % 6 = 0),
j AS (SELECT *, CASE WHEN to_ < 0 THEN greatest(to_ + n - m, 0) ELSE to_ END AS wish FROM w), r AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY wish, ord, id) - 1 AS j FROM j),
p AS (SELECT id, pid, least(max(wish - j) OVER (PARTITION BY pid ORDER BY j), n - m) + j AS place FROM r),
free AS (SELECT pid, place, row_number() OVER (PARTITION BY pid ORDER BY place) AS i FROM (SELECT pid, unnest(range(0, n)) AS place FROM n EXCEPT SELECT pid, place FROM p)),
o AS (SELECT id, pid, row_number() OVER (PARTITION BY pid ORDER BY ord, id) AS i FROM s WHERE k % 6 <> 0)
SELECT id, pid, place, chr((33 + place)::INT) AS position FROM (SELECT id, pid, place FROM p UNION ALL SELECT o.id, o.pid, free.place FROM o JOIN free USING (pid, i))""", graph=True)
def moved_slides(spark, d: str) -> DataFrame:
    """Every sixth slide moved to a place among its siblings, from the front or from the end; several in one row meet."""
    s = nodes(spark, d).where("type = 'SLIDE'").select("id", "pid", "ord", "position")
    k = S.parse_id(F.col("id"))["local"]
    moves = s.where(k % 6 == 0).select("id", F.when(k % 4 == 0, -(k % 5) - 1).otherwise(k % 9).alias("to_index"))
    return edit.move_nodes(s, moves).select("id", "pid", "place", "position")


# Drafts, pictures of templates, removals ----------------------------------------------------------


@query("""WITH m AS (SELECT s.id, s.pid, s.ord, s.name, row_number() OVER (ORDER BY s.ord) AS k FROM nodes s JOIN nodes r ON r.id = s.pid JOIN nodes c ON c.id = r.pid WHERE s.type = 'SLIDE' AND c.name <> 'Internal Only Canvas'),
p AS (SELECT *, '3:' || ((SELECT max(split_part(id, ':', 2)::BIGINT) FROM nodes) + k) AS module FROM m)
SELECT n.id, coalesce(p.module, n.pid) AS pid, n.type FROM nodes n LEFT JOIN p USING (id) UNION ALL SELECT module, pid, 'MODULE' FROM p""", graph=True)
def publish_all_drafts(spark, d: str) -> DataFrame:
    """With no draft named, all of the main rows are published; those of the internal canvas are not."""
    return template.publish(nodes(spark, d)).select("id", "pid", "type")


@query("SELECT id, CASE WHEN type = 'INSTANCE' AND ord % 3 = 0 THEN 'REMOVED' ELSE phase END AS phase, CASE WHEN NOT (type = 'INSTANCE' AND ord % 3 = 0) THEN name END AS click FROM nodes", graph=True)
def removed_interactions(spark, d: str) -> DataFrame:
    """What a removed node did on a click goes with it."""
    n = nodes(spark, d).withColumn("interactions", F.array(F.struct(F.col("name").alias("click"))))
    out = edit.soft_delete(n, n.where("type = 'INSTANCE' and ord % 3 = 0"))
    return out.select("id", "phase", F.get("interactions", F.lit(0))["click"].alias("click"))


@query("""WITH w AS (SELECT row_number() OVER (ORDER BY ord) - 1 AS place, id AS root FROM nodes WHERE type = 'SLIDE'),
t AS (SELECT w.place, n.id, n.name, split_part(n.id, ':', 2)::BIGINT % 3 AS kind FROM w JOIN nodes n ON n.pid = w.root WHERE n.phase <> 'REMOVED')
SELECT place, id AS old_id, CASE WHEN name = '1-URGENT' THEN CASE kind WHEN 0 THEN 'IMAGE:n' || place || ':FIT' WHEN 1 THEN 'IMAGE:n' || place || ':FILL' ELSE 'SOLID::,IMAGE:n' || place || ':TILE,IMAGE:old:FILL' END
 ELSE CASE kind WHEN 0 THEN 'IMAGE:old:FIT' WHEN 1 THEN 'SOLID::,SOLID::' ELSE 'SOLID::,IMAGE:old:TILE,IMAGE:old:FILL' END END AS paints FROM t""", graph=True)
def template_pictures(spark, d: str) -> DataFrame:
    """Clones of layouts with new pictures for nodes of one name: in place of the first picture, filling as it did, or of all paints."""
    from sceneloom.functions.ranking import numbered

    def paint(kind: str, image: str | None = None, mode: str | None = None):
        return F.struct(F.lit(kind).alias("type"), F.lit(image).cast("string").alias("image"), F.lit(mode).cast("string").alias("mode"), F.lit(None).cast("double").alias("image_width"), F.lit(1.0).alias("opacity"))

    kind = S.parse_id(F.col("id"))["local"] % 3
    paints = F.when(kind == 0, F.array(paint("IMAGE", "old", "FIT"))).when(kind == 1, F.array(paint("SOLID"), paint("SOLID"))).otherwise(F.array(paint("SOLID"), paint("IMAGE", "old", "TILE"), paint("IMAGE", "old", "FILL")))
    n = nodes(spark, d).withColumn("fill_paints", paints)
    wanted = numbered(n.where("type = 'SLIDE'").select("ord", F.col("id").alias("root")), ["ord"], "place", 0).select("place", "root")
    images = wanted.select("place", F.lit("1-URGENT").alias("key"), F.concat(F.lit("n"), "place").alias("image"), F.lit(10).alias("image_width"), F.lit(20).alias("image_height"))
    out = template.pictured(template.clone_layouts(n, wanted, "2:0"), images).where("type = 'INSTANCE'")
    said = F.transform("fill_paints", lambda p: F.concat(p["type"], F.lit(":"), F.coalesce(p["image"], F.lit("")), F.lit(":"), F.coalesce(p["mode"], F.lit(""))))
    return out.select("place", "old_id", F.array_join(said, ",").alias("paints"))


# Sources of fonts ---------------------------------------------------------------------------------


@query("""WITH n AS (SELECT DISTINCT p_brand AS family, p_size % 3 * 100 + 400 AS weight FROM part WHERE p_brand <> (SELECT max(p_brand) FROM part)),
s AS (SELECT p_brand AS family, p_size % 3 * 100 + 400 AS weight, CASE p_partkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS rank, CASE p_partkey % 3 WHEN 0 THEN 'system' WHEN 1 THEN 'cache' ELSE 'web' END AS source FROM part WHERE p_retailprice > 1400)
SELECT n.family, n.weight, arg_min(source, rank) AS source FROM n LEFT JOIN s USING (family, weight) GROUP BY ALL""")
def font_sources(spark, d: str) -> DataFrame:
    """Cache before web before system, for each family and weight."""
    p = table(spark, d, "part")
    needed = p.select(F.col("p_brand").alias("family"), (F.col("p_size") % 3 * 100 + 400).alias("weight")).distinct()
    place = F.col("p_partkey") % 3
    have = p.where("p_retailprice > 1400").select(
        fonts.cache_key(F.col("p_brand"), F.col("p_size") % 3 * 100 + 400).alias("key"), F.when(place == 0, 3).when(place == 1, 1).otherwise(2).alias("rank"), F.when(place == 0, "system").when(place == 1, "cache").otherwise("web").alias("source")
    )
    return fonts.sources_of(needed, p.agg(F.max("p_brand").alias("family")), have)


@query("""WITH f AS (SELECT DISTINCT p_type AS family, 'v' || p_size % 4 AS file FROM part), w AS (SELECT family, count(*) FILTER (WHERE file IN ('v0', 'v1', 'v2')) = 3 AS whole FROM f GROUP BY 1)
SELECT family, file, NOT whole AS is_fallback FROM f JOIN w USING (family) WHERE CASE WHEN whole THEN file IN ('v0', 'v1', 'v2') ELSE file IN ('v3', 'v0') END""")
def fallback_fonts(spark, d: str) -> DataFrame:
    """Three files that count together, or else what there is of two others."""
    files = table(spark, d, "part").select(F.col("p_type").alias("family"), F.concat(F.lit("v"), F.col("p_size") % 4).alias("file"))
    return fonts.with_fallback(files, ["v0", "v1", "v2"], ["v3", "v0"])


# Look-ups -----------------------------------------------------------------------------------------


@query("SELECT id, name, 2::BIGINT AS number FROM nodes WHERE type = 'CANVAS' AND name <> 'Internal Only Canvas' ORDER BY position COLLATE NOCASE LIMIT 1 OFFSET 1", graph=True)
def second_page(spark, d: str) -> DataFrame:
    return decks.nth(catalog.pages(nodes(spark, d)), 2, "page").select("id", "name", "number")


@query("""WITH s AS (SELECT id, name, ord FROM nodes WHERE type = 'INSTANCE'), r AS (SELECT DISTINCT o_orderpriority AS ref FROM orders UNION SELECT '4:' || o_orderkey FROM orders WHERE o_orderstatus = 'F')
SELECT ref, coalesce((SELECT id FROM s WHERE id = ref), (SELECT arg_min(id, ord) FROM s WHERE name = ref)) AS id FROM r""", graph=True)
def removed_by_reference(spark, d: str) -> DataFrame:
    """Look-ups that count removed nodes too."""
    o = table(spark, d, "orders")
    refs = o.select(F.col("o_orderpriority").alias("ref")).unionByName(o.where("o_orderstatus = 'F'").select(F.concat(F.lit("4:"), F.col("o_orderkey")).alias("ref"))).distinct()
    return resolve.by_reference(nodes(spark, d), refs, "INSTANCE", removed_too=True)


@query("SELECT r.id AS row, r.name AS row_name, s.id AS slide, s.name FROM nodes s JOIN nodes r ON r.id = s.pid WHERE s.type = 'SLIDE'", graph=True)
def layouts_of_all_rows(spark, d: str) -> DataFrame:
    """Layouts of every live row, those of the internal canvas too."""
    return layouts.describe(nodes(spark, d), include_internal=True).select("row", "row_name", "slide", "name")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 0.25 WHEN c_custkey % 3 = 1 THEN 0.5 END::DOUBLE AS r, CASE WHEN c_custkey % 3 < 2 THEN 1 END::DOUBLE AS a FROM customer")
def slide_backgrounds(spark, d: str) -> DataFrame:
    """The first paint's colour, though it be hidden or no solid one; none where it has none."""
    kind, none = F.col("c_custkey") % 3, F.lit(None)
    paint = lambda type_, visible, r, a: F.struct(F.lit(type_).alias("type"), F.lit(visible).alias("visible"), *(v.cast("double").alias(c) for c, v in zip("rgba", (r, r, r, a))))
    paints = F.when(kind == 0, F.array(paint("SOLID", False, F.lit(0.25), F.lit(1)), paint("SOLID", True, F.lit(1), F.lit(1)))).when(kind == 1, F.array(paint("NOISE", True, F.lit(0.5), F.lit(1)))).otherwise(F.array(paint("IMAGE", True, none, none), paint("SOLID", True, F.lit(1), F.lit(1))))
    return catalog.backgrounds(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), paints.alias("fill_paints"))).select("id", "r", "a")


# Pictures, frames and unions ----------------------------------------------------------------------


@query("""WITH p AS (SELECT p_partkey AS id, p_partkey % 4 AS kind, p_size + 1 AS w, '<clipPath id="img-clip-' || p_partkey || '-1"><rect width="' || (p_size + 1) || '" height="20" rx="0" ry="0"/></clipPath>' AS clip, 'data:image/' || CASE WHEN p_partkey % 8 < 4 THEN 'png;base64,iVBO' ELSE 'jpeg;base64,/9j/' END AS uri FROM part),
s AS (SELECT *, '<image href="' || uri || '" x="0" y="0" width="' || w || '" height="20" preserveAspectRatio="xMidYMid ' AS whole, '<rect x="0" y="0" width="' || w || '" height="20" rx="0" ry="0" fill=' AS rect, '" clip-path="url(#img-clip-' || id || '-1)"' AS clipped,
 '<clipPath id="frame-clip-' || id || '"><rect width="' || w || '" height="20" rx="0" ry="0"/></clipPath>' AS frame FROM p)
SELECT id, '<g transform="translate(0,0)">' || chr(10) || CASE kind
 WHEN 0 THEN '<defs>' || clip || '</defs>' || chr(10) || whole || 'slice' || clipped || '/>' || chr(10) || rect || '"rgba(255,0,0,1.0000)"/>' || chr(10) || 'child'
 WHEN 1 THEN '<defs>' || clip || '</defs>' || frame || chr(10) || whole || 'meet' || clipped || ' opacity="0.5"/>' || chr(10) || '<g clip-path="url(#frame-clip-' || id || ')">child</g>'
 WHEN 2 THEN '<defs>' || clip || '<pattern id="img-pat-' || id || '-1" x="0" y="0" width="15" height="5" patternUnits="userSpaceOnUse"><image href="' || uri || '" width="15" height="5"/></pattern></defs>' || chr(10) || rect || '"url(#img-pat-' || id || '-1)"' || ltrim(clipped, '"') || '/>' || chr(10) || 'child'
 ELSE 'child' END || chr(10) || '</g>' AS text FROM s""")
def painted_frames(spark, d: str) -> DataFrame:
    """Frames with pictures that fill, fit and tile, stacked and faint, and that clip what is inside where they are told to and have a visible paint."""
    kind, none = F.col("p_partkey") % 4, F.lit(None)

    def paint(type_: str, mode=None, opacity=None, visible=None, r=None):
        fields = {"type": F.lit(type_), "visible": F.lit(visible).cast("boolean"), "opacity": F.lit(opacity).cast("double"), **{c: F.lit(r if c == "r" else None if r is None or c == "a" else 0.0).cast("double") for c in "rgba"}, "image": F.lit("h" if type_ == "IMAGE" else None).cast("string"),
                  "mode": F.lit(mode).cast("string"), "image_width": F.lit(30.0), "image_height": F.lit(10.0), "scale": F.lit(0.5)}
        return F.struct(*(v.alias(k) for k, v in fields.items()))

    paints = F.when(kind == 0, F.array(paint("IMAGE"), paint("SOLID", r=1.0))).when(kind == 1, F.array(paint("IMAGE", "FIT", 0.5))).when(kind == 2, F.array(paint("IMAGE", "TILE"))).otherwise(F.array(paint("IMAGE", visible=False)))
    content = F.unhex(F.when(F.col("p_partkey") % 8 < 4, "89504E").otherwise("FFD8FF"))
    at = F.struct(*(F.lit(1.0 if k in ("m00", "m11") else 0.0).alias(k) for k in fills.MATRIX))
    rows = _shape_rows(spark, d, "FRAME", fill_paints=paints, width=(F.col("p_size") + 1).cast("double"), transform=at, inner=F.lit("child"), mask_disabled=F.when(kind != 2, F.lit(False)).otherwise(none.cast("boolean")), image_uris=F.create_map(F.lit("h"), fills.data_uri(content)))
    # a first kind without a mask stays open
    rows = rows.withColumn("mask_disabled", F.when(F.col("id") % 4 == 0, F.lit(True)).otherwise(F.col("mask_disabled")))
    return svg.fragments(rows).select("id", "text")


@query("""SELECT l_orderkey || ':' || l_linenumber AS id, max(CASE WHEN o_orderkey % 3 = 0 THEN 'rgba(255,0,0,1.0000)' WHEN o_orderkey % 3 = 1 AND o_custkey % 2 = 0 THEN 'rgba(0,0,255,1.0000)' ELSE 'own' END) AS colour FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""")
def union_colours(spark, d: str) -> DataFrame:
    """Shapes in unions have the union's colour, or that of the union around it; others their own."""
    o, none = table(spark, d, "orders"), F.lit(None)
    red, blue = ({"type": "SOLID", "r": r, "g": 0.0, "b": b, "a": 1.0, "opacity": 1.0, "visible": True} for r, b in ((1.0, 0.0), (0.0, 1.0)))
    paint = lambda p: F.array(F.struct(*(F.lit(p[c]).alias(c) for c in ("type", "visible", "opacity", "r", "g", "b", "a"))))
    kind = F.col("o_orderkey") % 3
    key = F.col("o_orderkey").cast("string")
    outer = o.select(F.concat(F.lit("c"), F.col("o_custkey")).alias("id"), F.lit(None).cast("string").alias("pid"), F.lit("BOOLEAN_OPERATION").alias("type"), F.when(F.col("o_custkey") % 2 == 0, "UNION").otherwise("SUBTRACT").alias("boolean_operation"), paint(blue).alias("fill_paints")).distinct()
    inner = o.select(F.concat(F.lit("o"), key).alias("id"), F.when(kind == 1, F.concat(F.lit("c"), F.col("o_custkey"))).alias("pid"), F.lit("BOOLEAN_OPERATION").alias("type"), F.when(kind == 2, "INTERSECT").otherwise("UNION").alias("boolean_operation"), F.when(kind == 0, paint(red)).alias("fill_paints"))
    leaf = table(spark, d, "lineitem").select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("id"), F.concat(F.lit("o"), F.col("l_orderkey")).alias("pid"), F.lit("ELLIPSE").alias("type"), none.cast("string").alias("boolean_operation")).distinct()
    leaf = leaf.withColumn("fill_paints", none.cast(outer.schema["fill_paints"].dataType))
    out = vectors.union_fills(outer.unionByName(inner).unionByName(leaf)).where("type = 'ELLIPSE'")
    return out.select("id", F.coalesce(svg.solid(F.col("fill_paints")), F.lit("own")).alias("colour"))

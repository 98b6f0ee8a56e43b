"""Shapes on slides as rows: colours and text styles by name, new shapes in bulk, and setters.

A table of asks has one row for each shape: k (order of creation), parent (id of a slide or frame), kind,
and the columns of ASK that the kind needs; those that a table lacks count as null. All ids of one call
are dealt at once, in order of k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sceneloom.functions.ranking import numbered, summed_before
from sceneloom.functions.scalars import blank_as_space, guid_id, line_vector, position_char

from .markup import PAINT
from .template import next_local

#: Colours by name, for names that the document's own variables do not have.
COLOURS = {
    "white": "FFFFFF", "black": "000000", "cream": "F5F0E8", "ivory": "FFFFF0", "charcoal": "36454F", "smoke": "F5F5F5",
    "silver": "C0C0C0", "ash": "B2BEB5", "navy": "1E2761", "midnight": "0D1B2A", "cobalt": "0047AB", "sky": "87CEEB",
    "teal": "008080", "cyan": "00BCD4", "steel": "4682B4", "denim": "1560BD", "forest": "2C5F2D", "sage": "A7BEAE",
    "mint": "98FF98", "olive": "808000", "emerald": "50C878", "moss": "8A9A5B", "lime": "32CD32", "coral": "F96167",
    "crimson": "DC143C", "rose": "FF007F", "blush": "FFB6C1", "burgundy": "800020", "brick": "CB4154", "salmon": "FA8072",
    "terracotta": "B85042", "rust": "B7410E", "sand": "E7E8D1", "amber": "FFBF00", "gold": "FFD700", "saffron": "F4C430",
    "peach": "FFCBA4", "lavender": "E6E6FA", "violet": "8B00FF", "plum": "DDA0DD", "mauve": "E0B0FF", "indigo": "4B0082",
    "grape": "6F2DA8", "purple": "800080",
}
#: The id of a style that is none, the session of new nodes, and what shapes are called by kind.
DETACHED, SESSION = "4294967295:4294967295", 1
NAMES = {"RECTANGLE": "Rectangle", "IMAGE": "Image", "TEXT": "Text", "LINE": "Line", "FRAME": "Frame"}
TYPES = {"RECTANGLE": "ROUNDED_RECTANGLE", "IMAGE": "ROUNDED_RECTANGLE", "TEXT": "TEXT", "LINE": "LINE", "FRAME": "FRAME"}
SHAPE_KINDS = ("ELLIPSE", "DIAMOND", "TRIANGLE_UP", "STAR")

FILL = PAINT[:-1] + ",image:string,thumbnail:string,mode:string,image_width:double,image_height:double,scale:double,colour_var:string>"
TRANSFORM = "struct<m00:double,m01:double,m02:double,m10:double,m11:double,m12:double>"
ASK = {
    "name": "string", "x": "double", "y": "double", "width": "double", "height": "double", "x2": "double", "y2": "double", "colour": "string",
    "opacity": "double", "radius": "double", "weight": "double", "text": "string", "style": "string", "font": "string", "font_style": "string",
    "font_size": "double", "align": "string", "image": "string", "thumbnail": "string", "image_width": "double", "image_height": "double",
    "mode": "string", "direction": "string", "spacing": "double",
}
#: Columns of a new shape.
SHAPE = {
    "id": "string", "pid": "string", "position": "string", "type": "string", "name": "string", "phase": "string", "visible": "boolean", "opacity": "double",
    "width": "double", "height": "double", "radius": "double", "transform": TRANSFORM, "fill_paints": f"array<{FILL}>", "stroke_paints": f"array<{FILL}>",
    "stroke_weight": "double", "stroke_align": "string", "mask_disabled": "boolean", "text": "string", "font_family": "string", "font_style": "string",
    "font_size": "double", "line_height": "double", "line_height_units": "string", "text_style": "string", "align": "string", "auto_resize": "string",
    "shape_kind": "string", "shape_paints": f"array<{FILL}>", "text_paints": f"array<{FILL}>", "stack_mode": "string", "stack_spacing": "double",
}


def hex_colour(text: Column) -> Column:
    """(r, g, b) in 0 .. 1 of six hexadecimal digits, with a # or without; null for anything else."""
    digits = F.regexp_extract(text, "^#?([0-9a-fA-F]{6})$", 1)
    part = lambda k: F.conv(F.substring(digits, k, 2), 16, 10).cast("double") / 255
    return F.when(digits != "", F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b")))


#: Tasks over which the asks of one colour are spread.
SHARES = 64


def resolve_colours(asks: DataFrame, variables: DataFrame, colour: str = "colour") -> DataFrame:
    """asks with r, g, b and colour_var: what the text in `colour` means.

    Null or empty is black. Then come hexadecimal digits, a colour variable of exactly that name (variables: id,
    ord, name, r, g, b; the first of a name counts, if it has a value; its id is colour_var), and a name in
    COLOURS, whatever its case. Anything else is an error.
    """
    first = variables.groupBy(F.col("name").alias("_name")).agg(F.min_by(F.struct("id", "r", "g", "b"), "ord").alias("_var"))
    known = F.create_map(*(F.lit(x) for pair in COLOURS.items() for x in pair))
    alias = hex_colour(F.try_element_at(known, F.lower(colour)))
    named = F.when(F.col("_var.r").isNotNull(), F.struct("_var.r", "_var.g", "_var.b"))
    black = F.when(F.coalesce(F.col(colour), F.lit("")) == "", F.struct(*(F.lit(0.0).alias(c) for c in "rgb")))
    unknown = F.raise_error(F.concat(F.lit("unknown colour: "), F.col(colour))).cast("struct<r:double,g:double,b:double>")
    by_hex = hex_colour(F.col(colour))
    # most asks may have one colour: each colour is met in so many shares
    salt = F.pmod(F.xxhash64(*(c for c, t in asks.dtypes if "map<" not in t)), F.lit(SHARES))
    first = first.withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long"))))
    joined = asks.join(first, (F.col(colour) == F.col("_name")) & (salt == F.col("_share")), "left").drop("_share")
    out = joined.withColumn("_rgb", F.coalesce(black, by_hex, named, alias, unknown))
    bound = F.when(by_hex.isNull() & F.col("_var.r").isNotNull(), F.col("_var.id"))
    return out.withColumns({**{c: F.col(f"_rgb.{c}") for c in "rgb"}, "colour_var": bound}).drop("_name", "_var", "_rgb")


def text_styles(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """(style, id, font_family, font_style, font_size, line_height, line_height_units) of each name in names (column style).

    A text node that may be published comes first, else a locked and hidden one; of several, the first by ord.
    A name without either is an error.
    """
    texts = nodes.where("type = 'TEXT'")
    rank = F.when(F.coalesce("is_publishable", F.lit(False)), 0).when(F.coalesce("locked", F.lit(False)) & F.col("visible").eqNullSafe(False), 1)
    columns = ["id", "font_family", "font_style", "font_size", "line_height", "line_height_units"]
    found = texts.withColumn("_rank", rank).where("_rank is not null").groupBy(F.col("name").alias("style"))
    found = found.agg(F.min_by(F.struct(*columns), F.struct("_rank", "ord")).alias("_x"))
    out = names.select("style").where("style is not null").distinct().join(found, "style", "left")
    lost = F.raise_error(F.concat(F.lit("unknown text style: "), F.col("style"))).cast(found.schema["_x"].dataType)
    return out.withColumn("_x", F.coalesce("_x", lost)).select("style", "_x.*")


def paint(r: Column, g: Column, b: Column, opacity: Column | None = None, colour_var: Column | None = None) -> Column:
    """A visible solid paint with the fields of FILL."""
    none = F.lit(None)
    fields = {
        "type": F.lit("SOLID"), "visible": F.lit(True), "opacity": F.lit(1.0) if opacity is None else F.coalesce(opacity, F.lit(1.0)),
        "r": r, "g": g, "b": b, "a": F.lit(1.0), **dict.fromkeys(("image", "thumbnail", "mode", "image_width", "image_height", "scale"), none),
        "colour_var": none if colour_var is None else colour_var,
    }
    return F.struct(*(v.alias(k) for k, v in fields.items())).cast(FILL)


def picture(mode: Column) -> Column:
    """The paint of a picture, from the columns image, thumbnail, image_width and image_height."""
    fields = dict.fromkeys(("r", "g", "b", "a", "colour_var"), F.lit(None))
    fields |= {"type": F.lit("IMAGE"), "visible": F.lit(True), "opacity": F.lit(1.0), "mode": F.coalesce(mode, F.lit("FILL")), "scale": F.lit(0.5)}
    fields |= {c: F.col(c) for c in ("image", "thumbnail", "image_width", "image_height")}
    order = [f.split(":")[0] for f in FILL[7:-1].split(",")]
    return F.struct(*(fields[c].alias(c) for c in order)).cast(FILL)


def placed(x: Column, y: Column) -> Column:
    """The matrix of a shift."""
    return turned(F.lit(1.0), F.lit(0.0), x, y)


def turned(cos: Column, sin: Column, x: Column, y: Column) -> Column:
    """The matrix of a turn and a shift."""
    parts = {"m00": cos, "m01": -sin, "m02": x, "m10": sin, "m11": cos, "m12": y}
    return F.struct(*(v.cast("double").alias(k) for k, v in parts.items()))


def add_shapes(nodes: DataFrame, asks: DataFrame, variables: DataFrame | None = None) -> DataFrame:
    """New nodes (columns of SHAPE, with ord and k) for asks; nodes has id, pid, type and ord at least.

    Kinds: RECTANGLE, IMAGE, TEXT, LINE (to x2, y2), FRAME, and ELLIPSE, DIAMOND, TRIANGLE_UP and STAR, which
    hold a text. Ids go on from the largest, positions from the parent's children. Texts in a frame
    stand at 0, 0: it lays them out. A text has its named style, unless it names a font, or a size and no style.
    """
    asks = asks.withColumns({c: F.lit(None).cast(t) for c, t in ASK.items() if c not in asks.columns})
    if variables is None:
        variables = asks.sparkSession.createDataFrame([], "id string, ord bigint, name string, r double, g double, b double")
    is_text, is_line = F.col("kind") == "TEXT", F.col("kind") == "LINE"
    default = F.when(is_text | is_line, "black").otherwise("White")
    rows = resolve_colours(asks.withColumn("colour", F.coalesce(F.col("colour"), default)), variables)
    rows = _with_style(rows, nodes)
    parents = nodes.select(F.col("id").alias("parent"), F.col("type").alias("_parent_type"))
    children = nodes.groupBy(F.col("pid").alias("parent")).agg(F.count(F.lit(1)).alias("_children"))
    rows = rows.join(parents, "parent", "left").join(children, "parent", "left")
    place = F.coalesce("_children", F.lit(0)) + F.row_number().over(Window.partitionBy("parent").orderBy("k")) - 1
    rows = numbered(rows.withColumn("_place", place), ["k"], "_local", next_local(nodes))
    last = nodes.agg(F.coalesce(F.max("ord"), F.lit(0))).first()[0]
    made = _shape_columns()
    return rows.select("k", (F.col("_local") + F.lit(last)).alias("ord"), *(made[c].cast(t).alias(c) for c, t in SHAPE.items()))


def _with_style(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """rows with the columns of their named style as _style; null where a row is detached from styles."""
    columns = ("is_publishable", "locked", "font_family", "font_style", "font_size", "line_height", "line_height_units")
    if not set(columns) <= set(nodes.columns):
        kinds = dict(zip(columns, ("boolean", "boolean", "string", "string", "double", "double", "string")))
        nodes = nodes.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items() if c not in nodes.columns})
    if "visible" not in nodes.columns:
        nodes = nodes.withColumn("visible", F.lit(None).cast("boolean"))
    named = rows.where("kind = 'TEXT' and coalesce(style, '') <> ''").select("style")
    styles = text_styles(nodes, named)
    found = styles.select(F.col("style").alias("_name"), F.struct(*(c for c in styles.columns if c != "style")).alias("_style"))
    attached = (F.col("kind") == "TEXT") & (F.coalesce("font", F.lit("")) == "")
    return rows.join(found, attached & (F.col("style") == F.col("_name")), "left").drop("_name")


def _shape_columns() -> dict[str, Column]:
    kind = F.col("kind")
    rectangle, text, line, frame, image = (kind == k for k in ("RECTANGLE", "TEXT", "LINE", "FRAME", "IMAGE"))
    shape = kind.isin(*SHAPE_KINDS)
    solid = paint(F.col("r"), F.col("g"), F.col("b"))
    at = lambda c, d: F.coalesce(F.col(c), F.lit(float(d)))
    x, y, x2, y2 = (at(c, 0) for c in ("x", "y", "x2", "y2"))
    way = line_vector(x, y, x2, y2)
    in_frame = F.col("_parent_type") == "FRAME"
    named = F.create_map(*(F.lit(v) for pair in NAMES.items() for v in pair))
    types = F.create_map(*(F.lit(v) for pair in TYPES.items() for v in pair))
    style = lambda own, c, d: F.when(text, F.when(F.col("_style").isNotNull(), F.col(f"_style.{c}")).otherwise(F.coalesce(F.col(own), F.lit(d)) if own else F.lit(d)))
    text_at = F.when(in_frame, placed(F.lit(0.0), F.lit(0.0))).otherwise(placed(at("x", 128), at("y", 128)))
    boxed = rectangle | image
    return {
        "id": guid_id(F.lit(SESSION), F.col("_local")), "pid": F.col("parent"), "position": position_char(F.col("_place")),
        "type": F.coalesce(types[kind], F.lit("SHAPE_WITH_TEXT")), "name": F.coalesce("name", named[kind], F.lit("Shape")), "phase": F.lit("CREATED"),
        "visible": F.lit(True), "opacity": F.when(rectangle | shape, at("opacity", 1)).otherwise(1.0),
        "width": F.when(line, way["length"]).when(text, at("width", 1200)).when(image, at("width", 1920)).otherwise(F.col("width")),
        "height": F.when(line, F.lit(0.0)).when(text, at("height", 50)).when(image, at("height", 1080)).otherwise(F.col("height")),
        "radius": F.when(boxed, F.nullif("radius", F.lit(0.0))),
        "transform": F.when(line, turned(way["cos"], way["sin"], x, y)).when(text, text_at).otherwise(placed(x, y)),
        "fill_paints": F.when(image, F.array(picture(F.col("mode")))).when(rectangle | text, F.array(solid)),
        "stroke_paints": F.when(line, F.array(solid)),
        "stroke_weight": F.when(line, at("weight", 2)).when(boxed, F.lit(1.0)).when(text, F.lit(0.0)),
        "stroke_align": F.when(line, "CENTER").when(boxed, "INSIDE").when(text, "OUTSIDE"), "mask_disabled": F.when(frame | shape, F.lit(True)),
        "text": F.when(text, blank_as_space(F.col("text"))),
        "font_family": style("font", "font_family", "Inter"), "font_style": style("font_style", "font_style", "Regular"),
        "font_size": F.when(text, F.coalesce("font_size", "_style.font_size", F.lit(36.0))),
        "line_height": style(None, "line_height", 1.4), "line_height_units": style(None, "line_height_units", "RAW"),
        "text_style": F.when(text, F.coalesce("_style.id", F.lit(DETACHED))), "align": F.when(text, F.coalesce("align", F.lit("LEFT"))),
        "auto_resize": F.when(text, "HEIGHT"), "shape_kind": F.when(shape, kind), "shape_paints": F.when(shape, F.array(solid)),
        "text_paints": F.when(shape, F.array(paint(F.lit(0.0), F.lit(0.0), F.lit(0.0)))),
        "stack_mode": F.when(frame, F.coalesce("direction", F.lit("VERTICAL"))), "stack_spacing": F.when(frame, at("spacing", 24)),
    }


def add_tables(nodes: DataFrame, tables: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, cells) of new tables.

    tables: k, parent, x, y, and maybe column_width, row_height, radius, name. cells: k, row, col (from 0), text; a
    table has as many rows and columns as its cells say, and one without cells is an error. A new cell has its
    table's id, the ids of its row and column (path) and a text, a space where there is none. Ids: the table, its rows, its columns.
    """
    kinds = {"column_width": "double", "row_height": "double", "radius": "double", "name": "string"}
    tables = tables.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items() if c not in tables.columns})
    size = cells.groupBy("k").agg((F.max("row") + 1).cast("long").alias("n_rows"), (F.max("col") + 1).cast("long").alias("n_cols"))
    rows = tables.join(size, "k", "left")
    bare = F.raise_error("a table needs at least one cell").cast("long")
    rows = rows.withColumn("n_rows", F.coalesce("n_rows", bare))
    rows = numbered(rows, ["k"], "_n", 0)
    rows = summed_before(rows.withColumn("_ids", F.col("n_rows") + F.col("n_cols") + 1), ["k"], "_ids", "_used")
    rows = rows.withColumn("_local", F.col("_used") + F.lit(next_local(nodes)))
    children = nodes.groupBy(F.col("pid").alias("parent")).agg(F.count(F.lit(1)).alias("_children"))
    place = F.coalesce("_children", F.lit(0)) + F.row_number().over(Window.partitionBy("parent").orderBy("k")) - 1
    last = nodes.agg(F.coalesce(F.max("ord"), F.lit(0))).first()[0]
    rows = rows.join(children, "parent", "left").withColumn("_place", place)
    white = F.array(paint(*(F.lit(1.0) for _ in "rgb")))
    made = {
        "id": guid_id(F.lit(SESSION), F.col("_local")), "pid": F.col("parent"), "position": position_char(F.col("_place")), "type": F.lit("TABLE"),
        "name": F.coalesce("name", F.lit("Table")), "phase": F.lit("CREATED"), "visible": F.lit(True), "opacity": F.lit(1.0),
        "width": F.coalesce("column_width", F.lit(192.0)) * F.col("n_cols"), "height": F.coalesce("row_height", F.lit(44.0)) * F.col("n_rows"),
        "radius": F.coalesce("radius", F.lit(12.0)), "transform": placed(F.col("x"), F.col("y")), "fill_paints": white, "stroke_weight": F.lit(1.0),
        "stroke_align": F.lit("INSIDE"), "mask_disabled": F.lit(True),
    }
    shapes = rows.select("k", (F.col("_n") + F.lit(last) + 1).alias("ord"), *(made.get(c, F.lit(None)).cast(t).alias(c) for c, t in SHAPE.items()))
    ids = rows.select("k", "_local", "n_rows")
    row_id, col_id = F.col("_local") + 1 + F.col("row"), F.col("_local") + 1 + F.col("n_rows") + F.col("col")
    path = F.array(*(guid_id(F.lit(SESSION), c) for c in (row_id, col_id)))
    filled = cells.join(ids, "k").select(guid_id(F.lit(SESSION), F.col("_local")).alias("table"), "row", "col", path.alias("path"), blank_as_space(F.col("text")).alias("text"))
    return shapes, filled


# Setters -------------------------------------------------------------------------------------------


def _changed(nodes: DataFrame, changes: DataFrame, new: dict[str, Column]) -> DataFrame:
    """nodes in which the columns of new are set where changes (id, and columns by the name _of_...) has the id."""
    out = nodes.join(changes, nodes["id"] == F.col("_of"), "left")
    hit = F.col("_of").isNotNull()
    return out.select(*(F.when(hit, new[c]).otherwise(F.col(c)).cast(t).alias(c) if c in new else F.col(c) for c, t in nodes.dtypes))


def set_fill(nodes: DataFrame, changes: DataFrame, variables: DataFrame, bind: bool = False) -> DataFrame:
    """nodes with the solid fills of changes (id, colour, opacity; colour "none" takes fills away).

    In shapes that hold a text the shape's own paints change. bind: a variable's name stays bound to it, as in backgrounds.
    """
    none = F.col("colour") == "none"
    asked = resolve_colours(changes.withColumn("_none", none).withColumn("colour", F.when(~none, F.col("colour"))), variables)
    asked = asked.select(F.col("id").alias("_of"), "_none", F.struct("r", "g", "b", F.col("opacity").alias("o"), F.col("colour_var").alias("v")).alias("_c"))
    fill = paint(F.col("_c.r"), F.col("_c.g"), F.col("_c.b"), F.col("_c.o"), F.col("_c.v") if bind else None)
    new = F.when(F.col("_none"), F.array().cast(f"array<{FILL}>")).otherwise(F.array(fill))
    inner = (F.col("type") == "SHAPE_WITH_TEXT") & F.col("shape_paints").isNotNull()
    keep = lambda c, on: F.when(on, new).otherwise(F.col(c))
    return _changed(nodes, asked, {"fill_paints": keep("fill_paints", ~F.coalesce(inner, F.lit(False))), "shape_paints": keep("shape_paints", inner)})


def set_background(nodes: DataFrame, changes: DataFrame, variables: DataFrame) -> DataFrame:
    """nodes with the backgrounds of changes (id of a slide, colour, opacity); a colour by a variable's name stays bound to it."""
    return set_fill(nodes, changes, variables, bind=True)


def set_stroke(nodes: DataFrame, changes: DataFrame, variables: DataFrame) -> DataFrame:
    """nodes with the strokes of changes (id, colour, weight, align); weight 2 and INSIDE unless given; colour "none" takes it away."""
    none = F.col("colour") == "none"
    asked = resolve_colours(changes.withColumn("_none", none).withColumn("colour", F.when(~none, F.col("colour"))), variables)
    asked = asked.select(F.col("id").alias("_of"), "_none", F.struct("r", "g", "b", "weight", "align").alias("_c"))
    empty, line = F.array().cast(f"array<{FILL}>"), F.array(paint(F.col("_c.r"), F.col("_c.g"), F.col("_c.b")))
    return _changed(nodes, asked, {
        "stroke_paints": F.when(F.col("_none"), empty).otherwise(line),
        "stroke_weight": F.when(F.col("_none"), 0.0).otherwise(F.coalesce("_c.weight", F.lit(2.0))),
        "stroke_align": F.when(F.col("_none"), F.col("stroke_align")).otherwise(F.coalesce("_c.align", F.lit("INSIDE"))),
    })


def set_image_fill(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """nodes whose fill is the picture of changes (id, image, thumbnail, image_width, image_height, mode)."""
    asked = changes.select(F.col("id").alias("_of"), picture(F.col("mode")).alias("_p"))
    inner = F.coalesce((F.col("type") == "SHAPE_WITH_TEXT") & F.col("shape_paints").isNotNull(), F.lit(False))
    new = F.array("_p")
    return _changed(nodes, asked, {"fill_paints": F.when(inner, F.col("fill_paints")).otherwise(new), "shape_paints": F.when(inner, new).otherwise(F.col("shape_paints"))})


def set_rotation(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """nodes turned to the degrees of changes (id, degrees): the matrix is a plain turn afterwards, its shift stays; without a matrix, nothing."""
    angle = F.radians("_degrees")
    t = F.col("transform")
    new = F.when(t.isNotNull(), turned(F.cos(angle), F.sin(angle), t["m02"], t["m12"]))
    return _changed(nodes, changes.select(F.col("id").alias("_of"), F.col("degrees").alias("_degrees")), {"transform": new})


def set_geometry(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """nodes with what changes (id, x, y, width, height, visible, opacity) gives; nulls leave a value. A place needs a matrix, a size a size."""
    asked = changes.select(F.col("id").alias("_of"), F.struct("x", "y", "width", "height", "visible", "opacity").alias("_g"))
    t, given = F.col("transform"), lambda c: F.coalesce(f"_g.{c}", c)
    moved = t.withField("m02", F.coalesce("_g.x", t["m02"])).withField("m12", F.coalesce("_g.y", t["m12"]))
    sized = {c: F.when(F.col(c).isNotNull(), given(c)) for c in ("width", "height")}
    return _changed(nodes, asked, {"transform": F.when(t.isNotNull(), moved), **sized, "visible": given("visible"), "opacity": given("opacity")})


def geometry(nodes: DataFrame) -> DataFrame:
    """(id, x, y, width, height, visible, opacity) with what counts where a node has no value."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return nodes.select(
        "id", zero("transform.m02").alias("x"), zero("transform.m12").alias("y"), zero("width").alias("width"), zero("height").alias("height"),
        F.coalesce("visible", F.lit(True)).alias("visible"), F.coalesce("opacity", F.lit(1.0)).alias("opacity"),
    )


def colours(nodes: DataFrame) -> DataFrame:
    """(id, fill, stroke, weight): colour of the first fill paint (in shapes that hold a text, of the shape's own) and of the first stroke paint, null where it has none."""
    rgb = lambda p: F.when(p["r"].isNotNull(), F.struct(*(p[c].alias(c) for c in "rgba")))
    first = lambda c: F.get(F.col(c), F.lit(0))
    inner = (F.col("type") == "SHAPE_WITH_TEXT") & F.col("shape_paints").isNotNull()
    stroke = rgb(first("stroke_paints"))
    weight = F.when(stroke.isNotNull(), F.coalesce("stroke_weight", F.lit(0.0)))
    return nodes.select("id", F.when(inner, rgb(first("shape_paints"))).otherwise(rgb(first("fill_paints"))).alias("fill"), stroke.alias("stroke"), weight.alias("weight"))

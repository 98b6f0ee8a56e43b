"""Overrides of instances as rows: reading, setting and listing what they change inside a symbol.

An override row has inst_id, ov_ix (its place in the instance's list), path (array of keys), and what it
changes: text, image (hash of the full picture), or both null. Nodes have fill_paints, an array of
structs with at least type and image.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sceneloom.functions.scalars import blank_as_space, is_key
from sceneloom.functions.tables import spread

from .resolve import slide_symbols
from .tree import is_live, walk

#: Types that can be picture slots, and how a picture fills its slot by default.
PICTURE_TYPES, SCALE_MODE = ("ROUNDED_RECTANGLE", "RECTANGLE"), "FILL"


def has_image(paints: str = "fill_paints") -> Column:
    """Some paint is an image."""
    return F.coalesce(F.exists(paints, lambda p: p["type"] == "IMAGE"), F.lit(False))


def first_image(paints: str = "fill_paints") -> Column:
    """Hash of the first paint, if that is a picture's."""
    return F.get(F.col(paints), F.lit(0))["image"]


def image_paint(image: Column, thumbnail: Column, width: Column, height: Column, mode: Column | None = None) -> Column:
    """The paint that shows a picture; mode is how it fills, FILL unless given."""
    scale_mode = F.lit(SCALE_MODE) if mode is None else F.coalesce(mode, F.lit(SCALE_MODE))
    fields = {
        "type": F.lit("IMAGE"), "visible": F.lit(True), "opacity": F.lit(1.0), "image": image, "thumbnail": thumbnail,
        "mode": scale_mode, "image_width": width, "image_height": height, "scale": F.lit(0.5),
    }
    return F.struct(*(v.alias(k) for k, v in fields.items()))


def set_overrides(overrides: DataFrame, changes: DataFrame, what: str, exact: bool = True, append: bool = False) -> DataFrame:
    """overrides with changes (inst_id, key, and `what`: text or image), each in one place.

    The first override of the key that has such a value is replaced, or one is appended. exact: only a path
    of that one key counts, else its first key does. append: always append. Empty texts become a space.
    Changes have one row for each inst_id and key.
    """
    value = blank_as_space(F.col("text")) if what == "text" else F.col(what)
    types, columns = dict(overrides.dtypes), overrides.columns
    fits = F.col(what).isNotNull() & (F.size("path") == 1 if exact else F.size("path") >= 1)
    old = overrides.select(*columns, F.when(fits, F.col("path")[0]).alias("_k"), F.lit(None).cast(types[what]).alias("_v"), F.lit(0).alias("_new"))
    none = {"inst_id": F.col("inst_id"), "_k": F.col("key"), "_v": value, "_new": F.lit(1)}
    new = changes.select(*(none.get(c, F.lit(None)).cast(t).alias(c) for c, t in old.dtypes))
    # one shuffle brings an instance's overrides and changes together; a task has about so many rows whatever the size
    rows = spread(old.unionByName(new), "inst_id")
    of_key, named = Window.partitionBy("inst_id", "_k"), F.col("_k").isNotNull() & F.col("inst_id").isNotNull() & F.lit(not append)
    rows = rows.select(
        "*", F.row_number().over(of_key.orderBy("_new", "ov_ix")).alias("_n"), F.max("_new").over(of_key).alias("_asked"), F.max("_v").over(of_key).alias("_to"),
        F.when(F.col("inst_id").isNotNull(), F.max("ov_ix").over(Window.partitionBy("inst_id"))).alias("_last"))
    # a change whose key has an override is not the first of its key: it went into that
    rows = rows.where(~((F.col("_new") == 1) & (F.col("_n") > 1) & named))
    hit = (F.col("_new") == 0) & (F.col("_n") == 1) & (F.col("_asked") == 1) & named
    rows = rows.withColumn("_hit", hit).withColumn("_v", F.when(F.col("_new") == 1, F.col("_v")).otherwise(F.col("_to")))
    place = F.coalesce("_last", F.lit(0)) + F.row_number().over(Window.partitionBy("inst_id", "_new").orderBy("_k"))
    made = {"inst_id": F.col("inst_id"), "ov_ix": place, "path": F.array("_k"), what: F.col("_v")}
    return rows.select(*(F.when(F.col("_new") == 1, made.get(c, F.lit(None))).otherwise(_replaced(c, what, exact)).cast(types[c]).alias(c) for c in columns))


def _replaced(column: str, what: str, exact: bool) -> Column:
    """A column of an override row where `_hit` marks it as replaced: a text set by exact key stays in its row, all else is a new row."""
    if column == what:
        return F.when(F.col("_hit"), F.col("_v")).otherwise(F.col(column)).alias(column)
    if column in ("inst_id", "ov_ix") or (what == "text" and exact):
        return F.col(column)
    value = F.array("_k") if column == "path" else F.lit(None)
    return F.when(F.col("_hit"), value).otherwise(F.col(column)).alias(column)


def image_nodes(nodes: DataFrame, overrides: DataFrame) -> DataFrame:
    """(slide, override_key, name, image): picture slots inside the symbol of each slide's first instance, with the picture they show.

    That is the first image override of the slot's key (by first key of its path), else the slot's own
    first paint; null if that is no picture.
    """
    links = slide_symbols(nodes).where("instance is not null").select("slide", "instance", F.col("symbol_id").alias("symbol"))
    slots = symbol_slots(nodes).where("kind = 'image'")
    over = overrides.where("image is not null and size(path) >= 1")
    over = over.groupBy(F.col("inst_id").alias("instance"), F.col("path")[0].alias("key")).agg(F.min_by("image", "ov_ix").alias("over"))
    rows = links.join(slots, "symbol").join(over, ["instance", "key"], "left")
    return rows.select("slide", F.col("key").alias("override_key"), "name", F.coalesce("over", "own").alias("image"))


def symbol_slots(nodes: DataFrame) -> DataFrame:
    """(symbol, kind, id, name, key, own, path): text and picture slots below every symbol, removed ones included, in preorder of path."""
    symbols = nodes.where("type = 'SYMBOL'").select("id")
    below = walk(nodes, symbols).select(F.col("root").alias("symbol"), "id", "path")
    picture = F.col("type").isin(*PICTURE_TYPES) & has_image()
    kind = F.when(F.col("type") == "TEXT", "text").when(picture, "image")
    keyed = nodes.where("override_key is not null").select("id", "name", F.col("override_key").alias("key"), kind.alias("kind"), first_image().alias("own"))
    return below.join(keyed.where("kind is not null"), "id").select("symbol", "kind", "id", "name", "key", "own", "path")


def named_keys(nodes: DataFrame, asks: DataFrame, kind: str) -> DataFrame:
    """asks (slide, name) with `key`: the name itself if it is written like an id, else the key of the first slot of that name in preorder.

    kind text: text nodes; kind image: rectangles, with a picture or without. Slots are those of the symbol of
    the slide's first instance. Null where there is none.
    """
    types = ("TEXT",) if kind == "text" else PICTURE_TYPES
    keyed = nodes.where(F.col("type").isin(*types)).where("override_key is not null").select("id", F.col("name").alias("_name"), "override_key")
    links = slide_symbols(nodes).where("symbol_id is not null").select(F.col("slide").alias("_slide"), F.col("symbol_id").alias("_symbol"))
    symbols = links.select(F.col("_symbol").alias("id")).distinct()
    below = walk(nodes, symbols).select(F.col("root").alias("_symbol"), "id", "path").join(keyed, "id")
    first = below.groupBy("_symbol", "_name").agg(F.min_by("override_key", "path").alias("_key"))
    wanted = asks.join(links, F.col("slide") == F.col("_slide"), "left").withColumn("_asked", F.col("name"))
    found = wanted.join(first.withColumnRenamed("_symbol", "_of"), (F.col("_symbol") == F.col("_of")) & (F.col("_asked") == F.col("_name")), "left")
    return found.withColumn("key", F.when(is_key(F.col("name")), F.col("name")).otherwise(F.col("_key"))).select(*asks.columns, "key")


def editable_keys(nodes: DataFrame) -> DataFrame:
    """(symbol, id, depth, type, key, name): live text nodes and nodes with a picture that have a key, below every symbol; removed nodes end a branch."""
    symbols = nodes.where("type = 'SYMBOL'").select("id")
    live = nodes.where(is_live() | (F.col("type") == "SYMBOL"))
    below = walk(live, symbols, path=False).where("depth > 0").select(F.col("root").alias("symbol"), "id", (F.col("depth") - 1).cast("long").alias("depth"))
    shown = nodes.where("override_key is not null").where((F.col("type") == "TEXT") | has_image())
    return below.join(shown.select("id", "type", F.col("override_key").alias("key"), "name"), "id").select("symbol", "id", "depth", "type", "key", "name")


def slide_content(nodes: DataFrame, overrides: DataFrame) -> DataFrame:
    """(slide, line): what each live slide shows: texts and pictures of its own nodes, then of its first instance's overrides.

    Lines are told by what they list: text-node, shape-text (column shape_text), image-node, text-override, image-override.
    Removed nodes are left out, what lies below them is not.
    """
    slides = nodes.where("type = 'SLIDE'").where(is_live()).select("id")
    below = walk(nodes, slides, path=False).where("depth > 0").select(F.col("root").alias("slide"), "id").join(nodes.where(is_live()), "id")
    told = lambda tag, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"  [{tag}] "), "id", F.lit(' "'), F.coalesce("name", F.lit("")), F.lit('": '), value))
    picture = F.get(F.filter("fill_paints", lambda p: (p["type"] == "IMAGE") & p["image"].isNotNull()), F.lit(0))["image"]
    text = told("text-node", F.when(F.col("type") == "TEXT", F.col("text")))
    shape = told("shape-text", F.when(F.col("type") == "SHAPE_WITH_TEXT", F.col("shape_text"))) if "shape_text" in nodes.columns else F.lit(None).cast("string")
    direct = below.select("slide", F.explode(F.array_compact(F.array(text, shape, told("image-node", picture)))).alias("line"))
    links = slide_symbols(nodes.where("type <> 'SLIDE'").unionByName(nodes.where("type = 'SLIDE'").where(is_live())))
    over = overrides.join(links.where("instance is not null").select("slide", "instance"), F.col("inst_id") == F.col("instance"))
    key = F.coalesce(F.get("path", F.lit(0)), F.lit("?"))
    said = lambda tag, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"  [{tag}] "), key, F.lit(": "), F.col(c)))
    lines = over.select("slide", F.explode(F.array_compact(F.array(said("text-override", "text"), said("image-override", "image")))).alias("line"))
    return direct.unionByName(lines)


def missing_images(nodes: DataFrame, have: DataFrame, source: DataFrame) -> DataFrame:
    """(sha1, bytes): pictures that nodes' paints name and source has, but have does not (both: sha1, bytes): what an import copies."""
    named = nodes.select(F.explode("fill_paints").alias("p")).select(F.col("p.image").alias("sha1")).where("sha1 is not null").distinct()
    return source.join(named, "sha1", "left_semi").dropDuplicates(["sha1"]).join(have.select("sha1"), "sha1", "left_anti")

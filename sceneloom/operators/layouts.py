"""Layouts of templates described for those who choose among them: names, states, and slots with previews.

Nodes have, beyond the usual columns, text, shape_text (text of a shape that holds one), holds_text (whether a node is
such a shape), fill_paints (array of structs with type), width and height.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sceneloom.functions.scalars import PREFIXES, half_up, head16, strip_prefix
from sceneloom.functions.tables import written

from .catalog import layouts, main_rows
from .listing import LARGE
from .overrides import has_image
from .tree import is_live, walk_links

LAYOUT, TEXT_SLOT, IMAGE_SLOT, FIXED_IMAGE = PREFIXES
PREVIEW = 80


def prefixed(name: Column, prefix: str) -> Column:
    """What a name says after a prefix that it begins with, without further prefixes; null if nothing."""
    return F.when(name.startswith(prefix), F.nullif(strip_prefix(F.substr(name, F.lit(len(prefix) + 1))), F.lit("")))


def layout_name(name: Column) -> Column:
    return F.when(name.startswith(LAYOUT), strip_prefix(F.substr(name, F.lit(len(LAYOUT) + 1)))).otherwise(strip_prefix(name))


def describe(nodes: DataFrame, include_internal: bool = False) -> DataFrame:
    """(row, row_name, slide, module, root, name, raw_name, state) of every layout of the main rows, or of all live rows.

    A layout in a module is published, goes by the module's name and begins there (root).
    """
    rows = nodes.where("type = 'SLIDE_ROW'").where(is_live()) if include_internal else main_rows(nodes)
    rows = written(rows)  # few, so that what is right below them is found without a shuffle of all nodes
    found = layouts(nodes, rows)
    slides = nodes.where("type = 'SLIDE'").select(F.col("id").alias("slide"), F.col("pid").alias("_up"), F.col("name").alias("_slide_name"))
    modules = nodes.where("type = 'MODULE'").select(F.col("id").alias("module"), F.col("name").alias("_module_name"))
    named = rows.select(F.col("id").alias("row"), F.coalesce(F.nullif("name", F.lit("")), F.lit("Slide row")).alias("row_name"))
    out = found.join(slides, "slide").join(named, "row")
    out = out.join(modules, (F.col("state") == "published") & (F.col("_up") == F.col("module")), "left")
    raw = F.coalesce(F.nullif("_module_name", F.lit("")), F.nullif("_slide_name", F.lit("")), F.lit("Untitled"))
    return out.select("row", "row_name", "slide", "module", F.coalesce("module", "slide").alias("root"), layout_name(raw).alias("name"), raw.alias("raw_name"), "state")


def slots(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """(layout, kind, id, name, source, type, preview, width, height, has_image, path) of the slots of layouts (tops: layout, root), in order of path.

    What is named as a slot is explicit, else texts, shapes with a text, nodes with a picture and large empty frames are guessed
    (source heuristic). Guessed texts count where a layout has no explicit text, guessed pictures where it has
    no explicit slot at all. Fixed images are none. The way leads through instances into their symbols.
    """
    kind, name = F.col("type"), F.col("name")
    texts = kind.isin("TEXT", "SHAPE_WITH_TEXT")
    said_text, said_image = prefixed(name, TEXT_SLOT), prefixed(name, IMAGE_SLOT)
    fixed = prefixed(name, FIXED_IMAGE).isNotNull()
    large = F.coalesce(kind.isin("FRAME", "ROUNDED_RECTANGLE") & (F.col("width") > LARGE) & (F.col("height") > LARGE), F.lit(False))
    numbered = F.concat(F.lit("#"), F.col("id"))
    plain = said_text.isNull() & said_image.isNull() & ~fixed
    guess = F.when((kind == "TEXT") & (F.coalesce(name, F.lit("")) != ""), name).when((kind == "SHAPE_WITH_TEXT") & F.coalesce("holds_text", F.lit(False)), numbered)
    slot = lambda what, source, called: F.struct(F.lit(what).alias("kind"), F.lit(source).alias("source"), called.alias("name"))
    either = F.array(
        F.when(said_text.isNotNull() & texts, slot("text", "explicit", said_text)),
        F.when(said_text.isNull() & said_image.isNotNull(), slot("image", "explicit", said_image)),
        F.when(plain & guess.isNotNull(), slot("text", "heuristic", guess)),
        F.when(plain & (has_image() | (large & F.col("_full").isNull())), slot("image", "heuristic", numbered)),
    )
    preview = F.when(kind == "TEXT", head16(F.coalesce("text", F.lit("")), PREVIEW)).otherwise(head16(F.trim(F.coalesce("shape_text", F.lit(""))), PREVIEW))
    size = lambda c: half_up(F.coalesce(c, F.lit(0.0))).cast("long")
    # what may be a slot, told without making names: large frames with something in them are among it
    may = ~fixed & (texts | has_image() | large | F.coalesce(name.startswith(TEXT_SLOT) | name.startswith(IMAGE_SLOT), F.lit(False)))
    parents = nodes.where(is_live()).where("pid is not null").select(F.col("pid").alias("id")).distinct().withColumn("_full", F.lit(True))
    slim = nodes.where(may).join(parents, "id", "left").select("id", "type", preview.alias("preview"), size("width").alias("width"), size("height").alias("height"), has_image().alias("has_image"), F.explode(either).alias("s"))
    found = walk_links(nodes, tops.select(F.col("root").alias("id")), wanted=may).select("root", "id", "path")
    spread = found.join(slim.where("s is not null"), "id")
    w = Window.partitionBy("root")  # layouts of one root have the same slots
    explicit = F.col("s.source") == "explicit"
    some_text = F.max(explicit & (F.col("s.kind") == "text")).over(w)
    some = F.max(explicit).over(w)
    spread = spread.withColumn("_has", F.when(F.col("s.kind") == "text", some_text).otherwise(some))
    kept = spread.where((F.col("s.source") == "explicit") | ~F.col("_has"))
    kept = kept.join(tops.select("layout", "root"), "root")
    columns = ["layout", "s.kind", "id", "s.name", "s.source", "type", F.when(F.col("s.kind") == "text", F.col("preview")).alias("preview")]
    return kept.select(*columns, "width", "height", "has_image", "path")


def catalog_text(described: DataFrame, found: DataFrame) -> DataFrame:
    """(slide, text): each layout with its slots, as it is shown to those who choose. found: slots with the slide as layout."""
    at = lambda c: F.col(c).cast("string")
    where = F.concat(F.lit("    - "), "name", F.lit(" ("), "id", F.lit(", "), "source")
    sized = F.concat(where, F.lit(", "), at("width"), F.lit("x"), at("height"), F.lit(")"), F.when(F.col("has_image"), " [image]").otherwise(""))
    line = F.when(F.col("kind") == "text", F.concat(where, F.lit('): "'), "preview", F.lit('"'))).otherwise(sized)
    per = found.groupBy("layout").agg(
        *(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("path", line.alias("line"))))).alias(k) for k in ("text", "image")),
        F.max(F.col("source") == "explicit").alias("explicit"))

    def listed(k: str) -> Column:
        lines = F.array_join(F.transform(k, lambda x: x["line"]), "\n")
        return F.when(F.size(F.coalesce(k, F.array())) > 0, F.concat(F.lit(f"  {k} slots:\n"), lines)).otherwise(f"  {k} slots: (none)")

    rows = described.join(per, described["slide"] == per["layout"], "left")
    state = F.concat(F.lit("  state: "), "state", F.coalesce(F.concat(F.lit(", module "), "module"), F.lit("")), F.lit(", row "), "row")
    said = F.when(F.coalesce("explicit", F.lit(False)), "yes").otherwise("no")
    head = F.concat(F.lit('Layout "'), "name", F.lit('" ['), "slide", F.lit("]"))
    return rows.select("slide", F.concat_ws("\n", head, state, F.concat(F.lit("  explicit slots: "), said), listed("text"), listed("image")).alias("text"))

"""Pages, rows, layouts and slots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sceneloom.functions.ranking import numbered
from sceneloom.functions.scalars import INTERNAL_CANVAS, prefix_kind, strip_prefix

from .tree import ancestor_of_type, is_live


def pages(nodes: DataFrame) -> DataFrame:
    """Live canvases but the internal one, numbered from 1 in collation order of their positions."""
    shown = nodes.where("type = 'CANVAS'").where(is_live()).where(~F.col("name").eqNullSafe(INTERNAL_CANVAS))
    key = F.expr("coalesce(position, '') COLLATE UNICODE")
    return numbered(shown.withColumn("_key", key), ["_key", "ord"], "number").drop("_key")


def active_slides(nodes: DataFrame, document: str | None = None) -> DataFrame:
    """Live slides with their index from 0, by order in the file."""
    live = nodes.where("type = 'SLIDE'").where(is_live())
    if document is None:
        return numbered(live, ["ord"], "slide_index", start=0)
    return live.withColumn("slide_index", F.row_number().over(Window.partitionBy(document).orderBy("ord")).cast("long") - 1)


def backgrounds(slides: DataFrame) -> DataFrame:
    """(id, r, g, b, a) of each slide: the colour of its first paint, of whatever type; null where that has none."""
    first = F.get("fill_paints", F.lit(0))
    coloured = F.coalesce(first["r"], first["g"], first["b"]).isNotNull()
    return slides.select("id", *(F.when(coloured, first[c]).alias(c) for c in "rgba"))


def main_rows(nodes: DataFrame) -> DataFrame:
    """Live slide rows whose canvas is not the internal one."""
    rows = nodes.where("type = 'SLIDE_ROW'").where(is_live())
    above = ancestor_of_type(nodes, rows, "CANVAS")
    inner = nodes.where(F.col("type") == "CANVAS").where(F.col("name") == INTERNAL_CANVAS).select(F.col("id").alias("ancestor"))
    return rows.join(above.join(inner, "ancestor", "left_anti").select("id"), "id", "left_semi")


def layouts(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """(row, slide, state): live slides right below a row are drafts, those in a module below it are published."""
    live = nodes.where(is_live()).select("id", "pid", "type")
    below = live.join(rows.select(F.col("id").alias("row")), F.col("pid") == F.col("row"))
    draft = below.where("type = 'SLIDE'").select("row", F.col("id").alias("slide"), F.lit("draft").alias("state"))
    modules = below.where("type = 'MODULE'").select("row", F.col("id").alias("module"))
    inside = live.where("type = 'SLIDE'").join(modules, F.col("pid") == F.col("module")).select("row", F.col("id").alias("slide"), F.lit("published").alias("state"))
    return draft.unionByName(inside)


def chosen_slots(slots: DataFrame) -> DataFrame:
    """Slots (layout, id, kind text or image, name) by explicit name, else by guess.

    Text guesses count only where a layout has no explicit text slot; image guesses only where it has no
    explicit slot of either kind. Names that start with fixed:image: are never slots.
    """
    kind = prefix_kind(F.col("name"))
    rows = slots.where(~F.coalesce(kind == "fixed:image", F.lit(False))).withColumn("explicit", F.coalesce(kind == F.concat(F.lit("slot:"), F.col("kind")), F.lit(False)))
    w = Window.partitionBy("layout")
    text = F.max(F.col("explicit") & (F.col("kind") == "text")).over(w)
    any_ = F.max("explicit").over(w)
    rows = rows.withColumn("has", F.when(F.col("kind") == "text", text).otherwise(any_))
    return rows.where("explicit or not has").select("layout", "id", "kind", "explicit", strip_prefix(F.col("name")).alias("name"))

"""Listings of documents: texts, override keys, effective values, slots of layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneloom.functions.scalars import preview

from .catalog import chosen_slots
from .resolve import slide_symbols
from .tree import is_live, walk, walk_links

#: Empty frames count as image slots if both sides are longer.
LARGE = 100


def list_text(nodes: DataFrame, overrides: DataFrame) -> DataFrame:
    """(source, slide, id, text): every text node, removed ones too (source direct), then the text overrides of each live slide's first instance (source override, id the key)."""
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    direct = nodes.where("type = 'TEXT'").where(some("text")).select(F.lit("direct").alias("source"), F.lit(None).cast("string").alias("slide"), "id", "text")
    of = slide_symbols(nodes.where("type <> 'SLIDE'").unionByName(nodes.where("type = 'SLIDE'").where(is_live()))).where("instance is not null").select("slide", "instance")
    over = overrides.where(some("text")).join(of, F.col("inst_id") == F.col("instance")).select(F.lit("override").alias("source"), "slide", F.col("key").alias("id"), "text")
    return direct.unionByName(over)


def list_override_keys(nodes: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol, override_key, depth, type, name, detail) of what can be overridden inside each symbol: a text's preview, an instance's symbol, or nothing."""
    n = nodes.where("override_key is not null").select("id", "override_key", "type", "name", "text", "symbol_id")
    below = walk(nodes, symbols).where("depth > 0").select(F.col("root").alias("symbol"), "id", (F.col("depth") - 1).cast("long").alias("depth"))
    detail = F.when(F.col("type") == "TEXT", preview(F.col("text"))).when(F.col("type") == "INSTANCE", F.concat(F.lit("sym="), "symbol_id"))
    return below.join(n, "id").select("symbol", "override_key", "depth", "type", "name", F.coalesce(detail, F.lit("")).alias("detail"))


def text_nodes(nodes: DataFrame, overrides: DataFrame) -> DataFrame:
    """(slide, override_key, text) of each text inside the symbol of a slide's first instance: its first override, else its own text, else empty."""
    links = slide_symbols(nodes).where("instance is not null").select("slide", "instance", F.col("symbol_id").alias("symbol"))
    wanted = nodes.join(links.select(F.col("symbol").alias("id")).distinct(), "id", "left_semi")
    inside = walk(nodes, wanted).where("depth > 0").select(F.col("root").alias("symbol"), "id")
    inside = inside.join(nodes.where("type = 'TEXT' and override_key is not null").select("id", "override_key", F.col("text").alias("own")), "id").drop("id")
    first = overrides.groupBy(F.col("inst_id").alias("instance"), F.col("key").alias("override_key")).agg(F.min_by(F.struct("text"), "ov_ix")["text"].alias("over"))
    rows = links.join(inside, "symbol").join(first, ["instance", "override_key"], "left")
    return rows.select("slide", "override_key", F.coalesce("over", "own", F.lit("")).alias("text"))


def discover_slots(nodes: DataFrame, layouts: DataFrame) -> DataFrame:
    """(layout, id, kind, explicit, name) of the slots below each layout (column slide), through instances into symbols.

    A text node may be a text slot; a node with an image fill, or a large frame without live children, an image
    slot. Explicit names decide as chosen_slots says.
    """
    parents = nodes.where(is_live()).where("pid is not null").select(F.col("pid").alias("id")).distinct().withColumn("_full", F.lit(True))
    found = walk_links(nodes, layouts.select(F.col("slide").alias("id"))).select(F.col("root").alias("layout"), "id")
    rows = found.join(nodes.select("id", "type", "name", "has_image", "width", "height"), "id").join(parents, "id", "left")
    empty = F.col("type").isin("FRAME", "ROUNDED_RECTANGLE") & (F.col("width") > LARGE) & (F.col("height") > LARGE) & F.col("_full").isNull()
    said = F.regexp_extract(F.trim("name"), "^slot:(text|image):", 1)
    kind = F.when(said != "", said).when(F.col("type") == "TEXT", "text").when(F.coalesce("has_image", F.lit(False)) | F.coalesce(empty, F.lit(False)), "image")
    return chosen_slots(rows.withColumn("kind", kind).where("kind is not null").select("layout", "id", "kind", "name"))

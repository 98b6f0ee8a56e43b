"""Document validation: variant names, contrast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneloom.functions.scalars import contrast, luminance, to_fixed

from .resolve import dangling
from .tree import is_live, walk_links


def variant_parts(symbols: DataFrame) -> DataFrame:
    """(id, component_key, property, value) of names like "Type=A, Size=1"; parts without "=" are left out."""
    out = symbols.select("id", "component_key", F.explode(F.split("name", ",")).alias("part")).withColumn("part", F.trim("part")).where(F.col("part").contains("="))
    return out.select("id", "component_key", F.trim(F.split_part("part", F.lit("="), F.lit(1))).alias("property"), F.trim(F.substring_index("part", "=", -1)).alias("value"))


def variant_mismatches(symbols: DataFrame) -> DataFrame:
    """(id, component_key, value): values in symbols' names that no symbol of their component (of two or more) lists in variant_specs."""
    shared = symbols.where("component_key is not null").groupBy("component_key").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("component_key")
    parts = variant_parts(symbols).join(shared, "component_key", "left_semi")
    specs = symbols.select("component_key", F.explode("variant_specs").alias("value")).distinct()
    return parts.join(specs, ["component_key", "value"], "left_anti").select("id", "component_key", "value").distinct()


def own_variant_invalid(symbols: DataFrame) -> DataFrame:
    """Symbols with specs whose name has a value outside their own specs: they are drawn as placeholders."""
    own = variant_parts(symbols).groupBy("id").agg(F.collect_set("value").alias("values"))
    both = symbols.where("component_key is not null and size(variant_specs) > 0").join(own, "id")
    return both.where(F.size(F.array_except("values", "variant_specs")) > 0).select("id", "component_key")


def low_contrast(texts: DataFrame, least: float = 2.0) -> DataFrame:
    """texts (id, r, g, b, bg_r, bg_g, bg_b) whose contrast with the background is below `least`, with the ratio. An absent background is white."""
    bg = [F.coalesce(F.col(f"bg_{c}"), F.lit(1.0)) for c in "rgb"]
    ratio = contrast(luminance(*(F.col(c) for c in "rgb")), luminance(*bg))
    return texts.withColumn("ratio", ratio).where(F.col("ratio") < least)


def first_colour(paints: str = "fill_paints"):
    """Colour of the first paint, of whatever type, seen or not; null without one."""
    p = F.get(F.col(paints), F.lit(0))
    return F.when(p["r"].isNotNull(), F.struct(*(p[c].alias(c) for c in "rgb")))


def slide_contrast(nodes: DataFrame) -> DataFrame:
    """(slide, id, name, ratio) of every text below a live slide, through instances and removed nodes too, whose contrast with the slide's background is low."""
    slides = nodes.where("type = 'SLIDE'").where(is_live())
    coloured = (F.col("type") == "TEXT") & first_colour().isNotNull()
    found = walk_links(nodes, slides.select("id"), skip_removed=False, enter_symbol=True, wanted=coloured).select(F.col("root").alias("slide"), "id")
    ground = slides.select(F.col("id").alias("slide"), first_colour().alias("_bg"))
    texts = nodes.where("type = 'TEXT'").select("id", "name", first_colour().alias("_fg")).where("_fg is not null")
    rows = found.join(texts, "id").join(ground, "slide")
    rows = rows.select("slide", "id", "name", *(F.col(f"_fg.{c}").alias(c) for c in "rgb"), *(F.col(f"_bg.{c}").alias(f"bg_{c}") for c in "rgb"))
    return low_contrast(rows).select("slide", "id", "name", "ratio")


def warnings(nodes: DataFrame) -> DataFrame:
    """(kind, id, message): what is wrong with a document: variant values that no symbol lists, instances without symbol, texts hard to read."""
    quoted = lambda c: F.concat(F.lit(' "'), F.coalesce(c, F.lit("")), F.lit('"'))
    named = nodes.select("id", "name")
    variants = variant_mismatches(nodes.where("type = 'SYMBOL'").where(is_live())).join(named, "id")
    told = F.concat(F.lit("SYMBOL "), "id", quoted("name"), F.lit(': variant value "'), "value", F.lit('" is in no symbol of the component'))
    lost = dangling(nodes.where("symbol_id is not null or type <> 'INSTANCE'"))
    missing = F.concat(F.lit("INSTANCE "), "id", quoted("name"), F.lit(": references missing SYMBOL "), "symbol_id")
    pale = F.concat(F.lit("TEXT "), "id", quoted("name"), F.lit(": contrast ratio "), to_fixed(F.col("ratio"), 2), F.lit(":1 on slide "), "slide", F.lit(" is below 2:1"))
    out = variants.select(F.lit("variant").alias("kind"), "id", told.alias("message"))
    out = out.unionByName(lost.select(F.lit("missing").alias("kind"), "id", missing.alias("message")))
    return out.unionByName(slide_contrast(nodes).select(F.lit("contrast").alias("kind"), "id", pale.alias("message")))

"""References between nodes: instance to symbol, override to target, image and style lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tree import is_live


def slide_symbols(nodes: DataFrame) -> DataFrame:
    """(slide, instance, symbol_id, symbol_name) by each slide's first instance; nulls where a link is missing."""
    first = nodes.where("type = 'INSTANCE'").groupBy("pid").agg(F.min_by(F.struct("id", "symbol_id"), "ord").alias("x"))
    symbols = nodes.where("type = 'SYMBOL'").select(F.col("id").alias("_sid"), F.col("name").alias("symbol_name"))
    out = nodes.where("type = 'SLIDE'").select(F.col("id").alias("slide")).join(first.withColumnRenamed("pid", "slide"), "slide", "left")
    out = out.select("slide", F.col("x.id").alias("instance"), F.col("x.symbol_id").alias("symbol_id"))
    return out.join(symbols, F.col("symbol_id") == F.col("_sid"), "left").drop("_sid")


def dangling(nodes: DataFrame) -> DataFrame:
    """Live instances whose symbol is missing or no symbol."""
    symbols = nodes.where("type = 'SYMBOL'").select(F.col("id").alias("_sid"))
    return nodes.where("type = 'INSTANCE'").where(is_live()).join(symbols, F.col("symbol_id") == F.col("_sid"), "left_anti")


def effective(overrides: DataFrame, key: list[str], value: str, last: bool = False) -> DataFrame:
    """One value per key: of the first override (reading an object) or of the last (drawing)."""
    pick = F.max_by if last else F.min_by
    return overrides.groupBy(*key).agg(pick(value, "ov_ix").alias(value), F.count(F.lit(1)).alias("n_overrides"))


def slot_values(slots: DataFrame, values: DataFrame) -> DataFrame:
    """(slot, value) for each slot with an ordered array `keys`: the value of the first key that values (key, value) has, even if that is null."""
    wanted = slots.select("slot", F.posexplode(F.array_distinct(F.filter("keys", lambda k: F.coalesce(k, F.lit("")) != ""))).alias("at", "key"))
    hit = wanted.join(values, "key").groupBy("slot").agg(F.min_by(F.struct("key", "value"), "at").alias("x"))
    return hit.select("slot", F.col("x.key").alias("key"), F.col("x.value").alias("value"))


def last_node_wins(nodes: DataFrame, key: str = "id") -> DataFrame:
    """One row per key: where ids repeat, the last in order."""
    return nodes.groupBy(key).agg(F.max_by(F.struct(*nodes.columns), "ord").alias("x")).select("x.*")


def named_or_id(nodes: DataFrame, ref: str, kind: str = "SLIDE", removed_too: bool = False) -> DataFrame:
    """The node of a type whose id is ref, else the first by that name (live ones only, unless removed_too)."""
    of = nodes.where(F.col("type") == kind)
    by_name = of.where(F.col("name") == ref) if removed_too else of.where(is_live()).where(F.col("name") == ref)
    both = of.where(F.col("id") == ref).withColumn("_by", F.lit(0)).unionByName(by_name.withColumn("_by", F.lit(1)))
    return both.orderBy("_by", "ord").limit(1).drop("_by")


def by_reference(nodes: DataFrame, refs: DataFrame, kind: str = "SLIDE", removed_too: bool = False) -> DataFrame:
    """refs (ref) with id: of the node of a type that has ref as its id, else of the first by that name (live ones only, unless removed_too); null if none."""
    of = nodes.where(F.col("type") == kind)
    named = (of if removed_too else of.where(is_live())).groupBy(F.col("name").alias("_name")).agg(F.min_by("id", "ord").alias("_named"))
    out = refs.join(of.select(F.col("id").alias("_id")), F.col("ref") == F.col("_id"), "left").join(named, F.col("ref") == F.col("_name"), "left")
    return out.select(*refs.columns, F.coalesce("_id", "_named").alias("id"))

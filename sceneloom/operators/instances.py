"""Instances expanded into what they show: the content of their symbols with overrides, as nodes of their own.

An override has inst_id, ov_ix, path (array of keys; the first of one that counts has one key), and text, image or symbol_id
(another symbol for a nested instance). A layout entry has inst_id, ix, path, and width and height, transform (or x and y), or glyphs and
baselines (and what else nodes have of a text's layout): what the document's own layout gives a node inside an instance.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneloom.functions.tables import written

from .tree import is_live, override_targets, walk

#: Columns of layout entries that only count inside a symbol that lays out its content itself, each row of them set together.
PLACED = (("width", "height"), ("transform",), ("x", "y"))


def targets(nodes: DataFrame, uses: DataFrame, keys: DataFrame) -> DataFrame:
    """keys (inst_id, key, ...) with target: the node that a key means inside an instance.

    A node of that id, wherever it stands; else the last node below the instance's symbols that has the key. uses: (inst_id,
    symbol, rank), where a symbol of higher rank hides others.
    """
    by_key = override_targets(nodes, uses.select(F.col("symbol").alias("id")).distinct())
    inside = uses.join(by_key, "symbol").groupBy("inst_id", F.col("override_key").alias("key")).agg(F.max_by("id", "rank").alias("_inside"))
    ids = nodes.select(F.col("id").alias("key"), F.col("id").alias("_own")).distinct()
    out = keys.join(ids, "key", "left").join(inside, ["inst_id", "key"], "left")
    return out.withColumn("target", F.coalesce("_own", "_inside")).drop("_own", "_inside")


def swaps(nodes: DataFrame, overrides: DataFrame) -> DataFrame:
    """(inst_id, target, symbol): nested instances that show another symbol inside an instance; the last override of one counts."""
    uses = nodes.where("type = 'INSTANCE'").select(F.col("id").alias("inst_id"), F.col("symbol_id").alias("symbol"), F.lit(-1).cast("long").alias("rank"))
    asked = overrides.where("symbol_id is not null and size(path) = 1").select("inst_id", F.col("path")[0].alias("key"), "ov_ix", "symbol_id")
    return targets(nodes, uses, asked).where("target is not null").groupBy("inst_id", "target").agg(F.max_by("symbol_id", "ov_ix").alias("symbol"))


def values(nodes: DataFrame, overrides: DataFrame, swapped: DataFrame) -> DataFrame:
    """(inst_id, target, text, image): what overrides set on nodes inside an instance, the last of each; keys of swapped symbols count too."""
    own = nodes.where("type = 'INSTANCE'").select(F.col("id").alias("inst_id"), F.col("symbol_id").alias("symbol"), F.lit(0).alias("rank"))
    uses = own.unionByName(swapped.select("inst_id", "symbol", F.lit(1).alias("rank")))
    asked = overrides.where("size(path) = 1 and (text is not null or image is not null)").select("inst_id", F.col("path")[0].alias("key"), "ov_ix", "text", "image")
    found = targets(nodes, uses, asked).where("target is not null")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ov_ix"))).alias(c)
    return found.groupBy("inst_id", "target").agg(last("text"), last("image"))


def layout_units(entries: DataFrame) -> dict[str, list[str]]:
    """Columns of layout entries that are set together, by name: sizes, transforms, places, and all of a text's layout."""
    have = [c for c in entries.columns if c not in ("inst_id", "ix", "path")]
    units = {"_".join(unit): [c for c in unit if c in have] for unit in PLACED}
    units["laid_text"] = [c for c in have if not any(c in unit for unit in PLACED)]
    return {name: columns for name, columns in units.items() if columns}


def layouts(nodes: DataFrame, entries: DataFrame, swapped: DataFrame) -> DataFrame:
    """(inst_id, target, a struct for each of layout_units): what layout entries set on nodes inside an instance.

    An entry names a node by the last key of its path. Of entries with one key the last counts, in the place of the first; where
    several keys mean one node, the later place counts, for each unit by itself. Keys of swapped symbols count too.
    """
    units = layout_units(entries)
    own = nodes.where("type = 'INSTANCE'").select(F.col("id").alias("inst_id"), F.col("symbol_id").alias("symbol"), F.lit(0).alias("rank"))
    uses = own.unionByName(swapped.select("inst_id", "symbol", F.lit(1).alias("rank")))
    given = lambda columns: reduce(or_, (F.col(c).isNotNull() for c in columns))
    said = entries.select("inst_id", "ix", F.element_at("path", -1).alias("key"), *(F.when(given(columns), F.struct(*columns)).alias(name) for name, columns in units.items()))
    last = said.where("key is not null").groupBy("inst_id", "key").agg(F.min("ix").alias("place"), F.max_by(F.struct(*units), "ix").alias("x")).select("inst_id", "key", "place", "x.*")
    later = [F.max_by(name, F.when(F.col(name).isNotNull(), F.col("place"))).alias(name) for name in units]
    return targets(nodes, uses, last).where("target is not null").groupBy("inst_id", "target").agg(*later)


def expand(nodes: DataFrame, overrides: DataFrame, start: DataFrame, invalid: DataFrame | None = None, entries: DataFrame | None = None) -> DataFrame:
    """Nodes below start (column id), with copies of their symbols' content below live instances.

    A copy has the instance's id, a slash and its own id; node is the id that it copies, chain the instances that it is in, from
    the outermost. Instances inside symbols are expanded in turn, each level one join; a symbol inside itself is not. Values
    of the innermost instance that sets one count. An instance that shows a symbol is marked as expanded and has its looks
    (symbol_paints and so on), another none: its symbol is missing or in invalid (column id). Removed nodes end a branch.
    """
    live = nodes.where(is_live())
    symbols = live.where("type = 'SYMBOL'") if invalid is None else live.where("type = 'SYMBOL'").join(invalid.select("id"), "id", "left_anti")
    ids = symbols.select("id")
    swapped = written(swaps(nodes, overrides))
    content = written(walk(nodes, ids, skip_removed=True, path=False).where("depth > 0").select(F.col("root").alias("symbol"), F.col("id").alias("node"), F.col("pid").alias("up")))
    kinds = nodes.select(F.col("id").alias("node"), "type", "symbol_id")
    top = walk(nodes, start, skip_removed=True, path=False).select("id", "pid", F.col("id").alias("node"))
    top = top.withColumns({"chain": F.array().cast("array<string>"), "inside": F.array().cast("array<string>")})
    known = ids.select(F.col("id").alias("_symbol"))
    level, found = _shown(top.join(kinds, "node"), swapped, known), None
    while True:
        level = written(level)
        found = level if found is None else found.unionByName(level)
        uses = level.where("shows is not null").select(F.col("id").alias("_id"), F.concat("chain", F.array("node")).alias("chain"), F.concat("inside", F.array("shows")).alias("inside"), F.col("shows").alias("symbol"))
        if uses.isEmpty():
            break
        below = uses.join(content, "symbol")
        within = lambda c: F.concat(F.col("_id"), F.lit("/"), F.col(c))
        above = F.when(F.col("up") == F.col("symbol"), F.col("_id")).otherwise(within("up"))
        below = below.select(within("node").alias("id"), above.alias("pid"), "node", "chain", "inside")
        level = _shown(below.join(kinds, "node"), swapped, known)
    return _valued(found.select("id", "pid", "node", "chain", "shows"), nodes, values(nodes, overrides, swapped), None if entries is None else (layouts(nodes, entries, swapped), layout_units(entries)))


def _shown(rows: DataFrame, swapped: DataFrame, known: DataFrame) -> DataFrame:
    """rows (node, type, symbol_id, chain, inside) with shows: the symbol that an instance shows there, null if none or if it is in it already."""
    swap = swapped.select(F.col("inst_id").alias("_inst"), F.col("target").alias("node"), F.col("symbol").alias("_to"))
    asked = rows.where("type = 'INSTANCE'").select("id", "node", F.posexplode("chain").alias("_at", "_inst")).join(swap, ["node", "_inst"])
    inner = asked.groupBy("id").agg(F.max_by("_to", "_at").alias("_to"))
    out = rows.join(inner, "id", "left").withColumn("_asked", F.when(F.col("type") == "INSTANCE", F.coalesce("_to", "symbol_id")))
    out = out.join(known, F.col("_asked") == F.col("_symbol"), "left")
    shows = F.when(~F.array_contains("inside", F.col("_symbol")), F.col("_symbol"))
    return out.withColumn("shows", shows).select("id", "pid", "node", "chain", "inside", "shows")


def _valued(found: DataFrame, nodes: DataFrame, value: DataFrame, layout: tuple[DataFrame, dict[str, list[str]]] | None) -> DataFrame:
    """found with the columns of nodes, changed by the instances that each row is in, and the looks of the symbol that it shows."""
    spread = found.select("id", "node", F.posexplode("chain").alias("_at", "inst_id"), "chain")

    def innermost(rows: DataFrame, columns: list[str]) -> DataFrame:
        return rows.groupBy("id").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_at"))).alias(f"_{c}") for c in columns))

    own = nodes.drop("pid").withColumnRenamed("id", "node")
    hit = spread.join(value.withColumnRenamed("target", "node"), ["inst_id", "node"])
    out = found.join(own, "node").join(innermost(hit, ["text", "image"]), "id", "left")
    out = out.withColumn("text", F.coalesce(F.when(F.col("type") == "TEXT", F.col("_text")), "text"))
    if "image" in nodes.columns:
        out = out.withColumn("image", F.coalesce("_image", "image"))
    if layout is not None:
        table, units = layout
        hit = spread.join(table.withColumnRenamed("target", "node"), ["inst_id", "node"])
        hit = hit.withColumn("_copy", F.concat_ws("/", F.slice("chain", 1, F.col("_at") + 1)))  # the id of the instance's own row
        auto = nodes.where("type = 'SYMBOL' and stack_mode is not null") if "stack_mode" in nodes.columns else nodes.where("false")
        laid = found.join(auto.select(F.col("id").alias("shows")).distinct(), "shows", "left_semi").select(F.col("id").alias("_copy"), F.lit(True).alias("_laid"))
        hit = hit.join(laid, "_copy", "left").withColumns({name: F.when(F.col("_laid"), F.col(name)) for name in units if name != "laid_text"})
        out = out.join(innermost(hit, list(units)), "id", "left")
        for name, columns in units.items():
            out = out.withColumns({c: F.when(F.col(f"_{name}").isNotNull(), F.col(f"_{name}")[c]).otherwise(F.col(c)) for c in columns if c in nodes.columns})
    looks = {"fill_paints": "symbol_paints", "width": "symbol_width", "height": "symbol_height", "radius": "symbol_radius", "stack_mode": "stack_mode", "stroke_paints": "symbol_stroke_paints", "stroke_weight": "symbol_stroke_weight", "stroke_align": "symbol_stroke_align"}
    have = {c: name for c, name in looks.items() if c in nodes.columns}
    out = out.drop("stack_mode")
    if have:
        symbol = nodes.select(F.col("id").alias("shows"), F.struct(*(F.col(c).alias(name) for c, name in have.items())).alias("_looks"))
        out = out.join(symbol, "shows", "left")
    out = out.withColumn("expanded", F.when(F.col("type") == "INSTANCE", F.col("shows").isNotNull()))
    kept = [c for c in nodes.columns if c not in ("id", "pid", "stack_mode")]
    return out.select("id", "pid", *kept, "node", "chain", "shows", "expanded", *(F.col(f"_looks.{name}").alias(name) for name in have.values()))

"""Layouts to documents: publish drafts, clone layouts, annotate names, add and remove slides. Inputs are never changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sceneloom.functions.ranking import numbered
from sceneloom.functions.scalars import parse_id, position_char, strip_prefix
from sceneloom.functions.tables import spread, written

from .layouts import describe
from .overrides import SCALE_MODE
from .tree import is_live, roots, walk

#: The sessions of cloned and of imported nodes, the distance between slides side by side.
CLONE_SESSION, IMPORT_SESSION, SLIDE_GAP = 200, 1, 2160


def next_local(nodes: DataFrame) -> int:
    """One more than the largest local id."""
    return (nodes.agg(F.max(parse_id(F.col("id"))["local"])).first()[0] or 0) + 1


def publish(nodes: DataFrame, drafts: DataFrame | None = None) -> DataFrame:
    """nodes with a MODULE between each draft slide (column slide) and its parent. Modules keep the slide's session, name and place.

    Without drafts, or with none named, all draft layouts of the main rows. Drafts that are no node are passed over; without any draft the
    result would be the input, and that is an error.
    """
    if drafts is None or drafts.isEmpty():
        drafts = describe(nodes).where("state = 'draft'").select("slide")
    slides = nodes.join(drafts.select(F.col("slide").alias("id")).distinct(), "id", "left_semi")
    fresh = numbered(slides, ["ord"], "_n", next_local(nodes))
    if fresh.isEmpty():
        raise ValueError("no draft slides to publish")
    module = F.concat(parse_id(F.col("id"))["session"].cast("string"), F.lit(":"), F.col("_n").cast("string"))
    last = F.lit(nodes.agg(F.max("ord")).first()[0])
    changed = {"id": module, "type": F.lit("MODULE"), "phase": F.lit("CREATED"), "name": F.coalesce("name", F.lit("layout")), "ord": last + F.col("_n")}
    modules = fresh.select(*(changed.get(c, F.col(c)).cast(t).alias(c) for c, t in nodes.dtypes))
    above = fresh.select(F.col("id").alias("_id"), module.alias("_module"))
    moved = nodes.join(above, F.col("id") == F.col("_id"), "left")
    moved = moved.withColumn("pid", F.coalesce("_module", "pid")).withColumn("position", F.when(F.col("_module").isNotNull(), "!").otherwise(F.col("position")))
    return moved.select(*nodes.columns).unionByName(modules)


def clone_layouts(nodes: DataFrame, wanted: DataFrame, row: str) -> DataFrame:
    """Clones of the subtrees that wanted (place from 0, root) names, as new nodes under `row`, with old_id and place.

    A root may be named repeatedly. Removed nodes are left out, what lies below them is not. Ids go on
    from the largest local id, by place and then preorder. The root's x is its place times the slide gap.
    """
    trees = walk(nodes, wanted.select(F.col("root").alias("id"))).select("root", F.col("id").alias("old_id"), "path")
    live = nodes.where(is_live())
    rows = wanted.join(trees, "root").join(live, F.col("old_id") == live["id"])
    rows = numbered(rows, ["place", "path"], "_n", next_local(nodes))
    new_id = F.concat(F.lit(f"{CLONE_SESSION}:"), F.col("_n").cast("string"))
    ids = rows.select(F.col("place").alias("_place"), F.col("old_id").alias("_old"), new_id.alias("_new"))
    out = rows.join(ids, (F.col("place") == F.col("_place")) & (F.col("pid") == F.col("_old")), "left")
    is_root = F.col("old_id") == F.col("root")
    changed = {
        "id": new_id, "pid": F.when(is_root, F.lit(row)).otherwise(F.coalesce("_new", "pid")), "phase": F.lit("CREATED"), "ord": F.col("_n") + F.lit(nodes.agg(F.max("ord")).first()[0]),
        "position": F.when(is_root, position_char(F.col("place"))).otherwise(F.col("position")), "x": F.when(is_root, F.col("place") * F.lit(float(SLIDE_GAP))).otherwise(F.col("x")) if "x" in nodes.columns else None,
    }
    return out.select("place", "old_id", *((changed[c] if c in changed else F.col(c)).cast(t).alias(c) for c, t in nodes.dtypes))


def create_from_template(nodes: DataFrame, wanted: DataFrame, layouts: DataFrame, rows: DataFrame, texts: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """nodes with clones of the wanted layouts in the first row, filled with texts and pictures, and without the layouts and the other rows.

    wanted: (place, root). layouts: (row, slide, state). rows: (id, ord). texts: (place, key, text); a
    clone's text is the one whose key is its slot name, else its old id, else "#" and its old id, else its
    name; images (place, key, image, image_width, image_height) by the same keys. Unknown roots and a template without rows are errors.
    """
    first = rows.agg(F.min_by("id", "ord")).first()[0]
    if first is None:
        raise ValueError("no slide row in the template")
    tops = layouts.join(nodes.select(F.col("id").alias("slide"), "pid"), "slide").select(F.when(F.col("state") == "published", F.col("pid")).otherwise(F.col("slide")).alias("root"))
    unknown = wanted.join(tops, "root", "left_anti").select("root").first()
    if unknown:
        raise ValueError(f"layout not found: {unknown[0]}")
    clones = filled(clone_layouts(nodes, wanted, first), texts)
    clones = (clones if images is None else pictured(clones, images)).drop("place", "old_id")
    gone = walk(nodes, tops.select(F.col("root").alias("id"))).select("id").unionByName(rows.where(F.col("id") != first).select("id")).distinct()
    left = spread(nodes, "id").join(gone.hint("shuffle_merge"), "id", "left_anti")  # most of a template may go
    return left.select(*nodes.columns).unionByName(clones.select(*nodes.columns))


def import_symbols(source: DataFrame, target: DataFrame, wanted: DataFrame, canvas: str) -> tuple[DataFrame, DataFrame]:
    """(mapping (old, new, place), new nodes) for symbols of source that wanted (place, id) names, to go below target's node `canvas`.

    A symbol whose component_key a live symbol of target has, or one imported before it, maps to that one
    and brings no nodes. Others are cloned with their live subtrees in session 1, ids going on from target's. References to symbols and override keys follow
    their own subtree's clones, else the last import before. A name that is no symbol of source is an error.
    """
    symbols = source.where("type = 'SYMBOL'").select("id", F.col("component_key").alias("_key"))
    asked = wanted.join(symbols, "id", "left_anti").select("id").first()
    if asked:
        raise ValueError(f"SYMBOL not found in source deck: {asked[0]}")
    have = target.where("type = 'SYMBOL'").where(is_live()).where("coalesce(component_key, '') <> ''").groupBy(F.col("component_key").alias("_key")).agg(F.max_by("id", "ord").alias("_have"))
    rows = wanted.join(symbols, "id").join(have, "_key", "left")
    keyed = F.coalesce("_key", F.lit("")) != ""
    rows = written(rows.withColumn("_first", F.when(keyed, F.min("place").over(Window.partitionBy("_key"))).otherwise(F.col("place"))))
    fresh = rows.where("_have is null and place = _first").select("place", F.col("id").alias("root"))
    trees = walk(source, fresh.select(F.col("root").alias("id"))).select("root", F.col("id").alias("old"), "path")
    live = source.where(is_live())
    clones = numbered(fresh.join(trees, "root").join(live, F.col("old") == live["id"]), ["place", "path"], "_n", next_local(target))
    new_id = F.concat(F.lit(f"{IMPORT_SESSION}:"), F.col("_n").cast("string"))
    ids = written(clones.select("place", "root", "old", new_id.alias("new")))
    tops = ids.where("old = root").select(F.col("place").alias("_p"), F.col("new").alias("_new"))
    reused = rows.where("_have is not null or place <> _first").join(tops, F.col("_first") == F.col("_p"), "left")
    mapping = ids.select("old", "new", "place").unionByName(reused.select(F.col("id").alias("old"), F.coalesce("_have", "_new").alias("new"), "place"))

    def follow(df: DataFrame, column: str, earlier: bool) -> DataFrame:
        """column through the clones of the same place, or the last mapping of an earlier one."""
        m = mapping.select(F.col("old").alias("_old"), F.col("new").alias("_to"), F.col("place").alias("_at"))
        near = F.col("_at") <= F.col("place") if earlier else F.col("_at") == F.col("place")
        best = df.select("place", "old", column).join(m, (F.col(column) == F.col("_old")) & near).groupBy("place", "old").agg(F.max_by("_to", "_at").alias("_best"))
        best = best.select(F.col("place").alias("_place"), F.col("old").alias("_node"), "_best")
        joined = df.join(best, (F.col("place") == F.col("_place")) & (F.col("old") == F.col("_node")), "left")
        return joined.withColumn(column, F.coalesce("_best", column)).drop("_place", "_node", "_best")

    out = clones.withColumn("symbol_id", F.when(F.col("type") == "INSTANCE", F.col("symbol_id")))
    for column, earlier in (("pid", False), ("symbol_id", True), ("override_key", False)):
        out = follow(out, column, earlier)
    last, siblings = target.agg(F.max("ord")).first()[0], target.where(F.col("pid") == canvas).count()
    is_root = F.col("old") == F.col("root")
    changed = {"id": new_id, "phase": F.lit("CREATED"), "ord": F.col("_n") + F.lit(last or 0), "pid": F.when(is_root, F.lit(canvas)).otherwise(F.col("pid")), "position": F.when(is_root, position_char(F.lit(siblings))).otherwise(F.col("position"))}
    return mapping, out.select(*(changed.get(c, F.col(c)).cast(t).alias(c) for c, t in source.dtypes))


def import_overrides(overrides: DataFrame, mapping: DataFrame, new: DataFrame) -> DataFrame:
    """What the overrides of imported instances become: overrides (inst_id, path and any others) with new ids, once for each clone.

    mapping and new: what import_symbols gives. Every key of a path that names a node of the same import becomes that node's clone; others stay, as
    keys of libraries do. Overrides of instances that were not cloned are not in the result. Each path is followed once an import, however many
    overrides have it.
    """
    clones = written(mapping.join(new.select(F.col("id").alias("new")), "new", "left_semi").select("place", "old", "new"))
    own = clones.select(F.col("place").alias("_place"), F.col("old").alias("_old"), F.col("new").alias("_inst"))
    rows = written(overrides.join(own, F.col("inst_id") == F.col("_old")))
    paths = rows.select("_place", "path").distinct().where("size(path) > 0")
    keys = paths.select("_place", "path", F.posexplode("path").alias("_at", "_key"))
    to = clones.select(F.col("place").alias("_p"), F.col("old").alias("_k"), F.col("new").alias("_to"))
    followed = keys.join(to, (F.col("_place") == F.col("_p")) & (F.col("_key") == F.col("_k")), "left")
    step = F.struct("_at", F.coalesce("_to", "_key").alias("key"))
    found = followed.groupBy(F.col("_place").alias("_of"), F.col("path").alias("_from")).agg(F.array_sort(F.collect_list(step)).alias("_steps"))
    out = rows.join(found, (F.col("_place") == F.col("_of")) & (F.col("path") == F.col("_from")), "left")
    path = F.when(F.col("_steps").isNull(), F.col("path")).otherwise(F.transform("_steps", lambda x: x["key"]))
    return out.withColumns({"inst_id": F.col("_inst"), "path": path}).select(*overrides.columns)


def _keyed(clones: DataFrame) -> DataFrame:
    """(_place, _old, _at, _key): the keys that a clone goes by, the first first."""
    keys = F.array_distinct(F.array_compact(F.array(strip_prefix(F.col("name")), F.col("old_id"), F.concat(F.lit("#"), F.col("old_id")), F.col("name"))))
    return clones.select(F.col("place").alias("_place"), F.col("old_id").alias("_old"), F.posexplode(keys).alias("_at", "_key"))


def pictured(clones: DataFrame, images: DataFrame) -> DataFrame:
    """clones whose fill_paints show the picture that images (place, key, image, image_width, image_height) has under one of a node's keys.

    It takes the place of the first picture, filling as that did, or of all paints where there is none.
    """
    kinds = clones.schema["fill_paints"].dataType.elementType
    told = images.select(F.col("place").alias("_p"), F.col("key").alias("_k"), F.struct("image", F.col("image_width").cast("double").alias("image_width"), F.col("image_height").cast("double").alias("image_height")).alias("_i"))
    hit = _keyed(clones).join(told, (F.col("_place") == F.col("_p")) & (F.col("_key") == F.col("_k"))).groupBy("_place", "_old").agg(F.min_by("_i", "_at").alias("_image"))
    out = clones.join(hit, (F.col("place") == F.col("_place")) & (F.col("old_id") == F.col("_old")), "left")
    values = {"type": F.lit("IMAGE"), "visible": F.lit(True), "opacity": F.lit(1.0), "scale": F.lit(0.5), **{c: F.col("_image")[c] for c in ("image", "image_width", "image_height")}}
    if "mode" in kinds.names:
        before = F.get(F.filter("fill_paints", lambda p: p["type"] == "IMAGE"), F.lit(0))["mode"]
        values["mode"] = F.coalesce(before, F.lit(SCALE_MODE))
    paint = F.struct(*(values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds.fields))
    return out.withColumn("fill_paints", F.when(F.col("_image").isNotNull(), with_paint(F.col("fill_paints"), paint)).otherwise(F.col("fill_paints"))).drop("_place", "_old", "_image")


def filled(clones: DataFrame, texts: DataFrame) -> DataFrame:
    """clones with `text` replaced where texts (place, key, text) has a value under one of a node's keys; empty texts become a space.

    A layout and list lines that a replaced text had (baselines, glyphs, line_types, line_indents) go with it.
    """
    asked = _keyed(clones)
    values = texts.select(F.col("place").alias("_p"), F.col("key").alias("_k"), F.when(F.coalesce("text", F.lit("")) == "", " ").otherwise(F.col("text")).alias("_t"))
    hit = asked.join(values, (F.col("_place") == F.col("_p")) & (F.col("_key") == F.col("_k"))).groupBy("_place", "_old").agg(F.min_by("_t", "_at").alias("_text"))
    out = clones.join(hit, (F.col("place") == F.col("_place")) & (F.col("old_id") == F.col("_old")), "left")
    stale = [c for c in ("baselines", "glyphs", "line_types", "line_indents") if c in clones.columns]
    out = out.withColumns({c: F.when(F.col("_text").isNull(), F.col(c)) for c in stale})
    return out.withColumn("text", F.coalesce("_text", "text")).drop("_place", "_old", "_text")


def annotate(nodes: DataFrame, names: DataFrame, prefix: str) -> DataFrame:
    """nodes renamed to prefix + name by names (id, name); a prefix that a name has already is dropped. An unknown id is an error."""
    unknown = names.join(nodes.select("id"), "id", "left_anti").first()
    if unknown:
        raise ValueError(f"node not found: {unknown['id']}")
    new = names.select(F.col("id").alias("_id"), F.concat(F.lit(prefix), strip_prefix(F.col("name"))).alias("_name"))
    return nodes.join(new, F.col("id") == F.col("_id"), "left").withColumn("name", F.coalesce("_name", "name")).drop("_id", "_name")


def remove_slides(nodes: DataFrame, slides: DataFrame, all_children: bool = True) -> DataFrame:
    """nodes with slides (column id) marked as removed, with all their direct children, or with their first instance only."""
    below = nodes.join(slides.select(F.col("id").alias("pid")).distinct(), "pid", "left_semi")
    if not all_children:
        below = below.where("type = 'INSTANCE'").groupBy("pid").agg(F.min_by("id", "ord").alias("id"))
    gone = slides.select("id").unionByName(below.select("id")).distinct().select(F.col("id").alias("_gone"))
    out = nodes.join(gone, F.col("id") == F.col("_gone"), "left")
    return out.withColumn("phase", F.when(F.col("_gone").isNotNull(), "REMOVED").otherwise(F.col("phase"))).drop("_gone")


def slide_for_symbol(nodes: DataFrame) -> DataFrame:
    """(symbol_id, slide): the slide to copy for a new one of each symbol: the first live slide that uses it, else the document's first live slide."""
    slides = nodes.where("type = 'SLIDE'").where(is_live()).select("id", "ord")
    uses = nodes.where("type = 'INSTANCE'").select(F.col("pid").alias("_pid"), "symbol_id")
    by = slides.join(uses, F.col("id") == F.col("_pid")).groupBy("symbol_id").agg(F.min_by("id", "ord").alias("slide"))
    first = slides.agg(F.min_by("id", "ord")).first()[0]
    symbols = nodes.where("type = 'SYMBOL'").select(F.col("id").alias("_sid"))
    return symbols.join(by, F.col("_sid") == F.col("symbol_id"), "left").select(F.col("_sid").alias("symbol_id"), F.coalesce("slide", F.lit(first)).alias("slide"))


def with_paint(paints: Column, paint: Column) -> Column:
    """Paints with the first image paint replaced; without one, all are replaced."""
    at = F.array_position(F.transform(paints, lambda p: p["type"]), "IMAGE")
    return F.when(F.coalesce(at, F.lit(0)) == 0, F.array(paint)).otherwise(F.transform(paints, lambda p, i: F.when(i + 1 == at, paint).otherwise(p)))


def orphans(nodes: DataFrame) -> DataFrame:
    """Nodes but the document whose parent is missing, as after a prune."""
    return roots(nodes).where("pid is not null").select("id", "pid")


def import_blobs(uses: DataFrame, source: DataFrame, target: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(uses with new places of their byte strings, target with those appended).

    uses: place (of the import) and blob (a place in source); source and target: ix, bytes. Within one import a byte string is
    copied once; places that source does not have stay as they are.
    """
    have = source.select(F.col("ix").alias("blob"), "bytes")
    first = target.agg(F.coalesce(F.max("ix") + 1, F.lit(0))).first()[0]
    fresh = written(numbered(uses.select("place", "blob").distinct().join(have, "blob"), ["place", "blob"], "_new", first))
    named = fresh.select(F.col("place").alias("_place"), F.col("blob").alias("_blob"), "_new")
    out = uses.join(named, (F.col("place") == F.col("_place")) & (F.col("blob") == F.col("_blob")), "left")
    out = out.withColumn("blob", F.coalesce("_new", "blob")).select(*uses.columns)
    return out, target.unionByName(fresh.select(F.col("_new").alias("ix"), "bytes"))

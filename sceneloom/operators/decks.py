"""Slides made in bulk: blank ones, from symbols, by cloning, and whole decks from a description of their slides.

Asks have k, the order in which slides are made. Every call deals all ids at once and leaves its inputs as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sceneloom.functions.ranking import numbered
from sceneloom.functions.scalars import guid_id, position_char, strip_prefix
from sceneloom.functions.tables import written

from .catalog import active_slides
from .shapes import SESSION, add_shapes, paint
from .template import SLIDE_GAP, next_local, slide_for_symbol
from .tree import is_live, walk

#: A slide's size, and colours of decks by theme: dark, light, accent, text on dark, text on light.
SLIDE_SIZE = (1920.0, 1080.0)
THEMES = {
    "midnight": ("Black", "White", (0.792, 0.863, 0.988), "White", "Black"),
    "ocean": ("Blue", "Pale Blue", (0.129, 0.161, 0.361), "White", "Black"),
    "forest": ("Green", "Pale Green", (0.592, 0.737, 0.384), "White", "Black"),
    "coral": ("Persimmon", "Pale Persimmon", (0.184, 0.235, 0.494), "White", "Black"),
    "terracotta": ("Persimmon", "Pale Persimmon", (0.906, 0.910, 0.820), "White", "Black"),
    "minimal": ("Black", "White", (0.212, 0.271, 0.310), "White", "Black"),
}
DARK_TYPES = ("title", "closing", "stat", "image-full")


def seed_nodes(spark) -> DataFrame:
    """The nodes that a new document starts with: document, canvas, row, one blank slide, and the canvas for symbols and styles."""
    rows = [
        ("0:0", None, 0, "DOCUMENT", "Document", "!"), ("0:1", "0:0", 1, "CANVAS", "Page 1", "!"), ("0:2", "0:0", 2, "CANVAS", "Internal Only Canvas", '"'),
        ("0:3", "0:1", 3, "SLIDE_ROW", "Slide row", "!"), ("0:4", "0:3", 4, "SLIDE", "1", "!"),
    ]
    nodes = spark.createDataFrame([(*r, None, 0.0) for r in rows], "id string, pid string, ord bigint, type string, name string, position string, phase string, x double")
    size = lambda k: F.when(F.col("type") == "SLIDE", SLIDE_SIZE[k])
    return nodes.withColumns({"width": size(0), "height": size(1)})


def slide_size(nodes: DataFrame) -> DataFrame:
    """(width, height) of the first live slide, as one row; a slide's usual size where there is none or it has none."""
    first = nodes.where("type = 'SLIDE'").where(is_live()).agg(F.min_by(F.struct("width", "height"), "ord").alias("s"))
    return first.select(*(F.coalesce(f"s.{c}", F.lit(d)).alias(c) for c, d in zip(("width", "height"), SLIDE_SIZE)))


def nth(nodes: DataFrame, number: int, what: str = "slide") -> DataFrame:
    """The n-th (from 1) of the rows that active_slides or pages gives; a number outside is an error."""
    column = "slide_index" if "slide_index" in nodes.columns else "number"
    base = 1 if column == "slide_index" else 0
    found = nodes.where(F.col(column) + base == number)
    if found.isEmpty():
        raise IndexError(f"{what} {number} out of range (1 to {nodes.count()})")
    return found


def _new_rows(rows: DataFrame, nodes: DataFrame, changed: dict[str, Column]) -> DataFrame:
    """rows (columns of nodes and more) as rows of nodes, with some columns changed; those that nodes lacks are passed over."""
    return rows.select(*(changed.get(c, F.col(c)).cast(t).alias(c) for c, t in nodes.dtypes))


def add_blank_slides(nodes: DataFrame, asks: DataFrame, replace_seed: bool = False) -> DataFrame:
    """nodes with a blank slide for each of asks (k, name, may be null), copied from the first live slide; white, side by side.

    With replace_seed the document's first live slide and its children are marked as removed by the first
    new slide, as in a document just made: later ones count and copy what is live then. Without a live slide it is an error.
    """
    live = active_slides(nodes)
    first = written(live.where("slide_index < 2").orderBy("slide_index"))
    seeds = first.orderBy("slide_index").collect()  # two rows at most
    if not seeds:
        raise ValueError("no slide to copy")
    count, top = live.count(), nodes.agg(F.max("ord")).first()[0]
    rows = numbered(asks.select(F.col("k"), F.col("name").alias("_asked")), ["k"], "_i", 0)
    at = F.col("_i") + count - (F.when(F.col("_i") > 0, 1).otherwise(0) if replace_seed else 0)
    rows = rows.withColumn("_at", at)
    base = next_local(nodes)
    later = seeds[-1]["id"] if replace_seed else seeds[0]["id"]
    source = F.when(F.col("_i") == 0, seeds[0]["id"]).otherwise(later)
    copied = rows.withColumn("_source", source).join(F.broadcast(first), F.col("_source") == first["id"])
    new = _new_rows(copied, nodes, {
        "id": guid_id(F.lit(SESSION), F.col("_i") + base), "name": F.coalesce("_asked", (F.col("_at") + 1).cast("string")), "phase": F.lit("CREATED"),
        "ord": F.col("_i") + top + 1, "position": position_char(F.col("_at")), **_shifted(nodes, F.col("_at") * SLIDE_GAP), **_white(nodes),
    })
    if not replace_seed or asks.isEmpty():
        return nodes.unionByName(new)
    gone = F.col("id").eqNullSafe(seeds[0]["id"]) | F.col("pid").eqNullSafe(seeds[0]["id"])
    return nodes.withColumn("phase", F.when(gone, "REMOVED").otherwise(F.col("phase"))).unionByName(new)


def _shifted(nodes: DataFrame, x: Column) -> dict[str, Column]:
    """The change of a slide's place to x, in the column x or in its matrix."""
    if "transform" in nodes.columns:
        t = F.col("transform")
        return {"transform": F.when(t.isNotNull(), t.withField("m02", x.cast("double")))}
    return {"x": x} if "x" in nodes.columns else {}


def _white(nodes: DataFrame) -> dict[str, Column]:
    return {"fill_paints": F.array(paint(*(F.lit(1.0) for _ in "rgb")))} if "fill_paints" in nodes.columns else {}


def add_slides(nodes: DataFrame, asks: DataFrame) -> DataFrame:
    """nodes with a slide and its instance for each of asks (k, symbol, name and after, which may be null).

    The slide is copied from the first live one that uses the symbol, else from the first live one; so is its
    instance, where that has one, but for symbol and overrides. It stands last, or right after the live slide `after` (its
    position; positions of others stay). A symbol that is none is an error, and so is a document without a live slide.
    """
    live = active_slides(nodes).select(F.col("id").alias("_slide"), "slide_index")
    count, top, base = live.count(), nodes.agg(F.max("ord")).first()[0], next_local(nodes)
    if not count:
        raise ValueError("no slide to copy")
    symbols = nodes.where("type = 'SYMBOL'").select(F.col("id").alias("_symbol"), F.col("name").alias("_symbol_name"))
    source = slide_for_symbol(nodes).select(F.col("symbol_id").alias("_of"), F.col("slide").alias("_source"))
    rows = numbered(asks.select("k", "symbol", F.col("name").alias("_asked"), F.col("after").alias("_after")), ["k"], "_i", 0)
    rows = rows.join(symbols, F.col("symbol") == F.col("_symbol"), "left").join(source, F.col("symbol") == F.col("_of"), "left")
    rows = rows.join(live, F.col("_after") == F.col("_slide"), "left")
    lost = F.raise_error(F.concat(F.lit("no such symbol: "), F.col("symbol"))).cast("string")
    rows = rows.withColumn("_source", F.coalesce("_source", lost))
    called = F.coalesce("_asked", "_symbol_name", F.lit("New Slide"))
    at = F.when(F.col("_after").isNull(), F.col("_i") + count).otherwise(F.coalesce(F.col("slide_index") + 1, F.lit(0)))
    rows = rows.select("_i", F.col("symbol").alias("_to"), "_source", called.alias("_called"), at.alias("_at"))
    slide_id, instance_id = (guid_id(F.lit(SESSION), F.col("_i") * 2 + base + k) for k in (0, 1))
    slides = _new_rows(rows.join(nodes, F.col("_source") == nodes["id"]), nodes, {
        "id": slide_id, "name": F.col("_called"), "phase": F.lit("CREATED"), "ord": F.col("_i") * 2 + top + 1, "position": position_char(F.col("_at")),
        **_shifted(nodes, (F.col("_i") + count) * SLIDE_GAP),
    })
    first = nodes.where("type = 'INSTANCE'").groupBy(F.col("pid").alias("_parent")).agg(F.min_by(F.struct(*nodes.columns), "ord").alias("_x"))
    copied = rows.join(first, F.col("_source") == F.col("_parent"), "left").select("_i", "_to", "_called", "_x.*")
    instances = _new_rows(copied, nodes, {
        "id": instance_id, "pid": slide_id, "type": F.lit("INSTANCE"), "name": F.col("_called"), "phase": F.lit("CREATED"), "ord": F.col("_i") * 2 + top + 2,
        "position": F.lit("!"), "symbol_id": F.col("_to"),
    })
    return nodes.unionByName(slides).unionByName(instances)


def clone_slides(nodes: DataFrame, asks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with clones, (k, old, new) of every cloned node) for asks (k, slide, name).

    A clone has a new slide, a new first instance without overrides, the live subtrees of the slide's other live
    children, and a new module where the slide stands in one. Ids by k: module, slide, instance, then the
    rest in preorder. A slide without an instance is an error. Overrides for new instances are set by overrides.set_overrides.
    """
    count, top, base = active_slides(nodes).count(), nodes.agg(F.max("ord")).first()[0], next_local(nodes)
    up = nodes.select(F.col("id").alias("_up"), F.col("type").alias("_up_type"), F.col("pid").alias("_row"))
    first = nodes.where("type = 'INSTANCE'").groupBy(F.col("pid").alias("_pid")).agg(F.min_by("id", "ord").alias("_instance"))
    slides = nodes.where("type = 'SLIDE'").select(F.col("id").alias("slide"), F.col("pid").alias("_parent"))
    rows = numbered(asks.select("k", "slide", F.col("name").alias("_called")), ["k"], "_i", 0).join(slides, "slide", "left")
    rows = rows.join(up, F.col("_parent") == F.col("_up"), "left").join(first, F.col("slide") == F.col("_pid"), "left")
    lost = F.raise_error(F.concat(F.lit("no instance on slide "), F.col("slide"))).cast("string")
    rows = rows.withColumn("_instance", F.coalesce("_instance", lost)).withColumn("_module", F.coalesce(F.col("_up_type") == "MODULE", F.lit(False)))
    rows = written(rows.select("k", "_i", "slide", "_called", "_parent", "_row", "_instance", "_module"))
    part = lambda old, step, on=None: (rows if on is None else rows.where(on)).select("k", F.col(old).alias("old"), F.lit(step).alias("_step"), F.array().cast("array<bigint>").alias("path"))
    live = nodes.where(is_live())
    beside = live.join(rows.select("slide", "_instance").distinct(), (F.col("pid") == F.col("slide")) & (F.col("id") != F.col("_instance"))).select("id", "slide")
    below = walk(live, beside.select("id")).join(beside.select(F.col("id").alias("root"), "slide"), "root")
    rest = rows.select("k", "slide").join(below, "slide").select("k", F.col("id").alias("old"), F.lit(3).alias("_step"), "path")
    parts = part("_parent", 0, "_module").unionByName(part("slide", 1)).unionByName(part("_instance", 2)).unionByName(rest)
    parts = written(numbered(parts, ["k", "_step", "path"], "_local", base))
    ids = parts.select("k", "old", guid_id(F.lit(SESSION), F.col("_local")).alias("new"))
    asked = rows.select("k", "_i", "_called", "_row", "_module")
    out = parts.join(asked, "k").join(nodes, F.col("old") == nodes["id"])
    above = ids.select(F.col("k").alias("_k"), F.col("old").alias("_old"), F.col("new").alias("_new"))
    out = out.join(above, (F.col("k") == F.col("_k")) & (F.col("pid") == F.col("_old")), "left")
    is_top = F.when(F.col("_module"), F.col("_step") == 0).otherwise(F.col("_step") == 1)
    named, in_module = F.col("_step") < 3, F.col("_module") & (F.col("_step") == 1)
    place = F.when(is_top, position_char(F.col("_i") + count)).when(in_module | (F.col("_step") == 2), "!").otherwise(F.col("position"))
    changed = {
        "id": guid_id(F.lit(SESSION), F.col("_local")), "ord": F.col("_local") - base + top + 1, "phase": F.lit("CREATED"), "position": place,
        "pid": F.when(is_top & ~F.col("_module"), F.col("pid")).when(is_top, F.col("pid")).otherwise(F.coalesce("_new", "pid")),
        "name": F.when(named, F.col("_called")).otherwise(F.col("name")),
    }
    x = (F.col("_i") + count) * SLIDE_GAP
    for c, new in _shifted(nodes, F.when(in_module, 0).otherwise(x)).items():
        changed[c] = F.when(F.col("_step") < 2, new).otherwise(F.col(c))
    return nodes.unionByName(_new_rows(out, nodes, changed)), ids


def draft_template(spark, layouts: DataFrame) -> DataFrame:
    """Nodes of a new template with one blank slide for each of layouts (k, name), named as a layout; one called cover where there is none."""
    asks = layouts.select("k", F.concat(F.lit("layout:"), strip_prefix(F.col("name"))).alias("name"))
    if asks.isEmpty():
        asks = spark.createDataFrame([(0, "layout:cover")], "k bigint, name string")
    return add_blank_slides(seed_nodes(spark), asks, replace_seed=True)


def _ask(kind: str, on: Column, **columns: Column | float | str) -> Column:
    """One shape to be made where `on` holds, as a struct; null elsewhere."""
    texts, numbers = ("text", "style", "colour", "align", "image"), ("x", "y", "width", "height", "opacity")
    value = {c: columns.get(c) for c in (*texts, *numbers)}
    field = lambda c, t: (value[c] if isinstance(value[c], Column) else F.lit(value[c])).cast(t).alias(c)
    row = F.struct(F.lit(kind).alias("kind"), *(field(c, "string") for c in texts), *(field(c, "double") for c in numbers))
    return F.when(on, row)


def slide_shapes(specs: DataFrame, theme: str = "midnight") -> DataFrame:
    """specs with background and shapes (array of what add_shapes takes) of each described slide, by its type.

    Columns of specs: type (title, closing, bullets, two-column, stat, image-full), title, subtitle, body, bullets (array), stat,
    caption, image, left_text, right_text, background. Unknown themes are the first; bullets stand 80 apart from 240 on.
    """
    dark, light, accent, on_dark, on_light = THEMES.get(theme, THEMES["midnight"])
    accent = "#" + "".join(f"{int(c * 255 + 0.5):02x}" for c in accent)
    kind = F.col("type")
    is_dark = kind.isin(*DARK_TYPES)
    text_colour = F.when(is_dark, on_dark).otherwise(on_light)
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    of = lambda *kinds: kind.isin(*kinds)

    def says(on: Column, c: str, style: str, y: float, align: str, x: float = 80, width: float = 1760, colour: Column | str = text_colour) -> Column:
        return _ask("TEXT", on & has(c), text=F.col(c), style=style, x=x, y=y, width=width, align=align, colour=colour)

    def box(on: Column, x: float, y: float, width: float, height: float, colour: str = accent, **more: float) -> Column:
        return _ask("RECTANGLE", on, x=x, y=y, width=width, height=height, colour=colour, **more)

    cover, columns, stat, full = of("title", "closing"), of("two-column"), of("stat"), of("image-full")
    listed = F.coalesce("bullets", F.when(has("body"), F.split("body", "\n")), F.array().cast("array<string>"))
    y_of = lambda i: F.lit(240) + i * 80
    item = lambda t, i: F.array(
        _ask("RECTANGLE", F.lit(True), x=80, y=y_of(i) + 10, width=12, height=12, colour=accent),
        _ask("TEXT", F.lit(True), text=t, style="Body 1", x=116, y=y_of(i), width=1724, align="LEFT", colour=text_colour),
    )
    bullets = F.when(of("bullets"), F.flatten(F.transform(listed, item)))
    caption = full & (has("title") | has("body"))
    head = F.array_compact(F.array(
        box(~full, 0, 0, 1920, 8), says(cover, "title", "Title", 360, "CENTER"), says(cover, "subtitle", "Body 1", 540, "CENTER"),
        says(of("bullets", "two-column", "stat"), "title", "Header 2", 80, "LEFT"),
    ))
    tail = F.array_compact(F.array(
        box(columns, 960, 200, 4, 800), says(columns, "left_text", "Body 1", 240, "LEFT", width=840), says(columns, "right_text", "Body 1", 240, "LEFT", 1004, 836),
        _ask("IMAGE", columns & has("image"), image=F.col("image"), x=1004, y=200, width=836, height=800),
        says(stat, "stat", "Title", 300, "CENTER"), says(stat, "caption", "Body 1", 720, "CENTER"),
        _ask("IMAGE", full & has("image"), image=F.col("image"), x=0, y=0, width=1920, height=1080),
        box(caption, 0, 680, 1920, 400, "#000000", opacity=0.7), says(full, "title", "Header 1", 720, "LEFT", colour="White"), says(full, "body", "Body 1", 880, "LEFT", colour="White"),
    ))
    ground = F.coalesce("background", F.when(is_dark, dark).otherwise(light))
    return specs.withColumns({"background": ground, "shapes": F.concat(head, F.coalesce(bullets, F.slice(head, 1, 0)), tail)})


def create_deck(spark, specs: DataFrame, styles: DataFrame, variables: DataFrame, theme: str = "midnight") -> tuple[DataFrame, DataFrame]:
    """(nodes of a new document with a blank slide for each of specs, shapes on them): slides by k, shapes in order of slide and place.

    styles: nodes of text styles, variables: colours by name (shapes.text_styles, shapes.resolve_colours). Backgrounds come as shapes of
    kind BACKGROUND in no list: the column background of slide_shapes is for shapes.set_background.
    """
    told = slide_shapes(specs, theme)
    slides = add_blank_slides(seed_nodes(spark), specs.select("k", F.lit(None).cast("string").alias("name")), replace_seed=True)
    made = slides.where("type = 'SLIDE' and phase = 'CREATED'").select(F.col("id").alias("parent"), "ord")
    order = numbered(specs.select("k"), ["k"], "_i", 0)
    made = numbered(made, ["ord"], "_i", 0).select("parent", "_i").join(order, "_i")
    asks = told.select("k", F.posexplode("shapes").alias("_place", "s")).join(made, "k").select("parent", "_i", "_place", "s.*")
    asks = numbered(asks, ["_i", "_place"], "k", 0)
    every = slides.unionByName(styles, allowMissingColumns=True)
    return slides, add_shapes(every, asks, variables)

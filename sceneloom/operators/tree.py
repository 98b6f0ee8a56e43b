"""Traversal of node tables (id, pid, ord, type, name, phase, ...).

Whole subtrees are walked by doubling: every node knows a stretch of the way up from it, and each round joins it to the
stretch above, so a tree of depth n takes about log2(n) joins.  Walks to a given depth and those through instances go level by level, one join of the frontier
each.  Rounds and levels are written out: depth does not pile up in the plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sceneloom.functions.tables import drop_written, tasks, written


def is_live() -> Column:
    """Not removed; an absent phase is live."""
    return ~F.col("phase").eqNullSafe("REMOVED")


def roots(nodes: DataFrame) -> DataFrame:
    """Nodes without a parent, or whose parent is missing."""
    ids = nodes.select(F.col("id").alias("_id"))
    return nodes.join(ids, nodes["pid"] == F.col("_id"), "left_anti")


def walk(nodes: DataFrame, start: DataFrame, max_depth: int | None = None, skip_removed: bool = False, path: bool = True, ids: bool = False, full: bool = False) -> DataFrame:
    """(root, id, pid, depth, path) of all nodes below each start node (column id), itself at depth 0.

    path is the array of ord from the root (with ids, of (ord, id)): ordering by (root, path) is preorder; without it, path is left
    out; full (only without max_depth) adds whether a node has something below it. max_depth and skip_removed prune: what lies below is not visited. A node has one parent (where an
    id repeats, its last row's), so a walk can come back to its root only, and there it ends. A chain of 10,000 nodes takes 14 joins.
    """
    kept = nodes.where(is_live()) if skip_removed else nodes
    slim = kept.groupBy("id").agg(F.max_by(F.struct("pid", "ord"), "ord").alias("x")).select("id", "x.pid", "x.ord")
    found = _ways_up(slim, start) if max_depth is None or max_depth > 2 else _levels(slim, start, max_depth)
    found = found if full else found.drop("full")
    found = found if max_depth is None else found.where(F.col("depth") <= max_depth)
    if not path:
        return found.drop("path")
    return found if ids else found.withColumn("path", F.transform("path", lambda x: x["ord"]))


def _ways_up(slim: DataFrame, start: DataFrame) -> DataFrame:
    """(root, id, pid, depth, path, full) by doubling; path has (ord, id). way: the nodes from just below `above` down to a node; above is null at the top, or
    where a way comes back to a node that is on it. Only nodes with something below take part in the rounds; the others follow their parents at the end."""
    tops = start.select(F.col("id").alias("_top")).distinct()
    step = F.struct(F.col("ord").cast("long").alias("ord"), "id", F.col("_top").isNotNull().alias("top"))
    parents = slim.where("pid is not null").select(F.col("pid").alias("_parent")).distinct().withColumn("_full", F.lit(True))
    slim = slim.join(tops, F.col("id") == F.col("_top"), "left").join(parents, F.col("id") == F.col("_parent"), "left")
    slim = written(slim.select("id", "pid", F.array(step).alias("way"), F.col("_full").isNotNull().alias("full")))
    state = written(slim.where("full").select("id", "pid", F.when(F.col("pid") != F.col("id"), F.col("pid")).alias("above"), "way"))
    while not state.where("above is not null").isEmpty():
        up = state.select(F.col("id").alias("_id"), F.col("above").alias("_above"), F.col("way").alias("_way"))
        both = state.join(up, F.col("above") == F.col("_id"), "left")
        longer = both.select("id", "pid", "_above", F.when(F.col("_id").isNotNull(), F.concat("_way", "way")).otherwise(F.col("way")).alias("way"))
        back = F.exists("way", lambda x: x["id"] == F.col("_above"))
        new = written(longer.select("id", "pid", F.when(~back, F.col("_above")).alias("above"), "way"))
        drop_written(state)
        state = new
    up = state.select(F.col("id").alias("_id"), F.col("way").alias("_way"))
    leaves = slim.where("not full").join(up, F.col("pid") == F.col("_id"), "left").select("id", "pid", "full", F.when(F.col("_id").isNotNull(), F.concat("_way", "way")).otherwise(F.col("way")).alias("way"))
    state = state.select("id", "pid", F.lit(True).alias("full"), "way").unionByName(leaves)
    last = F.size("way")
    later = lambda x, i: F.exists(F.slice("way", i + 2, F.greatest(last - i - 1, F.lit(0))), lambda y: y["id"] == x["id"])  # noqa: E731  on a cycle
    at = F.filter(F.transform("way", lambda x, i: F.when(x["top"] & ~later(x, i), i)), lambda i: i.isNotNull())
    rows = state.select("id", "pid", "full", "way", F.explode(at).alias("_at"))
    path = F.transform(F.slice("way", F.col("_at") + 1, last - F.col("_at")), lambda x: F.struct(x["ord"].alias("ord"), x["id"].alias("id")))
    return rows.select(F.element_at("way", F.col("_at") + 1)["id"].alias("root"), "id", "pid", (last - 1 - F.col("_at")).alias("depth"), path.alias("path"), "full")


def _levels(slim: DataFrame, start: DataFrame, max_depth: int) -> DataFrame:
    """The same, down to a small depth, level by level."""
    slim = written(slim)  # read once per level
    step = F.struct(F.col("ord").cast("long").alias("ord"), "id")
    level = start.select(F.col("id").alias("root")).distinct().join(slim, F.col("root") == F.col("id")).select("root", "id", "pid", F.lit(0).alias("depth"), F.array(step).alias("path"))
    level = seen = written(level)
    below = slim.where("pid is not null").select(F.col("id").alias("child"), F.col("pid").alias("parent"), step.alias("o"))
    for depth in range(1, max_depth + 1):
        rows = level.join(below, (F.col("id") == F.col("parent")) & (F.col("child") != F.col("root")))
        level = written(rows.select("root", F.col("child").alias("id"), F.col("parent").alias("pid"), F.lit(depth).alias("depth"), F.concat("path", F.array("o")).alias("path")))
        seen = seen.unionByName(level)
    drop_written(slim)
    return seen


def walk_links(nodes: DataFrame, start: DataFrame, skip_removed: bool = True, enter_symbol: bool = False, wanted: Column | None = None) -> DataFrame:
    """(root, id, depth, path) of all nodes below each start node, through instances into their symbols.

    An instance's symbol's children come before its own (with enter_symbol, the symbol itself does). A
    node counts once per root, at its first place in preorder: ordering by (root, path) is preorder.
    skip_removed prunes. Per level and root each node keeps its first path only, and a path never meets a
    node twice, so diamonds do not multiply and cycles end. A node's own children have that one way to it, so
    those with nothing below them take no part in the rounds.

    wanted (a condition on nodes): rows of nodes that do not meet it may be left out; links that lead to none of them are not walked.
    """
    keep = F.lit(True) if wanted is None else F.coalesce(wanted, F.lit(False))
    kept = (nodes.where(is_live()) if skip_removed else nodes).select("id", "pid", "ord", "type", "symbol_id", keep.alias("wanted"))
    own = kept.where("pid is not null").select(F.col("pid").alias("parent"), F.col("id").alias("child"), F.lit(1).cast("long").alias("kind"), F.col("ord").alias("o"), "wanted")
    uses = kept.where("type = 'INSTANCE' and symbol_id is not null").select(F.col("id").alias("parent"), "symbol_id")
    inside = kept.select("id", (F.col("id") if enter_symbol else F.col("pid")).alias("_of"), "ord", "type", "wanted")
    if wanted is not None and enter_symbol:  # symbols without anything in them
        some = own.select(F.col("parent").alias("_some")).distinct()
        inside = inside.join(some, F.col("id") == F.col("_some"), "left").where("wanted or type = 'INSTANCE' or _some is not null")
    linked = uses.join(inside, F.col("symbol_id") == F.col("_of")).select("parent", F.col("id").alias("child"), F.lit(0).cast("long").alias("kind"), F.col("ord").alias("o"), "wanted")
    steps = _leading(written(own.unionByName(linked)), wanted is not None)
    level = start.select(F.col("id").alias("root")).distinct().join(kept.select(F.col("id").alias("root"), "ord"), "root")
    level = level.groupBy("root").agg(F.min(F.struct("ord")).alias("x"))
    level = written(level.select("root", F.col("root").alias("id"), F.lit(0).alias("depth"), F.array(F.lit(1).cast("long"), "x.ord").alias("path"), F.array("root").alias("ids")))
    found = level.drop("ids")
    while not level.isEmpty():
        below = level.join(steps, level["id"] == steps["parent"]).where(~F.array_contains("ids", F.col("child")))
        ids = F.when(F.col("full"), F.concat("ids", F.array("child")))
        below = written(below.select("root", F.col("child").alias("id"), (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("kind", "o")).alias("path"), ids.alias("ids"), (F.col("full") | (F.col("kind") == 0)).alias("meets")))
        first = below.where("meets").groupBy("root", "id").agg(F.min(F.struct("path", "ids", "depth")).alias("x"))
        first = written(first.select("root", "id", "x.depth", "x.path", "x.ids"))
        found = found.unionByName(below.where("not meets").drop("ids", "meets")).unionByName(first.drop("ids"))
        level = first.where("ids is not null")
    first = found.groupBy("root", "id").agg(F.min(F.struct("path", "depth")).alias("x"))
    return first.select("root", "id", "x.depth", "x.path")


def _leading(steps: DataFrame, prune: bool) -> DataFrame:
    """steps with `full`: whether there may be steps from the child on. With prune, those to unwanted children without any go, again and again as long as that leaves less than a third."""
    n = steps.count() if prune else 0
    while True:
        on = steps.select(F.col("parent").alias("_on")).distinct()
        marked = steps.drop("full").join(on, F.col("child") == F.col("_on"), "left").withColumn("full", F.col("_on").isNotNull()).drop("_on")
        marked = written(marked.where("wanted or full") if prune else marked)
        drop_written(steps)
        steps, before = marked, n
        n = steps.count() if prune else 0
        if 3 * n >= before:
            return steps


#: Stands for the children's texts while a node's own is made.
INNER = "\x00inner\x00"


def fold_up(nodes: DataFrame, start: DataFrame, own: Callable[[DataFrame], DataFrame], skip_removed: bool = True) -> DataFrame:
    """(root, id, text) of each start node: its subtree's texts, each around its children's.

    own adds the column text to nodes, which have all their columns, root and inner: the children's texts in order (ord, then id), without
    null and empty ones, joined by line ends. It puts inner into text once and unchanged, or not at all (then nothing below
    the node counts); whether inner is empty may change the rest.

    All nodes are made at once: those with something below them both with a mark for inner and without, as something below counts or not. What stands
    before the mark opens a node and what stands behind closes it; a root's text is its pieces in order of their bracketed paths. No level loop but the
    walk's, which only nodes with something below take part in: the others meet their parents' paths once, by rows dealt out by parent, and go on to their
    root as one row a parent, which has the path once. Nodes are written once, with what the walk needs, and dealt out by rows, so that tasks do not grow
    with the document.
    """
    n = tasks(nodes)
    live = is_live() if skip_removed else F.lit(True)
    parents = nodes.where(live & F.col("pid").isNotNull()).select(F.col("pid").alias("_parent")).distinct()
    same = Window.partitionBy("id")  # where an id repeats, its last row's place counts
    rows = nodes.repartition(n, "id").join(parents.repartition(n, "_parent"), F.col("id") == F.col("_parent"), "left").withColumn("_last", F.max_by(F.struct("pid", "ord"), F.when(live, F.col("ord"))).over(same))
    rows = rows.withColumn("_live", F.max(live).over(same)).where("_live")
    rows = written(rows.select(*nodes.columns, F.col("_last.pid").alias("_pid"), F.col("_last.ord").cast("long").alias("_ord"), F.col("_parent").isNotNull().alias("_inside")))
    inner, outer, tops = rows.where("_inside"), rows.where("not _inside"), start.select(F.col("id").alias("_top")).distinct()
    ways = written(walk(inner.select("id", F.col("_pid").alias("pid"), F.col("_ord").alias("ord")), start, ids=True).select("root", F.col("id").alias("_way"), "path"))
    said = lambda df: own(df).withColumn("text", F.coalesce("text", F.lit("")))
    forms = inner.repartition(n, "id").join(ways.repartition(n, "_way"), F.col("id") == F.col("_way")).withColumn("_around", F.explode(F.array(F.lit(False), F.lit(True))))
    made = written(said(forms.withColumn("inner", F.when(F.col("_around"), INNER).otherwise(""))).select("root", "id", "path", F.col("_around").alias("around"), "text"))
    plain = lambda df: said(df.withColumn("inner", F.lit("")))
    some = lambda parts: F.filter(parts, lambda p: p["text"] != "")  # noqa: E731  not a filter on text: it would be made twice
    below = plain(outer.repartition(n, "_pid").join(ways.repartition(n, "_way"), F.col("_pid") == F.col("_way")))
    part = F.struct(F.col("_ord").alias("ord"), "id", "text")
    runs = below.groupBy("root", "_way").agg(F.first("path").alias("path"), some(F.collect_list(part)).alias("parts")).where(F.size("parts") > 0)
    alone = outer.join(tops, F.col("id") == F.col("_top"), "left_semi").withColumn("root", F.col("id"))
    single = plain(alone).select("root", F.lit(None).cast(ways.schema["_way"].dataType).alias("_way"), F.array().cast(ways.schema["path"].dataType).alias("path"), some(F.array(part)).alias("parts"))
    runs = written(runs.unionByName(single))
    shows = F.col("text").contains(INNER)
    ids = lambda path: F.transform(path, lambda x: x["id"])
    above = ids(F.slice("path", 1, F.size("path") - 1))
    closed = made.where(F.col("around") & ~shows).select(F.col("root").alias("_root"), F.col("id").alias("_closed"))
    seen = made
    if not closed.isEmpty():  # nodes that do not show what is below them
        within = lambda df, key, path: df.select("root", key, F.explode(path).alias("_above")).join(closed, (F.col("root") == F.col("_root")) & (F.col("_above") == F.col("_closed"))).select("root", key).distinct()
        seen = written(made.join(within(made.where("not around"), "id", above), ["root", "id"], "left_anti"))
        runs = written(runs.join(within(runs, "_way", ids("path")), ["root", "_way"], "left_anti"))
    # a node has something inside if a node below it counts by itself
    counts = seen.where("not around and text <> ''").select("root", F.explode(above).alias("_id")).unionByName(runs.select("root", F.explode(ids("path")).alias("_id")))
    filled = counts.select(F.col("root").alias("_root"), "_id").distinct().withColumn("_filled", F.lit(True))
    inside = seen.join(filled, (F.col("root") == F.col("_root")) & (F.col("id") == F.col("_id")), "left").where(F.col("around") == F.coalesce("_filled", F.lit(False))).where("text <> ''")
    drawn = inside.select("root", "path", "around", "text", F.lit(None).cast(runs.schema["parts"].dataType).alias("parts"))
    drawn = drawn.unionByName(runs.select("root", "path", F.lit(False).alias("around"), F.lit(None).cast("string").alias("text"), "parts")).repartition(n, "root")
    half = lambda k: F.split_part("text", F.lit(INNER), F.lit(k))
    piece = lambda path, kind, said: F.struct(path.alias("path"), F.lit(kind).alias("kind"), said.alias("said"))
    end = F.concat("path", F.array(F.struct(F.lit((1 << 63) - 1).alias("ord"), F.lit("").alias("id"))))
    each = F.transform("parts", lambda p: piece(F.concat("path", F.array(F.struct(p["ord"].alias("ord"), p["id"].alias("id")))), "whole", p["text"]))
    pieces = F.when(F.col("parts").isNotNull(), each).when(F.col("around"), F.array(piece(F.col("path"), "opens", half(1)), piece(end, "closes", half(2)))).otherwise(F.array(piece(F.col("path"), "whole", F.col("text"))))
    whole = drawn.select("root", F.explode(pieces).alias("_p")).groupBy(F.col("root").alias("_root")).agg(F.array_sort(F.collect_list("_p")).alias("_ps"))
    # siblings are apart: what follows the piece that opens a node is its first child
    apart = lambda p, i: F.when((i == 0) | (p["kind"] == "closes") | (F.get("_ps", i - 1)["kind"] == "opens"), "").otherwise("\n")
    whole = whole.select("_root", F.array_join(F.transform("_ps", lambda p, i: F.concat(apart(p, i), p["said"])), "").alias("text"))
    found = made.where(~F.col("around") & (F.size("path") == 1)).select("root", "id").unionByName(alone.select("root", "id"))
    return found.join(whole, F.col("root") == F.col("_root"), "left").select("root", "id", F.coalesce("text", F.lit("")).alias("text"))


def override_targets(nodes: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol, override_key, id): what an override key means inside each symbol; where keys repeat, the last in preorder."""
    below = walk(nodes, symbols).where("depth > 0").join(nodes.where("override_key is not null").select("id", "override_key"), "id")
    return below.groupBy(F.col("root").alias("symbol"), "override_key").agg(F.max_by("id", "path").alias("id"))


def ancestor_of_type(nodes: DataFrame, start: DataFrame, kind: str) -> DataFrame:
    """(id, ancestor): the nearest ancestor of the given type of each start node (column id); null if none, as on a cycle.

    Each level is one join of what still searches; the ids on the way tell a cycle.
    """
    slim = nodes.select(F.col("id").alias("nid"), F.col("pid").alias("up"), F.col("type").alias("kind"))
    level = written(start.select("id").distinct()).join(slim, F.col("id") == F.col("nid"))  # written, so that few meet all nodes without a shuffle
    level = written(level.select("id", F.col("up").alias("at"), F.array("id").alias("way")))
    found = None
    while True:
        here = level.join(slim, level["at"] == slim["nid"])
        hit = here.where(F.col("kind") == kind).select("id", F.col("nid").alias("ancestor"))
        found = hit if found is None else found.unionByName(hit)
        rest = here.where(~F.col("kind").eqNullSafe(kind)).where("up is not null").where(~F.array_contains("way", F.col("up")))
        level = written(rest.select("id", F.col("up").alias("at"), F.concat("way", F.array("at")).alias("way")))
        if level.isEmpty():
            return start.select("id").distinct().join(found, "id", "left")


def tree_lines(nodes: DataFrame, walked: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(root, path, id, line): the indented listing: type, name, id, removed mark, symbol and the number of overrides (inst_id)."""
    n = nodes.select("id", "type", "name", "phase", "symbol_id")
    n = n.withColumn("_overrides", F.lit(None).cast("long")) if overrides is None else n.join(overrides.groupBy(F.col("inst_id").alias("id")).agg(F.count(F.lit(1)).alias("_overrides")), "id", "left")
    removed = F.when(F.col("phase") == "REMOVED", F.lit(" [REMOVED]")).otherwise(F.lit(""))
    symbol = F.when(F.col("symbol_id").isNotNull(), F.concat(F.lit(" sym="), "symbol_id")).otherwise(F.lit(""))
    count = F.coalesce(F.concat(F.lit(" overrides="), "_overrides"), F.lit(""))
    name = F.when(F.coalesce("name", F.lit("")) == "", "").otherwise(F.concat(F.lit('"'), "name", F.lit('"')))
    line = F.concat(F.expr("repeat('  ', depth)"), F.coalesce(F.nullif("type", F.lit("")), F.lit("?")), F.lit(" "), name, F.lit(" ("), "id", F.lit(")"), removed, symbol, count)
    return walked.join(n, "id").select("root", "path", "id", line.alias("line"))


def children_count(nodes: DataFrame) -> DataFrame:
    """(id, n_children, n_live) of every node."""
    counts = nodes.groupBy("pid").agg(F.count(F.lit(1)).alias("n_children"), F.count_if(is_live()).alias("n_live")).withColumnRenamed("pid", "_pid")
    out = nodes.join(counts, nodes["id"] == F.col("_pid"), "left")
    return out.select("id", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_live", F.lit(0)).alias("n_live"))


def live_children(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """The live direct children of parents (column id), all their columns."""
    return nodes.where(is_live()).join(parents.select(F.col("id").alias("pid")).distinct(), "pid", "left_semi")


def first_child(nodes: DataFrame, parents: DataFrame, kind: str) -> DataFrame:
    """(id, child): the first child of a type, by ord, of each parent; null if none."""
    of = nodes.where(F.col("type") == kind).groupBy("pid").agg(F.min_by("id", "ord").alias("child"))
    return parents.select("id").join(of.withColumnRenamed("pid", "id"), "id", "left")

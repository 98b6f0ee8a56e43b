"""Edits as new node tables: inputs are never changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sceneloom.functions.ranking import numbered, numbered_within
from sceneloom.functions.scalars import blank_as_space, position_char
from sceneloom.functions.tables import spread


def soft_delete(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """nodes with those of `ids` (column id) marked as removed and, where nodes have the column, without their interactions."""
    gone = ids.select(F.col("id").alias("_gone")).distinct()
    out = nodes.join(gone, nodes["id"] == F.col("_gone"), "left")
    if "interactions" in nodes.columns:
        out = out.withColumn("interactions", F.when(F.col("_gone").isNull(), F.col("interactions")))
    return out.withColumn("phase", F.when(F.col("_gone").isNotNull(), "REMOVED").otherwise(F.col("phase"))).drop("_gone")


def upsert_text(overrides: DataFrame, changes: DataFrame) -> DataFrame:
    """overrides (inst_id, ov_ix, key, text) with the texts of changes (inst_id, key, text): the first override of a key is set, missing ones are appended. Empty texts become a space."""
    new = changes.select(F.col("inst_id").alias("_i"), F.col("key").alias("_k"), blank_as_space(F.col("text")).alias("_t"))
    w = Window.partitionBy("inst_id", "key").orderBy("ov_ix")
    old = overrides.withColumn("_n", F.row_number().over(w))
    hit = (F.col("inst_id") == F.col("_i")) & (F.col("key") == F.col("_k")) & (F.col("_n") == 1)
    kept = old.join(new, hit, "left").withColumn("text", F.coalesce("_t", "text")).select(*overrides.columns)
    last = overrides.groupBy("inst_id").agg(F.max("ov_ix").alias("_last")).withColumnRenamed("inst_id", "_inst")
    fresh = new.join(overrides.select("inst_id", "key"), (F.col("_i") == F.col("inst_id")) & (F.col("_k") == F.col("key")), "left_anti").join(last, F.col("_i") == F.col("_inst"), "left")
    ix = F.coalesce("_last", F.lit(0)) + F.row_number().over(Window.partitionBy("_i").orderBy("_k"))
    fresh = fresh.select(F.col("_i").alias("inst_id"), ix.cast(dict(overrides.dtypes)["ov_ix"]).alias("ov_ix"), F.col("_k").alias("key"), F.col("_t").alias("text"))
    return kept.unionByName(fresh)


def move_to_front(nodes: DataFrame, moved: str, order: str = "ord") -> DataFrame:
    """Siblings (pid, id) with a new position each: the rows whose `moved` is true come first, the others keep their order."""
    w = Window.partitionBy("pid").orderBy(F.col(moved).desc(), order)
    rank = F.row_number().over(w) - 1
    return nodes.withColumn("place", rank).withColumn("position", position_char(F.col("place")))


def move_nodes(nodes: DataFrame, moves: DataFrame, order: str = "ord") -> DataFrame:
    """nodes with place (from 0, among the siblings of a parent) and position, after moves (id, to_index) have been made.

    A moved node takes to_index among its siblings, of which nodes has those that count (live ones); from the end where it is negative, and no further than either
    end. The others keep their order around it. Of moves to one place, or to ones that are taken, the first by order is first and the
    rest follow. Moves that name no node are passed over; of several for one node one with the largest place counts. Every sibling gets a position anew. Rows are numbered by
    ranges, so a parent with most of the nodes is no single task.
    """
    to = moves.groupBy(F.col("id").alias("_moved")).agg(F.max("to_index").alias("_to"))
    told = nodes.join(to, nodes["id"] == F.col("_moved"), "left").drop("_moved")
    size = told.groupBy(F.col("pid").alias("_pid")).agg(F.count_if(F.col("_to").isNull()).alias("_others"))
    told = told.join(size, F.col("pid").eqNullSafe(F.col("_pid"))).drop("_pid")
    wish = F.when(F.col("_to") < 0, F.greatest(F.col("_to") + F.col("_others"), F.lit(0))).otherwise(F.col("_to"))
    moved = told.where("_to is not null").withColumn("_to", wish)
    moved = moved.withColumn("_j", F.row_number().over(Window.partitionBy("pid").orderBy("_to", order, "id")) - 1)
    # the moved node j lands behind so many others that it keeps its place, once those moved before it are there
    behind = F.max(F.col("_to") - F.col("_j")).over(Window.partitionBy("pid").orderBy("_j"))
    moved = moved.withColumn("_behind", F.least(behind, F.col("_others")).cast("long"))
    others = numbered_within(told.where("_to is null"), "pid", [order, "id"], "_behind").withColumn("_j", F.lit(None).cast("int"))
    both = moved.select(*nodes.columns, "_behind", "_j").unionByName(others.select(*nodes.columns, "_behind", "_j"))
    both = both.withColumn("_last", F.coalesce("_j", F.lit((1 << 31) - 1)))  # of what stands behind so many others, moved nodes are first
    out = numbered_within(both, "pid", ["_behind", "_last"], "place")
    return out.withColumn("position", position_char(F.col("place"))).select(*nodes.columns, *({"place", "position"} - set(nodes.columns)))


def allocate_ids(nodes: DataFrame, start: int, session: int) -> DataFrame:
    """(old, new) ids for nodes in order: "session:start + 1", ..."""
    rows = numbered(nodes.select("id", "ord"), ["ord"], "n", start + 1)
    return rows.select(F.col("id").alias("old"), F.concat(F.lit(f"{session}:"), F.col("n").cast("string")).alias("new"))


def remap(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """nodes with id, pid and symbol_id replaced where ids (old, new) has them, and the phase set to CREATED.

    ids grow with the document, so they are merged, not broadcast; nodes that refer to nothing are spread by their ids.
    """
    out = nodes
    for c in ("id", "pid", "symbol_id"):
        m = ids.select(F.col("old").alias("_old"), F.col("new").alias("_new")).hint("shuffle_merge")
        out = out.join(m, (F.coalesce(c, F.concat(F.lit("\0"), "id")) if c != "id" else out[c]) == F.col("_old"), "left").withColumn(c, F.coalesce("_new", c)).drop("_old", "_new")
    return out.withColumn("phase", F.lit("CREATED"))


def import_plan(source: DataFrame, target: DataFrame) -> DataFrame:
    """(id, component_key, action): symbols of source that target already has by component_key are mapped, the first of each other key is imported, the rest map to it."""
    have = target.where("component_key is not null").select(F.col("component_key").alias("_key")).distinct()
    rows = source.join(have, source["component_key"] == F.col("_key"), "left")
    first = F.row_number().over(Window.partitionBy("component_key").orderBy("ord")) == 1
    action = F.when(F.col("_key").isNotNull(), "map").when(first | F.col("component_key").isNull(), "import").otherwise("map")
    return rows.select("id", "component_key", action.alias("action"))


def prune(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """nodes without those of ids. These may be most of the nodes: both are merged in shares of so many rows."""
    return spread(nodes, "id").join(ids.select("id").hint("shuffle_merge"), "id", "left_anti")


def put_images(images: DataFrame, new: DataFrame) -> DataFrame:
    """images (sha1, bytes) with those of new (bytes) that are not there yet, each once."""
    fresh = new.select(F.sha1("bytes").alias("sha1"), "bytes").dropDuplicates(["sha1"]).join(images, "sha1", "left_anti")
    return images.unionByName(fresh)


def table_cells(table_id: str, rows: list[list[str]], df_of) -> DataFrame:
    """Override rows (row, col, key, text) of a table; an empty table is an error."""
    if not rows or not rows[0]:
        raise ValueError("a table needs at least one cell")
    cells = [(r, c, f"{table_id}>{r}>{c}", t) for r, line in enumerate(rows) for c, t in enumerate(line)]
    return df_of(cells, "row int, col int, key string, text string").withColumn("text", blank_as_space(F.col("text")))


def reversed_ids(ids: DataFrame) -> DataFrame:
    """(new, old) of (old, new): where several old ids have one new id, the last by id."""
    return ids.groupBy("new").agg(F.max("old").alias("old"))

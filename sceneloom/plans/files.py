"""Registered queries that go through document files: tables to files, files to tables, edits, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneloom.functions.tables import written
from sceneloom.sources import archive

from .catalogue import query
from .graph import table

#: The record types of the documents made here.
SCHEMA = {
    "NodeType": ("ENUM", [(n, None, False, k + 1) for k, n in enumerate(("SLIDE_ROW", "SLIDE", "TEXT", "INSTANCE", "SYMBOL"))]),
    "NodePhase": ("ENUM", [("CREATED", None, False, 0), ("REMOVED", None, False, 1)]),
    "GUID": ("STRUCT", [("sessionID", "uint", False, 0), ("localID", "uint", False, 0)]),
    "Parent": ("STRUCT", [("guid", "GUID", False, 0), ("position", "string", False, 0)]),
    "Vector": ("STRUCT", [("x", "float", False, 0), ("y", "float", False, 0)]),
    "Text": ("MESSAGE", [("characters", "string", False, 1)]),
    "Node": ("MESSAGE", [
        ("guid", "GUID", False, 1), ("parentIndex", "Parent", False, 2), ("type", "NodeType", False, 3), ("name", "string", False, 4), ("phase", "NodePhase", False, 5),
        ("opacity", "float", False, 6), ("visible", "bool", False, 7), ("size", "Vector", False, 8), ("textData", "Text", False, 9), ("hash", "byte", True, 10), ("strokeWeight", "float", False, 11),
    ]),
    "Message": ("MESSAGE", [("nodeChanges", "Node", True, 1), ("blobs", "byte", True, 2)]),
}
COLUMNS = [c.split() for c in archive.NODES.split(", ")]


def documents(spark, d: str) -> DataFrame:
    """A document for each nation: its row, its customers' slides, and a text for each order."""

    def part(df: DataFrame, **columns) -> DataFrame:
        return df.select(*(columns[c].cast(t).alias(c) if c in columns else F.lit(None).cast(t).alias(c) for c, t in COLUMNS))

    path = lambda key: F.concat(F.lit("nation-"), key, F.lit(".deck"))
    c, o = table(spark, d, "customer"), table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    live = F.when(F.col("o_orderstatus") == "F", "REMOVED").otherwise("CREATED")
    raw = F.to_json(F.struct((F.col("c_custkey") % 8).cast("double").alias("strokeWeight"), F.lit("00ff").alias("hash")))
    rows = part(table(spark, d, "nation"), path=path("n_nationkey"), ord=F.lit(0), id=F.lit("0:0"), type=F.lit("SLIDE_ROW"), name=F.col("n_name"), position=F.lit("!"))
    slides = part(c, path=path("c_nationkey"), ord=F.col("c_custkey") + 1, id=F.concat(F.lit("1:"), "c_custkey"), pid=F.lit("0:0"), position=F.lit("!"), type=F.lit("SLIDE"), name=F.col("c_name"), phase=F.lit("CREATED"), width=F.lit(1920.0), height=F.lit(1080.0), raw=raw)
    texts = part(o, path=path("c_nationkey"), ord=F.col("o_orderkey") + 10_000_000, id=F.concat(F.lit("2:"), "o_orderkey"), pid=F.concat(F.lit("1:"), "o_custkey"), position=F.lit('"'), type=F.lit("TEXT"), name=F.lit("Ä"), phase=live, visible=F.col("o_orderkey") % 2 == 0, opacity=F.lit(0.5), text=F.col("o_orderpriority"))
    return rows.unionByName(slides).unionByName(texts)


def files(spark, d: str) -> DataFrame:
    """The documents as files (path, content)."""
    n = documents(spark, d)
    parts = archive.new_parts(n.select("path").distinct(), SCHEMA)
    return archive.write_archives(archive.with_nodes(parts, n)).withColumnRenamed("archive", "content")


@query("""WITH o AS (SELECT * FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT 'nation-' || n_nationkey || '.deck' AS path, '0:0' AS id, NULL AS pid, 'SLIDE_ROW' AS type, n_name AS name, NULL AS phase, NULL AS text, NULL::BOOLEAN AS visible, NULL::DOUBLE AS opacity, NULL::DOUBLE AS width, NULL::DOUBLE AS stroke FROM nation
UNION ALL SELECT 'nation-' || c_nationkey || '.deck', '1:' || c_custkey, '0:0', 'SLIDE', 'edited ' || c_name, 'CREATED', NULL, NULL, NULL, 1920, c_custkey % 8 FROM customer
UNION ALL SELECT 'nation-' || c_nationkey || '.deck', '2:' || o_orderkey, '1:' || o_custkey, 'TEXT', 'Ä', CASE WHEN o_orderstatus = 'F' THEN 'REMOVED' ELSE 'CREATED' END, o_orderpriority, o_orderkey % 2 = 0, 0.5, NULL, NULL FROM o""")
def files_edited(spark, d: str) -> DataFrame:
    """Documents written as files, read, their slides renamed, written and read again."""
    parts = written(archive.parts_of(files(spark, d)), group=archive.GROUP)
    name = F.when(F.col("type") == "SLIDE", F.concat(F.lit("edited "), "name")).otherwise(F.col("name"))
    edited = archive.write_archives(archive.with_nodes(parts, archive.nodes_of(parts).withColumn("name", name))).withColumnRenamed("archive", "content")
    out = archive.typed(archive.nodes_of(archive.parts_of(edited)))
    return out.select("path", "id", "pid", "type", "name", "phase", "text", "visible", "opacity", "width", F.col("stroke_weight").alias("stroke"))


@query("""WITH t AS (SELECT c_nationkey AS n, count(*) AS k FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1), s AS (SELECT c_nationkey AS n, count(*) AS k FROM customer GROUP BY 1)
SELECT 'nation-' || n_nationkey || '.deck' AS path, 1 + coalesce(s.k, 0) + coalesce(t.k, 0) AS nodes, coalesce(s.k, 0) AS slides, coalesce(s.k, 0) AS live_slides, 0::BIGINT AS instances, 0::BIGINT AS symbols, 2::BIGINT AS chunks, true AS same FROM nation LEFT JOIN s ON s.n = n_nationkey LEFT JOIN t ON t.n = n_nationkey""")
def files_round_trip(spark, d: str) -> DataFrame:
    return archive.round_trip(archive.parts_of(files(spark, d)))

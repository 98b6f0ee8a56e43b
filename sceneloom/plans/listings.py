"""Registered queries for listings, slots and vector data over the stand-in document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneloom.operators import listing
from sceneloom.sources import paths

from .catalogue import query
from .drawing import DEEP_SQL, deep_nodes
from .graph import OVERRIDES_SQL, overrides, table

# Texts below symbols have an override key (the override table's own keys) and a text; every third one none.
TEXTS_SQL = (
    DEEP_SQL
    + """,
texts AS (SELECT d.*, CASE WHEN type = 'TEXT' THEN '5:' || (ord % 3) END AS override_key, CASE WHEN type = 'TEXT' AND ord % 3 <> 0 THEN name || repeat('.', (ord % 60)::INT) END AS text FROM deep d)"""
)


def text_nodes_of(spark, d: str) -> DataFrame:
    n, is_text = deep_nodes(spark, d), F.col("type") == "TEXT"
    key = F.when(is_text, F.concat(F.lit("5:"), (F.col("ord") % 3).cast("string")))
    text = F.when(is_text & (F.col("ord") % 3 != 0), F.concat("name", F.expr("repeat('.', cast(ord % 60 as int))")))
    return n.withColumn("override_key", key).withColumn("text", text)


@query(f"""WITH {TEXTS_SQL},
{OVERRIDES_SQL},
f AS (SELECT pid AS slide, arg_min(id, ord) AS inst FROM nodes WHERE type = 'INSTANCE' AND pid IN (SELECT id FROM nodes WHERE type = 'SLIDE') GROUP BY 1)
SELECT 'direct' AS source, NULL::VARCHAR AS slide, id, text FROM texts WHERE type = 'TEXT' AND text <> '' UNION ALL SELECT 'override', f.slide, o.key, o.text FROM overrides o JOIN f ON f.inst = o.inst_id WHERE o.text <> ''""")
def list_text_all(spark, d: str) -> DataFrame:
    return listing.list_text(text_nodes_of(spark, d), overrides(spark, d))


@query(f"""WITH {TEXTS_SQL} SELECT pid AS symbol, override_key, 0::BIGINT AS depth, type, name, coalesce(CASE WHEN length(text) > 50 THEN text[1:47] || '...' ELSE text END, '') AS detail FROM texts WHERE type = 'TEXT' AND pid IN (SELECT id FROM nodes WHERE type = 'SYMBOL')""")
def list_override_keys(spark, d: str) -> DataFrame:
    n = text_nodes_of(spark, d)
    return listing.list_override_keys(n, n.where("type = 'SYMBOL'"))


@query(f"""WITH {TEXTS_SQL},
{OVERRIDES_SQL},
f AS (SELECT pid AS slide, arg_min(id, ord) AS inst, arg_min(symbol_id, ord) AS symbol FROM nodes WHERE type = 'INSTANCE' GROUP BY 1),
o AS (SELECT inst_id, key, arg_min(text, ov_ix) AS text FROM overrides GROUP BY 1, 2)
SELECT f.slide, t.override_key, coalesce(o.text, t.text, '') AS text FROM f JOIN texts t ON t.pid = f.symbol AND t.type = 'TEXT' AND t.override_key IS NOT NULL LEFT JOIN o ON o.inst_id = f.inst AND o.key = t.override_key
WHERE f.symbol IN (SELECT id FROM nodes) AND f.slide IN (SELECT id FROM nodes WHERE type = 'SLIDE')""")
def text_values(spark, d: str) -> DataFrame:
    return listing.text_nodes(text_nodes_of(spark, d), overrides(spark, d))


@query(f"""WITH RECURSIVE {DEEP_SQL},
named AS (SELECT id, pid, type, phase, symbol_id, CASE WHEN type = 'TEXT' AND ord % 5 = 0 THEN 'slot:text:' WHEN type = 'INSTANCE' AND ord % 11 = 0 THEN 'fixed:image:' ELSE '' END || name AS name, type = 'INSTANCE' AS has_image FROM deep WHERE phase <> 'REMOVED'),
step AS (SELECT pid AS parent, id AS child FROM named UNION SELECT i.id, c.id FROM named i JOIN named c ON c.pid = i.symbol_id WHERE i.type = 'INSTANCE'),
w AS (SELECT id AS root, id FROM named WHERE type = 'SLIDE' UNION SELECT w.root, s.child FROM w JOIN step s ON s.parent = w.id),
c AS (SELECT w.root AS layout, n.id, CASE WHEN type = 'TEXT' THEN 'text' ELSE 'image' END AS kind, name, starts_with(name, 'slot:text:') AS explicit FROM w JOIN named n ON n.id = w.id WHERE (type = 'TEXT' OR has_image) AND NOT starts_with(name, 'fixed:image:')),
h AS (SELECT *, max(explicit) OVER (PARTITION BY layout) AS has FROM c)
SELECT layout, id, kind, explicit, regexp_replace(name, '^slot:text:', '') AS name FROM h WHERE explicit OR NOT has""")
def slots_found(spark, d: str) -> DataFrame:
    n = deep_nodes(spark, d)
    mark = F.when(F.expr("type = 'TEXT' and ord % 5 = 0"), "slot:text:").when(F.expr("type = 'INSTANCE' and ord % 11 = 0"), "fixed:image:").otherwise("")
    n = n.withColumns({"name": F.concat(mark, "name"), "has_image": F.col("type") == "INSTANCE", "width": F.lit(None).cast("double"), "height": F.lit(None).cast("double")})
    return listing.discover_slots(n, n.where("type = 'SLIDE'").select(F.col("id").alias("slide")))


@query("""WITH p AS (SELECT p_partkey AS k, p_size AS a, p_partkey % 97 AS b FROM part)
SELECT k, 'M0,0 L' || a || ',' || b || ' L' || (a + 3) || ',' || (b + 4) || CASE WHEN a + 3 = 0 AND b + 4 = 0 THEN '' ELSE ' L0,0' END || ' Z' AS path FROM p""")
def vector_network(spark, d: str) -> DataFrame:
    """Path data to vector network bytes and back."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("string").alias("a"), (F.col("p_partkey") % 97).cast("string").alias("b"))
    back = p.select("k", paths.decoded_network(paths.encoded_network(F.concat(F.lit("M0 0 L"), "a", F.lit(" "), "b", F.lit(" l3 4 Z"))), F.lit(1.0), F.lit(1.0)).alias("ops"))
    step = lambda o: F.concat(o["op"], F.array_join(F.transform(o["args"], lambda x: x.cast("long").cast("string")), ","))
    return back.select("k", F.array_join(F.transform("ops", step), " ").alias("path"))

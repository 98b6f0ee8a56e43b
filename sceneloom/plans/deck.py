"""Registered queries over a stand-in document with pictures, sizes and overrides of several kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sceneloom.operators import overrides as O
from sceneloom.operators import tree

from .catalogue import query
from .graph import OVERRIDES_SQL, overrides, table
from .listings import TEXTS_SQL, text_nodes_of

# Pictures stand below symbols beside the texts; two thirds of them have a picture, every fifth is removed.
DECK_SQL = (
    TEXTS_SQL
    + """,
deck AS (SELECT id, pid, ord, type, name, phase, symbol_id, override_key, text, NULL::VARCHAR AS image FROM texts UNION ALL
SELECT '7:' || s_suppkey, '5:' || s_suppkey, 7000000000 + s_suppkey, 'ROUNDED_RECTANGLE', 'Pic' || (s_suppkey % 4), CASE WHEN s_suppkey % 5 = 0 THEN 'REMOVED' ELSE 'CREATED' END, NULL,
 '5:' || (s_suppkey % 3), NULL, CASE WHEN s_suppkey % 3 <> 0 THEN sha1(s_name) END FROM supplier)"""
)
# Every fourth override has a path of two keys; those of flag N change a picture, the others a text.
OVER_SQL = (
    OVERRIDES_SQL
    + """,
over AS (SELECT inst_id, ov_ix, CASE WHEN ov_ix % 4 = 0 THEN [key, '9:1'] ELSE [key] END AS path, CASE WHEN text NOT LIKE 'N%' THEN text END AS text, CASE WHEN text LIKE 'N%' THEN sha1(text) END AS image FROM overrides)"""
)
PAINTS = "array<struct<type:string,image:string>>"
FIRST = "f AS (SELECT pid AS slide, arg_min(id, ord) AS inst, arg_min(symbol_id, ord) AS symbol FROM nodes WHERE type = 'INSTANCE' GROUP BY 1)"


def deck_nodes(spark, d: str) -> DataFrame:
    s, key = table(spark, d, "supplier"), F.col("s_suppkey")
    image = F.struct(F.lit("IMAGE").alias("type"), F.sha1("s_name").alias("image"))
    solid = F.struct(F.lit("SOLID").alias("type"), F.lit(None).cast("string").alias("image"))
    none = F.lit(None).cast("string")
    pictures = s.select(
        F.concat(F.lit("7:"), key).alias("id"), F.concat(F.lit("5:"), key).alias("pid"), (key + 7_000_000_000).alias("ord"),
        F.lit("ROUNDED_RECTANGLE").alias("type"), F.concat(F.lit("Pic"), (key % 4)).alias("name"),
        F.when(key % 5 == 0, "REMOVED").otherwise("CREATED").alias("phase"), none.alias("symbol_id"),
        F.concat(F.lit("5:"), key % 3).alias("override_key"), none.alias("text"), F.array(F.when(key % 3 != 0, image).otherwise(solid)).alias("fill_paints"),
    )
    return text_nodes_of(spark, d).withColumn("fill_paints", F.lit(None).cast(PAINTS)).select(pictures.columns).unionByName(pictures)


def deck_overrides(spark, d: str) -> DataFrame:
    o = overrides(spark, d)
    picture = F.col("text").startswith("N")
    path = F.when(F.col("ov_ix") % 4 == 0, F.array("key", F.lit("9:1"))).otherwise(F.array("key"))
    return o.select("inst_id", F.col("ov_ix").cast("long").alias("ov_ix"), path.alias("path"), F.when(~picture, F.col("text")).alias("text"), F.when(picture, F.sha1("text")).alias("image"))


CHANGES = "c AS (SELECT '4:' || o_orderkey AS inst_id, '5:' || (o_orderkey % 4) AS key, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS text, sha1(o_orderpriority) AS image FROM orders WHERE o_orderkey % 3 <> 1)"
LAST = "l AS (SELECT inst_id, max(ov_ix) AS last FROM over GROUP BY 1)"


def changes(spark, d: str) -> DataFrame:
    """What some orders' instances are to show: a text that may be empty, and a picture."""
    key, o = F.col("o_orderkey"), table(spark, d, "orders").where("o_orderkey % 3 <> 1")
    text = F.when(key % 3 == 0, "").otherwise(F.col("o_orderpriority"))
    return o.select(F.concat(F.lit("4:"), key).alias("inst_id"), F.concat(F.lit("5:"), key % 4).alias("key"), text.alias("text"), F.sha1("o_orderpriority").alias("image"))


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumn("path", F.array_join("path", "/"))


@query(f"""WITH {OVER_SQL}, {CHANGES}, {LAST},
k AS (SELECT *, CASE WHEN image IS NOT NULL THEN row_number() OVER (PARTITION BY inst_id, path[1], image IS NOT NULL ORDER BY ov_ix) END AS n FROM over)
SELECT k.inst_id, k.ov_ix, CASE WHEN c.key IS NULL THEN array_to_string(k.path, '/') ELSE c.key END AS path, CASE WHEN c.key IS NULL THEN k.text END AS text, coalesce(c.image, k.image) AS image
FROM k LEFT JOIN c ON c.inst_id = k.inst_id AND c.key = k.path[1] AND k.n = 1
UNION ALL SELECT c.inst_id, coalesce(last, 0) + 1, key, NULL, c.image FROM c LEFT JOIN l ON l.inst_id = c.inst_id WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.inst_id = c.inst_id AND k.path[1] = c.key AND n = 1)""")
def set_images(spark, d: str) -> DataFrame:
    """Pictures of instances, replaced where one is set, else appended."""
    return _flat(O.set_overrides(deck_overrides(spark, d), changes(spark, d), "image", exact=False))


@query(f"""WITH {OVER_SQL}, {CHANGES}, {LAST} SELECT inst_id, ov_ix, array_to_string(path, '/') AS path, text, image FROM over
UNION ALL SELECT c.inst_id, coalesce(last, 0) + 1, key, NULL, c.image FROM c LEFT JOIN l ON l.inst_id = c.inst_id""")
def append_images(spark, d: str) -> DataFrame:
    return _flat(O.set_overrides(deck_overrides(spark, d), changes(spark, d), "image", append=True))


@query(f"""WITH {OVER_SQL}, {CHANGES}, {LAST},
k AS (SELECT *, CASE WHEN text IS NOT NULL THEN row_number() OVER (PARTITION BY inst_id, path[1], text IS NOT NULL ORDER BY ov_ix) END AS n FROM over)
SELECT k.inst_id, k.ov_ix, CASE WHEN c.key IS NULL THEN array_to_string(k.path, '/') ELSE c.key END AS path, CASE WHEN c.key IS NULL THEN k.text WHEN c.text = '' THEN ' ' ELSE c.text END AS text, CASE WHEN c.key IS NULL THEN k.image END AS image
FROM k LEFT JOIN c ON c.inst_id = k.inst_id AND c.key = k.path[1] AND k.n = 1
UNION ALL SELECT c.inst_id, coalesce(last, 0) + 1, key, CASE WHEN c.text = '' THEN ' ' ELSE c.text END, NULL FROM c LEFT JOIN l ON l.inst_id = c.inst_id WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.inst_id = c.inst_id AND k.path[1] = c.key AND n = 1)""")
def set_texts_by_first_key(spark, d: str) -> DataFrame:
    """Texts of instances by the first key of an override's path, as the tool sets them."""
    return _flat(O.set_overrides(deck_overrides(spark, d), changes(spark, d), "text", exact=False))


@query(f"""WITH {DECK_SQL}, {OVER_SQL}, {FIRST}, o AS (SELECT inst_id, path[1] AS key, arg_min(image, ov_ix) AS image FROM over WHERE image IS NOT NULL GROUP BY 1, 2)
SELECT f.slide, p.override_key, p.name, coalesce(o.image, p.image) AS image FROM f JOIN deck p ON p.pid = f.symbol AND p.image IS NOT NULL LEFT JOIN o ON o.inst_id = f.inst AND o.key = p.override_key WHERE f.slide IN (SELECT id FROM nodes WHERE type = 'SLIDE')""")
def image_values(spark, d: str) -> DataFrame:
    return O.image_nodes(deck_nodes(spark, d), deck_overrides(spark, d))


@query(f"WITH {DECK_SQL} SELECT pid AS symbol, CASE WHEN type = 'TEXT' THEN 'text' ELSE 'image' END AS kind, id, name, override_key AS key FROM deck WHERE (type = 'TEXT' OR image IS NOT NULL) AND override_key IS NOT NULL AND pid IN (SELECT id FROM nodes WHERE type = 'SYMBOL')")
def symbol_slots(spark, d: str) -> DataFrame:
    return O.symbol_slots(deck_nodes(spark, d)).select("symbol", "kind", "id", "name", "key")


@query(f"""WITH {DECK_SQL}, {FIRST}, a AS (SELECT '3:' || c_custkey AS slide, CASE WHEN c_custkey % 5 = 0 THEN '57:48' ELSE 'Pic' || (c_custkey % 4) END AS name FROM customer),
r AS (SELECT pid, name, arg_min(override_key, ord) AS key FROM deck WHERE type = 'ROUNDED_RECTANGLE' GROUP BY ALL)
SELECT a.slide, a.name, CASE WHEN regexp_full_match(a.name, '[0-9]+:[0-9]+') THEN a.name ELSE r.key END AS key FROM a LEFT JOIN f ON f.slide = a.slide LEFT JOIN r ON r.pid = f.symbol AND r.name = a.name""")
def keys_by_name(spark, d: str) -> DataFrame:
    key = F.col("c_custkey")
    asks = table(spark, d, "customer").select(F.concat(F.lit("3:"), key).alias("slide"), F.when(key % 5 == 0, "57:48").otherwise(F.concat(F.lit("Pic"), key % 4)).alias("name"))
    return O.named_keys(deck_nodes(spark, d), asks, "image")


@query(f"WITH {DECK_SQL} SELECT pid AS symbol, id, 0::BIGINT AS depth, type, override_key AS key, name FROM deck WHERE phase <> 'REMOVED' AND (type = 'TEXT' OR image IS NOT NULL) AND override_key IS NOT NULL AND pid IN (SELECT id FROM nodes WHERE type = 'SYMBOL')")
def editable_keys(spark, d: str) -> DataFrame:
    return O.editable_keys(deck_nodes(spark, d))


# Notes stand right on slides: one for each order, with a text or a picture.
NOTES_SQL = """notes AS (SELECT '8:' || o_orderkey AS id, '3:' || o_custkey AS pid, CASE WHEN o_orderkey % 2 = 0 THEN 'TEXT' ELSE 'ELLIPSE' END AS type, o_orderpriority AS name, CASE WHEN o_orderkey % 7 = 0 THEN 'REMOVED' ELSE 'CREATED' END AS phase,
 CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS text, CASE WHEN o_orderkey % 2 = 1 THEN sha1(o_orderstatus) END AS image FROM orders)"""


def notes(spark, d: str) -> DataFrame:
    o, key = table(spark, d, "orders"), F.col("o_orderkey")
    even, none = key % 2 == 0, F.lit(None).cast("string")
    paints = F.array(F.struct(F.lit("IMAGE").alias("type"), F.sha1("o_orderstatus").alias("image")))
    return o.select(
        F.concat(F.lit("8:"), key).alias("id"), F.concat(F.lit("3:"), F.col("o_custkey")).alias("pid"), (key + 8_000_000_000).alias("ord"),
        F.when(even, "TEXT").otherwise("ELLIPSE").alias("type"), F.col("o_orderpriority").alias("name"), F.when(key % 7 == 0, "REMOVED").otherwise("CREATED").alias("phase"),
        none.alias("symbol_id"), none.alias("override_key"), F.when(even, F.col("o_orderstatus")).alias("text"), F.when(~even, paints).cast(PAINTS).alias("fill_paints"),
    )


@query(f"""WITH {DECK_SQL}, {OVER_SQL}, {FIRST}, {NOTES_SQL}
SELECT pid AS slide, '  [' || CASE WHEN text IS NULL THEN 'image' ELSE 'text' END || '-node] ' || id || ' "' || name || '": ' || coalesce(text, image) AS line FROM notes WHERE phase <> 'REMOVED'
UNION ALL SELECT f.slide, '  [' || CASE WHEN text IS NULL THEN 'image' ELSE 'text' END || '-override] ' || path[1] || ': ' || coalesce(text, image) FROM f JOIN over o ON o.inst_id = f.inst WHERE f.slide IN (SELECT id FROM nodes WHERE type = 'SLIDE')""")
def slide_content(spark, d: str) -> DataFrame:
    return O.slide_content(deck_nodes(spark, d).unionByName(notes(spark, d)), deck_overrides(spark, d))


@query(f"WITH {NOTES_SQL} SELECT pid, id, type FROM notes WHERE phase <> 'REMOVED' UNION ALL SELECT '3:' || o_custkey, '4:' || o_orderkey, 'INSTANCE' FROM orders WHERE o_orderstatus <> 'F'")
def slide_shapes(spark, d: str) -> DataFrame:
    """Live direct children of every slide."""
    n = deck_nodes(spark, d).unionByName(notes(spark, d))
    return tree.live_children(n, n.where("type = 'SLIDE'")).select("pid", "id", "type")


@query(f"WITH {NOTES_SQL} SELECT DISTINCT image AS sha1 FROM notes WHERE image IS NOT NULL AND image <> sha1('O')")
def copied_images(spark, d: str) -> DataFrame:
    """Pictures that an import has to copy, from a store of every text's hash."""
    store = table(spark, d, "orders").select(F.sha1("o_orderstatus").alias("sha1"), F.col("o_orderstatus").cast("binary").alias("bytes"))
    return O.missing_images(notes(spark, d), store.where("bytes = cast('O' as binary)"), store).select("sha1")

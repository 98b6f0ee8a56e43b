"""One document as a node table over the plain tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BILLION = 1_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document, canvases (regions), rows (nations), slides (customers), instances (orders), symbols (parts)."""
    t = lambda name: table(spark, sf_dir, name)
    none = F.lit(None).cast("string")

    def part(df, level, key, up_level, up, type_, name, phase=None, symbol=None, component=None, specs=None):
        key = F.col(key).cast("long")
        return df.select(
            F.concat(F.lit(f"{level}:"), key.cast("string")).alias("id"),
            (F.concat(F.lit(f"{up_level}:"), F.col(up).cast("string")) if up else F.lit("0:0")).alias("pid"),
            (F.lit(level).cast("long") * BILLION + key).alias("ord"), F.lit(type_).alias("type"), name.alias("name"),
            (phase if phase is not None else F.lit("CREATED")).alias("phase"), F.char(33 + key % 94).alias("position"),
            (symbol if symbol is not None else none).alias("symbol_id"), (component if component is not None else none).alias("component_key"),
            (specs if specs is not None else F.lit(None).cast("array<string>")).alias("variant_specs"),
        )

    n_part = t("part").agg(F.count(F.lit(1)).alias("n_part"))
    orders = t("orders").crossJoin(F.broadcast(n_part))  # one row
    ref = F.concat(F.lit("5:"), F.expr("cast(o_orderkey % (n_part + n_part div 20) as string)"))
    name = F.concat(F.lit("Type="), F.col("p_type"), F.lit(", Size="), F.col("p_size").cast("string"))
    specs = F.when(F.col("p_size") % 5 == 0, F.array("p_type")).otherwise(F.array(F.col("p_type"), F.col("p_size").cast("string")))
    out = spark.sql("SELECT '0:0' AS id, cast(null AS string) AS pid, 0L AS ord, 'DOCUMENT' AS type, 'Document' AS name, 'CREATED' AS phase, '!' AS position, cast(null AS string) AS symbol_id, cast(null AS string) AS component_key, cast(null AS array<string>) AS variant_specs")
    canvas = F.when(F.col("r_regionkey") == 0, "Internal Only Canvas").otherwise(F.col("r_name"))
    for df in (
        part(t("region"), 1, "r_regionkey", 0, None, "CANVAS", canvas),
        part(t("nation"), 2, "n_nationkey", 1, "n_regionkey", "SLIDE_ROW", F.col("n_name")),
        part(t("customer"), 3, "c_custkey", 2, "c_nationkey", "SLIDE", F.col("c_name")),
        part(orders, 4, "o_orderkey", 3, "o_custkey", "INSTANCE", F.col("o_orderpriority"), F.when(F.col("o_orderstatus") == "F", "REMOVED").otherwise("CREATED"), ref),
        part(t("part"), 5, "p_partkey", 0, None, "SYMBOL", name, component=F.col("p_brand"), specs=specs),
    ):
        out = out.unionByName(df)
    return out


NODES_SQL = """nodes AS (
SELECT '0:0' AS id, NULL::VARCHAR AS pid, 0::BIGINT AS ord, 'DOCUMENT' AS type, 'Document' AS name, 'CREATED' AS phase, '!' AS position, NULL::VARCHAR AS symbol_id, NULL::VARCHAR AS component_key, NULL::VARCHAR[] AS variant_specs
UNION ALL SELECT '1:' || r_regionkey, '0:0', 1000000000 + r_regionkey, 'CANVAS', CASE WHEN r_regionkey = 0 THEN 'Internal Only Canvas' ELSE r_name END, 'CREATED', chr((33 + r_regionkey % 94)::INT), NULL, NULL, NULL FROM region
UNION ALL SELECT '2:' || n_nationkey, '1:' || n_regionkey, 2000000000 + n_nationkey, 'SLIDE_ROW', n_name, 'CREATED', chr((33 + n_nationkey % 94)::INT), NULL, NULL, NULL FROM nation
UNION ALL SELECT '3:' || c_custkey, '2:' || c_nationkey, 3000000000 + c_custkey, 'SLIDE', c_name, 'CREATED', chr((33 + c_custkey % 94)::INT), NULL, NULL, NULL FROM customer
UNION ALL SELECT '4:' || o_orderkey, '3:' || o_custkey, 4000000000 + o_orderkey, 'INSTANCE', o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN 'REMOVED' ELSE 'CREATED' END, chr((33 + o_orderkey % 94)::INT),
  '5:' || (o_orderkey % (SELECT count(*) + count(*) // 20 FROM part)), NULL, NULL FROM orders
UNION ALL SELECT '5:' || p_partkey, '0:0', 5000000000 + p_partkey, 'SYMBOL', 'Type=' || p_type || ', Size=' || p_size, 'CREATED', chr((33 + p_partkey % 94)::INT), NULL, p_brand,
  CASE WHEN p_size % 5 = 0 THEN [p_type] ELSE [p_type, p_size::VARCHAR] END FROM part)"""


def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(inst_id, ov_ix, key, text): an order's line items in order of all columns."""
    from pyspark.sql import Window

    line = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy(*["l_linenumber"] + [c for c in line.columns if c not in ("l_linenumber", "l_orderkey")])
    return line.select(
        F.concat(F.lit("4:"), F.col("l_orderkey").cast("string")).alias("inst_id"), F.row_number().over(w).alias("ov_ix"),
        F.concat(F.lit("5:"), (F.col("l_partkey") % 3).cast("string")).alias("key"), F.concat_ws("-", "l_returnflag", "l_linestatus", F.col("l_partkey").cast("string")).alias("text"),
    )


OVERRIDES_SQL = """overrides AS (
SELECT '4:' || l_orderkey AS inst_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS ov_ix,
  '5:' || (l_partkey % 3) AS key, l_returnflag || '-' || l_linestatus || '-' || l_partkey AS text FROM lineitem)"""

"""Registered queries over the stand-in document, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneloom.functions import scalars as S
from sceneloom.operators import catalog, edit, fonts, imagediff, resolve, text, tree, validate

from .graph import NODES_SQL, OVERRIDES_SQL, nodes, overrides, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None, graph: bool = False, over: bool = False, recursive: bool = False):
    """Register a query; graph and over put the node and override tables in front of its SQL."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ctes = [x for x, on in ((NODES_SQL, graph), (OVERRIDES_SQL, over)) if on]
            body = sql.strip()
            if ctes and body.startswith("WITH "):
                body = "," + body[5:]
            SQL[fn.__name__] = (("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + body if ctes else body).replace("),\n,", "),").replace(")SELECT", ")\nSELECT")
        return fn

    return register


WALK = "WITH w AS (SELECT id, 0 AS depth FROM nodes WHERE pid IS NULL UNION ALL SELECT n.id, w.depth + 1 FROM nodes n JOIN w ON n.pid = w.id)"


@query(WALK + " SELECT n.id, n.type, n.name, n.phase, n.symbol_id, w.depth FROM w JOIN nodes n ON n.id = w.id", graph=True, recursive=True)
def inspect(spark, d: str) -> DataFrame:
    n = nodes(spark, d)
    found = tree.walk(n, tree.roots(n), path=False).select("id", "depth")
    return n.join(found, "id").select("id", "type", "name", "phase", "symbol_id", "depth")


@query("WITH w AS (SELECT id, 0 AS depth FROM nodes WHERE pid IS NULL UNION ALL SELECT n.id, w.depth + 1 FROM nodes n JOIN w ON n.pid = w.id WHERE w.depth < 3) SELECT n.id, n.name, w.depth FROM w JOIN nodes n ON n.id = w.id WHERE type = 'SLIDE'", graph=True, recursive=True)
def inspect_depth_type(spark, d: str) -> DataFrame:
    n = nodes(spark, d)
    found = tree.walk(n, tree.roots(n), max_depth=3, path=False).select("id", "depth")
    return n.where("type = 'SLIDE'").join(found, "id").select("id", "name", "depth")


@query("WITH w AS (SELECT id, 0 AS depth FROM nodes WHERE pid IS NULL UNION ALL SELECT n.id, w.depth + 1 FROM nodes n JOIN w ON n.pid = w.id WHERE n.phase <> 'REMOVED') SELECT type, depth, count(*) AS n FROM w JOIN nodes USING (id) GROUP BY ALL", graph=True, recursive=True)
def inspect_live(spark, d: str) -> DataFrame:
    n = nodes(spark, d)
    found = tree.walk(n, tree.roots(n), skip_removed=True, path=False).select("id", "depth")
    return n.join(found, "id").groupBy("type", "depth").agg(F.count(F.lit(1)).alias("n"))


@query(WALK + """, o AS (SELECT inst_id, count(*) AS n FROM overrides GROUP BY 1)
SELECT n.id, repeat('  ', w.depth) || n.type || ' "' || n.name || '" (' || n.id || ')' || CASE WHEN n.phase = 'REMOVED' THEN ' [REMOVED]' ELSE '' END || coalesce(' sym=' || n.symbol_id, '') || coalesce(' overrides=' || o.n, '') AS line
FROM w JOIN nodes n ON n.id = w.id LEFT JOIN o ON o.inst_id = n.id""", graph=True, over=True, recursive=True)
def tree_text(spark, d: str) -> DataFrame:
    n = nodes(spark, d)
    return tree.tree_lines(n, tree.walk(n, tree.roots(n)), overrides(spark, d)).select("id", "line")


@query("SELECT n.id, n.type FROM nodes n WHERE n.type <> 'DOCUMENT' AND NOT EXISTS (SELECT 1 FROM nodes p WHERE p.id = n.pid AND p.type <> 'DOCUMENT')", graph=True)
def roots(spark, d: str) -> DataFrame:
    return tree.roots(nodes(spark, d).where("type <> 'DOCUMENT'")).select("id", "type")


@query("SELECT n.id, count(c.id) AS n_children, count(c.id) FILTER (WHERE c.phase <> 'REMOVED') AS n_live FROM nodes n LEFT JOIN nodes c ON c.pid = n.id GROUP BY n.id", graph=True)
def children_count(spark, d: str) -> DataFrame:
    return tree.children_count(nodes(spark, d))


@query("SELECT id, name, row_number() OVER (ORDER BY ord) - 1 AS slide_index FROM nodes WHERE type = 'SLIDE' AND phase <> 'REMOVED'", graph=True)
def active_slides(spark, d: str) -> DataFrame:
    return catalog.active_slides(nodes(spark, d)).select("id", "name", F.col("slide_index").cast("long").alias("slide_index"))


@query("""SELECT id, name, row_number() OVER (ORDER BY CASE position WHEN '"' THEN 2 WHEN '#' THEN 4 WHEN '$' THEN 6 WHEN '%' THEN 5 ELSE 1 END, ord) AS number FROM nodes WHERE type = 'CANVAS' AND name <> 'Internal Only Canvas'""", graph=True)
def page_order(spark, d: str) -> DataFrame:
    return catalog.pages(nodes(spark, d)).select("id", "name", F.col("number").cast("long").alias("number"))


@query("SELECT p.id, arg_min(c.id, c.ord) AS child FROM nodes p LEFT JOIN nodes c ON c.pid = p.id AND c.type = 'INSTANCE' WHERE p.type = 'SLIDE' GROUP BY p.id", graph=True)
def slide_instance(spark, d: str) -> DataFrame:
    n = nodes(spark, d)
    return tree.first_child(n, n.where("type = 'SLIDE'"), "INSTANCE")


@query("WITH f AS (SELECT pid, arg_min(id, ord) AS instance, arg_min(symbol_id, ord) AS symbol_id FROM nodes WHERE type = 'INSTANCE' GROUP BY pid) SELECT s.id AS slide, f.instance, f.symbol_id, y.name AS symbol_name FROM nodes s LEFT JOIN f ON f.pid = s.id LEFT JOIN nodes y ON y.id = f.symbol_id AND y.type = 'SYMBOL' WHERE s.type = 'SLIDE'", graph=True)
def slide_symbol(spark, d: str) -> DataFrame:
    return resolve.slide_symbols(nodes(spark, d))


@query("SELECT id, symbol_id FROM nodes n WHERE type = 'INSTANCE' AND phase <> 'REMOVED' AND NOT EXISTS (SELECT 1 FROM nodes s WHERE s.id = n.symbol_id AND s.type = 'SYMBOL')", graph=True)
def dangling_instances(spark, d: str) -> DataFrame:
    return resolve.dangling(nodes(spark, d)).select("id", "symbol_id")


@query("SELECT inst_id, key, arg_min(text, ov_ix) AS text, count(*) AS n_overrides FROM overrides GROUP BY ALL", over=True)
def effective_text(spark, d: str) -> DataFrame:
    return resolve.effective(overrides(spark, d), ["inst_id", "key"], "text")


@query("SELECT inst_id, key, arg_max(text, ov_ix) AS text, count(*) AS n_overrides FROM overrides GROUP BY ALL", over=True)
def effective_drawn(spark, d: str) -> DataFrame:
    return resolve.effective(overrides(spark, d), ["inst_id", "key"], "text", last=True)


@query("SELECT n.id, count(o.inst_id) AS n_overrides FROM nodes n LEFT JOIN overrides o ON o.inst_id = n.id WHERE n.type = 'INSTANCE' GROUP BY n.id", graph=True, over=True)
def override_count(spark, d: str) -> DataFrame:
    n = nodes(spark, d).where("type = 'INSTANCE'").select("id")
    counts = overrides(spark, d).groupBy(F.col("inst_id").alias("id")).agg(F.count(F.lit(1)).alias("k"))
    return n.join(counts, "id", "left").select("id", F.coalesce("k", F.lit(0)).alias("n_overrides"))


@query("""WITH p AS (SELECT id, component_key, trim(unnest(string_split(name, ','))) AS part FROM nodes WHERE type = 'SYMBOL'),
v AS (SELECT id, component_key, split_part(part, '=', -1) AS value FROM p WHERE contains(part, '=')),
k AS (SELECT component_key FROM nodes WHERE type = 'SYMBOL' GROUP BY 1 HAVING count(*) >= 2),
s AS (SELECT DISTINCT component_key, unnest(variant_specs) AS value FROM nodes WHERE type = 'SYMBOL')
SELECT DISTINCT v.id, v.component_key, v.value FROM v JOIN k USING (component_key) WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.component_key = v.component_key AND s.value = v.value)""", graph=True)
def variant_mismatch(spark, d: str) -> DataFrame:
    return validate.variant_mismatches(nodes(spark, d).where("type = 'SYMBOL'"))


@query("SELECT '5:' || p_partkey AS id, p_brand AS component_key FROM part WHERE p_size % 5 = 0")
def variant_placeholder(spark, d: str) -> DataFrame:
    return validate.own_variant_invalid(nodes(spark, d).where("type = 'SYMBOL'"))


@query("""WITH c AS (SELECT vec_id, [(x + 1) / 2 FOR x IN embedding[1:6]] AS e FROM embeddings),
l AS (SELECT vec_id, [CASE WHEN x <= 0.03928 THEN x / 12.92 ELSE pow((x + 0.055) / 1.055, 2.4) END FOR x IN e] AS m FROM c),
y AS (SELECT vec_id, 0.2126 * m[1] + 0.7152 * m[2] + 0.0722 * m[3] AS a, 0.2126 * m[4] + 0.7152 * m[5] + 0.0722 * m[6] AS b FROM l)
SELECT vec_id, round((greatest(a, b) + 0.05) / (least(a, b) + 0.05), 4) AS ratio FROM y WHERE (greatest(a, b) + 0.05) / (least(a, b) + 0.05) < 2""".replace("embedding[1:6]", "embedding[1:6]::DOUBLE[]"))
def low_contrast(spark, d: str) -> DataFrame:
    at = lambda k: (F.col("embedding")[k].cast("double") + 1) / 2
    rows = table(spark, d, "embeddings").select("vec_id", *(at(k).alias(c) for k, c in enumerate(("r", "g", "b", "bg_r", "bg_g", "bg_b"))))
    return validate.low_contrast(rows).select("vec_id", F.round("ratio", 4).alias("ratio"))


@query("SELECT r.id, r.name FROM nodes r JOIN nodes c ON c.id = r.pid WHERE r.type = 'SLIDE_ROW' AND c.name <> 'Internal Only Canvas'", graph=True)
def main_rows(spark, d: str) -> DataFrame:
    return catalog.main_rows(nodes(spark, d)).select("id", "name")


@query("SELECT s.pid AS row, s.id AS slide, 'draft' AS state FROM nodes s JOIN nodes r ON r.id = s.pid JOIN nodes c ON c.id = r.pid WHERE s.type = 'SLIDE' AND c.name <> 'Internal Only Canvas'", graph=True)
def layout_catalog(spark, d: str) -> DataFrame:
    n = nodes(spark, d)
    return catalog.layouts(n, catalog.main_rows(n))


SLOTS = """WITH s AS (SELECT c_nationkey AS layout, c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'text' ELSE 'image' END AS kind,
 CASE WHEN c_nationkey % 3 = 0 AND c_custkey % 4 = 0 THEN 'slot:text:' WHEN c_nationkey % 5 = 0 AND c_custkey % 4 = 1 THEN 'slot:image:' WHEN c_custkey % 7 = 0 THEN 'fixed:image:' ELSE '' END || c_name AS name FROM customer),
e AS (SELECT *, starts_with(name, 'slot:' || kind || ':') AS explicit FROM s WHERE NOT starts_with(name, 'fixed:image:')),
h AS (SELECT *, CASE kind WHEN 'text' THEN max(explicit AND kind = 'text') OVER (PARTITION BY layout) ELSE max(explicit) OVER (PARTITION BY layout) END AS has FROM e)
SELECT layout, id, kind, explicit, regexp_replace(name, '^(layout:|slot:text:|slot:image:|fixed:image:)', '') AS name FROM h WHERE explicit OR NOT has"""


@query(SLOTS)
def slot_choice(spark, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    name = F.when(F.expr("c_nationkey % 3 = 0 and c_custkey % 4 = 0"), "slot:text:").when(F.expr("c_nationkey % 5 = 0 and c_custkey % 4 = 1"), "slot:image:").when(F.expr("c_custkey % 7 = 0"), "fixed:image:").otherwise("")
    slots = c.select(F.col("c_nationkey").alias("layout"), F.col("c_custkey").alias("id"), F.when(F.expr("c_custkey % 2 = 0"), "text").otherwise("image").alias("kind"), F.concat(name, "c_name").alias("name"))
    return catalog.chosen_slots(slots)


@query("""WITH s AS (SELECT c_custkey AS slot, unnest([c_mktsegment, '3:' || c_custkey, '#3:' || c_custkey, c_name]) AS key, generate_subscripts([1, 2, 3, 4], 1) AS place FROM customer),
v AS (SELECT '3:' || o_custkey AS key, max(o_orderpriority) AS value FROM orders WHERE o_custkey % 3 = 0 GROUP BY 1 UNION ALL SELECT c_name, c_mktsegment FROM customer WHERE c_custkey % 2 = 0)
SELECT slot, arg_min(s.key, place) AS key, arg_min(value, place) AS value FROM s JOIN v ON v.key = s.key GROUP BY slot""")
def slot_values(spark, d: str) -> DataFrame:
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    id_ = F.concat(F.lit("3:"), F.col("c_custkey").cast("string"))
    slots = c.select(F.col("c_custkey").alias("slot"), F.array("c_mktsegment", id_, F.concat(F.lit("#"), id_), "c_name").alias("keys"))
    values = o.where("o_custkey % 3 = 0").groupBy(F.concat(F.lit("3:"), F.col("o_custkey").cast("string")).alias("key")).agg(F.max("o_orderpriority").alias("value"))
    values = values.unionByName(c.where("c_custkey % 2 = 0").select(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("value")))
    return resolve.slot_values(slots, values)


@query("""WITH g AS (SELECT user_id, event_id, event_type, coalesce(event_type <> lag(event_type) OVER w, true) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM g)
SELECT user_id, run::BIGINT AS run, min(event_id) AS first, max(event_id) AS last, min(event_type) AS event_type, count(*) AS n FROM r GROUP BY user_id, run""")
def style_runs(spark, d: str) -> DataFrame:
    return text.style_runs(table(spark, d, "events"), "user_id", "event_id", "event_type")


@query("""WITH k AS (SELECT min(event_type) AS t FROM events), g AS (SELECT user_id, event_id, event_type = t AS item, sum((event_type <> t)::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS grp FROM events, k)
SELECT user_id, event_id, CASE WHEN item THEN sum(item::INT) OVER (PARTITION BY user_id, grp ORDER BY event_id) ELSE 0 END::BIGINT AS number FROM g""")
def list_counter(spark, d: str) -> DataFrame:
    e = table(spark, d, "events")
    kind = e.agg(F.min("event_type")).first()[0]  # one value
    return text.list_numbers(e, "user_id", "event_id", "event_type", kind).select("user_id", "event_id", F.coalesce("number", F.lit(0)).alias("number"))


@query("SELECT user_id, event_id, NOT coalesce(event_type = lag(event_type) OVER w AND event_id % 2 = lag(event_id % 2) OVER w, false) AS is_first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def first_line_flags(spark, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("indent", F.col("event_id") % 2)
    return text.first_of_list(e, "user_id", "event_id", "event_type", "indent").select("user_id", "event_id", "is_first")


def astral(text: str) -> str:
    """SQL for how many characters of a text take two UTF-16 units."""
    return f"length(regexp_replace({text}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g'))"


def units(text: str) -> str:
    """SQL for the UTF-16 units of a text."""
    return f"(length({text}) + {astral(text)})"


LINES = "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),\no AS (SELECT doc_id, line, coalesce(sum(u + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, u AS length FROM (SELECT *, " + units("content") + " AS u FROM l))"


@query(LINES + " SELECT doc_id, line, start, length FROM o")
def line_offsets(spark, d: str) -> DataFrame:
    return text.line_offsets(table(spark, d, "documents"))


@query(LINES + ", r AS (SELECT doc_id, k * 100 AS run_start, k AS style FROM documents, unnest(range(0, n_chars // 100 + 1)) AS t(k)) SELECT o.doc_id, o.start, arg_max(r.style, r.run_start) AS style FROM o JOIN r ON r.doc_id = o.doc_id AND r.run_start <= o.start GROUP BY o.doc_id, o.start, o.line")
def asof_run(spark, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    runs = docs.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("n_chars div 100"))).alias("style")).withColumn("run_start", F.col("style") * 100)
    return text.run_at(text.line_offsets(docs), runs, "doc_id", "start", "run_start", "style")


@query("SELECT user_id, event_id, event_id // 7 AS first, coalesce((SELECT min(b.event_id // 7) FROM events b WHERE b.user_id = a.user_id AND b.event_id // 7 > a.event_id // 7), -1) AS next FROM events a")
def next_glyph_start(spark, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", F.expr("event_id div 7").alias("first"))
    return text.next_start(e, "user_id", "first").withColumn("next", F.coalesce("next", F.lit(-1)))


@query("SELECT doc_id AS id, coalesce(CASE WHEN doc_id % 5 = 0 THEN true ELSE abs(n_chars - doc_id % 3 - n_chars) > 1 OR n_chars - doc_id % 6 >= n_chars OR n_chars > n_chars - doc_id % 6 + 3 END, true) AS stale FROM documents")
def stale_layout(spark, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "n_chars", F.when(F.expr("doc_id % 5 <> 0"), F.expr("n_chars - doc_id % 3")).alias("baseline_end"), F.expr("n_chars - doc_id % 6").alias("last_glyph"))
    return text.stale_layout(rows).select("id", "stale")


@query("""WITH k AS (SELECT min(event_type) AS t FROM events), m AS (SELECT user_id, event_type, min(event_id) AS seen FROM events, k WHERE event_type <> t GROUP BY user_id, event_type), f AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY seen) AS i FROM m)
SELECT e.user_id, e.event_id, coalesce(f.i, 0) AS style_id FROM events e LEFT JOIN f ON f.user_id = e.user_id AND f.event_type = e.event_type""")
def format_dictionary(spark, d: str) -> DataFrame:
    e = table(spark, d, "events")
    plain = e.agg(F.min("event_type")).first()[0]  # one value
    return text.format_dictionary(e, "user_id", "event_id", "event_type", plain).select("user_id", "event_id", F.col("style_id").cast("long").alias("style_id"))


@query("""WITH g AS (SELECT user_id, event_id FROM events), b AS (SELECT user_id, k, k * 50 AS first, k * 50 + 50 AS stop FROM (SELECT DISTINCT user_id, event_id // 50 AS k FROM events WHERE event_id % 3 = 0))
SELECT g.user_id, g.event_id, b.k AS baseline FROM g JOIN b ON b.user_id = g.user_id AND g.event_id >= b.first AND g.event_id < b.stop""")
def glyph_line_range(spark, d: str) -> DataFrame:
    e = table(spark, d, "events")
    base = e.where("event_id % 3 = 0").select("user_id", F.expr("event_id div 50").alias("baseline")).distinct().withColumn("first", F.col("baseline") * 50)
    # Baselines do not overlap, so the range join is an as-of join and a test of the end.
    at = text.run_at(e.select("user_id", "event_id"), base, "user_id", "event_id", "first", "baseline")
    return at.where(F.col("baseline").isNotNull() & (F.col("event_id") < F.col("baseline") * 50 + 50))


@query(r"""SELECT page_id, len(regexp_extract_all(html, '<p>([^<]*)</p>', 1)) AS n_paths, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang FROM pages""")
def path_extract(spark, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit("<p>([^<]*)</p>"), 1)).cast("long").alias("n_paths"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"))


@query("""WITH p AS (SELECT vec_id, [floor((x + 1) / 2 * 255)::INT FOR x IN embedding[1:30]::DOUBLE[]] AS a, [floor((x + 1) / 2 * 255)::INT FOR x IN embedding[31:60]::DOUBLE[]] AS b FROM embeddings),
q AS (SELECT vec_id, i, greatest(abs(a[3 * i + 1] - b[3 * i + 1]), abs(a[3 * i + 2] - b[3 * i + 2]), abs(a[3 * i + 3] - b[3 * i + 3])) AS m FROM p, range(0, 10) AS t(i))
SELECT vec_id, count(*) AS n_pixels, count(*) FILTER (WHERE m > 10) AS off_pixels, 100.0::DOUBLE * count(*) FILTER (WHERE m > 10) / count(*) AS off_pct,
 floor(sum(m) / count(*) * 100 + 0.5)::BIGINT AS mean_delta_100, coalesce(floor(sum(m) FILTER (WHERE m > 10) / count(*) FILTER (WHERE m > 10) * 10 + 0.5), 0)::BIGINT AS off_delta_10 FROM q GROUP BY vec_id""")
def pixel_diff(spark, d: str) -> DataFrame:
    channel = lambda first: F.transform(F.slice("embedding", first, 30), lambda x: F.floor((x.cast("double") + 1) / 2 * 255))
    rows = table(spark, d, "embeddings").select("vec_id", channel(1).alias("a"), channel(31).alias("b"))
    return imagediff.pixel_metrics(rows, "a", "b").drop("a", "b")


@query("SELECT vec_id, CASE WHEN abs(embedding[1]) >= 0.99 THEN 'PASS' WHEN 1 - abs(embedding[1]) >= 0.9 THEN 'WARN' ELSE 'FAIL' END AS tier FROM embeddings")
def report_tier(spark, d: str) -> DataFrame:
    score = F.when(F.abs(F.col("embedding")[0]) >= 0.99, 1.0).otherwise(F.least(1 - F.abs(F.col("embedding")[0]), F.lit(0.98)))
    return table(spark, d, "embeddings").withColumn("score", score).select("vec_id", imagediff.tier("score").alias("tier"))


@query("SELECT type, count(*) AS n, count(*) FILTER (WHERE phase <> 'REMOVED') AS n_live, max(split_part(id, ':', 2)::BIGINT) AS max_local FROM nodes GROUP BY type", graph=True)
def document_counts(spark, d: str) -> DataFrame:
    local = S.parse_id(F.col("id"))["local"]
    return nodes(spark, d).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_if(tree.is_live()).alias("n_live"), F.max(local).alias("max_local"))


@query("""WITH i AS (SELECT id AS old, '9:' || (row_number() OVER (ORDER BY ord) + 500) AS new FROM nodes WHERE type IN ('SLIDE', 'SYMBOL'))
SELECT coalesce(a.new, n.id) AS id, coalesce(b.new, n.pid) AS pid, coalesce(c.new, n.symbol_id) AS symbol_id FROM nodes n LEFT JOIN i a ON a.old = n.id LEFT JOIN i b ON b.old = n.pid LEFT JOIN i c ON c.old = n.symbol_id""", graph=True)
def id_remap(spark, d: str) -> DataFrame:
    n = nodes(spark, d)
    ids = edit.allocate_ids(n.where("type IN ('SLIDE', 'SYMBOL')"), 500, 9)
    return edit.remap(n, ids).select("id", "pid", "symbol_id")


@query("""WITH s AS (SELECT id, component_key, ord, row_number() OVER (PARTITION BY component_key ORDER BY ord) AS k FROM nodes WHERE type = 'SYMBOL' AND ord % 2 = 1),
t AS (SELECT DISTINCT component_key FROM nodes WHERE type = 'SYMBOL' AND ord % 40 = 0) SELECT id, component_key, CASE WHEN component_key IN (SELECT component_key FROM t) THEN 'map' WHEN k = 1 THEN 'import' ELSE 'map' END AS action FROM s""", graph=True)
def import_dedup(spark, d: str) -> DataFrame:
    s = nodes(spark, d).where("type = 'SYMBOL'")
    return edit.import_plan(s.where("ord % 2 = 1"), s.where("ord % 40 = 0"))


@query("SELECT id, CASE WHEN type = 'INSTANCE' AND name = '1-URGENT' THEN 'REMOVED' ELSE phase END AS phase FROM nodes", graph=True)
def soft_delete(spark, d: str) -> DataFrame:
    n = nodes(spark, d)
    return edit.soft_delete(n, n.where("type = 'INSTANCE' and name = '1-URGENT'")).select("id", "phase")


@query("""WITH c AS (SELECT '4:' || o_orderkey AS inst_id, '5:1' AS key, CASE WHEN o_orderkey % 2 = 0 THEN ' ' ELSE 'new' END AS text FROM orders WHERE o_orderkey % 5 = 0),
k AS (SELECT o.*, row_number() OVER (PARTITION BY inst_id, key ORDER BY ov_ix) AS n FROM overrides o)
SELECT k.inst_id, k.ov_ix, k.key, coalesce(c.text, k.text) AS text FROM k LEFT JOIN c ON c.inst_id = k.inst_id AND c.key = k.key AND k.n = 1
UNION ALL SELECT c.inst_id, coalesce((SELECT max(ov_ix) FROM overrides o WHERE o.inst_id = c.inst_id), 0) + 1, c.key, c.text FROM c WHERE NOT EXISTS (SELECT 1 FROM overrides o WHERE o.inst_id = c.inst_id AND o.key = c.key)""", over=True)
def upsert_text(spark, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderkey % 5 = 0")
    changes = o.select(F.concat(F.lit("4:"), F.col("o_orderkey").cast("string")).alias("inst_id"), F.lit("5:1").alias("key"), F.when(F.expr("o_orderkey % 2 = 0"), "").otherwise("new").alias("text"))
    return edit.upsert_text(overrides(spark, d), changes).withColumn("ov_ix", F.col("ov_ix").cast("long"))


@query("SELECT id, pid, row_number() OVER (PARTITION BY pid ORDER BY (ord % 7 = 0) DESC, ord) - 1 AS place FROM nodes WHERE type = 'SLIDE'", graph=True)
def move_positions(spark, d: str) -> DataFrame:
    s = nodes(spark, d).where("type = 'SLIDE'").withColumn("moved", F.expr("ord % 7 = 0"))
    return edit.move_to_front(s, "moved").select("id", "pid", F.col("place").cast("long").alias("place"))


@query("SELECT id, type FROM nodes WHERE NOT (type = 'INSTANCE' AND phase = 'REMOVED')", graph=True)
def prune(spark, d: str) -> DataFrame:
    n = nodes(spark, d)
    return edit.prune(n, n.where("type = 'INSTANCE' and phase = 'REMOVED'")).select("id", "type")


@query("SELECT o_custkey AS id, min(o_totalprice) AS x0, max(o_totalprice + o_orderkey % 50) AS x1, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey")
def content_bounds(spark, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderstatus <> 'F'")
    return o.groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_totalprice").alias("x0"), F.max(F.expr("o_totalprice + o_orderkey % 50")).alias("x1"), F.count(F.lit(1)).alias("n"))


@query("""SELECT p_brand AS family, list_sort(list(DISTINCT CASE WHEN p_size % 3 = 0 THEN 700 WHEN p_size % 3 = 1 THEN 500 ELSE 400 END)) AS weights FROM part GROUP BY p_brand""")
def font_inventory(spark, d: str) -> DataFrame:
    style = F.element_at(F.array(F.lit("SemiBold"), F.lit("Medium"), F.lit("Regular")), (F.col("p_size") % 3 + 1).cast("int"))
    found = fonts.inventory(table(spark, d, "part").select(F.col("p_brand").alias("family"), style.alias("style")))
    return found.groupBy("family").agg(F.sort_array(F.collect_list("weight")).alias("weights"))


@query("""WITH w AS (SELECT p_brand AS family, list(DISTINCT p_size % 12) AS have FROM part WHERE p_size < 20 GROUP BY 1)
SELECT family, len([x FOR x IN [0, 3, 6, 9] IF NOT list_contains(have, x)]) AS n_missing, CASE WHEN len([x FOR x IN [0, 3, 6, 9] IF NOT list_contains(have, x)]) = 0 THEN 'resolved' WHEN len([x FOR x IN [0, 3, 6, 9] IF NOT list_contains(have, x)]) = 4 THEN 'failed' ELSE 'partial' END AS state FROM w""")
def font_coverage(spark, d: str) -> DataFrame:
    have = table(spark, d, "part").where("p_size < 20").select(F.col("p_brand").alias("family"), F.expr("p_size % 12").alias("weight"))
    needed = have.select("family").distinct().select("family", F.explode(F.array(*map(F.lit, (0, 3, 6, 9)))).alias("weight"))
    cached = have.select(fonts.cache_key(F.col("family"), F.col("weight")).alias("key"), F.lit("cache").alias("source"))
    return fonts.resolve(needed, have.select("family").where("false"), cached).select("family", "n_missing", "state")


@query("""SELECT vec_id, round(sqrt(power(embedding[3]::DOUBLE - embedding[1]::DOUBLE, 2) + power(embedding[4]::DOUBLE - embedding[2]::DOUBLE, 2)), 6) AS length,
 floor(degrees(atan2(embedding[2]::DOUBLE, embedding[1]::DOUBLE)) * 1000 + 0.5) / 1000 AS rotation FROM embeddings""")
def geometry(spark, d: str) -> DataFrame:
    at = lambda k: F.col("embedding")[k].cast("double")
    return table(spark, d, "embeddings").select("vec_id", F.round(S.line_vector(at(0), at(1), at(2), at(3))["length"], 6).alias("length"), S.rotation(at(0), at(1)).alias("rotation"))


CUT = (
    f"(array_to_string(list_filter(string_split(text[1:47], ''), lambda c, i: i + {astral('text[1:i]')} <= 47), '') || CASE WHEN "
    f"len(list_filter(string_split(text[1:47], ''), lambda c, i: {astral('c')} = 1 AND i + {astral('text[1:i]')} = 48)) > 0 THEN chr(65533) ELSE '' END)"
)


@query("SELECT doc_id, CASE WHEN " + units("text") + " > 50 THEN " + CUT + """ || '...' ELSE text END AS preview, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM documents""")
def text_preview(spark, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", S.preview(F.col("text")).alias("preview"), S.xml_escape(F.col("text")).alias("escaped"))


@query("SELECT sha1(text) AS sha1, count(*) AS n FROM documents GROUP BY 1")
def image_addresses(spark, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(F.sha1(F.col("text").cast("binary")).alias("sha1")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT inst_id, string_agg(key || ' → ' || text, chr(10) ORDER BY ov_ix) AS listing FROM overrides GROUP BY inst_id", over=True)
def list_text(spark, d: str) -> DataFrame:
    line = F.struct("ov_ix", F.concat("key", F.lit(" → "), "text").alias("line"))
    return overrides(spark, d).groupBy("inst_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("listing"))


@query("WITH c AS (SELECT id FROM nodes WHERE type = 'SLIDE'), t AS (SELECT c.id AS root, n.id FROM c JOIN nodes n ON n.id = c.id UNION ALL SELECT c.id, n.id FROM c JOIN nodes n ON n.pid = c.id WHERE n.phase <> 'REMOVED') SELECT root, count(*) AS n FROM t GROUP BY root", graph=True)
def clone_subtrees(spark, d: str) -> DataFrame:
    n = nodes(spark, d)
    return tree.walk(n, n.where("type = 'SLIDE'"), skip_removed=True, path=False).groupBy("root").agg(F.count(F.lit(1)).alias("n"))

"""Registered queries that describe and check documents: layouts with slots, warnings, lists, fonts, look-ups, imports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneloom.functions import scalars as S
from sceneloom.operators import edit, fonts, layouts, resolve, template, text, validate

from .catalogue import query, units
from .deck import DECK_SQL, NOTES_SQL, deck_nodes, notes
from .drawing import DEEP_SQL, TOP, deep_nodes
from .graph import nodes, table

# Layouts ------------------------------------------------------------------------------------------

# Every fifth slide stands in a module; notes are slots by name or by guess, pictures have sizes.
NAMED = "CASE WHEN n % 11 = 0 AND type = 'TEXT' THEN 'slot:text:T' || n WHEN n % 13 = 0 AND type = 'ELLIPSE' THEN 'slot:image:I' || n WHEN n % 6 = 1 THEN 'fixed:image:F' ELSE name END"
LAYOUT_SQL = f"""{DECK_SQL}, {NOTES_SQL},
rows AS (SELECT r.id, r.name FROM nodes r JOIN nodes c ON c.id = r.pid WHERE r.type = 'SLIDE_ROW' AND c.name <> 'Internal Only Canvas'),
d AS (SELECT s.pid AS row, rows.name AS row_name, s.id AS slide, CASE WHEN (s.ord - 3000000000) % 5 = 0 THEN '9:' || (s.ord - 3000000000) END AS module, s.name FROM nodes s JOIN rows ON rows.id = s.pid WHERE s.type = 'SLIDE'),
named AS (SELECT id, pid, type, text, image, phase, n, {NAMED} AS name FROM (SELECT *, split_part(id, ':', 2)::BIGINT AS n FROM notes)),
used AS (SELECT d.slide, k.id, min(i.ord) AS a, any_value(k.ord) AS b FROM d JOIN nodes i ON i.pid = d.slide AND i.type = 'INSTANCE' AND i.phase <> 'REMOVED' JOIN deck k ON k.pid = i.symbol_id AND k.phase <> 'REMOVED' AND k.type IN ('TEXT', 'ROUNDED_RECTANGLE') GROUP BY ALL),
cand AS (SELECT u.slide, u.a, u.b, k.id, k.type, k.name, k.text, k.image IS NOT NULL AS pic, CASE WHEN k.type <> 'TEXT' THEN 200 ELSE 0 END AS w, CASE WHEN k.type <> 'TEXT' THEN 150 ELSE 0 END AS h FROM used u JOIN deck k USING (id)
 UNION ALL SELECT d.slide, 8000000000 + n, 0, x.id, type, x.name, text, image IS NOT NULL, 0, 0 FROM d JOIN named x ON x.pid = d.slide AND x.phase <> 'REMOVED'),
e AS (SELECT slide AS layout, a, b, id, type, pic, w, h, CASE WHEN starts_with(name, 'slot:text:') THEN 'text' WHEN starts_with(name, 'slot:image:') THEN 'image' WHEN type = 'TEXT' THEN 'text' ELSE 'image' END AS kind,
 CASE WHEN starts_with(name, 'slot:') THEN 'explicit' ELSE 'heuristic' END AS source, CASE WHEN starts_with(name, 'slot:') THEN regexp_replace(name, '^slot:(text|image):', '') WHEN type = 'TEXT' THEN name ELSE '#' || id END AS name, left(coalesce(text, ''), 80) AS preview
 FROM cand WHERE NOT starts_with(name, 'fixed:') AND (type = 'TEXT' OR pic OR starts_with(name, 'slot:image:') OR w > 100)),
f AS (SELECT *, CASE kind WHEN 'text' THEN max(source = 'explicit' AND kind = 'text') OVER (PARTITION BY layout) ELSE max(source = 'explicit') OVER (PARTITION BY layout) END AS has FROM e),
slots AS (SELECT layout, kind, id, name, source, type, CASE kind WHEN 'text' THEN preview END AS preview, w::BIGINT AS width, h::BIGINT AS height, pic AS has_image, a, b FROM f WHERE source = 'explicit' OR NOT has)"""


def layout_nodes(spark, d: str) -> DataFrame:
    key, slide = F.split_part("id", F.lit(":"), F.lit(2)).cast("long"), F.col("ord") - 3_000_000_000
    base = deck_nodes(spark, d)
    base = base.withColumn("pid", F.when((F.col("type") == "SLIDE") & (slide % 5 == 0), F.concat(F.lit("9:"), slide)).otherwise(F.col("pid")))
    is_text, is_round = F.col("type") == "TEXT", F.col("type") == "ELLIPSE"
    name = F.when(is_text & (key % 11 == 0), F.concat(F.lit("slot:text:T"), key)).when(is_round & (key % 13 == 0), F.concat(F.lit("slot:image:I"), key))
    loose = notes(spark, d).withColumn("name", name.when(key % 6 == 1, "fixed:image:F").otherwise(F.col("name")))
    c = table(spark, d, "customer").where("c_custkey % 5 = 0")
    modules = c.select(
        F.concat(F.lit("9:"), F.col("c_custkey")).alias("id"), F.concat(F.lit("2:"), F.col("c_nationkey")).alias("pid"), (F.col("c_custkey") + 9_000_000_000).alias("ord"),
        F.lit("MODULE").alias("type"), F.concat(F.lit("layout:"), "c_name").alias("name"), F.lit("CREATED").alias("phase"))
    every = base.unionByName(loose).unionByName(modules, allowMissingColumns=True)
    picture = F.col("type") == "ROUNDED_RECTANGLE"
    none = F.lit(None)
    return every.withColumns({"width": F.when(picture, 200.0), "height": F.when(picture, 150.0), "shape_text": none.cast("string"), "holds_text": none.cast("boolean")})


@query(f"WITH {LAYOUT_SQL} SELECT row, row_name, slide, module, name, CASE WHEN module IS NULL THEN 'draft' ELSE 'published' END AS state FROM d")
def layouts_described(spark, d: str) -> DataFrame:
    return layouts.describe(layout_nodes(spark, d)).select("row", "row_name", "slide", "module", "name", "state")


@query(f"WITH {LAYOUT_SQL} SELECT layout, kind, id, name, source, type, preview, width, height, has_image FROM slots")
def layout_slots(spark, d: str) -> DataFrame:
    n = layout_nodes(spark, d)
    tops = layouts.describe(n).select(F.col("slide").alias("layout"), "root")
    return layouts.slots(n, tops).drop("path")


@query(f"""WITH {LAYOUT_SQL}, x AS (SELECT layout, a, b, kind, source, '    - ' || name || ' (' || id || ', ' || source || CASE kind WHEN 'text' THEN '): "' || preview || '"' ELSE ', ' || width || 'x' || height || ')' || CASE WHEN has_image THEN ' [image]' ELSE '' END END AS line FROM slots),
p AS (SELECT layout, string_agg(line, chr(10) ORDER BY a, b) FILTER (WHERE kind = 'text') AS t, string_agg(line, chr(10) ORDER BY a, b) FILTER (WHERE kind = 'image') AS i, max(source = 'explicit') AS explicit FROM x GROUP BY 1)
SELECT slide, 'Layout "' || name || '" [' || slide || ']' || chr(10) || '  state: ' || CASE WHEN module IS NULL THEN 'draft' ELSE 'published, module ' || module END || ', row ' || row || chr(10) || '  explicit slots: ' || CASE WHEN coalesce(explicit, false) THEN 'yes' ELSE 'no' END || chr(10)
|| coalesce('  text slots:' || chr(10) || t, '  text slots: (none)') || chr(10) || coalesce('  image slots:' || chr(10) || i, '  image slots: (none)') AS text FROM d LEFT JOIN p ON p.layout = d.slide""")
def layout_text(spark, d: str) -> DataFrame:
    n = layout_nodes(spark, d)
    described = layouts.describe(n)
    found = layouts.slots(n, described.select(F.col("slide").alias("layout"), "root"))
    return layouts.catalog_text(described, found)


# Warnings -----------------------------------------------------------------------------------------


@query("WITH RECURSIVE " + DEEP_SQL + r""",
p AS (SELECT id, name, component_key, trim(unnest(string_split(name, ','))) AS part FROM nodes WHERE type = 'SYMBOL'),
v AS (SELECT id, name, component_key, split_part(part, '=', -1) AS value FROM p WHERE contains(part, '=')),
k AS (SELECT component_key FROM nodes WHERE type = 'SYMBOL' GROUP BY 1 HAVING count(*) >= 2), s AS (SELECT DISTINCT component_key, unnest(variant_specs) AS value FROM nodes WHERE type = 'SYMBOL'),
step AS (SELECT pid AS parent, id AS child FROM deep WHERE pid IS NOT NULL UNION SELECT i.id, y.id FROM deep i JOIN deep y ON y.id = i.symbol_id WHERE i.type = 'INSTANCE'),
w AS (SELECT id AS root, id FROM deep WHERE type = 'SLIDE' UNION SELECT w.root, s.child FROM w JOIN step s ON s.parent = w.id),
g AS (SELECT w.root, w.id, s_name, s_acctbal / 10000 AS c FROM w JOIN supplier ON w.id = '6:' || s_suppkey),
l AS (SELECT *, 1.05 / (0.2126 * m + 0.7152 * m + 0.0722 * m + 0.05) AS ratio FROM (SELECT *, CASE WHEN c <= 0.03928 THEN c / 12.92 ELSE pow((c + 0.055) / 1.055, 2.4) END AS m FROM g))
SELECT DISTINCT 'variant' AS kind, v.id, 'SYMBOL ' || v.id || ' "' || v.name || '": variant value "' || v.value || '" is in no symbol of the component' AS message FROM v JOIN k USING (component_key) WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.component_key = v.component_key AND s.value = v.value)
UNION ALL SELECT 'missing', id, 'INSTANCE ' || id || ' "' || name || '": references missing SYMBOL ' || symbol_id FROM nodes n WHERE type = 'INSTANCE' AND phase <> 'REMOVED' AND NOT EXISTS (SELECT 1 FROM nodes s WHERE s.id = n.symbol_id AND s.type = 'SYMBOL')
UNION ALL SELECT 'contrast', id, 'TEXT ' || id || ' "' || s_name || '": contrast ratio ' || printf('%.2f', ratio) || ':1 on slide ' || root || ' is below 2:1' FROM l WHERE ratio < 2""")  # fmt: skip
def document_warnings(spark, d: str) -> DataFrame:
    n, s = deep_nodes(spark, d), table(spark, d, "supplier")
    shade = F.col("s_acctbal") / 10000  # of texts only, so no other node meets them
    paints = s.select(F.concat(F.lit("6:"), F.col("s_suppkey")).alias("_id"), F.array(F.struct(F.lit("SOLID").alias("type"), *(shade.alias(c) for c in "rgb"))).alias("fill_paints"))
    texts = n.where("type = 'TEXT'").join(paints, F.col("id") == F.col("_id"), "left").drop("_id")
    others = nodes(spark, d).select(*n.columns, "component_key", "variant_specs")
    return validate.warnings(others.unionByName(texts, allowMissingColumns=True))


# Lists --------------------------------------------------------------------------------------------


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, len(string_split(text, chr(10))) AS n FROM documents)
SELECT doc_id, line::INT AS line, CASE WHEN line = n - 1 AND content = '' THEN 'PLAIN' WHEN doc_id % 2 = 0 THEN 'ORDERED_LIST' ELSE 'UNORDERED_LIST' END AS line_type, CASE WHEN line = n - 1 AND content = '' THEN 0 ELSE 1 END AS indent, line = 0 AND NOT (n = 1 AND content = '') AS is_first FROM l""")
def list_lines(spark, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("kind", F.when(F.col("doc_id") % 2 == 0, "number").otherwise("bullet"))
    return text.list_lines(docs, "doc_id", "text", "kind")


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, len(string_split(text, chr(10))) AS n FROM documents),
o AS (SELECT *, coalesce(sum({units('content')} + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM l),
r AS (SELECT *, (start // 100) % 5 AS k FROM o), t AS (SELECT *, CASE WHEN line = n - 1 AND content = '' THEN 'PLAIN' WHEN k = 1 THEN 'UNORDERED_LIST' WHEN k IN (2, 3) THEN 'ORDERED_LIST' ELSE 'PLAIN' END AS line_type FROM r),
u AS (SELECT *, CASE WHEN line_type = 'PLAIN' THEN 0 WHEN k = 3 THEN 2 ELSE 1 END AS indent FROM t)
SELECT doc_id AS key, line::INT AS line, line_type, indent, line_type <> 'PLAIN' AND NOT coalesce(lag(line_type) OVER w = line_type AND lag(indent) OVER w = indent, false) AS is_first FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY line)""")
def run_lines(spark, d: str) -> DataFrame:
    """Lines of texts whose runs are 100 units long and of five kinds in turn."""
    docs = table(spark, d, "documents").where("text is not null")
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.expr("n_chars * 2 div 100"))).alias("k")
    k = F.col("k") % 5
    runs = docs.select(F.col("doc_id").alias("key"), at).select("key", (F.col("k") * 100).alias("run_start"), (k == 1).alias("bullet"), k.isin(2, 3).alias("number"), F.when(k == 3, 2).alias("indent"))
    return text.run_lines(docs.select(F.col("doc_id").alias("key"), "text"), runs)


# Fonts --------------------------------------------------------------------------------------------

SLUGS = "SELECT DISTINCT lower(replace(p_brand, '#', '-')) AS slug, p_size % 9 * 100 + 100 AS weight FROM part"


@query(f"""WITH n AS ({SLUGS}), f AS (SELECT DISTINCT lower(replace(p_brand, '#', '-')) || ['-latin-', '-all-'][p_partkey % 2 + 1] || (p_size % 9 * 100 + 100) || ['-normal.woff2', '-normal.woff', '-normal.ttf'][p_partkey % 3 + 1] AS file FROM part),
p AS (SELECT slug, weight, k, printf(['%s-latin-%d-normal.woff2', '%s-latin-%d-normal.woff', '%s-latin-%d-normal.ttf', '%s-all-%d-normal.woff2'][k], slug, weight) AS file FROM n, range(1, 5) AS t(k))
SELECT slug, weight, arg_min(file, k) AS file FROM p JOIN f USING (file) GROUP BY ALL""")
def packaged_fonts(spark, d: str) -> DataFrame:
    key, p = F.col("p_partkey"), table(spark, d, "part")
    slug, weight = F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))), F.col("p_size") % 9 * 100 + 100
    pick = lambda n, *x: F.element_at(F.array(*map(F.lit, x)), (key % n + 1).cast("int"))
    files = p.select(F.concat(slug, pick(2, "-latin-", "-all-"), weight.cast("string"), pick(3, "-normal.woff2", "-normal.woff", "-normal.ttf")).alias("file"))
    return fonts.packaged(p.select(slug.alias("slug"), weight.alias("weight")).distinct(), files)


@query(f"WITH n AS ({SLUGS}) SELECT slug AS family, count(*) = 3 AS complete FROM n WHERE weight IN (100, 400, 700) GROUP BY 1")
def complete_fonts(spark, d: str) -> DataFrame:
    slug, weight = F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))), F.col("p_size") % 9 * 100 + 100
    return fonts.all_or_none(table(spark, d, "part").select(slug.alias("family"), weight.alias("weight")), "family", [100, 400, 700])


@query(r"""WITH f AS (SELECT p_partkey AS ord, replace(lower(p_brand), '#', '') || ['-Regular', '-Bold', 'plain', '-SemiBold', ''][p_partkey % 5 + 1] || ['.ttf', '.ttc', '.otf', '.txt'][p_partkey % 4 + 1] AS file FROM part),
n AS (SELECT DISTINCT replace(p_brand, '#', ' ') AS family, w AS weight FROM part, unnest([400, 600, 700]) AS t(w))
SELECT family, weight, arg_min(file, ord) AS file FROM n JOIN f ON contains(lower(file), replace(lower(family), ' ', '')) AND NOT ends_with(file, '.txt') AND (ends_with(file, '.ttc') OR CASE weight WHEN 400 THEN contains(lower(file), 'regular') OR NOT regexp_matches(lower(file), '-\w+\.') WHEN 600 THEN contains(lower(file), 'semibold') ELSE contains(lower(file), 'bold') END) GROUP BY ALL""")
def system_fonts(spark, d: str) -> DataFrame:
    key, p = F.col("p_partkey"), table(spark, d, "part")
    pick = lambda n, *x: F.element_at(F.array(*map(F.lit, x)), (key % n + 1).cast("int"))
    file = F.concat(F.replace(F.lower("p_brand"), F.lit("#"), F.lit("")), pick(5, "-Regular", "-Bold", "plain", "-SemiBold", ""), pick(4, ".ttf", ".ttc", ".otf", ".txt"))
    needed = p.select(F.replace("p_brand", F.lit("#"), F.lit(" ")).alias("family"), F.explode(F.array(*map(F.lit, (400, 600, 700)))).alias("weight")).distinct()
    return fonts.system_fonts(needed, p.select(key.alias("ord"), file.alias("file")))


@query("SELECT DISTINCT '' || o_orderpriority AS family, CASE WHEN o_orderstatus = 'O' THEN 700 ELSE 300 END AS weight FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 7 <> 0")
def slide_fonts(spark, d: str) -> DataFrame:
    """Fonts of the texts that stand on slides."""
    n = deck_nodes(spark, d).unionByName(notes(spark, d))
    n = n.withColumns({"font_family": F.when(F.col("type") == "TEXT", F.col("name")), "font_style": F.when(F.col("text") == "O", "Bold").otherwise("Light")})
    return fonts.scan(n, n.where("type = 'SLIDE'"))


# Look-ups -----------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT id, name, ord, phase FROM nodes WHERE type = 'INSTANCE'), r AS (SELECT DISTINCT o_orderpriority AS ref FROM orders UNION SELECT '4:' || o_orderkey FROM orders WHERE o_orderkey % 3 = 0 UNION SELECT '3:1')
SELECT ref, coalesce((SELECT id FROM s WHERE id = ref), (SELECT arg_min(id, ord) FROM s WHERE name = ref AND phase <> 'REMOVED')) AS id FROM r""", graph=True)
def nodes_by_reference(spark, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    refs = o.select(F.col("o_orderpriority").alias("ref")).unionByName(o.where("o_orderkey % 3 = 0").select(F.concat(F.lit("4:"), F.col("o_orderkey")).alias("ref"))).distinct()
    return resolve.by_reference(nodes(spark, d), refs.unionByName(spark.createDataFrame([("3:1",)], "ref string")), "INSTANCE")


@query("SELECT l_orderkey AS id, arg_max(l_partkey, l_linenumber::BIGINT * 1000000000 + l_partkey) AS part FROM lineitem GROUP BY 1")
def last_of_repeated_ids(spark, d: str) -> DataFrame:
    n = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("part"), F.expr("l_linenumber * 1000000000L + l_partkey").alias("ord"))
    return resolve.last_node_wins(n).select("id", "part")


@query("SELECT doc_id, sha1(text) AS again, 20 AS bytes FROM documents WHERE text IS NOT NULL")
def hashes_as_bytes(spark, d: str) -> DataFrame:
    raw = S.hash_bytes(F.sha1("text"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", S.hash_text(raw).alias("again"), F.octet_length(raw).alias("bytes"))


@query("SELECT '9:' || (row_number() OVER (ORDER BY ord) + 500) AS new, id AS old FROM nodes WHERE type = 'SYMBOL'", graph=True)
def ids_reversed(spark, d: str) -> DataFrame:
    return edit.reversed_ids(edit.allocate_ids(nodes(spark, d).where("type = 'SYMBOL'"), 500, 9))


# Imports and templates ----------------------------------------------------------------------------


@query(f"""WITH {DECK_SQL}, q AS (SELECT s_suppkey AS place, '5:' || s_suppkey AS id, p_brand AS key FROM supplier JOIN part ON p_partkey = s_suppkey),
f AS (SELECT *, min(place) OVER (PARTITION BY key) AS first FROM q),
t AS (SELECT place, id AS root, id AS old, 0 AS step, 0 AS o FROM f WHERE place = first UNION ALL SELECT f.place, f.id, k.id, 1, k.ord FROM f JOIN deck k ON k.pid = f.id AND k.type IN ('TEXT', 'ROUNDED_RECTANGLE') AND k.phase <> 'REMOVED' WHERE place = first),
n AS (SELECT *, '1:' || (1 + row_number() OVER (ORDER BY place, step, o)) AS new FROM t)
SELECT n.new AS id, CASE WHEN step = 0 THEN '0:1' ELSE r.new END AS pid, k.type, k.name FROM n JOIN deck k ON k.id = n.old LEFT JOIN n r ON r.place = n.place AND r.old = n.root""".replace("CASE WHEN step = 0", "CASE WHEN n.step = 0"))
def imported_symbols(spark, d: str) -> DataFrame:
    """Symbols with their texts and pictures, into a document that has none; of those with one key the first."""
    keys = nodes(spark, d).select(F.col("id").alias("_id"), "component_key", "position")
    source = deck_nodes(spark, d).join(keys, F.col("id") == F.col("_id"), "left").drop("_id")
    target = spark.createDataFrame([("0:0", None, 0, "DOCUMENT"), ("0:1", "0:0", 1, "CANVAS")], "id string, pid string, ord bigint, type string")
    kinds = dict(source.dtypes)
    target = target.select("*", *(F.lit(None).cast(t).alias(c) for c, t in kinds.items() if c not in target.columns))
    wanted = table(spark, d, "supplier").join(table(spark, d, "part"), F.col("s_suppkey") == F.col("p_partkey")).select(F.col("s_suppkey").alias("place"), F.concat(F.lit("5:"), F.col("s_suppkey")).alias("id"))
    return template.import_symbols(source, target, wanted, "0:1")[1].select("id", "pid", "type", "name")


@query("""WITH b AS (SELECT l_orderkey AS place, l_partkey % 50 AS blob, l_linenumber AS k FROM lineitem), f AS (SELECT DISTINCT place, blob FROM b WHERE blob < 40),
n AS (SELECT place, blob, (SELECT count(*) FROM region) + row_number() OVER (ORDER BY place, blob) - 1 AS new FROM f)
SELECT b.place, b.k, CASE WHEN b.blob < 40 THEN n.new ELSE b.blob END AS blob, count(*) AS n FROM b LEFT JOIN n ON n.place = b.place AND n.blob = b.blob GROUP BY ALL""")
def imported_blobs(spark, d: str) -> DataFrame:
    """References to byte strings of a source with 40 of them, in imports by order, into a document that has five."""
    uses = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("place"), F.col("l_linenumber").alias("k"), (F.col("l_partkey") % 50).alias("blob"))
    source = spark.range(40).select(F.col("id").alias("ix"), F.col("id").cast("string").cast("binary").alias("bytes"))
    target = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("ix"), F.col("r_name").cast("binary").alias("bytes"))
    return template.import_blobs(uses, source, target)[0].groupBy("place", "k", "blob").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH w AS (SELECT row_number() OVER (ORDER BY ord) - 1 AS place, id AS root FROM nodes WHERE type = 'SLIDE' AND ord % 4 = 0),
t AS (SELECT place, root, root AS old, 0 AS step, 0 AS o FROM w UNION ALL SELECT w.place, w.root, n.id, 1, n.ord FROM w JOIN nodes n ON n.pid = w.root WHERE n.phase <> 'REMOVED'),
c AS (SELECT *, '200:' || ({TOP} + row_number() OVER (ORDER BY place, step, o)) AS id FROM t),
rows AS (SELECT id, ord FROM nodes WHERE type = 'SLIDE_ROW'), keep AS (SELECT arg_min(id, ord) AS id FROM rows),
v AS (SELECT c.id, CASE WHEN c.step = 0 THEN (SELECT id FROM keep) ELSE p.id END AS pid, n.type, CASE WHEN n.name = '1-URGENT' THEN CASE WHEN c.place % 2 = 0 THEN 'now' ELSE ' ' END ELSE n.name END AS text FROM c JOIN nodes n ON n.id = c.old LEFT JOIN c p ON p.place = c.place AND p.old = c.root)
SELECT id, pid, type, text FROM v UNION ALL SELECT id, pid, type, name FROM nodes n WHERE NOT (type = 'SLIDE' OR coalesce(pid, '') IN (SELECT id FROM nodes WHERE type = 'SLIDE')) AND NOT (type = 'SLIDE_ROW' AND id <> (SELECT id FROM keep))""", graph=True)
def from_template(spark, d: str) -> DataFrame:
    """A document from every fourth layout, with new texts for some slots; the template's layouts and other rows go."""
    from sceneloom.functions.ranking import numbered

    n = nodes(spark, d).withColumn("text", F.col("name"))
    slides = n.where("type = 'SLIDE'")
    wanted = numbered(slides.where("ord % 4 = 0").select("ord", F.col("id").alias("root")), ["ord"], "place", 0).select("place", "root")
    texts = wanted.select("place", F.lit("1-URGENT").alias("key"), F.when(F.col("place") % 2 == 0, "now").otherwise("").alias("text"))
    found = slides.select(F.col("pid").alias("row"), F.col("id").alias("slide"), F.lit("draft").alias("state"))
    out = template.create_from_template(n, wanted, found, n.where("type = 'SLIDE_ROW'").select("id", "ord"), texts)
    return out.select("id", "pid", "type", "text")

"""Text runs, lines, lists and glyph layout as windows over ordered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sceneloom.functions.scalars import utf16_length


def style_runs(glyphs: DataFrame, key: str, order: str, style: str) -> DataFrame:
    """(key, first, last, style, n): maximal runs of consecutive rows of one style."""
    w = Window.partitionBy(key).orderBy(order)
    new = ~F.lag(style).over(w).eqNullSafe(F.col(style)) | (F.row_number().over(w) == 1)
    runs = glyphs.select(key, order, style, new.cast("int").alias("new")).withColumn("run", F.sum("new").over(w))
    return runs.groupBy(key, "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.first(style).alias(style), F.count(F.lit(1)).alias("n"))


def list_numbers(lines: DataFrame, key: str, order: str, kind: str, ordered: str) -> DataFrame:
    """lines with `number`: counts consecutive ordered-list lines from 1; null on other lines, after which it starts again."""
    w = Window.partitionBy(key).orderBy(order)
    is_item = F.col(kind).eqNullSafe(ordered)
    group = lines.withColumn("grp", F.sum((~is_item).cast("int")).over(w))
    number = F.sum(F.when(is_item, 1).otherwise(0)).over(Window.partitionBy(key, "grp").orderBy(order))
    return group.withColumn("number", F.when(is_item, number)).drop("grp")


def first_of_list(lines: DataFrame, key: str, order: str, kind: str, indent: str) -> DataFrame:
    """lines with `is_first`: the type or the indent differs from the line before, or there is none."""
    w = Window.partitionBy(key).orderBy(order)
    same = F.lag(kind).over(w).eqNullSafe(F.col(kind)) & F.lag(indent).over(w).eqNullSafe(F.col(indent)) & (F.row_number().over(w) > 1)
    return lines.withColumn("is_first", ~same)


def line_offsets(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line, start, length): lines of a text with the UTF-16 unit that each starts at, and their units."""
    lines = texts.select(key, F.posexplode(F.split(text, "\n")).alias("line", "content"))
    lines = lines.select(key, "line", utf16_length(F.col("content")).alias("length"))
    before = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return lines.select(key, "line", F.coalesce(F.sum(F.col("length") + 1).over(before), F.lit(0)).alias("start"), "length")


def run_at(lines: DataFrame, runs: DataFrame, key: str, at: str, run_start: str, value: str) -> DataFrame:
    """As-of join: lines with the value of the last run that starts at or before them.

    Both sides go through one window per key over their union, so a long document costs a sort, not a product.
    """
    left = lines.select(key, F.col(at).alias("at"), F.lit(1).alias("side"), F.lit(None).cast(dict(runs.dtypes)[value]).alias("v"))
    right = runs.select(key, F.col(run_start).alias("at"), F.lit(0).alias("side"), F.col(value).alias("v"))
    w = Window.partitionBy(key).orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("found", F.last("v", ignorenulls=True).over(w))
    return both.where("side = 1").select(key, F.col("at").alias(at), F.col("found").alias(value))


def next_start(glyphs: DataFrame, key: str, first: str) -> DataFrame:
    """glyphs with `next`: the smallest first-character of the same text that is greater, null at the end."""
    steps = glyphs.select(key, first).distinct()
    steps = steps.withColumn("next", F.lead(first).over(Window.partitionBy(key).orderBy(first)))
    return glyphs.join(steps, [key, first])


def stale_layout(texts: DataFrame) -> DataFrame:
    """texts (id, n_chars, baseline_end, last_glyph) with `stale`: no layout, or one that does not fit the text's length."""
    n, end, glyph = F.col("n_chars"), F.col("baseline_end"), F.col("last_glyph")
    stale = end.isNull() | (F.abs(end - n) > 1) | (glyph >= n) | (n > glyph + 3)
    return texts.withColumn("stale", F.coalesce(stale, F.lit(True)))


def format_dictionary(runs: DataFrame, key: str, order: str, style: str, plain) -> DataFrame:
    """runs with `style_id`: 0 for plain, else 1, 2, ... in order of first appearance in the text."""
    first = runs.where(~F.col(style).eqNullSafe(plain)).groupBy(key, style).agg(F.min(order).alias("seen"))
    ids = first.select(key, F.col(style).alias("_style"), F.row_number().over(Window.partitionBy(key).orderBy("seen")).alias("_id")).withColumnRenamed(key, "_key")
    out = runs.join(ids, (F.col(key) == F.col("_key")) & F.col(style).eqNullSafe(F.col("_style")), "left")
    return out.withColumn("style_id", F.coalesce("_id", F.lit(0))).drop("_key", "_style", "_id")


#: Kinds of lines.
PLAIN, BULLET, NUMBER = "PLAIN", "UNORDERED_LIST", "ORDERED_LIST"


def list_lines(texts: DataFrame, key: str, text: str, kind: str) -> DataFrame:
    """(key, line, line_type, indent, is_first) of texts that are a list as a whole: `kind` is number, else bullet.

    An empty last line is plain; the first line of a list is one after a plain line, or the first of all.
    """
    lines = texts.select(key, F.col(kind).alias("_kind"), F.split(text, "\n").alias("_lines"))
    lines = lines.select(key, "_kind", F.size("_lines").alias("_n"), F.posexplode("_lines").alias("line", "content"))
    last = (F.col("line") == F.col("_n") - 1) & (F.col("content") == "")
    kind_of = F.when(last, PLAIN).when(F.col("_kind") == "number", NUMBER).otherwise(BULLET)
    return lines.select(key, "line", kind_of.alias("line_type"), F.when(last, 0).otherwise(1).alias("indent"), (~last & (F.col("line") == 0)).alias("is_first"))


def run_lines(texts: DataFrame, runs: DataFrame, key: str = "key") -> DataFrame:
    """(key, line, line_type, indent, is_first) of texts (key, text) made of runs (key, run_start in UTF-16 units, bullet, number, indent).

    A line is of the kind of the run that holds its first character: bullet before number; an empty last line is plain. The
    first line of a list differs in kind or indent from the line before.
    """
    starts = line_offsets(texts, key, "text")
    kind = F.when(F.coalesce("bullet", F.lit(False)), BULLET).when(F.coalesce("number", F.lit(False)), NUMBER).otherwise(PLAIN)
    told = runs.select(key, "run_start", F.struct(kind.alias("kind"), F.when(kind == PLAIN, 0).otherwise(F.coalesce("indent", F.lit(1))).alias("indent")).alias("run"))
    lines = starts.join(run_at(starts.select(key, "start").distinct(), told, key, "start", "run_start", "run"), [key, "start"])
    ends = starts.groupBy(key).agg(F.max("line").alias("_last"))
    lines = lines.join(ends, key)
    plain = (F.col("line") == F.col("_last")) & (F.col("length") == 0)
    lines = lines.withColumn("line_type", F.when(plain, PLAIN).otherwise(F.coalesce("run.kind", F.lit(PLAIN))))
    lines = lines.withColumn("indent", F.when(plain, 0).otherwise(F.coalesce("run.indent", F.lit(0))))
    out = first_of_list(lines, key, "line", "line_type", "indent")
    return out.select(key, "line", "line_type", "indent", (F.col("is_first") & (F.col("line_type") != PLAIN)).alias("is_first"))

"""Fonts that documents need, and where they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sceneloom.functions.scalars import inventory_weight

from .tree import walk


def inventory(texts: DataFrame) -> DataFrame:
    """(family, weight): each family and weight in texts (family, style), once."""
    return texts.where("coalesce(family, '') <> ''").select("family", inventory_weight(F.col("style")).alias("weight")).distinct()


def cache_key(family: Column, weight: Column) -> Column:
    """File name of a cached font."""
    return F.concat(F.concat_ws("-", family, weight.cast("string"), F.lit("normal")), F.lit(".ttf"))


def resolve(needed: DataFrame, builtin: DataFrame, sources: DataFrame) -> DataFrame:
    """(family, n_weights, n_missing, missing, state) of each family in needed (family, weight) that is not built in (column family).

    sources: (key, source); a weight is found under its cache key. States: resolved, partial, failed.
    """
    wanted = needed.join(builtin.select("family").distinct(), "family", "left_anti").withColumn("key", cache_key(F.col("family"), F.col("weight")))
    seen = sources.select("key", F.lit(True).alias("_found")).distinct()
    per = wanted.join(seen, "key", "left").groupBy("family").agg(F.count(F.lit(1)).alias("n_weights"), F.sort_array(F.collect_list(F.when(F.col("_found").isNull(), F.col("weight")))).alias("missing"))
    gone = F.size("missing")
    state = F.when(gone == 0, "resolved").when(gone == F.col("n_weights"), "failed").otherwise("partial")
    return per.select("family", "n_weights", gone.cast("long").alias("n_missing"), "missing", state.alias("state"))


def sources_of(needed: DataFrame, builtin: DataFrame, sources: DataFrame) -> DataFrame:
    """(family, weight, source): where each weight in needed that is not built in (column family) comes from: of sources (key, source, rank) that have it the
    one of the lowest rank (cache, then downloads, then the system); null where none has. A weight is asked for only where those before lack it."""
    wanted = needed.join(builtin.select("family").distinct(), "family", "left_anti").withColumn("key", cache_key(F.col("family"), F.col("weight")))
    first = sources.groupBy("key").agg(F.min_by("source", "rank").alias("source"))
    return wanted.join(first, "key", "left").select("family", "weight", "source")


def preferred(found: DataFrame, key: list[str], rank: str, path: str) -> DataFrame:
    """(key, path): of the paths that exist, the one that comes first."""
    return found.where(F.col(path).isNotNull()).groupBy(*key).agg(F.min_by(path, rank).alias(path))


#: Endings of font files, names by weight, and file names of packaged fonts in order of preference.
ENDINGS = ("ttf", "otf", "woff", "woff2")
WEIGHT_NAMES = {
    100: ("thin", "hairline"), 200: ("extralight", "ultralight"), 300: ("light",), 400: ("regular", "normal"), 500: ("medium",),
    600: ("semibold", "demibold"), 700: ("bold",), 800: ("extrabold", "ultrabold"), 900: ("black", "heavy"),
}
PACKAGED = ("{}-latin-{}-normal.woff2", "{}-latin-{}-normal.woff", "{}-latin-{}-normal.ttf", "{}-all-{}-normal.woff2")


def read_fonts(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes) of every font file below a folder that Spark can list."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(ENDINGS) + "}")
    return files.load(folder).select("path", F.col("content").alias("bytes"))


def packaged(families: DataFrame, files: DataFrame) -> DataFrame:
    """(slug, weight, file): for each of families (slug, weight) the preferred one of its packaged files that is in files (column file)."""
    names = F.array(*(F.format_string(p.replace("{}", "%s"), F.col("slug"), F.col("weight").cast("string")) for p in PACKAGED))
    wanted = families.select("slug", "weight", F.posexplode(names).alias("rank", "file"))
    return preferred(wanted.join(files.select("file").distinct(), "file"), ["slug", "weight"], "rank", "file")


def with_fallback(files: DataFrame, whole: list[str], fallback: list[str]) -> DataFrame:
    """(family, file, is_fallback) of each family in files (family, file): the files of `whole` if all are there, else what there is of `fallback`, marked as such."""
    kept = files.where(F.col("file").isin([*whole, *fallback])).distinct()
    have = files.groupBy(F.col("family").alias("_family")).agg((F.count_distinct(F.when(F.col("file").isin(whole), F.col("file"))) == len(set(whole))).alias("_whole"))
    out = kept.join(have, F.col("family") == F.col("_family"))
    return out.where(F.when(F.col("_whole"), F.col("file").isin(whole)).otherwise(F.col("file").isin(fallback))).select("family", "file", (~F.col("_whole")).alias("is_fallback"))


def all_or_none(found: DataFrame, family: str, weights: list[int]) -> DataFrame:
    """(family, complete): whether every one of a family's weights is found (family, weight); a part of them does not count."""
    have = found.where(F.col("weight").isin(weights)).groupBy(family).agg(F.count_distinct("weight").alias("n"))
    return have.select(family, (F.col("n") == len(weights)).alias("complete"))


#: A family is looked up by so many of its first letters (or all, where it has fewer) wherever they stand in a file's name.
SLUG_KEY = 6


def by_part(fonts: DataFrame) -> DataFrame:
    """fonts (low: a file's name, and others) once for each different part of the name, of up to SLUG_KEY letters, as key."""
    low = F.col("low")
    parts = F.transform(F.sequence(F.lit(0), F.lit(SLUG_KEY)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - n + 1, F.lit(1))), lambda i: F.substr(low, i, n)))
    return fonts.withColumn("key", F.explode(F.array_distinct(F.flatten(parts))))


def system_fonts(needed: DataFrame, files: DataFrame) -> DataFrame:
    """(family, weight, file): the first of files (ord, file) that a family and weight can use.

    A name has the family in it, with blanks left out, as dashes or as underscores, and one of the weight's names; a
    plain name (no dash and word before its ending) is regular, and a collection serves all weights.
    """
    low = F.lower("file")
    fonts = files.where(low.rlike(r"\.(ttf|otf|ttc)$")).select("ord", "file", low.alias("low"))
    family = F.lower("family")
    slugs = F.array(*(F.regexp_replace(family, r"\s+", by) for by in ("", "-", "_")))
    wanted = needed.select("family", "weight", F.explode(F.array_distinct(slugs)).alias("slug")).withColumn("key", F.substring("slug", 1, SLUG_KEY))
    both = by_part(fonts).join(wanted, "key").where(F.col("low").contains(F.col("slug")))
    plain = (F.col("weight") == 400) & ~F.col("low").rlike(r"-\w+\.")
    named = F.lit(False)
    for weight, names in WEIGHT_NAMES.items():
        for name in names:
            named = named | ((F.col("weight") == weight) & F.col("low").contains(name))
    fits = F.col("low").endswith(".ttc") | plain | named
    return both.where(fits).groupBy("family", "weight").agg(F.min_by("file", "ord").alias("file"))


def scan(nodes: DataFrame, slides: DataFrame) -> DataFrame:
    """(family, weight) of the live texts below slides (column id): removed nodes end a branch, and instances are not entered."""
    below = walk(nodes, slides, skip_removed=True, path=False).select("id").distinct()
    texts = nodes.join(below, "id").where("type = 'TEXT'")
    return inventory(texts.select(F.col("font_family").alias("family"), F.col("font_style").alias("style")))

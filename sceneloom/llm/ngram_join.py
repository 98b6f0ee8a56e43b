"""Jaccard self-join on word n-grams, and its connected groups.

1. Rows with equal sets are one class, told apart by two 64-bit sums over the set; only classes are joined.
2. In the order "n-grams of one class only first", two classes can link only if each has, among its first
   p = n - ceil(t n) + 1, one that another class has. So a class that is seen to have p n-grams of its own is
   out, exactly. Owners meet by hash: of a small hashed share of the n-grams first, then, for the classes
   that are left, of a larger share.
3. For the rest, exact frequencies put n-grams in rare-first order. Prefixes meet on common n-grams; a
   meeting passes the length filter and the positional filter; a pair, once it is distinct, passes the
   suffix filter (counts of n-grams by hash range bound the overlap) and is verified once.
4. Pairs are not all listed within a group: each class first meets the smallest class of each of its
   prefix n-grams; where an n-gram then still holds several components, only pairs that cross
   components, of lengths that may link, are tried. So every link that could join two groups is tested.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_batches, components, documents, drop_written, list_array, mix, shingle_sets, small_enough, written

#: Bytes of (n-gram, owner) pairs that one task of the first filter takes.
BUCKET_BYTES = 8 << 20
#: Bytes of an n-gram's hash that are sent to its bucket: a false match keeps a class that could go, no more.
SENT = 5
#: N-grams that a task remembers as sent for two owners already.
REMEMBERED = 1 << 18
#: Bytes of text that are looked at together.
TEXT_BYTES = 1 << 20
#: Hash ranges of the suffix filter.
RANGES = 16
#: N-grams that a row remembers of its prefix: a pair that meets in two places far apart is found twice and counted once.
BEFORE = 32

#: Of all n-grams: the share up to which the second filter looks.
SECOND_SHARE = 0.5

ROWS = "kind tinyint, key bigint, doc_id bigint, n bigint, d1 bigint, d2 bigint, alone bigint, bucket int, pairs binary"


def _digests(at: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums over each set that tell sets apart."""
    total = lambda x: np.diff(np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])[at])
    return total(mix(grams ^ np.uint64(0x1F3D5B79))), total(mix(grams * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(5)))


def _in_share(grams: np.ndarray, share: tuple[float, float]) -> np.ndarray:
    """N-grams whose hash lies in a share of all, given by its ends in 0 .. 1."""
    at = grams >> np.uint64(20) & np.uint64(1023)
    low, high = (np.uint64(math.ceil(x * 1024)) for x in share)
    return (at >= low) & (at < high)


class _Owners:
    """What a task sends of its batches' n-grams: each with its owners, but no more than two owners of one n-gram.

    An n-gram of which the task has seen two owners is answered at once: its owners here know that others have it.
    """

    def __init__(self, buckets: int) -> None:
        self.buckets, self.told = buckets, np.zeros(0, np.uint64)

    def send(self, key: np.ndarray, owner: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """(buckets, blobs, answered) of n-grams with their owners' digests; answered has one number of `of` for each answer."""
        order = np.lexsort((owner, key))
        key, owner, of = key[order], owner[order], of[order]
        new_key = np.ones(len(key), bool)
        new_key[1:] = key[1:] != key[:-1]
        new_pair = new_key.copy()
        new_pair[1:] |= owner[1:] != owner[:-1]
        known = np.zeros(len(key), bool)
        if len(self.told):
            known = self.told[np.minimum(np.searchsorted(self.told, key), len(self.told) - 1)] == key
        local, rank = np.zeros(len(key), bool), np.cumsum(new_pair)
        if len(key):
            group = np.cumsum(new_key) - 1
            local = np.bincount(group, new_pair)[group] > 1
            rank -= rank[np.flatnonzero(new_key)][group]
        sent, answered = new_pair & ~known & (rank < np.where(local, 2, 1)), local | known
        fresh = np.unique(key[local & ~known])
        self.told = np.union1d(self.told, fresh) if len(self.told) + len(fresh) <= REMEMBERED else np.unique(key[answered])[:REMEMBERED]
        key, owner, quiet = key[sent], owner[sent], local[sent]
        bucket = (mix(key ^ np.uint64(0x2545F491)) % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        full = np.flatnonzero(np.diff(edges))
        short = key.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :SENT]
        parts = [order[edges[b] : edges[b + 1]] for b in full]
        return full, [short[o].tobytes() + owner[o].tobytes() + quiet[o].tobytes() for o in parts], of[answered]


def _sets(n: int, share: tuple[float, float], buckets: int):
    """Rows of documents (kind 0) and of blobs (kind 1: n-grams of the share with owners, for a bucket).

    alone: how many n-grams of the share no other class of the task's batches has.
    """

    def run(batches):
        owners = _Owners(buckets)
        for rows, data, off in byte_batches(batches, "text", TEXT_BYTES):
            column = lambda c: rows.column(rows.schema.get_field_index(c))  # noqa: B023, E731
            at, grams = shingle_sets(data, off, n)
            d1, d2 = _digests(at, grams)
            size = np.diff(at)
            docs = len(size)
            doc = np.repeat(np.arange(docs), size)
            chosen = _in_share(grams, share)
            full, blobs, answered = owners.send(grams[chosen], d1[doc[chosen]], doc[chosen])
            alone = np.bincount(doc[chosen], minlength=docs) - np.bincount(answered, minlength=docs)
            empty = lambda kind, k: pa.nulls(k, kind)
            numbers = {"n": size, "d1": d1.view(np.int64), "d2": d2.view(np.int64), "alone": alone}
            yield pa.RecordBatch.from_pydict({
                "kind": pa.array(np.zeros(docs), pa.int8()), "key": column("key"), "doc_id": column("doc_id"),
                **{c: pa.array(v, pa.int64()) for c, v in numbers.items()}, "bucket": empty(pa.int32(), docs), "pairs": empty(pa.binary(), docs),
            })
            k = len(full)
            yield pa.RecordBatch.from_pydict({
                "kind": pa.array(np.ones(k), pa.int8()), **{c: empty(pa.int64(), k) for c in ("key", "doc_id", *numbers)},
                "bucket": pa.array(full, pa.int32()), "pairs": pa.array(blobs, pa.binary()),
            })

    return run


def _answer(table: pa.Table) -> pa.Table:
    """Of one bucket: for each class, how many of its n-grams another class has too."""
    keys, owners, quiets = [], [], []
    for blob in table.column("pairs").to_pylist():
        n = len(blob) // (SENT + 9)
        wide = np.zeros((n, 8), np.uint8)
        wide[:, 8 - SENT :] = np.frombuffer(blob, np.uint8, n * SENT).reshape(-1, SENT)
        keys.append(wide.view(">u8").reshape(-1).astype(np.uint64))
        owners.append(np.frombuffer(blob, np.uint64, n, n * SENT))
        quiets.append(np.frombuffer(blob, bool, n, n * (SENT + 8)))
    key, owner, quiet = map(np.concatenate, (keys, owners, quiets))
    order = np.lexsort((quiet, owner, key))
    key, owner, quiet = key[order], owner[order], quiet[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    stop = np.concatenate([start[1:], [len(key)]])
    shared = np.repeat(owner[start] != owner[stop - 1], stop - start)
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    found, count = np.unique(owner[shared & first & ~quiet], return_counts=True)
    return pa.table({"d1": pa.array(found.view(np.int64)), "answers": pa.array(count, pa.int64())})


def _whole_sets(n: int):
    """(cls, n, grams, ranges) of rows with the digests d1, d2 that their class has."""

    def run(batches):
        for rows, data, off in byte_batches(batches, "text", TEXT_BYTES):
            column = lambda c: rows.column(rows.schema.get_field_index(c))  # noqa: B023, E731
            at, grams = shingle_sets(data, off, n)
            d1, d2 = _digests(at, grams)
            whole = lambda c: column(c).to_numpy(zero_copy_only=False).view(np.uint64)  # noqa: B023, E731
            keep = pa.array((d1 == whole("d1")) & (d2 == whole("d2")))
            docs = len(off) - 1
            spread = np.repeat(np.arange(docs), np.diff(at)) * RANGES + (grams >> np.uint64(13) & np.uint64(RANGES - 1)).astype(np.int64)
            ranges = list_array(np.arange(docs + 1) * RANGES, np.bincount(spread, minlength=docs * RANGES).astype(np.int32))
            columns = [column("cls"), pa.array(np.diff(at), pa.int64()), list_array(at, grams.view(np.int64)), ranges]
            yield pa.RecordBatch.from_arrays(columns, names=["cls", "n", "grams", "ranges"]).filter(keep)

    return run


def _bounded(df: DataFrame) -> DataFrame:
    """df, to be broadcast if its measured size is within the bound."""
    return F.broadcast(df) if small_enough(df) else df


def _overlap(x: Column, y: Column) -> Column:
    """The most n-grams that two sets can share, by their counts in hash ranges."""
    return sum((F.least(x[k], y[k]) for k in range(1, RANGES)), F.least(x[0], y[0]))


class _Join:
    """The steps that share the parameters."""

    def __init__(self, n: int, num: int, den: int) -> None:
        self.n, self.num, self.den = n, num, den

    def prefix(self) -> Column:
        """Length of the prefix of a set of n."""
        return F.expr(f"n - (n * {self.num} + {self.den} - 1) div {self.den} + 1")

    def texts(self, docs: DataFrame, classes: DataFrame) -> DataFrame:
        """Rows (cls, d1, d2, doc_id, key, text) that stand for classes (cls, key, d1, d2)."""
        return docs.join(_bounded(classes.select("cls", "key", "d1", "d2")), "key").select("cls", "d1", "d2", "doc_id", "key", "text")

    def filtered(self, docs: DataFrame, classes: DataFrame, share: tuple[float, float], buckets: int) -> DataFrame:
        """classes (cls, key, d1, d2, n, doc, alone) that may link by the n-grams of one more share of hashes; alone counts those that nothing else has so far."""
        raw = written(self.texts(docs, classes).drop("d1", "d2", "cls").mapInArrow(_sets(self.n, share, buckets), ROWS))
        alone = raw.where("kind = 0").groupBy("d1", "d2").agg(F.max("alone").alias("more"))
        out = classes.join(alone, ["d1", "d2"]).join(_answers(raw), "d1", "left")
        out = out.withColumn("alone", F.col("alone") + F.col("more") - F.coalesce("answers", F.lit(0))).where(F.col("alone") < self.prefix())
        out = written(out.select(*classes.columns))
        drop_written(raw)
        return out

    def links(self, both: Column, x: Column, y: Column) -> Column:
        return self.den * both >= self.num * (x + y - both)

    def near(self, x: Column, y: Column) -> Column:
        return self.den * F.least(x, y) >= self.num * F.greatest(x, y)

    def fits(self, x: str, y: str) -> Column:
        """Length and position allow a link: at counts the n-grams before this one, shared those of them that other classes have."""
        a, b = (lambda c: F.col(f"{x}.{c}")), (lambda c: F.col(f"{y}.{c}"))
        bound = F.least(a("shared"), b("shared")) + F.least(a("n") - a("at"), b("n") - b("at"))
        return self.near(a("n"), b("n")) & self.links(bound, a("n"), b("n"))

    def ranked(self, sets: DataFrame) -> DataFrame:
        """(cls, n, ranges, alone, grams) of each class: grams are those that other classes have, rarest first; alone counts the others."""
        spread = sets.select("cls", F.explode("grams").alias("g"))
        often = spread.groupBy("g").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
        listed = spread.join(often, "g").groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("df", "g"))).alias("x"))
        both = sets.select("cls", "n", "ranges").join(listed, "cls")
        return written(both.select("cls", "n", "ranges", F.col("x.g").alias("grams"), (F.col("n") - F.size("x")).alias("alone")))

    def posts(self, ranked: DataFrame) -> DataFrame:
        """(g, cls, n, at, shared) of each n-gram in a prefix that others have."""
        rows = ranked.withColumn("length", (self.prefix() - F.col("alone")).cast("int")).where("length > 0")
        rows = rows.select("cls", F.col("n").cast("int").alias("n"), F.col("alone").cast("int").alias("alone"), F.posexplode(F.slice("grams", F.lit(1), F.col("length"))).alias("i", "g"))
        return written(rows.select("g", "cls", "n", (F.col("alone") + F.col("i")).alias("at"), (F.col("i") + 1).alias("shared")))

    def star(self, posts: DataFrame) -> DataFrame:
        """Pairs (a, b) of each class with the smallest class of each of its prefix n-grams."""
        row = F.struct("cls", "n", "at", "shared")
        centres = posts.groupBy("g").agg(F.min(row).alias("y"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
        met = posts.select("g", row.alias("x")).join(centres, "g").where("x.cls <> y.cls").where(self.fits("x", "y"))
        return met.select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct()

    def across(self, posts: DataFrame, found: DataFrame, ranked: DataFrame) -> DataFrame:
        """Pairs (a, b) that meet in an n-gram and are of different components (id, component); found has the components so far.

        An n-gram's rows outside its largest component meet the others in bands of length: a link's two
        lengths are in one band or in neighbouring ones. Rows here have the counts of the suffix filter with them, and
        the n-grams of their prefix just before this one: a pair that has one of those in common meets there, and not again here.
        """
        labelled = posts.join(found.withColumnRenamed("id", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
        labelled = written(labelled)
        groups = labelled.groupBy("g", "component").agg(F.count(F.lit(1)).alias("k"))
        mixed = groups.groupBy("g").agg(F.count(F.lit(1)).alias("several"), F.max_by("component", F.struct("k", "component")).alias("main"))
        mixed = mixed.where("several > 1").drop("several")
        band = F.floor(F.log(F.col("n").cast("double")) / math.log(self.den / self.num) + 1e-9).cast("int")
        there = labelled.join(mixed, "g").join(ranked.select("cls", "ranges", "grams"), "cls")
        first = F.greatest(F.lit(1), F.col("shared") - BEFORE)
        there = there.withColumn("before", F.slice("grams", first, F.col("shared") - first))
        there = written(there.select("g", "main", band.alias("band"), F.struct("cls", "n", "at", "shared", "component", "ranges", "before").alias("x")))
        odd = there.where("x.component <> main").select("g", "x", F.explode(F.array(*(F.col("band") + k for k in (-1, 0, 1)))).alias("band"))
        other = there.select("g", "main", "band", F.col("x").alias("y"))
        met = odd.join(other, ["g", "band"]).where("x.component <> y.component and (y.component = main or x.cls < y.cls)").where(self.fits("x", "y"))
        met = met.where(~F.arrays_overlap("x.before", "y.before"))
        met = met.where(self.links(_overlap(F.col("x.ranges"), F.col("y.ranges")), F.col("x.n"), F.col("y.n")))
        pairs = written(met.select(F.greatest("x.cls", "y.cls").alias("a"), F.least("x.cls", "y.cls").alias("b")).distinct())
        drop_written(labelled)
        drop_written(there)
        return pairs

    def verified(self, pairs: DataFrame, ranked: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (a, b) whose overlap reaches the threshold, each computed once, after the suffix filter."""
        side = lambda x: ranked.select(F.col("cls").alias(x), F.col("n").alias(f"n_{x}"), F.col("ranges").alias(f"r_{x}"))
        bound = _overlap(F.col("r_a"), F.col("r_b"))
        close = pairs.join(side("a"), "a").join(side("b"), "b").where(self.links(bound, F.col("n_a"), F.col("n_b")))
        whole = lambda x: sets.select(F.col("cls").alias(x), F.col("grams").alias(f"g_{x}"))
        both = close.select("a", "b", "n_a", "n_b").join(whole("a"), "a").join(whole("b"), "b")
        return written(both.where(self.links(F.size(F.array_intersect("g_a", "g_b")), F.col("n_a"), F.col("n_b"))).select("a", "b"))

    def edges(self, docs: DataFrame, classes: DataFrame) -> DataFrame:
        """Verified links between classes (a, b), enough to connect whatever links connect."""
        sets = self.texts(docs, classes).mapInArrow(_whole_sets(self.n), "cls bigint, n bigint, grams array<bigint>, ranges array<int>")
        sets = written(sets.dropDuplicates(["cls"]))  # exact repetitions of a row stand for one class
        ranked = self.ranked(sets)
        posts = self.posts(ranked)
        tried = written(self.star(posts))
        first = self.verified(tried, ranked, sets)
        pairs = self.across(posts, components(first).select("id", "component"), ranked)
        before = tried.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        new = written(pairs.join(before, ["a", "b"], "left_anti"))
        out = first if new.isEmpty() else first.unionByName(self.verified(new, ranked, sets))
        for table in (sets, ranked, posts, tried, pairs):
            drop_written(table)
        return out


def _answers(raw: DataFrame) -> DataFrame:
    """(d1, answers): how many n-grams of a class others have, by the blobs of raw."""
    found = raw.where("kind = 1").select("bucket", "pairs").groupBy("bucket").applyInArrow(_answer, "d1 bigint, answers bigint")
    return found.groupBy("d1").agg(F.sum("answers").alias("answers"))


def link_documents(docs: DataFrame, n: int = 3, num: int = 9, den: int = 10) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), key and first_key of every row of docs.

    key is a hash of the row's doc_id and text; first_key is the key of the oldest text (by doc_id, null last) of
    those that its links reach, before links of one doc_id are pooled: the row that can stand for all.

    Words are lower-cased (A-Z); a text with 1 to n - 1 words has its whole sequence as its one n-gram; null
    and empty texts have none, link with nothing, and are their own component. Two rows link when
    den * |intersection| >= num * |union|. Rows with one doc_id are one document: each set is compared by
    itself, then their links are pooled. A row without a doc_id links like any other; its component is
    null if no row that it reaches has a doc_id. Columns other than doc_id and text are not looked at;
    an empty table gives an empty table. Large ties cost no more: equal sets are one class. A very long
    text is one batch by itself. Links are tested as far as components need, not listed.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = docs.withColumn("key", F.xxhash64("doc_id", "text"))
    share = min(1.0, 1.5 * (den - num) / den)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(128, math.ceil(size / 6 * share * (SENT + 9) / BUCKET_BYTES))
    raw = written(docs.mapInArrow(_sets(n, (0.0, share), buckets), ROWS))
    members = raw.where("kind = 0").select("key", "doc_id", "n", "d1", "d2", "alone")
    classes = members.where("n > 0").groupBy("d1", "d2", "n")
    oldest = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)), "key")
    classes = classes.agg(F.min("doc_id").alias("doc"), F.min_by("key", oldest).alias("key"), F.max("alone").alias("alone"), F.count(F.lit(1)).alias("copies"))
    classes = classes.join(_answers(raw), "d1", "left").withColumn("alone", F.col("alone") - F.coalesce("answers", F.lit(0))).drop("answers")
    classes = written(classes)
    join = _Join(n, num, den)
    # Classes are numbered in order of their smallest doc_id, so that the smallest class of an n-gram is its oldest text.
    ordered = classes.where(F.col("alone") < join.prefix()).drop("copies").repartitionByRange(F.col("doc").asc_nulls_last(), "key")
    hopeful = written(ordered.sortWithinPartitions(F.col("doc").asc_nulls_last(), "key").withColumn("cls", F.monotonically_increasing_id()))
    hopeful = join.filtered(docs, hopeful, (share, max(share, SECOND_SHARE)), buckets)
    groups = components(join.edges(docs, hopeful)).select(F.col("id").alias("cls"), "component")
    labelled = written(hopeful.select("cls", "key", "d1", "d2", "n", "doc").join(groups, "cls"))
    least = labelled.groupBy("component").agg(F.min("doc").alias("component_id"), F.min_by("key", "cls").alias("first_key"))
    linked = labelled.join(least, "component").select("d1", "d2", "n", "component_id", "first_key")
    copies = classes.where("copies > 1").select("d1", "d2", "n", F.col("doc").alias("component_id"), F.col("key").alias("first_key"))
    copies = copies.join(linked.select("d1", "d2", "n"), ["d1", "d2", "n"], "left_anti")
    named = _bounded(written(linked.unionByName(copies).withColumn("_named", F.lit(True))))
    out = members.drop("alone").join(named, ["d1", "d2", "n"], "left")
    own = lambda c, d: F.when(F.col("_named"), F.col(c)).otherwise(F.col(d)).alias(c)
    return _pooled(out.select("doc_id", F.col("n").alias("n_shingles"), own("component_id", "doc_id"), "key", own("first_key", "key")))


def _pooled(rows: DataFrame) -> DataFrame:
    """rows with the components of one doc_id made one."""
    ids = rows.where("doc_id is not null and n_shingles > 0 and component_id is not null")
    several = ids.groupBy("doc_id").agg(F.min("component_id").alias("b"), F.max("component_id").alias("most")).where("b < most").select("doc_id", "b")
    several = written(several)
    if several.isEmpty():
        return rows
    edges = ids.join(_bounded(several), "doc_id").select(F.col("component_id").alias("a"), "b").distinct()
    joined = components(edges).select(F.col("id").alias("component_id"), F.col("component").alias("_joined"))
    out = rows.join(_bounded(written(joined)), "component_id", "left")
    return out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.coalesce("_joined", "component_id")).otherwise(F.col("component_id"))).select(*rows.columns)


#: Words, shingles, all pairs that share one, and what is reachable: the same rows by plain SQL.
OP1_SQL = r"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [list_aggregate(w, 'string_agg', ' ')]
  ELSE list_transform(range(1, len(w) - 1), lambda k: list_aggregate(w[k : k + 2], 'string_agg', ' ')) END) AS gram FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 90 * (x.n + y.n - common)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce((SELECT min(r.b) FROM r WHERE r.a = d.doc_id), d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id"""


def op1_ngram_join(spark, sf_dir: str) -> DataFrame:
    return link_documents(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")

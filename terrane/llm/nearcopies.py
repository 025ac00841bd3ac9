"""Near-duplicate detection by tensored MinHash banding, confirmed on full shingle sets.

Two collections of ``tables`` sub-keys are computed for each distinct shingle set, each from ``rows`` minhashes; every pair
of a sub-key of the one and a sub-key of the other is a table key.  So tables^2 keys of 2 * rows minhashes cost only
2 * tables * rows minhash evaluations.  Two sets of similarity s share a key unless one collection has no common sub-key:
they are missed with probability at most 2 * (1 - s^rows)^tables.  With 3 rows, the tables are as many as keep that under 4e-4 at the threshold: 9 at s = 0.85, 12 at 0.80.

Documents with equal sets are one class.  In each bucket of equal keys a leader, the class with the most bucket mates, is
compared with every other class on full sets (linear in the bucket), which links most of a group at once.

Links between two other classes of a bucket are found without making its pairs.  Let b be the leader, D(x) the shingles in
which x differs from b (taken from it or added to it).  With s = |D(x) & D(y)|, the sets x and y have an intersection of
|b| - removed + s and a union of |b| + added - s, so they are linked if and only if s reaches a bound that is a sum of a term
of x and a term of y.  If x is not linked with b the bound is positive: x and y must share differences.  Only links between
two components matter by then, so differences found in one component alone are left out: a variant of any size that its own
leaders have made one component drops out as a whole.  Ordering each D by how rare its elements are among b's classes, x and y
must share one of the first |D| - bound + 1 (prefix filter); joining those gives the candidates, less those whose rests after
a common element are too short (positional filter); s itself then decides.  Both ends linked with b are in one component already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.components import connected_components
from .common import forget, materialize, release_shuffles, settled, text_batches, texts_of

ROWS, MISSED = 3, 4e-4
WORDS_REMEMBERED = 500_000
SALTS = 16  # parts of a leader's classes
PRUNINGS = 2  # each takes away elements and classes that can't be linked; more only save rows


def tables_for(percent: int, rows: int = ROWS, missed: float = MISSED) -> int:
    """Least tables with which a pair at the threshold shares no key with probability ``missed`` at most."""
    if not 0 < percent <= 100:
        raise ValueError("percent must be over 0 and up to 100")
    tables, none = 1, 1 - (percent / 100) ** rows
    while 2 * none**tables > missed:
        tables += 1
    return tables


class Shingler:
    """64-bit hashes of the distinct shingles of a text; word hashes are remembered."""

    def __init__(self, width: int):
        self.width, self.words = width, {}
        self.mult = [pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) | 1 for k in range(width)]

    def hashes(self, text: bytes) -> np.ndarray:
        known = self.words
        words = text.lower().split()
        try:
            h = np.array([known[w] for w in words], np.uint64)
        except KeyError:
            if len(known) > WORDS_REMEMBERED:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            h = np.array([known[w] for w in words], np.uint64)
        n = len(h) - self.width + 1
        if n <= 0:
            if not len(h):
                return h
            n, width = 1, len(h)
        else:
            width = self.width
        out = np.full(n, width, np.uint64)
        for k in range(width):
            out += h[k : k + n] * np.uint64(self.mult[k])
            out ^= out >> np.uint64(31)
            out *= np.uint64(0xD6E8FEB86659FD93)
        return np.unique(out ^ (out >> np.uint64(32)))


class MinHasher:
    def __init__(self, size: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, size, dtype=np.uint64)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        """The upper half of the smallest a * x + b (mod 2^64), for each a and b."""
        out = None
        for k in range(0, len(hashes), 2048):
            low = (hashes[k : k + 2048, None] * self.a + self.b).min(axis=0)
            out = low if out is None else np.minimum(out, low)
        return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _digest(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    d = xxhash.xxh3_128_intdigest(hashes.tobytes())
    return (d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63)


def _sketches(width: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, hasher = Shingler(width), MinHasher(size)
        for b in batches:
            cols: list[list] = [[], [], [], []]
            for text in texts_of(b.column(1)):
                h = shingler.hashes(text)
                cols[0].append(len(h))
                for c, x in zip(cols[1:], _digest(h)):
                    c.append(x)
                cols[3].append(hasher.signature(h) if len(h) else None)
            yield pa.record_batch([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.list_(pa.int32()))], ["doc_id", "n_shingles", "h1", "h2", "minhashes"])

    return run


def _compare(width: int):
    """Full sets of leader and member: the leader's size, and the member's differences, removed (odd) and added (even)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, last, held = Shingler(width), None, None
        for b in batches:
            sizes, removed, diffs = [], [], []
            for x, text, other in zip(b.column(0).to_pylist(), texts_of(b.column(2)), texts_of(b.column(3))):
                if x != last:
                    last, held = x, shingler.hashes(text)
                h = shingler.hashes(other)
                gone, new = np.setdiff1d(held, h, assume_unique=True), np.setdiff1d(h, held, assume_unique=True)
                sizes.append(len(held))
                removed.append(len(gone))
                diffs.append(np.concatenate([gone | np.uint64(1), new & ~np.uint64(1)]).view(np.int64))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(diffs, pa.list_(pa.int64()))], ["a", "x", "size", "removed", "diff"])

    return run


def cluster(docs: DataFrame, shingle_words: int = 5, percent: int = 80, tables: int | None = None, rows: int = ROWS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each row of ``docs``.

    Words are lower-cased in ASCII and cut at ASCII white space; a text with fewer words than a shingle is one shingle, one
    without words has none and is linked with nothing.  Sets are compared by 64-bit hashes of their shingles.  Repeated rows
    have equal sets and so one component; the same id with different texts counts as different rows.  A null id is never a
    component's id unless the whole component has none.
    """
    spark = docs.sparkSession
    text_batches(spark)
    tables = tables or tables_for(percent, rows)
    size = 2 * tables * rows
    rows_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketched = materialize(rows_.mapInArrow(_sketches(shingle_words, size), "doc_id long, n_shingles long, h1 long, h2 long, minhashes array<int>"), "sketches")
    classes = sketched.where("n_shingles > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.first("minhashes").alias("minhashes"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")

    part = lambda c, k: F.xxhash64(F.lit(c), F.lit(k), *[F.element_at("minhashes", 1 + (c * tables + k) * rows + r) for r in range(rows)])
    halves = classes.select("cid", *[F.array(*[part(c, k) for k in range(tables)]).alias(x) for c, x in ((0, "left"), (1, "right"))])
    keys = halves.select("cid", F.explode("left").alias("l"), "right").select("cid", "l", F.explode("right").alias("r")).select("cid", F.xxhash64("l", "r").alias("key"))
    # Written, so that the join's two sides are plain exchanges, whose hot keys Spark can split; so are the tables below.
    shared = materialize(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    release_shuffles(spark)
    buckets = materialize(keys.join(shared, "key"), "buckets")  # only keys that two classes share
    release_shuffles(spark)
    forget(shared)
    mates = buckets.groupBy("cid").agg(F.sum(F.col("n") - 1).alias("mates"))
    leaders = buckets.join(mates, "cid").groupBy("key").agg(F.max_by("cid", F.struct("mates", -F.col("cid"))).alias("a"))
    stars = buckets.join(leaders, "key").where("cid <> a").select("a", F.col("cid").alias("x")).distinct()
    texts = _class_texts(rows_, classes, buckets, shingle_words)
    compared = _compared(stars, texts, shingle_words, percent)
    forget(buckets, texts)
    links = compared.where("linked").select("a", "x")
    durable = lambda df: settled(df, "components")
    components = connected_components(links, durable)
    more = settled(_links_beside_leaders(compared, components, percent), "more-links")
    if not more.isEmpty():
        components = connected_components(links.union(more), durable)
    forget(compared, more)

    labelled = classes.select("cid", "h1", "h2", "first").join(components.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    by_class = settled(labelled.join(least, "component").select("h1", "h2", "component_id"), "by-class")
    out = sketched.drop("minhashes").join(by_class, ["h1", "h2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _class_texts(docs: DataFrame, classes: DataFrame, buckets: DataFrame, width: int) -> DataFrame:
    """``cid, text`` of the classes that share a bucket, found by the class's smallest id and told apart by the set's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for b in batches:
            digests = [_digest(shingler.hashes(t)) for t in texts_of(b.column(0))]
            yield pa.record_batch([pa.array([d[k] for d in digests], pa.int64()) for k in (0, 1)] + [b.column(0)], ["h1", "h2", "text"])

    needed = classes.join(buckets.select("cid").distinct(), "cid", "left_semi").select("cid", "h1", "h2", "first")
    firsts = needed.select("first").distinct()
    found = docs.join(firsts, docs["doc_id"].eqNullSafe(firsts["first"]), "left_semi").select("text").mapInArrow(run, "h1 long, h2 long, text string")
    return settled(found.join(needed.drop("first"), ["h1", "h2"]).select("cid", "text").dropDuplicates(["cid"]), "texts")


def _compared(stars: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """``a, x, size, removed, added, diff, linked`` for each leader a and member x."""
    with_x = stars.join(texts.select(F.col("cid").alias("x"), F.col("text").alias("text_x")), "x")
    both = with_x.join(texts.select(F.col("cid").alias("a"), F.col("text").alias("text_a")), "a")  # last, so that rows of one a follow each other
    rows = both.select("a", "x", "text_a", "text_x").mapInArrow(_compare(width), "a long, x long, size long, removed long, diff array<long>")
    rows = rows.withColumn("added", F.size("diff") - F.col("removed"))
    return settled(rows.withColumn("linked", 100 * (F.col("size") - F.col("removed")) >= percent * (F.col("size") + F.col("added"))), "compared")


def _across(parts: DataFrame) -> DataFrame:
    """Rows of differences (a leader, an element, a class) that can lead from one component to another.

    An element whose classes, beside its leader, are all of one component leads nowhere; a class left with fewer elements than
    its least bounds is linked with none.  ``df`` counts the element's classes, ``most`` is the component most of them have.
    """
    counts = parts.groupBy("a", "e", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = counts.groupBy("a", "e").agg(F.sum("n").alias("df"), F.count(F.lit(1)).alias("of"), F.max_by("component", F.struct("n", "component")).alias("most")).where("of > 1")
    # Written, so that the join's two sides are plain exchanges, whose hot keys Spark can split.
    rows = parts.drop("df", "most", "left").join(settled(mixed.drop("of"), "mixed"), ["a", "e"]).withColumn("left", F.count(F.lit(1)).over(Window.partitionBy("a", "x")))
    return settled(rows.where((~F.col("linked") & (F.col("left") >= F.col("least_open"))) | (F.col("left") >= F.col("least_any"))), "across")


def _shared_differences(compared: DataFrame, components: DataFrame, percent: int) -> DataFrame:
    """``a, e, x, component, most, over, term, rest, as_open, as_any``: differences that classes of two components share.

    ``as_open`` and ``as_any`` tell whether the element is in the prefix in which the class must meet another, as the end that
    isn't linked with the leader and as any end.  A leader all of whose classes are linked with it has no rows.
    """
    label = components.select(F.col("node").alias("x"), "component")
    own = compared.join(label, "x", "left").withColumn("component", F.coalesce("component", "x"))
    # With term(x) = percent * added + 100 * removed and over(x) = term(x) - slack, the bound on s is
    # (over(x) + term(y)) / (100 + percent).  Neither end differs in fewer than s elements, so its term is at least percent * s.
    own = own.withColumn("term", percent * F.col("added") + 100 * F.col("removed")).withColumn("over", F.col("term") - (100 - percent) * F.col("size"))
    own = settled(own.withColumn("salt", F.pmod(F.xxhash64("x"), F.lit(SALTS)).cast("int")), "own")
    open_ = own.where("not linked").groupBy("a").agg(F.min("over").alias("least_over"))  # above 0
    open_ = open_.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = own.join(settled(open_, "open"), ["a", "salt"])
    own = own.withColumn("least_open", F.greatest(F.lit(1), F.ceil(F.col("over") / 100)))
    own = own.withColumn("least_any", F.greatest(F.ceil((F.col("least_over") + F.col("term")) / (100 + percent)), F.col("least_open")))
    own = own.where((~F.col("linked") & (F.size("diff") >= F.col("least_open"))) | (F.size("diff") >= F.col("least_any")))
    parts = own.select("a", "x", "component", "linked", "term", "over", "least_open", "least_any", F.explode("diff").alias("e"))
    for _ in range(PRUNINGS):
        parts = _across(parts)
    rest = F.col("left") - F.row_number().over(Window.partitionBy("a", "x").orderBy("df", "e"))
    parts = parts.withColumn("left", F.count(F.lit(1)).over(Window.partitionBy("a", "x"))).withColumn("rest", rest)
    ranked = parts.withColumn("as_open", ~F.col("linked") & (F.col("rest") + 1 >= F.col("least_open"))).withColumn("as_any", F.col("rest") + 1 >= F.col("least_any"))
    return ranked.where("as_open or as_any").select("a", "e", "x", "component", "most", "over", "term", "rest", "as_open", "as_any")


def _meetings(shared: DataFrame) -> DataFrame:
    """Rows of :func:`_shared_differences` that meet in an element: an open x and any y, one of them not of the element's most
    frequent component.  So classes of that component, however many they are, don't meet one another."""
    x = shared.where("as_open").select("a", "e", "x", "component", "over", "rest", (F.col("component") == F.col("most")).alias("usual"))
    y = shared.where("as_any").select("a", "e", F.col("x").alias("y"), F.col("component").alias("of_y"), "term", F.col("rest").alias("rest_y"), (F.col("component") == F.col("most")).alias("usual_y"))
    return x.where("not usual").join(y, ["a", "e"]).union(x.where("usual").join(y.where("not usual_y"), ["a", "e"]))


def _links_beside_leaders(compared: DataFrame, components: DataFrame, percent: int) -> DataFrame:
    """Links between two members of one leader, at least one of which isn't linked with it; only across components."""
    shared = settled(_shared_differences(compared, components, percent), "shared-differences")
    # From their first common element on, they can share no more than what is left of the shorter rest (positional filter).
    enough = F.col("over") + F.col("term") <= (100 + percent) * (1 + F.least("rest", "rest_y"))
    pairs = _meetings(shared).where((F.col("x") != F.col("y")) & (F.col("component") != F.col("of_y")) & enough).select("a", "x", "y").distinct()
    side = lambda n: compared.select("a", F.col("x").alias(n), "size", *[F.col(c).alias(f"{c}_{n}") for c in ("removed", "added", "diff")])
    both = pairs.join(side("x"), ["a", "x"]).join(side("y").drop("size"), ["a", "y"])
    s = F.size(F.array_intersect("diff_x", "diff_y"))
    inter, union = F.col("size") - F.col("removed_x") - F.col("removed_y") + s, F.col("size") + F.col("added_x") + F.col("added_y") - s
    return both.where(100 * inter >= percent * union).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("x")).distinct()


def drop_copies(docs: DataFrame, **options) -> DataFrame:
    """One row of each component stays, with all its columns: that of the smallest doc_id, once if it is repeated.

    Different texts under one id are one document here: its rows stay if one of them is kept.
    """
    ids = cluster(docs, **options).where("kept").select(F.col("doc_id").alias("__id")).distinct()
    one = Window.partitionBy("__key", "__text").orderBy("__text")
    rows = docs.withColumns({"__key": F.col("doc_id").cast("long"), "__text": F.xxhash64("text")})
    rows = rows.join(ids, F.col("__key").eqNullSafe(F.col("__id")), "left_semi")
    return rows.withColumn("__n", F.row_number().over(one)).where("__n = 1").select(*[F.col(c) for c in docs.columns])

"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are compared as lower-case words without ASCII punctuation.

1. Each distinct text's seeds, the hashes of its runs of ``MIN_MATCH`` words, are joined to the seeds of the items.  A seed table
   of at most ``BROADCAST_SEEDS`` rows is broadcast, so that no seed of a document moves; a larger one is joined by shuffle.
2. Shared seeds are summed by text and item.  Each marked word lies in a shared seed, so a pair whose shared seeds, even if they
   stand apart, can't reach the threshold goes here.  Copies of a text are one text until the end.
3. Texts with a pair left, and their items, are brought together by the text's digest: a task reads a text, then its items.
   On each pair, greedy string tiling marks the longest unmarked common run of words, then the next, down to MIN_MATCH,
   candidates being found by running Karp-Rabin hashes of falling length; so passages count in whatever order they stand.  An
   item whose marked share reaches the threshold leaks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, text_batches, texts_of
from .phrases import _ODD, WordHashes, _span_hashes

MIN_MATCH = 5
COVERAGE = 0.5
#: Rows (a hash and three small numbers) up to which the items' seeds are broadcast: some 20 MB.
BROADCAST_SEEDS = 500_000
#: ASCII upper case to lower case; ASCII control characters, space and punctuation to a space.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c > 127 else 32 for c in range(256))
_MOD = (1 << 61) - 1
_BASE = 1_000_003


def plain_words(text: bytes) -> list[bytes]:
    return text.translate(PLAIN).split()


def _runs(marked: list[bool], s: int) -> Iterator[tuple[int, int]]:
    """Unmarked stretches of at least s."""
    a = 0
    for i in range(len(marked) + 1):
        if i == len(marked) or marked[i]:
            if i - a >= s:
                yield a, i
            a = i + 1


def _hashes(x: list[int], marked: list[bool], s: int) -> Iterator[tuple[int, int]]:
    """(place, running hash) of each window of s unmarked tokens."""
    top = pow(_BASE, s - 1, _MOD)
    for a, b in _runs(marked, s):
        h = 0
        for v in x[a : a + s]:
            h = (h * _BASE + v) % _MOD
        yield a, h
        for i in range(a + 1, b - s + 1):
            h = ((h - x[i - 1] * top) * _BASE + x[i + s - 1]) % _MOD
            yield i, h


def tile(doc: list[int], item: list[int], shortest: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in doc, place in item, length) of non-overlapping matches, longest first."""
    md, mi, tiles = [False] * len(doc), [False] * len(item), []
    s = max(shortest, min(len(doc), len(item)))
    while True:
        at: dict[int, list[int]] = {}
        for j, h in _hashes(item, mi, s):
            at.setdefault(h, []).append(j)
        found = []
        if at:
            for i, h in _hashes(doc, md, s):
                for j in at.get(h, ()):
                    if doc[i : i + s] != item[j : j + s] or (i and j and not md[i - 1] and not mi[j - 1] and doc[i - 1] == item[j - 1]):
                        continue  # another window, or not the start of its match
                    n = s
                    while i + n < len(doc) and j + n < len(item) and not md[i + n] and not mi[j + n] and doc[i + n] == item[j + n]:
                        n += 1
                    found.append((-n, i, j))
        for n, i, j in sorted(found):
            if not any(md[i : i - n]) and not any(mi[j : j - n]):
                md[i : i - n] = [True] * -n
                mi[j : j - n] = [True] * -n
                tiles.append((i, j, -n))
        # What an earlier tile cut short is at least as long as a shorter window, so it is met again at a smaller s.
        if s == shortest:
            if not found or not any(not any(md[i : i + s]) and not any(mi[j : j + s]) for _, i, j in found):
                return tiles
            continue
        s = max(shortest, min(s - 1, s // 2))


def seeds_of(hashes: WordHashes, words: list[bytes], shortest: int) -> np.ndarray:
    """Hash of each run of ``shortest`` words."""
    return _span_hashes(hashes.of(words), shortest, _ODD) if len(words) >= shortest else np.zeros(0, np.uint64)


def _near(words: list[bytes], ids: dict[bytes, int], hits: np.ndarray, shortest: int) -> list[int]:
    """The item's ids of the document's words that seeds cover; others become distinct negatives, runs of them one."""
    keep = np.zeros(len(words) + 1, np.int64)
    np.add.at(keep, hits, 1)
    np.add.at(keep, hits + shortest, -1)
    covered = np.cumsum(keep[:-1]) > 0
    edge = covered | np.concatenate([[True], covered[:-1]])
    return [ids.get(words[i], -1 - i) if covered[i] else -1 - i for i in np.flatnonzero(edge).tolist()]


def matched_words(words: list[bytes], seeds: np.ndarray, item: list[bytes], item_seeds: np.ndarray, shortest: int, coverage: float) -> int:
    """Words of the item that tiles mark; 0 where shared seeds can't reach the coverage."""
    hits = np.flatnonzero(np.isin(seeds, item_seeds))
    if not len(hits) or shortest * len(hits) < coverage * len(item):
        return 0
    ids: dict[bytes, int] = {}
    tokens = [ids.setdefault(w, len(ids) + 1) for w in item]
    return sum(t[2] for t in tile(_near(words, ids, hits, shortest), tokens, shortest))


def _seeds(shortest: int):
    """The distinct seeds of each text, with how often it holds each, and its number of words; the key column is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            sizes, found, times = [], [], []
            for text in texts_of(b.column(1)):
                words = plain_words(text)
                h, m = np.unique(seeds_of(hashes, words, shortest), return_counts=True)
                sizes.append(len(words))
                found.append(h)
                times.append(m)
            at = pa.array(np.concatenate([[0], np.cumsum([len(h) for h in found])]), pa.int32())
            flat = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (found, times)]
            lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.uint64).view(np.int64))) for x in flat]
            yield pa.record_batch([b.column(0), pa.array(sizes, pa.int64()), *lists], ["key", "n_words", "seeds", "times"])

    return run


def _tile(shortest: int, coverage: float):
    """Leaks from rows in the order of texts: a text's own row, then one for each item it shares seeds with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        digest, words, seeds = None, [], None
        for b in batches:
            rows = []
            for d, own, item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), texts_of(b.column(3))):
                if own == 0:
                    if d != digest:  # rows of the same id and text say the same
                        digest, words = d, plain_words(text)
                        seeds = seeds_of(hashes, words, shortest)
                    continue
                said = plain_words(text)
                n = matched_words(words, seeds, said, seeds_of(hashes, said, shortest), shortest, coverage)
                if n and n >= coverage * len(said):
                    rows.append((d, item, n, len(said)))
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.int64(), pa.int64(), pa.int64()))], ["digest", "item", "matched_words", "item_words"])

    return run


def _digest(text: str = "text") -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def leaking_texts(docs: DataFrame, benchmark: DataFrame, coverage: float, shortest: int, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """``digest, item_id, matched_words, item_words`` of each distinct text and item that it leaks (written)."""
    spark = docs.sparkSession
    text_batches(spark)
    made = "n_words long, seeds array<long>, times array<long>"
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("said")).where("said is not null").distinct()
    items = materialize(items.withColumn("item", F.monotonically_increasing_id()), "items")  # written, so an item's number stays
    item_seeds = items.select("item", "said").mapInArrow(_seeds(shortest), f"key long, {made}")
    item_seeds = item_seeds.select(F.col("key").alias("item"), "n_words", F.explode(F.arrays_zip("seeds", "times")).alias("x"))
    item_seeds = materialize(item_seeds.select("item", "n_words", F.col("x.seeds").alias("h"), F.col("x.times").alias("m")), "item-seeds")
    small = item_seeds.count() <= broadcast_seeds

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest().alias("digest"), "text")
    found = texts.select(F.struct("doc_id", "digest").alias("key"), "text").mapInArrow(_seeds(shortest), f"key struct<doc_id: bigint, digest: binary>, {made}")
    found = found.select("key.doc_id", "key.digest", F.explode("seeds").alias("h"))
    met = found.join(F.broadcast(item_seeds) if small else item_seeds, "h")
    pairs = met.groupBy("digest", "item", "n_words").agg(F.min("doc_id").alias("doc_id"), F.sum("m").alias("shared"))  # copies only add
    pairs = materialize(pairs.where(F.col("shared") * shortest >= F.col("n_words") * F.lit(coverage)).select("digest", "doc_id", "item"), "pairs")

    wanted = pairs.groupBy("digest").agg(F.min("doc_id").alias("__id")).withColumnRenamed("digest", "__d")
    owners = texts.join(wanted, (F.col("digest") == F.col("__d")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    rows = owners.select("digest", F.lit(0).alias("own"), F.lit(None).cast("long").alias("item"), "text")
    rows = rows.union(pairs.join(items, "item").select("digest", F.lit(1), "item", "said"))
    tiled = rows.repartition("digest").sortWithinPartitions("digest", "own").mapInArrow(_tile(shortest, coverage), "digest binary, item long, matched_words long, item_words long")
    out = materialize(tiled.join(items.select("item", "item_id"), "item").select("digest", "item_id", "matched_words", "item_words"), "leaks")
    discard(items, item_seeds, pairs)
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, shortest: int = MIN_MATCH, **options) -> DataFrame:
    """``doc_id, item_id, matched_words, item_words, coverage`` of each document and item that it leaks.

    Null and empty texts leak nothing and are not leaked, nor are items of fewer than ``shortest`` words.  A null item_id or
    doc_id is kept as it is.  Equal item rows count once.  Repeated documents each have their rows.
    """
    leaks = leaking_texts(docs, benchmark, coverage, shortest, **options)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest().alias("digest"))
    return rows.join(leaks, "digest").select("doc_id", "item_id", "matched_words", "item_words", (F.col("matched_words") / F.col("item_words")).alias("coverage"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, shortest: int = MIN_MATCH, **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text leaks no item; nulls and repeats as in :func:`find_leaks`."""
    leaks = leaking_texts(docs, benchmark, coverage, shortest, **options).select(F.col("digest").alias("__digest")).distinct()
    return docs.join(leaks, _digest() == F.col("__digest"), "left_anti")

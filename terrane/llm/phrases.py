"""Removal of repeated passages with recurring phrases and Aho-Corasick automata.

A window of ``window`` consecutive words is repeated if the same words start earlier, in a smaller document or earlier in its
own.  Every word that a repeated window covers goes.

1. Documents of equal word sequences are one class; only the first of each is searched, the others are repeats as a whole.
2. Each window contributes the phrase of ``phrase`` words with the smallest hash in it (winnowing): equal windows contribute
   equal phrases, so a repeated window holds a phrase that occurs at least twice.  Phrases are counted by hash.
3. Phrases whose hash recurs are confirmed by counting their words themselves.
4. Documents are dealt to shards of about ``SHARD_WORDS`` words by their id, and each shard gets the confirmed phrases that its
   own documents contribute, as no other can make a window of theirs.  A task compiles a shard's phrases into an automaton over
   words (pyahocorasick) and streams all the shard's documents through it.  So shards of phrases are of bounded size, and every
   document meets one automaton, however many phrases the corpus has.
5. A window is searched on if the automaton found its smallest phrase at its place.  Such windows are compared by a 64-bit and
   a second 32-bit hash, not word by word: the first start of each stays, later ones go.

Hot phrases and windows are counted map-side and joined by ordinary joins, whose hot keys Spark splits at run time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import forget, materialize, release_shuffles, text_batches, texts_of

WINDOW, PHRASE = 20, 8
SHARD_WORDS = 250_000
SLICES = 4  # rounds in which phrases meet the recurring hashes; all are worked through
WORDS_REMEMBERED = 500_000
_ODD = [pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) for k in range(256)]
_ODD2 = [pow(0xD6E8FEB86659FD93, 2 * k + 1, 1 << 64) for k in range(256)]


class WordHashes:
    """64-bit hashes of words; a worker remembers them."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def of(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        try:
            return np.array([known[w] for w in words], np.uint64)
        except KeyError:
            if len(known) > WORDS_REMEMBERED:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            return np.array([known[w] for w in words], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _span_hashes(h: np.ndarray, n: int, odd: list[int]) -> np.ndarray:
    """Hash of each span of n words."""
    m = max(0, len(h) - n + 1)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out += h[k : k + m] * np.uint64(odd[k])
    return _mixed(out)


def _slide(x: np.ndarray, n: int, f) -> np.ndarray:
    """f (minimum or maximum) over each n neighbours."""
    step, m = 1, len(x) - n + 1
    while 2 * step <= n:
        x = f(x[: len(x) - step], x[step:])
        step *= 2
    return f(x[:m], x[n - step : n - step + m])


def phrase_places(h: np.ndarray, ends: np.ndarray, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the winnowed phrases of concatenated texts; ``ends``: for each word, the end of its text."""
    if len(h) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    spans, wide = _span_hashes(h, phrase, _ODD), window - phrase + 1
    least = _slide(spans, wide, np.minimum)
    starts = np.arange(len(least))
    least[starts + window > ends[: len(least)]] = 0  # windows across two texts select nothing
    pad = np.zeros(wide - 1, np.uint64)
    places = np.flatnonzero((_slide(np.concatenate([pad, least, pad]), wide, np.maximum) == spans) & (spans != 0))
    return places, spans[places]


def _search(window: int, phrase: int):
    """Per text: words, SHA-256 of all of them joined by a space, and the winnowed phrases with their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            sizes, digests, hs, all_words = [], [], [], []
            for text in texts_of(b.column(1)):
                words = text.split()
                sizes.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).digest())
                hs.append(hashes.of(words))
                all_words += words
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            h = np.concatenate(hs) if hs else np.zeros(0, np.uint64)
            places, spans = phrase_places(h, np.repeat(offsets[1:], sizes), window, phrase)
            at = pa.array(np.searchsorted(places, offsets), pa.int32())
            said = pa.array([b" ".join(all_words[p : p + phrase]) for p in places.tolist()], pa.binary())
            lists = [pa.ListArray.from_arrays(at, x) for x in (pa.array(spans.view(np.int64)), said)]
            yield pa.record_batch([b.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), *lists], ["doc_id", "n_words", "digest", "hashes", "phrases"])

    return run


class Automaton:
    """Aho-Corasick automaton over words that finds every occurrence of any of some phrases."""

    def __init__(self, phrases: list[bytes]):
        import ahocorasick

        self.ids: dict[bytes, int] = {}
        self.found, self.shortest = None, 0
        if phrases:
            self.found = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
            sizes = set()
            for p in phrases:
                words = p.split(b" ")
                self.found.add_word(tuple(self.ids.setdefault(w, len(self.ids) + 1) for w in words), len(words))
                sizes.add(len(words))
            self.found.make_automaton()
            self.shortest = min(sizes)

    def places(self, words: list[bytes]) -> np.ndarray:
        """Where occurrences start.  Words of no phrase cut the text; stretches shorter than any phrase hold none."""
        if self.found is None or len(words) < self.shortest:
            return np.zeros(0, np.int64)
        get = self.ids.get
        ids = np.array([0, *[get(w, 0) for w in words], 0])
        cuts = np.flatnonzero(ids == 0)
        long = np.flatnonzero(np.diff(cuts) > self.shortest)
        out: list[int] = []
        for a, z in zip((cuts[long] + 1).tolist(), cuts[long + 1].tolist()):
            out += [a + end - n for end, n in self.found.iter(tuple(ids[a:z].tolist()))]
        return np.array(out, np.int64)


def window_starts(h: np.ndarray, hits: np.ndarray, window: int, phrase: int) -> np.ndarray:
    """Starts of the windows of a text, given by its words' hashes, whose smallest phrase is one that starts at a hit."""
    if len(h) < window or not len(hits):
        return np.zeros(0, np.int64)
    spans = _span_hashes(h, phrase, _ODD)
    located = np.full(len(spans), np.iinfo(np.uint64).max)
    located[hits] = spans[hits]
    wide = window - phrase + 1
    return np.flatnonzero(_slide(located, wide, np.minimum) == _slide(spans, wide, np.minimum))


PHRASES, CLASSES, TEXTS = 0, 1, 2
STREAMED = "w1 long, w2 int, at long, cid long, base long, text string"


def _stream(window: int, phrase: int, compiled=Automaton):
    """Candidate windows, and the texts that have any, from rows in the order of shards: a shard's phrases, the classes whose
    first document it holds, and its documents."""
    names = [x.split()[0] for x in STREAMED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        shard, phrases, classes, automaton = None, [], {}, None
        for b in batches:
            shards, kinds = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            ids, data = b.column(2), b.column(3)
            kept: list[tuple[int, int, bytes]] = []
            out: list[list[np.ndarray]] = [[], [], [], []]
            cuts = np.flatnonzero((np.diff(shards) != 0) | (np.diff(kinds) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
                if lo == hi:
                    continue
                if shards[lo] != shard:
                    shard, phrases, classes, automaton = shards[lo], [], {}, None
                part, of = data.slice(lo, hi - lo).to_pylist(), ids.slice(lo, hi - lo).to_pylist()
                if kinds[lo] == PHRASES:
                    phrases += part
                    continue
                if kinds[lo] == CLASSES:
                    classes.update(((i, d), x) for i, d, *x in zip(of, part, b.column(4).slice(lo, hi - lo).to_pylist(), b.column(5).slice(lo, hi - lo).to_pylist()))
                    continue
                automaton = automaton or compiled(phrases)
                for i, text in zip(of, part):
                    words = (text or b"").split()
                    hits = automaton.places(words)
                    if not len(hits) or not (mine := classes.pop((i, hashlib.sha256(b" ".join(words)).digest()), None)):
                        continue  # nothing found, or not the first of its class
                    h = hashes.of(words)
                    starts = window_starts(h, hits, window, phrase)
                    if len(starts):
                        cid, base = mine
                        kept.append((cid, base, text))
                        out[0].append(_span_hashes(h, window, _ODD)[starts].view(np.int64))
                        out[1].append((_span_hashes(h, window, _ODD2)[starts] >> np.uint64(32)).astype(np.uint32).view(np.int32))
                        out[2].append(base + starts)
                        out[3].append(np.full(len(starts), cid))
            if kept:
                columns = [pa.array(np.concatenate(x)) for x in out]
                yield pa.record_batch([*columns, pa.nulls(len(columns[0]), pa.int64()), pa.nulls(len(columns[0]), pa.string())], names)
                cid, base, text = zip(*kept)
                none = [pa.nulls(len(kept), t) for t in (pa.int64(), pa.int32(), pa.int64())]
                yield pa.record_batch([*none, pa.array(cid, pa.int64()), pa.array(base, pa.int64()), pa.array(text, pa.binary()).cast(pa.string())], names)

    return run


def kept_words(words: list[bytes], starts: list[int], window: int) -> list[bytes]:
    """The words that no window at one of the starts covers."""
    cover = np.zeros(len(words) + 1, np.int64)
    starts_ = np.unique(np.array(starts, np.int64))
    np.add.at(cover, starts_, 1)
    np.add.at(cover, starts_ + window, -1)
    gone = np.cumsum(cover[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist()) if not g]


def _removed(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for cid, text, starts in zip(b.column(0).to_pylist(), texts_of(b.column(1)), b.column(2).to_pylist()):
                words = text.split()
                kept = kept_words(words, starts, window)
                joined = b" ".join(kept)
                rows.append((cid, len(words) - len(kept), hashlib.sha256(joined).digest(), joined.decode("utf-8", "replace") if with_text else None))
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.string()))], ["cid", "gone", "kept_digest", "kept_text"])

    return run


def _in_order(classes: DataFrame) -> DataFrame:
    """Classes with ``cid`` and ``base``: where each one's words start if all classes stand one after another by first id."""
    part = F.spark_partition_id().alias("__p")
    rows = materialize(classes.repartitionByRange("first", "digest").sortWithinPartitions("first", "digest").select("*", part), "ordered")
    sums = rows.groupBy("__p").agg(F.sum("n").alias("__s"), F.count(F.lit(1)).alias("__c"))
    up = Window.orderBy("__p")  # a row for each partition
    sums = sums.select("__p", (F.sum("__s").over(up) - F.col("__s")).alias("__words"), (F.sum("__c").over(up) - F.col("__c")).alias("__rows"))
    within = Window.partitionBy("__p").orderBy("first", "digest")
    rows = rows.withColumn("__r", F.row_number().over(within) - 1).withColumn("__w", F.sum("n").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    out = rows.join(F.broadcast(sums), "__p").select("digest", "first", "n", (F.col("__rows") + F.col("__r")).cast("long").alias("cid"), (F.col("__words") + F.col("__w")).cast("long").alias("base"))
    return materialize(out, "classes")


def find_repeats(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, with_text: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` and the text's ``digest`` for each row; with ``with_text`` also ``kept_text``
    where words go (kept words joined by a space; null where nothing goes).

    Words are cut at ASCII white space; a null text has none.  Rows that repeat an id with equal words are one document given
    more than once; different texts under one id count as documents that follow each other.  Null ids come first.
    """
    spark = docs.sparkSession
    text_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    searched = materialize(rows.mapInArrow(_search(window, phrase), "doc_id long, n_words long, digest binary, hashes array<long>, phrases array<binary>"), "searched")
    documents = materialize(searched.select("doc_id", "n_words", "digest"), "documents")
    classes = documents.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("__null"), F.max("n_words").alias("n"))
    classes = _in_order(classes.select("digest", F.when(~F.col("__null"), F.col("first")).alias("first"), "n"))
    shards = 1 + (documents.agg(F.sum("n_words")).first()[0] or 0) // SHARD_WORDS
    shard = lambda c: F.pmod(F.xxhash64(c), F.lit(shards)).alias("shard")

    firsts = searched.where(F.size("hashes") > 0).select("doc_id", "digest", "hashes").join(classes, "digest").where(F.col("doc_id").eqNullSafe(F.col("first")))
    # Written, so that the join's two sides are plain exchanges, whose hot keys Spark can split; so is ``earliest``.
    recurring = materialize(firsts.select(F.explode("hashes").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "recurring")
    release_shuffles(spark)
    said = searched.select(shard("doc_id"), F.explode(F.arrays_zip(F.col("hashes").alias("h"), F.col("phrases").alias("p"))).alias("x")).select("shard", F.col("x.h").alias("h"), F.col("x.p").alias("phrase"))
    parts = []
    for k in range(SLICES):  # one after another, so that only one slice's shuffles are on disk
        of_slice = F.pmod(F.col("h"), F.lit(SLICES)) == k
        # Counted by shard and words, which the join's order by hash doesn't serve: so Spark may split a hot hash's rows, and
        # sums them in the join's own tasks before they move.  Equal words have equal hashes.
        met = said.where(of_slice).join(recurring.where(of_slice).hint("merge"), "h")
        parts.append(materialize(met.groupBy("shard", "phrase").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("h")).select("shard", "h", "phrase", "n"), "said"))
        release_shuffles(spark)
    said = reduce(DataFrame.union, parts)
    forget(searched, recurring)
    once = materialize(said.groupBy("h", "phrase").agg(F.sum("n").alias("n")).where("n = 1").select("h", "phrase"), "once")  # other words under an equal hash
    phrases = said.join(once, ["h", "phrase"], "left_anti").select("shard", F.lit(PHRASES).alias("kind"), F.lit(None).cast("long").alias("id"), F.col("phrase").alias("data"), F.lit(None).cast("long").alias("cid"), F.lit(None).cast("long").alias("base"))
    owners = classes.where(F.col("n") >= window).select(shard("first"), F.lit(CLASSES), "first", "digest", "cid", "base")
    texts = rows.select(shard("doc_id"), F.lit(TEXTS), "doc_id", F.col("text").cast("binary"), F.lit(None).cast("long"), F.lit(None).cast("long"))
    both = phrases.union(owners).union(texts).repartition("shard").sortWithinPartitions("shard", "kind")
    streamed = materialize(both.mapInArrow(_stream(window, phrase), STREAMED), "streamed")
    forget(said, once)
    windows, texts = streamed.where("w1 is not null").select("w1", "w2", "at", "cid"), streamed.where("text is not null").select("cid", "base", "text")
    earliest = materialize(windows.groupBy("w1").agg(F.min("at").alias("e"), F.min_by("w2", "at").alias("f2"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "earliest")
    release_shuffles(spark)
    later = materialize(windows.join(earliest, "w1").where("at > e and w2 = f2").select("cid", "at"), "later")
    forget(earliest)
    starts = later.groupBy("cid").agg(F.collect_set("at").alias("ats"))
    removed = texts.join(starts, "cid").select("cid", "text", F.transform("ats", lambda x: (x - F.col("base")).cast("int")).alias("starts"))
    removed = removed.mapInArrow(_removed(window, with_text), "cid long, gone long, kept_digest binary, kept_text string")
    removed = materialize(removed.dropDuplicates(["cid"]), "removed")
    forget(later, streamed)

    known = classes.join(removed, "cid", "left").drop("cid", "base", "n")
    out = documents.join(known, "digest")
    copy = (F.col("n_words") >= window) & ~F.col("doc_id").eqNullSafe(F.col("first"))
    none = hashlib.sha256(b"").digest()
    out = out.select(
        "doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
        F.lower(F.hex(F.when(copy, F.lit(none)).otherwise(F.coalesce("kept_digest", "digest")))).alias("kept_sha256"),
        "digest", F.when(copy, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
    )
    return out if with_text else out.drop("kept_text")


def drop_repeats(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """``docs`` with repeated passages cut from ``text``; untouched texts stay as they are, rows left without words go.

    ``n_chars``, where there is one, is set to the new length.  Rows that never had a word stay.
    """
    words = F.concat_ws(" ", F.expr(r"regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+', 0)"))
    keyed = docs.withColumn("__d", F.unhex(F.sha2(words.cast("binary"), 256)))
    found = find_repeats(docs, window, phrase, with_text=True).where("n_removed > 0").select(F.col("doc_id").cast("long").alias("__id"), F.col("digest").alias("__d"), "kept_text").dropDuplicates(["__id", "__d"])
    out = keyed.join(found, keyed["doc_id"].cast("long").eqNullSafe(found["__id"]) & (keyed["__d"] == found["__d"]), "left")
    out = out.where(F.col("kept_text").isNull() | (F.col("kept_text") != ""))
    changed = F.col("kept_text").isNotNull()
    cols = []
    for c in docs.columns:
        if c == "text":
            cols.append(F.when(changed, F.col("kept_text")).otherwise(keyed["text"]).alias("text"))
        elif c == "n_chars":
            cols.append(F.when(changed, F.length("kept_text")).otherwise(keyed["n_chars"]).cast(dict(docs.dtypes)["n_chars"]).alias("n_chars"))
        else:
            cols.append(keyed[c])
    return out.select(*cols)

"""Best-fit packing of tokenised documents into sequences of bounded length.

Tokens are byte-level BPE ids of a public vocabulary plus an end id for each document.  Longer documents are cut into full
pieces, the first of which may be shorter.

Packing is bulk-synchronous best fit.  Pieces of over half a sequence open one each.  Then, in rounds:

1. the longest pieces left (those over ``BAND`` of the longest) and the gaps that may hold one are sorted together by size, in
   ranges dealt to tasks;
2. each task sweeps its range from large to small: a piece takes its successor, the smallest gap met so far that still has room
   (a gap far larger than the longest piece takes several);
3. pieces whose successor lies in an earlier range, and gaps that no piece of their own range took, are matched across ranges by
   rank: only the ranges' counts meet on the driver, and every piece and slot knows its rank in its range;
4. gaps are updated, and what found no gap goes on to the next round; new sequences are opened, for the tokens that wait, only
   when no gap holds any of the band.

No task sees more than one range, and the rounds depend on ``max_tokens``, not on the number of pieces.  A round of at most
``RANGE_ROWS`` pieces and gaps is one range, swept in one task without a shuffle and without step 3.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialize, release_shuffles, text_batches

MAX_TOKENS = 1024
END_ID = 2
BAND = 0.75
RANGE_ROWS = 100_000  # pieces and gaps of a round up to which it is one range
VOCABULARY = "byte_bpe_50k.json"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Words whose ids a worker remembers, some 400 MB; beyond, those not seen lately are forgotten.
REMEMBERED = 2_000_000


class Encoder:
    """Ids of whole texts by the ``tokenizers`` library.

    The pre-tokenizer always cuts before a lone space or line feed between two words, and merges never cross its cuts, so the
    ids of such a text are those of its words one after another; words recur and their ids are remembered. A text's new words
    are encoded in one call and told apart by the ids that begin with a space or line feed. There is a cut between a letter and
    the punctuation at a word's end too, so words are encoded without it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocab = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocab.values()) + 1, bool)
        self.begins[[i for t, i in vocab.items() if t.startswith(("\u0120", "\u010a"))]] = True  # space and line feed, as byte-level tokens spell them
        #: Ids, as little-endian bytes, of words after a space, or after the line feed they begin with; those of the time before in old.
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.feed = len(self.whole("\n"))

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        words = f"\n{text}".replace("\n", " \n").split(" ")
        del words[0]
        found = list(map(self.known.get, words))
        at = [k for k, x in enumerate(found) if x is None]
        if at:
            ids = self._learn({words[k] for k in at})
            if ids is None:
                return self.whole(text)
            for k in at:
                found[k] = ids[words[k]]
        return b"".join(found)[self.feed :]

    def _learn(self, new: set[str]) -> dict[str, bytes] | None:
        """Ids of words that ``known`` lacks; None if a space among them doesn't stand alone between two words."""
        if len(self.known) > REMEMBERED // 2:
            self.known, self.old, self.tails = {}, self.known, {}
        known, old, tails = self.known, self.old, self.tails
        out, fresh, tailed = {}, set(), []
        for w in new:
            if w in old:
                out[w] = known[w] = old[w]
                continue
            core = w if w[:1] != "\n" else w[1:]
            if not core or core.strip() != core:
                return None
            if not w[-1].isalpha() and len(w) <= 64:
                stem = w.rstrip(string.punctuation)
                if len(stem) < len(w) and stem[-1:].isalpha() and stem[-1] < "\u0250":  # letters in any version of Unicode
                    tailed.append((w, stem))
                    if stem in old:
                        known[stem] = old[stem]
                    elif stem not in known:
                        fresh.add(stem)
                    continue
            fresh.add(w)
        some = list(fresh)
        for k in range(0, len(some), 10_000):
            out.update(self._encode(some[k : k + 10_000]))
        for w, stem in tailed:
            tail = w[len(stem) :]
            if tail not in tails:
                tails[tail] = self.whole(tail)
            if stem in fresh:
                out[w] = out[stem] + tails[tail]
            else:  # words that recur are remembered with their punctuation too
                out[w] = known[w] = known[stem] + tails[tail]
        known.update([(w, out[w]) for w in some if len(w) <= 64])
        return out

    def _encode(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        spaced = [w if w[0] == "\n" else f" {w}" for w in words]
        ids = self.whole("".join(spaced))
        at = (4 * np.flatnonzero(self.begins[np.frombuffer(ids, "<u4")])).tolist()
        if len(at) != len(words) or at[0]:  # a vocabulary whose ids don't tell where words begin
            return zip(words, map(self.whole, spaced))
        return zip(words, [ids[a:z] for a, z in zip(at, [*at[1:], len(ids)])])


_encoders: dict[str, Encoder] = {}


def _encoder(path: str | None) -> Encoder:
    """The worker's encoder; without a path, of the vocabulary that the worker's own installation has."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut(n: int, max_tokens: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens: all full but the first."""
    first = n if n <= max_tokens else n % max_tokens or max_tokens
    return [(0, first)] + [(a, max_tokens) for a in range(first, n, max_tokens)]


def token_pieces(docs: DataFrame, max_tokens: int = MAX_TOKENS, end_id: int = END_ID, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """A row for each piece: ``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids`` (little-endian uint32).

    A null or empty text is the end id alone.  Rows of one doc_id are documents of their own.
    """
    end = end_id.to_bytes(4, "little")
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
    names = [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary).ids
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = encode(text or "") + end
                for k, (a, n) in enumerate(cut(len(ids) // 4, max_tokens)):
                    part = ids[4 * a : 4 * (a + n)]
                    rows.append((doc, k, a, n, zlib.crc32(part), part)[: len(names)])
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(names), types)], names)

    text_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES + ", ids binary" * with_ids)


SWEPT = "kind int, id long, size long, range int, rank long, slots long, sequence_id long"


def _sweep(longest: int):
    """Match the pieces (kind 1) of a range with its gaps (kind 0), from rows that fall in size, gaps before pieces.

    Pieces come out with their sequence, or with their rank among the range's unmatched; gaps with what is left of them and, for
    slots no piece took, the rank of the first, counted from the smallest gap.
    """
    names = [x.split()[0] for x in SWEPT.split(", ")]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at, waiting = TaskContext.get().partitionId(), 0
        open_: list[list[int]] = []  # sequence, room, slots; the smallest gap last
        for b in batches:
            rows = []
            for kind, id_, size in zip(*(c.to_pylist() for c in b.columns)):
                if kind == 0:
                    open_.append([id_, size, max(1, size // longest)])
                elif not open_:
                    rows.append((1, id_, size, at, waiting, None, None))
                    waiting += 1
                else:
                    gap = open_[-1]
                    gap[1] -= size
                    gap[2] -= 1
                    rows.append((1, id_, size, at, None, None, gap[0]))
                    if not gap[2]:
                        rows.append((0, gap[0], gap[1], at, None, 0, None))
                        open_.pop()
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
        rank = 0
        while open_:
            rows = []
            for _ in range(min(len(open_), 10_000)):
                id_, size, slots = open_.pop()
                rows.append((0, id_, size, at, rank, slots, None))
                rank += slots
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return run


def match_ranges(counts: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(range, first rank, pieces, range of the gaps, first slot) from (range, waiting pieces, free slots) in falling order.

    A range's waiting pieces take the free slots of the nearest ranges before it, the smallest gaps first.
    """
    out: list[tuple[int, int, int, int, int]] = []
    free: list[list[int]] = []  # range, first free slot, slots
    for at, waiting, slots in sorted(counts):
        rank = 0
        while rank < waiting and free:
            q = free[-1]
            n = min(waiting - rank, q[2])
            out.append((at, rank, n, q[0], q[1]))
            q[1], q[2], rank = q[1] + n, q[2] - n, rank + n
            if not q[2]:
                free.pop()
        if slots:
            free.append([at, 0, slots])
    return out


def _across_ranges(swept: DataFrame) -> DataFrame | None:
    """``id, size, sequence_id`` of pieces that go to a gap of another range; None if there are none."""
    spark = swept.sparkSession
    totals = swept.groupBy("range").agg(F.count(F.when(F.col("sequence_id").isNull() & (F.col("kind") == 1), 1)).alias("w"), F.sum(F.when(F.col("kind") == 0, F.col("slots")).otherwise(0)).alias("s"))
    plan = match_ranges([(r["range"], r["w"], r["s"]) for r in totals.collect()])  # a row for each range
    if not plan:
        return None
    used: dict[int, int] = {}
    for _, _, n, q, first in plan:
        used[q] = max(used.get(q, 0), first + n)
    # Both tables have about a row for each range, and are sent to all executors.
    plan_ = spark.createDataFrame(plan, "range int, __from long, __n long, of int, __slot long")
    used_ = spark.createDataFrame(list(used.items()), "of int, used long")
    waiting = swept.where("kind = 1 and sequence_id is null").select("id", "size", "range", "rank").join(F.broadcast(plan_), "range").where("rank >= __from and rank < __from + __n")
    waiting = waiting.select("id", "size", "of", (F.col("__slot") + F.col("rank") - F.col("__from")).alias("slot"))
    slots = swept.where("kind = 0 and slots > 0").select(F.col("id").alias("sequence_id"), F.col("range").alias("of"), "rank", "slots").join(F.broadcast(used_), "of").where("rank < used")
    slots = slots.select("sequence_id", "of", F.explode(F.sequence("rank", F.least(F.col("rank") + F.col("slots"), F.col("used")) - 1)).alias("slot"))
    return materialize(waiting.join(slots, ["of", "slot"]).select("id", "size", "sequence_id"), "across")


def _sequences(pieces: DataFrame, max_tokens: int, band: float, range_rows: int) -> DataFrame:
    """``id, sequence_id`` of pieces ``id, length`` of at most half a sequence; longer ones have their own, named after them."""
    spark = pieces.sparkSession
    own = F.col("length") * 2 > max_tokens
    state = pieces.select(F.when(own, 0).otherwise(1).alias("kind"), "id", F.when(own, max_tokens - F.col("length")).otherwise(F.col("length")).cast("long").alias("size")).where("size > 0")
    state, placed, opened, bound = materialize(state, "state"), [], 0, max_tokens // 2
    of = lambda k, c: F.when(F.col("kind") == k, c)
    while True:
        room = F.sum(of(0, F.floor(F.col("size") / F.lit(bound))))
        first = state.agg(F.count(F.lit(1)).alias("rows"), F.count(of(1, 1)).alias("n"), F.max(of(1, F.col("size"))).alias("longest"), F.max(of(0, F.col("size"))).alias("gap"), room.alias("room")).first()
        if not first["n"]:
            break
        bound = first["longest"]  # a bound of the next rounds' pieces too
        # All pieces take part if they surely fit, else the longest only.
        low = 0 if (first["room"] or 0) >= first["n"] else int(bound * band)
        mine = F.col("size") > low
        waiting = state.where(mine).agg(F.count(F.lit(1)).alias("rows"), F.min(of(1, F.col("size"))).alias("least"), F.sum(of(1, F.col("size"))).alias("tokens")).first()
        new = 0
        if (first["gap"] or 0) < waiting["least"]:
            new = -(-waiting["tokens"] // max_tokens)
            gaps = spark.range(new).select(F.lit(0).alias("kind"), (-F.col("id") - (opened + 1)).alias("id"), F.lit(max_tokens).cast("long").alias("size"))
            state, opened = state.union(gaps), opened + new
        order = [F.desc("size"), "kind", "id"]
        events, one_range = state.where(mine), waiting["rows"] + new <= range_rows
        events = (events.coalesce(1) if one_range else events.repartitionByRange(*order)).sortWithinPartitions(*order)
        swept = materialize(events.mapInArrow(_sweep(bound), SWEPT), "swept")
        placed.append(swept.where("kind = 1 and sequence_id is not null").select("id", "sequence_id"))
        pieces_left, gaps_left = swept.where("kind = 1 and sequence_id is null"), swept.where("kind = 0")
        across = None if one_range else _across_ranges(swept)
        if across is not None:
            placed.append(across.select("id", "sequence_id"))
            pieces_left = pieces_left.join(across.select("id"), "id", "left_anti")
            taken = across.groupBy(F.col("sequence_id").alias("id")).agg(F.sum("size").alias("__taken"))
            gaps_left = gaps_left.join(taken, "id", "left").withColumn("size", F.col("size") - F.coalesce("__taken", F.lit(0)))
        rest, before = state.where(~mine).select("kind", "id", "size"), state
        left = rest.union(pieces_left.select("kind", "id", "size")).union(gaps_left.where("size > 0").select("kind", "id", "size"))
        state = materialize(left.coalesce(-(-(first["rows"] + new) // range_rows)) if one_range else left, "state")
        discard(before)
        release_shuffles(spark)  # of a round; many partitions make many small files
    discard(state)
    empty = pieces.select("id", F.col("id").alias("sequence_id")).where("false")
    return reduce(DataFrame.union, placed, empty)


def best_fit(pieces: DataFrame, max_tokens: int = MAX_TOKENS, band: float = BAND, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to max_tokens each.

    Repeated rows are pieces of their own, and pieces of equal length go in any order.  An empty table gives an empty one.
    ``band``: pieces shorter than this share of the longest wait for a later round, unless all surely fit; nearer to 1 takes
    more rounds and wastes less.
    """
    numbered = materialize(pieces.withColumn("__id", F.monotonically_increasing_id()), "numbered")
    limits = numbered.agg(F.min("length").alias("a"), F.max("length").alias("z"), F.count(F.when(F.col("length").isNull(), 1)).alias("none")).first()
    if limits["none"] or (limits["a"] is not None and not 1 <= limits["a"] <= limits["z"] <= max_tokens):
        raise ValueError(f"lengths must be from 1 to {max_tokens}")
    found = _sequences(numbered.select(F.col("__id").alias("id"), "length"), max_tokens, band, range_rows).toDF("__id", "__seq")
    rows = numbered.join(found, "__id", "left").withColumn("sequence_id", F.coalesce("__seq", "__id"))
    upto = Window.partitionBy("sequence_id").orderBy("__id").rowsBetween(Window.unboundedPreceding, 0)  # a sequence's pieces
    return rows.select(*pieces.columns, "sequence_id", (F.sum("length").over(upto) - F.col("length")).cast("long").alias("offset"))


def pack(docs: DataFrame, max_tokens: int = MAX_TOKENS, end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece of every row of ``docs``.

    Null and empty texts are the end id alone; repeated rows and ids are documents of their own; other columns are ignored.
    """
    return best_fit(token_pieces(docs, max_tokens, end_id, vocabulary), max_tokens)

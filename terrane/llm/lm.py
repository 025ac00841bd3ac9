"""Brown class-based bigram language model.

P(word | history) = P(class of word | class of the word before) * P(word | class).  Every training word has a class:

* classes of the ``vocabulary`` most frequent words come from exchange clustering: each word in turn moves to the class that
  most raises the likelihood of the class bigrams, until nothing moves;
* every rarer word goes to the rare counterpart of the class whose neighbours are likeliest to be its own, by the counts of the
  classes to its left and right over all training texts (all rarer words count as one neighbour there).

Words not seen in training are one symbol with a class of its own, the end of a text is another, and a text starts after an
end.  Transitions between all classes are smoothed by adding a constant, so every text has a probability.

All counts are taken over all training documents, and what grows with the corpus stays distributed:

1. words are counted by executors and summed by word;
2. bigrams of frequent words are counted (at most vocabulary^2 numbers) for the exchange;
3. neighbours of rarer words are gathered by word, which gives the table ``word, n, class`` of all of them;
4. texts become sequences of classes: a task numbers its rarer words in chunks, the chunks' words meet their classes in a join
   and go back to the chunk's texts;
5. class bigrams are counted, and texts scored, on the sequences.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, forget, materialize, release_shuffles, text_batches, texts_of

FOLDS, HELD_OUT = 7, 2
VOCABULARY = 2000
CLASSES = 64
ADD = 0.1  # smoothing of transitions
FLUSH = 400_000  # distinct words or bigrams a task holds before it passes counts on
NEIGHBOURS = 4_000_000  # neighbours of rarer words a task holds before it passes them on
SLICES = 2  # rounds in which chunks meet their classes; all are worked through
CHUNK = 500_000  # rarer words numbered together; a chunk ends with the text that exceeds it


def tokens(text: bytes) -> list[bytes]:
    """Words in ASCII lower case, cut at ASCII white space."""
    return text.lower().split()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from collections import Counter

    def out(seen: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    seen: Counter = Counter()
    for b in batches:
        for text in texts_of(b.column(0)):
            seen.update(tokens(text))
            if len(seen) > FLUSH:
                yield out(seen)
                seen = Counter()
    if seen:
        yield out(seen)


def _ids(words: list[bytes], index: dict[bytes, int]) -> np.ndarray:
    """Indices of the words, len(index) for others; the end, len(index) + 1, before and after."""
    other = len(index)
    ids = np.full(len(words) + 2, other + 1, np.int64)
    ids[1:-1] = np.fromiter(map(index.get, words, repeat(other)), np.int64, len(words))
    return ids


def _count_bigrams(index: dict[bytes, int]):
    width = len(index) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], ["pair", "n"])

        parts: list[np.ndarray] = []
        held = 0
        total = np.zeros(width * width, np.int64) if width <= 4096 else None
        for b in batches:
            for text in texts_of(b.column(0)):
                ids = _ids(tokens(text), index)
                parts.append(ids[:-1] * width + ids[1:])
                held += len(parts[-1])
            if held > 1 << 20:
                if total is not None:
                    total += np.bincount(np.concatenate(parts), minlength=len(total))
                else:
                    yield out(*np.unique(np.concatenate(parts), return_counts=True))
                parts, held = [], 0
        if parts and total is not None:
            total += np.bincount(np.concatenate(parts), minlength=len(total))
        elif parts:
            yield out(*np.unique(np.concatenate(parts), return_counts=True))
        if total is not None and (keys := np.flatnonzero(total)).size:
            yield out(keys, total[keys])

    return run


def exchange_clusters(pair: np.ndarray, n: np.ndarray, width: int, classes: int) -> np.ndarray:
    """Class of each of ``width`` symbols, from bigram counts (``pair`` = first * width + second).

    The last two symbols (other words, the end) keep classes of their own, ``classes`` and ``classes + 1``.  Words start
    in classes by rank modulo ``classes``; a sweep visits them by rank and moves each to the class with the greatest gain in
    sum N(c, d) log N(c, d) - sum N(c) log N(c) over left and right sides (ties: the lower class).  Sweeps end when no word
    moves; a move must gain more than the rounding of the sums, so that no two states alternate.
    """
    words, total = width - 2, classes + 2
    of = np.concatenate([np.arange(words) % classes, [classes, classes + 1]]).astype(np.int64)
    a, b = pair // width, pair % width
    order = np.argsort(a, kind="stable")
    r_to, r_n, r_at = b[order], n[order].astype(float), np.searchsorted(a[order], np.arange(width + 1))
    order = np.argsort(b, kind="stable")
    l_from, l_n, l_at = a[order], n[order].astype(float), np.searchsorted(b[order], np.arange(width + 1))
    big = np.zeros((total, total))
    np.add.at(big, (of[a], of[b]), n)
    left, right = big.sum(axis=1), big.sum(axis=0)
    f = lambda x: x * np.log(np.maximum(x, 1.0))
    least = 1e-9 + 1e-13 * float(f(np.asarray(n, float).sum()))
    moved = 1
    while moved:
        moved = 0
        for w in range(words):
            to, tn = r_to[r_at[w] : r_at[w + 1]], r_n[r_at[w] : r_at[w + 1]]
            fr, fn = l_from[l_at[w] : l_at[w + 1]], l_n[l_at[w] : l_at[w + 1]]
            own_r, own_l = to == w, fr == w
            self_n = tn[own_r].sum()
            after = np.bincount(of[to[~own_r]], tn[~own_r], minlength=total)
            before = np.bincount(of[fr[~own_l]], fn[~own_l], minlength=total)
            out_n, in_n = after.sum() + self_n, before.sum() + self_n
            if not out_n and not in_n:
                continue
            c = of[w]
            big[c] -= after
            big[:, c] -= before
            big[c, c] -= self_n
            left[c] -= out_n
            right[c] -= in_n
            # Gain of putting w into each class d: its row and column grow, and so does the cell (d, d).
            rows = f(big[:classes] + after) - f(big[:classes])
            cols = f(big[:, :classes] + before[:, None]) - f(big[:, :classes])
            d = np.arange(classes)
            diag = f(big[d, d] + after[d] + before[d] + self_n) - f(big[d, d])
            gain = rows.sum(axis=1) + cols.sum(axis=0) - rows[d, d] - cols[d, d] + diag
            gain -= f(left[:classes] + out_n) - f(left[:classes]) + f(right[:classes] + in_n) - f(right[:classes])
            best = int(np.argmax(gain))
            if gain[best] <= gain[c] + least:
                best = int(c)
            big[best] += after
            big[:, best] += before
            big[best, best] += self_n
            left[best] += out_n
            right[best] += in_n
            of[w] = best
            moved += best != c
    return of


def _bytes_of(classes: int) -> type:
    return np.uint8 if classes <= 1 << 8 else np.uint16 if classes <= 1 << 16 else np.uint32


def _neighbours(index: dict[bytes, int], classes: np.ndarray, kind: type):
    """``word, near``: of each word outside the index, classes to its left and right, two for each time it occurs."""
    other = len(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(seen: dict[bytes, bytearray]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(seen), pa.binary()), pa.array([bytes(x) for x in seen.values()], pa.binary())], ["word", "near"])

        seen: dict[bytes, bytearray] = {}
        held, two = 0, np.dtype((np.void, 2 * np.dtype(kind).itemsize))
        for b in batches:
            for text in texts_of(b.column(0)):
                words = tokens(text)
                ids = _ids(words, index)
                c = classes[ids].astype(kind)
                at = np.flatnonzero(ids[1:-1] == other)
                near = np.column_stack([c[at], c[at + 2]]).view(two).ravel().tolist()
                for k, sides in zip(at.tolist(), near):
                    w = words[k]
                    if w in seen:
                        seen[w] += sides
                    else:
                        seen[w] = bytearray(sides)
                held += len(at)
                if len(seen) > FLUSH or held > NEIGHBOURS:
                    yield out(seen)
                    seen, held = {}, 0
        if seen:
            yield out(seen)

    return run


def _assign(big: np.ndarray, classes: int, kind: type):
    """``word, n, class`` from ``word, near`` rows in the order of words.  ``big``: smoothed class bigrams of the exchange."""
    total = classes + 2
    before = np.log(big[:, :classes] / big[:, :classes].sum(axis=0))  # of the class on the left, given the class
    after = np.log(big[:classes] / big[:classes].sum(axis=1, keepdims=True)).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sums = None, np.zeros((1, 2 * total))  # the word that may go on in the next batch

        def out(words: list[bytes], sums: np.ndarray) -> pa.RecordBatch:
            best = np.argmax(sums[:, :total] @ before + sums[:, total:] @ after, axis=1)
            return pa.record_batch([pa.array(words, pa.binary()), pa.array(sums[:, :total].sum(axis=1).astype(np.int64)), pa.array(best.astype(np.int32))], ["word", "n", "class"])

        for b in batches:
            if not b.num_rows:
                continue
            rows, near = b.column(0), b.column(1).to_pylist()
            other = np.ones(b.num_rows, bool)  # words that differ from the row before
            other[1:] = pc.not_equal(rows.slice(1), rows.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
            other[0] = last is None or rows[0].as_py() != last
            words = ([] if last is None else [last]) + rows.filter(pa.array(other)).to_pylist()
            at = np.cumsum(other) - (last is None)
            flat = np.frombuffer(b"".join(near), kind).astype(np.int64).reshape(-1, 2)
            of = np.repeat(at, [len(x) // (2 * np.dtype(kind).itemsize) for x in near]) * (2 * total)
            cells = np.bincount(of + flat[:, 0], minlength=len(words) * 2 * total) + np.bincount(of + total + flat[:, 1], minlength=len(words) * 2 * total)
            cells = cells.reshape(len(words), 2 * total).astype(float)
            if last is not None:
                cells[0] += sums[0]
            if len(words) > 1:
                yield out(words[:-1], cells[:-1])
            last, sums = words[-1], cells[-1:]
        if last is not None:
            yield out([last], sums)

    return run


@dataclass
class Model:
    """All logarithms are to base 10.  Symbols: frequent words by rank, then words never seen, then the end.

    Classes: of frequent words, of words never seen, of the end, and the rare counterparts of the first.
    """

    index: dict[bytes, int]
    word_counts: np.ndarray  # of the frequent words
    classes: np.ndarray  # of the symbols
    transition: np.ndarray  # class x class
    emission: np.ndarray  # of the symbols
    rare_totals: np.ndarray  # tokens of the rarer words of each class
    train_tokens: int
    types: int
    ends: int

    @property
    def base_total(self) -> float:
        return math.log10(self.train_tokens + self.types + 1)


def train(docs: DataFrame, vocabulary: int = VOCABULARY, classes: int = CLASSES) -> tuple[Model, DataFrame]:
    """The model, and the table ``word, n, class`` of the training words that are not frequent.

    The end token counts as one more type, if any text is seen.
    """
    return _train(docs, vocabulary, classes)[:2]


def _train(docs: DataFrame, vocabulary: int, classes: int) -> tuple[Model, DataFrame, DataFrame]:
    """What :func:`train` returns, and the class sequences of all texts."""
    spark = docs.sparkSession
    text_batches(spark)
    texts = docs.where(fold("doc_id", FOLDS) != HELD_OUT).select("text")
    ends = texts.count()
    counts = materialize(texts.mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    release_shuffles(spark)
    total = counts.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    top = [(bytes(r["word"]), r["n"]) for r in counts.orderBy(F.desc("n"), "word").limit(vocabulary).collect()]
    forget(counts)
    index, word_counts = {w: i for i, (w, _) in enumerate(top)}, np.array([n for _, n in top], float)
    width = len(index) + 2
    pairs = texts.mapInArrow(_count_bigrams(index), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).select(F.col("pair").cast("int"), "n").toArrow()
    pair, n = pairs["pair"].to_numpy().astype(np.int64), pairs["n"].to_numpy()
    of = exchange_clusters(pair, n, width, classes)
    big = np.zeros((classes + 2, classes + 2))
    np.add.at(big, (of[pair // width], of[pair % width]), n)
    kind = _bytes_of(classes + 2)
    near = texts.mapInArrow(_neighbours(index, of, kind), "word binary, near binary").repartition("word").sortWithinPartitions("word")
    rare = materialize(near.mapInArrow(_assign(big + ADD, classes, kind), "word binary, n long, class int"), "classes")
    release_shuffles(spark)
    rare_totals = np.zeros(classes)
    for r in rare.groupBy("class").agg(F.sum("n").alias("n")).collect():
        rare_totals[r["class"]] = r["n"]
    in_class = np.bincount(of[: len(index)], word_counts, minlength=classes)
    emission = np.append(np.log10(word_counts / in_class[of[: len(index)]]) if top else np.zeros(0), [0.0, 0.0])
    model = Model(index, word_counts, of, np.zeros((2 * classes + 2, 2 * classes + 2)), emission, rare_totals, int(total["n"]) + ends, total["v"] + (ends > 0), ends)
    made = _sequences(docs, model, rare)
    big = np.full(model.transition.shape, ADD)
    for r in made.where(fold("doc_id", FOLDS) != HELD_OUT).select("classes").mapInArrow(_count_transitions(len(big)), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        big[r["pair"] // len(big), r["pair"] % len(big)] += r["n"]
    model.transition = np.log10(big / big.sum(axis=1, keepdims=True))
    return model, rare, made


NUMBERED = "chunk long, id int, word binary, doc_id long, n_known long, base double, emission double, classes binary, others binary"


def _number(model: Model):
    """Texts, with what frequent words and ends make of their scores, classes of the symbols, and the other words by number in
    their chunk; after a chunk's texts (``id`` null) the chunk's words, by ``id``."""
    index, other, kind = model.index, len(model.index), _bytes_of(len(model.transition))
    base = np.append(np.log10(model.word_counts + 1) - model.base_total, [0.0, math.log10(model.ends + 1) - model.base_total])
    names = [x.split()[0] for x in NUMBERED.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = (TaskContext.get().partitionId() << 32) + TaskContext.get().partitionId()  # spread over slices
        seen: dict[bytes, int] = {}

        def chunk_words() -> Iterator[pa.RecordBatch]:
            words = list(seen)
            for i in range(0, len(words), 10_000):
                part = words[i : i + 10_000]
                cols = [pa.array(np.full(len(part), chunk)), pa.array(np.arange(i, i + len(part), dtype=np.int32)), pa.array(part, pa.binary())]
                yield pa.record_batch(cols + [pa.nulls(len(part), t) for t in kinds[3:]], names)

        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), texts_of(b.column(1))):
                words = tokens(text)
                ids = _ids(words, index)
                at = np.flatnonzero(ids[1:-1] == other)
                numbers = np.array([seen.setdefault(words[k], len(seen)) for k in at.tolist()], np.int32)
                rest = ids[1:]
                known = len(rest) - len(at) - (not model.ends)
                # By planes of bytes, the upper ones nearly all 0, which compress.
                planes = numbers.view(np.uint8).reshape(-1, 4).T.tobytes()
                rows.append((chunk, None, None, doc, known, float(base[rest].sum()), float(model.emission[rest].sum()), model.classes[ids].astype(kind).tobytes(), planes))
                if len(seen) > CHUNK:
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)
                    yield from chunk_words()
                    rows, seen, chunk = [], {}, chunk + 1
            if rows:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)
        yield from chunk_words()

    return run


SEQUENCES = "doc_id long, n_tokens long, n_known long, base double, emission double, classes binary"


def _fill(model: Model):
    """Texts with the classes of all words, from rows in the order of chunks, a chunk's words (by ``id``) before its texts."""
    total, kind = len(model.transition), _bytes_of(len(model.transition))
    unseen, first = (total - 2) // 2, (total - 2) // 2 + 2
    log_totals = np.log10(np.maximum(model.rare_totals, 1.0))
    names = [x.split()[0] for x in SEQUENCES.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, table = None, [], None
        for b in batches:
            cols = {c: b.column(c) for c in b.schema.names}
            chunks, is_text = cols["chunk"].to_numpy(), cols["id"].is_null().to_numpy(zero_copy_only=False)
            n, c = cols["n"].fill_null(0).to_numpy(), cols["class"].fill_null(-1).to_numpy()
            rows = []
            cuts = np.flatnonzero(np.diff(chunks) | np.diff(is_text.astype(np.int8))) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
                if lo == hi:
                    continue
                if chunks[lo] != chunk:
                    chunk, held, table = chunks[lo], [], None
                if not is_text[lo]:
                    held.append((n[lo:hi], c[lo:hi]))
                    continue
                if table is None:
                    count = np.concatenate([x[0] for x in held]) if held else np.zeros(0, np.int64)
                    of = np.concatenate([x[1] for x in held]) if held else np.zeros(0, np.int64)
                    share = np.where(count > 0, np.log10(np.maximum(count, 1)) - log_totals[np.maximum(of, 0)], 0.0)
                    table = count > 0, np.log10(count + 1) - model.base_total, share, np.where(count > 0, of + first, unseen).astype(kind)
                part = [cols[x].slice(lo, hi - lo).to_pylist() for x in ("doc_id", "n_known", "base", "emission", "classes", "others")]
                for doc, known, base, emission, classes, planes in zip(*part):
                    seq = np.frombuffer(classes, kind).copy()
                    if planes:
                        w = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view(np.int32).ravel()
                        seq[np.flatnonzero(seq == unseen)] = table[3][w]
                        known, base, emission = known + int(table[0][w].sum()), base + float(table[1][w].sum()), emission + float(table[2][w].sum())
                    rows.append((doc, len(seq) - 1, known, base, emission, seq.tobytes()))
            if rows:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)

    return run


def _sequences(docs: DataFrame, model: Model, rare: DataFrame) -> DataFrame:
    """Per row of ``docs``: its scores but for transitions, and the classes of its words between two ends."""
    spark = docs.sparkSession
    text_batches(spark)
    sent = spark.sparkContext.broadcast(model)  # frequent words and classes only: its size is set by parameters
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = materialize(texts.mapInArrow(lambda it: _number(sent.value)(it), NUMBERED), "numbered")
    columns = ["doc_id", "n_known", "base", "emission", "classes", "others"]
    made = []
    for k in range(SLICES):  # one after another, so that only one slice's shuffles are on disk
        part = parts.where(F.col("chunk") % SLICES == k)
        words = part.where("id is not null").select("chunk", "id", "word").join(rare, "word", "left")
        words = words.select("chunk", "id", "n", "class", *(F.lit(None).cast(parts.schema[x].dataType).alias(x) for x in columns))
        both = words.union(part.where("id is null").select("chunk", "id", F.lit(None).cast("long"), F.lit(None).cast("int"), *columns))
        both = both.repartition("chunk").sortWithinPartitions("chunk", F.asc_nulls_last("id"))
        made.append(materialize(both.mapInArrow(lambda it: _fill(sent.value)(it), SEQUENCES), "sequences"))
        del part, words, both
        release_shuffles(spark)
    forget(parts)
    return reduce(DataFrame.union, made)


def _count_transitions(total: int):
    kind = _bytes_of(total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(total * total, np.int64)
        for b in batches:
            pairs = [c[:-1].astype(np.int64) * total + c[1:] for c in (np.frombuffer(x, kind) for x in b.column(0).to_pylist())]
            if pairs:
                n += np.bincount(np.concatenate(pairs), minlength=len(n))
        keys = np.flatnonzero(n)
        yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(n[keys], pa.int64())], ["pair", "n"])

    return run


def score(docs: DataFrame, model: Model, rare: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of each row of ``docs`` (null text: empty).

    Repeated rows are scored one by one.  ``rare`` is the table from :func:`train`.
    """
    return _score(_sequences(docs, model, rare), model)


def _score(made: DataFrame, model: Model) -> DataFrame:
    transition, kind = model.transition, _bytes_of(len(model.transition))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = []
            for x, emission in zip(b.column("classes").to_pylist(), b.column("emission").to_pylist()):
                c = np.frombuffer(x, kind)
                scores.append(emission + float(transition[c[:-1], c[1:]].sum()))
            yield pa.record_batch([b.column(k) for k in ("doc_id", "n_tokens", "n_known", "base")] + [pa.array(scores, pa.float64())], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    out = made.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def score_documents(docs: DataFrame, vocabulary: int = VOCABULARY, classes: int = CLASSES) -> DataFrame:
    model, _, made = _train(docs, vocabulary, classes)
    return _score(made, model)


def perplexity(scored: DataFrame) -> DataFrame:
    """Perplexity per token of the training and the held-out texts, by the class model and by the unigram base."""
    per = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(per("score").alias("perplexity"), per("base_score").alias("base_perplexity"))

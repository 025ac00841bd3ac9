"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary.

Each language has a probability for every piece of the vocabulary.  A text is lower-cased and cut into runs of letters, each
with a space before it; a run's probability is the sum, over all its segmentations into pieces, of the products of their
probabilities, computed by a forward algorithm over bytes (every byte is a piece, so one always exists).  The language of the
greatest likelihood wins; the score is its posterior under equal priors.

Piece probabilities are fitted by expectation-maximisation over the same segmentations (forward-backward), on the words of
a bounded sample of labelled rows.  Scoring works on distinct words: a worker remembers each word's likelihoods.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, text_batches, texts_of

VOCABULARY = "byte_bpe_50k.tiktoken"
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
LONG_RUN = 256  # bytes; longer runs of letters are summed one by one, and learned from in parts
REMEMBERED = 400_000
_LETTER = regex.compile(r"\p{L}")
#: What can occur in a run: letters as they come from :func:`letter_runs`, after at most one space.
_USABLE = re.compile(rb" ?[a-z\x80-\xff]*")
#: Everything in ASCII but letters becomes a space.
_PLAIN = bytes(c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def letter_runs(text: str) -> list[bytes]:
    """Lower-case runs between ASCII non-letters."""
    return text.lower().encode().translate(_PLAIN).split()


def vocabulary(path: str | None = None) -> list[bytes]:
    """The pieces that a run of letters can hold."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with open(path) as f:
        pieces = [base64.b64decode(line.split()[0]) for line in f]
    return [p for p in pieces if p and _USABLE.fullmatch(p)]


class Trie:
    """The vocabulary as a trie in sorted arrays, walked for many words at once."""

    def __init__(self, pieces: list[bytes]):
        self.index, self.longest = {p: i for i, p in enumerate(pieces)}, max(map(len, pieces))
        nodes: dict[bytes, int] = {b"": 0}
        for p in pieces:
            for k in range(1, len(p) + 1):
                nodes.setdefault(p[:k], len(nodes))
        keys = np.array([(nodes[p[:-1]] << 8) | p[-1] for p in nodes if p], np.int64)
        child = np.array([i for p, i in nodes.items() if p], np.int64)
        order = np.argsort(keys)
        self.keys, self.child = keys[order], child[order]
        self.piece = np.full(len(nodes), -1, np.int64)
        for i, p in enumerate(pieces):
            self.piece[nodes[p]] = i
        self.root = np.full(256, -1, np.int64)
        for p, i in nodes.items():
            if len(p) == 1:
                self.root[p[0]] = i

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        want = (node << 8) | byte
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.child[at], -1)

    def edges(self, words: np.ndarray) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
        """For words of one length (rows of bytes): for each end, (start, rows, piece) of the pieces that end there."""
        n = words.shape[1]
        out: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            rows = np.arange(len(words))
            node = self.root[words[:, i]]
            for j in range(i + 1, min(n, i + self.longest) + 1):
                if j > i + 1:
                    node = self.step(node, words[rows, j - 1].astype(np.int64))
                live = node >= 0
                if not live.all():
                    rows, node = rows[live], node[live]
                if not len(rows):
                    break
                piece = self.piece[node]
                some = piece >= 0
                if some.any():
                    out[j].append((i, rows[some], piece[some]))
        return out


def _by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices, byte rows) for each length, at most some thousands of words at a time; a space is put before each."""
    sizes = np.array([len(w) for w in words])
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        for a in range(0, len(at), 4096):
            part = at[a : a + 4096]
            yield part, np.frombuffer(b"".join(b" " + words[i] for i in part), np.uint8).reshape(len(part), n + 1)


def _scaled(alpha: np.ndarray, scale: np.ndarray, upto: int, longest: int) -> None:
    """Keep the newest forward sums near 1: divide what later sums still read, and note the factor's logarithm."""
    top = alpha[upto].max(axis=1)
    top[top <= 0] = 1.0
    for k in range(max(0, upto - longest), upto + 1):
        alpha[k] /= top[:, None]
    scale += np.log(top)


def log_likelihoods(words: list[bytes], trie: Trie, probs: np.ndarray) -> np.ndarray:
    """log P(word | language), a row for each word: the forward sum over all segmentations.  probs: pieces x languages."""
    out = np.zeros((len(words), probs.shape[1]))
    short = [i for i, w in enumerate(words) if len(w) <= LONG_RUN]
    if len(short) < len(words):
        for i, w in enumerate(words):
            if len(w) > LONG_RUN:
                out[i] = long_log_likelihood(b" " + w, trie, probs)
        if short:
            out[short] = log_likelihoods([words[i] for i in short], trie, probs)
        return out
    for at, rows in _by_length(words):
        n = rows.shape[1]
        alpha = np.zeros((n + 1, len(at), probs.shape[1]))
        alpha[0] = 1.0
        scale = np.zeros(len(at))
        for j, edges in enumerate(trie.edges(rows)):
            for i, some, piece in edges:
                alpha[j, some] += alpha[i, some] * probs[piece]
            if j and j % 4 == 0:
                _scaled(alpha, scale, j, trie.longest)
        out[at] = np.log(np.maximum(alpha[n], 1e-300)) + scale[:, None]
    return out


def long_log_likelihood(run: bytes, trie: Trie, probs: np.ndarray) -> np.ndarray:
    """The same forward sum for one run of any length, holding as many sums as a piece is long."""
    sums, scale = [np.ones(probs.shape[1])], np.zeros(probs.shape[1])
    for j in range(1, len(run) + 1):
        total = np.zeros(probs.shape[1])
        for k in range(1, len(sums) + 1):
            if (p := trie.index.get(run[j - k : j])) is not None:
                total += sums[-k] * probs[p]
        sums = sums[1 - trie.longest :] + [total] if trie.longest > 1 else [total]
        if j % 16 == 0:
            top = np.maximum(sums[-1], 1e-300)
            sums, scale = [x / top for x in sums], scale + np.log(top)
    return np.log(np.maximum(sums[-1], 1e-300)) + scale


def expected_counts(words: list[bytes], counts: np.ndarray, trie: Trie, probs: np.ndarray) -> np.ndarray:
    """Expected piece counts (pieces x languages) of ``counts`` (words x languages), by forward-backward."""
    out = np.zeros_like(probs)
    width = probs.shape[1]
    for at, rows in _by_length(words):
        n, edges = rows.shape[1], trie.edges(rows)
        alpha = np.zeros((n + 1, len(at), width))
        beta = np.zeros_like(alpha)
        alpha[0], beta[n] = 1.0, 1.0
        unit = 1.0 / np.maximum(probs.max(axis=0), 1e-12)  # sums are kept in range by a factor for each byte, which cancels
        unit = np.full(width, min(unit.min(), 50.0))
        for j in range(1, n + 1):
            for i, some, piece in edges[j]:
                alpha[j, some] += alpha[i, some] * probs[piece] * unit ** (j - i)
        for j in range(n, 0, -1):
            for i, some, piece in edges[j]:
                beta[i, some] += beta[j, some] * probs[piece] * unit ** (j - i)
        weight = counts[at] / np.maximum(alpha[n], 1e-300)
        for j in range(1, n + 1):
            for i, some, piece in edges[j]:
                share = alpha[i, some] * beta[j, some] * probs[piece] * unit ** (j - i) * weight[some]
                for k in range(width):
                    out[:, k] += np.bincount(piece, share[:, k], minlength=len(out))
    return out


@dataclass
class Model:
    languages: list[str]
    probs: np.ndarray  # pieces x languages
    path: str | None = None
    _trie: Trie | None = field(default=None, repr=False)
    _rows: dict[bytes, int] = field(default_factory=dict, repr=False)
    _table: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self):
        return {"languages": self.languages, "probs": self.probs, "path": self.path}

    def __setstate__(self, state):
        self.__init__(**state)

    def word_rows(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """Rows of the remembered table for the words of each text."""
        if self._trie is None:
            self._trie = Trie(vocabulary(self.path))
            self._table = np.zeros((0, len(self.languages)))
        if len(self._rows) > REMEMBERED:
            self._rows, self._table = {}, self._table[:0]
        new = list({w for t in texts for w in t} - self._rows.keys())
        if new:
            got = log_likelihoods(new, self._trie, self.probs)
            base = len(self._rows)
            self._rows.update(zip(new, range(base, base + len(new))))
            if base + len(new) > len(self._table):
                grown = np.zeros((max(2 * len(self._table), base + len(new)), len(self.languages)))
                grown[:base] = self._table[:base]
                self._table = grown
            self._table[base : base + len(new)] = got
        get = self._rows.__getitem__
        return [np.fromiter(map(get, t), np.int64, len(t)) for t in texts]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        runs = [letter_runs(t) if t and self.languages and _LETTER.search(t) else [] for t in texts]
        out = []
        for rows in self.word_rows(runs):
            if not len(rows):
                out.append((UNKNOWN, 0.0))
                continue
            total = self._table[rows].sum(axis=0)
            total -= total.max()
            k = int(total.argmax())
            out.append((self.languages[k], float(1 / np.exp(total).sum())))
        return out


def train(docs: DataFrame, max_docs: int = 400, rounds: int = 3, smoothing: float = 0.05, path: str | None = None) -> Model:
    """Model of the values of ``lang``, from about ``max_docs`` rows of each at most, picked by a hash of id and text.

    Rows of the held-out fold, without a language, or without text aren't learned from.
    """
    spark = docs.sparkSession
    text_batches(spark)
    rows = docs.where((fold("doc_id", FOLDS) != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    # One row for each language; the model has a column for each of them too.
    share = {r["lang"]: max_docs / r["n"] for r in sizes.collect()}
    at = F.xxhash64("doc_id", "text")  # of 2^64 values, so that the share of any corpus can be cut off
    top = lambda v: F.lit(min((1 << 63) - 1, int(v * (1 << 64)) - (1 << 63)))
    picked = rows.where(F.coalesce(*[F.when(F.col("lang") == k, at <= top(v)) for k, v in sorted(share.items())], F.lit(False)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, bytes], int] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for w in [r[i : i + LONG_RUN] for r in letter_runs(text) for i in range(0, len(r), LONG_RUN)]:
                    seen[lang, w] = seen.get((lang, w), 0) + 1
        if seen:
            yield pa.record_batch([pa.array([k[0] for k in seen]), pa.array([k[1] for k in seen], pa.binary()), pa.array(list(seen.values()), pa.int64())], ["lang", "word", "n"])

    words = picked.select("lang", "text").mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toPandas()
    words = words.sort_values(["word", "lang"], kind="stable")
    languages = sorted(words["lang"].unique())
    pieces = vocabulary(path)
    trie, probs = Trie(pieces), np.full((len(pieces), len(languages)), 1.0 / len(pieces))
    distinct = {w: i for i, w in enumerate(dict.fromkeys(map(bytes, words["word"])))}
    counts = np.zeros((len(distinct), len(languages)))
    for lang, w, n in zip(words["lang"], words["word"], words["n"]):
        counts[distinct[bytes(w)], languages.index(lang)] = n
    for _ in range(rounds if languages else 0):
        got = expected_counts(list(distinct), counts, trie, probs) + smoothing
        probs = got / got.sum(axis=0)
    return Model(languages, probs, path)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of each row; ``und`` and 0 for a text that is null or has no letter.

    Texts are scored whole; equal likelihoods go to the language that sorts first; repeated rows are scored one by one.
    """
    text_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a fixed vocabulary by languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            got = m.predict(b.column(1).to_pylist())
            yield pa.record_batch([b.column(0), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")

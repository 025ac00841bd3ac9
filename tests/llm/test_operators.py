"""Corpus operators against brute force on small tables, with nulls, empty and long texts, ties and clashing columns."""

import base64
import collections
import hashlib
import io
import math
import random
import re
import struct
import zlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest

from terrane.llm import decontamination, language, lm, nearcopies, packing, phrases, quality, sharding, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def corpus(seed=0, n=60):
    """Random texts with copies, near copies, repeated passages, nulls, empty texts and one long text."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    say = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passage, base = say(26), say(120)
    texts = []
    for i in range(n):
        t = say(rng.randint(1, 80))
        if i % 5 == 0:
            at = rng.randint(0, len(t))
            t[at:at] = passage
        if i % 7 == 0:
            t = list(base)
            for _ in range(i // 7):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
        texts.append((" ", "\n", "  ")[i % 3].join(t))
    texts += [texts[3], texts[3], None, "", " \n ", "One", " ".join(["be"] * 90), " ".join(say(4000)), "　wide \x1c odd\tspace"]
    return [(i, t, ("en", "de", None)[i % 3], ("a", "b", None)[i % 3], None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- 1 -------------------------------------------------------------------------------------------


def test_warc_round_trip_over_any_ranges(spark):
    pages = [(3, "u", "<p>a</p>"), (1, "u\r\nx: y", "<p>a</p>"), (2, None, None), (5, "v", ""), (None, "n", "<p>a</p>"), (9, "w", "x" * 300_000), (3, "u", "<p>a</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1))
    for size in (1 << 20, 97):
        got = sorted(map(tuple, warc.archive_round_trip(df, split_bytes=size).collect()), key=str)
        want = []
        for i, _, html in pages:
            body = (html or "").encode()
            first = min(j for j, _, h in pages if j is not None and (h or "").encode() == body)
            want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if i == first else "revisit", None if i == first else first))
        assert got == sorted(want, key=str)


def test_warc_false_magic_and_foreign_members():
    inner = warc.encode_record(7, "u", b"payload", None)
    noise = bytes(range(256)) * 3
    outer = warc.encode_record(8, "u", warc.MAGIC + noise + random.Random(1).randbytes(5000) + warc.MAGIC, None)
    data = b"junk" + warc.MAGIC + b"more" + inner + warc.EMPTY_MEMBER + outer + b"\x1f\x8b"
    for step in (50, 1000, len(data)):
        got = [r for a in range(0, len(data), step) for r in warc.scan_range(io.BytesIO(data), len(data), a, min(len(data), a + step))]
        assert [r[1] for r in got] == ["urn:page:7", "urn:page:8"] and got[0][-1] == b"payload" and all(r[8] for r in got)


def test_warc_empty(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- 2 -------------------------------------------------------------------------------------------


def test_shards_hold_the_law(spark, docs, empty):
    got = [r.asDict() for r in sharding.assign_shards(docs).collect()]
    texts = {r["doc_id"]: r for r in docs.collect()}
    sizes = collections.Counter(r["shard"] for r in got)
    assert len(got) == len(texts) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    for source in ("a", "b", None):
        per = collections.Counter(r["shard"] for r in got if texts[r["doc_id"]]["source"] == source)
        assert max(per.values()) - min(per[s] for s in range(8)) <= 2
    for r in got:
        body = (texts[r["doc_id"]]["text"] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(body) + 1, zlib.crc32(body))
    assert sharding.assign_shards(empty).count() == 0
    assert sharding.assign_shards(docs.union(docs)).count() == 2 * len(got)


# --- 3 -------------------------------------------------------------------------------------------


def brute_likelihood(word, pieces, p):
    a = [Decimal(1)] + [Decimal(0)] * len(word)
    for j in range(1, len(word) + 1):
        a[j] = sum((a[i] * Decimal(float(p[pieces[word[i:j]]])) for i in range(j) if word[i:j] in pieces), Decimal(0))
    return float(a[-1].ln())


def test_forward_sums_all_segmentations():
    pieces = language.vocabulary()
    rng = np.random.default_rng(0)
    probs = rng.dirichlet(np.ones(len(pieces)), 2).T
    index = {p: i for i, p in enumerate(pieces)}
    some = [b"house", b"a", "straße".encode(), b"zz" * 100]
    got = language.log_likelihoods(some, language.Trie(pieces), probs)
    for w, row in zip(some[:3], got):
        assert row == pytest.approx([brute_likelihood(b" " + w, index, probs[:, k]) for k in range(2)])
    assert np.isfinite(got).all()


def test_prediction_is_the_likeliest_language():
    pieces = language.vocabulary()
    rng = np.random.default_rng(1)
    probs = rng.dirichlet(np.ones(len(pieces)), 3).T + 1e-5
    index = {p: i for i, p in enumerate(pieces)}
    model = language.Model(["a", "b", "c"], probs)
    texts = ["the house on the hill", "Wasser, straße 12 und", "née à l'été", "x" * 300, "q"]
    for text, (lang, score) in zip(texts, model.predict(texts)):
        total = np.array([sum(brute_likelihood(b" " + w, index, probs[:, k]) for w in language.letter_runs(text)) for k in range(3)])
        assert lang == "abc"[int(total.argmax())] and score == pytest.approx(1 / np.exp(total - total.max()).sum())
    assert [model.predict([t])[0] for t in ("½ ²", "①", "__ 7", None)] == [("und", 0.0)] * 4
    long = (b"abcde" * 60)[:290]
    assert language.log_likelihoods([long, b"a"], language.Trie(pieces), probs)[0] == pytest.approx([brute_likelihood(b" " + long, index, probs[:, k]) for k in range(3)])


def test_language_identification(spark, empty):
    rng = random.Random(2)
    heads = {"en": ["the", "and", "which", "house", "water"], "de": ["der", "und", "straße", "wasser", "haus"]}
    rows = [(i, " ".join(rng.choices(heads[("en", "de")[i % 2]], k=12)), ("en", "de")[i % 2], "s", 1) for i in range(80)]
    rows += [(100, None, "en", "s", 0), (101, "12 !? 34", "en", "s", 0), (102, "", None, None, 0), (103, "haus " * 20000, None, "s", 0)]
    df = spark.createDataFrame(rows, DOCS).withColumnRenamed("n_chars", "lang_pred")
    got = {r["doc_id"]: r for r in language.identify(df, language.train(df, max_docs=30)).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang, _, _ in rows[:80]) and got[103]["lang_pred"] == "de"
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (100, 101, 102))
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert language.identify(empty, language.train(empty)).count() == 0


# --- 4 -------------------------------------------------------------------------------------------


def test_language_model(spark, docs, empty):
    got = {r["doc_id"]: r for r in lm.score_documents(docs, vocabulary=40, classes=6).collect()}
    rows = docs.collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    lower = lambda t: (t or "").encode().lower().split()
    c = collections.Counter(w for r in rows if not held(r["doc_id"]) for w in lower(r["text"]))
    c[None] = sum(not held(r["doc_id"]) for r in rows)
    n, v = sum(c.values()), len(c)
    for r in rows:
        g, t = got[r["doc_id"]], [*lower(r["text"]), None]
        assert (g["n_tokens"], g["n_known"], g["train_tokens"], g["held_out"]) == (len(t), sum(c[w] > 0 for w in t), n, held(r["doc_id"]))
        assert g["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)) and g["score"] < 0
    assert lm.score_documents(empty).count() == 0


def test_class_model_is_a_distribution(spark, docs):
    model, _ = lm.train(docs, vocabulary=40, classes=6)
    assert (10**model.transition).sum(axis=1) == pytest.approx(1)
    for c in set(model.classes[:40]):
        assert (10 ** model.emission[:40][model.classes[:40] == c]).sum() == pytest.approx(1)


def test_exchange_raises_likelihood():
    rng = np.random.default_rng(0)
    of = np.arange(12) % 3
    seq = [0]
    for _ in range(4000):
        seq.append(int(rng.choice(np.flatnonzero(of == (of[seq[-1]] + 1) % 3))))
    pair, n = np.unique(np.array(seq[:-1]) * 14 + np.array(seq[1:]), return_counts=True)
    got = lm.exchange_clusters(pair, n, 14, 3)
    assert all(len(set(got[:12][of == k])) == 1 for k in range(3)) and len(set(got[:12])) == 3


def test_rare_words_get_classes(spark):
    """Two kinds of words alternate; rare words of each kind meet only in classes of their own kind."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        a, b = rng.integers(0, 8, 30), rng.integers(0, 8, 30)
        w = [x for p, q in zip(a, b) for x in (f"a{p}", f"b{q}")]
        w[10], w[31] = f"ra{i % 50}", f"rb{i % 50}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model, rare = lm.train(docs, vocabulary=16, classes=2)
    got = {bytes(r["word"]).decode(): (r["n"], r["class"]) for r in rare.collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    n = collections.Counter(w for i, t in rows if not held(i) for w in t.split() if w[0] == "r")
    assert {w: x[0] for w, x in got.items()} == n
    a, b = ({c for w, (_, c) in got.items() if w.startswith(x)} for x in ("ra", "rb"))
    assert len(a) == len(b) == 1 and a != b
    # Class bigrams of rarer words are counted: ra is followed by a frequent b, never by a frequent a.
    after = 10 ** model.transition[4 + a.pop()]
    kind = {w.decode()[0]: model.classes[i] for w, i in model.index.items()}
    assert after[kind["b"]] > 0.9 > 0.1 > after[kind["a"]]
    assert lm.score(docs, model, rare).count() == 400


def test_words_that_recur_in_a_chunk_are_numbered_once(monkeypatch):
    """Each row of a chunk's words meets its class in a shuffle, so texts with the same 120,000 words must share a chunk."""
    import pyspark

    monkeypatch.setattr(pyspark, "TaskContext", type("Context", (), {"get": staticmethod(lambda: type("Task", (), {"partitionId": staticmethod(lambda: 0)}))}))
    vocabulary = [f"w{i}" for i in range(120_000)]
    model = lm.Model({}, np.zeros(0), np.array([2, 3]), np.zeros((6, 6)), np.zeros(2), np.ones(2), 240_002, 120_001, 2)
    batch = pa.record_batch([pa.array([1, 2]), pa.array([" ".join(vocabulary), " ".join(vocabulary[::-1])])], ["doc_id", "text"])
    out = pa.Table.from_batches(list(lm._number(model)(iter([batch])))).to_pylist()
    assert [r["word"].decode() for r in sorted((r for r in out if r["id"] is not None), key=lambda r: r["id"])] == vocabulary
    of = [np.ascontiguousarray(np.frombuffer(r["others"], np.uint8).reshape(4, -1).T).view(np.int32).ravel().tolist() for r in out if r["id"] is None]
    assert of == [list(range(120_000)), list(range(120_000))[::-1]]


# --- 5 -------------------------------------------------------------------------------------------


def brute_stats(text):
    w = words(text)
    c, covered = collections.Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if c[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_stats_and_rules(spark, docs, empty):
    rows = docs.collect()
    labels = spark.createDataFrame([(r["doc_id"], int(r["doc_id"] % 7 != 0), 0) for r in rows] + [(None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.score_quality(docs.withColumnRenamed("n_chars", "n_words"), labels, bins=8).collect()}
    for r in rows:
        g, want = got[r["doc_id"]], brute_stats(r["text"])
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]) == want
        assert g["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (g["base_failed"] and g["kept"])
    assert quality.score_quality(empty, labels).count() == 0
    assert quality.score_quality(docs, labels.limit(0)).where("kept").count() == sum(not r["base_failed"] for r in got.values())


def test_quality_of_repeated_rows_and_hits_of_rules(spark, docs):
    """kept is what the ordered rules say, by plain Python over the statistics; repeated rows each have a row."""
    labels = spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(70)], "doc_id long, quality int")
    stats = quality.text_stats(docs.union(docs)).cache()
    rules = quality.learn_rules(stats, labels, bins=4, precision=0.1)
    got = quality.with_features(stats).select("*", quality.verdict(rules).alias("kept")).collect()
    assert rules and len(got) == 2 * docs.count()
    holds = lambda r, c: r[c.feature] > c.at if c.above else r[c.feature] <= c.at
    assert all(r["kept"] == (not any(all(holds(r, c) for c in rule) for rule in rules)) for r in got)


def test_rules_find_planted_conjunction(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        text = " ".join(("w%d###" if bad else "word%d") % rng.randrange(500) for _ in range(80))
        rows.append((i, text, None, None, 0))
        labels.append((i, int(not bad), 0))
    df, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.score_quality(df, lab).collect()
    assert all(r["kept"] == (r["doc_id"] % 5 != 0) for r in got)


# --- 6 -------------------------------------------------------------------------------------------


def brute_repeats(rows, window=20):
    first, out = {}, {}
    order = sorted(rows, key=lambda r: r["doc_id"])
    for r in order:
        w = words(r["text"])
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s : s + window]), (r["doc_id"], s))
    for r in order:
        w = words(r["text"])
        gone = {p for s in range(len(w) - window + 1) if first[tuple(w[s : s + window])] < (r["doc_id"], s) for p in range(s, s + window)}
        kept = [x for p, x in enumerate(w) if p not in gone]
        out[r["doc_id"]] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest(), kept)
    return out


def test_repeats(spark, docs, empty):
    want = brute_repeats(docs.collect())
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in phrases.find_repeats(docs.withColumnRenamed("lang", "digest")).collect()}
    assert got == {k: v[:3] for k, v in want.items()} and sum(v[1] for v in want.values()) > 200
    assert phrases.find_repeats(empty).count() == 0
    twice = phrases.find_repeats(docs.union(docs)).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in twice) == sorted((k, v[1]) for k, v in want.items() for _ in range(2))


def test_drop_repeats_keeps_columns(spark, docs):
    want = brute_repeats(docs.collect())
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = phrases.drop_repeats(docs)
    assert got.columns == docs.columns
    got = {r["doc_id"]: r["text"] for r in got.collect()}
    for i, (n, gone, _, kept) in want.items():
        assert (i not in got) if n and not kept else got[i] == (" ".join(kept) if gone else before[i])


def stream_rows(texts, phrases):
    """A shard's rows as _stream takes them."""
    rows = [(0, 0, None, p, None, None) for p in phrases]
    base = 0
    for i, t in enumerate(texts):
        rows.append((0, 1, i, hashlib.sha256(" ".join(words(t)).encode()).digest(), i, base))
        base += len(words(t))
    rows += [(0, 2, i, t.encode(), None, None) for i, t in enumerate(texts)]
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
    return [pa.record_batch([pa.array(c, k) for c, k in zip(zip(*part), kinds)], list("abcdef")) for part in (rows[:2], rows[2:]) if part]


def test_the_automaton_decides():
    rng = random.Random(9)
    say = lambda n: ["w%d" % rng.randrange(900) for _ in range(n)]
    passage = say(30)
    texts = [" ".join(say(25) + passage + say(25)) for _ in range(3)] + [" ".join(say(60))]
    said = [" ".join(passage[k : k + 8]).encode() for k in range(23)]
    got = [r for b in phrases._stream(20, 8)(iter(stream_rows(texts, said))) for r in b.to_pylist()]
    starts = {(r["cid"], r["at"] - sum(len(words(t)) for t in texts[: r["cid"]])) for r in got if r["text"] is None}
    assert {(i, s) for i in range(3) for s in range(25, 36)} <= starts and {r["cid"] for r in got if r["text"]} == {0, 1, 2}
    assert not [b for b in phrases._stream(20, 8)(iter(stream_rows(texts, [])))]
    assert not [b for b in phrases._stream(20, 8, lambda _: phrases.Automaton([]))(iter(stream_rows(texts, said)))]


def test_automaton_finds_every_occurrence():
    rng = random.Random(3)
    text = [b"%d" % rng.randrange(3) for _ in range(400)]
    some = {tuple(text[k : k + 5]) for k in range(0, 400, 37) if k + 5 <= 400}
    got = phrases.Automaton([b" ".join(p) for p in some]).places(text)
    assert sorted(got) == [k for k in range(396) if tuple(text[k : k + 5]) in some]


# --- 7 -------------------------------------------------------------------------------------------


def test_packing(spark, docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    t.encode_special_tokens = True
    extra = spark.createDataFrame([(900, "a <|endoftext|> b\n\n c  d ", None, None, 0), (901, " lead x it's  1,2", None, None, 0)], DOCS)
    df = docs.union(extra)
    got = [r.asDict() for r in packing.pack(df).collect()]
    ids = {r["doc_id"]: t.encode(r["text"] or "", add_special_tokens=False).ids + [2] for r in df.collect()}
    assert {r["doc_id"] for r in got} == set(ids)
    for i, want in ids.items():
        parts = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [(p["start"], p["length"]) for p in parts] == packing.cut(len(want), 1024)
        for p in parts:
            own = want[p["start"] : p["start"] + p["length"]]
            assert p["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(own)}I", *own))
    for s in {r["sequence_id"] for r in got}:
        at = 0
        for r in sorted((r for r in got if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert packing.pack(empty).count() == 0


def test_new_words_of_a_text_are_encoded_in_one_call(monkeypatch):
    import public_tokenizers

    class Counting(packing.Encoder):
        calls = 0

        def whole(self, text):
            self.calls += 1
            return super().whole(text)

    encoder = Counting(public_tokenizers.path(packing.VOCABULARY))
    want = lambda text: struct.pack(f"<{len(x)}I", *x) if (x := encoder.tokenizer.encode(text, add_special_tokens=False).ids) else b""
    text = " ".join(f"word{k}\nstem{'abcdefghij'[k % 10] * (k // 10)}.,%%%" for k in range(200))
    encoder.calls = 0
    assert encoder.ids(text) == want(text) and encoder.calls <= 5
    assert encoder.ids(text) == want(text) and encoder.calls <= 5

    monkeypatch.setattr(packing, "REMEMBERED", 40)  # words are forgotten and remembered again
    rng = random.Random(5)
    some = ["a", "Be", "it", "é", "ß", "e\u0301", "д", "漢", "1", "٣", "'s", "'", "'ll", ".", ",", "...", "$%", "×", "_", "\u0250", "<|endoftext|>", "x" * 70, "\u200b", "\0"]
    gaps = [" "] * 30 + ["\n"] * 6 + ["  ", "\n\n", " \n", "\t", "\r\n", "\u00a0", "\u3000", "\x1c", "\x85"]
    for plain in (True, False):
        for _ in range(1500):
            words = ["".join(rng.choices(some, k=rng.randint(1, 4))) for _ in range(rng.randint(1, 6))]
            text = "".join(w + rng.choice(gaps[:36] if plain else gaps) for w in words)
            text = text[:-1] if plain else rng.choice(["", " ", "\n"]) + text
            assert encoder.ids(text) == want(text), repr(text)


def best_fit_decreasing(lengths, room):
    """Sequences that best-fit decreasing opens."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else room) - n)
    return len(gaps)


def test_successor_sweeps_pack_like_best_fit_decreasing(spark):
    rng = random.Random(0)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several ranges, for matches across them
    try:
        for lengths in ([rng.randint(1, 64) for _ in range(700)], [22] * 100 + [3] * 150 + [64] * 20, [rng.randint(1, 9) for _ in range(400)]):
            df = spark.createDataFrame([(i % 50, n) for i, n in enumerate(lengths)], "sequence long, length long")
            got = packing.best_fit(df, 64).collect()
            assert sorted(r["length"] for r in got) == sorted(lengths)
            groups = collections.defaultdict(list)
            for r in got:
                groups[r["sequence_id"]].append((r["offset"], r["length"]))
            for parts in groups.values():
                at = 0
                for offset, n in sorted(parts):
                    assert offset == at
                    at += n
                assert at <= 64
            assert len(groups) <= best_fit_decreasing(lengths, 64) + 1 + len(lengths) // 100
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_small_rounds_are_one_range(spark):
    """Few pieces don't make a task for each shuffle partition in each round; several ranges pack as well."""
    rng = random.Random(1)
    lengths = [rng.randint(1, 64) for _ in range(300)]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "id long, length long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    tasks, status = {}, spark.sparkContext.statusTracker()
    try:
        for partitions, rows in ((40, packing.RANGE_ROWS), (4, 0)):
            spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
            spark.sparkContext.setJobGroup(f"packing-{rows}", "")
            got = packing._sequences(df, 64, packing.BAND, rows).collect()
            stages = {s for j in status.getJobIdsForGroup(f"packing-{rows}") for s in status.getJobInfo(j).stageIds}
            tasks[rows] = sum(x.numTasks for x in map(status.getStageInfo, stages) if x)
            room = collections.Counter({i: 64 - n for i, n in enumerate(lengths) if 2 * n > 64})
            for r in got:
                room[r["sequence_id"]] = room.get(r["sequence_id"], 64) - lengths[r["id"]]
            assert sorted(r["id"] for r in got) == [i for i, n in enumerate(lengths) if 2 * n <= 64] and min(room.values()) >= 0
            assert len(room) <= best_fit_decreasing(lengths, 64) + 4
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.sparkContext._jsc.clearJobGroup()
    assert tasks[packing.RANGE_ROWS] < tasks[0]


def test_ranges_match_as_one_sweep_would():
    """Cut a falling list of gaps and pieces anywhere: sweeps of the parts and the match by rank place as one sweep does."""
    import pyspark

    rng = random.Random(4)
    at = [0]

    class Context:
        @staticmethod
        def get():
            return type("Task", (), {"partitionId": staticmethod(lambda: at[0])})

    kinds = (pa.int32(), pa.int64(), pa.int64())
    old, pyspark.TaskContext = pyspark.TaskContext, Context
    try:
        for _ in range(50):
            events = sorted([(-rng.randint(1, 30), k, i) for i in range(60) for k in (0, 1)])
            sets = []
            for cuts in ([0, 120], sorted([0, 120, *(rng.randrange(120) for _ in range(5))])):
                placed, counts, out = {}, [], []
                for p, (a, z) in enumerate(zip(cuts, cuts[1:])):
                    at[0] = p
                    cols = [pa.array([x[k] if k else -x[0] for x in events[a:z]], t) for k, t in ((1, kinds[0]), (2, kinds[1]), (0, kinds[2]))]
                    rows = [r for b in packing._sweep(30)(iter([pa.record_batch(cols, ["kind", "id", "size"])])) for r in b.to_pylist()]
                    placed.update({r["id"]: r["sequence_id"] for r in rows if r["kind"] and r["sequence_id"] is not None})
                    counts.append((p, sum(r["kind"] and r["sequence_id"] is None for r in rows), sum(r["slots"] for r in rows if not r["kind"])))
                    out += rows
                waiting = {(r["range"], r["rank"]): r["id"] for r in out if r["kind"] and r["sequence_id"] is None}
                slots = {(r["range"], r["rank"] + k): r["id"] for r in out if not r["kind"] for k in range(r["slots"])}
                for p, first, n, q, slot in packing.match_ranges(counts):
                    placed.update({waiting[p, first + k]: slots[q, slot + k] for k in range(n)})
                sets.append(placed)
            assert sets[0] == sets[1] and sets[0]
    finally:
        pyspark.TaskContext = old


# --- 8 -------------------------------------------------------------------------------------------


def toxic_corpus(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(500):
        sentences = [" ".join(rng.choice("red blue green fast slow tree stone".split()) for _ in range(6)) for _ in range(5)]
        toxic = i % 4 == 0
        if toxic:
            sentences[rng.randrange(5)] += " you " + rng.choice(["vile", "rotten"]) + " fool"
        rows.append((i, ". ".join(sentences), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, None, None, None, 0), (1001, "", None, None, 0), (1002, "you vile fool " * 30000, None, None, 0)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark, empty):
    docs, labels = toxic_corpus(spark)
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs.withColumnRenamed("n_chars", "score"), model).collect()}
    assert all(got[i]["predicted"] == (i % 4 == 0) and got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(500))
    assert got[1000]["score"] == got[1001]["score"] == 0 and got[1002]["predicted"] == 1
    bad = toxicity.offending_sentences(docs.where("doc_id < 500"), model).collect()
    assert {r["doc_id"] for r in bad} == {i for i in range(500) if i % 4 == 0} and all("fool" in r["sentence"] for r in bad)
    assert toxicity.drop_toxic(docs, model).columns == docs.columns and toxicity.drop_toxic(docs, model).count() == 377
    assert toxicity.score_toxicity(empty, toxicity.train(empty, labels.limit(0))).count() == 0


def test_toxicity_bound_is_filled_from_the_documents(spark):
    docs = spark.createDataFrame([(i, "text") for i in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 25 == 0)) for i in range(4000)], "doc_id long, toxic int")
    assert toxicity._labelled(docs, labels, 20).count() == 20


def test_gradient_of_the_bags():
    rng = np.random.default_rng(7)
    rows = [(int(rng.integers(0, 2)), int(rng.integers(0, 3)), [sorted(set(rng.integers(0, 6, 3).tolist())) for _ in range(rng.integers(0, 4))]) for _ in range(40)]
    rows = [r for r in rows if r[1] or r[2]]
    bags, theta = toxicity.Bags(rows, 6), rng.normal(0, 1, 7)
    loss = lambda k, h: bags.loss(theta + h * np.eye(7)[k], 0.01)[0]
    assert bags.loss(theta, 0.01)[1] == pytest.approx([(loss(k, 1e-6) - loss(k, -1e-6)) / 2e-6 for k in range(7)], abs=1e-6)


def test_held_out_toxicity(spark):
    """Precision and recall on the fold that isn't learned from, and one row for each of a repeated document."""
    path = "/root/testdata/sf0.01/%s.parquet"
    docs, labels = spark.read.parquet(path % "documents"), spark.read.parquet(path % "labels")
    model = toxicity.train(docs, labels)
    rows = toxicity.score_toxicity(docs, model).where("held_out").join(labels.select("doc_id", "toxic").where("toxic is not null"), "doc_id").collect()
    hit = sum(r["predicted"] and r["toxic"] for r in rows)
    assert hit >= 0.8 * sum(r["predicted"] for r in rows) and hit >= 0.4 * sum(r["toxic"] for r in rows) > 0
    some = docs.limit(20)
    assert toxicity.score_toxicity(some.union(some), model).count() == 40


def test_noisy_or_of_sentences():
    m = toxicity.Model(-2.0, {b"vile": 3.0})
    ps = [p for _, p in m.sentences(b"vile man. good man.")]
    assert m.score(b"vile man. good man.") == pytest.approx(1 - (1 - ps[0]) * (1 - ps[1]))
    assert m.score(b"good. man.") == pytest.approx(1 - (1 - ps[1]) ** 2)


# --- 9 -------------------------------------------------------------------------------------------


def test_tiles_are_greedy():
    doc, item = list(range(40, 60)) + [1, 2, 3] + list(range(20, 40)), list(range(20, 60))
    assert sorted(t[2] for t in decontamination.tile(doc, item)) == [20, 20]
    assert decontamination.tile([1, 2, 3, 4], [1, 2, 3, 4]) == []
    assert sum(t[2] for t in decontamination.tile([7] * 12, [7] * 9)) == 9


def test_leaks(spark, empty):
    rng = random.Random(6)
    item = ["k%d" % rng.randrange(1000) for _ in range(30)]
    swapped = item[15:] + item[:15]
    rows = [
        (0, "x y " + " ".join(item).upper() + " z", None, None, 0), (1, "a " + " ".join(swapped[:15]) + " q r s " + ", ".join(swapped[15:]), None, None, 0),
        (2, " ".join(item[:9]) + " other", None, None, 0), (3, None, None, None, 0), (4, "", None, None, 0), (5, " ".join(item[:3] * 40), None, None, 0), (6, "w " * 50000 + " ".join(item), None, None, 0),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    bench = spark.createDataFrame([(7, " ".join(item)), (7, " ".join(item)), (8, None), (9, ""), (10, "too short")], "item_id long, text string")
    for most in (decontamination.BROADCAST_SEEDS, 0):  # seeds broadcast, and shuffled
        got = decontamination.find_leaks(docs, bench, broadcast_seeds=most).collect()
        assert sorted((r["doc_id"], r["item_id"], r["matched_words"]) for r in got) == [(0, 7, 30), (1, 7, 30), (6, 7, 30)]
        kept = decontamination.drop_leaks(docs, bench, broadcast_seeds=most)
        assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4, 5]
    assert decontamination.find_leaks(empty, bench).count() == 0 and decontamination.find_leaks(docs, bench.limit(0)).count() == 0


def test_leaks_are_those_of_tiling_every_pair(spark):
    """Random documents of shuffled, cut and repeated item pieces; copies, one id with two texts, null ids, clashing columns."""
    rng = random.Random(21)
    items = [(k % 7 if k else None, " ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(3, 40)))) for k in range(12)]
    rows = []
    for d in range(60):
        out = []
        for _ in range(rng.randint(0, 5)):
            said = rng.choice(items)[1].split()
            a = rng.randrange(len(said))
            out += said[a : a + rng.randint(1, 25)] + ["z%d" % rng.randrange(9)] * rng.randint(0, 2)
        rows.append((None if d == 5 else d // 2 if d < 8 else d, " ".join(out)))
    rows += [(100, rows[9][1]), rows[9], (None, rows[9][1]), (101, None)]
    want, leaking = collections.Counter(), 0
    for doc_id, text in rows:
        found = []
        for item_id, said in set(items):
            ids = {}
            x, y = ([ids.setdefault(w, len(ids)) for w in decontamination.plain_words((t or "").encode())] for t in (text, said))
            n = sum(t[2] for t in decontamination.tile(x, y))
            if n and n >= 0.5 * len(y):
                found.append((doc_id, item_id, n, len(y)))
        want.update(found)
        leaking += bool(found)
    docs = spark.createDataFrame([(*r, 1, 2, b"", 3) for r in rows], "doc_id long, text string, item int, h int, digest binary, n_words int")
    bench = spark.createDataFrame([(*r, 4, 5) for r in items + items[:3]], "item_id long, text string, doc_id int, n_words int")
    for most in (decontamination.BROADCAST_SEEDS, 0):
        got = collections.Counter((r["doc_id"], r["item_id"], r["matched_words"], r["item_words"]) for r in decontamination.find_leaks(docs, bench, broadcast_seeds=most).collect())
        assert got == want and len(want) > 20
        kept = decontamination.drop_leaks(docs, bench, broadcast_seeds=most)
        assert kept.columns == docs.columns and kept.count() == len(rows) - leaking


# --- 10 ------------------------------------------------------------------------------------------


def brute_clusters(rows, width, percent):
    def shingles(text):
        w = tuple((text or "").encode().lower().split())
        return {w[i : i + width] for i in range(len(w) - width + 1)} or ({w} if w else set())

    sets = [(r["doc_id"], shingles(r["text"])) for r in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: (len(s), least[find(i)], d == least[find(i)]) for i, (d, s) in enumerate(sets)}


def families(seed):
    """Near copies around bases at every distance from the threshold."""
    rng = random.Random(seed)
    say = lambda: "w%d" % rng.randrange(5000)
    rows = []
    for _ in range(6):
        base = [say() for _ in range(150)]
        for k in range(14):
            t = list(base)
            for _ in range(k):
                t[rng.randrange(len(t))] = say()
            rows.append((len(rows), " ".join(t), None, None, 0))
    return rows


def test_tables_follow_the_threshold():
    assert [nearcopies.tables_for(p) for p in (85, 80)] == [9, 12]
    assert all(2 * (1 - (p / 100) ** 3) ** nearcopies.tables_for(p) <= 4e-4 for p in (60, 80, 85, 95, 100))


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_copies(spark, docs, empty, width, percent):
    df = docs.union(spark.createDataFrame([(1000 + i, *r) for i, *r in families(width)], DOCS))
    want = brute_clusters(df.collect(), width, percent)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in nearcopies.cluster(df.withColumnRenamed("lang", "key"), width, percent).collect()}
    assert got == want
    kept = nearcopies.drop_copies(df.union(df), shingle_words=width, percent=percent)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, w in want.items() if w[2])
    assert nearcopies.cluster(empty, width, percent).count() == 0

def two_variants(n, seed=1):
    """Documents around one base: half near it, half near a variant that is apart from it; each changes a few words of its own."""
    rng = random.Random(seed)
    base = ["w%d" % k for k in range(200)]
    variant = list(base)
    for k in range(0, 200, 25):
        variant[k] = "v%d" % k
    rows = []
    for i in range(n):
        t = list((base, variant)[i % 2])
        for _ in range(rng.randint(0, 2)):
            t[rng.randrange(200)] = "r%d" % rng.randrange(10 * n)
        rows.append((i, " ".join(t), None, None, 0))
    return rows


def test_variants_around_one_leader_meet_linearly(spark, monkeypatch):
    made = {}
    meet = nearcopies._meetings
    for n in (300, 1200):
        monkeypatch.setattr(nearcopies, "_meetings", lambda shared, n=n: made.update({n: meet(shared).count()}) or meet(shared))
        got = nearcopies.cluster(spark.createDataFrame(two_variants(n), DOCS), 3, 85).select("component_id").distinct().collect()
        assert sorted(r["component_id"] for r in got) == [0, 1]
    assert made[1200] <= 6 * max(made[300], n)


def test_near_copies_of_one_id_and_of_none(spark):
    text = " ".join("w%d" % k for k in range(60))
    rows = [(5, text), (5, "quite another text here"), (None, text + " end"), (None, "alone in the world"), (9, text)]
    got = sorted(nearcopies.cluster(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect(), key=str)
    of = lambda n: sorted(str((r["doc_id"], r["component_id"], r["kept"])) for r in got if r["n_shingles"] == n)
    assert of(58) == ["(5, 5, True)", "(9, 5, False)"] and of(59) == ["(None, 5, False)"]
    assert of(2) == ["(5, 5, True)", "(None, None, True)"]

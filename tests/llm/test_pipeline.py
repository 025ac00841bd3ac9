"""The stages of the corpus pipeline, each held against a brute-force version on what its predecessor kept."""

import random

import pytest

import corpus_pipeline
from terrane.llm import decontamination, packing
from tests.llm.test_operators import DOCS, brute_clusters, brute_repeats, words

LABELS, ITEMS = "doc_id long, quality int, toxic int", "item_id long, text string"


def write(spark, path, docs, labels, items):
    for name, rows, schema in (("documents", docs, DOCS), ("labels", labels, LABELS), ("benchmark", items, ITEMS)):
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")


def fixture():
    rng = random.Random(11)
    say = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)]
    passage, item = say(60), say(40)
    docs, labels, toxic, leaks = [], [], set(), set()
    for i in range(120):
        t = say(rng.randint(60, 120))
        if i % 6 == 0:
            t[30:30] = ["you", "vile", "fool."]
            toxic.add(i)
        elif i % 10 == 1:
            t[20:20] = passage
        elif i % 10 == 3:
            t = t[:20] + item[20:] + item[:20]
            leaks.add(i)
        docs.append((i, " ".join(t), "en", "s", 0))
        labels.append((i, 1, int(i in toxic)))
    near = docs[5][1].split()
    near[40] = "changed"
    docs += [(500, " ".join(near), None, None, 0), (501, docs[7][1], None, None, 0), docs[8]]
    docs += [(600, None, None, None, None), (601, "", None, None, 0), (602, " ".join(say(9000)), None, None, 0), (None, "nobody knows this one", None, None, None)]
    return docs, labels, [(1, " ".join(item)), (2, None), (3, "short")], toxic, leaks


def leaked(text, item):
    """Half of the item's words, tiled over the whole text (what the passages' stage left of it)."""
    ids = {}
    doc, item = ([ids.setdefault(w, len(ids)) for w in words(t)] for t in (text, item))
    return 2 * sum(n for _, _, n in decontamination.tile(doc, item)) >= len(item)


def test_each_stage(spark, tmp_path):
    docs, labels, items, toxic, leaks = fixture()
    write(spark, tmp_path, docs, labels, items)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near copies", "repeated passages", "decontamination", "packing"]
    df, key = spark.read.parquet(f"{tmp_path}/documents.parquet"), lambda r: str((r["doc_id"], r["text"]))
    before = sorted(df.collect(), key=key)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, df, str(tmp_path)).write.parquet(f"{tmp_path}/out/{name}")
        df = spark.read.parquet(f"{tmp_path}/out/{name}")
        got = sorted(df.collect(), key=key) if "text" in df.columns else df.collect()
        if name == "toxicity":
            assert got == [r for r in before if r["doc_id"] not in toxic]
        if name == "near copies":
            known = [r for r in before if r["doc_id"] is not None]
            stays = {d for d, x in brute_clusters(known, 5, 80).items() if x[2]}
            assert got == sorted({r for r in before if r["doc_id"] is None or r["doc_id"] in stays}, key=key)
            assert not {500, 501} & {r["doc_id"] for r in got}
        if name == "repeated passages":
            want = brute_repeats([r for r in before if r["doc_id"] is not None])
            assert sum(n > 0 for _, n, _, _ in want.values()) >= 5
            for r in got:
                n, gone, _, kept = want.get(r["doc_id"], (0, 0, "", []))
                assert words(r["text"]) == kept if gone else r["text"] == next(x["text"] for x in before if x["doc_id"] == r["doc_id"])
            assert {r["doc_id"] for r in got} == {None} | {d for d, (n, _, _, kept) in want.items() if kept or not n}
        if name == "decontamination":
            assert got == [r for r in before if not leaked(r["text"], items[0][1])] and len(got) < len(before)
        if name == "packing":
            encode = packing._encoder(None).ids
            for r in before:
                mine = sorted((x for x in got if x["doc_id"] == r["doc_id"]), key=lambda x: x["piece"])
                assert sum(x["length"] for x in mine) == len(encode(r["text"] or "")) // 4 + 1
            room = {}
            for x in got:
                room[x["sequence_id"]] = room.get(x["sequence_id"], 0) + x["length"]
            assert max(room.values()) <= 1024 and len(room) <= 1.1 * sum(room.values()) / 1024 + 1
        before = got


def test_empty_tables(spark, tmp_path):
    write(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", ["toxicity", "decontamination"])
def test_other_columns_pass_through(spark, tmp_path, name):
    docs, labels, items, toxic, leaks = fixture()
    write(spark, tmp_path, docs[:30], labels, items)
    df = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumnRenamed("lang", "score").withColumnRenamed("source", "item_id")
    got = dict(corpus_pipeline.STAGES)[name](spark, df, str(tmp_path))
    assert got.columns == df.columns and {r["doc_id"] for r in got.collect()} == set(range(30)) - (toxic if name == "toxicity" else leaks)

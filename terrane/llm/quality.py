"""Learned decision lists for text quality, in DataFrame operations only.

Statistics of every text come from built-in functions; labels are joined to them, conditions are thresholds at quantiles of
the labelled rows, and sequential covering grows a conjunction by information gain on two thirds of the rows, prunes it on
the other third, and goes on with what it doesn't cover.  The ordered rules become one Spark conditional expression.

Learning reads counts by (feature, bin) only: at most some hundreds of rows for each grown condition, whatever the corpus.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SPACE = " \t\n\x0b\f\r"
#: feature: SQL over the statistics.
FEATURES = {
    "words": "cast(n_words as double)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "distinct": "n_distinct / greatest(n_words, 1)",
    "capitals": "n_capitals / greatest(word_chars, 1)",
    "ends": "n_ends / greatest(n_words, 1)",
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    at: float

    def expr(self) -> Column:
        return F.col(self.feature) > F.lit(self.at) if self.above else F.col(self.feature) <= F.lit(self.at)


Rule = tuple[Condition, ...]


def text_stats(docs: DataFrame, *keep: str) -> DataFrame:
    """``doc_id``, the ``keep`` columns, and counts of each whole text (null: as empty, all counts 0).

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words as the contract has them; n_lines with a word, n_distinct
    words, n_capitals, n_ends (sentence ends).  Windows of three words are sorted, by a hash and then by the words themselves, so
    that equal ones stand together; no step is quadratic in a text's length.  Repeated rows are counted one by one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.trim(text, F.lit(SPACE))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, text.alias("__t"), F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \x09-\x0D]+")).alias("__w"))
    w, n = F.col("__w"), F.size("__w")

    def window(i: Column) -> Column:
        words = [F.get(w, i + k) for k in range(3)]
        return F.struct(F.xxhash64(*words).alias("h"), *[x.alias(f"w{k}") for k, x in enumerate(words)], i.alias("at"))

    windows = F.when(n >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), window)))
    same = lambda a, b: F.coalesce((a["h"] == b["h"]) & (a["w0"] == b["w0"]) & (a["w1"] == b["w1"]) & (a["w2"] == b["w2"]), F.lit(False))
    twice = F.filter("__windows", lambda x, k: same(F.get(F.col("__windows"), k - 1), x) | same(x, F.get(F.col("__windows"), k + 1)))
    lines = F.filter(F.split("__t", "\n"), lambda x: F.trim(x, F.lit(SPACE)) != "")
    length = lambda pattern: F.length(F.regexp_replace("__t", pattern, "")).cast("long")
    out = out.withColumn("__windows", windows).withColumn("__lines", lines)
    out = out.withColumn("__twice", F.coalesce(F.sort_array(F.transform(twice, lambda x: x["at"])), F.array().cast("array<int>")))
    added = F.aggregate("__twice", F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")), lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n")))
    return out.select(
        "doc_id", *keep, n.cast("long").alias("n_words"), F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        length(r"[^#*$%&|<>]+").alias("n_symbols"), (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        added["n"].alias("n_repeat_words"), F.size("__lines").cast("long").alias("n_lines"), F.size(F.array_distinct("__w")).cast("long").alias("n_distinct"),
        length(r"[^\p{Lu}]+").alias("n_capitals"), length(r"[^.!?]+").alias("n_ends"),
    )


def with_features(stats: DataFrame) -> DataFrame:
    return stats.withColumns({k: F.expr(v) for k, v in FEATURES.items()})


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _counts(cells: DataFrame, covered: Column) -> dict[str, dict[int, list[int]]]:
    """feature → bin → [grow bad, grow good, prune bad, prune good] over the cells that the condition covers."""
    one = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"b_{f}").alias("b")) for f in FEATURES])).alias("x")
    sums = [F.sum(F.when((F.col("__prune") == p) & (F.col("__bad") == b), F.col("n")).otherwise(0)).alias(f"s{i}") for i, (p, b) in enumerate([(False, True), (False, False), (True, True), (True, False)])]
    out: dict[str, dict[int, list[int]]] = {f: {} for f in FEATURES}
    for r in cells.where(covered).select("__prune", "__bad", "n", one).groupBy("x.f", "x.b").agg(*sums).collect():
        out[r["f"]][r["b"]] = [r[f"s{i}"] for i in range(4)]
    return out


def _below(feature: str):
    return lambda x: x < F.col(feature)


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def learn_rules(stats: DataFrame, labels: DataFrame, bins: int = 32, max_rules: int = 8, max_conditions: int = 4, precision: float = 0.8) -> list[Rule]:
    """Ordered rules for bad texts: a text is bad if one of them holds.

    labels: ``doc_id, quality`` (1 good, 0 bad; null: no label).  A document's labels are the smallest it has.  Rows that fail
    the base rules are left out.  A pruned rule stands if at least ``precision`` of what it covers, in both parts, is bad.
    Without labels of both kinds there are no rules.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") == 0).alias("__bad"))
    rows = with_features(stats.where(~base_failed())).select("doc_id", *FEATURES).join(known, "doc_id")
    rows = rows.withColumn("__prune", F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0)
    rows = materialize(rows, "labelled")
    quantiles = [i / bins for i in range(1, bins)]
    cuts = rows.agg(*[F.percentile_approx(f, quantiles, 10000).alias(f) for f in FEATURES]).first()
    if cuts[0] is None:
        return []
    edges = {f: sorted(set(cuts[f])) for f in FEATURES}
    binned = [F.size(F.filter(F.array(*[F.lit(x) for x in edges[f]]), _below(f))).alias(f"b_{f}") for f in FEATURES]
    cells = materialize(rows.select("__prune", "__bad", *binned).groupBy("__prune", "__bad", *[f"b_{f}" for f in FEATURES]).agg(F.count(F.lit(1)).alias("n")), "cells")
    of_bin = lambda c: F.col(f"b_{c.feature}") > edges[c.feature].index(c.at) if c.above else F.col(f"b_{c.feature}") <= edges[c.feature].index(c.at)

    rules: list[Rule] = []
    left = F.lit(True)
    while len(rules) < max_rules:
        conditions: list[Condition] = []
        steps: list[list[int]] = []  # counts after each condition
        covered = left
        while len(conditions) < max_conditions:
            counts = _counts(cells, covered)
            all_ = [sum(v[i] for v in counts[next(iter(FEATURES))].values()) for i in range(4)]
            if not steps:
                steps.append(all_)
            if not all_[0] or not all_[1]:
                break
            best, at = 1e-9, None
            for f in FEATURES:
                below = [0, 0, 0, 0]
                for k, x in enumerate(edges[f]):
                    below = [a + b for a, b in zip(below, counts[f].get(k, [0] * 4))]
                    above = [a - b for a, b in zip(all_, below)]
                    for up, c in ((False, below), (True, above)):
                        if (g := _gain(c[0], c[1], all_[0], all_[1])) > best:
                            best, at = g, (Condition(f, up, x), c)
            if at is None:
                break
            conditions.append(at[0])
            steps.append(at[1])
            covered = covered & of_bin(at[0])
        worth = [(c[2] - c[3]) / max(c[2] + c[3], 1) for c in steps]
        keep = max(range(1, len(steps)), key=lambda i: (worth[i], -i), default=0)
        rule, c = tuple(conditions[:keep]), steps[keep] if keep else [0] * 4
        if not rule or c[0] + c[2] < precision * sum(c):
            break
        rules.append(rule)
        hit = F.lit(True)
        for x in rule:
            hit = hit & of_bin(x)
        left = left & ~hit
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The decision list over the feature columns: false at the first rule that holds, else true."""
    out = None
    for rule in rules:
        hit = rule[0].expr()
        for c in rule[1:]:
            hit = hit & c.expr()
        out = F.when(hit, False) if out is None else out.when(hit, False)
    return F.lit(True) if out is None else out.otherwise(True)


def score_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept`` of each row of ``docs``."""
    stats = materialize(text_stats(docs), "stats")
    rules = learn_rules(stats, labels, **options)
    out = with_features(stats).withColumn("base_failed", base_failed())
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & verdict(rules)).alias("kept"))

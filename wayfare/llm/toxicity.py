"""Toxicity by multiple-instance learning: sentences are instances, documents are bags with labels.

A sentence's score is logistic in its words. Its evidence is ``-log(1 - p)`` as far as it exceeds that of a sentence
without weighted words; a document's score is the noisy-or ``1 - exp(-sum)`` of the evidence, so sentences that say nothing
add nothing, however many they are. Only document labels are known, so training goes through the noisy-or (with a leak for
each document, not for each sentence) and divides a toxic document's blame among its sentences, which then locates the
offending ones. What clean sentences give by chance, ``n`` times their mean evidence and one standard deviation of such a
sum, is taken off, so length alone makes no document toxic.

The classifier is fitted on a bounded sample of labelled rows that are not held out, chosen by a hash of the text:
``MAX_EACH`` of each label, and no more once they hold ``MAX_TOTAL`` characters; texts of any length are drawn alike.
Scoring is one map over all rows without a shuffle.

Defined cases: a null, empty or wordless text has no instances and scores 0; repeated rows score alike; without labels of
both kinds every score is 0; labels of unknown ids are ignored, and a row with several labels counts as toxic if one is.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.llm.common import batches, sample_bound, sample_key, text

#: Sampled rows of each label, characters after which no further one is taken, features kept after screening.
MAX_EACH, MAX_TOTAL, MAX_FEATURES = 2000, 20_000_000, 4000
#: Evidence that a document has besides its sentences, in training only.
LEAK = 0.01
THRESHOLD = 0.7
SENTENCE, WORD = re.compile(r"[^.!?\n]+[.!?]*"), re.compile(r"\w+")
PREFIXES = (4, 5, 6)


def held_out(id_column: str = "doc_id") -> Column:
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1


def word_features(word: str) -> list[str]:
    """The word, and its beginnings, which inflected and compound forms share."""
    return ["=" + word, *(word[:n] for n in PREFIXES if len(word) > n)]


@dataclass
class Model:
    """bias and the weights of features; others weigh 0. mean and sd: the evidence of the clean sentences of the sample."""

    bias: float
    weights: dict[str, float]
    mean: float = 0.0
    sd: float = 0.0

    def scorer(self):
        """text -> (score, [(start, end, p)] of its sentences with p >= 0.5); remembers the weights of words."""
        get, seen, bias = self.weights.get, {}, self.bias
        least = float(np.logaddexp(0, bias))

        def weigh(w: str) -> float:
            if len(seen) > 500_000:
                seen.clear()
            x = seen[w] = sum(get(f, 0.0) for f in word_features(w))
            return x

        def score(t: str) -> tuple[float, list[tuple[int, int, float]]]:
            if not self.weights:
                return 0.0, []
            found, n, spans = 0.0, 0, []
            for m in SENTENCE.finditer(t):
                words = set(WORD.findall(m.group().lower()))
                if not words:
                    continue
                z = bias
                for w in words:
                    x = seen.get(w)
                    z += weigh(w) if x is None else x
                n += 1
                if z > bias:
                    found += float(np.logaddexp(0, z)) - least
                if z >= 0:
                    z = min(z, 30.0)
                    spans.append((m.start(), m.end(), float(1 / (1 + np.exp(-z)))))
            return float(-np.expm1(-max(0.0, found - self.mean * n - self.sd * n**0.5))) + 0.0, spans

        return score


def fit(bags: list[list[list[str]]], labels: np.ndarray, rounds: int = 400, rate: float = 0.3, l2: float = 1e-6) -> Model:
    """A model from bags (documents of sentences of features) by full-batch adaptive gradient steps."""
    y = np.asarray(labels, np.float64)
    if len(y) == 0 or y.min() == y.max():
        return Model(0.0, {})
    # screening: features whose share of toxic documents stands out, with a margin for chance
    in_toxic: dict[str, int] = {}
    in_clean: dict[str, int] = {}
    for bag, label in zip(bags, y):
        here = in_toxic if label else in_clean
        for f in {f for s in bag for f in s}:
            here[f] = here.get(f, 0) + 1
    n1, n0 = y.sum(), len(y) - y.sum()
    gain = {f: c / n1 - in_clean.get(f, 0) / n0 - 2 * ((c + in_clean.get(f, 0)) ** 0.5) / (n1 + n0) for f, c in in_toxic.items() if c >= 3 and np.log((c + 0.5) / n1 / ((in_clean.get(f, 0) + 0.5) / n0)) > 1.5}
    names = sorted((f for f in gain if gain[f] > 0), key=lambda f: (-gain[f], f))[:MAX_FEATURES]
    index = {f: i for i, f in enumerate(names)}
    rows, cols, bag_of, filled = [], [], [], []
    for b, bag in enumerate(bags):
        for s in bag:
            for i in {index[f] for f in s if f in index}:
                rows.append(len(bag_of))
                cols.append(i)
            bag_of.append(b)
            filled.append(bool(s))
    rows, cols, bag_of, filled = np.array(rows, np.int64), np.array(cols, np.int64), np.array(bag_of, np.int64), np.array(filled, bool)
    w, b, g2, gb2 = np.zeros(len(names)), -6.0, np.full(len(names), 1e-8), 1e-8
    weight = np.where(y > 0, 0.5 / n1, 0.5 / n0)
    for _ in range(rounds):
        z = b + np.bincount(rows, w[cols], len(bag_of))
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        over = z >= b
        s = LEAK + np.bincount(bag_of, np.where(over, np.logaddexp(0, z) - np.logaddexp(0, b), 0.0), len(y))
        blame = np.where(y > 0, -1 / np.expm1(np.clip(s, 1e-9, 50)), 1.0) * weight
        each = over * blame[bag_of]
        dz = p * each
        gw, gb = np.bincount(cols, dz[rows], len(names)) + l2 * w, (dz - each / (1 + np.exp(-b))).sum() + l2 * (b + 6)
        g2, gb2 = g2 + gw * gw, gb2 + gb * gb
        w -= rate * gw / np.sqrt(g2)
        b -= 0.5 * rate * gb / np.sqrt(gb2)
    z = b + np.bincount(rows, w[cols], len(bag_of))[(y[bag_of] == 0) & filled]
    chance = np.where(z > b, np.logaddexp(0, z) - np.logaddexp(0, b), 0.0) if len(z) else np.zeros(1)
    return Model(float(b), {f: float(x) for f, x in zip(names, w) if abs(x) > 1e-3}, float(chance.mean()), float(chance.std()))


def sample(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", column: str = "text", label: str = "toxic") -> DataFrame:
    """(t, y): the bounded training sample, without held-out rows. Least hashes first, so it does not depend on partitions."""
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col(id_column).alias("_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    d = docs.select(F.col(id_column).alias("_id"), text(column).alias("t")).where(~held_out("_id")).withColumn("h", F.xxhash64("t"))
    # chosen by narrow rows; only then the texts of the chosen, whose number is bounded, are fetched
    narrow = d.select("_id", "h", sample_key("h").alias("key"), F.length("t").alias("n")).join(known, "_id")
    rows = {r.y: r["count"] for r in narrow.groupBy("y").count().where("y IN (0, 1)").collect()}
    least = lambda y: narrow.where((F.col("y") == y) & (F.col("key") < sample_bound(rows.get(y, 0), MAX_EACH))).orderBy("key", "h", "_id").limit(MAX_EACH).withColumn("before", F.sum("n").over(Window.orderBy("key", "h", "_id")) - F.col("n")).where(F.col("before") < MAX_TOTAL)
    chosen = least(1).union(least(0)).select(F.col("_id").alias("_c"), F.col("h").alias("_h"), "y").distinct()
    return d.join(F.broadcast(chosen), (F.col("_id") == F.col("_c")) & (F.col("h") == F.col("_h"))).dropDuplicates(["_id", "h"]).orderBy("h", "_id").select("t", "y")


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", column: str = "text", label: str = "toxic") -> Model:
    rows = sample(docs, labels, id_column, column, label).collect()  # at most 2 * MAX_EACH texts, bounded by MAX_TOTAL
    seen: dict[str, list[str]] = {}
    of = lambda w: seen.get(w) or seen.setdefault(w, word_features(w))
    bags = [[[f for w in set(WORD.findall(m.group().lower())) for f in of(w)] for m in SENTENCE.finditer(r.t)] for r in rows]
    return fit(bags, np.array([r.y for r in rows]))


def apply(docs: DataFrame, model: Model, id_column: str = "doc_id", column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted, n_offending, offending): spans start:end of sentences that score 0.5 or more."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = held.value.scorer()
        for b in it:
            got = [score(t) for t in b.column(1).to_pylist()]
            ids = b.column(0)
            out = [zlib.crc32(str(i).encode()) % 3 == 1 if i is not None else False for i in ids.to_pylist()]
            s = [round(x[0], 6) for x in got]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(out), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32()), pa.array([len(x[1]) for x in got], pa.int32()), pa.array([",".join(f"{a}:{e}" for a, e, _ in x[1]) for x in got])],
                ["id", "held_out", "score", "predicted", "n_offending", "offending"],
            )

    batches(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("id"), text(column).alias("t")).mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int, n_offending int, offending string")

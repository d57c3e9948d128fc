"""Operator 8, toxicity by cumulative-link ordinal regression.

Severity has the ordered grades 0, 1, ... that the labels have (a label that says toxic or not gives the grades 0 and 1). Features are
sparse: hashed words and word beginnings, and of those the ones that are many times as likely in toxic training texts, each
with the logarithm of its count. One weight per feature, never negative, is shared by all thresholds: P(grade >= k) =
sigmoid(w x - cut_k), with ascending cuts. The expected severity is the sum of these probabilities.

The regression is fitted on about ``SAMPLE`` labelled texts, picked by a hash of id and text, half of them toxic where there are
enough. How often the features occur in the sample is counted by an aggregation; what reaches the driver are the features that
qualify and their counts in each sampled text. Predictions read the whole text.

Defined results: null and empty texts have no features and get the intercept's severity; so does every text when there are no
labels of two grades (then 0). Labels with a null id or null grade are left out; if an id has several labels the largest
counts. Repeated rows are learned from once and give repeated results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.kernel import WORD_LIKE, pieces, words_of
from causeway.llm.storage import materialize
from causeway.plans.shipping import ship

BITS = 20
SAMPLE = 4000
#: Bytes of the word beginnings that are features beside the words, so that inflected forms count together.
PREFIXES = (4, 5, 6, 7)
#: A feature must be in so many toxic texts, so many times as likely there as elsewhere (half a text added to both), and by so
#: many standard errors of the difference.
LEAST_TEXTS, LEAST_RATIO, LEAST_Z = 4, 12.0, 5.0


def _terms(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text and hash of every word and of the beginnings of longer words; how many words each text has."""
    words = words_of(texts, WORD_LIKE)
    owner, hashes = [words.owner], [words.hashes]
    for size in PREFIXES:
        which, some = words.prefixes(size)
        owner.append(words.owner[which])
        hashes.append(some)
    return np.concatenate(owner), np.concatenate(hashes), words.counts


def _counted(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, hash) in order, with how often each occurs."""
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    heads = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1]))) if len(owner) else np.zeros(0, np.int64)
    return owner[heads], hashes[heads], np.diff(np.append(heads, len(owner)))


@dataclass
class Model:
    features: np.ndarray  # hashes, ascending
    weights: np.ndarray
    cuts: np.ndarray

    def __post_init__(self) -> None:
        self.bitmap = np.zeros(1 << BITS, bool)
        self.bitmap[self.features >> np.uint64(64 - BITS)] = True

    def number(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are features, and the features' numbers."""
        maybe = np.flatnonzero(self.bitmap[hashes >> np.uint64(64 - BITS)])
        if not len(maybe):
            return maybe, maybe
        at = np.minimum(np.searchsorted(self.features, hashes[maybe]), len(self.features) - 1)
        same = self.features[at] == hashes[maybe]
        return maybe[same], at[same]

    def grade(self, texts) -> np.ndarray:
        """P(grade > k) for each text and threshold."""
        owner, hashes, sizes = _terms(texts)
        which, _ = self.number(hashes)
        owner, hashes, count = _counted(owner[which], hashes[which])
        value = self.weights[self.number(hashes)[1]] * np.log1p(count)
        total = np.bincount(owner, value, minlength=len(sizes))
        return 1 / (1 + np.exp(-(total[:, None] - self.cuts).clip(-30, 30)))


def fit(owner: np.ndarray, number: np.ndarray, count: np.ndarray, severity: np.ndarray, weight: np.ndarray, features: np.ndarray, steps: int = 800, ridge: float = 3e-6) -> Model:
    """Text ``owner`` has feature ``number`` as often as ``count`` says; texts have severities and weights that add up to 1."""
    n, top = len(severity), int(severity.max())
    value, rows = np.log1p(count), np.arange(n)
    w, cuts = np.zeros(len(features)), np.arange(top, dtype=float)
    first_w, second_w = np.zeros_like(w), np.zeros_like(w)
    first_c, second_c = np.zeros(top), np.zeros(top)
    for t in range(1, steps + 1):  # Adam on the weighted likelihood
        score = np.bincount(owner, w[number] * value, minlength=n)
        s = 1 / (1 + np.exp(-(score[:, None] - cuts).clip(-30, 30)))
        above = np.column_stack([np.ones(n), s, np.zeros(n)])
        slope = np.column_stack([np.zeros(n), s * (1 - s), np.zeros(n)])
        chance = np.maximum(above[rows, severity] - above[rows, severity + 1], 1e-9)
        up, down = slope[rows, severity] / chance * weight, slope[rows, severity + 1] / chance * weight
        gw = -np.bincount(number, (up - down)[owner] * value, minlength=len(w)) + ridge * w
        gc = np.array([up[severity == k + 1].sum() - down[severity == k].sum() for k in range(top)])
        first_w, second_w = 0.9 * first_w + 0.1 * gw, 0.999 * second_w + 0.001 * gw * gw
        first_c, second_c = 0.9 * first_c + 0.1 * gc, 0.999 * second_c + 0.001 * gc * gc
        scale = 0.05 / (1 - 0.9**t)
        w = np.maximum(0, w - scale * first_w / (np.sqrt(second_w / (1 - 0.999**t)) + 1e-8))  # terms of toxic texts never speak against it
        cuts = np.maximum.accumulate(cuts - scale * first_c / (np.sqrt(second_c / (1 - 0.999**t)) + 1e-8))
    return Model(features, w, cuts)


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic", sample: int = SAMPLE) -> Model | None:
    """A model of labels with grades 0, 1, ...; None where they have only one."""
    ship(spark)
    known = labels.select(F.col(id_col).alias("doc_id"), F.greatest(F.lit(0), F.col(toxic_col).cast("int")).alias("grade")).dropna().groupBy("doc_id").agg(F.max("grade").alias("grade"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    drawn = materialize(rows.select("doc_id", "key").distinct().join(known, "doc_id").select("key", "grade").distinct(), "labelled")
    sizes = {r["toxic"]: r["count"] for r in drawn.groupBy((F.col("grade") > 0).alias("toxic")).count().collect()}
    if len(sizes) < 2:
        return None
    share = {k: min(1.0, sample / 2 / n) for k, n in sizes.items()}
    draw = F.pmod("key", F.lit(1 << 30)) / float(1 << 30)
    picked = drawn.where(draw < F.when(F.col("grade") > 0, share[True]).otherwise(share[False]))  # about ``sample`` rows of two numbers, so broadcast
    texts = rows.join(F.broadcast(picked), "key").select("key", "text", "grade").dropDuplicates(["key"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, own in pieces(batch):
                owner, hashes, _ = _terms(own)
                owner, hashes, count = _counted(owner, hashes)
                cut = np.append(np.searchsorted(owner, np.arange(len(own))), len(owner)).astype(np.int32)
                lists = (pa.ListArray.from_arrays(pa.array(cut), pa.array(c)) for c in (hashes.view(np.int64), count.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *lists], ["key", "grade", "features", "counts"])

    encoded = materialize(texts.mapInArrow(encode, "key long, grade int, features array<long>, counts array<int>"), "features")
    by_grade = {r["grade"]: r["count"] for r in encoded.groupBy("grade").count().collect()}
    bad, good = sum(n for g, n in by_grade.items() if g > 0), by_grade.get(0, 0)
    if not bad or not good:
        return None
    terms = encoded.select("key", "grade", F.explode(F.arrays_zip("features", "counts")).alias("t")).select("key", "grade", F.col("t.features").alias("feature"), F.col("t.counts").alias("n"))
    seen = terms.groupBy("feature").agg(F.sum((F.col("grade") > 0).cast("int")).alias("in_bad"), F.sum((F.col("grade") == 0).cast("int")).alias("in_good"))
    p = (F.col("in_bad") + F.col("in_good")) / (bad + good)
    z = (F.col("in_bad") / bad - F.col("in_good") / good) / F.sqrt(F.greatest(p * (1 - p) * (1 / bad + 1 / good), F.lit(1e-12)))
    ratio = ((F.col("in_bad") + 0.5) / bad) / ((F.col("in_good") + 0.5) / good)
    usable = materialize(seen.where((F.col("in_bad") >= LEAST_TEXTS) & (ratio >= LEAST_RATIO) & (z >= LEAST_Z)).select("feature"), "usable")
    held = terms.join(usable, "feature").select("key", "feature", "n").toArrow().sort_by([("key", "ascending"), ("feature", "ascending")])
    of = encoded.select("key", "grade").toArrow().sort_by("key")
    keys, severity = of["key"].to_numpy(), of["grade"].to_numpy().astype(np.int64)
    grades = np.unique(severity)  # grades that no sampled text has make no threshold
    severity = np.searchsorted(grades, severity)
    features, number = np.unique(held["feature"].to_numpy().view(np.uint64), return_inverse=True)
    prior = sizes[True] / sum(sizes.values())
    weight = np.where(severity > 0, prior / bad, (1 - prior) / good)
    return fit(np.searchsorted(keys, held["key"].to_numpy()), number, held["n"].to_numpy(), severity, weight, features)


def grade(spark: SparkSession, docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, p_toxic, p_severe, expected_severity, grade, toxic) of every text; p_severe is that of the highest grade."""
    ship(spark)
    shipped = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = ["doc_id", "p_toxic", "p_severe", "expected_severity", "grade", "toxic"]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = shipped.value
        for batch in batches:
            for part, own in pieces(batch):
                p = ready.grade(own) if ready is not None else np.zeros((len(own), 1))
                reached = (p >= 0.5).sum(axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p[:, 0]), pa.array(p[:, -1]), pa.array(p.sum(axis=1)), pa.array(reached.astype(np.int64)), pa.array(reached > 0)], names)

    return rows.mapInArrow(predict, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, p_toxic double, p_severe double, expected_severity double, grade long, toxic boolean")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return grade(spark, docs, train(spark, docs, labels))

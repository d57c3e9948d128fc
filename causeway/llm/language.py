"""Operator 6, language ID with error-correcting output codes.

Each language gets a codeword; one binary classifier per bit, logistic on hashed byte trigrams, predicts it. Decoding sums
per bit a loss for disagreeing with a codeword, weighted by how well the bit's classifier does in training, and takes the
codeword of least loss. A text whose two best codewords are nearly as near is flagged as ambiguous.

The classifiers are fitted on about ``SAMPLE`` labelled texts, spread evenly over all languages and picked by a hash of id and text
(LEAST_EACH of each language, if that is more). Predictions read the text alone, all of it.

Defined results: a null text, an empty one and one without a letter are ``und`` with score 0; so is every text when nothing
was learned. Repeated rows give repeated results; null ids are not learned from; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.kernel import BYTE_VALUES, Texts, pieces, texts_of
from causeway.plans.shipping import ship

BUCKETS = 2048
SAMPLE = 6000
#: Texts of each language, at least, where there are as many.
LEAST_EACH = 20
#: Texts whose margin between the two best codewords, as a share of the largest possible, is smaller are ambiguous.
AMBIGUOUS = 0.02
UNKNOWN = "und"
_ROWS = 1024
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_STEP = np.uint64(0x9E3779B97F4A7C13)


def features(texts: Texts) -> np.ndarray:
    """Per text the square roots of its byte-trigram counts, scaled to length 1."""
    data, n = texts.data, len(texts)
    if len(data) < 3:
        return np.zeros((n, BUCKETS), np.float32)
    v = BYTE_VALUES[data]
    h = ((v[:-2] * _STEP + v[1:-1]) * _STEP + v[2:]) >> np.uint64(64 - int(math.log2(BUCKETS)))
    sizes = np.diff(texts.offsets)
    owner = np.repeat(np.arange(n), sizes)
    whole = owner[:-2] == owner[2:]
    counts = np.bincount(owner[:-2][whole] * BUCKETS + h[whole].astype(np.int64), minlength=n * BUCKETS)
    x = np.sqrt(counts.reshape(n, BUCKETS).astype(np.float32))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def has_letter(texts: Texts) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(_LETTER[texts.data])])
    found = total[texts.offsets[1:]] > total[texts.offsets[:-1]]
    for i in np.flatnonzero(~found):
        found[i] = any(c.isalpha() for c in texts.raw(i).decode(errors="replace"))
    return found


def codewords(n: int) -> np.ndarray:
    """A row of +1 and -1 for each of ``n`` languages: all splits for a few, else the random code with the widest rows."""
    if n <= 1:
        return np.ones((n, 1), np.float32)
    if n <= 5:
        columns = [(1, *c) for c in itertools.product((1, -1), repeat=n - 1) if -1 in c]
        return np.array(columns, np.float32).T
    bits, best, widest = math.ceil(10 * math.log2(n)), None, -1
    random = np.random.default_rng(11)
    for _ in range(200):
        code = random.choice(np.array([-1, 1], np.float32), (n, bits))
        code = code[:, np.abs(code.sum(axis=0)) < n]  # a bit that all languages share tells nothing
        apart = ((code.shape[1] - code @ code.T) / 2 + np.eye(n) * bits).min()
        if apart > widest:
            best, widest = code, apart
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its share of exp(-loss), and the margin to the second, from 0 to 1."""
        f = x @ self.weights + self.bias
        loss = np.stack([(np.logaddexp(0, -self.code[k] * f) * self.trust).sum(axis=1) for k in range(len(self.languages))], axis=1)
        order = np.sort(loss, axis=1)
        p = np.exp(-(loss - order[:, :1]))
        margin = np.tanh((order[:, 1] - order[:, 0]) / 2) if loss.shape[1] > 1 else np.ones(len(x))
        return loss.argmin(axis=1), 1 / p.sum(axis=1), margin


def fit(x: np.ndarray, labels: np.ndarray, languages: list[str], steps: int = 300, ridge: float = 1e-5) -> Model:
    """Logistic regression for all bits at once by accelerated gradient steps."""
    code = codewords(len(languages))
    y = code[labels]
    share = 1 / np.bincount(labels, minlength=len(languages))[labels][:, None] / len(languages)  # languages count alike
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb, rate = w.copy(), b.copy(), 4.0
    for k in range(steps):
        momentum = k / (k + 3)
        aw, ab = w + momentum * vw, b + momentum * vb
        g = (-y / (1 + np.exp((y * (x @ aw + ab)).clip(-30, 30))) * share).astype(np.float32)
        nw, nb = aw - rate * (x.T @ g + ridge * aw), ab - rate * g.sum(axis=0)
        vw, vb, w, b = nw - w, nb - b, nw, nb
    right = (((x @ w + b) * y > 0) * share).sum(axis=0)
    return Model(languages, code, w, b, np.clip(2 * right - 1, 0.05, 1).astype(np.float32))


def train(spark: SparkSession, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model | None:
    """A model of about ``sample`` of the labelled texts, of every language that has one; None if there are none."""
    ship(spark)
    rows = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(id_col, text_col).alias("draw")).where("text IS NOT NULL AND lang IS NOT NULL")
    counts = rows.select("lang", "draw").distinct().groupBy("lang").count().collect()  # a row for each language
    if not counts:
        return None
    languages = sorted(r["lang"] for r in counts)
    each = max(LEAST_EACH, sample // len(languages))
    share = spark.createDataFrame([(r["lang"], 1.0 if r["count"] <= 2 * each else each / r["count"]) for r in counts], "lang string, share double")
    draw = F.pmod("draw", F.lit(1 << 30)) / float(1 << 30)
    picked = rows.join(F.broadcast(share), "lang").where(draw < F.col("share")).dropDuplicates(["draw", "lang"]).select("text", "lang")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch):
                for a in range(0, len(texts), _ROWS):
                    some = part.slice(a, _ROWS)
                    x = features(texts_of(some.column(0)))
                    yield pa.RecordBatch.from_arrays([some.column(1), pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())], ["lang", "x"])

    got = picked.mapInArrow(encode, "lang string, x binary").toArrow().sort_by([("lang", "ascending"), ("x", "ascending")])
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float16).reshape(-1, BUCKETS).astype(np.float32)
    names = np.array(got["lang"].to_pylist(), dtype=object)
    present = [name for name in languages if (names == name).any()]
    if not present:
        return None
    number = {name: k for k, name in enumerate(present)}
    return fit(x, np.array([number[n] for n in names]), present)


def _decoded(batch: pa.RecordBatch, at: int, model: Model | None) -> Iterator[tuple[pa.RecordBatch, list[str], np.ndarray, np.ndarray]]:
    """Slices of the batch, whose column ``at`` is the text, with language, score and whether that is ambiguous."""
    named = pa.RecordBatch.from_arrays(batch.columns, [f"c{i}" if i != at else "text" for i in range(batch.num_columns)])
    for part, _ in pieces(named):
        for a in range(0, part.num_rows, _ROWS):
            some = part.slice(a, _ROWS)
            own = texts_of(some.column(at))
            letters = has_letter(own)
            if model is None:
                letters[:] = False
                best, score, margin = np.zeros(len(own), np.int64), np.zeros(len(own)), np.zeros(len(own))
            else:
                best, score, margin = model.decode(features(own))
            langs = [model.languages[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), letters.tolist(), strict=True)]
            yield some, langs, np.where(letters, score, 0.0).astype(np.float64), ~letters | (margin < AMBIGUOUS)


def identify(spark: SparkSession, docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) of every text."""
    ship(spark)
    shipped = spark.sparkContext.broadcast(model)  # grows with the languages alone
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, langs, score, ambiguous in _decoded(batch, 1, shipped.value):
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(langs, pa.string()), pa.array(score), pa.array(ambiguous)], ["doc_id", "lang_pred", "score", "ambiguous"])

    return rows.mapInArrow(predict, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, ambiguous boolean")


def _split() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def keep_identified(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` without those whose language is unknown or ambiguous; ``lang`` stays as it was given."""
    model = train(spark, docs.where(F.col("doc_id").isNotNull()))
    shipped = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, langs, _, ambiguous in _decoded(batch, at, shipped.value):
                kept = some.filter(pa.array((np.array(langs, object) != UNKNOWN) & ~ambiguous))
                yield pa.RecordBatch.from_arrays(kept.columns, batch.schema.names)

    return docs.mapInArrow(keep, docs.schema)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(spark, docs.where(F.col("doc_id").isNotNull() & ~_split()))
    return identify(spark, docs, model).select("doc_id", _split().alias("held_out"), "lang_pred", "score")

"""Operator 1, language-model scoring with a log-bilinear model trained by noise-contrastive estimation.

Word counts are gathered over all training texts by a distributed aggregation (keys are 64-bit word hashes, so that two words
share a count with a chance of about 2**-61 a pair). The most frequent words, the end of a text and classes of all other
words by the power of two of their counts make the model's output vocabulary, so it follows the counts. The context vector is
the sum of two position-weighted word vectors, and a word's score is its product with the word's output vector plus a bias.
Training texts are dealt to shards by hashes, as many as the tokens need; in each of ``rounds`` rounds every shard trains a
copy of the same model on its share of the round's texts in numpy, and copies are averaged by a distributed aggregation weighted
by tokens. All training tokens are learned from once, and neither files nor partitions change the result.

Scoring normalises exactly: since scores add up over context positions, the partition function of all pairs of context words
is one matrix product of exponentials. A word of a class has the probability of the class times its add-one share
of the class. Counts of the ``TABLE_WORDS`` most frequent words, at most, travel to the executors; rarer words, which are
spread thinly by nature, join their counts by hash.

Defined results: null and empty texts are a single end token; a null id counts as the id '' for the split; repeated rows (equal
id and text) come out as often as they came in; with no training texts every count is zero; other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.kernel import NOT_SPACE, mix, pieces, words_of
from causeway.llm.storage import materialize
from causeway.plans.shipping import ship

#: Output vocabulary of the model: frequent words, the end of text, and classes for all other words, one for each power of two of
#: their counts and one for words that are met once, never, or too seldom for the table.
VOCABULARY = 2048
DIMENSION = 32
NOISE = 64
BATCH = 1024
RATE = 0.02
#: Averagings of the copies; each round trains on its own share of the texts.
ROUNDS = 4
#: Training tokens of one copy over all rounds, about.
SHARD_TOKENS = 1 << 22
#: Words whose counts are sent to the executors, at most (12 bytes each).
TABLE_WORDS = 1 << 20
OTHER, END = 0, 1
_LN10 = math.log(10)
#: Units of one in the sums of models.
_FIXED = float(1 << 32)
#: Counts held by one counting task before it passes them on.
_HELD = 1 << 20


def _token_ids(hashes: np.ndarray, bounds: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the tokens of some texts with END after each text, and where the texts begin."""
    n = len(bounds) - 1
    begin = bounds + np.arange(n + 1)
    out = np.full(len(hashes) + n, END, np.int32)
    if len(hashes):
        out[np.arange(len(hashes)) + np.repeat(np.arange(n), np.diff(bounds))] = ids
    return out, begin


class WordTable:
    """Counts of frequent training words, and their ids in the model."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, n_texts: int, n_tokens: int, n_distinct: int, vocabulary: int) -> None:
        """``hashes`` ascending, without the end token, which has the count ``n_texts`` among all ``n_tokens``."""
        self.hashes, self.counts = hashes, counts
        level = np.frexp(counts.astype(np.float64))[1] - 1  # the whole part of log2, 0 for words met once
        top = np.lexsort((hashes, -counts))[: max(0, vocabulary - 2 - np.count_nonzero(np.unique(level)))]
        level[top] = 0
        levels = np.append(0, np.unique(level[level > 0]))
        #: A word's id: its own, that of its class of counts, or OTHER.
        self.ids = np.append(OTHER, 2 + len(top) + np.arange(len(levels) - 1))[np.searchsorted(levels, level)].astype(np.int32)
        self.ids[top] = np.arange(2, len(top) + 2)
        self.size = 1 + len(top) + len(levels)
        self.id_counts = np.bincount(self.ids, counts, self.size).astype(np.int64)
        self.id_counts[END] = n_texts
        self.id_counts[OTHER] += n_tokens - self.id_counts.sum()
        distinct = np.bincount(self.ids, minlength=self.size)
        distinct[OTHER] += n_distinct - len(hashes) - (n_texts > 0) + 1  # with one word that was never seen
        #: log10 of what a word's count plus one is divided by for its share of its class; a word of its own has the share 1.
        self.class_log = np.log10(np.maximum(self.id_counts + distinct, 1))
        self.own = np.zeros(self.size, bool)
        self.own[END : 2 + len(top)] = True
        self.shift = np.uint64(64 - 18)
        self.first = np.searchsorted(hashes >> self.shift, np.arange((1 << 18) + 1, dtype=np.uint64)).astype(np.int32) if len(hashes) else np.zeros((1 << 18) + 1, np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Position of each word in the table, or -1."""
        bucket = (hashes >> self.shift).astype(np.int64)
        at, stop = self.first[bucket], self.first[bucket + 1]
        out = np.full(len(hashes), -1, np.int64)
        left = np.flatnonzero(at < stop)
        at, stop, want = at[left], stop[left], hashes[left]
        while len(left):
            same = self.hashes[at] == want
            out[left[same]] = at[same]
            at = at + 1
            more = ~same & (at < stop)
            left, at, stop, want = left[more], at[more], stop[more], want[more]
        return out

    def ids_of(self, hashes: np.ndarray) -> np.ndarray:
        at = self.find(hashes)
        return np.where(at >= 0, self.ids[at] if len(self.ids) else 0, OTHER).astype(np.int32)


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n): how often each word hash occurs in ``text``, counted within tasks before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> pa.RecordBatch:
            hashes = np.concatenate([h for h, _ in held])
            counts = np.concatenate([c for _, c in held])
            words, which = np.unique(hashes, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(np.bincount(which, counts, len(words)).astype(np.int64))], ["word", "n"])

        for batch in batches:
            for _, part in pieces(batch):
                held.append(np.unique(words_of(part, NOT_SPACE).hashes, return_counts=True))
                size += len(held[-1][0])
                if size > _HELD:
                    yield merged()
                    held, size = [], 0
        if held:
            yield merged()

    return texts.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` of the most frequent words, cut between classes of counts, ascending by hash."""
    level = F.floor(F.log2("n") * 8).cast("int")
    classes = sorted((r["level"], r["words"]) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect())  # a few hundred rows
    floor_, total = 0, sum(n for _, n in classes)
    for lvl, n in classes:
        if total <= most:
            break
        total, floor_ = total - n, lvl + 1
    table = counts.where(level >= floor_).toArrow()
    hashes = table["word"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], table["n"].to_numpy()[order]


def contexts(ids: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The token before each and the one before that, END where the text hasn't begun."""
    first = np.zeros(len(ids), bool)
    first[begin[:-1][begin[:-1] < len(ids)]] = True
    return np.where(first, END, np.roll(ids, 1)), np.where(first | np.roll(first, 1), END, np.roll(ids, 2))


def _grouped(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    heads = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    return ids[heads], np.add.reduceat(rows[order], heads, axis=0)


class Model:
    """Parameters as float32 rows of ``dimension`` numbers: input vectors, output vectors, biases, two position weights."""

    def __init__(self, size: int, dimension: int, id_counts: np.ndarray) -> None:
        self.size, self.dimension = size, dimension
        self.noise = (id_counts + 1.0) / (id_counts + 1.0).sum()
        random = np.random.default_rng(7)
        self.inputs = (random.standard_normal((size, dimension)) * 0.1).astype(np.float32)
        self.outputs = (random.standard_normal((size, dimension)) * 0.1).astype(np.float32)
        self.bias = np.log(self.noise).astype(np.float32)
        self.near = np.ones(dimension, np.float32)
        self.far = np.full(dimension, 0.5, np.float32)

    def rows(self) -> np.ndarray:
        bias = np.zeros(-(-self.size // self.dimension) * self.dimension, np.float32)
        bias[: self.size] = self.bias
        return np.concatenate([self.inputs, self.outputs, bias.reshape(-1, self.dimension), self.near[None], self.far[None]])

    def load(self, rows: np.ndarray) -> None:
        rows = rows.astype(np.float32)
        self.inputs, self.outputs = rows[: self.size].copy(), rows[self.size : 2 * self.size].copy()
        self.bias = rows[2 * self.size : -2].ravel()[: self.size].copy()
        self.near, self.far = rows[-2].copy(), rows[-1].copy()

    def begin(self, seed: int) -> None:
        """Before training: draws follow from ``seed``, and step sizes start anew."""
        self.random = np.random.default_rng(seed)
        self.log_noise = np.log(NOISE * self.noise).astype(np.float32)
        self.cumulative = np.cumsum(self.noise)
        self.sums = {k: np.full_like(getattr(self, k), 1e-2) for k in ("inputs", "outputs", "bias", "near", "far")}

    def _step(self, name: str, where, gradient: np.ndarray) -> None:
        self.sums[name][where] += gradient * gradient
        getattr(self, name)[where] -= RATE * gradient / np.sqrt(self.sums[name][where])

    def train(self, ids: np.ndarray, begin: np.ndarray) -> int:
        """Noise-contrastive steps over all tokens of some texts; returns how many there were."""
        one, two = contexts(ids, begin)
        for a in range(0, len(ids), BATCH):
            w, c1, c2 = ids[a : a + BATCH], one[a : a + BATCH], two[a : a + BATCH]
            noise = np.searchsorted(self.cumulative, self.random.random(NOISE)).clip(max=self.size - 1)
            r1, r2 = self.inputs[c1], self.inputs[c2]
            h = r1 * self.near + r2 * self.far
            q, qn = self.outputs[w], self.outputs[noise]
            true = np.einsum("ij,ij->i", h, q) + self.bias[w] - self.log_noise[w]
            false = h @ qn.T + (self.bias[noise] - self.log_noise[noise])
            gt = (1 / (1 + np.exp(-true.clip(-30, 30))) - 1).astype(np.float32)
            gf = (1 / (1 + np.exp(-false.clip(-30, 30)))).astype(np.float32)
            dh = gt[:, None] * q + gf @ qn
            out_ids, out_rows = _grouped(np.concatenate([w, noise]), np.concatenate([np.column_stack([gt[:, None] * h, gt]), np.column_stack([gf.T @ h, gf.sum(axis=0)])]))
            in_ids, in_rows = _grouped(np.concatenate([c1, c2]), np.concatenate([dh * self.near, dh * self.far]))
            near, far = (dh * r1).sum(axis=0), (dh * r2).sum(axis=0)
            self._step("outputs", out_ids, out_rows[:, :-1])
            self._step("bias", out_ids, out_rows[:, -1])
            self._step("inputs", in_ids, in_rows)
            self._step("near", slice(None), near)
            self._step("far", slice(None), far)
        return len(ids)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """near[c, w] and far[c, w] such that log p(w | one, two) = near[one, w] + far[two, w] - log_z[one, two]."""
        near = (self.inputs * self.near) @ self.outputs.T
        far = (self.inputs * self.far) @ self.outputs.T + self.bias
        a, b = near.max(axis=1, keepdims=True), far.max(axis=1, keepdims=True)
        z = np.exp(near - a) @ np.exp(far - b).T
        return near, far, np.log(z) + a + b.T


def train(spark: SparkSession, training: DataFrame, table: WordTable, dimension: int = DIMENSION, rounds: int = ROUNDS, shard_tokens: int = SHARD_TOKENS) -> Model:
    """Average of the copies that shards of ``training`` (doc_id, text) train, round by round.

    Shard, round and order of a text follow from hashes of its id and itself, so files and partitions have no part in the
    result; the sums that make the average are of whole numbers, so neither has the order of tasks.
    """
    model = Model(table.size, dimension, table.id_counts)
    tokens = int(table.id_counts.sum())
    if not tokens:
        return model
    names = [f"v{k}" for k in range(dimension)]
    words = spark.sparkContext.broadcast(table)
    shards = math.ceil(tokens / shard_tokens)
    place = F.xxhash64("doc_id", "text")
    dealt = training.select("text", F.pmod(place, F.lit(shards)).cast("int").alias("shard"), F.pmod(F.xxhash64(place), F.lit(rounds)).alias("turn"), F.xxhash64("text").alias("key"))
    for turn in range(rounds):
        start = spark.sparkContext.broadcast(model)

        def learn(batches: Iterator[pa.RecordBatch], turn: int = turn, start=start) -> Iterator[pa.RecordBatch]:
            import copy

            known = words.value

            def done(own: Model, seen: int) -> pa.RecordBatch:
                weight = seen / shard_tokens
                rows = np.rint(own.rows().astype(np.float64) * weight * _FIXED).astype(np.int64)
                return pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), pa.array(np.full(len(rows), round(weight * _FIXED))), *(pa.array(rows[:, k]) for k in range(dimension))], ["row", "weight", *names])

            own, now, seen = None, None, 0
            for batch in batches:
                shard = batch.column(1).to_numpy()
                cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if b > a and shard[a] != now:
                        if seen:
                            yield done(own, seen)
                        own, now, seen = copy.deepcopy(start.value), shard[a], 0
                        own.begin(int(now) * rounds + turn)
                    for _, part in pieces(batch.slice(a, b - a)):
                        found = words_of(part, NOT_SPACE)
                        seen += own.train(*_token_ids(found.hashes, found.bounds, known.ids_of(found.hashes)))
            if seen:
                yield done(own, seen)

        some = dealt.where(F.col("turn") == turn).repartition(shards, "shard").sortWithinPartitions("shard", "key").select("text", "shard")
        copies = some.mapInArrow(learn, "row long, weight long, " + ", ".join(f"{n} long" for n in names))
        mean = copies.groupBy("row").agg(F.sum("weight").alias("weight"), *(F.sum(n).alias(n) for n in names)).toArrow()
        if mean.num_rows:
            order = np.argsort(mean["row"].to_numpy())
            weight = mean["weight"].to_numpy()[order].astype(np.float64)
            model.load(np.column_stack([mean[n].to_numpy()[order] / weight for n in names]))
    return model


_ready: dict[str, tuple] = {}


def score(spark: SparkSession, docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: int = VOCABULARY, dimension: int = DIMENSION, rounds: int = ROUNDS, table_words: int = TABLE_WORDS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every text under counts and model of ``training``."""
    ship(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    learned = training.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    counts = materialize(word_counts(learned), "word-counts")
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("words")).first()
    n_texts = learned.count()
    n_tokens, n_distinct = totals["n"] + n_texts, totals["words"] + (n_texts > 0)
    table = WordTable(*_frequent(counts, table_words), n_texts, n_tokens, n_distinct, vocabulary)
    model = train(spark, learned, table, dimension, rounds, shard_tokens)
    base_norm, key = math.log10(n_tokens + n_distinct + 1), uuid.uuid4().hex
    shipped = spark.sparkContext.broadcast((table, model))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_key long, word long, n long, head int, n_tokens long, n_known long, base double, score double"

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, model = shipped.value
        if key not in _ready:  # once per Python worker
            _ready.clear()
            _ready[key] = model.tables()
        near, far, log_z = _ready[key]
        in_table = np.log10(table.counts + 1.0) if len(table.counts) else np.zeros(1)
        end_log, met = math.log10(n_texts + 1), 0
        for batch in batches:
            for part, texts in pieces(batch):
                found = words_of(texts, NOT_SPACE)
                at = table.find(found.hashes)
                word_ids = np.where(at >= 0, table.ids[at] if len(table.ids) else 0, OTHER).astype(np.int32)
                ids, begin = _token_ids(found.hashes, found.bounds, word_ids)
                one, two = contexts(ids, begin)
                log_p = (near[one, ids] + far[two, ids] - log_z[one, two]).astype(np.float64) / _LN10
                total = np.diff(begin)
                model_part = np.add.reduceat(log_p, begin[:-1])
                share = np.where(at >= 0, in_table[at], 0.0)
                known = np.concatenate([[0], np.cumsum(at >= 0)])
                base_sum = np.concatenate([[0.0], np.cumsum(share)])
                class_sum = np.concatenate([[0.0], np.cumsum(np.where(table.own[word_ids], 0.0, share - table.class_log[word_ids]))])
                a, b = found.bounds[:-1], found.bounds[1:]
                base_part = base_sum[b] - base_sum[a] + end_log - total * base_norm
                model_part = model_part + class_sum[b] - class_sum[a]
                zeros = np.zeros(part.num_rows, np.int64)
                spread = mix(part.column(2).to_numpy().view(np.uint64) + np.arange(met, met + part.num_rows, dtype=np.uint64)).view(np.int64)
                met += part.num_rows
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(spread), *map(pa.array, (zeros, np.ones(part.num_rows, np.int32), total, known[b] - known[a] + (n_texts > 0), base_part, model_part))], NAMES)
                rare = np.flatnonzero(at < 0)
                if len(rare):
                    owner = found.owner[rare]
                    order = np.lexsort((found.hashes[rare], owner))
                    owner, words = owner[order], found.hashes[rare][order]
                    heads = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (words[1:] != words[:-1])))
                    many = np.diff(np.append(heads, len(words)))
                    take = pa.array(owner[heads])
                    zero, nought = np.zeros(len(heads), np.int64), np.zeros(len(heads))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(2).take(take), *map(pa.array, (words[heads].view(np.int64), many, zero.astype(np.int32), zero, zero, nought, nought))], NAMES)

    parts = rows.mapInArrow(apply, schema)
    # a header row has n = 0 and a word made of its place, so headers spread over the join, those of equal texts too
    joined = parts.join(counts.select("word", F.col("n").alias("c")), "word", "left")
    gain = F.col("n") * F.log10(F.coalesce(F.col("c"), F.lit(0)) + 1)
    summed = joined.groupBy("doc_id", "text_key").agg(
        F.sum("head").alias("copies"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + gain).alias("base"),
        F.sum(F.col("score") + gain).alias("score"),
    )
    one = lambda c: (F.col(c) / F.col("copies")).alias(f"{c}")
    each = summed.select("doc_id", (F.col("n_tokens") / F.col("copies")).cast("bigint").alias("n_tokens"), (F.col("n_known") / F.col("copies")).cast("bigint").alias("n_known"), F.lit(n_tokens).cast("bigint").alias("train_tokens"), one("base").alias("base_score"), one("score").alias("score"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return each.drop("copy")


NAMES = ["doc_id", "text_key", "word", "n", "head", "n_tokens", "n_known", "base", "score"]


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2
    scored = score(spark, docs, docs.where(~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")

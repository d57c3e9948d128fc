"""Operator 2, benchmark decontamination by suffix arrays of the training documents.

Each shard of training text gets a suffix array over its words; every test suffix is binary-searched in it. Equal diagonals
of hits join into the longest verbatim matches with their places in document and item. A window is ``window`` consecutive
words of an item, or a whole shorter item; a document word inside an occurrence of a window is hit.

The benchmark is measured first and taken in blocks of at most ``block_bytes`` characters of text: only one block is ever
collected and broadcast, and a larger benchmark means more passes over the documents.

Defined results: null or wordless texts have no words and no hits; an item without words matches nothing; repeated document
rows (equal id and text) come out as often as they came in; repeated items count once per id; an item with a null id
hits words and makes documents dirty but is not listed or counted; an empty benchmark leaves all
documents clean; other columns are ignored whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causeway.llm.kernel import WORD_LIKE, Texts, pieces, texts_of, words_of
from causeway.plans.shipping import ship

WINDOW = 10
BLOCK_BYTES = 16 << 20
SHARD_BYTES = 2 << 20
_BITMAP_BITS = 20

MATCH = T.StructType([T.StructField("item_id", T.StringType()), *(T.StructField(n, T.LongType()) for n in ("doc_word", "item_word", "n_words"))])


class TestSuffixes:
    """The windows of one block of items as packed keys to search for."""

    def __init__(self, item_ids: list, item_texts: list, window: int) -> None:
        words = words_of(texts_of(pa.array(item_texts, pa.string())), WORD_LIKE)
        self.window, self.item_ids = window, item_ids
        self.vocabulary, ids = np.unique(words.hashes, return_inverse=True)
        ids = ids.astype(np.int64) + 1
        self.bitmap = np.zeros(1 << _BITMAP_BITS, bool)
        self.bitmap[self.vocabulary >> np.uint64(64 - _BITMAP_BITS)] = True
        self.bits = max(1, int(len(self.vocabulary)).bit_length())
        self.per_key = max(1, min(window, 63 // self.bits))
        self.columns = math.ceil(window / self.per_key)
        counts = words.counts
        span = np.minimum(counts, window)
        per_item = np.where(counts > 0, counts - span + 1, 0)
        item = np.repeat(np.arange(len(counts)), per_item)
        within = np.arange(len(item)) - np.repeat(np.cumsum(per_item) - per_item, per_item)
        at = words.bounds[:-1][item] + within
        padded = np.concatenate([ids, np.zeros(window, np.int64)])
        rows = padded[at[:, None] + np.arange(window)] if len(at) else np.zeros((0, window), np.int64)
        rows[np.arange(window) >= span[item][:, None]] = 0
        self.rows, which = np.unique(rows, axis=0, return_inverse=True)
        which = which.ravel()
        order = np.argsort(which, kind="stable")
        #: Places of each distinct window: item and first word, as slices of two arrays.
        self.items, self.item_words = item[order], within[order]
        self.place_bounds = np.searchsorted(which[order], np.arange(len(self.rows) + 1))
        self.lengths = (self.rows > 0).sum(axis=1)
        self.low = self.pack(self.rows)
        self.high = self.pack(np.where(self.rows > 0, self.rows, (1 << self.bits) - 1))
        self.item_sizes = counts

    def pack(self, rows: np.ndarray) -> list[np.ndarray]:
        """Keys that order rows of word ids as their words do, a few words to a 64-bit number."""
        keys = []
        for c in range(self.columns):
            key = np.zeros(len(rows), np.int64)
            for k in range(c * self.per_key, (c + 1) * self.per_key):
                key = (key << self.bits) | (rows[:, k] if k < rows.shape[1] else 0)
            keys.append(key)
        return keys

    def ids_in(self, hashes: np.ndarray) -> np.ndarray:
        """Item word ids of document words, 0 for words that no item has."""
        out = np.zeros(len(hashes), np.int64)
        if len(self.vocabulary):
            maybe = np.flatnonzero(self.bitmap[hashes >> np.uint64(64 - _BITMAP_BITS)])
            at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
            same = self.vocabulary[at] == hashes[maybe]
            out[maybe[same]] = at[same] + 1
        return out


class SuffixArray:
    """Suffixes of a shard's words in order of their first ``window`` words; words that no item has begin none."""

    def __init__(self, ids: np.ndarray, tests: TestSuffixes) -> None:
        padded = np.concatenate([ids, np.zeros(tests.window, np.int64)])
        begin = np.flatnonzero(ids)
        self.keys = []
        for c in range(tests.columns):
            key = np.zeros(len(begin), np.int64)
            for k in range(c * tests.per_key, (c + 1) * tests.per_key):
                key = (key << tests.bits) | (padded[begin + k] if k < tests.window else 0)
            self.keys.append(key)
        order = np.lexsort(self.keys[::-1]) if len(begin) else np.zeros(0, np.int64)
        self.suffixes = begin[order]
        self.keys = [key[order] for key in self.keys]

    def search(self, wanted: list[np.ndarray], right: bool) -> np.ndarray:
        """How many suffixes come before each wanted key (or not after it): one binary search for all of them."""
        low = np.zeros(len(wanted[0]), np.int64)
        high = np.full(len(wanted[0]), len(self.suffixes), np.int64)
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            middle = (low[open_] + high[open_]) // 2
            before = np.zeros(len(open_), bool)
            equal = np.ones(len(open_), bool)
            for have, want in zip(self.keys, wanted, strict=True):
                a, b = have[middle], want[open_]
                before |= equal & (a < b)
                equal &= a == b
            if right:
                before |= equal
            low[open_[before]] = middle[before] + 1
            high[open_[~before]] = middle[~before]


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All of start, start + 1, ... for each start, as many as counted."""
    total = int(counts.sum())
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(total)


def scan_shard(texts: Texts, tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray, list[list[str]], list[list[dict]]]:
    """Per text of the shard: words, hit words, items with occurring windows, longest matches."""
    words = words_of(texts, WORD_LIKE)
    counts, n = words.counts, len(texts)
    owner = words.owner
    ids = np.zeros(len(owner) + n, np.int64)  # a 0 after each text
    place = np.arange(len(owner)) + owner
    ids[place] = tests.ids_in(words.hashes)
    array = SuffixArray(ids, tests)
    first, past = array.search(tests.low, False), array.search(tests.high, True)
    found = np.maximum(past - first, 0)
    at = array.suffixes[_spread(first, found)]
    window = np.repeat(np.arange(len(found)), found)
    items: list[list[str]] = [[] for _ in range(n)]
    matches: list[list[dict]] = [[] for _ in range(n)]
    if not len(at):
        return counts, np.zeros(n, np.int64), items, matches
    step = np.zeros(len(ids) + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + tests.lengths[window], -1)
    hit = np.cumsum(step)[:-1] > 0
    begin = words.bounds[:-1] + np.arange(n)
    n_hit = np.add.reduceat(np.concatenate([hit, [False]]).astype(np.int64), begin)
    n_hit[counts == 0] = 0
    places = np.diff(tests.place_bounds)[window]
    k = _spread(tests.place_bounds[:-1][window], places)
    at, size = np.repeat(at, places), np.repeat(tests.lengths[window], places)
    doc = np.searchsorted(begin, at, "right") - 1
    item, item_word = tests.items[k], tests.item_words[k]
    order = np.lexsort((at, at - item_word, item, doc))
    doc, item, at, item_word, size = doc[order], item[order], at[order], item_word[order], size[order]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (at[1:] != at[:-1] + 1) | (item_word[1:] != item_word[:-1] + 1)
    heads = np.flatnonzero(fresh)
    runs = np.diff(np.append(heads, len(at)))
    for h, run in zip(heads.tolist(), runs.tolist(), strict=True):
        d = int(doc[h])
        name = tests.item_ids[item[h]]
        items[d].append(name)
        matches[d].append({"item_id": name, "doc_word": int(at[h] - begin[d]), "item_word": int(item_word[h]), "n_words": int(size[h] + run - 1)})
    return counts, n_hit, [sorted({i for i in x if i is not None}) for x in items], matches


def _pass(docs: DataFrame, items: list, window: int) -> DataFrame:
    """One block of items against all documents."""
    shipped = docs.sparkSession.sparkContext.broadcast(([i for i, _ in items], [t or "" for _, t in items]))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("matches", T.ArrayType(MATCH)), T.StructField("text_key", T.LongType())])
    arrow_match = pa.struct([("item_id", pa.string()), *((n, pa.int64()) for n in ("doc_word", "item_word", "n_words"))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = TestSuffixes(*shipped.value, window)
        for batch in batches:
            for part, texts in pieces(batch, "text", SHARD_BYTES):
                n_words, n_hit, found, matches = scan_shard(texts, tests)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(found, pa.list_(pa.string())), pa.array(matches, pa.list_(arrow_match)), part.column(2)], schema.names)

    return docs.mapInArrow(scan, schema)


def _blocks(benchmark: DataFrame, item_col: str, item_text_col: str, block_bytes: int) -> Iterator[list[tuple]]:
    """The items, collected a bounded block at a time; one empty block if there are none."""
    tests = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    size = tests.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64), F.lit(0)).alias("bytes")).first()["bytes"]
    blocks = max(1, math.ceil(size / block_bytes))
    for k in range(blocks):
        yield [tuple(r) for r in tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()]


def find_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, items, matches) for every document; matches give longest verbatim matches and their places."""
    ship(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    parts, blocks = None, 0
    for block in _blocks(benchmark, item_col, item_text_col, block_bytes):
        one = _pass(rows, block, window).withColumn("block", F.lit(blocks))
        parts, blocks = one if parts is None else parts.unionAll(one), blocks + 1
    if blocks == 1:
        return parts.drop("text_key", "block")
    merged = parts.groupBy("doc_id", "text_key").agg(
        F.max("n_words").alias("n_words"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_distinct(F.flatten(F.collect_list("matches"))).alias("matches"),
        F.sum(F.when(F.col("block") == 0, 1).otherwise(0)).alias("copies"),
    )
    spans = F.array_sort(F.transform("matches", lambda m: F.struct(m["doc_word"].alias("a"), (m["doc_word"] + m["n_words"]).alias("b"))))
    covered = F.aggregate(
        spans, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda s, m: F.struct((s["n"] + F.greatest(F.lit(0), m["b"] - F.greatest(m["a"], s["end"]))).alias("n"), F.greatest(s["end"], m["b"]).alias("end")),
    )["n"]
    return merged.select("doc_id", "n_words", covered.alias("n_hit"), "items", "matches", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the documents that hold a benchmark window; all columns stay, and no row is shuffled."""
    ship(spark)
    at = docs.columns.index(text_col)
    for block in _blocks(benchmark, "item_id", "text", block_bytes):
        shipped = spark.sparkContext.broadcast(([i for i, _ in block], [t or "" for _, t in block]))

        def clean(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            tests = TestSuffixes(*shipped.value, window)
            for batch in batches:
                named = pa.RecordBatch.from_arrays(batch.columns, [f"c{i}" if i != at else "text" for i in range(batch.num_columns)])
                for part, texts in pieces(named, "text", SHARD_BYTES):
                    kept = part.filter(pa.array(scan_shard(texts, tests)[1] == 0))
                    yield pa.RecordBatch.from_arrays(kept.columns, batch.schema.names)

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = find_leaks(spark, docs, benchmark)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ORACLE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORDS}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORDS}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, unnest(list_transform(range(1, len(w) - least(len(w), {WINDOW}) + 2), lambda k: array_to_string(w[k:k + least(len(w), {WINDOW}) - 1], ' '))) AS s FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS k, w FROM d, sizes WHERE len(w) >= n),
hits AS (SELECT dw.doc_id, dw.k, dw.n, bw.item_id FROM (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS s FROM dw) dw JOIN bw ON bw.n = dw.n AND bw.s = dw.s),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

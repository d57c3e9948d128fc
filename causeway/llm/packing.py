"""Operator 3, packing: shortest-pack-first over the length histogram.

Documents are tokenised, ended by id 0 and cut into pieces of at most ``capacity`` ids. Only the histogram of piece lengths
(``capacity`` counts) reaches the driver. There lengths are placed longest first, each into the shortest open pack that
takes it, updating counts of packing patterns; the patterns become ranges of ranks per length, and pieces join them by
their rank within their length. Ranks come from salted groups, so a length that most pieces share is spread.

Defined results: a null or empty text is the single id 0; repeated rows are packed each; no documents give no pieces; other
columns are ignored whatever their names.
"""

from __future__ import annotations

import ctypes
import functools
import json
import math
import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from causeway.llm.kernel import pieces
from causeway.llm.storage import materialize
from causeway.plans.shipping import ship

CAPACITY = 1024
END_ID = 0
#: Pieces of one length that one salted group ranks, about.
GROUP_ROWS = 4_000
#: Text bytes encoded at once, so that little is held besides the batch.
SLICE_BYTES = 2 << 20
#: New parts encoded as one text; what a tokenizer makes of a text is many times its size.
LEARN_PARTS = 1 << 10
#: Parts of texts whose ids a worker keeps, about.
MOST_PARTS = 1 << 19
#: Characters of new parts after which a worker forgets, about.
MOST_HELD = 16 << 20
#: Longer parts aren't kept then.
SHORT_PART = 64


class Encoder:
    """Ids of texts by a tokenizer file, with no options beside ``add_special_tokens=False``.

    A byte-level tokenizer starts a new word at every blank that a character other than white space follows, whatever
    stands around. So a text is cut there and each distinct part is encoded once, its ids being kept for the next texts; new
    parts are encoded as one text, and token lengths tell where each ends. Other tokenizers, and texts with the string of an
    added token, are encoded whole.
    """

    BLANK = re.compile(r" (?=\S)")

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a worker has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        split = made["pre_tokenizer"] or {}
        self.added = [t["content"] for t in made["added_tokens"]]
        plain = made["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        self.by_part = plain and made["model"]["type"] == "BPE" and not any(" " in t for t in self.added)
        if self.by_part:  # a token's characters stand for its bytes
            vocabulary = self.tokenizer.get_vocab()
            self.token_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
            self.token_bytes[[*vocabulary.values()]] = [len(t) for t in vocabulary]
        self.parts = _Parts()
        #: Characters of the parts that came since the last time some were forgotten.
        self.held = 0
        self.sizes, self.begin, self.flat, self.uses = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def forget(self) -> None:
        """Keeps the short parts met again since they came, half of MOST_PARTS at most."""
        names = [*self.parts]
        often = np.array([k for k in np.flatnonzero(self.uses > 1).tolist() if len(names[k]) <= SHORT_PART], np.int64)
        often = np.sort(often[np.argsort(-self.uses[often], kind="stable")[: MOST_PARTS // 2]])
        ids = self.ids(often)
        self.parts, self.held = _Parts(names[k] for k in often.tolist()), 0
        self.sizes, self.flat, self.uses = self.sizes[often], ids, np.ones(len(often), np.int64)
        self.begin = np.cumsum(self.sizes) - self.sizes

    def rest(self) -> None:
        """Ends a task: a worker lives on beside those of later stages, so it gives back what it can."""
        if len(self.parts) > MOST_PARTS // 2 or self.held > MOST_HELD // 2:
            self.forget()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def learn(self) -> None:
        """Encodes the new parts, each after a blank."""
        fresh, self.parts.fresh = self.parts.fresh, []
        self.held += sum(map(len, fresh))
        sizes, flat = [self.sizes], [self.flat]
        for a in range(0, len(fresh), LEARN_PARTS):
            some = fresh[a : a + LEARN_PARTS]
            joined = " " + " ".join(some)
            flat.append(self.whole(joined))
            data = np.frombuffer(joined.encode(), np.uint8)
            ends = np.append(np.flatnonzero(data == 32)[1:], len(data))
            if len(ends) != len(some):  # odd parts have blanks of their own
                ends = np.cumsum([len(part.encode()) + 1 for part in some])
            upto = np.searchsorted(np.cumsum(self.token_bytes[flat[-1]]), ends) + 1
            sizes.append(np.diff(upto, prepend=0))
        if fresh:
            self.sizes, self.flat = np.concatenate(sizes), np.concatenate(flat)
            self.begin = np.cumsum(self.sizes) - self.sizes
            self.uses = np.concatenate([self.uses, np.zeros(len(fresh), np.int64)])

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.parts) > MOST_PARTS or self.held > MOST_HELD:
            self.forget()
        found: list[np.ndarray | None] = []
        firsts: list[str] = []
        numbers: list[int] = []
        upto: list[int] = []
        number = self.parts.__getitem__
        for text in texts:
            if not self.by_part or any(t in text for t in self.added):
                found.append(self.whole(text))
                continue
            split = text.split(" ")
            known = len(numbers)
            try:
                numbers.extend(map(number, split[1:]))
            except OddBlank:
                del numbers[known:]
                split = self.BLANK.split(text)
                numbers.extend(map(number, split[1:]))
            found.append(None)
            firsts.append(split[0])
            upto.append(len(numbers))
        self.learn()
        n = np.fromiter(numbers, np.int64, len(numbers))
        self.uses += np.bincount(n, minlength=len(self.uses))
        ends = np.append(0, np.cumsum(self.sizes[n]))[np.asarray([0, *upto], np.int64)].tolist()
        ids = self.ids(n)
        first_ids = self.tokenizer.encode_batch_fast(firsts, add_special_tokens=False)
        by_part = (np.concatenate([np.array(e.ids, np.uint32), ids[a:b]]) for e, a, b in zip(first_ids, ends, ends[1:], strict=False))
        return [next(by_part) if f is None else f for f in found]

    def ids(self, n: np.ndarray) -> np.ndarray:
        size = self.sizes[n]
        shift = np.repeat(self.begin[n] - (np.cumsum(size) - size), size)
        return self.flat[shift + np.arange(len(shift))]


class OddBlank(KeyError):
    """A text has a blank before white space or at its end."""


class _Parts(dict):
    """Numbers of parts of texts; a new part gets the next number."""

    def __init__(self, known: Iterable[str] = ()) -> None:
        super().__init__((part, k) for k, part in enumerate(known))
        self.fresh: list[str] = []

    def __missing__(self, part: str) -> int:
        if not part or part[0].isspace():
            raise OddBlank(part)
        self[part] = number = len(self)
        self.fresh.append(part)
        return number


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Rows (doc_id, start, length, doc_tokens, ids, ids_crc32); ids holds little-endian unsigned 32-bit ids."""
    path = tokenizer_path or default_tokenizer()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    names = ["doc_id", "start", "length", "doc_tokens", "ids", "ids_crc32"]
    schema = T.StructType([rows.schema["doc_id"], *(T.StructField(n, T.LongType()) for n in names[1:4]), T.StructField("ids", T.BinaryType()), T.StructField("ids_crc32", T.LongType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        for batch in batches:
            for part, texts in pieces(batch, "text", SLICE_BYTES):
                found = encode([texts.raw(i).decode() for i in range(len(texts))])
                total = np.array([len(ids) for ids in found]) + 1
                many = -(-total // capacity)
                own = np.repeat(np.arange(len(found)), many)
                start = (np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)) * capacity
                length = np.minimum(total[own] - start, capacity)
                end = END_ID.to_bytes(4, "little")
                ended = [ids.astype("<u4").tobytes() + end for ids in found]
                held = [ended[i][4 * a : 4 * (a + n)] for i, a, n in zip(own.tolist(), start.tolist(), length.tolist(), strict=True)]
                columns = [part.column(0).take(pa.array(own)), *(pa.array(c) for c in (start, length, total[own])), pa.array(held, pa.binary()), pa.array([zlib.crc32(h) for h in held], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names)
        encode.rest()

    return rows.mapInArrow(cut, schema)


def shortest_pack_first(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns with their counts.

    Lengths are placed longest first. A piece goes into the shortest open pack with room for it; where none has room it
    opens a pack, which the next pieces of its length then share.
    """
    open_packs: dict[int, list[list]] = {}
    for length in sorted((k for k, n in histogram.items() if n), reverse=True):
        left = histogram[length]
        while left:
            filled = min((f for f, stack in open_packs.items() if stack and f + length <= capacity), default=None)
            if filled is None:
                each = capacity // length
                for share, packs in ((each, left // each), (left % each, 1)):
                    if share and packs:
                        open_packs.setdefault(share * length, []).append([(length,) * share, packs])
                break
            pattern, count = open_packs[filled].pop()
            packs = min(count, left)
            if packs < count:
                open_packs[filled].append([pattern, count - packs])
            open_packs.setdefault(filled + length, []).append([(*pattern, length), packs])
            left -= packs
    return [(pattern, count) for filled in sorted(open_packs) for pattern, count in open_packs[filled]]


def _intervals(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, past the last rank, first sequence, offset) for each slot of each pattern."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            first = used.get(length, 0)
            out.append((length, first, first + count, sequence, offset))
            used[length] = first + count
            offset += length
        sequence += count
    return out


def pack(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its ids and its place: (doc_id, start, length, doc_tokens, ids, ids_crc32, sequence_id, offset)."""
    ship(spark)
    cut = materialize(token_pieces(docs, id_col, text_col, tokenizer_path, capacity), "pieces")
    lengths = cut.groupBy("length").count().collect()  # at most `capacity` rows
    patterns = shortest_pack_first({r["length"]: r["count"] for r in lengths}, capacity)
    total = sum(r["count"] for r in lengths)
    salts = max(1, math.ceil(total / GROUP_ROWS))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)))
    by_salt = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(by_salt), F.lit(0)).alias("before"))
    place = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = salted.join(offsets, ["length", "salt"]).withColumn("rank", F.col("before") + F.row_number().over(place) - 1)
    slots = spark.createDataFrame(_intervals(patterns), "slot_length long, first long, past long, sequence long, slot_offset long")
    hit = (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("past"))
    # slots has a few rows per length whatever the input, so it is broadcast
    return ranked.join(F.broadcast(slots), hit).select("doc_id", "start", "length", "doc_tokens", "ids", "ids_crc32", (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), F.col("slot_offset").alias("offset"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")

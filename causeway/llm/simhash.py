"""Operator 10, document fingerprints by SimHash.

Every run of ``TERM`` words is a term; each occurrence votes for or against every bit of the fingerprint by the bits of its hash,
so a term weighs as often as it occurs. A fingerprint has ``BITS`` bits, written as hex. Neighbours within a Hamming radius are
found through permuted block tables: the bits are cut into radius + ``SPARE`` blocks, and for every choice of ``SPARE``
blocks a table is keyed by them; any two fingerprints within the radius agree on some choice.

The query gives the number of other fingerprints within ``RADIUS`` of those of the documents whose id is divisible by
``QUERY_EVERY``, found through the tables over all fingerprints.

Defined results: ids are whole numbers; a null text is empty; an empty or wordless text has the fingerprint of zeros; equal texts have equal
fingerprints; repeated rows give repeated results. Next documents follow ascending (id, hash of the text); a row with a null id
has no place in that order and is its own next document. Other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.kernel import NOT_SPACE, Texts, pieces, salted, shingles_of, words_of
from causeway.llm.storage import materialize
from causeway.plans.shipping import ship

BITS = 128
TERM = 2
SPARE = 2
RADIUS = 3
#: Documents whose ids are divisible by this are the queries of the neighbour search.
QUERY_EVERY = 20
#: Documents in one sorted stretch, about.
STRETCH_ROWS = 5_000
_TERMS = 1 << 17
UNPACK_BYTES = 8 << 20


def fingerprints(texts: Texts) -> np.ndarray:
    """A row of ``BITS // 8`` bytes for each text."""
    rolled, own = shingles_of(words_of(texts, NOT_SPACE), TERM)
    n = len(texts)
    votes = np.zeros((n, BITS), np.int64)
    for a in range(0, len(rolled), _TERMS):  # bounds the matrix of bits
        hashes, owner = rolled[a : a + _TERMS], own[a : a + _TERMS]
        heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        size = np.diff(np.append(heads, len(owner)))
        for part in range(BITS // 64):
            bits = np.unpackbits(salted(hashes, part).view(np.uint8).reshape(-1, 8), axis=1)
            ones = np.add.reduceat(bits, heads, axis=0, dtype=np.int32)
            votes[owner[heads], part * 64 : part * 64 + 64] += 2 * ones - size[:, None]
    return np.packbits(votes > 0, axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine that the share of unequal bits stands for, 0 where it is negative."""
    apart = np.bitwise_count(a ^ b).sum(axis=1)
    return np.maximum(0.0, np.cos(np.pi * apart / BITS))


def _packed(texts: pa.Array) -> pa.Array:
    """Each text compressed, after its size in 8 bytes."""
    codec = pa.Codec("zstd", compression_level=3)
    raw = [t.as_buffer() for t in texts.cast(pa.large_binary())]
    return pa.array([len(r).to_bytes(8, "little") + codec.compress(r, asbytes=True) for r in raw], pa.binary())


def _unpacked(packed: pa.Array) -> pa.Array:
    codec = pa.Codec("zstd")
    return pa.array([codec.decompress(p[8:], int.from_bytes(p[:8], "little"), asbytes=True) for p in packed.to_pylist()], pa.large_binary()).cast(pa.large_string())


def with_next(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) dealt into stretches of ascending ids: (stretch, role, doc_id, key, packed), with the texts compressed.

    Role 0 is a document, role 1 a copy of the next stretch's first document at the end of a stretch. Only the borders, one
    id per stretch, reach the driver; each text is shuffled once.
    """
    ids = docs.select("doc_id").where("doc_id IS NOT NULL")
    n = ids.count()
    stretches = max(1, math.ceil(n / STRETCH_ROWS))
    cuts = sorted(set(ids.stat.approxQuantile("doc_id", [k / stretches for k in range(1, stretches)], 0.1 / stretches))) if stretches > 1 else []
    # the least ids at or after each cut are the stretches' first; one aggregation, combined within tasks
    cut_table = spark.sparkContext.broadcast(np.array(cuts, np.float64))

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, int] = {}
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.searchsorted(cut_table.value, values, "right")
            for k in np.unique(at).tolist():
                best[k] = min(best.get(k, values[at == k].min()), values[at == k].min())
        if best:
            yield pa.RecordBatch.from_arrays([pa.array(list(best)), pa.array([int(v) for v in best.values()])], ["cut", "first"])

    firsts = np.array(sorted(r["first"] for r in ids.select(F.col("doc_id").cast("bigint")).mapInArrow(least, "cut long, first long").groupBy("cut").agg(F.min("first").alias("first")).collect()), np.int64)
    shipped = spark.sparkContext.broadcast(firsts)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = shipped.value
        for batch in batches:
            known = batch.filter(batch.column(0).is_valid())
            values = known.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.searchsorted(first, values, "right") - 1
            lead = np.flatnonzero(first[at] == values) if len(values) else np.zeros(0, np.int64)
            lost = batch.filter(batch.column(0).is_null())
            for rows, stretch, role in ((known, at, 0), (known.take(pa.array(lead)), (at[lead] - 1) % max(1, len(first)), 1), (lost, -1 - np.arange(lost.num_rows) % 997, 0)):
                if rows.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(np.asarray(stretch, np.int64)), pa.array(np.full(rows.num_rows, role, np.int32)), rows.column(0), rows.column(2), _packed(rows.column(1))], ["stretch", "role", "doc_id", "key", "packed"])

    dealt = docs.select("doc_id", "text", F.xxhash64("text")).mapInArrow(deal, f"stretch long, role int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, key long, packed binary")
    return dealt.repartition("stretch").sortWithinPartitions("stretch", "role", "doc_id", "key")


def _unpacked_pieces(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Slices of a batch of ``with_next`` with its texts, a few MB of them at once."""
    packed = batch.column(4)
    size = np.array([int.from_bytes(p.as_buffer()[:8].to_pybytes(), "little") for p in packed], np.int64)
    block = np.cumsum(size) // UNPACK_BYTES
    cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(size)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            some = batch.slice(a, b - a)
            yield from pieces(pa.RecordBatch.from_arrays([*some.columns[:3], _unpacked(some.column(4))], ["stretch", "role", "doc_id", "text"]))


def edit(text: str, following: str) -> str:
    """The last half of the code points replaced by as many first ones of the following text, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_with_next(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next) of every document."""
    ship(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    names = ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row so far, whose next row isn't known yet
        own_next = lambda stretch: stretch < 0

        def done(stretch, role, ids, texts, prints, following) -> pa.RecordBatch:
            """Rows 0..n-1 of lists that may hold one row more, the next of the last."""
            take = [i for i in range(following) if role[i] == 0]
            # a role-1 row ends a stretch; a second one of an equal id is passed over
            nxt = [i if own_next(stretch[i]) or i + 1 >= len(texts) or stretch[i + 1] != stretch[i] else i + 1 for i in take]
            edited = [edit(texts[i], texts[j]) for i, j in zip(take, nxt, strict=True)]
            changed = np.zeros((len(take), BITS // 8), np.uint8)
            at = 0
            for _, some in pieces(pa.RecordBatch.from_arrays([pa.array(edited, pa.large_string())], ["text"])):
                changed[at : at + len(some)] = fingerprints(some)
                at += len(some)
            mine, theirs = prints[take], prints[nxt]
            hexed = lambda x: pa.array([r.tobytes().hex() for r in x], pa.string())
            return pa.RecordBatch.from_arrays([pa.array([ids[i] for i in take], id_type), pa.array([len(texts[i]) for i in take], pa.int64()), pa.array(edited, pa.string()), hexed(mine), hexed(changed), pa.array(likeness(mine, changed)), pa.array(likeness(mine, theirs))], names)

        id_type = None
        for batch in batches:
            id_type = batch.column(2).type
            for part, own in _unpacked_pieces(batch):
                now = ([*part.column(0).to_pylist()], [*part.column(1).to_pylist()], [*part.column(2).to_pylist()], part.column(3).to_pylist(), fingerprints(own))
                if held is not None:
                    now = tuple(h + x for h, x in zip(held[:4], now[:4], strict=True)) + (np.concatenate([held[4], now[4]]),)
                if len(now[3]) > 1:
                    yield done(*now, len(now[3]) - 1)
                held = tuple(x[-1:] for x in now)
        if held is not None:
            yield done(*held, 1)

    return with_next(spark, rows).mapInArrow(compare, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def fingerprint_table(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every document."""
    ship(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, own in pieces(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes().hex() for r in fingerprints(own)], pa.string())], ["doc_id", "fingerprint"])

    return rows.mapInArrow(make, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def neighbours(queries: DataFrame, table: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct fingerprints of ``queries`` with all distinct ones of ``table`` within the radius: (query, fingerprint, apart).

    Equal fingerprints are one row, so a group of copies makes no pairs; members follow by a join on the fingerprint.
    """
    blocks = radius + SPARE
    borders = [round(k * BITS / 4 / blocks) for k in range(blocks + 1)]  # in hex digits
    choices = list(itertools.combinations(range(blocks), SPARE))
    half = lambda c, k: F.conv(F.substring(c, 1 + 8 * k, 8), 16, 10).cast("bigint")
    word = lambda c, k: F.shiftleft(half(c, 2 * k), 32).bitwiseOR(half(c, 2 * k + 1))

    def keyed(df: DataFrame, name: str) -> DataFrame:
        # a table's key is a hash of its number and its blocks; fingerprints travel as two numbers
        part = lambda b: F.substring("fingerprint", borders[b] + 1, borders[b + 1] - borders[b])
        keys = F.array(*[F.xxhash64(F.lit(t), *[part(b) for b in choice]) for t, choice in enumerate(choices)])
        return df.select("fingerprint").distinct().select(word("fingerprint", 0).alias(f"{name}0"), word("fingerprint", 1).alias(f"{name}1"), F.explode(keys).alias("key"))

    apart = F.bit_count(F.col("q0").bitwiseXOR(F.col("t0"))) + F.bit_count(F.col("q1").bitwiseXOR(F.col("t1")))
    pairs = keyed(queries, "q").join(keyed(table, "t"), "key").select("q0", "q1", "t0", "t1", apart.alias("apart")).where(F.col("apart") <= radius).distinct()
    shown = lambda *c: F.lower(F.concat(*[F.lpad(F.hex(x), 16, "0") for x in c]))
    return pairs.select(shown("q0", "q1").alias("query"), shown("t0", "t1").alias("fingerprint"), "apart")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compare_with_next(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = materialize(found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next"), "fingerprints")
    asks = F.coalesce(F.col("doc_id") % QUERY_EVERY == 0, F.lit(False))
    queries = found.where(asks)
    near = neighbours(queries, found).where("apart > 0").groupBy("query").agg(F.count("*").alias("near"))
    counted = queries.join(near, F.col("fingerprint") == F.col("query"), "left").withColumn("n_near", F.coalesce("near", F.lit(0)).cast("bigint")).drop("query", "near")
    return counted.unionAll(found.where(~asks).withColumn("n_near", F.lit(None).cast("bigint")))

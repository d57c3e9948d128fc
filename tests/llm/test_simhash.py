import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from causeway.llm import simhash
from causeway.llm.kernel import mix, salted, texts_of, words_of


def check(rows, got):
    order = sorted((i, t or "") for i, t in rows if i is not None)
    want = {}
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        want[i] = (len(t), hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest())
    assert {r.doc_id: (r.n_chars, hashlib.sha256(r.edited.encode()).hexdigest()) for r in got if r.doc_id is not None} == want


@pytest.mark.parametrize("stretch", [1, 3, 5000])
def test_edits_follow_the_order(spark, docs, monkeypatch, stretch):
    monkeypatch.setattr(simhash, "STRETCH_ROWS", stretch)
    random.seed(2)
    rows = [(k * 7, "".join(random.choice("ab é\U0001f600") for _ in range(random.randint(0, 40)))) for k in range(25)] + [(3, None), (4, ""), (5, "x" * 3_000_000)]
    random.shuffle(rows)
    got = simhash.compare_with_next(spark, docs(rows).repartition(5)).collect()
    assert len(got) == len(rows)
    check(rows, got)


def test_ties_nulls_and_singles(spark, docs):
    rows = [(1, "same words here"), (1, "same words here"), (None, "alone at last"), (2, "tail end")]
    got = simhash.compare_with_next(spark, docs(rows)).collect()
    assert len(got) == 4
    alone = next(r for r in got if r.doc_id is None)
    assert alone.near_next == 1 and alone.edited == "alone aalone "
    assert len({r.fingerprint for r in got if r.doc_id == 1}) == 1
    one = simhash.compare_with_next(spark, docs([(9, "abcd")])).first()
    assert one.edited == "abab"
    assert simhash.compare_with_next(spark, docs([])).count() == 0
    empty = simhash.compare_with_next(spark, docs([(1, None), (2, "")])).collect()
    assert {r.fingerprint for r in empty} == {"0" * 32}


def test_likeness_tells_edits_from_others(spark, sf_dir):
    got = simhash.op10_simhash(spark, sf_dir).collect()
    long = [r for r in got if r.n_chars > 500]
    assert sum(r.near_edited > r.near_next for r in long) > 0.9 * len(long)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    by_text = {}
    for r in got:
        assert by_text.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint


def plain_fingerprint(text):
    """Votes term by term over the words' own hashes."""
    words = words_of(texts_of(pa.array([text])))
    h = [int(x) for x in words.hashes]
    if not h:
        return "0" * 32
    terms = [(a * 0x9E3779B97F4A7C13 + b) % 2**64 for a, b in zip(h, h[1:], strict=False)]
    hashed = [int(mix(np.array([x], np.uint64))[0]) for x in terms] if terms else [int(salted(np.array(h, np.uint64), simhash.TERM)[0])]
    votes = [0] * 128
    for part in range(2):
        for x in hashed:
            raw = int(salted(np.array([x], np.uint64), part)[0]).to_bytes(8, "little")
            for b in range(64):
                votes[part * 64 + b] += 1 if raw[b // 8] >> (7 - b % 8) & 1 else -1
    return "%032x" % int("".join("1" if v > 0 else "0" for v in votes), 2)


def test_query_columns_against_brute_force(spark, sf_dir):
    texts = dict(sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()))
    got = {r.doc_id: r for r in simhash.op10_simhash(spark, sf_dir).collect()}
    assert got.keys() == texts.keys()
    ids = list(texts)
    prints = {i: got[i].fingerprint for i in ids}
    cosine = lambda a, b: max(0.0, math.cos(math.pi * bin(int(a, 16) ^ int(b, 16)).count("1") / 128))
    for k, i in enumerate(ids):
        following = ids[(k + 1) % len(ids)]
        if len(texts[i]) < 4000:
            assert prints[i] == plain_fingerprint(texts[i])
            edited = simhash.edit(texts[i], texts[following])
            assert got[i].edited_fingerprint == plain_fingerprint(edited)
        assert abs(got[i].near_edited - cosine(prints[i], got[i].edited_fingerprint)) < 1e-9
        assert abs(got[i].near_next - cosine(prints[i], prints[following])) < 1e-9
        near = {p for p in prints.values() if 0 < bin(int(p, 16) ^ int(prints[i], 16)).count("1") <= simhash.RADIUS}
        assert got[i].n_near == (len(near) if i % 20 == 0 else None)


def test_block_tables_find_all_neighbours(spark):
    random = np.random.default_rng(3)
    base = random.integers(0, 256, (40, 16)).astype(np.uint8)
    rows = [b.tobytes() for b in base]
    for b in base:
        for flips in (0, 1, 3, 4):
            bits = np.unpackbits(b)
            bits[random.choice(128, flips, replace=False)] ^= 1
            rows.append(np.packbits(bits).tobytes())
    rows = [r.hex() for r in rows]
    table = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "doc_id long, fingerprint string")
    queries = table.where("doc_id % 20 = 0")
    got = {(r["query"], r.fingerprint, r.apart) for r in simhash.neighbours(queries, table).collect()}
    apart = lambda a, b: bin(int(a, 16) ^ int(b, 16)).count("1")
    want = {(q, t, apart(q, t)) for q in set(rows[::20]) for t in set(rows) if apart(q, t) <= 3}
    assert got == want

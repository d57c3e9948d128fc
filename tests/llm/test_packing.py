import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from causeway.llm import packing


def check(rows, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = defaultdict(int)
    for i, t in texts:
        want[i, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0])] += 1
    parts, packs = defaultdict(list), defaultdict(list)
    for r in rows:
        parts[r.doc_id].append(r)
        packs[r.sequence_id].append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length and r.length > 0
    for pieces in packs.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    got = defaultdict(int)
    for i, pieces in parts.items():
        total = sum(p.length for p in pieces)
        copies = sum(n for (d, _), n in want.items() if d == i)
        by_start = sorted(pieces, key=lambda p: p.start)
        ids = b"".join(p.ids for p in by_start[::copies])
        assert total == copies * by_start[0].doc_tokens
        got[i, tuple(np.frombuffer(ids, "<u4").tolist())] += copies
    assert got == want
    return sum(max(o + n for o, n in p) for p in packs.values()) / (1024 * len(packs))


def test_round_trip(spark, docs):
    random.seed(5)
    texts = [(k, "word, é\n" * random.randint(0, 900)) for k in range(60)] + [(100, None), (101, ""), (102, "<|endoftext|>"), (7000, "same"), (7000, "same")]
    check(packing.pack(spark, docs(texts)).collect(), texts)
    assert packing.pack(spark, docs([])).count() == 0


def test_little_padding(spark, sf_dir):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert check(packing.pack(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).collect(), texts) > 0.9


def test_digest_query(spark, sf_dir):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        want.update({(r.doc_id, a): (min(1024, len(ids) - a), zlib.crc32(ids[a : a + 1024].tobytes()), len(ids)) for a in range(0, len(ids), 1024)})
    rows = packing.op3_packing(spark, sf_dir).collect()
    assert {(r.doc_id, r.start): (r.length, r.ids_crc32, r.doc_tokens) for r in rows} == want and len(rows) == len(want)


def test_special_tokens_are_the_tokenizers():
    assert packing.Encoder(packing.default_tokenizer())(["a <|endoftext|> b"])[0].tolist() == [64, 220, 50256, 275]


ODD_TEXT = st.text(st.sampled_from(list("ab1'! \n\t\u00a0\u0085\u2003\x1c\x1fé’s中🙂")), max_size=30)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(ODD_TEXT, st.text(max_size=20)), max_size=4))
def test_parts_give_the_ids_of_whole_texts(texts):
    encode = packing._encoder(packing.default_tokenizer())
    assert [ids.tolist() for ids in encode(texts)] == [encode.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_forgotten_parts_change_no_ids(monkeypatch):
    monkeypatch.setattr(packing, "MOST_PARTS", 50)
    encode = packing.Encoder(packing.default_tokenizer())
    random.seed(6)
    for _ in range(40):
        texts = [" ".join(random.choice(["often", "word%d" % random.randrange(500)]) for _ in range(20)) for _ in range(3)]
        assert [ids.tolist() for ids in encode(texts)] == [encode.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(encode.parts) < 150


def test_other_tokenizers_encode_whole_texts():
    encode = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["Some  Words here ", "", "a\nb"]
    assert not encode.by_part and [i.tolist() for i in encode(texts)] == [encode.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_long_texts(spark, docs):
    random.seed(1)
    texts = [(1, "x" * 300_000), (2, " ".join(str(random.random()) for _ in range(100_000)))]
    check(packing.pack(spark, docs(texts)).collect(), texts)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 200), max_size=20))
def test_patterns_cover_the_histogram(histogram):
    used = defaultdict(int)
    for pattern, count in packing.shortest_pack_first(histogram, 64):
        assert sum(pattern) <= 64 and count > 0
        for length in pattern:
            used[length] += count
    assert used == {k: n for k, n in histogram.items() if n}


@pytest.mark.parametrize("histogram, packs", [({64: 3}, 3), ({20: 7}, 3), ({40: 2, 24: 2}, 2), ({40: 1, 10: 2}, 1)])
def test_pack_counts(histogram, packs):
    assert sum(n for _, n in packing.shortest_pack_first(histogram, 64)) == packs


def test_parts_forgotten_between_texts_change_no_ids(monkeypatch):
    from causeway.llm import packing

    monkeypatch.setattr(packing, "MOST_PARTS", 8)
    monkeypatch.setattr(packing, "MOST_HELD", 200)
    encode = packing.Encoder(packing.default_tokenizer())
    texts = ["a b c d e f g h i j", "a  b", "x \n y", " a", "a ", "", "é " * 5 + "z" * 300, "b c d", "y " + "z" * 300, "q \x1c r", "k l m n o p"] * 2
    for text in texts:
        assert encode([text])[0].tolist() == encode.whole(text).tolist()
        encode.rest()
        assert len(encode.parts) <= 8

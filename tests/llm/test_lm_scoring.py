import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from causeway.llm import lbl
from causeway.llm.kernel import texts_of, words_of

TEXTS = [(1, "The cat sat on the mat"), (2, None), (3, ""), (4, "the CAT\tran\x0bfast é É"), (5, "the cat sat on the mat"), (5, "the cat sat on the mat"), (None, "odd one"), (9, "x" * 5000 + " the")]


def brute(rows, learned):
    counts = Counter()
    for t in learned:
        counts.update((t or "").encode().lower().split() + [0])
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        w = (t or "").encode().lower().split() + [0]
        out.append((i, len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)))
    return sorted(out, key=str)


def test_counts_against_brute_force(spark, docs, monkeypatch):
    learned = [t for i, t in TEXTS if i != 9]
    for table in (lbl.TABLE_WORDS, 2):  # the second sends nearly all words through the join
        got = lbl.score(spark, docs(TEXTS), docs(TEXTS).where("doc_id IS NULL OR doc_id <> 9"), vocabulary=6, dimension=4, table_words=table).collect()
        assert sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == brute(TEXTS, learned)
        assert all(r.score < 0 for r in got)


def test_nothing_to_learn_and_no_documents(spark, docs):
    got = lbl.score(spark, docs(TEXTS[:3]), docs(TEXTS[:0])).collect()
    assert {(r.doc_id, r.n_known, r.base_score) for r in got} == {(1, 0, 0.0), (2, 0, 0.0), (3, 0, 0.0)}
    assert lbl.score(spark, docs(TEXTS[:0]), docs(TEXTS)).count() == 0


def test_probabilities_sum_to_one_and_beat_the_unigram():
    random.seed(2)
    pairs = {"a": "b", "b": "c", "c": "a"}
    word, stream = "a", []
    for _ in range(30000):
        stream.append(word)
        word = pairs[word] if random.random() < 0.9 else random.choice("abcd")
        word = word if word in pairs else "a"
    words = words_of(texts_of(pa.array([" ".join(stream)])))
    hashes, counts = np.unique(words.hashes, return_counts=True)
    table = lbl.WordTable(hashes, counts, 1, len(stream) + 1, len(hashes) + 1, 8)
    ids = lbl._token_ids(words.hashes, words.bounds, table.ids_of(words.hashes))
    model = lbl.Model(table.size, 8, table.id_counts)
    unigram = np.log(model.noise)[ids[0]].mean()
    model.begin(0)
    for _ in range(3):
        model.train(*ids)
    near, far, z = model.tables()
    whole = np.exp(near[:, None, :] + far[None, :, :] - z[:, :, None]).sum(axis=2)
    assert np.allclose(whole, 1, atol=1e-4)
    one, two = np.roll(ids[0], 1), np.roll(ids[0], 2)
    assert (near[one, ids[0]] + far[two, ids[0]] - z[one, two]).mean() > unigram + 0.3


def test_query(spark, sf_dir):
    rows = lbl.op1_lm_scoring(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = {r.doc_id: r for r in rows}
    learned = [t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    want = {b[0]: b for b in brute(texts.items(), learned)}
    assert len(rows) == len(texts) and all((r.n_tokens, r.n_known, r.train_tokens) == want[i][1:4] and abs(r.base_score - want[i][4]) < 1e-4 for i, r in out.items())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 7 == 2) for i, r in out.items())


def plain_scores(rows, learned, vocabulary, dimension, rounds, shard_tokens, spark):
    """The score column from the trained parameters, word by word."""
    texts = spark.createDataFrame(learned, "doc_id long, text string").fillna({"text": ""})
    words = lambda t: [x.decode(errors="replace") for x in (t or "").encode().lower().split()]
    counts = Counter(w for _, t in learned for w in words(t))
    code = {w: int(words_of(texts_of(pa.array([w]))).hashes[0]) for w in {*counts, *(x for _, t in rows for x in words(t))}}
    hashes = np.array(sorted(code[w] for w in counts), np.uint64)
    by_code = {code[w]: n for w, n in counts.items()}
    n_tokens = sum(counts.values()) + len(learned)
    table = lbl.WordTable(hashes, np.array([by_code[int(h)] for h in hashes]), len(learned), n_tokens, len(counts) + 1, vocabulary)
    model = lbl.train(spark, texts, table, dimension, rounds, shard_tokens)
    ident = {int(h): int(k) for h, k in zip(hashes, table.ids, strict=True)}
    members = Counter(ident[code[w]] for w in counts)
    mass = Counter()
    for w, n in counts.items():
        mass[ident[code[w]]] += n
    alone = {k for k in range(1, table.size) if k == lbl.END or members[k] == 1 and table.own[k]}
    out = []
    for i, t in rows:
        total, one, two = 0.0, lbl.END, lbl.END
        for w in [*words(t), None]:
            k = lbl.END if w is None else ident.get(code[w], lbl.OTHER)
            h = model.inputs[one] * model.near + model.inputs[two] * model.far
            s = (model.outputs @ h + model.bias).astype(np.float64)
            total += (s[k] - np.log(np.exp(s - s.max()).sum()) - s.max()) / math.log(10)
            if k not in alone:
                total += math.log10((counts[w] + 1) / (mass[k] + members[k] + (k == lbl.OTHER)))
            one, two = k, one
        out.append((i, total))
    return out


def test_scores_against_plain_numpy(spark, docs):
    random.seed(9)
    learned = [(i, " ".join(random.choice(["the", "a", "cat", "dog", "w%d" % random.randrange(60)]) for _ in range(random.randrange(80)))) for i in range(40)]
    rows = learned[:5] + [(100, "the unseen cat w1"), (101, None), (102, "The A")]
    kinds = dict(vocabulary=20, dimension=4, rounds=2, shard_tokens=600)
    got = {r.doc_id: r.score for r in lbl.score(spark, docs(rows), docs(learned), **kinds).collect()}
    want = dict(plain_scores(rows, learned, *kinds.values(), spark))
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-3 * max(1, abs(want[i])) for i in got)


def test_files_and_partitions_change_no_score(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    some = []
    for n in (1, 8, 200):
        dealt = docs.repartition(n)
        some.append({r.doc_id: r.score for r in lbl.score(spark, dealt, dealt, rounds=2, shard_tokens=20_000).collect()})
    assert all(abs(a - some[0][i]) < 1e-6 * abs(a) for other in some[1:] for i, a in other.items())


def test_equal_texts_in_many_rows(spark, docs):
    rows = [(i, "same words here") for i in range(300)] + [(i, None) for i in range(300, 600)] + [(7, "same words here")]
    got = lbl.score(spark, docs(rows), docs(rows), vocabulary=6, dimension=4).collect()
    assert len(got) == 601 and len({r.score for r in got}) == 2 and sum(r.doc_id == 7 for r in got) == 2

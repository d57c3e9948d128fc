import zlib

import numpy as np

from causeway.llm import language


def test_codewords_are_apart():
    for n in (2, 4, 5, 9, 30):
        code = language.codewords(n)
        gaps = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(gaps) >= (1 if n == 2 else 2 ** (n - 2) if n <= 5 else 3)
        assert (np.abs(code.sum(axis=0)) < n).all()


def test_held_out_accuracy_and_contract(spark, sf_dir):
    rows = {r.doc_id: r for r in language.op6_language_id(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(rows) == len(docs)
    held = [d for d in docs if rows[d.doc_id].held_out]
    assert all(rows[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 5 == 0) for d in docs)
    assert sum(rows[d.doc_id].lang_pred == d.lang for d in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_odd_rows(spark, docs):
    labelled = spark.createDataFrame([(k, t, lang) for k, (t, lang) in enumerate([("the cat is here and there", "en"), ("der Hund ist nicht hier", "de")] * 20)] + [(None, "x", "en"), (99, None, "fr"), (98, "y", None)], "doc_id long, text string, lang string")
    model = language.train(spark, labelled)
    assert model.languages == ["de", "en"]
    rows = [(1, None), (2, ""), (3, "123 !"), (4, "the cat"), (4, "the cat"), (None, "der Hund"), (5, "é")]
    got = sorted(((r.doc_id, r.lang_pred) for r in language.identify(spark, docs(rows), model).collect()), key=str)
    assert [x for x in got if x[0] != 5] == sorted([(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (None, "de")], key=str)
    assert {r.lang_pred for r in language.identify(spark, docs(rows), None).collect()} == {"und"}
    assert language.train(spark, labelled.where("lang = 'xx'")) is None
    assert language.identify(spark, docs([]), model).count() == 0


def test_rejects_leave(spark):
    rows = [(k, t, lang, "s", 1) for k, (t, lang) in enumerate([("the cat is here and there", "en"), ("der Hund ist nicht hier", "de")] * 20 + [("?!", "en"), (None, "en")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = language.keep_identified(spark, docs)
    assert kept.columns == docs.columns and kept.count() == 40


def test_many_languages_and_their_decoding(spark):
    import random

    random.seed(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    kinds = {"l%02d" % k: ["".join(random.choice(letters) for _ in range(5)) for _ in range(12)] for k in range(70)}
    rows = [(k * 40 + j, " ".join(random.choice(words) for _ in range(30)), name) for k, (name, words) in enumerate(kinds.items()) for j in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(spark, docs.where("doc_id % 3 <> 0"))
    assert model.languages == sorted(kinds)
    got = {r.doc_id: r for r in language.identify(spark, docs, model).collect()}
    held = [(i, name) for i, _, name in rows if i % 3 == 0]
    assert sum(got[i].lang_pred == name for i, name in held) >= 0.95 * len(held)
    for i, text, _ in rows[:40]:  # decoding by hand
        counts = np.zeros(language.BUCKETS)
        raw = np.frombuffer(text.encode(), np.uint8)
        values = [int(v) for v in language.BYTE_VALUES[raw]]
        for a, b, c in zip(values, values[1:], values[2:], strict=False):
            counts[(((a * int(language._STEP) + b) * int(language._STEP) + c) % 2**64) >> (64 - 11)] += 1
        x = np.sqrt(counts) / np.linalg.norm(np.sqrt(counts))
        f = x @ model.weights.astype(float) + model.bias
        loss = [sum(np.log1p(np.exp(-word[b] * f[b])) * model.trust[b] for b in range(len(f))) for word in model.code]
        assert got[i].lang_pred == model.languages[int(np.argmin(loss))]
        assert abs(got[i].score - 1 / sum(np.exp(min(loss) - v) for v in loss)) < 1e-3


def test_repeated_labelled_rows_and_clashing_names(spark):
    rows = [(1, "the cat is here", "en")] * 20_000 + [(k, "der Hund ist nicht hier", "de") for k in range(2, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1.5 AS score", "'x' AS lang_pred", "true AS ambiguous", "2 AS draw", "3 AS share")
    assert language.train(spark, docs).languages == ["de", "en"]
    kept = language.keep_identified(spark, docs)
    assert kept.columns == docs.columns and kept.count() == docs.count() and kept.where("score <> 1.5 OR lang_pred <> 'x'").isEmpty()

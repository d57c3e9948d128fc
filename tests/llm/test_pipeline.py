from collections import defaultdict

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from causeway.llm import decontaminate


def test_stages_and_their_decisions(spark, sf_dir):
    from test_decontaminate import words
    from test_near_dedup import shingle_set
    from test_secret_scan import brute

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables, columns = {"input": docs.collect()}, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir), name)
        tables[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    ids = {k: {r.doc_id for r in v} for k, v in tables.items() if k != "packing"}
    assert ids["language_id"] <= ids["input"] and len(ids["language_id"]) >= 0.95 * len(ids["input"])
    texts = {r.doc_id: r.text for r in tables["input"]}
    sets = {i: shingle_set(texts[i], 5) for i in ids["language_id"]}
    alike = lambda a, b: bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b)
    for i in ids["language_id"] - ids["near_dedup"]:  # what goes is like something; groups are chains of links
        assert any(alike(sets[i], s) for j, s in sets.items() if j != i)
    kept = sorted(ids["near_dedup"])
    assert not any(alike(sets[i], sets[j]) for n, i in enumerate(kept) for j in kept[:n])
    windows = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(x) for x in windows}
    leaks = lambda t: any(tuple(t[k : k + n]) in windows for n in sizes for k in range(len(t) - n + 1))
    assert ids["decontamination"] == {i for i in ids["near_dedup"] if not leaks(words(texts[i]))}
    assert ids["secrets"] == ids["decontamination"]
    assert all((r.text == texts[r.doc_id]) == (not brute(texts[r.doc_id]) and "ghp_" not in texts[r.doc_id]) or "BEGIN" in texts[r.doc_id] or "xox" in texts[r.doc_id] for r in tables["secrets"])
    assert not any(brute(r.text) for r in tables["secrets"])
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total = defaultdict(int)
    for r in tables["packing"]:
        total[r.doc_id] += r.length
    assert total == {r.doc_id: len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in tables["secrets"]}


def test_run_is_the_stages(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "start", "length", "doc_tokens", "ids", "ids_crc32", "sequence_id", "offset"] and out.count() > 0
    assert corpus_pipeline.ORACLE_SQL is None and decontaminate.WINDOW == 10


NAMES = "kept kept_id secrets redacted score lang_pred ambiguous shard start length ids sequence_id offset node n_hit items"


def test_stages_on_odd_tables(spark, sf_dir, tmp_path):
    """Empty tables, nulls, repeated rows, ties and columns with the stages' own names."""
    plain = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = plain.where("doc_id < 60")
    odd = odd.unionAll(odd.where("doc_id < 5")).unionAll(odd.where("doc_id = 7").selectExpr("CAST(NULL AS bigint) AS doc_id", *plain.columns[1:])).unionAll(odd.where("doc_id = 8").selectExpr("doc_id", "CAST(NULL AS string) AS text", *plain.columns[2:]))
    for docs in (plain.limit(0), odd.selectExpr("*", *[f"'x' AS {n}" for n in NAMES.split()])):
        count = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs, corpus_pipeline.materialize(stage(spark, docs, sf_dir), name)
            if name != "packing":
                assert docs.columns == before.columns and docs.count() <= before.count()
                assert docs.columns[-1] != "items" or docs.where("kept <> 'x' OR secrets <> 'x'").isEmpty()
        assert (docs.count() > 0) == (count > 0)

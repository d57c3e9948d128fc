"""Operator 13 against brute force: all pairs of words by a plain edit distance."""

import random
import re
import zlib
from collections import Counter

import pytest
from oracle import assert_same, connect
from pyspark.sql import functions as F

from causeway.llm import spelling


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def brute(counts, times=spelling.TIMES):
    out, form = {}, {}
    for w, n in counts.items():
        near = [v for v in counts if one_edit(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= times * n else None
        out[w] = (n, len(near), form[w], counts[form[w]] if form[w] else None)
    def root(w):
        while form[w]:
            w = form[w]
        return w
    return sorted((w, *v, root(w)) for w, v in out.items())


def words_of(rows, one_in=199):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % one_in == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


@pytest.mark.parametrize(("letters", "seed"), [("ab", 1), ("abc", 2), ("aé÷", 3), ("abcdefghij", 4)])
def test_equals_brute_force(spark, letters, seed):
    """Few letters repeat bigrams within a word, where the order of places decides."""
    draw = random.Random(seed)
    counts = {"".join(draw.choice(letters) for _ in range(draw.randint(6, 10))): draw.choice([5, 6, 30, 31, 160, 900]) for _ in range(260)}
    counts |= {"a" * k: 5 * 6**k for k in range(6, 12)} | {"a" * 200: 9, "a" * 199 + "b": 45}
    for w in list(counts)[:60]:
        k = draw.randrange(len(w))
        counts.setdefault(w[:k] + draw.choice(letters) + w[k:], 7)
    got = spelling.group_variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    assert sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in got) == brute(counts)


def test_counting_words(spark, docs, tmp_path):
    base = [(k, f"Committee committée COMMITTEE comittee Ärgernis ärgernis x1colour_behaviour behavior{'s' * (k % 2)} abcde") for k in range(40)]
    rows = [*base, base[0], base[0], (None, "Committee no-id behaviour"), (7, None), (8, ""), (9, "ÀÁÂÃÄÅ " * 6), (10, "z" * 50_000 + " " + "z" * 50_000)]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    for one_in in (199, 3):
        found = spelling.runs(docs(rows))
        words = spelling.counted(found.select(spelling.misspelt(F.col("doc_id"), F.col("run"), one_in).alias("word")))
        assert {r.word: r.n for r in words.collect()} == words_of(rows, one_in)
    got = spelling.op13_spelling(spark, str(tmp_path)).collect()
    assert sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in got) == brute(words_of(rows))


def test_chain_of_forms_and_ties(spark):
    counts = {"aaaaaaa": 5, "aaaaaab": 25, "aaaaabb": 125, "aaaabbb": 625, "zzzzzz": 100, "zzzzza": 20, "zzzzzzb": 100, "lonely": 9}
    got = {r.word: r for r in spelling.group_variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert got["aaaaaaa"].root == "aaaabbb" and got["aaaaaaa"].form == "aaaaaab" and got["zzzzza"].form == "zzzzzz"
    assert (got["lonely"].form, got["lonely"].root, got["lonely"].n_near) == (None, "lonely", 0)


def test_empty_table_and_short_words(spark, docs):
    assert spelling.runs(docs([]).limit(0)).count() == 0
    assert spelling.group_variants(spark.createDataFrame([], "word string, n long")).count() == 0
    with pytest.raises(ValueError):
        spelling.group_variants(spark.createDataFrame([], "word string, n long"), least_chars=3)


def test_query(spark, sf_dir):
    assert_same(spelling.op13_spelling(spark, sf_dir), connect(sf_dir), spelling.ORACLE)

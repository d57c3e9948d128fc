import random

import numpy as np
from oracle import assert_same, connect

from causeway.llm import near_dedup
from causeway.operators import components


def shingle_set(text, size):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute(rows, size):
    """Component ids by comparing all pairs, per row."""
    sets = [shingle_set(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None and sets[i]:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def make(seed):
    random.seed(seed)
    words = [f"w{k}" for k in range(400)]
    rows, n = [], 0
    for _ in range(12):
        base = [random.choice(words) for _ in range(random.randint(1, 120))]
        for _ in range(random.randint(1, 9)):
            text = list(base)
            for _ in range(random.randint(0, 3)):
                text[random.randrange(len(text))] = random.choice(words)
            rows.append((n, " ".join(text)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " "), (n + 3, "One"), (n + 4, "one"), (n + 4, "one"), (None, "one"), (None, None)]
    random.shuffle(rows)
    return rows


def test_against_brute_force(spark, docs):
    for seed in (1, 2):
        rows = make(seed)
        got = near_dedup.near_duplicates(spark, docs(rows), shingle=4).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, 4)


def test_one_of_each_group_stays(spark, docs):
    rows = [(1, "a b c d e f g"), (2, "A b c d e f g"), (2, "A b c d e f g"), (3, "z y x"), (3, "z y x"), (4, None), (5, ""), (6, "other words here now ok")]
    kept = near_dedup.deduplicate(spark, docs(rows))
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(i for i, _ in got) == [1, 3, 4, 5, 6] and set(got) <= set(rows)
    assert kept.columns == docs(rows).columns
    assert near_dedup.near_duplicates(spark, docs([])).count() == 0


def test_large_group_of_near_copies(spark, docs):
    random.seed(9)
    base = [f"w{k}" for k in range(100)]
    rows = []
    for k in range(400):
        text = list(base)
        for j in range(2):
            text[random.randrange(100)] = f"x{k}_{j}"
        rows.append((k, " ".join(text)))
    got = near_dedup.near_duplicates(spark, docs(rows), shingle=4).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, 4)


def test_sketches_estimate_similarity():
    random = np.random.default_rng(0)
    common, a, b = (random.integers(1, 1 << 63, n, dtype=np.uint64) for n in (600, 200, 200))
    sets = [np.unique(np.concatenate([common, x])) for x in (a, b)] + [common[:1]]
    owner = np.repeat([0, 1, 2], [len(s) for s in sets])
    sketch = near_dedup.fill_sketches(owner, np.concatenate(sets), 3, 120)
    assert (sketch != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    assert abs((sketch[0] == sketch[1]).mean() - 0.6) < 0.15


def test_overlaps_in_parts(monkeypatch):
    monkeypatch.setattr(near_dedup, "COLUMNS", 50)
    random = np.random.default_rng(1)
    sets = [np.unique(random.integers(0, 300, random.integers(1, 200)).astype(np.uint64)) for _ in range(40)]
    left = np.arange(40) % 2 == 0
    want = [[len(np.intersect1d(a, b)) for b, y in zip(sets, left) if not y] for a, x in zip(sets, left) if x]
    assert (near_dedup.overlaps(sets, left, ~left) == want).all()


def test_components(spark, monkeypatch):
    monkeypatch.setattr(components, "HELD_EDGES", 3)
    edges = [(k, k + 1) for k in range(60)] + [(100 + k, 200) for k in range(30)] + [(300, 301), (301, 300)]
    random.seed(1)
    random.shuffle(edges)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()}
    assert {n for n, r in got.items() if r == 0} == set(range(61))
    assert {n for n, r in got.items() if r == 100} == {*range(100, 130), 200} and got[301] == 300


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = near_dedup.op4_near_dedup(spark, sf_dir).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, 4)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert_same(near_dedup.op4_near_dedup(spark, sf_dir), connect(sf_dir), near_dedup.ORACLE)


def test_clashing_names(spark):
    rows = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (None, "z")], "doc_id long, text string").selectExpr("*", "1 AS kept", "2 AS kept_id", "3 AS kept_key", "4 AS kept_again", "5 AS bucket", "6 AS comp", "7 AS text_key")
    kept = near_dedup.deduplicate(spark, rows)
    assert kept.columns == rows.columns and sorted((r.doc_id, r.kept_id) for r in kept.collect() if r.doc_id) == [(1, 2)] and kept.count() == 2


def test_very_long_texts(spark, docs):
    random.seed(3)
    long = ["u%d" % random.randrange(10**8) for _ in range(250_000)]
    other = list(long)
    other[1000:5000] = ["changed"] * 4000
    rows = [(1, " ".join(long)), (2, " ".join(other)), (3, " ".join(reversed(long)))]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark, docs(rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3}

"""Operator 13, spelling variants: words one edit apart, each led to the more frequent form it stands for.

Rare-first prefix filter: bigrams are ordered by the number of words that have them, rarest first, and a word is joined by its
three rarest bigrams alone. One edit destroys at most two bigrams of a word, so of the three first ones of two near words some
bigram is common to both; it stands at the same place in words of equal length, and at the same or the next place in a
word longer by one. Place and length are therefore part of the join key, and the join's condition confirms the edit distance, so
only near words leave it. Among equal bigrams the first places come first, which the argument needs where a bigram repeats.

Defined results: null texts have no words; a word has at least ``LEAST_CHARS`` code points and ``LEAST_COUNT`` occurrences; of near
words with equal counts the first in code-point order is the form; a word without near words has none and is its own root; repeated
rows count as often as they stand; no words give an empty table; columns of the input other than id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.storage import materialize

#: Letters of a word, as a class of a regular expression.
LETTERS = r"A-Za-zÀ-ÿ"
LEAST_CHARS = 6
LEAST_COUNT = 5
#: A form is at least this many times as frequent as its variant.
TIMES = 5
#: Bigrams of a word that the join uses: one more than an edit destroys.
PREFIX = 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, run) for each maximal run of letters of at least ``least_chars``, with A-Z lower-cased."""
    found = F.regexp_extract_all(F.translate(F.col(text_col).cast("string"), _UPPER, _LOWER), F.lit(f"[{LETTERS}]{{{least_chars},}}"), F.lit(0))
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(found).alias("run"))


def misspelt(key: Column, run: Column, one_in: int) -> Column:
    """``run``, or without one of its code points where ``one_in`` divides the checksum of key and run."""
    h = F.crc32(F.encode(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), run), "UTF-8"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def counted(words: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of ``words`` (word), counted within tasks first."""
    return words.where(F.char_length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def rare_bigrams(words: DataFrame) -> DataFrame:
    """``words`` (word, n) by their first bigrams in the global order: (word, n, size, gram, place)."""
    size = F.char_length("word")
    grams = F.transform(F.sequence(F.lit(1), size - 1), lambda p: F.struct(F.substr("word", p, F.lit(2)).alias("gram"), p.alias("place")))
    placed = words.select("word", "n", F.explode(grams).alias("g")).select("word", "n", "g.gram", "g.place")
    # a table by itself, so its size is known where it is joined: with these letters, at most 90 * 90 rows
    held = materialize(placed.groupBy("gram").agg(F.countDistinct("word").alias("held")), "bigrams")
    first = F.slice(F.array_sort(F.collect_list(F.struct("held", "gram", "place"))), 1, PREFIX)
    ordered = placed.join(held, "gram").groupBy("word", "n").agg(first.alias("first"))
    return ordered.select("word", "n", size.alias("size"), F.explode("first").alias("g")).select("word", "n", "size", "g.gram", "g.place")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): every two of ``words`` (word, n) that differ by exactly one edit, once; b is longer, or follows a."""
    rare = materialize(rare_bigrams(words), "rare")
    left = rare.select(F.col("word").alias("a"), F.col("n").alias("n_a"), "gram", "place", "size")
    at = lambda place, size, longer: F.struct(place.alias("place"), size.alias("size"), F.lit(longer).alias("longer"))
    place, size = F.col("place"), F.col("size")
    right = rare.select(F.col("word").alias("b"), F.col("n").alias("n_b"), "gram", F.explode(F.array(at(place, size, False), at(place, size - 1, True), at(place - 1, size - 1, True))).alias("k"))
    right = right.select("b", "n_b", F.col("gram").alias("gram_b"), F.col("k.place").alias("place_b"), F.col("k.size").alias("size_b"), "k.longer")
    same = (F.col("gram") == F.col("gram_b")) & (F.col("place") == F.col("place_b")) & (F.col("size") == F.col("size_b"))
    near = (F.col("longer") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1)
    return left.join(right, same & near).select("a", "n_a", "b", "n_b").distinct()


def with_roots(forms: DataFrame) -> DataFrame:
    """``forms`` (word, form) with ``root``, the last of the forms that follow one another.

    A form is more frequent than its word, so chains end; each round doubles what is followed.
    """
    current = materialize(forms.select("word", "form", F.col("form").alias("root")), "roots")
    while True:
        ahead = current.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = materialize(current.join(ahead, "root", "left").select("word", "form", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        current = joined.drop("moved")
        if joined.where("moved").isEmpty():
            return current


def group_variants(words: DataFrame, times: int = TIMES, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of the distinct ``words`` (word, n), all of at least ``least_chars`` code points."""
    if least_chars <= PREFIX:
        raise ValueError(f"words of fewer than {PREFIX + 1} code points have too few bigrams")
    words = materialize(words.select("word", "n"), "words")
    pairs = near_pairs(words)
    way = lambda x, y: F.struct(F.col(x).alias("word"), F.col(y).alias("near"), F.col(f"n_{y}").alias("n_of"))
    ways = pairs.select(F.explode(F.array(way("a", "b"), way("b", "a"))).alias("w")).select("w.*")
    best = ways.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_of")).alias("less"), F.col("near"))).alias("best"))
    leads = -F.col("best.less") >= times * F.col("n")
    found = materialize(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(leads, F.col("best.near")).alias("form"), F.when(leads, -F.col("best.less")).alias("form_n")), "forms")
    roots = with_roots(found.where("form IS NOT NULL").select("word", "form")).select("word", "root")
    return found.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    words = counted(found.select(misspelt(F.col("doc_id"), F.col("run"), 199).alias("word")))
    return group_variants(words).select("word", "form", "root", "n", "n_near", "form_n")


#: Checksums by the polynomial, near words by deletions: of either of two words, or of the same place in both.
ORACLE = r"""
WITH RECURSIVE t AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) ORDER BY i) AS t FROM range(256) r(i)),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
g AS (SELECT doc_id, run, count(*) AS n FROM r GROUP BY doc_id, run),
b AS (SELECT run, n, regexp_extract_all(hex(encode(doc_id || ':' || run)), '..') AS bytes FROM g WHERE length(run) >= 6),
h AS (SELECT run, n, xor(list_reduce(bytes, lambda c, x: xor(c // 256, t.t[1 + xor(c % 256, x)]), CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM
      (SELECT run, n, list_transform(bytes, lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM b), t),
m AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM m WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
d AS (SELECT word, n, k, substr(word, 1, k - 1) || substr(word, k + 1) AS part FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM w)),
p AS (SELECT a.word, b.word AS near, b.n AS n_of FROM d a JOIN d b ON a.part = b.part AND a.k = b.k AND a.word <> b.word
      UNION SELECT a.word, b.word, b.n FROM d a JOIN w b ON a.part = b.word UNION SELECT a.word, b.word, b.n FROM w a JOIN d b ON b.part = a.word),
s AS (SELECT word, count(*) AS n_near, min({'less': -n_of, 'near': near}) AS best FROM p GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 5 * w.n THEN best.near END AS form, CASE WHEN -best.less >= 5 * w.n THEN -best.less END AS form_n FROM w LEFT JOIN s USING (word)),
c(word, root, depth) AS (SELECT word, word, 0 FROM f UNION ALL SELECT c.word, f.form, depth + 1 FROM c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, form, (SELECT max_by(root, depth) FROM c WHERE c.word = f.word) AS root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM f
"""

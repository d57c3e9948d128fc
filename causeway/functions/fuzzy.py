"""Fuzzy name ratios, and matching of names by a join on their rarest grams.

The ratios are the published ones on a scale of 100: ``ratio`` is twice the longest common subsequence over both lengths, the token
ratios compare sorted words and sets of words, the weighted ratio takes the best of them with weights that fall where lengths differ
much. Words are what blanks separate; callers lower-case and clean names as they need.

Names are never compared with a whole vocabulary. Grams are pairs of neighbouring letters inside a word, and words of one letter, which
are sought among all letters of the other side. One edit destroys two grams at most, so two names within a cutoff have a gram in common among the first ``3 * (1 - cutoff) * length + 1``
rarest of one of them: these are joined with all grams of the other side, and what shares one is scored. A name of fewer grams than
that is joined by its letters as well, of which names within a cutoff share one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.operators.storage import materialize
from causeway.plans.shipping import ship

#: The weighted ratio's weights: of sorted and set ratios, of windows, and of windows where one name is more than eight times as long.
TOKENS, WINDOWS, FAR_WINDOWS = 0.95, 0.9, 0.6


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence: a row of the table is the bits of one number."""
    at: dict[str, int] = {}
    for k, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << k
    whole = (1 << len(a)) - 1
    row = whole
    for x in b:
        hit = row & at.get(x, 0)
        row = ((row + hit) | (row - hit)) & whole
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    return 200.0 * common(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_sort_ratio(a: str, b: str) -> float:
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """Best ratio among the common words and the common words with each side's rest; a subset scores 100."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    shared, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if shared and (not left or not right):
        return 100.0
    with_left, with_right = (f"{shared} {s}".strip() for s in (left, right))
    scores = [indel_ratio(with_left, with_right)]
    if shared:
        scores += [indel_ratio(shared, with_left), indel_ratio(shared, with_right)]
    return max(scores)


def partial_ratio(a: str, b: str) -> float:
    """The shorter text against its best window of the longer, windows cut off at either end included."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long else 0.0
    sides = ((short, long), (long, short)) if len(a) == len(b) else ((short, long),)
    return max(indel_ratio(x, y[max(0, k) : k + len(x)]) for x, y in sides for k in range(1 - len(x), len(y)))


def partial_token_ratio(a: str, b: str) -> float:
    """Windows of sorted words, and of the words that are not common; a common word alone scores 100."""
    x, y = set(a.split()), set(b.split())
    if x & y:
        return 100.0
    return max(partial_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), partial_ratio(" ".join(sorted(x - y)), " ".join(sorted(y - x))))


def weighted_ratio(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    best = indel_ratio(a, b)
    apart = max(len(a), len(b)) / min(len(a), len(b))
    if apart < 1.5:
        return max(best, TOKENS * max(token_sort_ratio(a, b), token_set_ratio(a, b)))
    scale = WINDOWS if apart <= 8 else FAR_WINDOWS
    return max(best, scale * partial_ratio(a, b), TOKENS * scale * partial_token_ratio(a, b))


RATIOS = {"weighted": weighted_ratio, "token_set": token_set_ratio}
#: Below these cutoffs names may match that share no gram of those joined.
LEAST_CUTOFF = {"weighted": 100 * TOKENS * WINDOWS, "token_set": 200 / 3}


def grams(name: Column) -> Column:
    """Distinct pairs of neighbouring letters inside the words of a name, and its words of one letter."""
    words = F.array_distinct(F.filter(F.split(name, r"\s+"), lambda w: w != ""))
    pairs = lambda w: F.when(F.char_length(w) == 1, F.array(w)).otherwise(F.transform(F.sequence(F.lit(1), F.char_length(w) - 1), lambda k: F.substr(w, k, F.lit(2))))
    return F.array_distinct(F.flatten(F.transform(words, pairs)))


def candidates(left: DataFrame, right: DataFrame, within: list[str], cutoff: float) -> DataFrame:
    """(within, a, b): distinct names of ``left`` and ``right`` (within, name) that may reach the cutoff and share ``within``."""
    share = 3 * (1 - cutoff / 100)
    sides = {}
    for side, df in (("a", left), ("b", right)):
        named = df.select(*within, "name").where("trim(name) <> ''").distinct().withColumn("own", grams(F.col("name")))
        letters = F.array_except(F.array_distinct(F.split("name", "")), F.array_union("own", F.array(F.lit(" "), F.lit(""))))
        marked = lambda grams_, own: F.transform(grams_, lambda g: F.struct(g.alias("gram"), F.lit(own).alias("own")))
        sides[side] = materialize(named.select(*within, "name", F.explode(F.concat(marked("own", True), marked(letters, False))).alias("g")).select(*within, "name", "g.gram", "g.own"), "grams")
    # how many names have a gram, in either table: rare grams come first, so common ones join little
    held = materialize(sides["a"].select("gram").unionAll(sides["b"].select("gram")).groupBy("gram").agg(F.count("*").alias("held")), "held")

    def first(side: str) -> DataFrame:
        ordered = sides[side].join(held, "gram").groupBy(*within, "name").agg(F.array_sort(F.collect_list(F.struct("held", "gram", "own"))).alias("g"))
        n = F.floor(F.lit(share) * F.char_length("name")).cast("int") + 1
        own = F.filter("g", lambda g: g["own"])
        chosen = F.when(F.size(own) >= n, F.slice(own, F.lit(1), n)).otherwise(F.col("g"))
        return ordered.select(*within, "name", F.explode(chosen).alias("g")).select(*within, "name", "g.gram")

    keys = [*within, "gram"]
    one = first("a").withColumnRenamed("name", "a").join(sides["b"].withColumnRenamed("name", "b").drop("own"), keys).select(*within, "a", "b")
    two = first("b").withColumnRenamed("name", "b").join(sides["a"].withColumnRenamed("name", "a").drop("own"), keys).select(*within, "a", "b")
    return one.unionAll(two).distinct()


def scored(pairs: DataFrame, ratio: str, cutoff: float) -> DataFrame:
    """``pairs`` (..., a, b) of names with their ``score``, those below the cutoff left out."""
    ship(pairs.sparkSession)
    measure = RATIOS[ratio]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = pa.array([measure(x, y) for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, score], [*batch.schema.names, "score"]).filter(pc.greater_equal(score, cutoff))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)
    return pairs.mapInArrow(run, f"{kinds}, score double")


def best_matches(rows: DataFrame, column: str, vocabulary: DataFrame, ratio: str = "weighted", cutoff: float = 88.0) -> DataFrame:
    """``rows`` with (match, score): the code of the best name of ``vocabulary`` (name, code, pos) at or above the cutoff.

    Ties go to the first ``pos``, then the first code; null and empty names match nothing. Distinct names are matched once.
    """
    if cutoff <= LEAST_CUTOFF[ratio]:
        raise ValueError(f"the {ratio} ratio needs a cutoff above {LEAST_CUTOFF[ratio]:.1f}")
    asked = rows.select(F.col(column).alias("name"))
    pairs = scored(candidates(asked, vocabulary, [], cutoff), ratio, cutoff)
    terms = vocabulary.select(F.col("name").alias("b"), "code", "pos")
    best = pairs.join(terms, "b").groupBy("a").agg(F.min(F.struct((-F.col("score")).alias("less"), "pos", "code")).alias("best"))
    found = materialize(best.select(F.col("a").alias("_name"), F.col("best.code").alias("match"), (-F.col("best.less")).alias("score")), "matches")
    return rows.join(found, F.col(column) == F.col("_name"), "left").select(*[rows[c] for c in rows.columns], "match", "score")

"""Operator 11, fill-in-middle: texts rearranged so that a model learns to fill a gap, in Spark SQL functions alone.

``regexp_extract_all`` makes the array of units, words with the blanks before them; ``conv`` of groups of the hex digest of seed
and id gives the two cuts, the choice to rearrange and the order; ``slice`` and ``array_join`` build the three parts. The parts
stand after sentinels, so what lies between these gives the text back.

Defined results: a null text is empty; an empty text, or one that holds a sentinel already, is left plain whatever its digest; a
text of blanks is one unit; parts may be empty; a null id is hashed as nothing after the seed; equal rows have equal results;
texts of any length are cut whole (a row holds its units for the time of its projection); an empty table gives none. Columns of
any name stay where the operator adds to a table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLANKS = r"\x20\x09-\x0D"
#: Blanks before a word belong to it. The possessive quantifier gives nothing back, so a long run of blanks is read once.
UNIT = rf"[{BLANKS}]*+[^{BLANKS}]+|[{BLANKS}]+"


@dataclass(frozen=True)
class Settings:
    """How many of a hundred texts are rearranged, how many of those have the suffix first, and the sentinels."""

    seed: int = 42
    rearranged: int = 50
    suffix_first: int = 80
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        marks = (self.prefix, self.suffix, self.middle)
        joined = any(a[-k:] == b[:k] for a in marks for b in marks for k in range(1, min(len(a), len(b)) + (a != b)))
        if len(set(marks)) < 3 or "" in marks or joined or any(a in b for a in marks for b in marks if a != b):
            raise ValueError("sentinels must be three texts of which none holds or overlaps another")


def units(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))


def draws(key: Column, seed: int) -> list[Column]:
    """Four numbers below 2**32: the first groups of eight digits of the digest of ``seed:key``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(4)]


def restored(output: Column, form: Column, settings: Settings = Settings()) -> Column:  # noqa: B008
    """The text that was arranged: its parts are what stands after each sentinel, in the order that the form tells."""
    p, s, m = (re.escape(x) for x in (settings.prefix, settings.suffix, settings.middle))
    back = lambda pattern, order: F.regexp_replace(output, f"(?s)^{pattern}$", order)
    return F.when(form == "psm", back(f"{p}(.*?){s}(.*?){m}(.*)", "$1$3$2")).when(form == "spm", back(f"{s}(.*?){p}(.*?){m}(.*)", "$2$3$1")).otherwise(output)


def arrange(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row.

    Each step is a projection of its own: what a later one uses twice, the units above all, is computed once.
    """
    marks = (settings.prefix, settings.suffix, settings.middle)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    drawn = rows.select("doc_id", "text", units(F.col("text")).alias("units"), F.array(*draws(F.col("doc_id"), settings.seed)).alias("h"))
    h = lambda k: F.col("h")[k]
    held = F.lit(False)
    for m in marks:
        held = held | F.contains("text", F.lit(m))
    plain = (F.col("text") == "") | held | (h(2) % 100 >= settings.rearranged)
    n = F.size("units").cast("bigint")
    placed = drawn.select(
        "doc_id", "text", "units", n.alias("n"),
        F.when(plain, "plain").when(h(3) % 100 < settings.suffix_first, "spm").otherwise("psm").alias("form"),
        F.least(h(0) % (n + 1), h(1) % (n + 1)).cast("int").alias("a"), F.greatest(h(0) % (n + 1), h(1) % (n + 1)).cast("int").alias("b"),
    )
    joined = lambda start, length: F.when(F.col("form") != "plain", F.array_join(F.slice("units", start, length), ""))
    parts = placed.select(
        "doc_id", "text", "n", "form",
        joined(F.lit(1), F.col("a")).alias("prefix"), joined(F.col("a") + 1, F.col("b") - F.col("a")).alias("middle"), joined(F.col("b") + 1, F.size("units") - F.col("b")).alias("suffix"),
    )
    p, s, m = (F.lit(x) for x in marks)
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(p, "prefix", s, "suffix", m, "middle")).otherwise(F.concat(s, "suffix", p, "prefix", m, "middle"))
    chars = lambda c: F.char_length(c).cast("bigint").alias(f"{c}_chars")
    return parts.select("doc_id", "n", "form", chars("prefix"), chars("middle"), output.alias("output"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = Settings()
    done = arrange(spark.read.parquet(f"{sf_dir}/documents.parquet"), settings=settings)
    again = restored(F.col("output"), F.col("form"), settings)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
             list_transform(range(4), lambda k: CAST('0x' || substr(x, CAST(1 + 8 * k AS INT), 8) AS BIGINT)) AS h FROM d),
c AS (SELECT doc_id, t, w, len(w) AS n, least(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) AS a, greatest(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 50 THEN 'plain'
                  WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, t, n, form, array_to_string(list_slice(w, 1, a), '') AS pre, array_to_string(list_slice(w, a + 1, b), '') AS mid,
             array_to_string(list_slice(w, b + 1, n), '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""

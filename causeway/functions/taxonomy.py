"""Controlled vocabularies of the risk layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Outcome classes with their severities, in the order that breaks ties.
OUTCOMES = (
    ("loss-of-safety-function", 5),
    ("safety-system-inoperable", 4),
    ("reactor-trip-or-scram", 4),
    ("esf-actuation", 3),
    ("containment-isolation", 3),
    ("degraded-not-lost", 2),
    ("ts-violation-only", 2),
    ("other-or-no-safety-impact", 1),
)
# Cause codes and their categories.
CAUSE_CATEGORIES = {
    "A": "Personnel Error",
    "B": "Design/Manufacturing/Installation",
    "C": "External Cause",
    "D": "Defective Procedure",
    "E": "Management/QA Deficiency",
    "X": "Other",
    "TBD": "provisional",
}
# Words that name an outcome class in a phrase; the first class with a word in the phrase counts.
OUTCOME_WORDS = {
    "loss-of-safety-function": ("loss of safety", "loss of function", "both trains", "all trains"),
    "safety-system-inoperable": ("inoperable", "out of service", "single train"),
    "reactor-trip-or-scram": ("reactor trip", "scram", "rps", "trip"),
    "esf-actuation": ("esf", "eccs", "injection", "afw", "efw", "edg", "actuation", "start"),
    "containment-isolation": ("containment isolation", "pciv", "msiv", "isolation"),
    "degraded-not-lost": ("degraded", "non-conform", "nonconform"),
    "ts-violation-only": ("tech spec", "technical specification", "ts ", "lco", "surveillance"),
    "other-or-no-safety-impact": ("no safety impact", "administrative", "other"),
}
#: A classification below this confidence does not count; an entity with so few classified events is a small sample.
GATE = 0.60
SMALL_SAMPLE = 5
CANDIDATE_CAP = 8


def outcomes(spark: SparkSession) -> DataFrame:
    """(outcome, severity, idx), eight rows."""
    return spark.createDataFrame([(k, s, i) for i, (k, s) in enumerate(OUTCOMES)], "outcome string, severity int, idx int")


def severity(outcome: Column) -> Column:
    table = F.create_map(*[F.lit(x) for k, s in OUTCOMES for x in (k, s)])
    return table[outcome]


def weight(outcome: Column) -> Column:
    """Orders classes by severity, and within one severity by their order; larger is worse."""
    table = F.create_map(*[F.lit(x) for i, (k, s) in enumerate(OUTCOMES) for x in (k, s * 100 - i)])
    return table[outcome]


def outcome_phrase(phrase: Column) -> Column:
    """The class that a free phrase names, or null."""
    text = F.trim(F.lower(F.coalesce(phrase, F.lit(""))))
    out = F.when(text == "", None).when(text.isin([k for k, _ in OUTCOMES]), text)
    for name, words in OUTCOME_WORDS.items():
        hit = F.lit(False)
        for word in words:
            hit = hit | text.contains(word)
        out = out.when(hit, name)
    return out


SQL_VALUES = ", ".join(f"('{k}', {s}, {i})" for i, (k, s) in enumerate(OUTCOMES))
SQL_TAXONOMY = f"tax(outcome, severity, idx) AS (VALUES {SQL_VALUES})"

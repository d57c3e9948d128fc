"""Codes of systems, components and manufacturers: a code that was read, a known acronym, then the name.

The coded dimension has a few hundred rows, whatever the number of reports, so it is broadcast; names are matched by their rarest
grams, each distinct name once. Nodes need ``display_name`` and ``eiis_code`` (manufacturers ``code``); other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.functions import fuzzy, text
from causeway.sources.records import file_order

# Acronyms, names and codes met in reports and absent from the dimension.
SYSTEM_ACRONYMS = {"CS": "BM"}
SYSTEM_NAMES = {"core spray": "BM"}
UNCODED_SYSTEMS = {"ads": "Automatic Depressurization System", "automatic depressurization": "Automatic Depressurization System"}
UNCODED_WORD = "depressurization"
INFERRED_COMPONENTS = {r"(?i)primary containment isolation valve|pciv": "ISV", r"(?i)\bisolation valve\b": "ISV"}
MANUFACTURERS = {"C770": "Eaton / QualTech NP"}
#: Least score of a name.
CUTOFF = 88.0


def read_dimension(spark: SparkSession, path: str) -> DataFrame:
    """(kind, code, name, acronyms, pos) of the coded dimension, trimmed, in file order."""
    rows = spark.read.option("header", True).csv(path)
    known = F.filter(F.transform(F.split(F.coalesce("acronyms", F.lit("")), r"\|"), lambda a: F.upper(F.trim(a))), lambda a: a != "")
    return rows.select(F.trim("type").alias("kind"), F.trim("eiis_code").alias("code"), F.col("canonical_name").alias("name"), known.alias("acronyms"), file_order().alias("pos"))


def _named(values: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]


def _acronyms(dimension: DataFrame, kind: str) -> DataFrame:
    """(acronym, by_acronym): of several rows with an acronym the first one's code."""
    rows = dimension.where(F.col("kind") == kind).select("code", "pos", F.explode("acronyms").alias("acronym"))
    return rows.groupBy("acronym").agg(F.min_by("code", "pos").alias("by_acronym"))


def _prepared(nodes: DataFrame, dimension: DataFrame, kind: str) -> DataFrame:
    """Nodes with ``acronym``, ``code_read`` and ``by_acronym``."""
    read = F.nullif(F.upper(F.trim("eiis_code")), F.lit(""))
    rows = nodes.withColumns({"acronym": text.paren_acronym(F.col("display_name")), "code_read": read})
    return rows.join(F.broadcast(_acronyms(dimension, kind)), "acronym", "left")


def systems(nodes: DataFrame, dimension: DataFrame) -> DataFrame:
    """Nodes with ``eiis_code``, ``resolved_by`` (read, acronym, name or null), ``acronym`` and ``non_eiis``.

    A system without a code gets a name that is the same in all reports.
    """
    rows = _prepared(nodes, dimension, "system").withColumn("by_acronym", F.coalesce("by_acronym", _named(SYSTEM_ACRONYMS, F.col("acronym"))))
    name = text.norm_name(F.col("display_name"))
    rows = rows.withColumn("by_alias", _named(SYSTEM_NAMES, name))
    open_name = F.when(F.coalesce("code_read", "by_acronym", "by_alias").isNull(), name).otherwise("")
    names = dimension.where("kind = 'system'").select(text.norm_name(F.col("name")).alias("name"), "code", "pos")
    rows = fuzzy.best_matches(rows.withColumn("open_name", open_name), "open_name", names, cutoff=CUTOFF)
    by_name = F.coalesce("by_alias", "match")
    code = F.coalesce("code_read", "by_acronym", by_name)
    clean = F.trim(F.regexp_replace("display_name", r"\s*[({][^)}]*[)}]\s*", " "))
    stable = F.coalesce(_named(UNCODED_SYSTEMS, F.lower(clean)), _named(UNCODED_SYSTEMS, F.lower("acronym")), F.nullif(clean, F.lit("")), F.col("display_name"))
    how = F.when(F.col("code_read").isNotNull(), "read").when(F.col("by_acronym").isNotNull(), "acronym").when(by_name.isNotNull(), "name")
    found = rows.select("*", how.alias("resolved_by"), code.alias("resolved_code"), F.col("display_name").alias("read_name"), stable.alias("stable_name"))
    done = found.withColumns({"eiis_code": F.col("resolved_code"), "non_eiis": F.col("resolved_code").isNull(), "display_name": F.when(F.col("resolved_code").isNull(), F.col("stable_name")).otherwise(F.col("display_name"))})
    return done.drop("code_read", "by_acronym", "by_alias", "open_name", "match", "score", "resolved_code", "stable_name")


def learned_acronyms(resolved: DataFrame) -> DataFrame:
    """Distinct (acronym, eiis_code, resolved_from_name) of systems found by name beside an acronym the dimension lacks."""
    rows = resolved.where("resolved_by = 'name' AND acronym IS NOT NULL")
    return rows.select("acronym", "eiis_code", text.norm_name(F.col("read_name")).alias("resolved_from_name")).distinct()


def unknown_acronyms(resolved: DataFrame) -> DataFrame:
    """Distinct (acronym, display_name) of systems not found, but for those known to have no code."""
    rows = resolved.where(F.col("resolved_by").isNull() & F.col("acronym").isNotNull() & ~F.lower("read_name").contains(UNCODED_WORD))
    return rows.select("acronym", F.col("read_name").alias("display_name")).distinct()


def components(nodes: DataFrame, dimension: DataFrame) -> DataFrame:
    """Nodes with ``eiis_code`` and ``inferred_code``, true where the description alone gave the code."""
    rows = _prepared(nodes, dimension, "component")
    inferred = F.coalesce(*[F.when(F.col("display_name").rlike(p), code) for p, code in INFERRED_COMPONENTS.items()])
    known = F.coalesce("code_read", "by_acronym")
    return rows.withColumns({"inferred_code": known.isNull() & inferred.isNotNull(), "eiis_code": F.coalesce(known, inferred)}).drop("acronym", "code_read", "by_acronym")


def manufacturers(nodes: DataFrame) -> DataFrame:
    """Nodes with the name of a known code where they have none; ``unknown_code`` marks other codes without a name."""
    bare = F.coalesce("display_name", F.lit("")) == ""
    code = F.nullif(F.trim("code"), F.lit(""))
    name = _named(MANUFACTURERS, code)
    return nodes.withColumns({"unknown_code": bare & code.isNotNull() & name.isNull(), "display_name": F.when(bare, F.coalesce(name, F.col("display_name"))).otherwise(F.col("display_name"))})

"""Readers of incident reports and their dimensions, field extraction, and table sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from causeway.functions import taxonomy, text

NODE = """id string, display_name string, type string, properties map<string,string>, key string, stub boolean, title string, plant string,
eiis_code string, non_eiis boolean, provisional boolean, role string, identifier string, model string, manufacturer_code string, inferred_code boolean,
description string, cause_code string, category string, theme string, proximate_text string, start string, `end` string, duration string, tz string,
status string, code string, ref_type string"""
IDENTITY = """accession_number string, docket string, plant_name string, unit int, reactor_type string, nss_vendor string, event_date string, report_date string,
operating_mode string, power_level int, discovery_context string, status string, revision string, ens_number string, ens_date string, ens_time string, title string"""
REPORT = f"""ler_number string, identity struct<{', '.join(x.strip().replace(' ', ':', 1) for x in IDENTITY.split(','))}>,
reporting_basis struct<reported_under:array<string>, ssff:string>,
block_13 array<struct<cause:string, system:string, component:string, manufacturer:string, reportable:string>>,
cause struct<proximate_text:string, cause_code:string, category:string, theme:string, provisional:boolean>,
nodes array<struct<{', '.join(x.strip().replace(' ', ':', 1) for x in NODE.replace('map<string,string>', 'map<string;string>').split(','))}>>,
edges array<struct<source:string, relation:string, target:string, evidence:string>>, chain string, golden_questions array<string>, notes string, _corrupt_record string""".replace("map<string;string>", "map<string,string>")
# Node types and relations of the record model.
NODE_TYPES = ("LER", "Unit", "System", "Component", "FailureMode", "Cause", "Consequence", "CorrectiveAction", "Manufacturer", "RegulatoryReference")
RELATIONS = ("OCCURRED_AT", "INVOLVES", "LEADS_TO", "CAUSED_BY", "MITIGATED_BY", "BACKED_UP_BY", "REPORTED_UNDER", "MANUFACTURED_BY", "PART_OF", "SIMILAR_TO", "REVISES", "HAS_CAUSE")


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """One row per JSON file; unreadable files keep their text in ``_corrupt_record``."""
    rows = spark.read.schema(REPORT).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return rows.withColumn("source_file", F.input_file_name())


def validated(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined): a report needs a number, known node types and relations, and edges between its own nodes."""
    ids = F.transform("nodes", lambda n: n["id"])
    dangling = F.exists("edges", lambda e: ~F.array_contains(ids, e["source"]) | ~F.array_contains(ids, e["target"]))
    strange = F.exists("nodes", lambda n: ~n["type"].isin(*NODE_TYPES)) | F.exists("edges", lambda e: ~e["relation"].isin(*RELATIONS))
    reason = F.when(F.col("_corrupt_record").isNotNull() | F.col("ler_number").isNull(), "unreadable").when(F.coalesce(strange, F.lit(False)), "unknown type").when(F.coalesce(dangling, F.lit(False)), "edge without node")
    judged = reports.withColumn("reason", reason)
    return judged.where("reason IS NULL").drop("reason", "_corrupt_record"), judged.where("reason IS NOT NULL")


def prefer_curated(curated: DataFrame, extracted: DataFrame) -> DataFrame:
    """All curated reports and the extracted ones whose number no curated report has; ``source`` tells which."""
    rest = extracted.join(curated.select("ler_number"), "ler_number", "left_anti")
    return curated.withColumn("source", F.lit("oracle")).unionByName(rest.withColumn("source", F.lit("pipeline")))


def report_nodes(reports: DataFrame) -> DataFrame:
    """One row per node of each report with its match key and storage key."""
    n = reports.select("ler_number", "source_file", F.posexplode("nodes").alias("pos", "n")).select("ler_number", "source_file", "pos", "n.*")
    # attributes may sit among the properties
    for name in ("eiis_code", "identifier", "cause_code", "category", "theme", "proximate_text", "code", "key", "role", "status"):
        n = n.withColumn(name, F.coalesce(name, F.col("properties")[name]))
    n = n.withColumn("category", F.when(F.col("type") == "Cause", F.coalesce("category", F.lit("provisional"))))
    match = text.match_key(F.col("type"), F.col("display_name"), F.coalesce(F.nullif("eiis_code", F.lit("")), "code"), F.col("key"), F.col("identifier"), F.col("category"))
    n = n.withColumn("match_key", match)
    provisional = F.coalesce(F.col("provisional"), F.lit(False)) | (F.col("category") == "provisional")
    return n.withColumn("gkey", text.storage_key(F.col("type"), F.col("match_key"), provisional, F.col("ler_number")))


def read_plants(spark: SparkSession, path: str) -> DataFrame:
    """The plant dimension, every field trimmed; keyed by docket."""
    rows = spark.read.option("header", True).csv(path)
    return rows.select(*[F.trim(c).alias(c) for c in rows.columns])


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(accession, text) of whole text files named by accession."""
    return spark.read.option("wholetext", True).text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("accession"), F.col("value").alias("text"))


def file_order() -> F.Column:
    """Where a row of a reader stands: by file, then by part of the file, then within the part, so the order is that of the lines of each file."""
    return F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("row"))


def read_accessions(spark: SparkSession, path: str) -> DataFrame:
    """Distinct lines in the order of their first appearance."""
    lines = spark.read.text(path).select(F.trim("value").alias("accession"), file_order().alias("pos")).where("accession <> ''")
    return lines.groupBy("accession").agg(F.min("pos").alias("pos"))


def unwrap_documents(replies: DataFrame) -> DataFrame:
    """API replies ``document`` or ``results[0].document`` as (ler_number, docket, title, content)."""
    doc = "DocketNumber array<string>, DocumentTitle string, LicenseeEventReport string, content string"
    shape = f"document struct<{', '.join(p.strip().replace(' ', ':', 1) for p in doc.split(','))}>"
    parsed = F.from_json("reply", f"{shape}, results array<struct<{shape.replace(' ', ':', 1)}>>")
    found = F.coalesce(parsed["document"], F.get(parsed["results"], F.lit(0))["document"])
    number = F.regexp_replace(found["LicenseeEventReport"], "^LER *", "")
    docket = F.get(found["DocketNumber"], F.lit(0))
    return replies.select(F.concat_ws("-", F.regexp_replace(docket, "^0*50*0*", ""), number).alias("ler_number"), docket.alias("docket"), found["DocumentTitle"].alias("title"), found["content"].alias("content"))


def normalize_stub_keys(rows: DataFrame, plants: DataFrame) -> DataFrame:
    """(key, plant, normalized): a short lead is a unit of the same plant; other forms stay as they are."""
    parts = rows.withColumn("p", text.stub_parts(F.col("key")))
    unit = F.when(F.length("p.lead") <= 2, F.col("p.lead").cast("int"))
    joined = parts.join(F.broadcast(plants), (F.col("name") == F.col("plant")) & (F.col("unit") == unit), "left")  # plants: a few hundred rows
    full = F.concat_ws("-", F.coalesce("short", "p.lead"), "p.year", "p.seq", "p.rev")
    return joined.select("key", "plant", F.when(F.col("p").isNull(), F.col("key")).otherwise(full).alias("normalized"))


def report_fields(reports: DataFrame) -> DataFrame:
    """(doc_id, field, value) of the fields found in a report's text."""
    c = F.col("text")
    fields = {"power_level": text.power_level(c).cast("string"), "operating_mode": text.operating_mode(c), "event_date": text.event_date(c, c, F.lit(None).cast("string")), "status": text.report_status(c, c), "ssff": text.functional_failure(c), "discovery": text.discovery(c)}
    rows = reports.where("text IS NOT NULL").select("doc_id", F.array(*[F.struct(F.lit(k).alias("field"), v.alias("value")) for k, v in fields.items()]).alias("f"))
    return rows.select("doc_id", F.explode("f").alias("f")).select("doc_id", "f.field", "f.value").where("value IS NOT NULL")


def component_failures(tokens: F.Column) -> F.Column:
    """The component-failure block of a form: whole groups of five tokens, else the first five, else a short row placed by role."""
    clean = lambda x: F.when(~F.lower(x).isin("n/a", "na", ""), x)
    yes = lambda x: F.when(F.lower(x).isin("y", "yes"), "Y").when(F.lower(x).isin("n", "no"), "N")
    at = lambda k: F.get(tokens, k)
    row = lambda c, s, o, m, r: F.struct(c.alias("cause"), s.alias("system"), o.alias("component"), m.alias("manufacturer"), r.alias("reportable"))
    five = lambda g: row(*[clean(at(g * 5 + k)) for k in range(4)], yes(at(g * 5 + 4)))
    n = F.size(tokens)
    nothing = F.lit(None).cast("string")
    short = row(F.when(at(F.lit(0)).rlike("^([A-EX]|TBD)$"), at(F.lit(0))), F.get(F.filter(F.slice(tokens, 2, F.greatest(n - 1 - F.when(yes(at(n - 1)).isNotNull(), 1).otherwise(0), F.lit(0))), lambda t: t.rlike("^[A-Z]{2}$")), F.lit(0)), nothing, nothing, yes(at(n - 1)))
    rows = F.when(n == 0, F.array().cast("array<struct<cause:string,system:string,component:string,manufacturer:string,reportable:string>>")).when((n >= 5) & (n % 5 == 0), F.transform(F.sequence(F.lit(0), F.greatest(F.floor(n / 5).cast("int") - 1, F.lit(0))), five)).when(n >= 5, F.array(five(F.lit(0)))).otherwise(F.array(short))
    return F.filter(rows, lambda r: F.coalesce(r["cause"], r["system"], r["component"], r["manufacturer"], r["reportable"]).isNotNull())


#: Characters of a classifier's reason that are kept.
REASON_CHARS = 300


def classifier_replies(replies: DataFrame) -> DataFrame:
    """``replies`` (reply, ...) with (class, conf, reason): the class if it is in the taxonomy, the confidence clamped to 0..1, a short reason.

    All three are null where there is no class; a missing confidence is 0.
    """
    parsed = F.from_json(text.json_object(F.col("reply")), "outcome_class string, confidence double, reason string")
    named = F.when(parsed["outcome_class"].isin([k for k, _ in taxonomy.OUTCOMES]), parsed["outcome_class"])
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(parsed["confidence"], F.lit(0.0))))
    known = lambda c: F.when(named.isNotNull(), c)
    return replies.select("*", named.alias("class"), known(conf).alias("conf"), known(F.left(F.coalesce(parsed["reason"], F.lit("")), F.lit(REASON_CHARS))).alias("reason"))


def listing_cell(cell: F.Column) -> F.Column:
    """(accession, revision) of a listing's cell; a name without a revision is its first, 0."""
    found = lambda pattern: F.nullif(F.regexp_extract(cell, pattern, 1), F.lit(""))
    return F.struct(found(r"(ML\w+)").alias("accession"), F.coalesce(found(r"R(\d+)\.pdf").cast("int"), F.lit(0)).alias("revision"))


def latest(rows: DataFrame, keys: list[str], *order: F.Column) -> DataFrame:
    """One row per key, the first by ``order``."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def latest_filings(rows: DataFrame) -> DataFrame:
    """Rows (pos, report, accession, revision) with one for each report and then one for each accession.

    Of a report's rows the highest revision counts, the first of equal ones; an accession that several reports share stays with the
    report that comes first. Rows without a report or an accession go.
    """
    named = rows.where("trim(report) <> '' AND trim(accession) <> ''").withColumn("_first", F.min("pos").over(Window.partitionBy("report")))
    newest = latest(named, ["report"], F.desc("revision"), F.col("pos"))
    return latest(newest, ["accession"], F.col("_first")).drop("_first")


def read_sheet_dates(spark: SparkSession, path: str) -> DataFrame:
    """(accession, event_date) of a listing with dates as m/d/y; the last readable date of an accession counts."""
    rows = spark.read.option("header", True).csv(path).withColumn("pos", file_order())
    date = text.slash_date(F.regexp_extract(F.trim("event_date"), r"^(\d{1,2}/\d{1,2}/\d{2,4})", 1))
    dated = rows.select("accession", date.alias("event_date"), "pos").where("accession <> '' AND event_date IS NOT NULL")
    return dated.groupBy("accession").agg(F.max_by("event_date", "pos").alias("event_date"))


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], *order: F.Column) -> DataFrame:
    """Union in which new rows replace existing ones of their key; of several new rows of a key the first by ``order`` counts."""
    one = latest(new, keys, *(order or [F.xxhash64(*new.columns)]))
    return existing.join(one.select(*keys), keys, "left_anti").unionByName(one)


def missing_rows(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Distinct new rows that aren't there yet."""
    return new.distinct().join(existing.select(*new.columns).distinct(), new.columns, "left_anti")


def append_missing(new: DataFrame, path: str) -> None:
    """Append to a Parquet table the rows it doesn't have."""
    spark = new.sparkSession
    try:
        there = spark.read.schema(new.schema).parquet(path)
        fresh = missing_rows(new, there)
    except Exception as absent:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(absent):
            raise
        fresh = new.distinct()
    fresh.write.mode("append").parquet(path)


def overwrite(table: DataFrame, path: str, yes: bool = False) -> None:
    """Replace a table; refuses without ``yes``."""
    if not yes:
        raise ValueError(f"refusing to overwrite {path} without yes=True")
    table.write.mode("overwrite").parquet(path)



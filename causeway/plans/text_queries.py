"""Catalogue: scalar text functions, ingest fields, chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from causeway.functions import taxonomy, text
from causeway.operators import ablation
from causeway.operators.storage import materialize
from causeway.plans import proxy
from causeway.plans.registry import query
from causeway.sources import forms, records


@query("slug_keys", "SELECT p_partkey, p_name || ' / ' || p_type || ' #' || p_size || '.' AS input, regexp_replace(regexp_replace(lower(p_name || ' / ' || p_type || ' #' || p_size || '.'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS output FROM part")
def slug_keys(spark, sf_dir):
    name = F.concat("p_name", F.lit(" / "), "p_type", F.lit(" #"), F.col("p_size").cast("string"), F.lit("."))
    return proxy.table(spark, sf_dir, "part").select("p_partkey", name.alias("input"), text.slug(name).alias("output"))


@query("slug_whole_keys", """WITH s AS (SELECT doc_id, regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM documents) SELECT doc_id, length(slug) AS n_chars, md5(slug) AS digest FROM s""")
def slug_whole_keys(spark, sf_dir):
    slug = text.slug(F.col("text"))
    return proxy.table(spark, sf_dir, "documents").select("doc_id", F.length(slug).cast("bigint").alias("n_chars"), F.md5(slug.cast("binary")).alias("digest"))


#: Names of parts, their types in brackets of both kinds and cut to two to seven letters, the second one in lower case.
_NAMES = "SELECT DISTINCT 'the ' || p_name || ' System (' || substr(p_type, 1, 2 + p_size % 6) || ') Unit-' || p_size || ' {' || lower(substr(p_type, 1, 3)) || ')' AS input FROM part"
_NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(input), '[({][^)}]*[)}]', ' ', 'g'), '\b(system|subsystem|the|unit)\b', ' ', 'g'), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"


def _names(spark, sf_dir):
    size = F.col("p_size")
    name = F.concat(F.lit("the "), "p_name", F.lit(" System ("), F.substr("p_type", F.lit(1), 2 + size % 6), F.lit(") Unit-"), size.cast("string"), F.lit(" {"), F.lower(F.substring("p_type", 1, 3)), F.lit(")"))
    return proxy.table(spark, sf_dir, "part").select(name.alias("input")).distinct()


@query("norm_names", f"WITH v AS ({_NAMES}) SELECT input, {_NORM} AS output FROM v")
def norm_names(spark, sf_dir):
    return _names(spark, sf_dir).select("input", text.norm_name(F.col("input")).alias("output"))


@query("paren_acronyms", f"""WITH v AS ({_NAMES}), f AS (SELECT input, regexp_extract_all(input, '[({{]\\s*([A-Za-z]{{2,6}})\\s*[)}}]', 1) AS a FROM v)
SELECT input, upper(coalesce(list_filter(a, lambda x: x = upper(x))[1], a[1])) AS output FROM f""")
def paren_acronyms(spark, sf_dir):
    return _names(spark, sf_dir).select("input", text.paren_acronym(F.col("input")).alias("output"))


@query("component_keys", r"""WITH v AS (SELECT DISTINCT CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'ISV' ELSE substr(p_type, 1, 1) END AS code, CASE WHEN p_size % 3 > 0 THEN CAST(p_size AS VARCHAR) WHEN p_size % 2 = 0 THEN '' END AS identifier, p_name || ' #' || p_size AS name FROM part)
SELECT code, identifier, name, replace('Component:' || coalesce(nullif(code, ''), regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) || CASE WHEN nullif(code, '') IS NOT NULL AND nullif(identifier, '') IS NOT NULL THEN '|' || identifier ELSE '' END, 'Component:ISV', 'Component:V') AS match_key FROM v""")
def component_keys(spark, sf_dir):
    size = F.col("p_size")
    code = F.when(size % 4 == 0, None).when(size % 4 == 1, "").when(size % 4 == 2, "ISV").otherwise(F.substring("p_type", 1, 1))
    identifier = F.when(size % 3 > 0, size.cast("string")).when(size % 2 == 0, "")
    rows = proxy.table(spark, sf_dir, "part").select(code.alias("code"), identifier.alias("identifier"), F.concat("p_name", F.lit(" #"), size.cast("string")).alias("name")).distinct()
    return rows.select("*", text.tolerant_key(text.component_key(F.col("code"), F.col("identifier"), F.col("name"))).alias("match_key"))


@query("stub_keys", r"""WITH v AS (SELECT o_orderkey, ' ' || CASE WHEN o_custkey % 3 = 0 THEN o_custkey % 1000 ELSE o_custkey % 3 END || '-' || strftime(o_orderdate, '%Y') || '-' || o_orderkey % (CASE WHEN o_orderkey % 11 = 0 THEN 100000 ELSE 1000 END) || CASE WHEN o_orderkey % 2 = 0 THEN '-' || o_orderkey % 13 ELSE '' END AS key, n_name AS plant
 FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey), p AS (SELECT n_name AS name, u AS unit, CAST(300 + 3 * n_nationkey + u AS VARCHAR) AS short FROM nation, range(1, 3) r(u)),
m AS (SELECT o_orderkey, key, plant, regexp_extract(trim(key), '^(\d{1,4})-(\d{4})-(\d{1,3})(?:-(\d{1,2}))?$', ['a', 'b', 'c', 'd']) AS g FROM v)
SELECT o_orderkey, key, plant, CASE WHEN g.a = '' THEN key ELSE coalesce(CASE WHEN length(g.a) <= 2 THEN short END, g.a) || '-' || g.b || '-' || lpad(g.c, 3, '0') || '-' || CASE WHEN g.d = '' THEN '00' ELSE lpad(g.d, 2, '0') END END AS normalized
FROM m LEFT JOIN p ON p.name = m.plant AND length(g.a) BETWEEN 1 AND 2 AND p.unit = TRY_CAST(g.a AS INT)""")
def stub_keys(spark, sf_dir):
    o, customer, nation = (proxy.table(spark, sf_dir, n) for n in ("orders", "customer", "nation"))
    word = lambda c: c.cast("string")
    cust, key = F.col("o_custkey"), F.col("o_orderkey")
    lead = F.when(cust % 3 == 0, cust % 1000).otherwise(cust % 3)
    number = key % F.when(key % 11 == 0, 100000).otherwise(1000)
    short = F.concat(F.lit(" "), word(lead), F.lit("-"), F.date_format("o_orderdate", "yyyy"), F.lit("-"), word(number), F.when(key % 2 == 0, F.concat(F.lit("-"), word(key % 13))).otherwise(""))
    rows = o.join(customer, cust == customer.c_custkey, "left").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("o_orderkey", short.alias("key"), F.col("n_name").alias("plant"))
    plants = nation.select(F.col("n_name").alias("name"), "n_nationkey", F.explode(F.array(F.lit(1), F.lit(2))).alias("unit")).select("name", "unit", word(300 + 3 * F.col("n_nationkey") + F.col("unit")).alias("short"))
    keys = rows.select("key", "plant").distinct()
    return rows.join(records.normalize_stub_keys(keys, plants), ["key", "plant"]).select("o_orderkey", "key", "plant", "normalized")


#: How long something lasted, said in seven ways from a line's numbers, and the hours meant.
_LASTED = """SELECT l_orderkey, l_linenumber, CASE l_linenumber % 7 WHEN 0 THEN CAST(l_quantity AS INT) || ':' || lpad(CAST(l_suppkey % 60 AS VARCHAR), 2, '0') WHEN 1 THEN '~' || CAST(l_quantity AS INT) || '.5 hours' WHEN 2 THEN CAST(l_quantity AS INT) || ' days ' || l_suppkey % 24 || ' hrs ' || l_suppkey % 60 || ' mins'
 WHEN 3 THEN 'approx. ' || CAST(l_quantity AS INT) || ' Days' WHEN 4 THEN '~' || CAST(l_quantity AS INT) || ' months' WHEN 5 THEN 'longer than ' || l_suppkey % 60 || ' minutes' ELSE '' END AS input,
 round(CASE l_linenumber % 7 WHEN 0 THEN CAST(l_quantity AS INT) + (l_suppkey % 60) / 60.0 WHEN 1 THEN CAST(l_quantity AS INT) + 0.5 WHEN 2 THEN CAST(l_quantity AS INT) * 24 + l_suppkey % 24 + (l_suppkey % 60) / 60.0 WHEN 3 THEN CAST(l_quantity AS INT) * 24 WHEN 5 THEN (l_suppkey % 60) / 60.0 END, 9) AS output FROM lineitem"""


@query("duration_hours", _LASTED)
def duration_hours(spark, sf_dir):
    n, supp, kind = F.col("l_quantity").cast("int").cast("string"), F.col("l_suppkey"), F.col("l_linenumber") % 7
    word = lambda c: c.cast("string")
    said = (
        F.when(kind == 0, F.concat(n, F.lit(":"), F.lpad(word(supp % 60), 2, "0"))).when(kind == 1, F.concat(F.lit("~"), n, F.lit(".5 hours")))
        .when(kind == 2, F.concat(n, F.lit(" days "), word(supp % 24), F.lit(" hrs "), word(supp % 60), F.lit(" mins"))).when(kind == 3, F.concat(F.lit("approx. "), n, F.lit(" Days")))
        .when(kind == 4, F.concat(F.lit("~"), n, F.lit(" months"))).when(kind == 5, F.concat(F.lit("longer than "), word(supp % 60), F.lit(" minutes"))).otherwise("")
    )
    rows = proxy.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", said.alias("input"))
    return rows.select("*", F.round(text.duration_hours(F.col("input")), 9).alias("output"))


@query("iso_dates", """SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN NULL WHEN o_custkey % 5 = 4 AND CAST(strftime(o_orderdate, '%d') AS INT) = 1 THEN strftime(o_orderdate, '%Y-%m') || '-31' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS output FROM orders""")
def iso_dates(spark, sf_dir):
    """Dates as m/d/yy, m/d/yyyy, in words with and without a comma, and out of range; the thirty-first of any month passes."""
    d, way = F.col("o_orderdate"), F.col("o_custkey") % 5
    first = F.when(F.dayofmonth(d) == 1, "31").otherwise(F.dayofmonth(d).cast("string"))
    said = (
        F.when(way == 0, F.concat(F.lit("13/"), F.date_format(d, "d/yyyy"))).when(way == 1, F.date_format(d, "M/d/yyyy")).when(way == 2, F.date_format(d, "MMMM d, yyyy"))
        .when(way == 3, F.upper(F.date_format(d, "MMMM dd yyyy"))).otherwise(F.concat(F.date_format(d, "MM/"), first, F.date_format(d, "/yyyy")))
    )
    rows = proxy.table(spark, sf_dir, "orders").select("o_orderkey", said.alias("input"))
    return rows.select("o_orderkey", F.coalesce(text.slash_date(F.col("input")), text.word_date(F.col("input"))).alias("output"))


def _phrase_sql() -> str:
    cases = "".join(" WHEN " + " OR ".join(f"contains(t, '{w}')" for w in words) + f" THEN '{name}'" for name, words in taxonomy.OUTCOME_WORDS.items())
    names = ", ".join(f"'{k}'" for k, _ in taxonomy.OUTCOMES)
    return f"WITH n AS (SELECT doc_id, trim(lower(coalesce(text, ''))) AS t FROM documents UNION ALL SELECT -l_orderkey - 1, ' ' || lower({proxy.OUTCOME_SQL}) FROM lineitem WHERE l_linenumber = 1) SELECT doc_id, CASE WHEN trim(t) = '' THEN NULL WHEN trim(t) IN ({names}) THEN trim(t){cases} END AS outcome FROM n"


@query("outcome_phrase", _phrase_sql())
def outcome_phrase(spark, sf_dir):
    """Classes read out of whole texts, and out of their own names."""
    docs = proxy.table(spark, sf_dir, "documents").select("doc_id", "text")
    named = proxy.consequences(spark, sf_dir, "l_linenumber").where("l_linenumber = 1").select(-F.col("event_key") - 1, F.concat(F.lit(" "), F.upper("outcome")))
    return docs.unionAll(named).select("doc_id", taxonomy.outcome_phrase(F.col("text")).alias("outcome"))


#: The day that a document's report tells of, in SQL.
_DAY = "CAST(DATE '2020-01-01' + CAST(doc_id % 1500 AS INT) AS DATE)"


def _reports(spark, sf_dir):
    """(doc_id, text): a report at the end of each document's text, whose digits are taken out."""
    word = lambda c: c.cast("string")
    key = F.col("doc_id")
    d = F.date_add(F.lit("2020-01-01").cast("date"), (key % 1500).cast("int"))
    status = F.get(F.array(F.lit("F"), F.lit("O"), F.lit("P")), (key % 3).cast("int"))
    power = F.when(key % 3 == 0, F.concat(F.lit("Power Level: "), word(key % 101), F.lit(" %."))).when(key % 3 == 1, F.concat(F.lit("It ran at "), word(key % 101), F.lit(" percent power."))).otherwise("")
    mode = F.when(key % 2 == 0, F.concat(F.lit(" Reactor Mode: "), word(key % 5 + 1))).otherwise(F.concat(F.lit(" (OPCON) "), word(key % 5 + 1)))
    dated = F.when(key % 5 < 2, F.concat(F.lit(" Event Date: "), F.date_format(d, "MMMM d, yyyy"))).when(key % 5 < 4, F.concat(F.lit(" On "), F.date_format(d, "MMMM dd yyyy"), F.lit(" it began."))).otherwise("")
    found = F.when(key % 4 == 0, " A surveillance test showed it.").when(key % 4 == 1, " An inspection showed it.").when(key % 4 == 2, " An operability test, then a surveillance test.").otherwise("")
    lost = F.when(key % 6 == 0, " There was a loss of safety function.").otherwise("")
    more = F.when(key % 7 == 0, " A supplemental report will be submitted.").otherwise("")
    cited = F.concat(F.lit(" 10 CFR 50.73(a)(2)("), status, F.lit(") and CFT 50. 73 (a) (2)(v"), word(key % 3), F.lit("), again 10 CFR 50.73(a)(2)("), status, F.lit(")."))
    body = F.translate(F.coalesce("text", F.lit("")), "0123456789%", "")
    return materialize(proxy.table(spark, sf_dir, "documents").select("doc_id", F.concat(body, F.lit("\n"), power, mode, dated, F.lit("."), found, lost, more, cited).alias("text")), "reports")


@query("report_fields", f"""SELECT * FROM (SELECT doc_id, 'power_level' AS field, CASE WHEN doc_id % 3 < 2 THEN CAST(doc_id % 101 AS VARCHAR) END AS value FROM documents UNION ALL SELECT doc_id, 'operating_mode', CAST(doc_id % 5 + 1 AS VARCHAR) FROM documents
UNION ALL SELECT doc_id, 'event_date', CASE WHEN doc_id % 5 < 4 THEN strftime({_DAY}, '%Y-%m-%d') END FROM documents UNION ALL SELECT doc_id, 'status', CASE WHEN doc_id % 7 = 0 THEN 'supplement-expected' ELSE 'final' END FROM documents
UNION ALL SELECT doc_id, 'ssff', CASE WHEN doc_id % 6 = 0 THEN 'Y' ELSE 'not stated' END FROM documents UNION ALL SELECT doc_id, 'discovery', CASE doc_id % 4 WHEN 0 THEN 'surveillance test' WHEN 1 THEN 'inspection' WHEN 2 THEN 'operability test' ELSE 'normal operation' END FROM documents) WHERE value IS NOT NULL""")
def report_fields(spark, sf_dir):
    return records.report_fields(_reports(spark, sf_dir))


@query("regex_citations", """SELECT DISTINCT doc_id, value FROM (SELECT doc_id, '10 CFR 50.73(a)(2)(' || ['F', 'O', 'P'][1 + doc_id % 3] || ')' AS value FROM documents UNION ALL SELECT doc_id, '10 CFR 50.73(a)(2)(v' || doc_id % 3 || ')' FROM documents)""")
def regex_citations(spark, sf_dir):
    return _reports(spark, sf_dir).select("doc_id", F.explode(text.reported_under(F.col("text"))).alias("value"))


#: The lines of the block of failures by the remainder of the document's id: two whole rows, one and a rest, a short row, no end, nothing, a code alone.
_BLOCKS = ("B BJ P G080 Yes\nX BK V N/A no", "E BD RLY C770 n trailing", "C BN y", "D BN P W120 y", "n/a", "TBD")
_ROWS = ("B/BJ/P/G080/Y+X/BK/V//N", "E/BD/RLY/C770/N", "C/BN///Y", "", "", "TBD////")


@query("form_fields", f"""WITH b AS (SELECT doc_id, {list(_ROWS)}[1 + doc_id % 6] AS rows FROM documents)
SELECT doc_id, CASE WHEN doc_id % 4 < 3 THEN 'Pump ' || doc_id || ' failed' ELSE 'Listed ' || doc_id END AS title, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id % 5 + 1 AS VARCHAR) ELSE '3' END AS operating_mode,
CAST(CASE doc_id % 3 WHEN 2 THEN 11 ELSE doc_id % 101 END AS INT) AS power_level, CASE WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 THEN 'supplement-expected' ELSE 'final' END AS status, CASE WHEN doc_id % 8 = 0 THEN '2021-03-04' ELSE strftime({_DAY}, '%Y-%m-%d') END AS event_date,
CASE WHEN doc_id % 9 = 0 THEN '10 CFR 50.73(a)(2)(iv)' ELSE '' END AS reported_under, rows AS failures, CASE WHEN rows = '' THEN 'TBD' ELSE split_part(rows, '/', 1) END AS cause_code FROM b""")
def form_fields(spark, sf_dir):
    """Whole forms around each document's text: fields stand in one region or another, and the header says other things than the prose."""
    key, word = F.col("doc_id"), lambda c: c.cast("string")
    d = F.date_add(F.lit("2020-01-01").cast("date"), (key % 1500).cast("int"))
    t = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    cover = F.when(key % 4 < 3, t("Dear reader\nSubject: LER 2024-001, \"Pump ", word(key), "\nfailed\"\n\n")).otherwise("Dear reader\n\n")
    block = t("13. Complete One Line for each Component Failure Described\nCause System Component Manufacturer Reportable to IRIS\n", F.get(F.array(*[F.lit(b) for b in _BLOCKS]), (key % 6).cast("int")), "\n", F.when(key % 6 != 3, "\n 14. Supplemental\n").otherwise("15. other\n"))
    header = t("NRC FORM 366\nPower Level: 11 %\n(OPCON) 3 [x] 10 CFR 50.73(a)(2)(i)\n", block, F.when(key % 5 == 0, "Expected Submission Date 01 02 2025\n").otherwise(""))
    abstract = t("16. Abstract (limit)\n", F.when(key % 3 == 1, t("It ran at ", word(key % 101), " percent power.\n")).otherwise("It ran.\n"))
    body = F.translate(F.coalesce("text", F.lit("")), "0123456789%", "")
    dated = F.when(key % 8 != 0, t("On ", F.date_format(d, "MMMM d, yyyy"), " it began.")).otherwise("")
    narrative = t("NRC FORM 366A\n", body, "\n", dated, F.when(key % 2 == 0, t(" Reactor Mode: ", word(key % 5 + 1))).otherwise(""), F.when(key % 3 == 0, t(" Power Level: ", word(key % 101), " %")).otherwise(""), F.when(key % 7 == 0, " A supplemental LER will be submitted.").otherwise(""), F.when(key % 9 == 0, " under 10 CFR 50.73(a)(2)(iv)").otherwise(""))
    made = proxy.table(spark, sf_dir, "documents").select("doc_id", t(cover, header, abstract, narrative).alias("text"), t("LER 9 for North, Unit 2, Listed ", word(key)).alias("listed"), F.lit("3/4/21").alias("sheet"))
    got = forms.form_fields(materialize(made, "forms"), listed_title="listed", listed_date="sheet").select("doc_id", "form.*")
    row = lambda x: F.concat_ws("/", *[F.coalesce(x[c], F.lit("")) for c in ("cause", "system", "component", "manufacturer", "reportable")])
    return got.select("doc_id", "title", "operating_mode", "power_level", "status", "event_date", F.array_join("reported_under", ",").alias("reported_under"), F.array_join(F.transform("block_13", row), "+").alias("failures"), "cause_code")


_FURNITURE = "(?i)" + "|".join(text.FURNITURE_LINES).replace("'", "''")
_NOTICE = " OR ".join(f"contains(lower(x), '{w}')" for w in text.NOTICE_WORDS)


@query("boilerplate_filter", f"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x = '' OR NOT (({_NOTICE}) OR regexp_matches(x, '{_FURNITURE}'))) AS k FROM documents)
SELECT doc_id, CAST(len(k) AS BIGINT) AS n_lines_kept, CAST(length(array_to_string(k, chr(10))) AS BIGINT) AS n_chars FROM l""")
def boilerplate_filter(spark, sf_dir):
    kept = text.prose_lines(F.col("text"))
    docs = proxy.table(spark, sf_dir, "documents").select("doc_id", kept.alias("kept"))
    return docs.select("doc_id", F.size("kept").cast("bigint").alias("n_lines_kept"), F.length(F.array_join("kept", "\n")).cast("bigint").alias("n_chars"))


@query("html_cell_extract", """WITH c AS (SELECT page_id, coalesce(html, '') || '<a href="/docs/' || page_id % 97 || CASE WHEN page_id % 3 = 0 THEN 'R0' || page_id % 7 ELSE '' END || '.pdf"><strong>ML' || CASE WHEN page_id % 5 = 0 THEN '' ELSE page_id || 'A' END || '</strong></a>' AS cell FROM pages)
SELECT page_id, nullif(regexp_extract(cell, '(ML\\w+)', 1), '') AS accession, coalesce(TRY_CAST(nullif(regexp_extract(cell, 'R(\\d+)\\.pdf', 1), '') AS INT), 0) AS revision FROM c""".replace("\\\\", "\\"))
def html_cell_extract(spark, sf_dir):
    """Accessions and revisions out of the cells of a listing that end whole pages."""
    n = F.col("page_id")
    word = lambda c: c.cast("string")
    cell = F.concat(F.coalesce("html", F.lit("")), F.lit('<a href="/docs/'), word(n % 97), F.when(n % 3 == 0, F.concat(F.lit("R0"), word(n % 7))).otherwise(""), F.lit('.pdf"><strong>ML'), F.when(n % 5 == 0, "").otherwise(F.concat(word(n), F.lit("A"))), F.lit("</strong></a>"))
    return proxy.table(spark, sf_dir, "pages").select("page_id", records.listing_cell(cell).alias("c")).select("page_id", "c.accession", "c.revision")


@query("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf_dir):
    reply = F.concat(F.lit("Sure:\n"), "props", F.lit("\ndone"))
    return proxy.table(spark, sf_dir, "events").select("event_id", F.from_json(text.json_object(reply), "k long")["k"].alias("k"))


@query("classifier_reply_validation", f"""WITH r AS (SELECT l_orderkey, l_linenumber, l_suppkey % 6 AS way, {proxy.OUTCOME_SQL} AS outcome, round(l_discount * 20, 2) AS conf FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN way IN (0, 1, 4) THEN outcome END AS class, CASE WHEN way IN (0, 1) THEN least(1.0, CAST(conf AS DOUBLE)) WHEN way = 4 THEN 0.0 END AS conf, CASE WHEN way IN (0, 1, 4) THEN substr('because ' || repeat('x', 400), 1, 300) END AS reason FROM r""")
def classifier_reply_validation(spark, sf_dir):
    """Replies about lines: plain, in chatter, of an unknown class, without an object, without a confidence, and cut off."""
    con = proxy.consequences(spark, sf_dir, "l_orderkey", "l_linenumber", "l_suppkey", "l_discount")
    way, conf = F.col("l_suppkey") % 6, F.round(F.col("l_discount") * 20, 2).cast("string")
    said = lambda name, rest: F.concat(F.lit('{"outcome_class": "'), name, F.lit('"'), rest, F.lit(f', "reason": "because {"x" * 400}"}}'))
    sure = F.concat(F.lit(', "confidence": '), conf)
    reply = (
        F.when(way == 0, said(F.col("outcome"), sure)).when(way == 1, F.concat(F.lit("Here it is:\n```json\n"), said(F.col("outcome"), sure), F.lit("\n```\nDone."))).when(way == 2, said(F.lit("nonsense"), sure))
        .when(way == 3, "no object").when(way == 4, said(F.col("outcome"), F.lit(""))).otherwise(F.lit('{"outcome_class": "esf-act'))
    )
    return records.classifier_replies(con.select("l_orderkey", "l_linenumber", reply.alias("reply"))).drop("reply")


CHUNKS = {"short": (90, 15), "medium": (180, 27), "long": (330, 50)}
_WORDS = "SELECT doc_id, len(list_filter(string_split_regex(trim(coalesce(text, '')), '\\s+'), lambda x: x <> '')) AS n FROM documents"


def _chunks_sql(size: int, overlap: int) -> str:
    return f"SELECT doc_id, k AS chunk_ix, least({size}, n - k * {size - overlap}) AS n_words FROM (SELECT doc_id, n, unnest(range(CASE WHEN n = 0 THEN 0 ELSE greatest(1, CAST(ceil((n - {overlap}) / {size - overlap}) AS BIGINT)) END)) AS k FROM ({_WORDS}))"


@query("chunk_documents", _chunks_sql(*CHUNKS["medium"]))
def chunk_documents(spark, sf_dir):
    docs = proxy.table(spark, sf_dir, "documents")
    made = docs.select("doc_id", F.posexplode(text.chunks(F.col("text"), *CHUNKS["medium"])).alias("chunk_ix", "words"))
    return made.select("doc_id", F.col("chunk_ix").cast("bigint").alias("chunk_ix"), F.size("words").cast("bigint").alias("n_words"))


@query("chunk_ablation_counts", " UNION ALL ".join(f"SELECT '{k}' AS config, count(*) AS n_chunks FROM ({_chunks_sql(*v)})" for k, v in CHUNKS.items()))
def chunk_ablation_counts(spark, sf_dir):
    docs = proxy.table(spark, sf_dir, "documents")
    sizes = docs.agg(*[F.sum(F.size(text.chunks(F.col("text"), *v))).alias(k) for k, v in CHUNKS.items()])
    return sizes.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, CHUNKS)), F.array(*CHUNKS))).alias("config", "n_chunks"))


MAKERS = (ablation.Maker("words", 256), ablation.Maker("pairs", 512, 2))
ABLATION_KS = (1, 8)
#: Words of an item by which the documents that hold it are told.
HEAD = 12


def _digested(source: str, key: str, maker: ablation.Maker) -> str:
    """SQL of unit vectors by digests: rows of ``source`` (key, w)."""
    run = "lower(w[k])" if maker.run == 1 else "lower(w[k]) || ' ' || lower(w[k + 1])"
    return f"""SELECT {key}, place, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS x FROM (SELECT {key}, CAST('0x' || substr(h, 1, 8) AS BIGINT) % {maker.width} AS place, CAST(sum(CASE WHEN CAST('0x' || substr(h, 9, 2) AS INT) % 2 = 1 THEN 1 ELSE -1 END) AS DOUBLE) AS n
 FROM (SELECT {key}, md5({run}) AS h FROM (SELECT {key}, w, unnest(range(1, len(w) + {2 - maker.run})) AS k FROM {source})) GROUP BY ALL)"""


def _ablation_sql() -> str:
    split = "list_filter(string_split_regex(trim(coalesce(text, '')), '\\s+'), lambda x: x <> '')".replace("\\\\", "\\")
    cut = lambda size, overlap: f"SELECT doc_id, i AS chunk_ix, w[1 + i * {size - overlap} : i * {size - overlap} + {size}] AS w FROM (SELECT doc_id, w, unnest(range(CASE WHEN len(w) = 0 THEN 0 ELSE greatest(1, CAST(ceil((len(w) - {overlap}) / {size - overlap}) AS BIGINT)) END)) AS i FROM d)"
    parts = [f"d AS (SELECT doc_id, {split} AS w FROM documents)", f"q AS (SELECT item_id, {split} AS w FROM benchmark)", *[f"c_{name} AS ({cut(*size)})" for name, size in CHUNKS.items()]]
    parts += [f"q_{m.name} AS ({_digested('q', 'item_id', m)})" for m in MAKERS]
    scored = " UNION ALL ".join(
        f"SELECT '{name}' AS config, '{m.name}' AS maker, a.item_id, v.doc_id, v.chunk_ix, sum(a.x * v.x) AS score FROM ({_digested(f'c_{name}', 'doc_id, chunk_ix', m)}) v JOIN q_{m.name} a USING (place) GROUP BY ALL" for name in CHUNKS for m in MAKERS
    )
    parts += [f"s AS ({scored})", "al AS (SELECT config, maker, item_id, doc_id, chunk_ix, 0.0 AS score FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS config, doc_id, chunk_ix FROM c_{n}" for n in CHUNKS) + f") CROSS JOIN (VALUES {', '.join(f'({m.name!r})' for m in MAKERS)}) m(maker) CROSS JOIN (SELECT item_id FROM benchmark))"]
    parts += ["f AS (SELECT config, maker, item_id, doc_id, chunk_ix, round(sum(score), 6) AS score FROM (SELECT * FROM s UNION ALL SELECT * FROM al) GROUP BY ALL)", "r AS (SELECT *, row_number() OVER (PARTITION BY config, maker, item_id ORDER BY score DESC, doc_id, chunk_ix) AS rank FROM f)"]
    parts += [f"t AS (SELECT item_id, doc_id FROM q JOIN d ON len(q.w) > 0 AND contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || array_to_string(q.w[1:{HEAD}], ' ') || ' '))", f"ks(k) AS (VALUES {', '.join(f'({k})' for k in ABLATION_KS)})"]
    parts += ["h AS (SELECT config, maker, item_id, k, count(DISTINCT r.doc_id) FILTER (WHERE rank <= k AND t.doc_id IS NOT NULL) AS hit FROM r LEFT JOIN t USING (item_id, doc_id), ks GROUP BY ALL)", "w AS (SELECT item_id, count(*) AS n FROM t GROUP BY 1)"]
    return "WITH " + ", ".join(parts) + " SELECT config, maker, CASE WHEN coalesce(n, 0) > 1 THEN 'cross-doc' WHEN n = 1 THEN 'lookup' ELSE 'negative' END AS bucket, CAST(k AS BIGINT) AS k, count(*) AS n, avg(CASE WHEN n > 0 THEN CAST(hit AS DOUBLE) / n ELSE 0.0 END) AS recall FROM h LEFT JOIN w USING (item_id) GROUP BY config, maker, bucket, k"


@query("ablation_grid", _ablation_sql())
def ablation_grid(spark, sf_dir):
    """Three ways of cutting, two of making vectors: do benchmark items find the documents that hold their first twelve words?"""
    docs = proxy.table(spark, sf_dir, "documents").select("doc_id", "text")
    items = proxy.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question"), "text")
    hits = ablation.search(ablation.chunk_table(docs, CHUNKS, MAKERS), items, MAKERS, max(ABLATION_KS))
    words = lambda c: F.filter(F.split(F.trim(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != "")
    heads = items.select("question", F.slice(words(F.col("text")), 1, HEAD).alias("head")).where("size(head) > 0").select("question", "head", F.xxhash64("head").alias("hash"))
    sizes = [r["n"] for r in heads.select(F.size("head").alias("n")).distinct().collect()]  # at most HEAD numbers
    nothing = F.array().cast("array<bigint>")
    of = lambda w, n: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda k: F.xxhash64(F.slice(w, k, n)))).otherwise(nothing)
    windows = lambda w: F.flatten(F.array(nothing, *[of(w, n) for n in sizes]))
    held = docs.select("doc_id", words(F.col("text")).alias("w")).select("doc_id", F.explode(F.array_distinct(windows(F.col("w")))).alias("hash"))
    found = held.join(heads.select("question", "hash"), "hash").groupBy("question").agg(F.collect_set("doc_id").alias("docs"))
    wanted = items.join(found, "question", "left").select("question", F.coalesce("docs", F.array().cast("array<bigint>")).alias("docs"))
    bucket = F.when(F.size("docs") > 1, "cross-doc").when(F.size("docs") == 1, "lookup").otherwise("negative")
    return ablation.recall_by_bucket(hits, wanted.withColumn("bucket", bucket), ABLATION_KS)

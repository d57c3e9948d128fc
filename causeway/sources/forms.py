"""Fields of a report's form: each is read from the regions it may stand in, in their order, and failures from their own block.

A text has a cover letter, the form's header, an abstract and a narrative; prose is what is left of the first and the last two without
the form's furniture. The block of component failures is found by going through the header's lines one by one: it begins after the
line that names it and ends before a line of the next block, and where that never comes there is none.

Defined results: a null text is empty, and its fields are null or what is said where nothing is found; a listed date and title serve
where the text has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions import text
from causeway.functions.taxonomy import CAUSE_CATEGORIES
from causeway.sources.records import component_failures

# The line that begins the block of failures, the one that ends it and its column heads.
BLOCK, NEXT_BLOCK = "complete one line for each component failure", r"^\s*14\."
HEADS = r"(?i)Cause|System|Component|Manufacturer|Reportable\s+to\s+IRIS"


def failure_lines(header: Column) -> Column:
    """The lines of the block of failures, empty where it is absent or never ends: a fold over the header's lines.

    The state is 0 before the block, 1 on its first line, which belongs to it whatever it says, 2 further inside and 3 after it.
    """
    state = lambda at, lines: F.struct(F.lit(at).alias("at") if isinstance(at, int) else at.alias("at"), lines.alias("lines"))
    nothing = F.array().cast("array<string>")

    def step(s: Column, line: Column) -> Column:
        at, lines = s["at"], s["lines"]
        begins = (at == 0) & F.lower(line).contains(BLOCK)
        ends = (at == 2) & line.rlike(NEXT_BLOCK)
        inside = at.isin(1, 2) & ~ends
        moved = F.when(begins, 1).when(ends, 3).when(inside, 2).otherwise(at)
        return state(moved, F.when(inside, F.array_append(lines, line)).otherwise(lines))

    return F.aggregate(F.split(F.coalesce(header, F.lit("")), "\n"), state(0, nothing), step, lambda s: F.when(s["at"] == 3, s["lines"]).otherwise(nothing))


def failures(header: Column) -> Column:
    """Rows (cause, system, component, manufacturer, reportable) of the block of failures."""
    # the rest of the naming line is no value; heads may be repeated anywhere
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(F.array_join(failure_lines(header), "\n"), HEADS, " "), r"\s+", " ")), " ")
    return component_failures(F.filter(words, lambda w: w != ""))


def form_fields(reports: DataFrame, text_col: str = "text", listed_title: str | None = None, listed_date: str | None = None) -> DataFrame:
    """``reports`` with ``form``: the fields of each text, as (event_date, operating_mode, power_level, discovery, status, ssff,
    reported_under, title, notification, block_13, cause_code, category, provisional)."""
    given = lambda c: F.col(c).cast("string") if c else F.lit(None).cast("string")
    cut = reports.select("*", text.segments(F.col(text_col)).alias("_cut"))
    clean = lambda region: F.coalesce(text.clean_prose(F.col(f"_cut.{region}")), F.lit(""))
    regions = cut.select("*", F.struct(F.col("_cut.cover").alias("cover"), F.col("_cut.header").alias("header"), clean("abstract").alias("abstract"), clean("narrative").alias("narrative")).alias("_r"))
    r = lambda name: F.col(f"_r.{name}")
    told = regions.select("*", F.concat_ws("\n", r("cover"), r("abstract"), r("narrative")).alias("_prose"), failures(r("header")).alias("_rows"))
    prose, first = F.col("_prose"), F.get("_rows", F.lit(0))["cause"]
    code = F.when(first.isin(*CAUSE_CATEGORIES), first).otherwise("TBD")
    named = F.create_map(*[F.lit(x) for pair in CAUSE_CATEGORIES.items() for x in pair])
    fields = {
        "event_date": text.event_date(r("header"), r("narrative"), given(listed_date)),
        "operating_mode": text.operating_mode(r("narrative"), r("header")),
        "power_level": text.power_level(r("narrative"), r("abstract"), r("header")),
        "discovery": text.discovery(F.concat_ws(" ", r("narrative"), r("abstract"))),
        "status": text.report_status(r("header"), prose),
        "ssff": text.functional_failure(prose),
        "reported_under": text.reported_under(prose),
        "title": text.title(r("cover"), F.coalesce(given(listed_title), F.lit(""))),
        "notification": text.notification(prose),
        "block_13": F.col("_rows"),
        "cause_code": code,
        "category": named[code],
        "provisional": code == "TBD",
    }
    return told.select(*[reports[c] for c in reports.columns], F.struct(*[v.alias(k) for k, v in fields.items()]).alias("form"))

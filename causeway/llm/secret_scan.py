"""Operator 7, secret scans with one combined deterministic automaton.

All rules are compiled into a single minimal automaton that reads each byte once. Where it reports a rule, the rule's
reversed automaton walks back to the leftmost start; runs of reported ends give the longest end. Matches of a rule do not
overlap: a later match begins at or after the end of the one before it, whether or not that one is long enough to be kept.

Defined results: a null text is empty and has no secrets; repeated rows give repeated results; no documents give no rows;
spans count code points; other columns are ignored whatever their names.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causeway.llm.automaton import Automaton, compile_rules
from causeway.llm.kernel import Texts, pieces
from causeway.llm.storage import free_name
from causeway.plans.shipping import ship

SCAN_BYTES = 2 << 20


@dataclass(frozen=True)
class Rule:
    """``least`` characters are asked of the whole match, or of ``group`` if it is set."""

    kind: str
    pattern: str
    least: int
    group: int = 0


#: The base rules, in the order that breaks ties between equal starts.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=\-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),  # runs shorter than 24 are dropped anyway; so the automaton stays quiet on them
)
#: Rules of widely documented token formats; each open-ended rule doubles the states, so there are few.
MORE_RULES = (
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9\-]+", 15),
    Rule("pem", r"-----BEGIN\x20([A-Z]+\x20)*PRIVATE\x20KEY-----", 0),
)
RULES = BASE_RULES + MORE_RULES


@dataclass
class Scanner:
    rules: tuple[Rule, ...]
    together: Automaton
    single: list[Automaton]
    back: list[Automaton]

    def __post_init__(self) -> None:
        self.whole = [re.compile(r.pattern.encode()) for r in self.rules]

    def long_enough(self, k: int, match: bytes) -> bool:
        rule = self.rules[k]
        if rule.group:
            match = self.whole[k].fullmatch(match)[rule.group]
        return len(match) >= rule.least

    def spans(self, texts: Texts) -> list[list[tuple[int, int, int]]]:
        """Per text the (start, rule, end) of its matches in code points, in order."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
        stream = np.zeros(len(texts.data) + len(texts), np.uint8)  # a 0 after each text: no rule reads it
        begin = texts.offsets[:-1] + np.arange(len(texts))
        for i, at in enumerate(begin.tolist()):
            a, b = texts.offsets[i], texts.offsets[i + 1]
            stream[at : at + b - a] = texts.data[a:b]
        ends, masks = self.together.scan(stream)
        if not len(ends):
            return out
        owner = np.searchsorted(begin, ends - 1, "right") - 1
        for k in range(len(self.rules)):
            mine = ends[(masks >> k & 1) > 0]
            if not len(mine):
                continue
            doc = owner[(masks >> k & 1) > 0]
            cut = np.flatnonzero((np.diff(mine) != 1) | (np.diff(doc) != 0))
            firsts, lasts = mine[np.append(0, cut + 1)], mine[np.append(cut, len(mine) - 1)]
            current, resume, data = -1, 0, b""
            for first, last, d in zip(firsts.tolist(), lasts.tolist(), doc[np.append(0, cut + 1)].tolist(), strict=True):
                if d != current:
                    current, resume, data = d, 0, texts.raw(d)
                first, last = first - int(begin[d]), last - int(begin[d])
                start = self.back[k].furthest_back(data, first, resume)
                if start is None:  # it began inside the match before; look for one that begins after it
                    first = self.single[k].first_end(data, resume, last)
                    if first is None:
                        continue
                    start = self.back[k].furthest_back(data, first, resume)
                if self.long_enough(k, data[start:last]):
                    out[d].append((start, k, last))
                resume = last
        for d, found in enumerate(out):
            if found:
                found.sort()
                raw = np.frombuffer(texts.raw(d), np.uint8)
                if (raw > 127).any():
                    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                    out[d] = [(int(points[a]), k, int(points[b])) for a, k, b in found]
        return out


@functools.lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    patterns = [r.pattern for r in rules]
    return Scanner(rules, compile_rules(patterns), [compile_rules([p]) for p in patterns], [compile_rules([p], anywhere=False, backwards=True) for p in patterns])


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def scan(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, text, secrets): secrets holds kind, start and end of each match by start, then by the rules' order."""
    ship(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return _scanned(rows, rules)


def _scanned(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``rows``, which has a column ``text``, with ``secrets`` as the last column."""
    schema = T.StructType([*rows.schema.fields, T.StructField(free_name(rows.columns, "secrets"), T.ArrayType(SPAN))])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    at = rows.columns.index("text")
    shipped = rows.sparkSession.sparkContext.broadcast(scanner(rules))  # a few hundred kB, whatever the input

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = shipped.value
        for batch in batches:
            batch = pa.RecordBatch.from_arrays(batch.columns, [f"c{i}" if i != at else "text" for i in range(batch.num_columns)])
            for part, texts in pieces(batch, "text", SCAN_BYTES):
                found = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in x] for x in ready.spans(texts)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, arrow)], schema.names)

    return rows.mapInArrow(find, schema)


def redact(spark: SparkSession, docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every secret replaced by ``[kind]`` in ``text`` and ``n_chars`` counted anew; a document without secrets is left as it is."""
    ship(spark)
    found = _scanned(docs, rules)
    secrets = found.columns[-1]
    # overlapping spans of several rules are replaced as one
    merged = F.aggregate(
        secrets,
        F.struct(F.lit(0).cast("long").alias("end"), F.lit("").alias("text")),
        lambda s, m: F.when(m["start"] >= s["end"], F.struct(m["end"].alias("end"), F.concat(s["text"], F.substring("text", (s["end"] + 1).cast("int"), (m["start"] - s["end"]).cast("int")), F.lit("["), m["kind"], F.lit("]")).alias("text"))).otherwise(F.struct(F.greatest(s["end"], m["end"]).alias("end"), s["text"].alias("text"))),
    )
    tail = F.concat(merged["text"], F.substring(F.col("text"), (merged["end"] + 1).cast("int"), F.length("text")))
    dirty, redacted = F.size(secrets) > 0, free_name(found.columns, "redacted")
    cleaned = found.withColumn(redacted, F.when(dirty, tail).otherwise(F.col("text")))
    columns = [F.col(redacted).alias(c) if c == "text" else F.when(dirty, F.length(redacted)).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return cleaned.select(*columns)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = [r.kind for r in BASE_RULES]
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in base), F.sha2(said(F.filter("secrets", lambda s: s["kind"].isin(*base))), 256).alias("base_sha256"), said(F.col("secrets")).alias("spans"))


def _oracle() -> str:
    """Spans by splitting each text at the matches of a rule: a match starts where the parts and matches before it end."""
    found = "\nUNION ALL ".join(
        f"SELECT r, {k} AS place, '{x.kind}' AS kind, {x.least} AS least, string_split_regex(t, {p}) AS parts, regexp_extract_all(t, {p}) AS found, {f'regexp_extract_all(t, {p}, {x.group})' if x.group else 'found'} AS held FROM d"
        for k, x in enumerate(RULES) for p in ["'" + x.pattern.replace("'", "''") + "'"]
    )
    listed = "string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, place)"
    base = ", ".join(f"'{x.kind}'" for x in BASE_RULES)
    counts = ", ".join(f"count(*) FILTER (kind = '{x.kind}') AS n_{x.kind}" for x in BASE_RULES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({found}),
i AS (SELECT *, unnest(range(1, len(found) + 1)) AS k FROM f),
s AS (SELECT r, place, kind, list_sum(list_transform(parts[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:k - 1], lambda x: length(x))), 0) AS a,
      length(found[k]) AS n FROM i WHERE length(held[k]) >= least),
p AS (SELECT r, place, kind, CAST(a AS BIGINT) AS a, CAST(a + n AS BIGINT) AS b FROM s),
g AS (SELECT r, {counts}, {listed} FILTER (kind IN ({base})) AS base, {listed} AS spans FROM p GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{x.kind}, 0) AS n_{x.kind}" for x in BASE_RULES)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (r)
"""


ORACLE = _oracle()

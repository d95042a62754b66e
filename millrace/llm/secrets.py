"""Secret scans: rules as regular expressions, found through a trigram inverted index and then verified.

Rules with mandatory trigrams are verified only on the rows that the index names; rules without any scan every row.
Everything runs on built-in functions.

Defined results: a null text counts as empty; rows without a doc_id are not in the index and are
scanned in full; repeated rows repeat; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .spans import joined, matches
from .trigrams import TRUE, build_index, candidates, query_of

#: Candidate rows that are broadcast at most (each a doc_id and a few rule names); beyond that they are joined by a shuffle.
BROADCAST = 100_000


@dataclass(frozen=True)
class Rule:
    """least: a match must have so many characters, or its group `group` if one is named."""

    name: str
    pattern: str
    least: int = 1
    group: int = 0


#: The three base rules. Runs that are too short are left out by the pattern where that changes nothing else.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    Rule("access", r"AKIA[A-Z0-9]{12,}", 16),
    Rule("hex", r"[0-9a-f]{32,}", 32),
)
#: Published formats of further secrets.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)


def _spans(text: Column, rule: Rule, order: int) -> Column:
    tagged = lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(rule.name).alias("kind"))
    size = lambda s: F.length(F.regexp_extract(s["found"], rule.pattern, rule.group) if rule.group else s["found"])
    return F.transform(F.filter(matches(text, rule.pattern), lambda s: size(s) >= rule.least), tagged)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """(doc_id, text, spans): spans is array<struct<start, order, end, kind>>, by start, then rule."""
    queries = {r.name: query_of(r.pattern) for r in rules}
    indexed = {n: q for n, q in queries.items() if q != TRUE}
    wanted = sorted({t for q in indexed.values() for a in q for t in a})
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = named
    if indexed:
        index = written(build_index(named, wanted), "trigram_index")
        found = written(candidates(index, indexed), "candidates")
        found = F.broadcast(found) if found.count() <= BROADCAST else found
        rows = named.join(found, "doc_id", "left")
    else:
        rows = named.withColumn("rules", F.lit(None).cast("array<string>"))
    empty = F.array().cast("array<struct<start: int, order: int, end: int, kind: string>>")
    each = []
    for order, rule in enumerate(rules):
        spans = _spans(F.col("text"), rule, order)
        if rule.name in indexed:
            spans = F.when(F.coalesce(F.array_contains("rules", rule.name), F.col("doc_id").isNull()), spans).otherwise(empty)
        each.append(spans)
    return rows.select("doc_id", "text", F.array_sort(F.concat(*each)).alias("spans"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents")).select("doc_id", "spans")
    base = F.filter("spans", lambda s: s["order"] < len(BASE))
    count = lambda i: F.size(F.filter("spans", lambda s: s["order"] == i)).cast("long")
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{r.name}") for i, r in enumerate(BASE)],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def oracle(rules: tuple[Rule, ...] = BASE + MORE) -> str:
    """DuckDB SQL for the rows of op3: gaps and matches of each rule add up to positions, without any index."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    kinds = " UNION ALL ".join(
        f"SELECT rid, {i} AS o, '{r.name}' AS kind, {r.least} AS least, string_split_regex(t, {quoted(r.pattern)}) AS gaps, "
        f"regexp_extract_all(t, {quoted(r.pattern)}) AS m, regexp_extract_all(t, {quoted(r.pattern)}, {r.group}) AS g FROM d"
        for i, r in enumerate(rules)
    )
    span = "kind || ':' || start || ':' || (start + n)"
    base = ", ".join(f"count(*) FILTER (WHERE o = {i}) AS n_{r.name}" for i, r in enumerate(BASE))
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
k AS ({kinds}),
s AS (
  SELECT rid, o, kind, least, length(m[i]) AS n, length(g[i]) AS size,
    list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM k WHERE len(m) > 0)
),
f AS (SELECT rid, o, kind, n, CAST(start AS BIGINT) AS start FROM s WHERE size >= least)
SELECT doc_id, {base},
  sha256(coalesce(string_agg({span}, ',' ORDER BY start, o) FILTER (WHERE o < {len(BASE)}), '')) AS base_sha256,
  coalesce(string_agg({span}, ',' ORDER BY start, o), '') AS spans
FROM d LEFT JOIN f USING (rid) GROUP BY rid, doc_id
"""

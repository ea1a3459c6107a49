"""Line dedup by site-relative frequency.

Pages are grouped by host. A line's ratio is the number of the host's pages that hold
it over the number of the host's pages; lines with a ratio over ``ratio`` that stand on
at least ``min_pages`` pages are boilerplate and are dropped from every page of the host.

Copies count once: pages of a host with the same whole text are one page, in a line's count and in the host's total, so a large
group of copies isn't taken for its own boilerplate; ``copies_once=False`` counts each.

RATIO is well below the share that site-wide lines have (some 9 to 13 % of a host's pages in the test tables), so that
chance doesn't decide, and above that of lines that merely recur (under 5 %). MIN_PAGES keeps hosts of very few pages, where
any line is on a large share of pages, from losing what two or three pages have in common.

Lines travel as two 64-bit hashes of different seeds, pre-aggregated before the shuffle, so a host with a
third of all pages costs no more than its distinct lines. The rules of a host are bounded:
each takes more than ``ratio`` of its pages, so there are fewer than (mean lines of a page) /
ratio. Pages meet them by a join on the host, which adaptive execution splits where it is
skewed; the rules are broadcast only when their counted number is at most BROADCAST_ROWS.

Defined cases: a null host is a host of its own; a null text stays null and counts as a
page without lines; an empty text stays empty; empty lines are never rules and stay;
very long texts and lines are read whole; a line whose share is just the ratio stays;
repeated rows are copies; other columns pass through unchanged, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterflow.llm.common import materialize

RATIO = 0.05
MIN_PAGES = 4
BROADCAST_ROWS = 50_000


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def boilerplate(docs: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, host_col: str = "source", text_col: str = "text", copies_once: bool = True) -> DataFrame:
    """(host, a, b, n_pages, host_pages): the lines over the ratio, by their hashes."""
    pages = docs.select(F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    distinct = F.array_distinct(F.filter(F.split("text", "\n"), lambda x: x != ""))
    if copies_once:
        # lines as hashes, so no text is shuffled; copies collapse before the shuffle
        pages = pages.select("host", _key(F.col("text")).alias("page"), F.transform(distinct, _key).alias("keys"))
        totals = pages.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
        lines = pages.groupBy("host", "page").agg(F.first("keys").alias("keys")).select("host", F.explode("keys").alias("key")).select("host", "key.a", "key.b")
    else:
        totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
        lines = pages.select("host", F.explode(distinct).alias("line"))
        lines = lines.select("host", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"))
    counts = lines.groupBy("host", "a", "b").agg(F.count(F.lit(1)).alias("n_pages")).where(F.col("n_pages") >= min_pages)
    totals = totals.withColumnRenamed("host", "total_host")
    return counts.join(totals, F.col("host").eqNullSafe(F.col("total_host"))).where(F.col("n_pages") > F.lit(ratio) * F.col("host_pages")).drop("total_host")


def line_dedup(docs: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, host_col: str = "source", text_col: str = "text", count_col: str | None = None, copies_once: bool = True) -> DataFrame:
    """``docs`` without boilerplate lines; ``count_col`` adds the number of lines dropped."""
    rules = materialize(boilerplate(docs, ratio, min_pages, host_col, text_col, copies_once), "line-rules")
    by_host = rules.groupBy("host").agg(F.collect_list(F.struct("a", "b")).alias("rules"))
    if rules.count() <= BROADCAST_ROWS:
        by_host = F.broadcast(by_host)
    # the input's columns stand inside a struct, where no name can clash with those used here
    joined = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("page")).join(by_host, F.col(f"page.`{host_col}`").eqNullSafe(F.col("host")), "left")
    text = F.col(f"page.`{text_col}`")
    # one hashed look-up finds the pages to take apart; both hashes decide on a line
    hit = F.col("rules").isNotNull() & F.arrays_overlap(F.transform(F.split(text, "\n"), lambda line: F.xxhash64(line)), F.col("rules.a"))
    stay = F.filter(F.split(text, "\n"), lambda line: (line == "") | ~F.array_contains(F.col("rules"), _key(line)))
    changed = joined.withColumn("hit", F.coalesce(hit, F.lit(False))).withColumn("stay", F.when(F.col("hit"), stay))
    cut = F.when(F.col("hit"), F.array_join("stay", "\n")).otherwise(text)
    columns = [(cut if c == text_col else F.col(f"page.`{c}`")).alias(c) for c in docs.columns]
    if count_col:
        columns.append(F.when(F.col("hit"), F.size(F.split(text, "\n")) - F.size("stay")).otherwise(0).cast("long").alias(count_col))
    return changed.select(*columns)


def oracle_sql(select: str, ratio: float = RATIO, min_pages: int = MIN_PAGES, table: str = "documents", before: str = "") -> str:
    """SQL with a table ``cut`` (all columns, text cut, n_dropped), ending in ``select``."""
    return f"""
WITH {before} src AS (SELECT row_number() OVER () AS r, * FROM {table}),
totals AS (SELECT source AS host, count(DISTINCT text) + max(CASE WHEN text IS NULL THEN 1 ELSE 0 END) AS host_pages FROM src GROUP BY source),
lines AS (SELECT text, source AS host, unnest(string_split(text, chr(10))) AS line FROM src WHERE text IS NOT NULL),
rules AS (SELECT c.host, line FROM (SELECT host, line, count(DISTINCT text) AS n FROM lines WHERE line <> '' GROUP BY host, line) c
  JOIN totals ON c.host IS NOT DISTINCT FROM totals.host WHERE n >= {min_pages} AND n > {ratio!r}::DOUBLE * host_pages),
by_host AS (SELECT host, list(line) AS bad FROM rules GROUP BY host),
cut AS (SELECT src.* EXCLUDE (text), CASE WHEN bad IS NULL OR text IS NULL THEN text
    ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(bad, x)), chr(10)) END AS text,
  CASE WHEN bad IS NULL OR text IS NULL THEN 0 ELSE len(list_filter(string_split(text, chr(10)), lambda x: list_contains(bad, x))) END AS n_dropped
  FROM src LEFT JOIN by_host ON src.source IS NOT DISTINCT FROM by_host.host)
{select}
"""

"""Line dedup by site-relative frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.llm.common import cut

#: A line is boilerplate of its host if it is on more than this share of the host's pages,
MOST_SHARE = 0.1
#: and on this many of them at least: what is on one page only is repeated nowhere, however few pages the host has.
LEAST_PAGES = 2
#: The lists of all hosts are sent to every task if no more lines than these can be on them (8 MB).
MOST_SENT = 100_000


def _digest(value: Column) -> Column:
    return F.md5(value.cast("binary"))


def drop_boilerplate(
    docs: DataFrame,
    host: str = "source",
    text: str = "text",
    most_share: float = MOST_SHARE,
    least_pages: int = LEAST_PAGES,
    distinct_pages: bool = True,
    n_lines: str = "n_lines",
    n_dropped: str = "n_dropped",
) -> DataFrame:
    """``docs`` without its hosts' boilerplate lines, and with ``n_lines`` and ``n_dropped``.

    Lines end at line feeds and are compared without leading and trailing spaces; blank lines are neither
    counted nor dropped. With ``distinct_pages`` pages of a host with the same text count once, in a line's pages and in the
    host's total, so that copies of a page don't make all its lines boilerplate; without it, and with ``least_pages`` 1, a line's
    share is the bare ratio of pages. ``n_lines`` and ``n_dropped`` (long) count
    the lines that are not blank, repeats included. A text whose lines are all dropped becomes empty; null stays
    null with counts of 0. A null host is a host. Columns of the two names are replaced, all others stay, whatever
    their names, as do repeated rows.

    Counting goes by digests of 16 bytes, and a line of a page moves once. A host has at most 1 / ``most_share``
    times as many boilerplate lines as lines on a page on average, so its list is short. The lists are sent to the
    texts if a count shows that they are small together; else they meet in a join by host, for which Spark splits a host
    with very many pages.
    """
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.col(host).isNull().alias("_absent"),
        F.coalesce(F.col(host).cast("string"), F.lit("")).alias("_host"),
        F.col(text).alias("_text"),
    )
    site = ["_absent", "_host"]
    stripped = F.transform(F.split("_text", "\n"), lambda line: F.trim(line))
    there = F.filter(stripped, lambda line: line != "")
    bytes_of = lambda value: F.unhex(_digest(value))
    own_lines = F.transform(F.array_distinct(there), bytes_of)
    pages = keyed.where("_text is not null").select(*site, bytes_of(F.col("_text")).alias("_page"), own_lines.alias("_lines"))
    # a page without lines counts for the host too, by a line of its own that no line has
    on_pages = pages.select(*site, "_page", F.explode(F.concat("_lines", F.array(F.lit(b"")))).alias("_line"))
    on_pages = on_pages.distinct() if distinct_pages else on_pages
    on = on_pages.groupBy(*site, "_line").agg(F.count("*").alias("_on"))
    lines = cut(on.where((F.col("_on") >= least_pages) | (F.col("_line") == b"")))
    totals = lines.where(F.col("_line") == b"").select(*site, F.col("_on").alias("_pages"))
    boilerplate = cut(
        lines.where((F.col("_line") != b"") & (F.col("_on") >= least_pages))
        .join(totals, site)
        .where(F.col("_on") > F.lit(most_share) * F.col("_pages"))
        .select(*site, "_line")
    )
    common = (
        boilerplate.groupBy(*site)
        .agg(F.collect_list(F.lower(F.hex("_line"))).alias("_common"))
    )
    small = boilerplate.limit(MOST_SENT + 1).count() <= MOST_SENT
    found = keyed.join(F.broadcast(common) if small else common, site, "left").withColumn("_lost", F.array_intersect(F.transform(there, _digest), "_common"))
    kept = F.filter(F.split("_text", "\n"), lambda line: ~F.array_contains("_lost", _digest(F.trim(line))))
    n_there = F.coalesce(F.size(there), F.lit(0))
    n_kept = F.size(F.filter(kept, lambda line: F.trim(line) != ""))
    loses = F.coalesce(F.size("_lost"), F.lit(0)) > 0
    new = found.select(
        "_row",
        F.when(loses, F.array_join(kept, "\n")).otherwise(F.col("_text")).alias("_new"),
        F.when(F.col("_text").isNull(), 0).otherwise(n_there).cast("long").alias("_there"),
        F.when(loses, n_there - n_kept).otherwise(0).cast("long").alias("_dropped"),
    )
    others = [c for c in docs.columns if c.lower() not in (n_lines.lower(), n_dropped.lower())]
    return new.select(
        *[F.col("_new" if c.lower() == text.lower() else f"_row.`{c}`").alias(c) for c in others],
        F.col("_there").alias(n_lines),
        F.col("_dropped").alias(n_dropped),
    )


#: DuckDB SQL for ``drop_boilerplate`` over documents with the default parameters.
ORACLE = f"""
WITH d AS (SELECT doc_id, text, source IS NULL AS absent, coalesce(source, '') AS host FROM documents),
pages AS (SELECT DISTINCT absent, host, text FROM d WHERE text IS NOT NULL),
lines AS (SELECT absent, host, unnest(list_distinct(list_transform(string_split(text, chr(10)), lambda x: trim(x)))) AS line FROM pages),
totals AS (SELECT absent, host, count(*) AS pages FROM pages GROUP BY ALL),
common AS (
  SELECT absent, host, list(line) AS lost FROM (
    SELECT absent, host, line, count(*) AS n FROM lines WHERE line <> '' GROUP BY ALL) JOIN totals USING (absent, host)
  WHERE n >= {LEAST_PAGES} AND n > CAST({MOST_SHARE} AS DOUBLE) * pages GROUP BY ALL),
split AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS all_lines, coalesce(lost, []) AS lost
  FROM d LEFT JOIN common USING (absent, host))
SELECT doc_id, array_to_string(list_filter(all_lines, lambda x: NOT list_contains(lost, trim(x))), chr(10)) AS text,
       CAST(coalesce(len(list_filter(all_lines, lambda x: trim(x) <> '')), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(list_filter(all_lines, lambda x: trim(x) <> '' AND list_contains(lost, trim(x)))), 0) AS BIGINT) AS n_dropped
FROM split
"""

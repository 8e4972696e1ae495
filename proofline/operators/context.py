"""Nearest context, neighbours in order, and containment of spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_context(rows: DataFrame, by: list[str], order: list[str], is_context: Column, value: Column, barrier: Column | None = None) -> DataFrame:
    """``before`` and ``after``: the value of the nearest context row on each side of a row, within its group.

    Nothing is looked for beyond a row where ``barrier`` is true: barriers number the stretches between them, and
    the search stays in its stretch.
    """
    whole = Window.partitionBy(*by).orderBy(*order)
    stretch = F.lit(0) if barrier is None else F.sum(F.when(barrier, 1).otherwise(0)).over(whole.rowsBetween(Window.unboundedPreceding, 0))
    cut = rows.withColumn("_stretch", stretch).withColumn("_value", F.when(is_context, value))
    inside = Window.partitionBy(*by, "_stretch").orderBy(*order)
    return cut.withColumns(
        {
            "before": F.last("_value", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1)),
            "after": F.first("_value", ignorenulls=True).over(inside.rowsBetween(1, Window.unboundedFollowing)),
        }
    ).drop("_stretch", "_value")


def within_band(left: DataFrame, right: DataFrame, by: list[str], position: str, band: int) -> DataFrame:
    """Pairs of a group whose positions differ by at most ``band``: left columns as l_, right as r_.

    Positions are binned by the band, and a left row meets its own bin and the two beside it, so the join is on
    equality and a long group is spread over its bins.
    """
    a = left.select(*by, *[F.col(c).alias(f"l_{c}") for c in left.columns if c not in by], F.floor(F.col(position) / band).alias("_bin"))
    b = right.select(*by, *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in by], F.floor(F.col(position) / band).alias("_bin"))
    a = a.withColumn("_bin", F.explode(F.array(F.col("_bin") - 1, F.col("_bin"), F.col("_bin") + 1)))
    return a.join(b, [*by, "_bin"]).where(F.abs(F.col(f"l_{position}") - F.col(f"r_{position}")) <= band).drop("_bin")


def widest_spans(spans: Column) -> Column:
    """Of an array of structs (start, stop, ...) those that lie strictly inside no longer one."""
    return F.filter(
        spans,
        lambda a: ~F.exists(spans, lambda b: (b["start"] <= a["start"]) & (b["stop"] >= a["stop"]) & (b["stop"] - b["start"] > a["stop"] - a["start"])),
    )


def islands(rows: DataFrame, by: list[str], order: list[str], same_as_before: Column) -> DataFrame:
    """``island``: a number that changes wherever a row doesn't continue the one before."""
    whole = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("island", F.sum(F.when(F.coalesce(same_as_before, F.lit(False)), 0).otherwise(1)).over(whole.rowsBetween(Window.unboundedPreceding, 0)))


def bridges(rows: DataFrame, by: list[str], page: str, text: str, span: int = 150) -> DataFrame:
    """A bridge chunk between each two consecutive pages: the end of one and the beginning of the next.

    Returns the group, from_page, to_page and bridge; only where the pages differ by one and both sides have text.
    """
    order = Window.partitionBy(*by).orderBy(page)
    pairs = rows.withColumns({"_next": F.lead(text).over(order), "_to": F.lead(page).over(order)})
    has_text = (F.trim(F.col(text)) != "") & (F.trim(F.col("_next")) != "")
    return pairs.where((F.col("_to") - F.col(page) == 1) & has_text).select(
        *by, F.col(page).alias("from_page"), F.col("_to").alias("to_page"),
        F.concat(F.expr(f"right(`{text}`, {span})"), F.lit("\n"), F.expr(f"left(_next, {span})")).alias("bridge"),
    )

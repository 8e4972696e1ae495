"""Samples that are the same on every run: by hash, in proportion, and by turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: str, purpose: str, key: Column) -> Column:
    """The sort key of a seeded draw."""
    return F.sha2(F.concat_ws(":", F.lit(seed), F.lit(purpose), key.cast("string")).cast("binary"), 256)


def per_stratum(rows: DataFrame, stratum: str, key: str, n: int, seed: str, purpose: str = "sample") -> DataFrame:
    """The first ``n`` rows of each stratum in the order of the draw, as ``position`` from 1."""
    order = Window.partitionBy(stratum).orderBy(draw(seed, purpose, F.col(key)), key)
    return rows.withColumn("position", F.row_number().over(order)).where(F.col("position") <= n)


def proportional(rows: DataFrame, stratum: str, key: str, n: int) -> DataFrame:
    """``n`` rows spread over the strata in proportion to their sizes.

    Rows go by their place in the stratum divided by its size, then by stratum. With fewer places than strata, the
    largest strata give one row each. Sizes are a group sum, and only the first ``n`` rows of a stratum are ordered
    against others, so a stratum with most of the rows isn't sorted in one task. A null stratum is one too.
    """
    sizes = rows.groupBy(F.col(stratum).alias("_of")).agg(F.count("*").alias("_size"))
    strata = sizes.agg(F.count("*").alias("_strata"))
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(key)) - 1
    first = rows.withColumn("_place", place).where(F.col("_place") < n)
    few = F.col("_strata") > n
    return (
        first.join(sizes, F.col(stratum).eqNullSafe(F.col("_of"))).crossJoin(F.broadcast(strata)).where(~few | (F.col("_place") == 0))
        .orderBy(F.when(few, -F.col("_size")).otherwise(F.col("_place") / F.col("_size")), stratum, key).limit(n)
        .drop("_size", "_place", "_strata", "_of")
    )


def by_turns(rows: DataFrame, stratum: str, key: str, n: int, seed: str) -> DataFrame:
    """``n`` rows, one of each stratum by turns, within it in the order of a draw; no stratum gives more than ``n``."""
    order = Window.partitionBy(stratum).orderBy(draw(seed, "turn", F.col(key)), key)
    placed = rows.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= n)
    return placed.orderBy("turn", stratum).limit(n)


def scarce_first(rows: DataFrame, stratum: str, group: str, key: str, each: int, seed: str) -> DataFrame:
    """``each`` rows of every stratum, the scarcest first, no group twice; an error if a stratum can't be filled.

    Rows are first thinned in Spark to the ``each`` x strata best of every stratum by the draw, one of a group each: more
    can't be needed, as other strata take at most ``each`` groups away each. The choice among those is made one by one.
    """
    strata = rows.select(stratum).distinct().count()
    order = draw(seed, "scarce", F.col(key))
    once = rows.withColumn("_d", order)
    once = once.withColumn("_g", F.row_number().over(Window.partitionBy(stratum, group).orderBy("_d", key))).where("_g = 1")
    thin = once.withColumn("_n", F.row_number().over(Window.partitionBy(stratum).orderBy("_d", key))).where(F.col("_n") <= each * max(1, strata))
    sizes = {r[0]: r[1] for r in rows.groupBy(stratum).agg(F.countDistinct(group)).collect()}
    candidates = thin.select(stratum, group, key, "_d").collect()
    taken: set = set()
    chosen = []
    for name in sorted(sizes, key=lambda s: (sizes[s], str(s))):
        mine = [r for r in sorted((c for c in candidates if c[0] == name), key=lambda c: (c["_d"], c[2])) if r[1] not in taken][:each]
        if len(mine) < each:
            raise ValueError(f"stratum {name} has too few groups")
        taken |= {r[1] for r in mine}
        chosen += [(r[2],) for r in mine]
    return rows.join(rows.sparkSession.createDataFrame(chosen, [key]), key, "left_semi")

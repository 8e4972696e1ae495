"""Retrieval and decision metrics as plans over ranked hits, gold sets and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_set(gold: DataFrame, ranked: DataFrame) -> DataFrame:
    """Metrics of each case: hit, recall and reciprocal rank of its best evidence set.

    ``gold`` (case_id, set_id, item) has alternative sets; ``ranked`` (case_id, item, rank) what was found. A set is
    hit if all of its items were found; recall is the best share found of any set; the reciprocal rank is that of
    the last item needed, of the best complete set, else 0.
    """
    found = gold.distinct().join(ranked, ["case_id", "item"], "left")
    sets = found.groupBy("case_id", "set_id").agg(
        F.count("*").alias("size"), F.count("rank").alias("present"), F.max("rank").alias("last")
    )
    whole = F.col("present") == F.col("size")
    return sets.groupBy("case_id").agg(
        F.max(whole.cast("int")).alias("hit"),
        F.max(F.col("present") / F.col("size")).alias("recall"),
        F.coalesce(F.max(F.when(whole, 1.0 / F.col("last"))), F.lit(0.0)).alias("reciprocal_rank"),
    )


def ndcg(gold: DataFrame, ranked: DataFrame) -> DataFrame:
    """nDCG of each case over the union of its sets; the ideal has as many items as there are gold or found ones."""
    items = gold.select("case_id", "item").distinct()
    retrieved = ranked.groupBy("case_id").agg(F.count("*").alias("n"))
    gain = items.join(ranked, ["case_id", "item"], "left").groupBy("case_id").agg(
        F.count("*").alias("size"), F.coalesce(F.sum(1.0 / F.log2(F.col("rank") + 1)), F.lit(0.0)).alias("dcg")
    )
    best = F.least("size", F.coalesce("n", F.lit(0)))
    ideal = F.aggregate(F.when(best > 0, F.sequence(F.lit(1), best.cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1))
    return gain.join(retrieved, "case_id", "left").withColumn("ideal", ideal).select(
        "case_id", F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0).alias("ndcg")
    )


def paired_outcomes(scores: DataFrame, baseline: str, challenger: str, value: str = "value", epsilon: float = 1e-12) -> DataFrame:
    """Wins, ties and losses of ``challenger`` in the cases (case_id, arm, value) that both arms have."""
    sides = scores.where(F.col("arm").isin(baseline, challenger)).groupBy("case_id").agg(
        F.max(F.when(F.col("arm") == baseline, F.col(value))).alias("a"), F.max(F.when(F.col("arm") == challenger, F.col(value))).alias("b")
    )
    gap = F.col("b") - F.col("a")
    return sides.where("a is not null and b is not null").agg(
        F.count_if(gap > epsilon).alias("wins"), F.count_if(F.abs(gap) <= epsilon).alias("ties"), F.count_if(gap < -epsilon).alias("losses")
    )


def by_class(decisions: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Precision, recall and F1 of each class, 0 where undefined; rows without gold or prediction are left out."""
    known = decisions.where(F.col(gold).isNotNull() & F.col(predicted).isNotNull())
    cells = known.groupBy(F.col(gold).alias("g"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    both = cells.select("g", "p", "n", F.explode(F.array_distinct(F.array("g", "p"))).alias("class"))
    right = F.sum(F.when((F.col("g") == F.col("class")) & (F.col("p") == F.col("class")), F.col("n")).otherwise(0))
    said, real = F.sum(F.when(F.col("p") == F.col("class"), F.col("n")).otherwise(0)), F.sum(F.when(F.col("g") == F.col("class"), F.col("n")).otherwise(0))
    counted = both.groupBy("class").agg(right.alias("right"), said.alias("said"), real.alias("real"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    f1 = F.when(F.col("said") + F.col("real") > 0, 2.0 * F.col("right") / (F.col("said") + F.col("real"))).otherwise(0.0)
    return counted.select("class", "right", "said", "real", ratio("right", "said").alias("precision"), ratio("right", "real").alias("recall"), f1.alias("f1"))


def bag_overlap(left: Column, right: Column) -> Column:
    """How many items two arrays share, repeats counted."""
    shared = F.array_distinct(F.array_intersect(left, right))
    times = lambda bag, item: F.size(F.filter(bag, lambda x: x == item))
    return F.aggregate(shared, F.lit(0), lambda s, x: s + F.least(times(left, x), times(right, x)))


def bag_f1(predicted: Column, gold: Column) -> Column:
    """F1 of two bags; 1 if both are empty, 0 if one is."""
    total = F.size(predicted) + F.size(gold)
    return F.when(total == 0, 1.0).otherwise(2.0 * bag_overlap(predicted, gold) / total)


#: A gate's comparison by its operator's name; null is never passed.
GATES = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}


def gates(metrics: DataFrame, limits: DataFrame) -> DataFrame:
    """``limits`` (metric, operator, value) against ``metrics`` (metric, actual): passed, false if the metric is missing."""
    joined = limits.join(metrics, "metric", "left")
    passed = F.raise_error(F.concat(F.lit("unknown operator "), F.col("operator"))).cast("boolean")
    for name, test in GATES.items():
        passed = F.when(F.col("operator") == name, test(F.col("actual"), F.col("value"))).otherwise(passed)
    return joined.withColumn("passed", F.coalesce(passed, F.lit(False)))


def compare_runs(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Metrics (stage_id, metric_id, value, direction) that both runs have, with delta and verdict."""
    both = baseline.select("stage_id", "metric_id", F.col("value").alias("before"), "direction").join(
        candidate.select("stage_id", "metric_id", F.col("value").alias("after")), ["stage_id", "metric_id"]
    )
    delta = F.col("after") - F.col("before")
    better = F.when(F.col("direction") == "lower", -delta).otherwise(delta)
    verdict = (
        F.when(F.abs(delta) <= 1e-12, "unchanged").when(F.col("direction") == "neutral", "unchanged")
        .when(better > 0, "improved").otherwise("regressed")
    )
    return both.withColumn("delta", delta).withColumn("verdict", verdict)


def summary(results: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Mean and median of each value by group."""
    return results.groupBy(*by).agg(F.count("*").alias("cases"), *[f(v).alias(f"{n}_{v}") for v in values for n, f in (("mean", F.avg), ("median", F.median))])


def first_by(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def audit(references: DataFrame, corpus: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, problem) of each reference that the corpus hasn't, or has with another value of a field; none if all agree."""
    there = corpus.select(key, F.lit(True).alias("_there"), *[F.col(f).alias(f"_{f}") for f in fields])
    joined = references.join(there, key, "left")
    problems = [F.when(F.col("_there") & ~F.col(f).eqNullSafe(F.col(f"_{f}")), F.lit(f)) for f in fields]
    return joined.select(key, F.explode(F.array_compact(F.array(F.when(F.col("_there").isNull(), "missing"), *problems))).alias("problem"))


def set_scores(found: Column, wanted: Column) -> Column:
    """A struct (precision, recall, exact) of two sets of names compared without case; 0 where there is nothing to divide by."""
    norm = lambda names: F.array_distinct(F.transform(names, lambda n: F.lower(F.trim(n))))
    a, b = norm(found), norm(wanted)
    both = F.size(F.array_intersect(a, b))
    share = lambda of: F.when(F.size(of) > 0, both / F.size(of)).otherwise(0.0)
    exact = (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)
    return F.struct(share(a).alias("precision"), share(b).alias("recall"), exact.alias("exact"))


def rates(rows: DataFrame, parts: dict[str, tuple[str, str]], if_none: float | None = 1.0) -> DataFrame:
    """Sums of each (part, whole) pair of columns over all rows, as a rate; ``if_none`` where the whole is zero."""
    sums = [(F.sum(part) / F.nullif(F.sum(whole), F.lit(0))).alias(name) for name, (part, whole) in parts.items()]
    rolled = rows.agg(*sums)
    return rolled if if_none is None else rolled.fillna(if_none)

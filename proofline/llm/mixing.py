"""Mixing sources to target weights: a time-varying curriculum in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.llm.common import WORD, cut

#: Rows of a slice of a source's order, if all rows were one source.
SLICE_ROWS = 1 << 14
#: (time from 0 to 1, weight) knots, joined by straight lines; times ascend from 0 to 1.
Schedule = Sequence[tuple[float, float]]
#: Weights of the sources by turns over the training: one fades, one peaks half way, one grows; their areas are 1, 2 and 3.
CURRICULUM: tuple[Schedule, ...] = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (0.5, 3.0), (1.0, 1.0)), ((0.0, 1.0), (1.0, 5.0)))
#: No source gives more than so many times its size.
MOST = 3

#: A source's key: whether it is null, and its name. Unlike a nullable column, both can be joined.
KEY = ["_absent", "_source"]


def words(text: Column) -> Column:
    """Number of runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def integral(schedule: Schedule) -> float:
    """Area under the weights over the whole training."""
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]))


def _time_of(share: Column, schedule: Schedule) -> Column:
    """The time by which a schedule has asked for ``share`` (0 to 1) of all that it asks for."""
    area = share * F.lit(integral(schedule))
    before, cases = 0.0, []
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        rest = F.greatest(area - F.lit(before), F.lit(0.0))
        slope = (w1 - w0) / (t1 - t0)
        # w0 x + slope x^2 / 2 = rest, in the form that also holds for a slope of zero
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * rest, F.lit(0.0)))
        cases.append((before, F.lit(t0) + F.coalesce(2 * rest / F.nullif(F.lit(w0) + root, F.lit(0.0)), F.lit(0.0))))
        before += (t1 - t0) * (w0 + w1) / 2
    found = cases[0][1]
    for start, time in cases[1:]:
        found = F.when(area >= F.lit(start), time).otherwise(found)
    return found


def _by_turns(values: Sequence[Column], rank: Column) -> Column:
    found = values[-1]
    for i, value in enumerate(values[:-1]):
        found = F.when(rank % len(values) == i, value).otherwise(found)
    return found


def source_targets(sized: DataFrame, schedules: Sequence[Schedule] = CURRICULUM, most: int = MOST) -> DataFrame:
    """_absent, _source, source_size, _rank and target of each source of ``sized`` (KEY and _size).

    Sources are ranked by code point, null last, and take the schedules by turns. The total size is shared by
    weight; a source stops at ``most`` times its size, and what it leaves is shared by weight among the others
    until none is above. The ranks come from a range partitioning that is written down once, and a loop of
    sums, so no task and no driver holds all sources.
    """
    totals = sized.groupBy(*KEY).agg(F.sum("_size").alias("source_size"))
    dealt = cut(totals.repartitionByRange(*KEY).withColumn("_part", F.spark_partition_id()))
    parts = dealt.groupBy("_part").count().withColumn(
        "_before", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )  # a row for each partition
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*KEY)) - 1
    ranked = dealt.withColumn("_within", within).join(F.broadcast(parts.drop("count")), "_part")
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_within"))
    weight = _by_turns([F.lit(integral(s)) for s in schedules], F.col("_rank"))
    ranked = cut(ranked.select(*KEY, "source_size", "_rank", weight.alias("_weight")))

    limit = most * F.col("source_size")
    level = None
    while True:
        above = F.lit(False) if level is None else limit < F.lit(level) * F.col("_weight")
        total, held, open_weight = ranked.agg(
            F.sum("source_size"), F.sum(F.when(above, limit).otherwise(0)), F.sum(F.when(above, 0.0).otherwise(F.col("_weight")))
        ).first()
        following = ((total or 0) - (held or 0)) / open_weight if open_weight else 0.0
        if following == level:
            break
        level = following
    share = F.lit(level) * F.col("_weight")
    return ranked.withColumn("target", F.when(limit < share, limit.cast("double")).otherwise(share)).drop("_weight")


def mix(
    docs: DataFrame,
    schedules: Sequence[Schedule] = CURRICULUM,
    most: int = MOST,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """``docs`` with size, source_size, target, taken, position and positions.

    ``size`` counts the words of the whole text (null: 0). Each source passes its documents in an order drawn
    by md5 of doc_id and text, again from the first after the last, until the words taken reach its target to the
    nearest word; ``taken`` is what the mix takes of the document, repeats counted, at most ``most`` times its size.
    The last one may be taken in part. ``position`` (0 to 1, null if nothing is taken) is the time of training at
    which the document first comes: the time by which its source's schedule has asked for the words before it.
    ``positions`` has those of all its whole copies; a part of half the document or more counts as a whole one.

    A source's running sums are taken within slices of md5, which hold a 4096th of it each, or less where that would be more than
    SLICE_ROWS of all rows, and then over the slices, so that a source with most of the rows is spread, and rows that share a doc_id, or have none, are too.
    A null source is a source; null and repeated doc_id are kept, and rows equal in doc_id and text are
    interchangeable. An empty table gives no rows. Of ``docs`` columns with the names of added ones are replaced;
    all others stay, whatever their names.
    """
    added = ["size", "source_size", "target", "taken", "position", "positions"]
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))).cast("binary"))
    own = {f"_c{i}": c for i, c in enumerate(docs.columns)}  # numbered, so that no name clashes and what nobody asks for is pruned
    keyed = docs.select(
        *[F.col(f"`{c}`").alias(n) for n, c in own.items()],
        F.col(source).isNull().alias("_absent"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_source"),
        words(F.col(text)).alias("_size"),
        digest.alias("_digest"),
    )
    rows, digits = docs.count(), 3
    while rows > SLICE_ROWS * 16**digits:
        digits += 1
    keyed = keyed.withColumn("_slice", F.substring("_digest", 1, digits))
    slices = cut(keyed.groupBy(*KEY, "_slice").agg(F.sum("_size").alias("_size")))
    targets = source_targets(slices, schedules, most)
    before_slice = Window.partitionBy(*KEY).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        slices.withColumn("_start", F.coalesce(F.sum("_size").over(before_slice), F.lit(0)))
        .drop("_size")
        .join(targets, KEY)
        .withColumn("_due", F.floor(F.col("target") + 0.5))
    )
    before = Window.partitionBy(*KEY, "_slice").orderBy("_digest").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("_inside", F.coalesce(F.sum("_size").over(before), F.lit(0))).join(starts, [*KEY, "_slice"])
    size, full = F.col("_size"), F.greatest(F.col("source_size"), F.lit(1))
    start = F.col("_start") + F.col("_inside")
    passes = F.floor(F.col("_due") / full)
    rest = F.least(F.greatest(F.col("_due") - passes * full - start, F.lit(0)), size)
    taken = (passes * size + rest).cast("long")

    def time(nth: Column) -> Column:
        share = F.least((nth * full + start) / F.nullif(F.col("target"), F.lit(0.0)), F.lit(1.0))
        return _by_turns([_time_of(share, s) for s in schedules], F.col("_rank"))

    copies = F.when(size > 0, passes + F.when(2 * rest >= size, 1).otherwise(0)).otherwise(0).cast("int")
    positions = F.when(copies > 0, F.transform(F.sequence(F.lit(0), F.greatest(copies, F.lit(1)) - 1), time)).otherwise(F.array().cast("array<double>"))
    position = F.when(taken > 0, time(F.lit(0)))
    made = [size, F.col("source_size"), F.col("target"), taken, position, positions]
    new = placed.select(*own, *[value.alias(f"_new_{name}") for name, value in zip(added, made)])
    return new.select(*[F.col(n).alias(c) for n, c in own.items() if c.lower() not in added], *[F.col(f"_new_{name}").alias(name) for name in added])


def in_training_order(
    docs: DataFrame, schedules: Sequence[Schedule] = CURRICULUM, most: int = MOST, doc_id: str = "doc_id", text: str = "text", source: str = "source"
) -> DataFrame:
    """The copies of ``docs`` that the mix takes, range-sorted by their positions; the columns are those of ``docs``.

    Whole documents only: one that is taken in part comes once more if the part is at least half of it. What has
    no words, or isn't taken, is left out. Ties go by doc_id and a hash of the text; a text itself is no sort key, as
    Spark samples the keys to find the ranges. Null and repeated doc_id and a null source are kept as in ``mix``.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    whole = docs.select(row.alias("_row"), F.col(doc_id).alias("_id"), F.col(text).alias("_text"), F.col(source).alias("_of"))
    placed = mix(whole, schedules, most, "_id", "_text", "_of").select("_row", F.explode("positions").alias("_position"))
    return placed.orderBy("_position", F.col(f"_row.`{doc_id}`"), F.xxhash64(F.col(f"_row.`{text}`"))).select("_row.*")


def _time_sql(share: str, schedule: Schedule) -> str:
    """``_time_of`` in SQL."""
    area, before, found = f"({share} * {integral(schedule)!r})", 0.0, ""
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        rest, slope = f"greatest({area} - {before!r}, 0.0::DOUBLE)", (w1 - w0) / (t1 - t0)
        root = f"sqrt(greatest({w0 * w0!r}::DOUBLE + {2 * slope!r}::DOUBLE * {rest}, 0.0::DOUBLE))"
        time = f"({t0!r}::DOUBLE + coalesce(2 * {rest} / nullif({w0!r}::DOUBLE + {root}, 0), 0.0::DOUBLE))"
        found = f"CASE WHEN {area} >= {before!r} THEN {time} ELSE {found} END" if found else time
        before += (t1 - t0) * (w0 + w1) / 2
    return found


#: DuckDB SQL for ``mix`` with the default schedules.
_SHARE = "least(CAST(start AS DOUBLE) / target, 1.0::DOUBLE)"
ORACLE = f"""
WITH d AS (
  SELECT doc_id, source IS NULL AS absent, coalesce(source, '') AS src, md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', coalesce(text, ''))) AS digest,
         CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size
  FROM documents),
s AS (SELECT absent, src, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY ALL),
r AS (SELECT *, CAST(1 + turn AS DOUBLE) AS weight FROM (SELECT *, (row_number() OVER (ORDER BY absent, src) - 1) % 3 AS turn FROM s)),
c AS (
  SELECT *, 3 * source_size / weight AS ratio,
         sum(source_size) OVER () AS total,
         coalesce(sum(3 * source_size) OVER o, 0) AS held,
         sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS free
  FROM r WINDOW o AS (ORDER BY 3 * source_size / weight, absent, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT CAST(total - held AS DOUBLE) / free AS level FROM c WHERE ratio >= CAST(total - held AS DOUBLE) / free
      ORDER BY ratio, absent, src LIMIT 1),
t AS (SELECT absent, src, source_size, weight, turn, CASE WHEN 3 * source_size < level * weight THEN CAST(3 * source_size AS DOUBLE)
             ELSE level * weight END AS target FROM r, l),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.weight, t.turn, CAST(floor(t.target + 0.5) AS BIGINT) AS due,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.absent, d.src ORDER BY d.digest
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN t USING (absent, src)),
k AS (
  SELECT *, CAST(due // greatest(source_size, 1) * size
                 + least(greatest(due - due // greatest(source_size, 1) * greatest(source_size, 1) - start, 0), size) AS BIGINT) AS taken
  FROM p)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken = 0 THEN NULL WHEN turn = 0 THEN {_time_sql(_SHARE, CURRICULUM[0])}
            WHEN turn = 1 THEN {_time_sql(_SHARE, CURRICULUM[1])} ELSE {_time_sql(_SHARE, CURRICULUM[2])} END AS position
FROM k
"""

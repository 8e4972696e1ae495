"""Checks of a table's bindings between cells and words, and cells read anew where words couldn't be bound.

A re-read replaces evidence only if its table qualifies, every asked cell came back whole and legible, all words find their
cell afterwards, no row falls into doubt and no number that a cell had is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.functions import boxes
from proofline.functions.shared import written
from proofline.operators.records import rows_in_doubt, text_lines
from proofline.operators.structure import assign_boxes

MOST_CELLS, LEAST_SIDE, LEAST_SCORE, MOST_LINES, MOST_TEXT = 12, 16, 0.5, 500, 10000
LEAST_COVERAGE, WHOLE = 0.7, 0.999
_NUMBER = "\\p{Nd}+(?:\\.\\p{Nd}+)?"  # fixed pattern


def _repeated(ids: Column) -> Column:
    """Whether an array holds a value twice, in one sort."""
    return F.size(F.array_distinct(ids)) < F.size(ids)


def trace_anomalies(traces: DataFrame) -> DataFrame:
    """(table_id, reasons, accepted) of traces (table_id, cells, words, physical_boxes), each checked in one pass over its arrays.

    ``cells`` are structs (cell_id, row, col, row_span, col_span, bbox, text, ocr_ids), ``words`` are (ocr_id, text, bbox). Reasons,
    in this order: ``cell_count`` (no cells, or not as many as physical boxes), ``repeated_cell_id``, ``repeated_position``,
    ``invalid_position``, ``missing_geometry``, ``repeated_word_id``, ``unknown_word`` (bound but not there), ``unbound_word``,
    ``word_bound_twice``, ``low_overlap`` (under 0.7 of a word in its cell), ``text_mismatch`` (a cell's text isn't its words' in
    order). Null arrays count as empty, a null text as blank; a null id or place is invalid. A trace without reasons is accepted.
    """
    empty = lambda name: F.coalesce(name, F.array().cast(traces.schema[name].dataType))
    rows = traces.select("table_id", "physical_boxes", empty("cells").alias("cells"), empty("words").alias("words"))
    bound = F.flatten(F.transform("cells", lambda c: F.coalesce(c["ocr_ids"], F.array().cast("array<long>"))))
    keyed = F.map_from_entries(F.array_distinct(F.transform(F.filter("words", lambda w: w["ocr_id"].isNotNull()), lambda w: F.struct(w["ocr_id"].cast("long"), w))))
    ids = F.transform("words", lambda w: w["ocr_id"].cast("long"))
    repeated = _repeated(ids) | F.exists(ids, lambda i: i.isNull())
    rows = rows.select("*", bound.alias("bound"), ids.alias("ids"), repeated.alias("repeated"))
    rows = rows.withColumn("by_id", F.when(~F.col("repeated"), keyed))  # looked up only where ids are unique

    at_least = lambda value, low: F.coalesce(value >= low, F.lit(False))
    valid = lambda c: c["cell_id"].isNotNull() & at_least(c["row"], 0) & at_least(c["col"], 0) & at_least(c["row_span"], 1) & at_least(c["col_span"], 1)
    has_box = lambda box: F.coalesce(boxes.is_valid(box) & (boxes.area(box) > 0), F.lit(False))
    own = lambda c: F.coalesce(c["ocr_ids"], F.array().cast("array<long>"))
    word = lambda i: F.try_element_at("by_id", i)
    folded = lambda text: F.trim(F.regexp_replace(text, "\\s+", " "))
    joined = lambda c: folded(F.array_join(F.transform(own(c), lambda i: F.coalesce(word(i)["text"], F.lit(""))), " "))
    low = lambda c: F.exists(own(c), lambda i: has_box(c["bbox"]) & (F.coalesce(boxes.coverage(c["bbox"], word(i)["bbox"]), F.lit(0.0)) < LEAST_COVERAGE))
    position = F.transform("cells", lambda c: F.struct(c["row"], c["col"], c["row_span"], c["col_span"]))
    rules = {
        "cell_count": (F.size("cells") == 0) | ~F.col("physical_boxes").eqNullSafe(F.size("cells")),
        "repeated_cell_id": _repeated(F.transform("cells", lambda c: c["cell_id"])), "repeated_position": _repeated(position),
        "invalid_position": F.exists("cells", lambda c: ~valid(c)), "missing_geometry": F.exists("cells", lambda c: ~has_box(c["bbox"])),
        "repeated_word_id": F.col("repeated"), "unknown_word": F.size(F.array_except("bound", "ids")) > 0,
        "unbound_word": F.size(F.array_except("ids", "bound")) > 0, "word_bound_twice": _repeated(F.col("bound")),
        "low_overlap": ~F.col("repeated") & F.exists("cells", low),
        "text_mismatch": ~F.col("repeated") & F.exists("cells", lambda c: folded(F.coalesce(c["text"], F.lit(""))) != joined(c)),
    }
    reasons = F.filter(F.array(*[F.when(rule, name) for name, rule in rules.items()]), lambda x: x.isNotNull())
    return rows.select("table_id", reasons.alias("reasons")).withColumn("accepted", F.size("reasons") == 0)


def plan_rereads(cells: DataFrame, words: DataFrame) -> DataFrame:
    """(table_id, cell_id, row, col, crop): the cells to read anew, for tables whose only fault is words without a cell.

    Cells are (table_id, cell_id, row, col, row_span, col_span, bbox), words (table_id, ocr_id, cell_id, bbox), ``cell_id`` null for a word that
    couldn't be bound. Each of these must lie wholly on at least two cells of one row without spans. A table asks for at most 12 cells,
    each at least 16 pixels wide and high within its whole pixels; one that fails anywhere asks for none.
    """
    lost = words.where("cell_id is null").select("table_id", "ocr_id", F.col("bbox").alias("w"))
    touched = lost.join(cells, "table_id", "left").withColumn("covered", F.coalesce(boxes.coverage(F.col("bbox"), F.col("w")), F.lit(0.0)))
    hit = F.col("covered") > 0
    per_word = touched.groupBy("table_id", "ocr_id").agg(
        F.count_if(hit).alias("n"), F.count_distinct(F.when(hit, F.col("row"))).alias("rows"), F.sum("covered").alias("covered"),
        F.coalesce(F.max(hit & ((F.col("row_span") != 1) | (F.col("col_span") != 1))), F.lit(False)).alias("spans"), F.collect_set(F.when(hit, F.col("cell_id"))).alias("ids"),
    )
    clear = (F.col("n") >= 2) & (F.col("rows") == 1) & ~F.col("spans") & (F.col("covered") >= WHOLE)
    tables = per_word.groupBy("table_id").agg(F.min(clear).alias("clear"), F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))
    asked = tables.where(F.col("clear") & (F.size("ids") <= MOST_CELLS)).select("table_id", F.explode("ids").alias("cell_id"))
    crop = F.array(F.ceil(F.col("bbox")[0]), F.ceil(F.col("bbox")[1]), F.floor(F.col("bbox")[2]), F.floor(F.col("bbox")[3]))
    found = asked.join(cells, ["table_id", "cell_id"]).select("table_id", "cell_id", "row", "col", crop.alias("crop"))
    narrow = (F.col("crop")[2] - F.col("crop")[0] < LEAST_SIDE) | (F.col("crop")[3] - F.col("crop")[1] < LEAST_SIDE)
    return found.withColumn("_bad", F.max(narrow).over(Window.partitionBy("table_id"))).where("not _bad").drop("_bad")


def _legible(lines: DataFrame, plan: DataFrame) -> DataFrame:
    """(table_id): tables of the plan whose every asked cell came back with right lines, and no other did."""
    joined = lines.withColumn("_there", F.lit(True)).join(plan.select("table_id", "cell_id", "crop"), ["table_id", "cell_id"], "full")
    joined = joined.join(plan.select("table_id").distinct(), "table_id", "left_semi")
    box, crop = F.col("bbox"), F.col("crop")
    inside = boxes.is_valid(box) & (boxes.area(box) > 0) & (box[0] >= crop[0]) & (box[1] >= crop[1]) & (box[2] <= crop[2]) & (box[3] <= crop[3])
    right = F.col("_there") & (F.trim(F.regexp_replace("text", "\\s+", " ")) != "") & (F.length("text") <= MOST_TEXT) & F.col("score").between(LEAST_SCORE, 1) & inside
    per_cell = joined.groupBy("table_id", "cell_id").agg(F.min(F.coalesce(right, F.lit(False))).alias("right"), F.count("*").alias("n"), F.count_distinct("bbox").alias("different"))
    whole = F.col("right") & (F.col("n") <= MOST_LINES) & (F.col("n") == F.col("different"))
    return per_cell.groupBy("table_id").agg(F.min(whole).alias("whole")).where("whole").select("table_id")


def apply_rereads(cells: DataFrame, words: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What becomes of the planned re-reads ``lines`` (table_id, cell_id, line_id, text, score, bbox).

    The first result has (table_id, accepted, reasons, lost_numbers) for each table with a plan, the second the words that an accepted
    table has then: (table_id, word_id, source, ocr_id, cell_id, text, bbox), ``source`` is ``original`` or ``reread`` (with its line_id as ocr_id).
    Words of the asked cells and those without a cell go, all others stay. ``lost_numbers`` counts the numbers, repeats included, that an
    asked cell had and its lines haven't.
    """
    plan = written(plan_rereads(cells, words))
    legible = written(_legible(lines, plan))
    asked = plan.select("table_id", "cell_id")
    stay = words.join(legible, "table_id", "left_semi").where("cell_id is not null").join(asked, ["table_id", "cell_id"], "left_anti")
    fresh = lines.join(legible, "table_id", "left_semi")
    both = stay.select("table_id", F.lit("original").alias("source"), F.col("cell_id").alias("of_cell"), F.col("ocr_id").cast("long").alias("ocr_id"), "text", "bbox").unionByName(
        fresh.select("table_id", F.lit("reread").alias("source"), F.col("cell_id").alias("of_cell"), F.col("line_id").cast("long").alias("ocr_id"), "text", "bbox")
    )
    order = Window.partitionBy("table_id").orderBy("source", "of_cell", "ocr_id", "bbox")
    both = written(both.withColumn("word_id", (F.row_number().over(order) - 1).cast("long")))
    assigned = assign_boxes(cells, both.select("table_id", F.col("word_id").alias("text_id"), "bbox")).withColumnRenamed("text_id", "word_id")
    placed = written(both.join(assigned, ["table_id", "word_id"], "left").select("table_id", "word_id", "source", "ocr_id", "cell_id", "text", "bbox"))

    number = lambda rows: rows.select("table_id", "cell_id", F.explode(F.regexp_extract_all("text", F.lit(_NUMBER), F.lit(0))).alias("number")).groupBy("table_id", "cell_id", "number")
    had = number(words.join(asked, ["table_id", "cell_id"], "left_semi")).agg(F.count("*").alias("had"))
    has = number(fresh).agg(F.count("*").alias("has"))
    gone = had.join(legible, "table_id", "left_semi").join(has, ["table_id", "cell_id", "number"], "left").withColumn("gone", F.greatest(F.col("had") - F.coalesce("has", F.lit(0)), F.lit(0)))
    gone = gone.groupBy("table_id").agg(F.sum("gone").alias("lost"))
    unbound = placed.groupBy("table_id").agg(F.count_if(F.col("cell_id").isNull()).alias("unbound"))
    bound = placed.where("cell_id is not null").select("table_id", "cell_id", F.col("word_id").alias("ocr_id"), "text", "bbox")
    doubt = rows_in_doubt(cells, text_lines(bound)).select("table_id").distinct().withColumn("doubt", F.lit(True))
    told = plan.select("table_id").distinct().join(legible.withColumn("legible", F.lit(True)), "table_id", "left").join(unbound, "table_id", "left").join(doubt, "table_id", "left").join(gone, "table_id", "left")
    rules = {"invalid_or_missing_reread": F.col("legible").isNull(), "unassigned_words": F.col("unbound") > 0, "aligned_multiline_rows": F.col("doubt"), "numbers_lost": F.col("lost") > 0}
    reasons = F.filter(F.array(*[F.when(rule, name) for name, rule in rules.items()]), lambda x: x.isNotNull())
    verdict = written(told.select("table_id", reasons.alias("reasons"), F.coalesce("lost", F.lit(0)).alias("lost_numbers")).withColumn("accepted", F.size("reasons") == 0))
    return verdict.select("table_id", "accepted", "reasons", "lost_numbers"), placed.join(verdict.where("accepted"), "table_id", "left_semi")

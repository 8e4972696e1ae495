"""Table rows that hold several records: text lines of cells, rows in doubt, and their split along typed labels.

Cells are rows (table_id, cell_id, row, col, row_span, col_span, header, bbox), words (table_id, cell_id, ocr_id, text,
bbox), each in one cell; an ocr_id is unique in its table. Boxes are [left, top, right, bottom]. All steps are keyed by
table_id, so one shuffle of the words and cells serves them, and none is needed where these are derived from rows that lie by
table already. What is collected is a cell's words, a row's lines or the plan of a table. A table whose split isn't certain in every row in doubt keeps its cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.functions import boxes
from proofline.functions.text import compatible

#: Fixed limits, heights in those of a text line.
MERGE_HEIGHT, ALIGN_HEIGHT, INDENT_HEIGHT, CORE_GAP = 0.35, 0.4, 0.35, 0.1
LEAST_LINES, LEAST_CELL_LINES, LEAST_COLUMNS, LEAST_SUPPORT = 3, 3, 3, 2
MOST_RECORDS, MOST_ROWS, MOST_WORDS, MOST_CELLS, MOST_TABLE_WORDS = 32, 8, 128, 5000, 10000

#: Fixed patterns: a number with at most a unit, and up to three words before a number.
_WORD = "[\\p{L}\\p{Nl}\\p{No}]+"
_NUMBER = "[+-]?\\p{Nd}+(?:[.,]\\p{Nd}+)?"
NUMBER_UNIT = f"^{_NUMBER}(?:\\s*({_WORD}(?:/{_WORD})?|%))?$"
PREFIX_NUMBER = f"^({_WORD}(?:[ -]+{_WORD}){{0,2}})\\s+{_NUMBER}(?:\\s|$)"


def typed_start(text: Column) -> Column:
    """``number_unit:kg`` for "5 kg", ``prefix_number:sample`` for "Sample 2 b", else null; NFKC, white space and case folded."""

    def kind(t: Column) -> Column:
        named = F.regexp_extract(t, PREFIX_NUMBER, 1)
        known = F.when(t.rlike(NUMBER_UNIT), F.concat(F.lit("number_unit:"), F.regexp_extract(t, NUMBER_UNIT, 1)))
        return F.when(F.length(t).between(1, 100), known.when(named != "", F.concat(F.lit("prefix_number:"), named)))

    return F.transform(F.array(F.trim(F.regexp_replace(compatible(text), "\\s+", " "))), kind)[0]


def _middle(sorted_values: Column) -> Column:
    """Median of a sorted array."""
    n = F.size(sorted_values)
    return (F.get(sorted_values, F.shiftright(n - 1, 1)) + F.get(sorted_values, F.shiftright(n, 1))) / 2


def _lines_of(w: str) -> Column:
    """The lines of a cell's words ``w`` (y, ocr_id, text, bbox), which are sorted: array<struct<line,y,height,left,text,ocr_ids,core_top,core_bottom>>."""
    falling = F.sort_array(F.transform(w, lambda x: x["bbox"][1] - x["bbox"][3]), asc=False)  # unknown heights go last
    height = _middle(F.transform(falling, lambda h: -h))

    def begins(starts: Column, i: Column, limit: Column) -> Column:
        start = F.element_at(starts, -1)
        low, high = F.get(w, start + F.shiftright(i - start - 1, 1)), F.get(w, start + F.shiftright(i - start, 1))
        apart = F.abs(F.get(w, i)["y"] - (low["y"] + high["y"]) / 2) > limit
        return F.when(apart, F.concat(starts, F.array(i))).otherwise(starts)

    def line(words: Column, k: Column, h: Column) -> Column:
        across = F.sort_array(F.transform(words, lambda x: F.struct(x["bbox"][0].alias("left"), x["ocr_id"].alias("ocr_id"), x["text"].alias("text"))))
        return F.transform(F.array(across), lambda a: F.struct(
            k.alias("line"), _middle(F.transform(words, lambda x: x["y"])).alias("y"), h.alias("height"), a[0]["left"].alias("left"),
            F.array_join(F.transform(a, lambda x: x["text"]), " ").alias("text"), F.transform(a, lambda x: x["ocr_id"]).alias("ocr_ids"),
            F.array_min(F.transform(words, lambda x: boxes.core(x["bbox"])[1])).alias("core_top"), F.array_max(F.transform(words, lambda x: boxes.core(x["bbox"])[3])).alias("core_bottom"),
        ))[0]

    def cut(h: Column) -> Column:  # a variable of a lambda is computed once, so the height isn't computed anew for each word
        rest = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: i > 0)
        starts = F.aggregate(rest, F.filter(F.array(F.lit(0)), lambda _: F.size(w) > 0), lambda found, i: begins(found, i, h * MERGE_HEIGHT))
        return F.transform(F.array(starts), lambda s: F.transform(s, lambda at, k: line(F.slice(w, at + 1, F.coalesce(F.get(s, k + 1), F.size(w)) - at), k, h)))[0]

    return F.transform(F.array(height), cut)[0]


def _word() -> Column:
    y = (F.col("bbox")[1] + F.col("bbox")[3]) / 2
    return F.struct(y.alias("y"), "ocr_id", F.coalesce("text", F.lit("")).alias("text"), "bbox")


def text_lines(words: DataFrame) -> DataFrame:
    """(table_id, cell_id, line, y, height, left, text, ocr_ids, core_top, core_bottom): the words of a cell as lines, from the top.

    By its middle a word joins the line above as long as it is within 0.35 of the cell's median word height of that line's
    running median. Words of a line go from the left, ties by ocr_id. A null text is empty.
    """
    cells = words.groupBy("table_id", "cell_id").agg(F.sort_array(F.collect_list(_word())).alias("w"))
    return cells.select("table_id", "cell_id", F.inline(_lines_of("w")))


def _with_lines(cells: DataFrame, lines: DataFrame) -> DataFrame:
    """Cells with their ``lines`` as an array from the top, empty for a cell without words."""
    line = F.struct("line", "y", "height", "left", "text", "ocr_ids", "core_top", "core_bottom")
    arrays = lines.groupBy("table_id", "cell_id").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    joined = cells.join(arrays, ["table_id", "cell_id"], "left")
    return joined.withColumn("lines", F.coalesce("lines", F.array().cast(arrays.schema["lines"].dataType)))


def _aligned(y: Column, height: Column, other: Column) -> Column:
    return F.abs(y - other["y"]) <= F.least(height, other["height"]) * ALIGN_HEIGHT


def _matched(a: Column | str, b: Column | str) -> Column:
    """How many lines of ``a`` find a free line of ``b``: each takes the nearest one, if it is level with it."""

    def take(used: Column, line: Column) -> Column:
        free = F.filter(F.sequence(F.lit(0), F.size(b) - 1), lambda j: ~F.array_contains(used, j))
        best = F.array_min(F.transform(free, lambda j: F.struct(F.abs(line["y"] - F.get(b, j)["y"]).alias("d"), j.alias("j"))))
        return F.when(_aligned(line["y"], line["height"], F.get(b, best["j"])), F.array_append(used, best["j"])).otherwise(used)

    return F.size(F.aggregate(a, F.array().cast("array<int>"), take))


def rows_in_doubt(cells: DataFrame, lines: DataFrame) -> DataFrame:
    """(table_id, row, cell_id, other_id, aligned): pairs of cells of a row with at least three lines side by side.

    Only cells without spans that are no headers, hold three lines and are three lines high are compared. Each line of the cell
    with the smaller cell_id takes the nearest free line of the other, if it is within 0.4 of a line's height.
    """
    high = F.col("bbox")[3] - F.col("bbox")[1] >= F.col("lines")[0]["height"] * LEAST_CELL_LINES
    single = ~F.coalesce("header", F.lit(False)) & (F.col("row_span") == 1) & (F.col("col_span") == 1)
    several = _with_lines(cells.where(single), lines).where((F.size("lines") >= LEAST_LINES) & high)
    left = several.select("table_id", "row", "col", "cell_id", F.col("lines").alias("a"))
    right = several.select("table_id", "row", F.col("col").alias("other_col"), F.col("cell_id").alias("other_id"), F.col("lines").alias("b"))
    pairs = left.join(right, ["table_id", "row"]).where("cell_id < other_id and col <> other_col")
    return pairs.select("table_id", "row", "cell_id", "other_id", _matched("a", "b").alias("aligned")).where(F.col("aligned") >= LEAST_LINES)


def _owned(cells: DataFrame, words: DataFrame) -> DataFrame:
    """Cells with their words as an array ``w`` and the sizes of their table, by one shuffle of both by table_id, or none where they lie so already."""
    word, cell = _word(), F.struct(*(F.col(c) for c in ("row", "col", "row_span", "col_span", "header", "bbox")))
    of_cells, of_words = cells.select("table_id", "cell_id", cell.alias("c")), words.select("table_id", "cell_id", word.alias("w"))
    none = lambda rows, name: F.lit(None).cast(rows.schema[name].dataType).alias(name)
    both = of_cells.select("*", none(of_words, "w")).unionByName(of_words.select("*", none(of_cells, "c")))
    table = Window.partitionBy("table_id")
    sizes = {"cells": F.count("c"), "words": F.count("w"), "rows": F.max(F.col("c.row") + F.col("c.row_span")), "cols": F.max(F.col("c.col") + F.col("c.col_span"))}
    both = both.withColumns({name: size.over(table) for name, size in sizes.items()})
    own = F.when(F.col("cell_id").isNotNull(), F.col("w"))
    held = both.groupBy("table_id", "cell_id").agg(F.collect_list("c").alias("c"), F.collect_list(own).alias("w"), *(F.first(name).alias(name) for name in sizes))
    return held.select("table_id", "cell_id", F.explode("c").alias("c"), "w", *sizes).select("table_id", "cell_id", "c.*", "w", *sizes)


def _doubtful_rows(owned: DataFrame) -> DataFrame:
    """(table_id, row, top, bottom, scale, faults, held, rows, cols) of each row in doubt: its cells with their lines, and what forbids its split whatever these are."""
    lined = owned.withColumn("w", F.sort_array("w"))
    lined = lined.select("*", _lines_of("w").alias("lines"), F.transform("w", lambda x: x["bbox"][3] - x["bbox"][1]).alias("h"), F.size("w").alias("size")).drop("w")
    top, bottom = F.col("bbox")[1], F.col("bbox")[3]
    odd = (F.col("row_span") != 1) | (F.col("col_span") != 1) | F.coalesce("header", F.lit(False))
    high = bottom - top >= F.get("lines", F.lit(0))["height"] * LEAST_CELL_LINES
    several = F.coalesce(~odd & (F.size("lines") >= LEAST_LINES) & high, F.lit(False))
    reach = F.posexplode_outer(F.sequence("row", F.col("row") + F.col("row_span") - 1)).alias("_nth", "_at")
    spread = lined.select("*", odd.alias("odd"), several.alias("several"), top.alias("top"), bottom.alias("bottom"), reach)
    own, there = F.coalesce(F.col("_nth") == 0, F.lit(True)), F.col("_at").isNotNull()  # a row's own cells, and all that cover it
    rows = spread.groupBy("table_id", F.coalesce("_at", "row").alias("row")).agg(
        F.count_if(there).alias("n"), F.max(F.when(there, F.col("odd"))).alias("odd"), F.max(F.when(there, F.col("top"))).alias("top"), F.min(F.when(there, F.col("top"))).alias("_t"),
        F.min(F.when(there, F.col("bottom"))).alias("bottom"), F.max(F.when(there, F.col("bottom"))).alias("_b"), F.max(F.when(own, F.col("size"))).alias("most"),
        F.collect_list(F.when(own, F.col("h"))).alias("h"), F.collect_list(F.when(own, F.struct("cell_id", "col", "several", "lines"))).alias("held"), F.first("rows").alias("rows"), F.first("cols").alias("cols"),
    )
    meets = lambda x, y: (x["cell_id"] < y["cell_id"]) & (x["col"] != y["col"]) & (_matched(x["lines"], y["lines"]) >= LEAST_LINES)
    beside = lambda held: F.exists(held, lambda x: F.exists(held, lambda y: F.coalesce(meets(x, y), F.lit(False))))
    doubt = F.transform(F.array(F.filter("held", lambda c: c["several"])), beside)[0]
    found = rows.where(F.col("row").isNotNull()).where(doubt).withColumn("targets", F.count("*").over(Window.partitionBy("table_id")))
    rules = {
        "unsupported_row_count": F.col("targets") > MOST_ROWS, "unverified_body_row": F.col("row") == 0,
        "span_or_header": F.col("odd") | (F.col("n") != F.col("cols")) | (F.col("cols") < LEAST_COLUMNS),
        "inconsistent_geometry": (F.col("top") - F.col("_t") > 1e-6) | (F.col("_b") - F.col("bottom") > 1e-6), "excessive_words": F.col("most") > MOST_WORDS,
    }
    faults = F.filter(F.array(*[F.when(rule, name) for name, rule in rules.items()]), lambda x: x.isNotNull())
    return found.select("table_id", "row", "top", "bottom", _middle(F.array_sort(F.flatten("h"))).alias("scale"), faults.alias("faults"), "held", "rows", "cols")


#: What is known of a row, and goes with it from step to step.
_ROW = ("top", "bottom", "scale", "faults", "rows", "cols")


def _first(*names: str) -> list[Column]:
    return [F.first(name).alias(name) for name in names]


def _typed_rows(doubtful: DataFrame) -> DataFrame:
    """Rows in doubt whose lines have their label as ``typed``, and whose cells are ``numeric`` if all their labels are the same number with a unit."""
    lines = doubtful.select("table_id", "row", *_ROW, F.explode("held").alias("c")).select("table_id", "row", *_ROW, "c.cell_id", F.explode_outer("c.lines").alias("l"))
    lines = lines.withColumn("typed", typed_start(F.col("l.text"))).repartition("table_id")  # Python loses how rows are dealt out
    cells = lines.groupBy("table_id", "row", "cell_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("l").isNotNull(), F.struct("l.line", "l.y", "l.height", "l.left", "l.text", "l.ocr_ids", "l.core_top", "l.core_bottom", "typed")))).alias("lines"), *_first(*_ROW)
    )
    label = F.get("lines", F.lit(0))["typed"]
    numeric = F.size("lines").between(LEAST_LINES, MOST_RECORDS) & F.coalesce(label.startswith("number_unit:") & F.forall("lines", lambda x: x["typed"].eqNullSafe(label)), F.lit(False))
    return cells.groupBy("table_id", "row").agg(F.collect_list(F.struct("cell_id", numeric.alias("numeric"), "lines")).alias("held"), *_first(*_ROW))


def _placed_lines(rows: DataFrame) -> DataFrame:
    """Each line of a row with its record by each anchor cell's lines, whether it starts it, and what is wrong with that; a row without an anchor is one line without one.

    A line level with one anchor line starts that record. Any other belongs to the last record that began above it, if it is
    indented against that record's start or follows a hyphen, and doesn't itself look like a label.
    """
    met = rows.select("table_id", "row", *_ROW, "held", F.explode_outer(F.filter("held", lambda c: c["numeric"])).alias("anchor"))
    met = met.select("table_id", "row", *_ROW, F.size("held").alias("cells"), "anchor", F.explode_outer(F.when(F.col("anchor").isNotNull(), F.col("held"))).alias("c"))
    met = met.select("table_id", "row", *_ROW, "cells", F.col("anchor.cell_id").alias("anchor_id"), F.col("anchor.lines").alias("a"), "c.cell_id", F.explode_outer("c.lines").alias("l"))
    met = met.where("anchor_id is null or l is not null")
    place = F.filter(F.sequence(F.lit(0), F.size("a")), lambda i: i < F.size("a"))
    level = F.filter(place, lambda i: _aligned(F.col("l.y"), F.col("l.height"), F.get("a", i)))
    reach = lambda i: F.least(F.col("l.height"), F.get("a", i)["height"]) * ALIGN_HEIGHT
    above = F.filter(place, lambda i: F.col("l.y") > F.get("a", i)["y"] + reach(i))
    met = met.withColumns({"level": level, "above": F.array_max(above), "records": F.size("a")}).withColumn("starts", F.size("level") == 1)
    met = met.withColumn("record", F.when(F.col("starts"), F.get("level", F.lit(0))).otherwise(F.col("above"))).withColumn("after", F.get("a", F.col("record") + 1))
    met = met.select("table_id", "row", *_ROW, "cells", "anchor_id", "cell_id", "records", "starts", "record", F.size("level").alias("levels"), F.col("after.y").alias("after_y"), F.col("after.height").alias("after_height"), "l.*")
    within = Window.partitionBy("table_id", "row", "anchor_id", "cell_id", "record").orderBy(F.desc("starts"), "line")
    before = F.rtrim(F.lag("text").over(within))
    hyphen = before.endswith("-") | before.endswith("\u00ad") | before.endswith("‐")
    indented = F.col("left") - F.first("left").over(within) >= F.col("height") * INDENT_HEIGHT
    goes_on = F.col("typed").isNull() & (indented | F.coalesce(hyphen, F.lit(False)))
    wrong = (
        F.when(F.col("levels") > 1, "ambiguous_record_start").when(F.col("record").isNull(), "continuation_before_first_record")
        .when(F.col("starts"), F.when(F.lag("starts").over(within), "multiple_starts_in_record"))
        .when(F.col("y") >= F.col("after_y") - F.least(F.col("height"), F.col("after_height")) * ALIGN_HEIGHT, "ambiguous_continuation_boundary")
        .when(~goes_on, "unsupported_continuation")
    )
    return met.withColumn("wrong", wrong)


def _parts(lines: Column) -> Column:
    """array<struct<record,ocr_ids,text>> of a cell's placed lines."""
    ordered = F.array_sort(F.transform(lines, lambda x: F.struct((~x["starts"]).alias("later"), x["line"].alias("line"), x["ocr_ids"].alias("ocr_ids"), x["text"].alias("text"), x["record"].alias("record"))))

    def part(own: Column, record: Column) -> Column:
        mine = F.filter(own, lambda x: x["record"].eqNullSafe(record))
        return F.struct(record.alias("record"), F.flatten(F.transform(mine, lambda x: x["ocr_ids"])).alias("ocr_ids"), F.array_join(F.transform(mine, lambda x: x["text"]), " ").alias("text"))

    return F.transform(F.array(ordered), lambda own: F.transform(F.array_distinct(F.transform(own, lambda x: x["record"])), lambda r: part(own, r)))[0]


def _judged_rows(owned: DataFrame) -> DataFrame:
    """(table_id, row, records, boundaries, reasons, parted, rows, cols) of each row in doubt; ``parted`` are its cells with their parts by the chosen anchor."""
    placed = _placed_lines(_typed_rows(_doubtful_rows(owned)))
    by_anchor, carried = ["table_id", "row", "anchor_id"], (*_ROW, "cells", "records")
    line = F.struct("cell_id", "record", "line", "ocr_ids", "starts", "text", "core_top", "core_bottom")
    per_cell = placed.groupBy(*by_anchor, "cell_id").agg(
        F.count_if("starts").alias("starts"), F.collect_set(F.when(F.col("starts"), F.col("typed"))).alias("kinds"), F.count_if(F.col("starts") & F.col("typed").isNull()).alias("untyped"),
        F.collect_set("wrong").alias("wrong"), F.collect_list(line).alias("lines"), *_first(*carried),
    )
    supports = (F.size("kinds") == 1) & (F.col("untyped") == 0) & (F.col("cell_id") != F.col("anchor_id"))
    judged = per_cell.groupBy(*by_anchor).agg(
        F.count("*").alias("n"), F.count_if(supports).alias("support"), F.max(F.col("starts") < F.col("records")).alias("missing"), F.array_distinct(F.flatten(F.collect_list("wrong"))).alias("wrong"),
        F.flatten(F.collect_list("lines")).alias("lines"), F.collect_list(F.struct("cell_id", _parts(F.col("lines")).alias("parts"))).alias("parted"), *_first(*carried),
    )

    def core(record: Column) -> Column:
        of = F.filter("lines", lambda x: x["record"] == record)
        return F.struct(record.alias("record"), F.array_min(F.transform(of, lambda x: x["core_top"])).alias("start"), F.array_max(F.transform(of, lambda x: x["core_bottom"])).alias("end"))

    cores = F.transform(F.array_sort(F.array_distinct(F.filter(F.transform("lines", lambda x: x["record"]), lambda r: r.isNotNull()))), core)
    judged = judged.withColumn("cores", F.when(F.col("anchor_id").isNotNull(), cores))
    judged = judged.withColumn("spans", F.transform("cores", lambda c, i: F.struct(c["record"].alias("record"), c["start"].alias("start"), c["end"].alias("end"), F.get("cores", i - 1)["end"].alias("before"))))
    holds = lambda test: F.coalesce(F.exists("spans", test), F.lit(False))
    cuts = F.transform(F.filter("spans", lambda c: c["record"] > 0), lambda c: (c["before"] + c["start"]) / 2)
    checks = F.array(
        F.when(F.col("missing") | (F.col("n") < F.col("cells")), "missing_record_start"), F.when(F.col("support") < LEAST_SUPPORT, "insufficient_labels"),
        F.when(holds(lambda c: (c["start"] < F.col("top")) | (c["end"] > F.col("bottom"))), "outside_row"), F.when(holds(lambda c: c["start"] - c["before"] < F.col("scale") * CORE_GAP), "overlapping_records"),
    )
    reasons = F.when(F.size("cores") > 0, F.filter(F.concat("wrong", checks), lambda x: x.isNotNull()))  # null for a row without an anchor
    signature = F.sha2(F.to_json(F.array_sort(F.transform("lines", lambda x: F.struct(x["cell_id"].alias("cell_id"), x["record"].alias("record"), x["line"].alias("line"), x["ocr_ids"].alias("ocr_ids"))))), 256)
    tried = judged.select(*by_anchor, *_ROW, "records", "parted", cuts.alias("cuts"), signature.alias("signature"), reasons.alias("reasons"))
    right = F.coalesce(F.size("reasons") == 0, F.lit(False))
    best = tried.groupBy("table_id", "row").agg(
        F.min_by(F.struct("records", "cuts", "parted"), F.when(right, F.col("anchor_id"))).alias("b"), F.size(F.collect_set(F.when(right, F.col("signature")))).alias("ways"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("why"), *_first(*_ROW),
    )
    told = F.when(F.col("ways") == 0, F.concat(F.array(F.lit("no_record_partition")), "why")).when(F.col("ways") > 1, F.array(F.lit("conflicting_anchors"))).otherwise(F.array().cast("array<string>"))
    return best.select(
        "table_id", "row", F.col("b.records").alias("records"), F.concat(F.array("top"), "b.cuts", F.array("bottom")).alias("boundaries"), F.concat("faults", told).alias("reasons"), F.col("b.parted").alias("parted"), "rows", "cols",
    )


def propose_records(cells: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The split of each row in doubt: (table_id, row, records, boundaries, reasons), and its parts (table_id, row, cell_id, record, ocr_ids, text).

    A column of three to 32 lines that are all numbers of the same unit (an anchor) says where records begin; at least two other
    columns must begin theirs with labels of one kind. Records may not overlap in the middles of their lines, and all anchors of
    a row that are right must agree. ``reasons`` is empty for a row that may be split; parts are given for those rows.
    """
    judged = _judged_rows(_owned(cells, words))
    parts = judged.where(F.size("reasons") == 0).select("table_id", "row", F.explode("parted").alias("c")).select("table_id", "row", "c.cell_id", F.inline("c.parts"))
    return judged.select("table_id", "row", "records", "boundaries", "reasons"), parts


def split_records(cells: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells with each row in doubt split into its records, and the audit of ``propose_records``.

    Cells come as (table_id, source_id, row, col, row_span, col_span, header, bbox, record, operation, ocr_ids, text):
    ``operation`` is ``split``, ``moved`` (below a split row) or ``unchanged``. A table is split only if all its rows in
    doubt may be and the result has at most 5,000 cells; a table of more than 5,000 cells or 10,000 words is left as it is. Every word comes
    out once. Text of cells that aren't split is in the order of ocr_id. A table is folded by itself, in ``record_folds``.
    """
    from proofline.operators.record_folds import split_tables

    judged = _judged_rows(_owned(cells, words).where((F.col("words") <= MOST_TABLE_WORDS) & (F.col("cells") <= MOST_CELLS)))
    return split_tables(_gathered(cells, words)), judged.select("table_id", "row", "records", "boundaries", "reasons")


def _gathered(cells: DataFrame, words: DataFrame) -> DataFrame:
    """(table_id, cells, words) of each table that has a cell, as arrays, by one shuffle of both by table_id."""
    cell = F.struct("cell_id", *(F.col(name).cast(kind).alias(name) for name, kind in (("row", "int"), ("col", "int"), ("row_span", "int"), ("col_span", "int"))), "header", "bbox")
    word = F.struct("cell_id", F.col("ocr_id").cast("long").alias("ocr_id"), "text", "bbox")
    both = cells.select("table_id", cell.alias("c")).unionByName(words.select("table_id", word.alias("w")), allowMissingColumns=True)
    return both.groupBy("table_id").agg(F.collect_list("c").alias("cells"), F.collect_list("w").alias("words")).where(F.size("cells") > 0)

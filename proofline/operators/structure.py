"""Layout blocks: reading order, section paths and evidence around figures and formulas."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.functions import boxes
from proofline.functions.shared import small_batches

#: Shares of the page width and the kinds of blocks that stay together.
SPANNING_WIDTH, GUTTER, COLUMN_GAP = 0.72, 0.04, 0.015
#: Headings of the first level, and the numbered and lettered forms.
TOP_HEADINGS = frozenset(
    (
        "abstract", "references", "bibliography", "acknowledgment", "acknowledgments", "acknowledgement", "acknowledgements", "limitations",
        "ethics statement", "appendix", "introduction", "related work", "background", "method", "methods", "results", "discussion", "conclusion",
        "conclusions",
    )
)
_NUMBERED, _LETTERED = re.compile(r"^(\d+(?:\.\d+)*)[.)]?\s+\S"), re.compile(r"^([A-Z](?:\.\d+)*)[.)]?\s+\S")


def reading_order(blocks: DataFrame) -> DataFrame:
    """``blocks`` (paper_id, page, ord, bbox) with reading_index and order_method.

    Boxes have their origin at the bottom left. On a page whose boxes are all valid, blocks that span the page
    divide it into bands from the top; in each band the left column comes before the right one. On other pages the
    original order stays. All of it is windows over the page, so pages are independent.
    """
    page = Window.partitionBy("paper_id", "page")
    box = F.col("bbox")
    valid = F.min(boxes.is_valid(box).cast("int")).over(page) == 1
    left, right = F.min(box[0]).over(page), F.max(box[2]).over(page)
    marked = blocks.withColumns({"_valid": valid, "_left": left, "_width": right - left})
    middle = F.col("_left") + F.col("_width") / 2
    crosses = (box[0] < middle - GUTTER * F.col("_width")) & (box[2] > middle + GUTTER * F.col("_width"))
    marked = marked.withColumn("_spans", F.coalesce(crosses | (box[2] - box[0] >= SPANNING_WIDTH * F.col("_width")), F.lit(False)))
    side = F.when((box[0] + box[2]) / 2 < middle, 0).otherwise(1)
    marked = marked.withColumn("_side", F.when(F.col("_spans"), None).otherwise(side))
    gap = F.min(F.when(F.col("_side") == 1, box[0])).over(page) - F.max(F.when(F.col("_side") == 0, box[2])).over(page)
    marked = marked.withColumn("_columns", F.coalesce(gap >= COLUMN_GAP * F.col("_width"), F.lit(False)))
    # a block lies in the band below all spanning blocks that begin higher on the page
    downwards = page.orderBy(F.desc(box[3]), "ord")
    spans_above = F.sum(F.when(F.col("_spans"), 1).otherwise(0)).over(downwards.rowsBetween(Window.unboundedPreceding, 0))
    keys = [
        F.when(F.col("_valid"), F.when(F.col("_spans"), 2 * F.col("_above") - 1).otherwise(2 * F.col("_above"))).otherwise(0),
        F.when(F.col("_valid") & F.col("_columns"), F.coalesce("_side", F.lit(0))).otherwise(0),
        F.when(F.col("_valid"), -box[3]).otherwise(0.0),
        F.when(F.col("_valid"), box[0]).otherwise(0.0),
        F.col("ord"),
    ]
    placed = marked.withColumn("_above", spans_above)
    method = F.when(~F.col("_valid"), "original").when(F.col("_columns"), "two_columns").otherwise("one_column")
    return placed.withColumns({"reading_index": F.row_number().over(page.orderBy(*keys)), "order_method": method}).drop(
        "_valid", "_left", "_width", "_spans", "_side", "_columns", "_above"
    )


#: Fixed patterns: a section number within a heading, and an appendix by its word and letter.
_NUMBER_WITHIN = re.compile(r"(?<!\S)(\d+(?:\.\d+)*)[.)]?\s+")
_APPENDIX_LETTER, _APPENDIX_ROOTS = re.compile(r"^Appendix\s+([A-Z](?:\.\d+)*)[.):]?\s+\S", re.I), ("appendix", "appendices", "appendix overview")


def merged_headings(text: str | None) -> list[str]:
    """The headings that one line has run together: it is cut before each number that can follow the one before.

    After 2.1 come 2.2 and 2.1.x. A line that doesn't begin with a number is one heading; an empty one is none.
    """
    line = (text or "").strip()
    numbers = [(m.start(), tuple(map(int, m[1].split(".")))) for m in _NUMBER_WITHIN.finditer(line)]
    if not numbers or numbers[0][0] > 0:
        return [line] if line else []
    cuts, last = [0], numbers[0][1]
    for at, number in numbers[1:]:
        if number[:-1] == last or number == (*last[:-1], last[-1] + 1):
            cuts.append(at)
            last = number
    return [line[a:b].strip() for a, b in zip(cuts, [*cuts[1:], len(line)])]


def split_headings(blocks: DataFrame) -> DataFrame:
    """``blocks`` (type, text) with a row for each heading that was run together, as ``part`` from 0; other blocks stay."""

    @F.arrow_udf("array<string>")
    def parts(column: pa.Array) -> pa.Array:
        return pa.array([merged_headings(text.as_py()) for text in column], pa.list_(pa.string()))

    names = [c for c in blocks.columns if c != "text"]
    several = F.when(F.col("type") == "heading", parts(F.col("text"))).otherwise(F.array("text"))
    return blocks.select(*names, F.posexplode_outer(several).alias("part", "text")).withColumn("part", F.coalesce("part", F.lit(0)))


def title_blocks(blocks: DataFrame) -> DataFrame:
    """(paper_id, ord) of each paper's title: its title block, else the first of several headings, unless that is
    numbered or names a usual section. Papers without either have none."""
    first = blocks.groupBy("paper_id").agg(
        F.min(F.when(F.col("type") == "title", F.col("ord"))).alias("title"), F.count_if(F.col("type") == "heading").alias("headings"),
        F.min(F.when(F.col("type") == "heading", F.struct("ord", F.trim("text").alias("text")))).alias("h"),
    )
    name = F.lower(F.trim(F.regexp_replace("h.text", "[.:]+$", "")))
    usual = name.isin(*sorted(TOP_HEADINGS)) | F.col("h.text").rlike(_NUMBERED.pattern)
    ord_ = F.coalesce("title", F.when((F.col("headings") >= 2) & ~usual, F.col("h.ord")))
    return first.select("paper_id", ord_.alias("ord")).where("ord is not null")


def special_sections(paths: DataFrame) -> DataFrame:
    """``paths`` (section_path, ...) with section_kind: abstract or appendix by the innermost such section, else null."""
    bare = lambda title: F.lower(F.trim(F.regexp_replace(title, "[.:]+$", "")))
    kinds = F.transform(
        "section_path",
        lambda title: F.when(bare(title) == "abstract", "abstract")
        .when(bare(title).isin(*_APPENDIX_ROOTS) | title.rlike(f"(?i){_APPENDIX_LETTER.pattern}") | title.rlike(_LETTERED.pattern), "appendix"),
    )
    return paths.withColumn("section_kind", F.get(F.reverse(F.array_compact(kinds)), F.lit(0)))


def figure_claims(blocks: DataFrame) -> DataFrame:
    """(paper_id, caption_ord, figure_ord): captions in order, each with the nearest figure of its page that no caption before has.

    Figures that carry the caption's number themselves come first, of equally near ones the one before. A caption
    that names no figure claims none. Which figure is left depends on the captions before, so each paper is folded
    by itself; captions without a free figure are left out.
    """
    told = blocks.withColumn("number", label_number(F.col("text"), "figure")).where((F.col("type") == "figure") | ((F.col("type") == "caption") & F.col("number").isNotNull()))

    @F.arrow_udf("array<struct<caption_ord:int,figure_ord:int>>")
    def claims(column: pa.Array) -> pa.Array:
        return pa.array([claimed(paper.as_py()) for paper in column], pa.list_(pa.struct([("caption_ord", pa.int32()), ("figure_ord", pa.int32())])))

    block = F.struct(F.col("ord").cast("int").alias("ord"), "type", "page", "number")
    papers = small_batches(told).groupBy("paper_id").agg(F.sort_array(F.collect_list(block)).alias("b"))
    return papers.select("paper_id", F.inline(claims("b")))


def claimed(blocks: list[dict]) -> list[dict]:
    """The captions of one paper in order, each with the figure that it claims."""
    free = [b for b in blocks if b["type"] == "figure"]
    found = []
    for caption in (b for b in blocks if b["type"] == "caption"):
        here = [f for f in free if f["page"] is not None and f["page"] == caption["page"]]
        pool = [f for f in here if f["number"] == caption["number"]] or here
        if pool:
            nearest = min(pool, key=lambda f: (abs(f["ord"] - caption["ord"]), f["ord"] > caption["ord"]))
            found.append({"caption_ord": caption["ord"], "figure_ord": nearest["ord"]})
            free = [f for f in free if f["ord"] != nearest["ord"]]
    return found


def heading_level(text: str, ancestors: list[tuple[int, str]]) -> int:
    """The level of a heading: by its number, its letter or its name, else one below the nearest known one."""
    title = text.strip()
    if title.lower().rstrip(":") in TOP_HEADINGS:
        return 1
    if title.lower().rstrip(".:").strip() in _APPENDIX_ROOTS:
        return 1
    number = _APPENDIX_LETTER.match(title) or _NUMBERED.match(title) or _LETTERED.match(title)
    if number:
        return number[1].count(".") + 1
    return ancestors[-1][0] + 1 if ancestors else 1


def stacked(headings: list[str | None]) -> list[dict]:
    """Level and section path at each block of a paper, of which the headings are given and other blocks are null."""
    stack, rows, path = [], [], []
    for text in headings:
        level = None
        if (text or "").strip():
            level = heading_level(text, stack)
            while stack and stack[-1][0] >= level:
                stack.pop()
            stack.append((level, text.strip()))
            path = [title for _, title in stack]
        rows.append({"level": level, "section_path": path})
    return rows


_PLACE = pa.struct([("level", pa.int32()), ("section_path", pa.list_(pa.string()))])


def with_section_paths(blocks: DataFrame) -> DataFrame:
    """``blocks`` (paper_id, ord, type, text, ...) with level and section_path: the headings that each stands under, the outermost first.

    A heading closes those of its level and deeper ones. The stack is a fold over one paper, so a paper's blocks are gathered
    in one shuffle; only the headings go through Python, many papers at once.
    """

    @F.arrow_udf("array<struct<level:int,section_path:array<string>>>")
    def paths(column: pa.Array) -> pa.Array:
        return pa.array([stacked(headings.as_py()) for headings in column], pa.list_(_PLACE))

    block = F.struct("ord", *(F.col(c) for c in blocks.columns if c not in ("paper_id", "ord")))
    papers = small_batches(blocks).groupBy("paper_id").agg(F.sort_array(F.collect_list(block)).alias("b"))
    headings = F.transform("b", lambda b: F.when(b["type"] == "heading", b["text"]))
    found = papers.select("paper_id", "b", paths(headings).alias("p")).select("paper_id", F.inline(F.arrays_zip("b", "p")))
    return found.select("paper_id", "b.*", "p.*").select(*blocks.columns, "level", "section_path")


def section_paths(blocks: DataFrame) -> DataFrame:
    """(paper_id, ord, level, section_path) of ``with_section_paths``; other texts than headings aren't moved."""
    heading = F.when(F.col("type") == "heading", F.col("text"))
    return with_section_paths(blocks.select("paper_id", F.col("ord").cast("int").alias("ord"), "type", heading.alias("text"))).select("paper_id", "ord", "level", "section_path")


def label_number(text: Column, kind: str) -> Column:
    """The number of a leading label such as ``Table 2`` or ``Fig. A.1``; null without one."""
    words = {"table": "table|tab\\.?|表", "figure": "figure|fig\\.?|图"}[kind]
    found = F.regexp_extract(text, f"(?i)^[\\s*_#>\\-\\[(]*(?:{words})\\s*([A-Za-z]?\\.?\\d+(?:\\.\\d+)*[a-z]?)", 1)
    return F.when(found != "", found)


def caption_targets(blocks: DataFrame, kind: str) -> DataFrame:
    """(paper_id, caption_ord, target_ord): each caption with the nearest block of ``kind`` on its page.

    Of equally near ones the earlier. Captions are blocks of type caption whose label is of that kind.
    """
    captions = blocks.where((F.col("type") == "caption") & label_number(F.col("text"), kind).isNotNull()).select("paper_id", "page", F.col("ord").alias("caption_ord"))
    targets = blocks.where(F.col("type") == kind).select("paper_id", "page", F.col("ord").alias("target_ord"))
    distance = F.abs(F.col("caption_ord") - F.col("target_ord"))
    nearest = Window.partitionBy("paper_id", "caption_ord").orderBy(distance, "target_ord")
    joined = captions.join(targets, ["paper_id", "page"])
    return joined.withColumn("_n", F.row_number().over(nearest)).where("_n = 1").select("paper_id", "caption_ord", "target_ord")


def assign_boxes(cells: DataFrame, texts: DataFrame, least: float = 0.7, lead: float = 0.4) -> DataFrame:
    """(table_id, text_id, cell_id): each text box with the one cell that covers it clearly.

    The best coverage must be ``least`` and ahead of the next by ``lead``. A table's cells are gathered as an array, which its
    texts meet one by one, so that no pair of a text and a cell is ever sorted or held.
    """
    by_table = cells.groupBy("table_id").agg(F.collect_list(F.struct("cell_id", F.col("bbox").alias("c"))).alias("cells"))
    met = texts.select("table_id", "text_id", F.col("bbox").alias("t")).join(by_table, "table_id")
    covers = F.filter(F.transform("cells", lambda x: F.struct((-boxes.coverage(x["c"], F.col("t"))).alias("c"), x["cell_id"].alias("cell_id"))), lambda x: x["c"] < 0)
    ranked = met.select("table_id", "text_id", F.slice(F.sort_array(covers), 1, 2).alias("r")).where(F.size("r") > 0)
    best, following = -F.get("r", F.lit(0))["c"], F.coalesce(-F.get("r", F.lit(1))["c"], F.lit(0.0))
    return ranked.where((best >= least) & (best - following >= lead)).select("table_id", "text_id", F.get("r", F.lit(0))["cell_id"].alias("cell_id"))


def keep_evidence_together(ordered: DataFrame) -> DataFrame:
    """``reading_order``'s rows (with type) with tables, figures and captions that were neighbours kept together.

    A run of such blocks in the original order that has a table or figure moves to its earliest place, in that order.
    """
    page = Window.partitionBy("paper_id", "page").orderBy("ord")
    evidence = F.col("type").isin("table", "figure", "caption")
    marked = ordered.withColumn("_e", evidence)
    marked = marked.withColumn("_run", F.sum((F.col("_e") != F.coalesce(F.lag("_e").over(page), ~F.col("_e"))).cast("int")).over(page.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("paper_id", "page", "_run")
    moves = F.col("_e") & (F.max(F.col("type").isin("table", "figure").cast("int")).over(run) == 1)
    marked = marked.withColumn("_moves", moves).withColumn("_at", F.when(F.col("_moves"), F.min("reading_index").over(run)).otherwise(F.col("reading_index")))
    place = Window.partitionBy("paper_id", "page").orderBy("_at", "ord")
    return marked.withColumn("reading_index", F.row_number().over(place)).drop("_e", "_run", "_moves", "_at")


def logical_tables(blocks: DataFrame) -> DataFrame:
    """(paper_id, table_id, number, ords, caption_ords, status): physical tables that make one table of the paper.

    A table without a caption right after another on its page goes on with it. Status is merged for several fragments,
    caption_attached or caption_missing. A number that comes again gets a suffix.
    """
    tables = blocks.where(F.col("type") == "table").select("paper_id", "page", "ord")
    captions = blocks.select("paper_id", F.col("ord").alias("caption_ord"), label_number(F.col("text"), "table").alias("number"))
    captioned = caption_targets(blocks, "table").join(captions, ["paper_id", "caption_ord"]).groupBy("paper_id", F.col("target_ord").alias("ord")).agg(
        F.array_sort(F.collect_list("caption_ord")).alias("caption_ords"), F.min_by("number", "caption_ord").alias("number")
    )
    order = Window.partitionBy("paper_id").orderBy("ord")
    follows = (F.col("ord") - F.lag("ord").over(order) == 1) & (F.col("page") == F.lag("page").over(order)) & F.col("number").isNull()
    joined = tables.join(captioned, ["paper_id", "ord"], "left").withColumn("_n", F.sum(F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = joined.groupBy("paper_id", "_n").agg(
        F.array_sort(F.collect_list("ord")).alias("ords"), F.flatten(F.collect_list("caption_ords")).alias("caption_ords"), F.min_by("number", F.when(F.col("number").isNotNull(), F.col("ord"))).alias("number")
    )
    base = F.concat(F.lit("table_"), F.coalesce(F.lower("number"), F.col("ords")[0].cast("string")))
    again = F.row_number().over(Window.partitionBy("paper_id", base).orderBy("_n"))
    status = F.when(F.size("ords") > 1, "merged").when(F.size("caption_ords") > 0, "caption_attached").otherwise("caption_missing")
    return grouped.withColumn("table_id", F.when(again == 1, base).otherwise(F.concat(base, F.lit(":"), again.cast("string")))).select("paper_id", "table_id", "number", "ords", "caption_ords", status.alias("status"))

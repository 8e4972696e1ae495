"""Documents stored as trees of JSON pointers: their items in reading order, as typed blocks, and the cells of their tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The arrays that hold a tree's items, and the block type of each label.
KINDS = ("groups", "texts", "tables", "pictures", "key_value_items", "form_items")
LABELS = {
    "title": "title", "section_header": "heading", "heading": "heading", "paragraph": "paragraph", "text": "paragraph", "list_item": "list_item", "code": "code", "table": "table",
    "picture": "figure", "image": "figure", "caption": "caption", "formula": "formula", "reference": "reference", "footnote": "footnote", "page_header": "page_header", "page_footer": "page_footer",
}
_REFS = "array<struct<`$ref`:string>>"
_BOX = "struct<l:double,t:double,r:double,b:double,coord_origin:string>"
CELL = (
    "struct<text:string,start_row_offset_idx:int,end_row_offset_idx:int,start_col_offset_idx:int,end_col_offset_idx:int,row_span:int,col_span:int,"
    f"column_header:boolean,row_header:boolean,row_section:boolean,bbox:{_BOX}>"
)
ITEM = (
    f"struct<label:string,content_layer:string,text:string,orig:string,level:int,confidence:double,children:{_REFS},captions:{_REFS},"
    f"prov:array<struct<page_no:int,bbox:{_BOX}>>,data:struct<num_rows:int,num_cols:int,table_cells:array<{CELL}>,grid:array<array<struct<text:string>>>>>"
)
TREE = f"name string,body struct<children:{_REFS}>,pages map<string,struct<size:struct<width:double,height:double>>>," + ",".join(f"{kind} array<{ITEM}>" for kind in KINDS)
#: A table of more slots isn't laid out.
MOST_SLOTS = 100_000
_WHITE = " \t\n\r\x0b\x0c"


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    """All trees stored as JSON under ``path``, a row for each file, which is its paper_id; a file that is no JSON object fails the read."""
    reader = spark.read.schema(TREE).option("multiLine", True).option("mode", "FAILFAST").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
    return reader.json(path).withColumn("paper_id", F.input_file_name())


def parse_trees(rows: DataFrame, json: str) -> DataFrame:
    """``rows`` (paper_id and a column of JSON text) as ``read_trees`` has them; a null or broken text has no items."""
    # as a generator the parse stays a step of its own; as an expression it would be repeated in each function that reads a field
    return rows.select("paper_id", F.inline(F.array(F.from_json(json, TREE))))


def preorder(body: list[int], children: list[list[int]]) -> tuple[list[dict], str | None]:
    """({at, level} of each item in reading order, None), or ([], why the tree is refused).

    The body's children are at level 1. A pointer to nothing is ``dangling``; an item that is met again, as in a cycle or under
    two parents, is ``repeated``: each item of a tree has one place.
    """
    steps, met = [], set()
    ahead = [(at, 1) for at in reversed(body)]
    while ahead:
        at, level = ahead.pop()
        if at < 0 or at in met:
            return [], "dangling" if at < 0 else "repeated"
        met.add(at)
        steps.append({"at": at, "level": level})
        ahead += [(child, level + 1) for child in reversed(children[at])]
    return steps, None


_STEPS = pa.struct([("steps", pa.list_(pa.struct([("at", pa.int32()), ("level", pa.int32())]))), ("reason", pa.string())])


def walked(trees: DataFrame) -> DataFrame:
    """paper_id, pages, n_groups (how many items are groups), items (of all kinds, one array), steps and reason of each tree.

    Pointers are resolved to places in ``items`` by arithmetic; only these numbers go through Python, a tree at a time. Of a
    picture's children those that are its captions are followed, as the others are parts of the picture.
    """
    none = F.array().cast(f"array<{ITEM}>")
    starts = [sum((F.size(kind) for kind in KINDS[:n]), F.lit(0)) for n in range(len(KINDS) + 1)]
    held = trees.select("paper_id", "pages", F.coalesce("body.children", F.array().cast(_REFS)).alias("body"), *(F.coalesce(kind, none).alias(kind) for kind in KINDS)).withColumn("starts", F.array(*starts))

    def place(pointer: Column) -> Column:
        kind, index = (F.regexp_extract(pointer, "^#/([a-z_]+)/([0-9]{1,9})$", n) for n in (1, 2))
        k = F.array_position(F.array(*map(F.lit, KINDS)), kind).cast("int")
        at = F.get("starts", k - 1) + index.cast("int")
        return F.coalesce(F.when((k > 0) & (at < F.get("starts", k)), at), F.lit(-1))

    def followed(item: Column) -> Column:
        children, captions = (F.coalesce(item[name], F.array().cast(_REFS)) for name in ("children", "captions"))
        picture = F.coalesce(F.lower(item["label"]).isin("picture", "chart"), F.lit(False))
        return F.transform(F.when(picture, F.array_intersect(children, captions)).otherwise(children), lambda c: place(c["$ref"]))

    ready = held.select(
        "paper_id", "pages", F.get("starts", F.lit(1)).alias("n_groups"), F.concat(*KINDS).alias("items"),
        F.transform("body", lambda c: place(c["$ref"])).alias("tops"), F.concat(*(F.transform(kind, followed) for kind in KINDS)).alias("below"),
    )

    @F.arrow_udf("struct<steps:array<struct<at:int,level:int>>,reason:string>")
    def walk(bodies: pa.Array, children: pa.Array) -> pa.Array:
        found = (preorder(body.as_py(), kids.as_py()) for body, kids in zip(bodies, children))
        return pa.array([{"steps": steps, "reason": reason} for steps, reason in found], _STEPS)

    return ready.withColumn("w", walk("tops", "below")).select("paper_id", "pages", "n_groups", "items", "w.steps", "w.reason")


def _provenance(item: Column, pages: Column) -> tuple[Column, Column]:
    """Page and box of an item's first place, the box measured from the page's bottom; null where the page's height is needed and unknown."""
    first = F.get(item["prov"], F.lit(0))
    box, height = first["bbox"], pages[first["page_no"].cast("string")]["size"]["height"]
    from_top = F.coalesce(F.lower(F.trim(box["coord_origin"])).isin("topleft", "top_left"), F.lit(False))
    edges = F.array(box["l"], F.when(from_top, height - box["t"]).otherwise(box["t"]), box["r"], F.when(from_top, height - box["b"]).otherwise(box["b"]))
    return first["page_no"], F.when(~F.exists(edges, lambda e: e.isNull()), edges)


def table_markdown(grid: Column) -> Column:
    """A grid of cells as a Markdown table whose first row is its header; empty without rows."""
    cell = lambda c: F.replace(F.btrim(F.regexp_replace(F.coalesce(c["text"], F.lit("")), r"\s*\n\s*", " "), F.lit(_WHITE)), F.lit("|"), F.lit("&#124;"))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    rows = F.transform(grid, lambda row: line(F.transform(row, cell)))
    rule = line(F.transform(F.get(grid, F.lit(0)), lambda _: F.lit("---")))
    return F.coalesce(F.when(F.size(grid) > 0, F.array_join(F.concat(F.slice(rows, 1, 1), F.array(rule), F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1)))), "\n")), F.lit(""))


def tree_blocks(trees: DataFrame, layers: tuple[str, ...] = ("body",)) -> tuple[DataFrame, DataFrame]:
    """The blocks of ``trees`` in reading order, and (paper_id, reason) of the trees that are refused.

    Columns: paper_id, ord (from 0), block_id, type, text, page, bbox, level (of headings: the stated one, else the depth),
    confidence, source_label, formula_text_source (text, orig_fallback or missing) and table (the data of a table). Groups pass their
    place to their children; items of other ``layers`` than these are left out with no number, while their children stay. A label
    that isn't known is the type itself, none is ``unknown``. Items that no pointer reaches are no blocks. A refused tree
    has no blocks at all.
    """
    found = walked(trees)
    layer = lambda item: F.coalesce(F.lower(item["content_layer"]), F.lit("body"))
    kept = F.filter("steps", lambda s: (s["at"] >= F.col("n_groups")) & layer(F.get("items", s["at"])).isin(*layers))

    def block(step: Column) -> Column:
        item = F.get("items", step["at"])
        page, box = _provenance(item, F.col("pages"))
        return F.struct(
            *(item[name].alias(name) for name in ("label", "text", "orig", "level", "confidence", "data")), step["level"].alias("depth"), page.alias("page"), box.alias("bbox")
        )

    rows = found.select("paper_id", F.posexplode(F.transform(kept, block)).alias("ord", "b")).select("paper_id", "ord", "b.*")
    label = F.lower(F.btrim(F.coalesce("label", F.lit("")), F.lit(_WHITE)))
    known = F.create_map(*(F.lit(word) for pair in LABELS.items() for word in pair))
    rows = rows.withColumns({"source_label": F.nullif(label, F.lit("")), "type": F.coalesce(known[label], F.nullif(label, F.lit("")), F.lit("unknown"))})
    text, orig = (F.btrim(F.coalesce(name, F.lit("")), F.lit(_WHITE)) for name in ("text", "orig"))
    grid = table_markdown(F.col("data.grid"))
    blocks = rows.select(
        "paper_id", "ord", F.concat(F.lit("block_"), F.lpad(F.col("ord").cast("string"), 6, "0")).alias("block_id"), "type",
        F.when((F.col("type") == "table") & (grid != ""), grid).when((F.col("type") == "formula") & (text == ""), orig).otherwise(text).alias("text"), "page", "bbox",
        F.when(F.col("type") == "heading", F.when(F.col("level") > 0, F.col("level")).otherwise(F.col("depth"))).alias("level"), "confidence", "source_label",
        F.when(F.col("type") == "formula", F.when(text != "", "text").when(orig != "", "orig_fallback").otherwise("missing")).alias("formula_text_source"),
        F.when(F.col("type") == "table", F.col("data")).alias("table"),
    )
    return blocks, found.where("reason is not null").select("paper_id", "reason")


def table_structures(blocks: DataFrame) -> DataFrame:
    """(paper_id, ord, num_rows, num_cols, valid, warnings, uncovered_slots) of each table block that has data.

    A table is valid if its sizes are positive and its cells lie in it, agree with their spans, have text and whole boxes, and
    don't overlap; the one warning names the first cell that doesn't, from 0. Slots of a valid table that no cell covers are counted and warned of.
    Slots meet by table and slot, so a large table is no task of its own.
    """
    tables = blocks.where("table is not null").select("paper_id", "ord", "table.*").withColumn("cells", F.coalesce("table_cells", F.array().cast(f"array<{CELL}>")))
    rows, cols, n = F.col("num_rows"), F.col("num_cols"), F.size("cells")
    whole = (
        F.when(~F.coalesce((rows > 0) & (cols > 0), F.lit(False)), "invalid table dimensions")
        .when(rows.cast("long") * cols > MOST_SLOTS, "table exceeds safe grid size").when((n == 0) | (n > MOST_SLOTS), "missing or excessive table cells")
    )
    tables = tables.select("paper_id", "ord", "num_rows", "num_cols", whole.alias("fault"), F.when(whole.isNull(), F.col("cells")).alias("cells"))
    c = {short: F.col(f"c.{name}") for short, name in (("r0", "start_row_offset_idx"), ("r1", "end_row_offset_idx"), ("c0", "start_col_offset_idx"), ("c1", "end_col_offset_idx"), ("rs", "row_span"), ("cs", "col_span"))}
    missing = F.array_contains(F.array(*(v.isNull() for v in c.values())), True)
    inside = (c["r0"] >= 0) & (c["r0"] < c["r1"]) & (c["r1"] <= rows) & (c["c0"] >= 0) & (c["c0"] < c["c1"]) & (c["c1"] <= cols)
    box = F.array(*(F.col(f"c.bbox.{edge}") for edge in "ltrb"))
    fault = (
        F.when(F.col("c").isNull(), "invalid cell payload").when(missing, "offsets/spans must be integers").when(~inside, "out-of-bounds offsets")
        .when((c["rs"] != c["r1"] - c["r0"]) | (c["cs"] != c["c1"] - c["c0"]), "spans disagree with offsets").when(F.col("c.text").isNull(), "text is not a string")
        .when(F.col("c.bbox").isNotNull() & F.exists(box, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), "invalid bbox coordinates")
    )
    key = ["paper_id", "ord"]
    cells = tables.select(*key, "num_rows", "num_cols", F.posexplode("cells").alias("i", "c")).select(*key, "i", fault.alias("fault"), "num_cols", *(v.alias(short) for short, v in c.items()))
    slots = cells.where("fault is null").select(*key, "i", "num_cols", "c0", "c1", F.explode(F.sequence("r0", F.col("r1") - 1)).alias("r"))
    slots = slots.select(*key, "i", F.explode(F.sequence(F.col("r") * F.col("num_cols") + F.col("c0"), F.col("r") * F.col("num_cols") + F.col("c1") - 1)).alias("slot"))
    taken = slots.withColumn("turn", F.row_number().over(Window.partitionBy(*key, "slot").orderBy("i"))).groupBy(*key).agg(
        F.count_if(F.col("turn") == 1).alias("covered"), F.min(F.when(F.col("turn") > 1, F.struct("i", F.lit("overlapping cells").alias("fault")))).alias("twice")
    )
    bad = cells.where("fault is not null").groupBy(*key).agg(F.min(F.struct("i", "fault")).alias("bad"))
    first = F.least(F.col("bad"), F.col("twice"))
    told = F.coalesce(F.col("fault"), F.concat(F.lit("cell "), first["i"].cast("string"), F.lit(": "), first["fault"]))
    joined = tables.drop("cells").join(taken, key, "left").join(bad, key, "left").withColumn("told", told)
    gaps = F.when(F.col("told").isNull(), rows * cols - F.col("covered"))
    warned = F.coalesce(F.col("told"), F.when(gaps > 0, F.concat(gaps.cast("string"), F.lit(" unrecognized grid slots exported as empty cells"))))
    return joined.select(*key, "num_rows", "num_cols", F.col("told").isNull().alias("valid"), F.array_compact(F.array(warned)).alias("warnings"), gaps.alias("uncovered_slots"))

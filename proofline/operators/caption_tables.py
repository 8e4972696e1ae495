"""Logical tables: which physical tables and captions of a paper make one table, by labels, neighbourhood and claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.functions.display import identifier
from proofline.functions.shared import written

#: Fixed patterns: a number such as 2, 2.1, 2a or A.1, a label with its number, and one that a text begins with.
_NUMBER = "(?:\\d+(?:\\.\\d+)*[A-Za-z]?|[A-Za-z]+\\.?\\d+(?:\\.\\d+)*[A-Za-z]?)"
_LABEL = f"(?i)\\b(Table|Figure|Fig\\.?)\\s+({_NUMBER})\\s*[:.]"
_LEADING = f"(?i)^[ \\t\\r\\n|#*_]*\\b(Table|Figure|Fig\\.?)\\s+({_NUMBER})\\s*[:.]"
#: How many blocks, and bytes of their texts, meet in one task.
TASK_ROWS, TASK_BYTES = 200_000, 32 << 20


def _dealt(blocks: DataFrame) -> DataFrame:
    """``blocks`` dealt out by paper, over as many tasks as their rows and texts need; a paper stays in one.

    What a task sorts takes many times what it reads, as rows of a few labels are shuffled at ten bytes each: the number of
    tasks goes by the rows and not by the size of the shuffle. Blocks are written once, to be counted and then dealt out.
    """
    kept = written(blocks.select("paper_id", "ord", "page", "type", "text"))
    rows, size = kept.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    tasks = max(kept.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS), -(-size // TASK_BYTES))
    return kept.repartition(tasks, "paper_id")


def _kind(name: Column) -> Column:
    return F.when(F.lower(name).startswith("fig"), "figure").when(name != "", "table")


def labelled(blocks: DataFrame) -> DataFrame:
    """paper_id, ord, page, text, type, at, lead_kind, lead_id and ids of each block (paper_id, ord, page, type, text).

    ``at`` is the block's place in the paper from 0, ``lead_*`` is the label that the text begins with, decoration aside, and ``ids``
    are the different numbers of the tables that it names. A table that begins with the label of a figure is a figure.
    """
    named = F.regexp_extract_all("text", F.lit(_LABEL), F.lit(0))
    tables = F.filter(named, lambda m: _kind(F.regexp_extract(m, _LABEL, 1)) == "table")
    lead = F.regexp_extract("text", _LEADING, 2)
    known = blocks.select(
        "paper_id", "ord", "page", F.coalesce("text", F.lit("")).alias("text"), "type",
        (F.row_number().over(Window.partitionBy("paper_id").orderBy("ord")) - 1).alias("at"),
    )
    told = known.withColumns(
        {
            "lead_kind": _kind(F.regexp_extract("text", _LEADING, 1)),
            "lead_id": F.when(lead != "", identifier(lead)),
            "ids": F.array_distinct(F.transform(tables, lambda m: identifier(F.regexp_extract(m, _LABEL, 2)))),
        }
    )
    figure = (F.col("type") == "table") & F.coalesce(F.col("lead_kind") == "figure", F.lit(False))
    return told.withColumns({"retyped": figure, "type": F.when(figure, "figure").otherwise(F.col("type"))})


def _assigned(told: DataFrame) -> DataFrame:
    """``told`` with each table's number (``own``), runs of neighbouring tables, the marks of collisions, and what stands beside each block.

    A collision is a table whose text names two tables, the first of which is also the caption behind it, before a table
    without a label: the first label belongs to that table, and the second one is the table's own.
    """
    order = Window.partitionBy("paper_id").orderBy("ord")  # as ``at`` was counted, so that nothing is sorted again
    ahead = lambda name, n=1: F.lead(name, n).over(order)
    table = F.col("type") == "table"
    caption_id = F.when((F.col("type") == "caption") & (F.col("lead_kind") == "table"), F.col("lead_id"))
    marked = told.withColumns({"is_table": F.coalesce(table, F.lit(False)), "caption_id": caption_id})
    collides = (
        F.col("is_table") & (F.size("ids") > 1) & (ahead("caption_id") == F.get("ids", F.lit(0)))
        & ahead("is_table", 2) & (F.size(ahead("ids", 2)) == 0) & (F.col("page") == ahead("page", 2))
    )
    marked = marked.withColumn("collides", F.coalesce(collides, F.lit(False)))
    own = F.when(F.col("collides"), F.get("ids", F.lit(1))).when(F.col("lead_kind") == "table", F.col("lead_id"))
    others = F.sum(F.when(F.col("is_table"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = marked.withColumns(
        {
            "own": F.when(F.col("is_table"), own),
            "run": F.when(F.col("is_table"), others),
            "bare": F.col("is_table") & (F.size("ids") == 0),
            "after_collision": F.coalesce(F.lag("collides").over(order), F.lit(False)),
        }
    )
    free = F.col("bare") & F.col("own").isNull()
    return marked.withColumns({f"{name}_{side}": f(c).over(order) for side, f in (("next", F.lead), ("last", F.lag)) for name, c in (("free", free), ("page", F.col("page")), ("run", F.col("run")))})


def _claims(marked: DataFrame) -> DataFrame:
    """The tables, with ``reserved`` and ``claimed``: the place and number of the one caption that has each, and these captions, with ``target``.

    A caption wants the table behind it after a collision, else the nearest table of its page with its number, else a
    neighbour of its page without any label, the one behind first. Of several captions that want a table, one of a
    collision has it, then the nearest, then the first. A block without a paper claims nothing.
    """
    known = marked.where("is_table or caption_id is not null").withColumns({"key": F.coalesce("own", "caption_id"), "table_at": F.when(F.col("is_table"), F.col("at"))})
    same = Window.partitionBy("paper_id", "page", "key").orderBy("at")
    around = known.withColumns(
        {
            "before": F.last("table_at", ignorenulls=True).over(same.rowsBetween(Window.unboundedPreceding, 0)),
            "after": F.expr("lead(table_at) ignore nulls over (partition by paper_id, page, key order by at)"),
        }
    )
    near = F.when(F.col("before").isNull() | (F.col("after") - F.col("at") < F.col("at") - F.col("before")), F.col("after")).otherwise(F.col("before"))
    beside = F.when(F.col("free_next") & (F.col("page_next") == F.col("page")), F.col("at") + 1).when(F.col("free_last") & (F.col("page_last") == F.col("page")), F.col("at") - 1)
    wanted = F.when(F.col("after_collision"), F.col("at") + 1).otherwise(F.coalesce(F.when(F.col("page").isNotNull(), near), beside))
    target = F.when(F.col("is_table"), F.col("at")).when(F.col("paper_id").isNotNull(), wanted)
    # a table and the captions that want it meet at its place
    met = around.withColumn("target", target).where("target is not null")
    met = met.drop("ids", "retyped", "type", "bare", "key", "table_at", "before", "after", "free_next", "free_last", "page_next", "page_last")
    here = Window.partitionBy("paper_id", "target")
    claim = F.when(~F.col("is_table"), F.struct(~F.col("after_collision"), F.abs(F.col("at") - F.col("target")), F.col("at").alias("caption"), F.col("caption_id").alias("number")))
    lead = F.when(F.col("is_table") & (F.col("lead_kind") == "table"), F.col("lead_id"))
    first = met.withColumns({"first": F.min(claim).over(here), "target_lead": F.max(lead).over(here)})
    first = first.withColumns({"reserved": F.col("first.caption"), "claimed": F.col("first.number")}).drop("first")
    return first.where("is_table or reserved = at")


def _owned(claimed: DataFrame) -> DataFrame:
    """``claimed`` with ``caption``, the place of the caption that owns each table, whose number it takes; a caption's is its own.

    A caption owns its target and the tables that follow each other from the caption towards the target, up to one that another caption
    has claimed, of another number or page. Behind a caption that repeats the label of the table before it, tables go on with that
    table. A table that two captions reach is the first one's.
    """
    forward = F.col("target") > F.col("at")
    repeats = (F.col("target") == F.col("at") - 1) & F.coalesce(F.col("target_lead") == F.col("caption_id"), F.lit(False))
    scan = lambda step, run: F.struct(F.lit(step).alias("step"), F.col(run).alias("run"))
    scans = F.array_compact(F.array(
        scan(0, "run"), F.when(~F.col("is_table") & (forward | repeats) & F.col("run_next").isNotNull(), scan(1, "run_next")),
        F.when(~F.col("is_table") & ~forward & F.col("run_last").isNotNull(), scan(-1, "run_last")),
    ))
    # a run of tables meets the caption before it, if that looks ahead, and the one behind it, if that looks back
    met = claimed.withColumn("scan", F.explode(scans)).drop("run", "run_next", "run_last", "after_collision", "target", "target_lead").select("*", "scan.*").drop("scan")
    met = met.withColumn("text", F.when(F.col("step") == 0, F.col("text")))
    run = Window.partitionBy("paper_id", "run").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    looks = lambda step: F.max(F.when(F.col("step") == step, F.struct(F.col("at").alias("caption"), F.col("caption_id").alias("number"), "page"))).over(run)
    met = met.withColumns({"ahead": looks(1), "back": looks(-1)})
    number = F.coalesce("claimed", "own")
    fits = lambda by: F.coalesce(
        (F.col("reserved").isNull() | (F.col("reserved") == by["caption"])) & (number.isNull() | (number == by["number"])) & (F.col("page") == by["page"]), F.lit(False)
    )
    misfit = lambda by: F.when(F.col("is_table") & ~fits(F.col(by)), F.col("at"))
    met = met.withColumns({"ahead_stop": F.min(misfit("ahead")).over(run), "back_stop": F.max(misfit("back")).over(run)}).where("step = 0")
    of = lambda caption, number: F.struct(caption.alias("caption"), number.alias("number"))
    owner = F.least(
        F.when(F.col("ahead").isNotNull() & (F.col("ahead_stop").isNull() | (F.col("at") < F.col("ahead_stop"))), of(F.col("ahead.caption"), F.col("ahead.number"))),
        F.when(F.col("back").isNotNull() & (F.col("back_stop").isNull() | (F.col("at") > F.col("back_stop"))), of(F.col("back.caption"), F.col("back.number"))),
        F.when(F.col("reserved").isNotNull(), of(F.col("reserved"), F.col("claimed"))),
    )
    return met.withColumn("owner", owner).withColumns({"caption": F.col("owner.caption"), "own": F.coalesce("owner.number", "own")}).drop("owner", "ahead", "back", "ahead_stop", "back_stop")


def recover_tables(blocks: DataFrame) -> DataFrame:
    """The logical tables of each paper's ``blocks`` (paper_id, ord, page, type, text).

    Returns paper_id, table_id, identifier, caption, page_start, page_end, source_ords, caption_ords, text, status and warnings. A
    caption claims a table (``_claims``) and owns its region (``_owned``); tables that nobody owns stay alone, but for direct
    neighbours with the same number. Status is caption_collision_recovered, merged_fragments, caption_attached,
    caption_missing or correct (the table has its caption's label itself). Without a caption block the line of the table that names it is
    the caption. A number that comes again has its place among the paper's tables in its id. Nothing is on the same page as
    a block without one. Every step is a window within a paper, after one
    shuffle by paper over as many tasks as the blocks need (``_dealt``); ids of papers may have any type.
    """
    tables = _owned(_claims(_assigned(labelled(_dealt(blocks)))))
    order = Window.partitionBy("paper_id").orderBy("run", "at")  # captions, which have no run, come before all tables
    goes_on = (
        F.col("caption").isNull() & F.lag("caption").over(order).isNull() & (F.col("own") == F.lag("own").over(order)) & (F.lag("at").over(order) == F.col("at") - 1)
    )
    island = F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    tables = tables.withColumn("group", F.when(F.col("caption").isNotNull(), F.concat(F.lit("c"), "caption")).otherwise(F.concat(F.lit("t"), island)))
    part = F.when(F.col("is_table"), F.struct("at", "ord", "page", "text", "own", "lead_kind", "lead_id", "collides"))
    of_caption = lambda name: F.max(F.when(~F.col("is_table"), F.col(name)))
    groups = tables.groupBy("paper_id", "group").agg(
        F.array_sort(F.collect_list(part)).alias("parts"), of_caption("ord").alias("caption_ord"), of_caption("text").alias("caption_text"), F.max(F.col("collides")).alias("collided")
    )
    first = F.col("parts")[0]
    numbered = groups.withColumns({"first": first, "id": first["own"], "sequence": F.row_number().over(Window.partitionBy("paper_id").orderBy(first["at"]))})
    place = F.lpad(F.col("sequence").cast("string"), 4, "0")
    slug = F.regexp_replace(F.regexp_replace(F.lower("id"), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    base = (
        F.when(F.col("id").isNull(), F.concat(F.lit("logical_table_unlabelled_"), place))
        .when(F.col("id").rlike("^\\d+$"), F.concat(F.lit("logical_table_"), F.lpad("id", F.greatest(F.length("id"), F.lit(4)), F.lit("0"))))
        .otherwise(F.concat(F.lit("logical_table_"), F.when(slug == "", F.col("sequence").cast("string")).otherwise(slug)))
    )
    again = F.row_number().over(Window.partitionBy("paper_id", "base").orderBy("sequence"))
    numbered = numbered.withColumn("base", base).withColumn("again", again)
    labelled_itself = F.coalesce((F.col("first.lead_kind") == "table") & (F.col("first.lead_id") == F.col("id")), F.lit(False))
    missing = F.col("caption_ord").isNull()
    status = (
        F.when(F.col("collided"), "caption_collision_recovered").when(F.size("parts") > 1, "merged_fragments").when(missing, "caption_missing")
        .when(~labelled_itself, "caption_attached").otherwise("correct")
    )
    warnings = F.when(F.col("collided"), F.array(F.lit("caption_collision"))).when(missing & (F.size("parts") == 1), F.array(F.lit("caption_missing")))
    its_line = F.regexp_substr("first.text", F.concat(F.lit("(?i)\\bTable\\s+\\Q"), "id", F.lit("\\E\\s*[:.](?!\\d).*")))
    embedded = F.trim(its_line, F.lit(" |"))
    pages = F.array_compact(F.transform("parts", lambda p: p["page"]))
    texts = F.filter(F.transform("parts", lambda p: p["text"]), lambda t: t != "")
    return numbered.select(
        "paper_id", F.when(F.col("again") == 1, F.col("base")).otherwise(F.concat("base", F.lit("_"), place)).alias("table_id"), F.col("id").alias("identifier"),
        F.when(~missing, F.trim("caption_text")).otherwise(F.when(embedded != "", embedded)).alias("caption"),
        F.array_min(pages).alias("page_start"), F.array_max(pages).alias("page_end"), F.transform("parts", lambda p: p["ord"]).alias("source_ords"),
        F.when(missing, F.array().cast("array<int>")).otherwise(F.array(F.col("caption_ord"))).alias("caption_ords"), F.array_join(texts, "\n\n").alias("text"),
        status.alias("status"), F.coalesce(warnings, F.array().cast("array<string>")).alias("warnings"),
    )

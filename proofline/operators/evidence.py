"""Evidence around figures and formulas, evidence of claims, and the answers that carry it."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.operators.context import within_band
from proofline.operators.structure import label_number

#: Blocks that can explain, and how far they may be away.
CONTEXT_TYPES, REACH = ("paragraph", "list_item"), 12
#: Fixed patterns: what mentions a figure or formula of a number, for Python; as in ``figure_explanations`` and ``formula_contexts``.
FIGURE_MENTION, FORMULA_MENTION = r"\b(?ai:(?:Figure|Fig\.?)\s*{})\b", r"\b(?ai:(?:Equation|Eq\.?)\s*\(?{}\)?)"


def _beside(pairs: DataFrame) -> DataFrame:
    """Pairs whose pages are at most one apart and whose sections are the same where both have one."""
    pages = F.coalesce(F.abs(F.col("l_page") - F.col("r_page")) <= 1, F.lit(True))
    both = (F.size("l_section_path") > 0) & (F.size("r_section_path") > 0)
    return pairs.where(pages & F.coalesce(~both | (F.col("l_section_path") == F.col("r_section_path")), F.lit(True)))


def figure_explanations(blocks: DataFrame) -> DataFrame:
    """(paper_id, figure_ord, context_ord): paragraphs near a figure that mention its number.

    ``blocks`` has paper_id, ord, page, type, text and section_path; a figure's text is its caption.
    """
    figures = blocks.where(F.col("type") == "figure").withColumn("number", label_number(F.col("text"), "figure")).where("number is not null")
    near = within_band(figures, blocks.where(F.col("type").isin(*CONTEXT_TYPES)), ["paper_id"], "ord", REACH)
    mentioned = F.expr("regexp_like(r_text, concat('(?i)\\\\b(?:Figure|Fig\\\\.?)\\\\s*', l_number, '\\\\b'))")
    return _beside(near).where(mentioned).select("paper_id", F.col("l_ord").alias("figure_ord"), F.col("r_ord").alias("context_ord"))


def formula_contexts(blocks: DataFrame) -> DataFrame:
    """(paper_id, formula_ord, context_ord): the nearest explaining block on each side, and those that cite its number.

    Headings, titles and other formulas end the search for the nearest one.
    """
    order = Window.partitionBy("paper_id").orderBy("ord")
    barrier = F.col("type").isin("heading", "title", "formula")
    usable = F.when(F.col("type").isin(*CONTEXT_TYPES), F.struct("ord", "page", "section_path"))
    stretches = blocks.withColumns({"_up": F.sum(barrier.cast("int")).over(order), "_down": F.sum(barrier.cast("int")).over(order.rowsBetween(0, Window.unboundedFollowing)), "_c": usable})
    is_formula = F.col("type") == "formula"
    # a formula begins its own stretch, so the one before it counts one less
    formulas = stretches.where(is_formula).select("paper_id", *[F.col(c).alias(f"l_{c}") for c in ("ord", "page", "section_path")], "_up", "_down")
    contexts = stretches.where(F.col("_c").isNotNull()).select("paper_id", *[F.col(c).alias(f"r_{c}") for c in ("ord", "page", "section_path")], "_up", "_down")
    after = formulas.drop("_down").join(contexts.drop("_down"), ["paper_id", "_up"]).where("r_ord > l_ord").drop("_up")
    before = formulas.drop("_up").join(contexts.drop("_up"), ["paper_id", "_down"]).where("r_ord < l_ord").drop("_down")
    nearest = Window.partitionBy("paper_id", "l_ord", F.col("r_ord") > F.col("l_ord")).orderBy(F.abs(F.col("r_ord") - F.col("l_ord")))
    closest = _beside(after.unionByName(before)).withColumn("_n", F.row_number().over(nearest)).where("_n = 1").select("paper_id", "l_ord", "r_ord")
    numbered = blocks.where(is_formula).withColumn("number", formula_number(F.col("text"))).where("number is not null")
    near = within_band(numbered, blocks.where(F.col("type").isin(*CONTEXT_TYPES)), ["paper_id"], "ord", REACH)
    cited = F.expr("regexp_like(r_text, concat('(?i)\\\\b(?:Equation|Eq\\\\.?)\\\\s*\\\\(?', replace(l_number, '.', '\\\\.'), '\\\\)?'))")
    cites = _beside(near).where(cited).select("paper_id", "l_ord", "r_ord")
    return closest.union(cites).distinct().select("paper_id", F.col("l_ord").alias("formula_ord"), F.col("r_ord").alias("context_ord"))


def formula_number(text: Column) -> Column:
    """The number in brackets at the end of a formula; null without one."""
    return F.nullif(F.regexp_extract(text, "\\(\\s*(\\d+(?:\\.\\d+)*[a-z]?)\\s*\\)\\s*$", 1), F.lit(""))


def _compatible(blocks: list[dict], paths: list[list[str]], a: int, b: int) -> bool:
    """Whether two blocks of a paper may be bound: as in ``_beside``."""
    pages = blocks[a]["page"], blocks[b]["page"]
    return (None in pages or abs(pages[0] - pages[1]) <= 1) and (not paths[a] or not paths[b] or paths[a] is paths[b] or paths[a] == paths[b])


def mentions_near(blocks: list[dict], paths: list[list[str]], at: int, pattern: str) -> list[int]:
    """The ords of the explaining blocks of a paper, in order, within reach of the one at ``at`` that match ``pattern``."""
    low = high = at
    while low > 0 and blocks[at]["ord"] - blocks[low - 1]["ord"] <= REACH:
        low -= 1
    while high + 1 < len(blocks) and blocks[high + 1]["ord"] - blocks[at]["ord"] <= REACH:
        high += 1
    near = [i for i in range(low, high + 1) if blocks[i]["type"] in CONTEXT_TYPES and _compatible(blocks, paths, at, i)]
    return [blocks[i]["ord"] for i in near if re.search(pattern, blocks[i]["text"] or "")]


def explained_beside(blocks: list[dict], paths: list[list[str]], at: int) -> list[int]:
    """The ords of the nearest explaining block on each side of the formula at ``at``, of a paper's blocks in order: as in ``formula_contexts``."""
    found = []
    for step in (-1, 1):
        i = at + step
        while 0 <= i < len(blocks) and blocks[i]["type"] not in ("heading", "title", "formula"):
            if blocks[i]["type"] in CONTEXT_TYPES and blocks[i]["ord"] != blocks[at]["ord"] and _compatible(blocks, paths, at, i):
                found.append(blocks[i]["ord"])
                break
            i += step
    return found


def rendered_claims(claims: DataFrame) -> DataFrame:
    """Claims (answer_id, position, text, source_ids) with where each stands in the answer that joins them.

    A claim is followed by its sources in brackets; claims are joined by a blank line. Offsets are code points.
    """
    shown = claims.withColumn("rendered", F.concat("text", F.lit(" "), F.array_join(F.transform("source_ids", lambda s: F.concat(F.lit("["), s, F.lit("]"))), "")))
    before = F.coalesce(F.sum(F.length("rendered") + 2).over(Window.partitionBy("answer_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return shown.withColumn("answer_start", before).withColumn("answer_end", F.col("answer_start") + F.length("text"))


def rendered_answers(claims: DataFrame) -> DataFrame:
    """(answer_id, answer): the whole texts of ``rendered_claims``."""
    ordered = F.array_sort(F.collect_list(F.struct("position", "rendered")))
    return rendered_claims(claims).groupBy("answer_id").agg(F.array_join(F.transform(ordered, lambda x: x["rendered"]), "\n\n").alias("answer"))


def whole_units(selected: DataFrame, anchors: DataFrame) -> DataFrame:
    """(claim_id, unit_id, complete): whether a claim's anchors (claim_id, anchor_id) have all parts of each unit they touch."""
    parts = anchors.select("anchor_id", "unit_id", "parts")
    return selected.distinct().join(parts, "anchor_id").groupBy("claim_id", "unit_id").agg((F.count("*") == F.max("parts")).alias("complete"))


def canonical_digest(value: object) -> str:
    """SHA-256 of a value's JSON with sorted keys and no spaces."""
    import hashlib

    return hashlib.sha256(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def review_packets(claims: DataFrame, anchors: DataFrame) -> DataFrame:
    """A packet for each claim (claim_id, question, claim, anchor_ids): its anchors' texts, and the digest that names it."""
    chosen = claims.select("claim_id", "question", "claim", F.posexplode("anchor_ids").alias("at", "anchor_id")).join(anchors.select("anchor_id", "text"), "anchor_id", "left")
    body = chosen.groupBy("claim_id", "question", "claim").agg(F.array_sort(F.collect_list(F.struct("at", "anchor_id", "text"))).alias("a"))
    packed = body.withColumn("anchors", F.transform("a", lambda x: F.struct(x["anchor_id"].alias("anchor_id"), x["text"].alias("text")))).drop("a")
    missing = F.exists("anchors", lambda x: x["text"].isNull())
    digest = F.sha2(F.to_json(F.struct("anchors", "claim", "claim_id", "question")).cast("binary"), 256)
    return packed.withColumn("packet_id", F.when(missing, F.raise_error(F.lit("a claim names an anchor that isn't there"))).otherwise(digest))


def citation_contract(answers: DataFrame) -> DataFrame:
    """Metrics of each answer (answer_id, cited, sources, required, gold_sets), all of them arrays.

    ``syntax``: every citation names a source. ``coverage``: share of the required that are cited, 1 if none is
    required. ``gold_hit``: some gold set is cited whole.
    """
    required = F.size("required")
    return answers.select(
        "answer_id",
        (F.size(F.array_except("cited", "sources")) == 0).alias("syntax"),
        F.when(required == 0, 1.0).otherwise(F.size(F.array_intersect("required", "cited")) / required).alias("coverage"),
        F.exists("gold_sets", lambda g: F.size(F.array_except(g, F.col("cited"))) == 0).alias("gold_hit"),
    )

"""Reciprocal-rank fusion, coverage selection and section reranking over tables of ranked hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked_once(hits: DataFrame, by: list[str], item: str, position: str) -> DataFrame:
    """Hits with ``rank``: a repeated item keeps its first position, and ranks don't count repeats."""
    first = hits.groupBy(*by, item).agg(F.min(position).alias(position))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(position, item)))


def fuse_rrf(dense: DataFrame, lexical: DataFrame, k: int, rrf_k: int = 60) -> DataFrame:
    """Equal-weight fusion of two branches (query_id, id, position, score).

    Returns query_id, id, rrf, dense_score, bm25_score, dense_rank, bm25_rank and rank. Branches are united and
    grouped, so each moves once. Ties go by the better branch rank, then by the id as a string.
    """
    if k <= 0 or rrf_k <= 0:
        raise ValueError("k and rrf_k must be positive")
    both = None
    for branch, hits in (("dense", dense), ("bm25", lexical)):
        kept = hits.groupBy("query_id", "id").agg(F.min("position").alias("position"), F.min_by("score", "position").alias("score"))
        kept = kept.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("position", "id"))).withColumn("branch", F.lit(branch))
        both = kept if both is None else both.unionByName(kept)
    of = lambda branch, value: F.max(F.when(F.col("branch") == branch, F.col(value)))
    fused = both.groupBy("query_id", "id").agg(
        F.sum(1.0 / (rrf_k + F.col("r"))).alias("rrf"), of("dense", "score").alias("dense_score"), of("bm25", "score").alias("bm25_score"),
        of("dense", "r").alias("dense_rank"), of("bm25", "r").alias("bm25_rank"), F.min("r").alias("best"),
    )
    order = Window.partitionBy("query_id").orderBy(F.round("rrf", 12).desc(), "best", F.col("id").cast("string"))
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("best")


def fuse_weighted(dense: DataFrame, reranked: DataFrame, k: int, dense_weight: float = 2.0, reranker_weight: float = 1.0, rrf_k: int = 60) -> DataFrame:
    """Weighted fusion of two orders (query_id, id, rank) of the same items.

    Returns query_id, id, score, rank. Ties go by dense rank, reranker rank, id. A query whose two orders don't
    have the same items gives no rows here; ``unequal_orders`` names it.
    """
    joined = dense.select("query_id", "id", F.col("rank").alias("d")).join(reranked.select("query_id", "id", F.col("rank").alias("r")), ["query_id", "id"], "full")
    whole = F.min((F.col("d").isNotNull() & F.col("r").isNotNull()).cast("int")).over(Window.partitionBy("query_id"))
    scored = joined.withColumn("whole", whole).where("whole = 1").withColumn("score", dense_weight / (rrf_k + F.col("d")) + reranker_weight / (rrf_k + F.col("r")))
    order = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "d", "r", F.col("id").cast("string"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "id", "score", "rank")


def unequal_orders(dense: DataFrame, reranked: DataFrame) -> DataFrame:
    """query_id of the queries whose two orders don't have the same items."""
    a, b = dense.select("query_id", "id"), reranked.select("query_id", "id")
    return a.exceptAll(b).union(b.exceptAll(a)).select("query_id").distinct()


def fuse_queries(hits: DataFrame, rrf_k: int = 60) -> DataFrame:
    """Fusion of the hits (case_id, query_id, chunk_id, rank, score) of several queries of one case.

    Returns case_id, chunk_id, rrf, retrieval_score (the largest), best_rank and fused_rank. A chunk that a query
    returns twice is an error, raised when the result is computed.
    """
    repeated = F.count("*").over(Window.partitionBy("case_id", "query_id", "chunk_id"))
    checked = hits.withColumn("rank", F.when(repeated > 1, F.raise_error(F.lit("a query returns a chunk twice"))).otherwise(F.col("rank")))
    fused = checked.groupBy("case_id", "chunk_id").agg(
        F.sum(1.0 / (rrf_k + F.col("rank"))).alias("rrf"), F.max("score").alias("retrieval_score"), F.min("rank").alias("best_rank")
    )
    order = Window.partitionBy("case_id").orderBy(F.round("rrf", 12).desc(), "best_rank", F.col("chunk_id").cast("string"))
    return fused.withColumn("fused_rank", F.row_number().over(order))


def select_coverage(fused: DataFrame, hits: DataFrame, k: int, targets: int, original: str = "original", original_reserve: int = 4, per_target: int = 2) -> DataFrame:
    """The ``k`` fused chunks of each case, of which the best of the original and of each target are assured.

    ``fused`` is from ``fuse_queries``; ``hits`` has the ranks by query. Places left over go by fused rank, and the
    result is in fused order.
    """
    if k <= 0 or original_reserve < 0 or per_target <= 0 or original_reserve + per_target * targets > k:
        raise ValueError("the reserves don't fit into k")
    held = F.when((F.col("query_id") == original) & (F.col("rank") <= original_reserve), 0).when((F.col("query_id") != original) & (F.col("rank") <= per_target), 1).otherwise(2)
    classes = hits.groupBy("case_id", "chunk_id").agg(F.min(held).alias("class"))
    place = F.row_number().over(Window.partitionBy("case_id").orderBy("class", "fused_rank"))
    chosen = fused.join(classes, ["case_id", "chunk_id"]).withColumn("place", place).where(F.col("place") <= k)
    return chosen.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy("fused_rank"))).drop("place")


def rerank_by_section(hits: DataFrame) -> DataFrame:
    """Hits (query_id, question, id, position, score, content_type, section, text) reordered for the section asked for.

    Adds intent, boost (the penalty of reference lists subtracted where no section matches), adjusted (0 to 1) and
    rank; equal scores keep their order. A question that asks for no or several kinds keeps its scores.
    """
    from proofline.functions.text import reference_penalty, section_boost, section_intent

    told = hits.withColumn("intent", section_intent(F.col("question")))
    boost = section_boost(F.col("intent"), F.col("content_type"), F.col("section"), F.col("text"))
    penalty = F.when(boost > 0, 0.0).otherwise(reference_penalty(F.col("content_type"), F.col("section"), F.col("text")))
    scored = told.withColumn("boost", F.when(F.col("intent").isNull(), 0.0).otherwise(F.round(boost - penalty, 6)))
    moved = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score") + F.col("boost")))
    scored = scored.withColumn("adjusted", F.when(F.col("intent").isNull(), F.col("score")).otherwise(moved))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("adjusted"), "position")))


def only_section_matches(reranked: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each query; if any hit has a positive boost, only such hits."""
    any_match = F.max((F.col("boost") > 0).cast("int")).over(Window.partitionBy("query_id")) == 1
    kept = reranked.withColumn("_any", any_match).where(~F.col("_any") | (F.col("boost") > 0)).drop("_any")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("rank") <= k)


def execute_plan(plan: DataFrame, hits: DataFrame, k: int, original: str = "original", original_reserve: int = 4, per_target: int = 2) -> DataFrame:
    """The result of each case of a plan (case_id, query_id): fused with coverage, or that of the original question.

    A case falls back to its original hits if it has no targets, if the reserves don't fit into ``k``, or if a target
    has no hits. Returns case_id, chunk_id, rank and reason, which is null where the plan was carried out.
    """
    found = hits.groupBy("case_id", "query_id").agg(F.count("*").alias("n"))
    cases = plan.join(found, ["case_id", "query_id"], "left").groupBy("case_id").agg(
        F.count_if(F.col("query_id") != original).alias("targets"), F.count_if((F.col("query_id") != original) & F.col("n").isNull()).alias("empty")
    )
    reason = (
        F.when(F.col("targets") == 0, "single_query").when(original_reserve + per_target * F.col("targets") > k, "insufficient_top_k_for_coverage")
        .when(F.col("empty") > 0, "target_retrieval_failed")
    )
    judged = cases.withColumn("reason", reason)
    single = hits.where(F.col("query_id") == original).join(judged.where("reason is not null"), "case_id").where(F.col("rank") <= k).select("case_id", "chunk_id", "rank", "reason")
    several = hits.join(judged.where("reason is null").select("case_id"), "case_id", "left_semi")
    held = F.when((F.col("query_id") == original) & (F.col("rank") <= original_reserve), 0).when((F.col("query_id") != original) & (F.col("rank") <= per_target), 1).otherwise(2)
    classes = several.groupBy("case_id", "chunk_id").agg(F.min(held).alias("class"))
    place = F.row_number().over(Window.partitionBy("case_id").orderBy("class", "fused_rank"))
    chosen = fuse_queries(several).join(classes, ["case_id", "chunk_id"]).withColumn("place", place).where(F.col("place") <= k)
    fused = chosen.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy("fused_rank"))).select("case_id", "chunk_id", "rank", F.lit(None).cast("string").alias("reason"))
    return single.unionByName(fused)


def named_reserves(k: int, papers: int, original_reserve: int = 4, per_target: int = 2) -> tuple[int, int]:
    """(places of the original, places of each paper) of a comparison of named papers; ValueError if they don't fit."""
    if not 2 <= papers <= 3 or k < papers:
        raise ValueError("a comparison has two or three papers and a place for each")
    each = max(1, min(per_target, k // papers))
    return max(0, min(original_reserve, k - each * papers)), each

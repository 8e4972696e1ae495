"""Retrieval of a chat request: how much is asked for, what is kept, and gates on named papers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofline.operators.fusion import only_section_matches, rerank_by_section

#: The most candidates of a section rerank and their share of what is asked for, and the range of hybrid ones.
MOST_CANDIDATES, TIMES, MOST_HYBRID = 50, 5, 500


def candidates_for_sections(k: int) -> int:
    """How many hits a request for ``k`` fetches before it reorders them by section."""
    return min(MOST_CANDIDATES, max(k, TIMES * k))


def hybrid_candidates(k: int, asked: int = 50) -> int:
    """How many hits of each branch are fused for ``k``; ValueError beyond 1 to 500."""
    if not (1 <= k <= MOST_HYBRID and 1 <= asked <= MOST_HYBRID):
        raise ValueError("between 1 and 500")
    return max(k, asked)


def hybrid_dense(dense: DataFrame, corpus: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Dense hits (query_id, id, score) that are in the corpus (id) and reach the threshold; ranks are counted anew."""
    kept = dense.where(F.col("score") >= threshold).join(corpus.select("id").distinct(), "id", "left_semi")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("position")))


def chat_hits(hits: DataFrame, k: int, threshold: float = 0.0) -> DataFrame:
    """The hits that a chat answers from: of the candidates those over the threshold, by section, the first ``k``.

    ``hits`` are as in ``rerank_by_section``. Positions beyond ``candidates_for_sections`` are left out first.
    """
    over = hits.where((F.col("position") <= candidates_for_sections(k)) & (F.col("score") >= threshold))
    return only_section_matches(rerank_by_section(over), k)


def named_papers_gate(hits: DataFrame, named: DataFrame) -> DataFrame:
    """``hits`` (case_id, filename, ...) of the cases in which every named paper (case_id, filename) has a hit.

    Adds status: complete, or null for a case that names no paper. Of an incomplete case nothing is kept.
    """
    missing = named.join(hits.select("case_id", "filename").distinct(), ["case_id", "filename"], "left_anti").select("case_id").distinct()
    naming = named.select("case_id").distinct().withColumn("status", F.lit("complete"))
    return hits.join(missing, "case_id", "left_anti").join(naming, "case_id", "left")


def missing_papers(hits: DataFrame, named: DataFrame) -> DataFrame:
    """(case_id, missing_documents) of the cases that the gate empties."""
    missing = named.join(hits.select("case_id", "filename").distinct(), ["case_id", "filename"], "left_anti")
    return missing.groupBy("case_id").agg(F.array_sort(F.collect_set("filename")).alias("missing_documents"))


def reranked_or_nothing(reranked: DataFrame, retrieved: DataFrame, named: DataFrame) -> DataFrame:
    """Reranked hits of the cases that didn't lose a named paper that retrieval had found; the others have none."""
    found = named.join(retrieved.select("case_id", "filename").distinct(), ["case_id", "filename"], "left_semi")
    lost = found.join(reranked.select("case_id", "filename").distinct(), ["case_id", "filename"], "left_anti").select("case_id").distinct()
    return reranked.join(lost, "case_id", "left_anti")

"""Audits and roll-ups of chunks, claims, citations and orders: what holds of a whole run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofline.functions.display import plain_words, source_id


def chunk_summary(chunks: DataFrame) -> DataFrame:
    """One row of counts of chunks (text, continued, is_bridge, is_table): all, bridges, over pages, of one page, tables; mean length."""
    plain = ~F.col("is_bridge")
    return chunks.agg(
        F.count("*").alias("total_chunks"), F.count_if("is_bridge").alias("bridge_chunks"), F.count_if(F.col("continued") & plain).alias("cross_page_chunks"),
        F.count_if(~F.col("continued") & plain).alias("single_page_chunks"), F.count_if("is_table").alias("table_chunks"),
        F.coalesce(F.avg(F.length("text")), F.lit(0.0)).alias("avg_chunk_length"),
    )


def chunk_regression(chunks: DataFrame, blocks: DataFrame, most: int = 900) -> DataFrame:
    """(problem, n) of chunks (chunk_id, token_count, block_ids) over blocks (block_id, type).

    Problems: oversized chunks, repeated ids, sources that are no block, tables that no chunk has as a source.
    """
    sources = chunks.select(F.explode("block_ids").alias("block_id")).distinct()
    counts = {
        "oversized": chunks.where(F.col("token_count") > most),
        "repeated_id": chunks.groupBy("chunk_id").count().where("count > 1"),
        "dangling_source": sources.join(blocks, "block_id", "left_anti"),
        "missing_table": blocks.where(F.col("type") == "table").join(sources, "block_id", "left_anti"),
    }
    found = None
    for problem, rows in counts.items():
        one = rows.agg(F.lit(problem).alias("problem"), F.count("*").alias("n"))
        found = one if found is None else found.unionByName(one)
    return found


def claim_decisions(claims: DataFrame) -> DataFrame:
    """One row of accuracy, exact cases and recall of both answers over claims (case_id, expected, predicted); recall is 1 of none."""
    right = (F.col("expected") == F.col("predicted")).cast("int")
    cases = claims.groupBy("case_id").agg(F.min(right).alias("exact"), F.count("*").alias("n"), F.sum(right).alias("right"), *[
        F.sum(F.when(F.col("expected") == side, value).otherwise(0)).alias(name) for side, name, value in
        ((False, "bad", 1), (False, "bad_right", right), (True, "good", 1), (True, "good_right", right))
    ])
    recall = lambda part, whole: F.coalesce(F.sum(part) / F.nullif(F.sum(whole), F.lit(0)), F.lit(1.0))
    return cases.agg(
        F.count("*").alias("cases"), F.sum("n").alias("claims"), (F.sum("right") / F.sum("n")).alias("accuracy"), F.avg("exact").alias("exact_cases"),
        recall("bad_right", "bad").alias("unsupported_recall"), recall("good_right", "good").alias("supported_recall"),
    )


def claim_states(judged: DataFrame) -> DataFrame:
    """(state, n, share) of judged claims (state); a null state is missing."""
    counted = judged.groupBy(F.coalesce("state", F.lit("missing")).alias("state")).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # a row for each state


def same_sets(expected: DataFrame, actual: DataFrame, key: str, member: str) -> DataFrame:
    """(key, same): whether both sides have the same members under each key, repeats not counted; a key of one side is not the same."""
    sets = lambda rows, name: rows.groupBy(key).agg(F.array_sort(F.collect_set(member)).alias(name))
    joined = sets(expected, "_a").join(sets(actual, "_b"), key, "full")
    return joined.select(key, F.coalesce(F.col("_a") == F.col("_b"), F.lit(False)).alias("same"))


def lost_tokens(before: DataFrame, after: DataFrame, key: str, token: str) -> DataFrame:
    """(key, token, lost): how often each token of a row is missing after a change, repeats counted."""
    count = lambda rows, name: rows.groupBy(key, token).agg(F.count("*").alias(name))
    joined = count(before, "_b").join(count(after, "_a"), [key, token], "left")
    return joined.select(key, token, (F.col("_b") - F.coalesce("_a", F.lit(0))).alias("lost")).where("lost > 0")


def matching_sources(texts: DataFrame, sources: DataFrame) -> DataFrame:
    """(case_id, text, source_ids) of each distinct evidence text and the sources of its case with the same words."""
    asked = texts.select("case_id", "text").distinct().withColumn("_w", plain_words(F.col("text")))
    there = sources.select("case_id", "source_id", plain_words(F.col("text")).alias("_w"))
    joined = asked.join(there, ["case_id", "_w"], "left")
    return joined.groupBy("case_id", "text").agg(F.array_sort(F.collect_list("source_id")).alias("source_ids"))


def cited_sources(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(answer_id, source_id, kind) of answers (answer_id, answer) and their sources (answer_id, position, given_id).

    The kind is cited, uncited, or unknown for a citation that names no source of the answer.
    """
    marks = F.transform(F.regexp_extract_all("answer", F.lit("(?i)\\[(S\\d+)\\]"), F.lit(1)), lambda s: F.upper(s))
    cited = answers.select("answer_id", F.explode(F.array_distinct(marks)).alias("source_id")).withColumn("_cited", F.lit(True))
    known = sources.select("answer_id", source_id(F.col("given_id"), F.col("position")).alias("source_id")).distinct().withColumn("_known", F.lit(True))
    kind = F.when(F.col("_known").isNull(), "unknown").when(F.col("_cited").isNull(), "uncited").otherwise("cited")
    return known.join(cited, ["answer_id", "source_id"], "full").select("answer_id", "source_id", kind.alias("kind"))


def order_invariants(ordered: DataFrame) -> DataFrame:
    """(paper_id, kept, counted) of ordered blocks (paper_id, page, ord, reading_index).

    ``kept``: no block is there twice; ``counted``: indexes go from 1 without gaps on each page.
    """
    pages = ordered.groupBy("paper_id", "page").agg(
        F.count("*").alias("n"), F.countDistinct("ord").alias("blocks"), F.countDistinct("reading_index").alias("places"), F.min("reading_index").alias("low"), F.max("reading_index").alias("high")
    )
    whole = (F.col("places") == F.col("n")) & (F.col("low") == 1) & (F.col("high") == F.col("n"))
    return pages.groupBy("paper_id").agg(F.bool_and(F.col("blocks") == F.col("n")).alias("kept"), F.bool_and(whole).alias("counted"))


def first_rank(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, rank): the first rank at which a hit (query_id, filename, rank) is of an expected file; null if none is."""
    wanted = expected.select("query_id", "filename").distinct()
    ranks = hits.join(wanted, ["query_id", "filename"]).groupBy("query_id").agg(F.min("rank").alias("rank"))
    return wanted.select("query_id").distinct().join(ranks, "query_id", "left")

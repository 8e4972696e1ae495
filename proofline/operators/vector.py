"""Exact cosine search in blocks."""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries that are sent to every task whole, if there are no more; else rows of a block of candidates and of queries.
SENT, BLOCK, QUERY_BLOCK = 4096, 8192, 1024


def _unit(values, low: int, high: int | None) -> np.ndarray:
    x = np.stack(values).astype(np.float64)[:, low:high]
    return x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]


def cosine_top_k(
    corpus: DataFrame,
    queries: DataFrame,
    k: int,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    dims: tuple[int, int] | None = None,
    threshold: float | None = None,
) -> DataFrame:
    """The ``k`` rows of ``corpus`` most similar to each row of ``queries`` (query_id, query_vector).

    Returns query_id, vec_id, score, rank; ties go to the smaller id. Null vectors and zero vectors take no part. With
    ``dims`` only components [from, to) count; with ``threshold`` lower scores are left out. Up to SENT queries are
    sent to the tasks, and the corpus is read where it lies. More queries meet the corpus in pairs of blocks, and
    no side is broadcast. Either way only k rows for each query leave a task or a pair.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    low, high = dims or (0, None)
    rows = corpus.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v")).where("v is not null")
    asked = queries.select("query_id", F.col("query_vector").alias("v")).where("v is not null")
    few = asked.limit(SENT + 1).collect()
    met = _by_sent_queries(rows, few, k, low, high) if len(few) <= SENT else _by_blocks(rows, asked, k, low, high)
    if threshold is not None:
        met = met.where(F.col("score") >= threshold)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k)


def scoped_cosine_top_k(corpus: DataFrame, queries: DataFrame, scopes: DataFrame, k: int, part_of: str, vec_id: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """The ``k`` rows of each query's own scope most similar to it: query_id, vec_id, score, rank.

    ``scopes`` (query_id, scope) names the values of ``part_of`` that a query (query_id, query_vector) may search; a query without a
    scope finds nothing, and null is in no scope. Candidates meet queries by part, in blocks of a part, so no vector is scored
    for a query whose scope it is outside of, and rows of parts that nobody names don't move. Ties go to the smaller id;
    null and zero vectors take no part. Only ``k`` rows for each query leave a block.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    scope = scopes.select("query_id", F.col("scope").alias("part")).where("part is not null").distinct()
    asked = queries.select("query_id", F.col("query_vector").alias("v")).where("v is not null").join(scope, "query_id")
    rows = corpus.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v"), F.col(part_of).alias("part")).where("v is not null")
    rows = rows.join(scope.select("part").distinct(), "part", "left_semi")
    sizes = rows.groupBy("part").agg(F.ceil(F.count("*") / block).alias("blocks"))
    left = rows.join(sizes, "part").withColumn("b", F.pmod(F.xxhash64("vec_id"), F.col("blocks")))
    asks = asked.groupBy("part").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("query_blocks"))
    left = left.join(asks, "part").withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("query_blocks") - 1)))
    right = asked.join(sizes, "part").join(asks, "part").withColumn("q", F.pmod(F.xxhash64("query_id"), F.col("query_blocks")))
    right = right.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))

    def search(mine: pd.DataFrame, those: pd.DataFrame) -> pd.DataFrame:
        if not (len(mine) and len(those)):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return _best(_unit(mine["v"], 0, None), mine["vec_id"].to_numpy(), _unit(those["v"], 0, None), those["query_id"].tolist(), k)

    keys, columns = ["part", "b", "q"], lambda df, id_: df.select("part", "b", "q", id_, "v")
    met = columns(left, "vec_id").groupBy(*keys).cogroup(columns(right, "query_id").groupBy(*keys)).applyInPandas(search, HITS)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k)


HITS = "query_id long, vec_id long, score double"


def _best(x: np.ndarray, ids: np.ndarray, y: np.ndarray, askers, k: int) -> pd.DataFrame:
    """The best ``k`` of the rows ``x`` for each of the queries ``y``."""
    alive = np.abs(x).sum(axis=1) > 0
    x, ids = x[alive], ids[alive]
    out = {"query_id": [], "vec_id": [], "score": []}
    for start in range(0, len(y) if len(x) else 0, 256):
        for asker, scores in zip(askers[start : start + 256], np.round(y[start : start + 256] @ x.T, 12)):
            some = np.nonzero(scores >= np.partition(scores, -k)[-k])[0] if len(scores) > k else np.arange(len(scores))
            order = some[np.lexsort((ids[some], -scores[some]))[:k]]
            out["query_id"] += [asker] * len(order)
            out["vec_id"] += ids[order].tolist()
            out["score"] += scores[order].tolist()
    return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


def _by_sent_queries(rows: DataFrame, few: list, k: int, low: int, high: int | None) -> DataFrame:
    askers = [r["query_id"] for r in few]
    y = _unit([r["v"] for r in few], low, high) if few else None

    def search(batches):
        for batch in batches:
            if len(batch) and y is not None:
                yield _best(_unit(batch["v"], low, high), batch["vec_id"].to_numpy(), y, askers, k)

    return rows.mapInPandas(search, HITS)


def _by_blocks(rows: DataFrame, asked: DataFrame, k: int, low: int, high: int | None) -> DataFrame:
    blocks, query_blocks = (max(1, ceil(df.count() / size)) for df, size in ((rows, BLOCK), (asked, QUERY_BLOCK)))
    left = rows.withColumns({"b": F.pmod(F.xxhash64("vec_id"), F.lit(blocks)), "q": F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))})
    spread = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    right = asked.withColumns({"q": F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int"), "b": spread})

    def search(mine: pd.DataFrame, those: pd.DataFrame) -> pd.DataFrame:
        if not (len(mine) and len(those)):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return _best(_unit(mine["v"], low, high), mine["vec_id"].to_numpy(), _unit(those["v"], low, high), those["query_id"].tolist(), k)

    return left.groupBy("b", "q").cogroup(right.groupBy("b", "q")).applyInPandas(search, HITS)

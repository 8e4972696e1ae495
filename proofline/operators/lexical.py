"""Lexical index and BM25."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofline.functions.shared import written
from proofline.functions.text import tokens


#: Tokens of all queries that are sent to every task; more meet the corpus in a shuffle.
MOST_SENT = 500_000


def term_counts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, token, tf, doc_length): the postings, one row for each token of each document."""
    words = docs.select(F.col(doc_id).alias("doc_id"), tokens(F.col(text)).alias("tokens"))
    words = words.select("doc_id", F.size("tokens").cast("long").alias("doc_length"), F.explode("tokens").alias("token"))
    return words.groupBy("doc_id", "token", "doc_length").agg(F.count("*").alias("tf"))


def document_frequencies(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(token, df, idf) over all documents; idf = ln(1 + (N - df + 0.5) / (df + 0.5))."""
    distinct = docs.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("token"))
    counted = distinct.groupBy("token").agg(F.count("*").alias("df"))
    total = docs.agg(F.count("*").alias("n"))
    return counted.crossJoin(F.broadcast(total)).select(
        "token", "df", F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")
    )  # one row of totals


def asked_postings(docs: DataFrame, asked: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, token, tf) of the tokens that some query (token) has; the others of a document count under a null token.

    The texts are tokenised once, and what leaves a task is a count for each document and asked token. Written down,
    as frequencies, lengths and scores all come from it. Rows of one doc_id are one document; one without tokens has
    a row with a null token and tf 0.
    """
    words = docs.select(F.col(doc_id).alias("doc_id"), tokens(F.col(text)).alias("tokens"))
    each = words.select("doc_id", F.explode_outer("tokens").alias("word"))
    vocabulary = asked.select(F.col("token").alias("word"), F.col("token")).distinct()
    if vocabulary.limit(MOST_SENT + 1).count() <= MOST_SENT:
        vocabulary = F.broadcast(vocabulary)
    tf = F.count("word").alias("tf")
    return written(each.join(vocabulary, "word", "left").groupBy("doc_id", "token").agg(tf))


#: Queries that are scored in the tasks, against so many documents at once; more meet the postings in a join.
MOST_QUERIES, AT_ONCE = 4096, 1024


def bm25(
    docs: DataFrame, queries: DataFrame, k: int, doc_id: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75
) -> DataFrame:
    """The ``k`` best documents of each query (query_id, query): query_id, doc_id, bm25_score, rank.

    Distinct query terms count once; only positive scores are ranked; ties go by the id as a string. The corpus
    is tokenised once, and of its tokens only those that some query has are kept. Up to MOST_QUERIES queries of MOST_SENT
    tokens are sent to the tasks, where the postings of a document meet them, and ``k`` rows for each query leave a block of
    documents. More queries meet the postings in a join by token.
    """
    if k <= 0 or k1 <= 0 or not 0 <= b <= 1:
        raise ValueError("k and k1 must be positive and b between 0 and 1")
    asked = queries.select("query_id", F.explode_outer(F.array_distinct(tokens(F.col("query")))).alias("token")).where("token is not null")
    asked = written(asked.distinct())
    counted = asked_postings(docs, asked, doc_id, text)
    lengths = counted.groupBy("doc_id").agg(F.sum("tf").alias("length"))
    totals = lengths.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    postings = counted.where("token is not null")
    frequencies = postings.groupBy("token").agg(F.count("*").alias("df"))
    weighted = frequencies.crossJoin(F.broadcast(totals)).select(
        "token", F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"),
        F.when(F.col("mean") > 0, F.col("mean")).otherwise(1.0).alias("mean"),
    )
    norm = k1 * (1 - b + b * F.col("length") / F.col("mean"))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + norm)
    parts = postings.join(lengths, "doc_id").join(weighted, "token").select("token", "doc_id", part.alias("part"))
    scored = scored_in_tasks(parts, asked, k) if few_queries(asked) else _scored_in_a_join(parts, asked)
    order = Window.partitionBy("query_id").orderBy(F.round("bm25_score", 9).desc(), F.col("doc_id").cast("string"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def few_queries(asked: DataFrame) -> bool:
    """Whether the rows (query_id, token) are few enough to be sent to the tasks."""
    return asked.limit(MOST_SENT + 1).count() <= MOST_SENT and asked.select("query_id").distinct().limit(MOST_QUERIES + 1).count() <= MOST_QUERIES


def _scored_in_a_join(parts: DataFrame, asked: DataFrame) -> DataFrame:
    return parts.join(asked, "token").groupBy("query_id", "doc_id").agg(F.sum("part").alias("bm25_score")).where("bm25_score > 0")


def scored_in_tasks(parts: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id and bm25_score of the ``k`` best documents, and those that tie with them, of each block of documents."""
    names: dict = {}
    by_token: dict[str, list[int]] = {}
    for query, token in asked.collect():
        by_token.setdefault(token, []).append(names.setdefault(query, len(names)))
    sent = parts.sparkSession.sparkContext.broadcast(({token: np.array(found) for token, found in by_token.items()}, list(names)))
    types = {name: frame.schema[name].dataType.simpleString() for name, frame in (("query_id", asked), ("doc_id", parts))}

    def best(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        askers, queries = sent.value
        types_of: list[pa.DataType] = []
        ids: list = []
        places: dict[str, tuple[list[int], list[float]]] = {}

        def block() -> pa.RecordBatch:
            scores = np.zeros((len(ids), len(queries)))
            for token, (rows, values) in places.items():
                scores[np.ix_(np.array(rows), askers[token])] += np.array(values)[:, None]
            rounded = np.round(scores, 9)
            least = np.partition(rounded, -k, axis=0)[-k] if len(ids) > k else np.zeros(len(queries))
            doc, query = np.nonzero((rounded >= least) & (scores > 0))
            return pa.RecordBatch.from_arrays(
                [pa.array([queries[j] for j in query.tolist()]), pa.array([ids[i] for i in doc.tolist()], types_of[0]), pa.array(scores[doc, query])],
                ["query_id", "doc_id", "bm25_score"],
            )

        for batch in batches:
            types_of[:] = [batch.schema.field("doc_id").type]
            for token, doc, value in zip(*(batch.column(name).to_pylist() for name in ("token", "doc_id", "part"))):
                if not ids or doc != ids[-1]:
                    if len(ids) == AT_ONCE:
                        yield block()
                        ids.clear()
                        places.clear()
                    ids.append(doc)
                rows, values = places.setdefault(token, ([], []))
                rows.append(len(ids) - 1)
                values.append(value)
        if ids:
            yield block()

    together = parts.repartition("doc_id").sortWithinPartitions("doc_id", "token")
    return together.mapInArrow(best, f"query_id {types['query_id']}, doc_id {types['doc_id']}, bm25_score double")


def scoped_bm25(
    docs: DataFrame, queries: DataFrame, scopes: DataFrame, k: int, doc_id: str = "doc_id", text: str = "text", part_of: str = "source", k1: float = 1.2, b: float = 0.75
) -> DataFrame:
    """The ``k`` best documents of each query within its own scope: query_id, doc_id, bm25_score, rank.

    ``scopes`` (query_id, scope) names the values of ``part_of`` that a query may search; a query without a scope finds nothing, and
    null is in no scope. Statistics are those of the scope: a term's weight and the mean length count its documents only, as if each
    query had an index of its own. They are sums over the parts of a scope, so the corpus is counted once by part and
    token. Documents of parts that no query names are not read on, and a posting is scored only for the queries whose scope
    has its part. A ``doc_id`` names one document of one part.
    """
    if k <= 0 or k1 <= 0 or not 0 <= b <= 1:
        raise ValueError("k and k1 must be positive and b between 0 and 1")
    asked = queries.select("query_id", F.explode_outer(F.array_distinct(tokens(F.col("query")))).alias("token")).where("token is not null").distinct()
    scope = written(scopes.select("query_id", F.col("scope").alias("part_of")).where("part_of is not null").distinct().join(queries.select("query_id").distinct(), "query_id", "left_semi"))
    searched = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(part_of).alias("part_of"))
    searched = searched.join(F.broadcast(scope.select("part_of").distinct()), "part_of", "left_semi") if scope.limit(MOST_SENT + 1).count() <= MOST_SENT else searched.join(scope.select("part_of").distinct(), "part_of", "left_semi")
    wanted = written(scope.join(asked, "query_id").select("query_id", "part_of", "token"))
    named = wanted.select("part_of", "token").distinct()
    words = searched.select("doc_id", "part_of", tokens(F.col("text")).alias("tokens"))
    each = words.select("doc_id", "part_of", F.explode_outer("tokens").alias("token"))
    kept = named.withColumn("asked", F.lit(True))
    kept = F.broadcast(kept) if named.limit(MOST_SENT + 1).count() <= MOST_SENT else kept
    counted = each.join(kept, ["part_of", "token"], "left").groupBy("part_of", "doc_id", F.when(F.col("asked"), F.col("token")).alias("token")).agg(F.count("token").alias("tf"))
    return _ranked_in_scopes(written(counted), wanted, scope, k, k1, b)


def _ranked_in_scopes(counted: DataFrame, wanted: DataFrame, scope: DataFrame, k: int, k1: float, b: float) -> DataFrame:
    """From (part_of, doc_id, token or null for all others, tf) to the ranked hits of ``scoped_bm25``."""
    lengths = counted.groupBy("part_of", "doc_id").agg(F.sum("tf").alias("length"))
    of_part = written(lengths.groupBy("part_of").agg(F.count("*").alias("n"), F.sum("length").alias("all")))
    totals = scope.join(of_part, "part_of").groupBy("query_id").agg(F.sum("n").alias("n"), (F.sum("all") / F.sum("n")).alias("mean"))
    postings = counted.where("token is not null")
    part_df = written(postings.groupBy("part_of", "token").agg(F.count("*").alias("df")))
    of_query = wanted.join(part_df, ["part_of", "token"]).groupBy("query_id", "token").agg(F.sum("df").alias("df")).join(totals, "query_id")
    weighted = of_query.select(
        "query_id", "token", F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), F.when(F.col("mean") > 0, F.col("mean")).otherwise(1.0).alias("mean")
    )
    asked = written(wanted.join(weighted, ["query_id", "token"]))
    norm = k1 * (1 - b + b * F.col("length") / F.col("mean"))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + norm)
    scored = postings.join(lengths, ["part_of", "doc_id"]).join(asked, ["part_of", "token"]).groupBy("query_id", "doc_id").agg(F.sum(part).alias("bm25_score")).where("bm25_score > 0")
    order = Window.partitionBy("query_id").orderBy(F.round("bm25_score", 9).desc(), F.col("doc_id").cast("string"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

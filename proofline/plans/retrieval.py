"""Registered queries over documents and embeddings: ranking, fusion and their metrics, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofline.functions.shared import shared_folder, written
from proofline.functions.text import reference_penalty, token_budget, tokens
from proofline.operators import fusion, lexical, metrics, postings, vector
from proofline.sources.collections import read_table

TOP = 10
#: Hits of each branch that are fused, of which TOP stay.
CANDIDATES = max(TOP, 50)

_TOKENS = r"regexp_extract_all(replace(lower({}), 'ß', 'ss'), '[\x{{3400}}-\x{{9fff}}]+|[\p{{L}}\p{{N}}]+')"
#: CTEs from docs(doc_id, text) and queries(query_id, query) to ranked(query_id, doc_id, s, rank).
_BM25 = f"""
words AS (SELECT doc_id, coalesce({_TOKENS.format('text')}, []) AS toks FROM docs),
totals AS (SELECT count(*) AS n, avg(len(toks)) AS mean FROM words),
asked AS (SELECT DISTINCT query_id, unnest({_TOKENS.format('query')}) AS token FROM queries),
postings AS (SELECT doc_id, length, token, count(*) AS tf FROM (SELECT doc_id, len(toks) AS length, unnest(toks) AS token FROM words)
             WHERE token IN (SELECT token FROM asked) GROUP BY ALL),
weights AS (SELECT token, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf, CASE WHEN mean > 0 THEN mean ELSE 1 END AS mean
            FROM (SELECT token, count(*) AS df FROM postings GROUP BY ALL), totals),
scored AS (SELECT query_id, doc_id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS s
           FROM postings JOIN weights USING (token) JOIN asked USING (token) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, CAST(doc_id AS VARCHAR)) AS rank
           FROM scored WHERE s > 0 QUALIFY rank <= {TOP})"""


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.bm25(read_table(spark, sf_dir, "documents"), _questions(spark, sf_dir), TOP)
    return found.select("query_id", "doc_id", "rank", F.round("bm25_score", 6).alias("bm25_score"))


BM25_TOPK = f"""
WITH docs AS (SELECT doc_id, text FROM documents), queries AS (SELECT item_id AS query_id, text AS query FROM benchmark), {_BM25}
SELECT query_id, doc_id, CAST(rank AS INT) AS rank, round(s, 6) AS bm25_score FROM ranked"""


def _scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item may search the sources whose number is its id by three, so scopes differ and overlap."""
    sources = read_table(spark, sf_dir, "documents").select(F.col("source").alias("scope")).where("scope is not null").distinct()
    number = F.regexp_extract("scope", "[0-9]+", 0).cast("int")
    items = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 3).alias("third"))
    return sources.withColumn("third", number % 3).join(items, "third").select("query_id", "scope")


def scoped_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.scoped_bm25(read_table(spark, sf_dir, "documents"), _questions(spark, sf_dir), _scopes(spark, sf_dir), TOP)
    return found.select("query_id", "doc_id", "rank", F.round("bm25_score", 6).alias("bm25_score"))


SCOPED_BM25 = f"""
WITH words AS (SELECT doc_id, CAST(regexp_extract(source, '[0-9]+') AS INT) % 3 AS third, coalesce({_TOKENS.format('text')}, []) AS toks FROM documents WHERE source IS NOT NULL),
totals AS (SELECT third, count(*) AS n, avg(len(toks)) AS mean FROM words GROUP BY third),
asked AS (SELECT DISTINCT item_id AS query_id, item_id % 3 AS third, unnest({_TOKENS.format('text')}) AS token FROM benchmark),
postings AS (SELECT third, doc_id, length, token, count(*) AS tf FROM (SELECT third, doc_id, len(toks) AS length, unnest(toks) AS token FROM words)
             WHERE token IN (SELECT token FROM asked) GROUP BY ALL),
weights AS (SELECT third, token, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf, mean FROM (SELECT third, token, count(*) AS df FROM postings GROUP BY ALL) JOIN totals USING (third)),
scored AS (SELECT query_id, doc_id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS s
           FROM postings JOIN weights USING (third, token) JOIN asked USING (third, token) GROUP BY ALL)
SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, CAST(doc_id AS VARCHAR)) AS INT) AS rank, round(s, 6) AS bm25_score
FROM scored WHERE s > 0 QUALIFY rank <= {TOP}"""


def stored_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index is built in the shared folder and then asked; the result is that of ``bm25_topk``."""
    folder = shared_folder(spark, "postings")
    postings.build(read_table(spark, sf_dir, "documents"), folder)
    found = postings.search(spark, folder, _questions(spark, sf_dir), TOP)
    return found.select("query_id", "doc_id", "rank", F.round("bm25_score", 6).alias("bm25_score"))


def scoped_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each asking vector searches the labels that leave the same remainder by three as its id."""
    found, asking = _asking(spark, sf_dir)
    labels = found.select(F.col("label").alias("scope")).where("scope is not null").distinct().withColumn("third", F.col("scope") % 3)
    scopes = asking.select("query_id", (F.col("query_id") % 3).alias("third")).join(labels, "third").select("query_id", "scope")
    hits = vector.scoped_cosine_top_k(found, asking, scopes, TOP, "label")
    return hits.select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


def token_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.document_frequencies(read_table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("token", "df", F.round("idf", 6).alias("idf"))


TOKEN_DF = f"""
WITH w AS (SELECT list_distinct({_TOKENS.format('text')}) AS toks FROM documents), t AS (SELECT unnest(toks) AS token FROM w),
d AS (SELECT token, count(*) AS df FROM t GROUP BY ALL)
SELECT token, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM d, (SELECT count(*) AS n FROM documents)"""


def doc_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("lang", F.size(tokens(F.col("text"))).alias("n"), token_budget(F.col("text")).alias("budget"))
    return docs.groupBy("lang").agg(
        F.count("*").alias("documents"), F.round(F.avg("n"), 6).alias("mean_tokens"), F.max("n").alias("max_tokens"),
        F.sum("budget").alias("budget"), F.count_if(F.col("budget") > 900).alias("oversized"),
    )


DOC_LENGTH_STATS = rf"""
WITH d AS (SELECT lang, len({_TOKENS.format('text')}) AS n,
           len(regexp_extract_all(text, '[\x{{3400}}-\x{{9fff}}]|[A-Za-z0-9_]+|[^\s]')) AS budget FROM documents)
SELECT lang, count(*) AS documents, round(avg(n), 6) AS mean_tokens, CAST(max(n) AS INT) AS max_tokens, CAST(sum(budget) AS BIGINT) AS budget,
       count(*) FILTER (budget > 900) AS oversized FROM d GROUP BY ALL"""


def _asking(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and those whose id is divisible by 50 as queries."""
    found = read_table(spark, sf_dir, "embeddings")
    return found, found.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def dense_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector.cosine_top_k(*_asking(spark, sf_dir), TOP)
    return found.select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


#: CTE: scores(query_id, vec_id, s) of every vector for each vector whose id is divisible by 50.
_COSINES = """
scores AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(CAST(q.embedding{part} AS DOUBLE[]), CAST(e.embedding{part} AS DOUBLE[])), 12) AS s
           FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0)"""
DENSE_TOPK = f"""
WITH {_COSINES.format(part='')}
SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS INT) AS rank, round(s, 6) AS score
FROM scores QUALIFY rank <= {TOP}"""


SCOPED_COSINE = f"""
WITH {_COSINES.format(part='')}
SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS INT) AS rank, round(s, 6) AS score
FROM scores JOIN (SELECT vec_id, label FROM embeddings) l USING (vec_id) WHERE label % 3 = query_id % 3 QUALIFY rank <= {TOP}"""


def dense_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector.cosine_top_k(*_asking(spark, sf_dir), 50, threshold=0.3)
    return found.select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


DENSE_THRESHOLD = f"""
WITH {_COSINES.format(part='')}
SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS INT) AS rank, round(s, 6) AS score
FROM scores WHERE s >= 0.3 QUALIFY rank <= 50"""


def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item asks by its text and by the vector of the same id."""
    vectors, questions = read_table(spark, sf_dir, "embeddings"), _questions(spark, sf_dir)
    asking = vectors.join(questions.select(F.col("query_id").alias("vec_id")), "vec_id", "left_semi")
    asking = asking.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    dense = vector.cosine_top_k(vectors, asking, CANDIDATES).select("query_id", F.col("vec_id").alias("id"), F.col("rank").alias("position"), "score")
    lexical_hits = lexical.bm25(read_table(spark, sf_dir, "documents"), questions, CANDIDATES)
    lexical_hits = lexical_hits.select("query_id", F.col("doc_id").alias("id"), F.col("rank").alias("position"), F.col("bm25_score").alias("score"))
    fused = fusion.fuse_rrf(dense, lexical_hits, TOP)
    return fused.select("query_id", "id", "rank", F.round("rrf", 9).alias("rrf"), "dense_rank", "bm25_rank")


HYBRID_RRF = f"""
WITH docs AS (SELECT doc_id, text FROM documents), queries AS (SELECT item_id AS query_id, text AS query FROM benchmark), {_BM25.replace(f"rank <= {TOP}", f"rank <= {CANDIDATES}")},
cosines AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 12) AS s
            FROM embeddings q JOIN benchmark b ON q.vec_id = b.item_id, embeddings e),
dense AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS r FROM cosines QUALIFY r <= {CANDIDATES}),
pairs AS (SELECT query_id, id, d.r AS dense_rank, l.rank AS bm25_rank,
                coalesce(1.0::DOUBLE / (60 + d.r), 0) + coalesce(1.0::DOUBLE / (60 + l.rank), 0) AS rrf
         FROM dense d FULL JOIN (SELECT query_id, doc_id AS id, rank FROM ranked) l USING (query_id, id))
SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, least(dense_rank, bm25_rank), CAST(id AS VARCHAR)) AS INT) AS rank,
       round(rrf, 9) AS rrf, CAST(dense_rank AS INT) AS dense_rank, CAST(bm25_rank AS INT) AS bm25_rank
FROM pairs QUALIFY rank <= {TOP}"""


def weighted_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense order of 20 candidates with one that puts the query's own label first."""
    vectors, asking = _asking(spark, sf_dir)
    dense = vector.cosine_top_k(vectors, asking, 20).select("query_id", F.col("vec_id").alias("id"), "rank")
    labels = vectors.select(F.col("vec_id").alias("id"), "label")
    own = labels.select(F.col("id").alias("query_id"), F.col("label").alias("own"))
    order = Window.partitionBy("query_id").orderBy((F.col("label") == F.col("own")).desc(), "id")
    reranked = dense.join(labels, "id").join(own, "query_id").select("query_id", "id", F.row_number().over(order).alias("rank"))
    return fusion.fuse_weighted(dense, reranked, TOP).select("query_id", "id", "rank", F.round("score", 9).alias("score"))


WEIGHTED_RRF = f"""
WITH {_COSINES.format(part='')},
dense AS (SELECT query_id, vec_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS d FROM scores QUALIFY d <= 20),
pairs AS (SELECT query_id, id, d, row_number() OVER (PARTITION BY query_id ORDER BY (a.label = b.label) DESC, id) AS r
         FROM dense JOIN embeddings a ON a.vec_id = id JOIN embeddings b ON b.vec_id = query_id)
SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(2.0::DOUBLE / (60 + d) + 1.0::DOUBLE / (60 + r), 12) DESC, d, r, CAST(id AS VARCHAR)) AS INT) AS rank,
       round(2.0::DOUBLE / (60 + d) + 1.0::DOUBLE / (60 + r), 9) AS score
FROM pairs QUALIFY rank <= {TOP}"""


def _subquery_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of each benchmark item as a case: by its whole text and by each half of its words."""
    words = F.split("text", " ")
    half = (F.size(words) / 2).cast("int")
    parts = F.array(
        F.struct(F.lit("original").alias("q"), F.col("text").alias("query")),
        F.struct(F.lit("first").alias("q"), F.array_join(F.slice(words, 1, half), " ").alias("query")),
        F.struct(F.lit("second").alias("q"), F.array_join(F.slice(words, half + 1, F.size(words)), " ").alias("query")),
    )
    asked = read_table(spark, sf_dir, "benchmark").select("item_id", F.inline(parts)).select(F.concat_ws("/", "item_id", "q").alias("query_id"), "query")
    hits = lexical.bm25(read_table(spark, sf_dir, "documents"), asked, TOP)
    case = F.split("query_id", "/")
    return hits.select(case[0].cast("long").alias("case_id"), case[1].alias("query_id"), F.col("doc_id").alias("chunk_id"), "rank", F.col("bm25_score").alias("score"))


_SUBQUERIES = f"""
WITH docs AS (SELECT doc_id, text FROM documents),
split AS (SELECT item_id, text, string_split(text, ' ') AS w FROM benchmark),
queries AS (SELECT item_id || '/original' AS query_id, text AS query FROM split
            UNION ALL SELECT item_id || '/first', array_to_string(w[1:len(w) // 2], ' ') FROM split
            UNION ALL SELECT item_id || '/second', array_to_string(w[len(w) // 2 + 1:], ' ') FROM split), {_BM25},
hits AS (SELECT CAST(string_split(query_id, '/')[1] AS BIGINT) AS case_id, string_split(query_id, '/')[2] AS q, doc_id AS chunk_id, rank, s FROM ranked),
grouped AS (SELECT case_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf, max(s) AS best_score, min(rank) AS best_rank,
                   min(CASE WHEN q = 'original' AND rank <= 4 THEN 0 WHEN q <> 'original' AND rank <= 2 THEN 1 ELSE 2 END) AS class
            FROM hits GROUP BY ALL),
fused AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY round(rrf, 12) DESC, best_rank, CAST(chunk_id AS VARCHAR)) AS fused_rank FROM grouped)"""


def query_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = fusion.fuse_queries(_subquery_hits(spark, sf_dir))
    return fused.select("case_id", "chunk_id", "fused_rank", F.round("rrf", 9).alias("rrf"), F.round("retrieval_score", 6).alias("retrieval_score"), "best_rank")


QUERY_RRF = f"""{_SUBQUERIES}
SELECT case_id, chunk_id, CAST(fused_rank AS INT) AS fused_rank, round(rrf, 9) AS rrf, round(best_score, 6) AS retrieval_score, CAST(best_rank AS INT) AS best_rank FROM fused"""


def coverage_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = written(_subquery_hits(spark, sf_dir))
    chosen = fusion.select_coverage(fusion.fuse_queries(hits), hits, TOP, targets=2)
    return chosen.select("case_id", "chunk_id", "rank", "fused_rank", "class")


COVERAGE_SELECT = f"""{_SUBQUERIES},
chosen AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY class, fused_rank) AS place FROM fused QUALIFY place <= {TOP})
SELECT case_id, chunk_id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY fused_rank) AS INT) AS rank, CAST(fused_rank AS INT) AS fused_rank,
       CAST(class AS INT) AS class FROM chosen"""


def _arms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Gold sets (the two nearest others by whole vectors, or the next two), and hits by each half of the vectors."""
    vectors, asking = _asking(spark, sf_dir)
    nearest = vector.cosine_top_k(vectors, asking, 5).where("rank > 1")
    gold = nearest.select(F.col("query_id").alias("case_id"), F.floor((F.col("rank") - 2) / 2).cast("int").alias("set_id"), F.col("vec_id").alias("item"))
    hits = None
    for arm, dims in (("low", (0, 32)), ("high", (32, 64))):
        found = vector.cosine_top_k(vectors, asking, TOP, dims=dims).select(F.lit(arm).alias("arm"), F.col("query_id").alias("case_id"), F.col("vec_id").alias("item"), "rank")
        hits = found if hits is None else hits.unionByName(found)
    return gold, hits


_HALVES = f"""
WITH {_COSINES.format(part='')},
low AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(CAST(q.embedding[1:32] AS DOUBLE[]), CAST(e.embedding[1:32] AS DOUBLE[])), 12) AS s FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0),
high AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(CAST(q.embedding[33:64] AS DOUBLE[]), CAST(e.embedding[33:64] AS DOUBLE[])), 12) AS s FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0),
gold AS (SELECT query_id AS case_id, vec_id AS item, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS r, (r - 2) // 2 AS set_id FROM scores QUALIFY r BETWEEN 2 AND 5),
hits AS (SELECT 'low' AS arm, query_id AS case_id, vec_id AS item, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM low QUALIFY rank <= {TOP}
         UNION ALL SELECT 'high', query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM high QUALIFY rank <= {TOP}),
sets AS (SELECT arm, g.case_id, set_id, count(*) AS size, count(h.rank) AS present, max(h.rank) AS last
         FROM (SELECT * FROM gold, (SELECT DISTINCT arm FROM hits)) g LEFT JOIN hits h USING (arm, case_id, item) GROUP BY ALL),
best AS (SELECT arm, case_id, max(CAST(present = size AS INT)) AS hit, max(present / size) AS recall, coalesce(max(CASE WHEN present = size THEN 1.0::DOUBLE / last END), 0) AS rr
         FROM sets GROUP BY ALL),
gain AS (SELECT g.arm, g.case_id, coalesce(sum(1.0::DOUBLE / log2(h.rank + 1)), 0) AS dcg
         FROM (SELECT * FROM gold, (SELECT DISTINCT arm FROM hits)) g LEFT JOIN hits h USING (arm, case_id, item) GROUP BY ALL),
quality AS (SELECT *, dcg / (SELECT sum(1.0::DOUBLE / log2(i + 1)) FROM range(1, 5) t(i)) AS ndcg FROM best JOIN gain USING (arm, case_id))"""


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, hits = map(written, _arms(spark, sf_dir))
    found = None
    for arm in ("low", "high"):
        mine = hits.where(F.col("arm") == arm).drop("arm")
        both = metrics.best_set(gold, mine).join(metrics.ndcg(gold, mine), "case_id").withColumn("arm", F.lit(arm))
        found = both if found is None else found.unionByName(both)
    return found


def evidence_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(spark, sf_dir).select("arm", "case_id", "hit", F.round("recall", 6).alias("recall"), F.round("reciprocal_rank", 6).alias("reciprocal_rank"), F.round("ndcg", 6).alias("ndcg"))


EVIDENCE_METRICS = f"""{_HALVES}
SELECT arm, case_id, hit, round(recall, 6) AS recall, round(rr, 6) AS reciprocal_rank, round(ndcg, 6) AS ndcg FROM quality"""


def paired_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.paired_outcomes(_measured(spark, sf_dir).withColumn("value", F.round("ndcg", 9)), "low", "high")


PAIRED_ARMS = f"""{_HALVES},
pairs AS (SELECT round(h.ndcg, 9) - round(l.ndcg, 9) AS gap FROM quality l JOIN quality h USING (case_id) WHERE l.arm = 'low' AND h.arm = 'high')
SELECT count(*) FILTER (gap > 1e-12) AS wins, count(*) FILTER (abs(gap) <= 1e-12) AS ties, count(*) FILTER (gap < -1e-12) AS losses FROM pairs"""


def go_no_go(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each arm's mean metrics against a limit for each."""
    means = metrics.summary(_measured(spark, sf_dir), ["arm"], ["hit", "recall", "ndcg"])
    values = means.select("arm", F.expr("stack(3, 'hit', mean_hit, 'recall', mean_recall, 'ndcg', mean_ndcg) as (name, actual)"))
    actual = values.select(F.concat_ws(".", "arm", "name").alias("metric"), "actual")
    limits = values.select(F.concat_ws(".", "arm", "name").alias("metric"), F.lit(">=").alias("operator"), F.when(F.col("name") == "hit", 0.5).otherwise(0.2).alias("value"))
    return metrics.gates(actual, limits).select("metric", "operator", "value", F.round("actual", 6).alias("actual"), "passed")


GO_NO_GO = f"""{_HALVES},
m AS (SELECT arm || '.hit' AS metric, 0.5::DOUBLE AS value, avg(hit) AS actual FROM quality GROUP BY arm
      UNION ALL SELECT arm || '.recall', 0.2::DOUBLE, avg(recall) FROM quality GROUP BY arm
      UNION ALL SELECT arm || '.ndcg', 0.2::DOUBLE, avg(ndcg) FROM quality GROUP BY arm)
SELECT metric, '>=' AS operator, value, round(actual, 6) AS actual, actual >= value AS passed FROM m"""


def reference_penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document would lose as a passage of bracket numbers or a reference list; source is its section."""
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", reference_penalty(F.lit("paragraph"), F.col("source"), F.regexp_replace("text", "([0-9]+)", "[$1]")).alias("penalty"))


REFERENCE_PENALTIES = r"""
SELECT doc_id, CASE WHEN regexp_matches(lower(source), 'references|bibliography|参考文献') THEN 0.24::DOUBLE
  WHEN len(regexp_extract_all(left(regexp_replace(text, '([0-9]+)', '[\1]', 'g'), 1600), '\[\s*\d+(?:\s*[-,]\s*\d+)*\s*\]')) >= 3 THEN 0.18::DOUBLE ELSE 0.0::DOUBLE END AS penalty
FROM documents"""

QUERIES = {
    "bm25_topk": (bm25_topk, BM25_TOPK),
    "scoped_bm25": (scoped_bm25, SCOPED_BM25),
    "stored_bm25": (stored_bm25, BM25_TOPK),
    "token_document_frequency": (token_document_frequency, TOKEN_DF),
    "doc_length_stats": (doc_length_stats, DOC_LENGTH_STATS),
    "dense_cosine_topk": (dense_cosine_topk, DENSE_TOPK),
    "scoped_cosine": (scoped_cosine, SCOPED_COSINE),
    "dense_threshold": (dense_threshold, DENSE_THRESHOLD),
    "hybrid_rrf": (hybrid_rrf, HYBRID_RRF),
    "weighted_rrf": (weighted_rrf, WEIGHTED_RRF),
    "query_rrf": (query_rrf, QUERY_RRF),
    "coverage_select": (coverage_select, COVERAGE_SELECT),
    "evidence_metrics": (evidence_metrics, EVIDENCE_METRICS),
    "paired_arms": (paired_arms, PAIRED_ARMS),
    "go_no_go": (go_no_go, GO_NO_GO),
    "reference_penalties": (reference_penalties, REFERENCE_PENALTIES),
}

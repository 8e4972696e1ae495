"""Searches within scopes and over stored postings against plain restatements."""

import random
from collections import Counter
from math import log1p

import pytest
from pyspark.sql import functions as F

from proofline.functions.shared import shared_folder
from proofline.operators import lexical, postings, vector


@pytest.fixture(scope="module")
def corpus(spark):
    chance = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(chance.choices(words, [1 / (j + 1) for j in range(300)], k=chance.randint(0, 60))), chance.choice("abcd")) for i in range(400)]
    rows += [(400, None, "a"), (401, "w1 w2", None), (402, "\u6d4b\u8bd5\u6587\u672c W1 \uff37\uff12", "b")]
    asks = [(q, " ".join(chance.choices(words, k=6))) for q in range(12)] + [(12, "\u6d4b\u8bd5 w2"), (13, ""), (14, "nothing")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string"), spark.createDataFrame(asks, "query_id long, query string"), rows, asks


def plain_tokens(text):
    text = (text or "").replace("\uff37\uff12", "w2").lower()
    return [t for w in text.split() for t in ([w[i : i + 2] for i in range(len(w) - 1)] if w[0] > "\u3400" else [w])]


def plain_bm25(docs, asks, k):
    said = {i: Counter(plain_tokens(t)) for i, t in docs}
    mean = sum(sum(c.values()) for c in said.values()) / max(1, len(said)) or 1.0
    df = Counter(t for c in said.values() for t in c)
    found = []
    for query, text in asks:
        scores = {}
        for i, c in said.items():
            norm = 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)
            scores[i] = sum(log1p((len(said) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + norm) for t in set(plain_tokens(text)) if c[t])
        best = sorted(((round(s, 9), i) for i, s in scores.items() if s > 0), key=lambda p: (-p[0], str(p[1])))[:k]
        found += [(query, i, n + 1, pytest.approx(s, abs=1e-6)) for n, (s, i) in enumerate(best)]
    return found


def rows_of(found, score="bm25_score"):
    return [(r["query_id"], r["doc_id"], r["rank"], r[score]) for r in found.orderBy("query_id", "rank").collect()]


@pytest.mark.parametrize("most", [0, 4096])
def test_bm25_in_tasks_and_in_a_join(corpus, monkeypatch, most):
    docs, queries, rows, asks = corpus
    monkeypatch.setattr(lexical, "MOST_QUERIES", most)
    monkeypatch.setattr(lexical, "AT_ONCE", 7)
    assert rows_of(lexical.bm25(docs, queries, 5)) == plain_bm25([r[:2] for r in rows], asks, 5)


def test_each_query_has_the_statistics_of_its_scope(spark, corpus):
    docs, queries, rows, asks = corpus
    scopes = {q: "abcd"[: 1 + q % 4] if q != 5 else "" for q, _ in asks}
    given = spark.createDataFrame([(q, s) for q, found in scopes.items() for s in found] + [(3, None), (99, "a")], "query_id long, scope string")
    want = [hit for q, text in asks for hit in plain_bm25([r[:2] for r in rows if r[2] and r[2] in scopes[q]], [(q, text)], 5)]
    assert rows_of(lexical.scoped_bm25(docs, queries, given, 5)) == want
    assert lexical.scoped_bm25(docs.limit(0), queries, given, 5).count() == lexical.scoped_bm25(docs, queries, given.limit(0), 5).count() == 0


def test_stored_postings_give_the_same_and_skip_blocks(spark, corpus):
    docs, queries, rows, asks = corpus
    folder = shared_folder(spark, "postings")
    postings.build(docs, folder, block=16)
    assert rows_of(postings.search(spark, folder, queries, 5, first=2)) == plain_bm25([r[:2] for r in rows], asks, 5)
    asked, begun, left = postings.plan_blocks(spark, folder, queries, 5, first=2)
    blocks = spark.read.parquet(f"{folder}/maxima").join(asked, ["bucket", "token"]).select("query_id", "block").distinct()
    begun_blocks = 2 * blocks.select("query_id").distinct().count()
    assert left.count() + begun_blocks <= 0.9 * blocks.count()  # a tenth of all blocks at least is never scored


def test_vectors_outside_a_scope_are_not_found(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id < 150")
    asking = vectors.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    scopes = asking.select("query_id", F.explode(F.array(F.col("query_id") % 4, F.col("query_id") % 3)).alias("scope"))
    allowed = {(r["query_id"], r["scope"]) for r in scopes.collect()}
    label = {r["vec_id"]: r["label"] for r in vectors.collect()}
    for block in (7, 8192):
        found = vector.scoped_cosine_top_k(vectors, asking, scopes, 4, "label", block=block)
        whole = vector.cosine_top_k(vectors, asking, 150).collect()
        want = {}
        for r in sorted(whole, key=lambda r: (r["query_id"], r["rank"])):
            if (r["query_id"], label[r["vec_id"]]) in allowed and len(want.setdefault(r["query_id"], [])) < 4:
                want[r["query_id"]].append(r["vec_id"])
        got = {}
        for r in found.orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["vec_id"])
        assert got == {q: ids for q, ids in want.items() if ids}

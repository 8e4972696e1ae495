"""Operators on small fixtures, against rules restated in Python."""

import json
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofline.functions import boxes, text
from proofline.operators import catalog, chunking, claims, context, fusion, lexical, metrics, sampling, structure, vector
from proofline.sources import collections as store
from proofline.streaming import ingest


def values(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


# text


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


def test_tokens_split_letters_and_pair_han(spark):
    assert one(spark, text.tokens(F.lit("Straße_2 深度学习x 中 a-b"))) == ["strasse", "2", "深度", "度学", "学习", "x", "中", "a", "b"]
    assert one(spark, text.tokens(F.lit(""))) == [] and one(spark, text.tokens(F.lit(None).cast("string"))) is None


def test_fold_compatibility(spark):
    assert one(spark, text.fold_compatibility(F.lit("ﬁne ＢＥＲＴ"))) == "fine bert"


def test_token_budget(spark):
    assert one(spark, text.token_budget(F.lit("two words, 中文 x_1!"))) == 7
    assert one(spark, text.token_budget(F.lit(None).cast("string"))) == 0


@pytest.mark.parametrize("question, intent", [("Which method do they use?", "method"), ("the abstract and the method", None), ("Who?", None), ("methodical", "method"), ("实验如何", "experiment"), ("实验怎么做", None)])
def test_section_intent(spark, question, intent):
    assert one(spark, text.section_intent(F.lit(question))) == intent


def test_boost_and_penalty(spark):
    boost = lambda kind, section, body: one(spark, text.section_boost(F.lit("method"), F.lit(kind), F.lit(section), F.lit(body)))
    assert [boost("p", "2 Method", ""), boost("p", "x", "## Method\nwe"), boost("method", "x", "we"), boost("p", "x", "we")] == [0.42, 0.34, 0.3, 0.0]
    loss = lambda kind, section, body: one(spark, text.reference_penalty(F.lit(kind), F.lit(section), F.lit(body)))
    assert [loss("reference", "x", ""), loss("p", "References", ""), loss("p", "x", "[1] [2] [3]"), loss("p", "x", "[1] [2]")] == [0.24, 0.24, 0.18, 0.0]


@pytest.mark.parametrize(
    "answer, sources, want",
    [
        ("A [S1, S3-S5].", 5, "A [S1][S3][S4][S5]."), ("A [S1;S2、S2]", 2, "A [S1][S2]"), ("none", 3, "none"), ("A [ s2 ]", 3, "A [S2]"), ("A [S1-3]", 3, "A [S1][S2][S3]"),
        ("A [S9]", 3, None), ("A [S3-S1]", 3, None), ("A [S1 and x]", 3, None), ("A [S 1]", 3, None), ("A [S1；S2]", 2, None), ("A [S0]", 2, None),
        ("A [S1-S100]", 200, "A " + "".join(f"[S{i}]" for i in range(1, 101))), ("A [S1-S101]", 200, None), ("A [S1-S60, S61-S120]", 200, None),
    ],
)
def test_citations(answer, sources, want):
    assert text.normalize_citations(answer, sources) == want


def test_guarded_answers(spark):
    rows = [
        ("It holds [S1].", 2, "It holds [S1].", "passed"), ("It holds [S1, S2].", 2, "It holds [S1][S2].", "normalized_citations"), ("It holds [S1].", 0, None, "no_evidence"),
        (" ", 2, None, "empty_answer"), (None, 2, None, "empty_answer"), ("It [S1 or so].", 2, None, "malformed_citation"), ("It holds [S3].", 2, None, "malformed_citation"),
        ("The papers do not report it. [S1]", 2, None, "insufficient_evidence"), ("It holds [S1]. It does not mention more [S2].", 2, "It holds [S1]. It does not mention more [S2].", "passed"),
        ("It holds [S1]. I cannot answer your question.", 2, None, "insufficient_evidence"), ("证据不足。", 2, None, "insufficient_evidence"), ("It holds.", 2, None, "invalid_or_missing_citation"),
        ("It holds [S1] [S2", 2, None, "malformed_citation"), ("It holds", None, None, "no_evidence"),
    ]
    found = claims.guard_answers(spark.createDataFrame([(i, a, n) for i, (a, n, _, _) in enumerate(rows)], "id int, answer string, source_count int")).orderBy("id").collect()
    assert [(r["shown"], r["status"]) for r in found] == [(shown or text.NO_EVIDENCE, status) for _, _, shown, status in rows]


def test_cited_numbers(spark):
    assert one(spark, text.cited_numbers(F.lit("a [S2] b [S1, S2] c [x]"))) == [2, 1]


def test_names(spark):
    assert one(spark, text.normal_name(F.lit("  A_b--C "))) == "a b c"
    assert one(spark, text.query_id(F.lit("The First, Paper!"), F.lit(1))) == "the_first_paper" and one(spark, text.query_id(F.lit("中"), F.lit(2))) == "query_2"
    assert one(spark, text.target_identity(F.lit("BERT-Large (v2)"))) == "bertlargev2"


# boxes


def test_boxes(spark):
    box = lambda *v: F.array(*map(F.lit, v))
    assert one(spark, boxes.coverage(box(0.0, 0.0, 2.0, 2.0), box(1.0, 1.0, 3.0, 2.0))) == 0.5
    assert one(spark, boxes.coverage(box(0.0, 0.0, 2.0, 2.0), box(1.0, 1.0, 1.0, 1.0))) == 0.0
    assert one(spark, boxes.core(box(0.0, 0.0, 1.0, 10.0))) == [0.0, 3.0, 1.0, 7.0]
    assert one(spark, boxes.flipped(box(0.0, 1.0, 1.0, 3.0), F.lit(10.0))) == [0.0, 7.0, 1.0, 9.0]
    assert [one(spark, boxes.is_valid(b)) for b in (box(0.0, 0.0, 1.0, 1.0), box(2.0, 0.0, 1.0, 1.0), box(0.0, 0.0, 1.0), F.lit(None).cast("array<double>"))] == [True, False, False, False]


# ranking


def plain_bm25(docs, query, k1=1.2, b=0.75):
    split = {i: re.findall(r"\w+", t.lower()) for i, t in docs.items()}
    mean = sum(map(len, split.values())) / len(split) or 1
    scores = {}
    for term in set(re.findall(r"\w+", query.lower())):
        df = sum(term in words for words in split.values())
        for i, words in split.items():
            tf = words.count(term)
            if tf:
                idf = math.log1p((len(split) - df + 0.5) / (df + 0.5))
                scores[i] = scores.get(i, 0) + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(words) / mean))
    return sorted(((-s, str(i), i) for i, s in scores.items() if s > 0))


def test_bm25(spark):
    chance = random.Random(1)
    docs = {i: " ".join(chance.choices("red green blue dog cat the the the".split(), k=chance.randint(0, 12))) for i in range(40)}
    table = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    queries = [(1, "the dog"), (2, "red red cat"), (3, "zebra"), (4, "")]
    found = lexical.bm25(table, spark.createDataFrame(queries, "query_id long, query string"), 7).collect()
    for query_id, query in queries:
        mine = sorted((r for r in found if r["query_id"] == query_id), key=lambda r: r["rank"])
        want = plain_bm25(docs, query)[:7]
        assert [r["doc_id"] for r in mine] == [i for _, _, i in want]
        assert np.allclose([r["bm25_score"] for r in mine], [-s for s, _, _ in want])
    with pytest.raises(ValueError):
        lexical.bm25(table, table, 0)


@pytest.mark.parametrize("block", [3, 8192])
def test_cosine_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(vector, "BLOCK", block)
    monkeypatch.setattr(vector, "QUERY_BLOCK", 2)
    x = np.random.default_rng(2).normal(size=(20, 5)).round(1)
    x[7] = x[3]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(50, None), (51, [0.0] * 5)], "vec_id long, embedding array<double>")
    asking = rows.where("vec_id < 4").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    for r in vector.cosine_top_k(rows, asking, 5).collect():
        scores = (unit @ unit[r["query_id"]]).round(12)
        assert r["vec_id"] == np.lexsort((np.arange(20), -scores))[r["rank"] - 1] and abs(r["score"] - scores[r["vec_id"]]) < 1e-9
    assert all(r["score"] >= 0.9 for r in vector.cosine_top_k(rows, asking, 5, threshold=0.9).collect())


def test_hybrid_fusion(spark):
    kind = "query_id long, id string, position int, score double"
    dense = spark.createDataFrame([(1, "a", 1, 0.9), (1, "b", 2, 0.8), (1, "a", 3, 0.1)], kind)
    words = spark.createDataFrame([(1, "b", 1, 3.0), (1, "c", 2, 2.0)], kind)
    found = fusion.fuse_rrf(dense, words, 10).orderBy("rank").collect()
    assert [(r["id"], r["dense_rank"], r["bm25_rank"]) for r in found] == [("b", 2, 1), ("a", 1, None), ("c", None, 2)]
    assert found[0]["rrf"] == pytest.approx(1 / 62 + 1 / 61) and found[1]["dense_score"] == 0.9
    assert [r["id"] for r in fusion.fuse_rrf(dense.limit(0), words, 1).collect()] == ["b"]


def test_weighted_fusion_needs_the_same_items(spark):
    kind = "query_id long, id string, rank int"
    dense = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 1)], kind)
    other = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (2, "x", 1)], kind)
    assert values(fusion.fuse_weighted(dense, other, 5), "query_id", "id", "rank") == [(1, "a", 1), (1, "b", 2)]
    assert values(fusion.unequal_orders(dense, other), "query_id") == [(2,)]


def test_queries_fuse_and_cover(spark):
    chance = random.Random(4)
    kind = "case_id long, query_id string, chunk_id string, rank int, score double"
    for _ in range(3):
        lists = {q: chance.sample("abcdefghijklmnopqrst", 10) for q in ("original", "x", "y")}
        hits = spark.createDataFrame([(1, q, c, i + 1, 1.0 / (i + 1)) for q, cs in lists.items() for i, c in enumerate(cs)], kind)
        fused = fusion.fuse_queries(hits)
        score = {}
        for cs in lists.values():
            for i, c in enumerate(cs):
                score[c] = score.get(c, 0) + 1 / (61 + i)
        best = {c: min(cs.index(c) for cs in lists.values() if c in cs) for c in score}
        order = sorted(score, key=lambda c: (-round(score[c], 12), best[c], c))
        assert [r["chunk_id"] for r in fused.orderBy("fused_rank").collect()] == order
        held = list(dict.fromkeys([*lists["original"][:4], *lists["x"][:2], *lists["y"][:2]]))
        for c in order:
            if len(held) < 10 and c not in held:
                held.append(c)
        chosen = fusion.select_coverage(fused, hits, 10, targets=2).orderBy("rank").collect()
        assert [r["chunk_id"] for r in chosen] == [c for c in order if c in held]
    with pytest.raises(Exception, match="twice"):
        fusion.fuse_queries(hits.union(hits)).collect()
    with pytest.raises(ValueError):
        fusion.select_coverage(fused, hits, 5, targets=2)


# collections


def test_catalog_and_changes(spark):
    rows = spark.createDataFrame([(1, "a", "k1", 5), (2, "a", "k1", 9), (3, "b", "k2", 7), (4, None, "k2", 1)], "id long, file string, kb string, created int")
    assert [tuple(r) for r in catalog.document_catalog(rows, "file", "id", "created").collect()] == [("a", 2, 1, 9), ("b", 1, 3, 7), (None, 1, 4, 1)]
    assert tuple(catalog.collection_stats(rows, "file", "created").first()) == (4, 2, 9)
    assert values(catalog.all_stats(rows, "kb", "file"), "kb", "n_rows", "files", "is_total") == [("k1", 2, 1, 0), ("k2", 2, 1, 0), (None, 4, 2, 1)]
    left, removed = catalog.without(rows, spark.createDataFrame([("a",)], "file string"), "file")
    assert values(left, "id") == [(3,), (4,)] and removed.first()["removed"] == 2
    assert values(catalog.already_present(rows, rows.where("id = 1"), ["file", "kb"]), "id") == [(1,), (2,)]
    assert values(catalog.dangling(rows, rows.where("id = 3"), "file", "file"), "id") == [(1,), (2,)]
    scope = rows.where(catalog.in_scope(["k2"], ["a"], F.col("kb"), F.col("file")))
    assert values(scope, "id") == [(1,), (2,), (3,), (4,)]


def test_uploads(spark, tmp_path):
    payload = {
        "filename": "p.pdf",
        "data": {
            "chunks": [{"chunk_id": "c1", "text": "raw", "retrieval_text": "title raw", "metadata": {"k": "chunk", "o": "own"}}, {"chunk_id": "c2", "text": "  "}, {"chunk_id": "c3", "text": "only", "retrieval_text": " "}],
            "metadata": {"k": "document", "file_id": "f1"},
        },
    }
    (tmp_path / "u").mkdir()
    (tmp_path / "u" / "p.json").write_text(json.dumps(payload))
    rows = store.read_uploads(spark, str(tmp_path / "u")).orderBy("chunk_text").collect()
    assert [(r["chunk_text"], r["file_id"]) for r in rows] == [("only", "f1"), ("title raw", "f1")]
    assert rows[1]["metadata"] == {"k": "document", "o": "own", "chunk_id": "c1", "file_id": "f1"}
    for _ in range(2):  # the second time the file is stored already
        ingest.ingest(ingest.upload_stream(spark, str(tmp_path / "u")), str(tmp_path / "store"), "kb", str(tmp_path / f"c{_}")).awaitTermination()
    assert store.read_collection(spark, str(tmp_path / "store"), "kb").count() == 2


def test_embedding_checks(spark):
    ok = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.0, 1.0])], "i int, v array<double>")
    assert store.check_embeddings(ok, "i", "i", "v").count() == 0
    bad = spark.createDataFrame([(0, [1.0]), (2, [float("nan"), 1.0])], "i int, v array<double>")
    assert values(store.check_embeddings(bad, "i", "i", "v"), "reason") == [("indexes",), ("not finite",), ("widths",)]


# metrics


def test_evidence_metrics(spark):
    gold = spark.createDataFrame([(1, 0, "a"), (1, 0, "b"), (1, 1, "z"), (2, 0, "a"), (3, 0, "q")], "case_id long, set_id int, item string")
    ranked = spark.createDataFrame([(1, "n", 1), (1, "a", 2), (1, "b", 3), (2, "a", 1)], "case_id long, item string, rank int")
    assert values(metrics.best_set(gold, ranked), "case_id", "hit", "recall", "reciprocal_rank") == [(1, 1, 1.0, 1 / 3), (2, 1, 1.0, 1.0), (3, 0, 0.0, 0.0)]
    found = dict(values(metrics.ndcg(gold, ranked), "case_id", "ndcg"))
    ideal = sum(1 / math.log2(i + 1) for i in (1, 2, 3))
    assert found[1] == pytest.approx((1 / math.log2(3) + 1 / math.log2(4)) / ideal) and found[2] == 1.0 and found[3] == 0.0


def test_decisions(spark):
    scores = spark.createDataFrame([(1, "a", 0.1), (1, "b", 0.2), (2, "a", 0.5), (2, "b", 0.5), (3, "a", 1.0)], "case_id long, arm string, value double")
    assert tuple(metrics.paired_outcomes(scores, "a", "b").first()) == (1, 1, 0)
    rows = spark.createDataFrame([("x", "x"), ("x", "y"), ("y", "y"), (None, "x")], "g string, p string")
    found = {r["class"]: r for r in metrics.by_class(rows, "g", "p").collect()}
    assert (found["x"]["precision"], found["x"]["recall"], found["y"]["precision"]) == (1.0, 0.5, 0.5) and found["x"]["f1"] == pytest.approx(2 / 3)
    bag = lambda a, b: one(spark, metrics.bag_f1(F.array(*map(F.lit, a)), F.array(*map(F.lit, b))))
    assert bag(["1", "1", "2"], ["1", "1", "1"]) == pytest.approx(4 / 6)
    limits = spark.createDataFrame([("m", ">=", 0.5), ("m", "<", 0.5), ("gone", "==", 1.0)], "metric string, operator string, value double")
    gated = metrics.gates(spark.createDataFrame([("m", 0.5)], "metric string, actual double"), limits)
    assert values(gated, "metric", "operator", "passed") == [("gone", "==", False), ("m", "<", False), ("m", ">=", True)]
    run = lambda *v: spark.createDataFrame([("s", m, x, d) for m, x, d in v], "stage_id string, metric_id string, value double, direction string")
    compared = metrics.compare_runs(run(("a", 1.0, "higher"), ("b", 1.0, "lower"), ("c", 1.0, "neutral")), run(("a", 2.0, ""), ("b", 2.0, ""), ("c", 2.0, ""), ("d", 1.0, "")))
    assert values(compared, "metric_id", "verdict") == [("a", "improved"), ("b", "regressed"), ("c", "unchanged")]


# samples


def test_proportional_sample(spark):
    chance = random.Random(8)
    for n in (2, 5, 17):
        rows = [(i, chance.choice("aaaabbc")) for i in range(40)]
        found = sampling.proportional(spark.createDataFrame(rows, "id long, s string"), "s", "id", n).collect()
        sizes = {s: sum(x == s for _, x in rows) for s in "abc"}
        if n < 3:
            want = {next(i for i, x in rows if x == s) for s in sorted(sizes, key=lambda s: (-sizes[s], s))[:n]}
        else:
            places = [(sum(y == s and j < i for j, y in rows) / sizes[s], s, i) for i, s in rows]
            want = {i for _, _, i in sorted(places)[:n]}
        assert {r["id"] for r in found} == want


def test_turns_and_strata(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(20)], "id long, s string")
    turns = sampling.by_turns(rows, "s", "id", 5, "seed").collect()
    assert [(r["turn"], r["s"]) for r in turns] == [(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a")]
    assert values(sampling.per_stratum(rows, "s", "id", 3, "x"), "id") == values(sampling.per_stratum(rows.repartition(3), "s", "id", 3, "x"), "id")


# context


def test_nearest_context(spark):
    kinds = "xcx|cxxc|x"
    rows = spark.createDataFrame([(1, i, k) for i, k in enumerate(kinds)], "g int, i int, k string")
    found = values(context.nearest_context(rows, ["g"], ["i"], F.col("k") == "c", F.col("i"), F.col("k") == "|"), "i", "before", "after")
    for i, before, after in found:
        low = max((j for j in range(i + 1) if kinds[j] == "|"), default=0)
        high = min((j for j in range(i + 1, len(kinds)) if kinds[j] == "|"), default=len(kinds))
        assert before == max((j for j in range(low, i) if kinds[j] == "c"), default=None)
        assert after == min((j for j in range(i + 1, high) if kinds[j] == "c"), default=None)


def test_band_join(spark):
    chance = random.Random(6)
    a, b = ([(chance.randint(0, 1), chance.randint(-50, 50)) for _ in range(60)] for _ in range(2))
    frame = lambda rows: spark.createDataFrame(rows, "g int, p int")
    found = context.within_band(frame(a), frame(b), ["g"], "p", 7)
    assert values(found, "g", "l_p", "r_p") == sorted(((g, p, q) for g, p in a for h, q in b if g == h and abs(p - q) <= 7), key=repr)


def test_spans_islands_bridges(spark):
    spans = F.array(*[F.struct(F.lit(s).alias("start"), F.lit(e).alias("stop")) for s, e in ((0, 5), (1, 4), (4, 9), (0, 5))])
    assert [tuple(s) for s in one(spark, context.widest_spans(spans))] == [(0, 5), (4, 9), (0, 5)]
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate("aabba")], "g int, i int, s string")
    from pyspark.sql import Window

    same = F.col("s") == F.lag("s").over(Window.partitionBy("g").orderBy("i"))
    assert [x for _, x in values(context.islands(rows, ["g"], ["i"], same), "i", "island")] == [1, 1, 2, 2, 3]
    pages = spark.createDataFrame([(1, 1, "abcdef"), (1, 2, "ghijkl"), (1, 4, "mn"), (1, 5, " ")], "d int, page int, t string")
    assert values(context.bridges(pages, ["d"], "page", "t", 3), "from_page", "bridge") == [(1, "def\nghi")]


# chunks


def test_pages_split_and_stitch(spark):
    md = spark.createDataFrame([(1, "intro{{第2页}}# Title\nText that ends.{{第3页}}and goes on"), (2, None)], "id long, t string")
    pages = chunking.markdown_pages(md, "id", "t")
    assert values(pages, "page", "text") == [(1, "intro"), (2, "# Title\nText that ends."), (3, "and goes on")]
    chunks = chunking.chunk_pages(pages, size=100).orderBy("chunk_index").collect()
    assert [(c["page_start"], c["page_end"], c["text"], c["continued"]) for c in chunks] == [(1, 1, "intro", False), (2, 3, "# Title\nText that ends.\nand goes on", True)]


def test_split_text_keeps_everything():
    chance = random.Random(3)
    for _ in range(50):
        whole = "".join(chance.choices(["word ", "longerword", ". ", "\n", "\n\n", "。"], k=80))
        parts = list(chunking.split_text(whole, 50))
        assert "".join(parts) == whole and all(len(p) <= 50 for p in parts)


def test_stitch_rules():
    piece = lambda t, p: {"text": t, "page_start": p, "page_end": p}
    joined = lambda *ps, **k: [c["text"] for c in chunking.stitch(list(ps), 20, **k)]
    assert joined(piece("a" * 10, 1), piece("b" * 10, 1)) == ["a" * 10 + "\n" + "b" * 10]
    assert len(joined(piece("a" * 15, 1), piece("b" * 10, 1))) == 2
    assert len(joined(piece("a" * 9 + ".", 1), piece("b" * 10, 2))) == 2
    assert len(joined(piece("a" * 10, 1), piece("b" * 10, 2))) == 1
    assert len(joined(piece("a" * 10, 1), piece("- item", 2))) == 2
    assert len(joined(piece("a", 1), piece("# b", 1))) == 2 and len(joined(piece("a", 1), piece("# b", 1), by_heading=False)) == 1
    assert len(joined(piece("a", 1), piece("b", 2), piece("c", 3), piece("d", 4))) == 2 and len(joined(piece("a", 1), piece("b", 3))) == 2


def test_packing(spark):
    chance = random.Random(7)
    rows = [(1, i, chance.choice(["s", "s", "t"]), " ".join("w" * chance.randint(1, 9) for _ in range(chance.randint(1, 12)))) for i in range(40)]
    found = chunking.pack_paragraphs(spark.createDataFrame(rows, "doc_id long, position int, section string, text string"), 15, 20).orderBy("chunk_index").collect()
    want = []
    for _, _, section, body in rows:
        n = len(body.split())
        if want and want[-1][0] == section and want[-1][2] < 15 and want[-1][2] + n <= 20:
            want[-1] = (section, want[-1][1] + "\n\n" + body, want[-1][2] + n)
        else:
            want.append((section, body, n))
    assert [(r["section"], r["text"], r["token_count"]) for r in found] == want


def test_anchors(spark):
    body = "See Fig. 2 for it. Second one!\nA line without end " + "word " * 200 + "。Last"
    rows = chunking.evidence_anchors(spark.createDataFrame([(1, body), (2, None), (3, " ")], "id long, t string"), "id", "t", 100).collect()
    assert all(body[r["start"] : r["stop"]] == r["text"] and 0 < len(r["text"]) <= 100 for r in rows)
    assert [r["text"] for r in rows[:2]] == ["See Fig. 2 for it.", "Second one!"] and {r["doc_id"] for r in rows} == {1}
    assert "".join("".join(r["text"] for r in rows).split()) == "".join(body.split())


# structure


def test_reading_order(spark):
    def row(i, *box):
        return (1, 1, i, list(map(float, box)))

    blocks = [row(1, 55, 10, 95, 20), row(2, 5, 10, 45, 20), row(3, 5, 60, 45, 70), row(4, 55, 60, 95, 70), row(5, 5, 40, 95, 50), row(6, 5, 90, 95, 99)]
    table = spark.createDataFrame([*blocks, (1, 2, 1, None), (1, 2, 2, [0.0, 0.0, 1.0, 1.0])], "paper_id long, page int, ord int, bbox array<double>")
    found = structure.reading_order(table)
    order = [r["ord"] for r in found.where("page = 1").orderBy("reading_index").collect()]
    assert order == [6, 3, 4, 5, 2, 1]
    assert values(found.where("page = 2"), "ord", "reading_index", "order_method") == [(1, 1, "original"), (2, 2, "original")]


def test_section_paths(spark):
    heads = [("heading", "Abstract"), ("text", "a"), ("heading", "1 Introduction"), ("heading", "1.2 Scope"), ("text", "b"), ("heading", "2. Method"), ("heading", "Details"), ("text", None), ("heading", "References")]
    rows = spark.createDataFrame([(1, i, k, t) for i, (k, t) in enumerate(heads)], "paper_id long, ord int, type string, text string")
    paths = [r["section_path"] for r in structure.section_paths(rows).orderBy("ord").collect()]
    assert paths[1] == ["Abstract"] and paths[4] == ["1 Introduction", "1.2 Scope"] and paths[7] == ["2. Method", "Details"] and paths[8] == ["References"]


def test_sections_of_stored_papers(spark):
    """Ids of stored papers are strings; an unnumbered Related Work is of the first level."""
    heads = [("heading", "1 Introduction"), ("heading", "1.1 Scope"), ("heading", "Related Work"), ("text", "a"), ("heading", "Experiments"), ("text", "b")]
    rows = spark.createDataFrame([("p1", 1, i, k, t) for i, (k, t) in enumerate(heads)], "paper_id string, page int, ord int, type string, text string")
    paths = [r["section_path"] for r in structure.section_paths(rows).orderBy("ord").collect()]
    assert paths[3] == ["Related Work"] and paths[5] == ["Related Work", "Experiments"]
    blocks = spark.createDataFrame([("p1", 1, 0, "figure", ""), ("p1", 1, 1, "caption", "Figure 1: x")], rows.schema)
    assert values(structure.figure_claims(blocks), "paper_id", "figure_ord") == [("p1", 0)]


def test_captions_and_boxes(spark):
    rows = [(1, 1, 1, "table", ""), (1, 1, 2, "caption", "Table 1: x"), (1, 1, 3, "table", ""), (1, 1, 4, "caption", "Figure 2"), (1, 1, 9, "figure", "")]
    blocks = spark.createDataFrame(rows, "paper_id long, page int, ord int, type string, text string")
    assert values(structure.caption_targets(blocks, "table"), "caption_ord", "target_ord") == [(2, 1)]
    assert values(structure.caption_targets(blocks, "figure"), "caption_ord", "target_ord") == [(4, 9)]
    cells = spark.createDataFrame([(1, "a", [0.0, 0.0, 10.0, 10.0]), (1, "b", [10.0, 0.0, 20.0, 10.0])], "table_id long, cell_id string, bbox array<double>")
    texts = spark.createDataFrame([(1, 1, [1.0, 1.0, 5.0, 5.0]), (1, 2, [8.0, 1.0, 12.0, 5.0]), (1, 3, [11.0, 1.0, 15.0, 5.0])], "table_id long, text_id int, bbox array<double>")
    assert values(structure.assign_boxes(cells, texts), "text_id", "cell_id") == [(1, "a"), (3, "b")]


# claims


def test_claim_replies():
    reply = lambda **k: json.dumps({"status": "answered", "claims": [{"text": "One thing holds.", "evidence_ids": ["e1"]}]} | k)
    known = {"e1", "e2"}
    assert claims.read_claims(reply(), known) == ("answered", [("One thing holds.", ["e1"])])
    assert claims.read_claims(reply(status="insufficient", claims=[]), known) == ("insufficient", [])
    claim = lambda t="One.", ids=("e1",): [{"text": t, "evidence_ids": list(ids)}]
    for bad in (None, "no", reply(status="x"), reply(extra=1), reply(claims=[]), reply(claims=claim(ids=["e9"])), reply(claims=claim(ids=[])), reply(claims=claim(ids=["e1", "e1"])),
                reply(claims=claim("Two. Sentences here.")), reply(claims=claim("- item")), reply(claims=claim("cited [S1]")), reply(claims=claim() * 2), reply(claims=claim("x" * 1201)),
                '{"status": "answered", "status": "answered", "claims": []}', '{"status": NaN, "claims": []}'):
        assert claims.read_claims(bad, known) == ("invalid", []), bad
    for text in ("code `x` here", "a <a href=x> tag", "a <h1> tag", "［S1］ cited", "【 s1】 cited", "two\nlines", "two\u2028lines", "# head", "甲。乙", "It is. So (there)"):
        assert claims.read_claims(reply(claims=claim(text)), known) == ("invalid", []), text
    for text in ("It is 3.5 of Fig. 2, e.g. so.", "Let $a. b$ be it!”", "中文。", "No stop", "A; b"):
        assert claims.read_claims(reply(claims=claim(text)), known)[0] == "answered", text


def test_verdicts_of_all_states(spark):
    import itertools

    rows = list(itertools.product(*[sorted(x) for x in (claims.STATES, claims.STATES, claims.STATES, claims.RELATIONS, claims.BASES)], (True, False)))
    table = spark.createDataFrame(rows, "c string, s string, k string, r string, b string, g boolean")
    found = table.withColumn("v", claims.verdict(*[F.col(x) for x in "cskrbg"])).collect()
    assert len(found) == 4**3 * 3 * 5 * 2
    for row in found:
        scope = row["s"]
        if row["r"] == "claim_broader":
            scope = scope if scope == "contradicted" else "missing"
        if scope == "entailed" and row["r"] == "unknown":
            scope = "uncertain"
        if scope == "entailed" and (row["b"] == "none" or row["g"] and row["b"] in ("single_example", "inference")):
            scope = "missing"
        states = {row["c"], scope, row["k"]}
        want = "unsupported" if states & {"contradicted", "missing"} else "uncertain" if "uncertain" in states else "supported"
        assert row["v"] == want


def test_risk_cues(spark):
    claim = "Not all models always fail, only if tuned; most work 通常."
    kinds = [(k, w) for _, _, k, w in claims.risk_cues(claim)]
    assert kinds == [("limited_quantifier", "Not all"), ("generalization", "always"), ("condition", "only if"), ("generalization", "most"), ("generalization", "通常")]
    assert tuple(one(spark, claims.cue_counts(F.lit(claim)))) == (1, 3, 1)


def test_decisions_are_read_strictly():
    check = {"status": "entailed", "reason": "r", "evidence_ids": ["e1"]}
    good = {"packet_id": "p", "claim_id": "c", "checks": {"content": check, "conditions": check | {"status": "missing", "evidence_ids": []}, "scope": check | {"basis": "none", "relation": "unknown"}}}
    read = lambda reply: claims.read_decision(json.dumps(reply) if isinstance(reply, dict) else reply, "p", "c", {"e1"})
    assert read(good) == good["checks"]
    broken = [None, "", "[]", good | {"packet_id": "q"}, good | {"more": 1}]
    for facet, change in (("content", {"evidence_ids": []}), ("content", {"evidence_ids": ["e2"]}), ("content", {"status": "yes"}), ("content", {"reason": " "}), ("scope", {"basis": "x"}), ("content", {"basis": "none"}), ("content", {"evidence_ids": ["e1", "e1"]})):
        broken.append(good | {"checks": good["checks"] | {facet: good["checks"][facet] | change}})
    assert [read(b) for b in broken] == [None] * len(broken)


def test_gates(spark):
    packets = spark.createDataFrame([(a, f"{a}{i}") for a in "abcde" for i in (1, 2)], "answer_id string, packet_id string")
    said = [("a1", "supported"), ("a2", "supported"), ("b1", "uncertain"), ("b2", "unsupported"), ("c1", "unsupported"), ("d1", "what"), ("d2", "supported"), ("e1", "supported"), ("e1", "supported"), ("e2", "uncertain")]
    found = dict(values(claims.gate_answers(packets, spark.createDataFrame(said, "packet_id string, verdict string")), "answer_id", "state"))
    assert found == {"a": "supported", "b": "unsupported", "c": "incomplete", "d": "invalid", "e": "invalid"}


def test_quotes(spark):
    def at(quote, source):
        found = one(spark, claims.align_quote(F.lit(quote), F.lit(source)))
        return found and tuple(found)

    assert at("b  c", "a b\nc d") == (2, 5, "b\nc", False) and at("c", "a  b c") == (5, 6, "c", True) and at("a", "a a") is None and at("z", "a") is None
    assert at("b ", "a b") is None and at("b ", "a b  c") == (2, 5, "b  ", False) and at(" ", "a b") is None and at("aa", "aaa") is None
    assert at("x.*", "a 😀 x.* b") == (4, 7, "x.*", True) and at("\\\\E(", "q \\\\E(") == (2, 6, "\\\\E(", True) and at("q" * 1201, "q" * 1201) is None
    assert at("a\nb", "xa  b a \tb.") is None and at(" a b", "c  a\n\nb") == (1, 7, "  a\n\nb", False)


# streams


def test_windows_of_a_stream_equal_those_of_the_table(spark, tmp_path):
    rows = spark.sql("select id as event_id, timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, cast(id * 7 as int), 0) as ts, id % 3 as user_id, 'click' as event_type, double(id) as value from range(200)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for name, query in (("w", lambda e: ingest.event_windows(e, "1 hour", watermark="10 minutes")), ("s", lambda e: ingest.sessions(e, "10 minutes", watermark="10 minutes"))):
        job = query(stream).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        job.awaitTermination()
        whole = {repr(tuple(r)) for r in query(rows).collect()}
        got = [repr(tuple(r)) for r in spark.table(name).collect()]
        assert got and set(got) <= whole and len(got) == len(set(got))
    twice = rows.union(rows).withColumn("k", F.col("event_id"))
    twice.write.parquet(str(tmp_path / "twice"))
    once = ingest.first_of_each(spark.readStream.schema(twice.schema).parquet(str(tmp_path / "twice")), "k", "3 days")
    once.writeStream.format("memory").queryName("once").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("once").count() == 200


def test_sentence_units(spark):
    body = "# Head. Line\nOne, e.g. this. Two “it.”  See http://a.b/c.d now! $x. y$ ends.\n\n| a. | b |\nPara 3.14 is. 中文。好" + " word" * 60
    spans = chunking.unit_spans(body)
    assert [body[a:b].strip() for a, b in spans][:6] == ["# Head. Line", "One, e.g. this.", "Two “it.”", "See http://a.b/c.d now!", "$x. y$ ends.", "| a. | b |"]
    assert "".join(body[a:b] for a, b in spans) == body
    rows = chunking.evidence_units(spark.createDataFrame([(1, body), (2, None), (3, "  ")], "id long, t string"), "id", "t", 50).collect()
    assert {r["doc_id"] for r in rows} == {1} and all(r["text"] == body[r["start"] : r["stop"]] and len(r["text"]) <= 50 and r["refused"] is None for r in rows)
    assert "".join(r["text"] for r in sorted(rows, key=lambda r: (r["unit"], r["part"]))) == body and max(r["parts"] for r in rows) > 1


def test_units_cut_nothing_that_must_stay_whole(spark):
    formula, link = "$x = y + z$", "https://a.example/some/path.html"
    body = f"We show that {formula} holds, see {link}. " + "word" * 30
    for most in (16, 20, 40):
        for a, b in chunking.unit_spans(body):
            try:
                cuts = {end for _, end in chunking.unit_parts(body, a, b, most)}
            except ValueError as error:
                assert (str(error) == "protected_span_too_long") == (most < len(link))
                continue
            for kept in (formula, link):
                at = body.index(kept)
                assert not any(at < c < at + len(kept) for c in cuts)
    rows = chunking.evidence_units(spark.createDataFrame([(1, "a" * 2000), (2, "Yes. " * 1700), (3, "fine")], "id long, t string"), "id", "t", 100).collect()
    said = {}
    for r in rows:
        said.setdefault(r["doc_id"], set()).add(r["refused"])
    assert said == {1: {"too_many_unit_parts"}, 2: {"evidence_catalog_too_large"}, 3: {None}}


def test_units_and_anchors_take_linear_time():
    import time

    began = time.perf_counter()
    body = "See Fig. 2, e.g. this. Then $a$ holds! " * 25_000
    assert len(chunking.unit_spans(body)) == 50_000 and len(chunking.anchors(body)) == 50_000
    assert time.perf_counter() - began < 20


def test_identifiers_and_language(spark):
    head = F.lit("Published 2021 (arXiv: 2106.09685v2), https://doi.org/10.1000/AB.c-1).")
    assert tuple(one(spark, text.identifiers(head))) == ("10.1000/AB.c-1", "2106.09685v2", 2021)
    assert tuple(one(spark, text.identifiers(F.lit("nothing")))) == (None, None, None)
    assert [one(spark, text.written_language(F.lit(t))) for t in ("中文文本 abc", "mostly english 中", "12")] == ["zh", "en", None]


def test_claim_units(spark):
    answer = "# Title\nThe findings:\nOne thing holds. [S1][S2] Another one! [S3]\nOk.\n中文结论。[S1]"
    assert claims.claim_units(answer) == ["One thing holds.", "[S1][S2] Another one!", "中文结论。[S1]"]
    assert claims.claim_units("甲是乙。丙是丁。结束了。") == ["甲是乙。丙是丁。结束了。"]
    more = "## Head\n1. **Part**:\nAs Fig. 2 of Lee et al. shows, it is so. But e.g. not here: it fails.\nShort lead:\nIn a sentence. Then this:\n"
    assert claims.claim_units(more) == ["As Fig. 2 of Lee et al. shows, it is so.", "But e.g. not here: it fails.", "In a sentence.", "Then this:"]
    rows = claims.claims_of_answers(spark.createDataFrame([(1, answer), (2, None)], "answer_id long, answer string"))
    assert values(rows, "position", "citations") == [(0, []), (1, [1, 2]), (2, [1])]
    judged = spark.createDataFrame([([1], True), ([], True)], "citations array<int>, supported boolean")
    assert values(claims.no_evidence_no_support(judged), "supported") == [(False,), (True,)]


def test_scarce_strata_first(spark):
    chance = random.Random(12)
    rows = [(i, chance.choice("aaabbc"), chance.randint(0, 14)) for i in range(90)]
    table = spark.createDataFrame(rows, "id long, s string, g int")
    found = sampling.scarce_first(table, "s", "g", "id", 4, "x").collect()
    assert len(found) == 12 and len({r["g"] for r in found}) == 12 and all(sum(r["s"] == s for r in found) == 4 for s in "abc")
    assert {r["id"] for r in sampling.scarce_first(table.repartition(5), "s", "g", "id", 4, "x").collect()} == {r["id"] for r in found}
    with pytest.raises(ValueError):
        sampling.scarce_first(table, "s", "g", "id", 9, "x")

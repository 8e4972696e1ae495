"""Requests, displays and changes of a store on rows made for them."""

import pytest
from pyspark.sql import functions as F

from proofline.functions import display
from proofline.operators import audits, catalog, requests, structure


def rows(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def test_candidates():
    assert [requests.candidates_for_sections(k) for k in (1, 5, 10, 60)] == [5, 25, 50, 50]
    assert requests.hybrid_candidates(10) == 50 and requests.hybrid_candidates(80) == 80
    for bad in ((0, 50), (501, 50), (5, 0), (5, 501)):
        with pytest.raises(ValueError):
            requests.hybrid_candidates(*bad)


def test_dense_hits_of_a_hybrid_search(spark):
    dense = spark.createDataFrame([(1, "a", 1, 0.9), (1, "x", 2, 0.8), (1, "b", 3, 0.7), (1, "c", 4, 0.1)], "query_id long, id string, position int, score double")
    corpus = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "id string")
    assert rows(requests.hybrid_dense(dense, corpus, 0.5), "id", "rank") == [("a", 1), ("b", 2)]


def test_named_papers(spark):
    hits = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "a", "z"), (3, "c", "w")], "case_id long, filename string, id string")
    named = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (4, "a")], "case_id long, filename string")
    assert rows(requests.named_papers_gate(hits, named), "case_id", "id", "status") == [(1, "x", "complete"), (1, "y", "complete"), (3, "w", None)]
    assert rows(requests.missing_papers(hits, named), "case_id", "missing_documents") == [(2, ["b"]), (4, ["a"])]
    reranked = hits.where("id <> 'y'")
    assert rows(requests.reranked_or_nothing(reranked, hits, named), "case_id", "id") == [(2, "z"), (3, "w")]


def test_store_changes(spark):
    chunks = spark.createDataFrame([("k1", "a"), ("k1", "b"), ("k2", "a"), (None, " ")], "collection string, filename string")
    names = spark.createDataFrame([("k1", "One"), ("k2", "Two")], "collection string, display_name string")
    assert [r[0] for r in catalog.filenames(chunks, "filename").collect()] == ["a", "b"]
    assert catalog.chunks_of(chunks, "filename", "a", 1).count() == 1
    left, left_names = catalog.drop_collection(chunks, names, "collection", "k1")
    assert rows(left, "collection") == [("k2",), (None,)] and rows(left_names, "collection") == [("k2",)]
    changed = catalog.upsert_names(names, spark.createDataFrame([("k2", "New"), ("k3", "B"), ("k3", "A")], names.schema))
    assert rows(changed, "collection", "display_name") == [("k1", "One"), ("k2", "New"), ("k3", "B")]
    assert rows(catalog.totals(chunks.limit(0), "collection", "filename"), "collections", "files", "chunks") == [(0, 0, 0)]
    assert rows(catalog.searched(names, "one", "display_name", "collection"), "collection") == [("k1",)] and catalog.searched(names, " ", "collection").count() == 2
    assert [r["x"] for r in catalog.recent(spark.createDataFrame([(1, 5), (2, 7), (3, 7)], "x int, t int"), "t", "x", 2).collect()] == [2, 3]


def test_displays(spark):
    one = lambda column: spark.range(1).select(column.alias("x")).first()["x"]
    assert one(display.linked(F.lit("[S1][s2] (x) [S3](#e) y"))) == "[S1](#evidence-S1)[S2](#evidence-S2) (x) [S3](#e) y"
    assert one(display.place(F.lit(3), F.lit(None).cast("int"), F.array(F.lit("A"), F.lit("B")))) == "第 3 页 · A › B"
    assert one(display.place(F.lit(None).cast("int"), F.lit(4), F.lit(None).cast("array<string>"))) == display.NO_PLACE
    assert one(display.folded_lines(F.lit("\n a  b\t c \r\n\n d \n"))) == "a b c\n\nd"
    assert one(display.plain_words(F.lit("Ａ ﬁne, Straße_1!"))) == "a fine strasse_1"
    assert [one(display.identifier(F.lit(v))) for v in (" a.1", "2A", "3", "")] == ["A.1", "2a", "3", ""]
    assert one(display.page_range(F.lit(5), F.lit(3))) == [] and one(display.page_range(F.lit(2), F.lit(4))) == [2, 3, 4]
    assert [one(display.suspicious_title(F.lit(v))) for v in (None, " ", "Research  Article", "https://a.b/c/d", "A proper title")] == [True, True, True, True, False]
    assert [one(display.is_image_path(F.lit(v))) for v in ("![](a/b-1.png)", "a.gif ", "see a.png", "")] == [True, True, False, False]


def test_order_invariants(spark):
    table = spark.createDataFrame([(1, 1, 1, 1), (1, 1, 2, 2), (2, 1, 1, 1), (2, 1, 1, 2), (3, 1, 1, 1), (3, 1, 2, 3)], "paper_id long, page int, ord int, reading_index int")
    assert rows(audits.order_invariants(table), "paper_id", "kept", "counted") == [(1, True, True), (2, False, True), (3, True, False)]


def test_merged_headings(spark):
    cut = structure.merged_headings
    assert cut("2 Method 2.1 Data 2.2 Model 3 End") == ["2 Method", "2.1 Data", "2.2 Model 3 End"] and cut("2 Method 3 End 4. Last") == ["2 Method", "3 End", "4. Last"]
    assert cut("1 Of 3 kinds") == ["1 Of 3 kinds"] and cut("On 2 Things") == ["On 2 Things"] and cut(None) == cut(" ") == [] and cut("A 1 x 2 y") == ["A 1 x 2 y"]
    blocks = spark.createDataFrame([(1, 1, "heading", "1 One 2 Two"), (1, 2, "paragraph", "1 One 2 Two"), (1, 3, "heading", None)], "paper_id long, ord int, type string, text string")
    assert rows(structure.split_headings(blocks), "ord", "part", "text") == [(1, 0, "1 One"), (1, 1, "2 Two"), (2, 0, "1 One 2 Two"), (3, 0, None)]


def test_titles_and_special_sections(spark):
    given = [(1, "heading", "A Paper"), (1, "heading", "1 Intro"), (2, "heading", "Abstract"), (2, "heading", "x"), (3, "heading", "1 One"), (3, "heading", "x"), (4, "heading", "alone"), (5, "heading", "x"), (5, "title", "T"), (5, "heading", "y")]
    blocks = spark.createDataFrame([(p, i, k, t) for i, (p, k, t) in enumerate(given)], "paper_id long, ord int, type string, text string")
    assert rows(structure.title_blocks(blocks), "paper_id", "ord") == [(1, 0), (5, 8)]
    paths = spark.createDataFrame([(1, ["Abstract"]), (2, ["2 Method"]), (3, ["Appendix", "A.1 More", "Details"]), (4, []), (5, None), (6, ["Appendix B: Rest"])], "ord int, section_path array<string>")
    assert rows(structure.special_sections(paths), "ord", "section_kind") == [(1, "abstract"), (2, None), (3, "appendix"), (4, None), (5, None), (6, "appendix")]
    assert [structure.heading_level(t, [(2, "x")]) for t in ("Appendix", "Appendix B.1 Rest", "A.1.2 More", "3.4 y", "z")] == [1, 2, 3, 2, 3]


def test_figures_are_claimed_once(spark):
    given = [(1, "figure", ""), (2, "caption", "Figure 1"), (3, "caption", "Fig. 2"), (4, "figure", ""), (6, "figure", "Figure 3"), (7, "figure", ""), (8, "caption", "Figure 3: x"), (9, "caption", "no label"), (10, "caption", "Figure 4"), (11, "caption", "Figure 5")]
    blocks = spark.createDataFrame([(1, 1, *g) for g in given], "paper_id long, page int, ord int, type string, text string")
    assert rows(structure.figure_claims(blocks), "caption_ord", "figure_ord") == [(10, 7), (2, 1), (3, 4), (8, 6)]
    assert structure.figure_claims(blocks.limit(0)).count() == 0

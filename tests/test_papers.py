"""Structure-aware chunks."""

import random

import pytest
from proofline.operators import papers

BLOCK = "paper_id long, block_id string, ord int, type string, text string, page int, section_path array<string>, caption_of string, context_ids array<string>"
PAPER = "paper_id long, filename string, title string, authors array<string>"


def words(n, tag="w"):
    return " ".join(f"{tag}{i}" for i in range(n - 1)) + " end."


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [
        (1, "b0", 0, "title", "The Paper", 1, [], None, None),
        (1, "b1", 1, "paragraph", words(10, "abs"), 1, ["Abstract"], None, None),
        (1, "b2", 2, "paragraph", words(12), 1, ["1 Intro"], None, None),
        (1, "b3", 3, "paragraph", words(12), 2, ["1 Intro"], None, None),
        (1, "b4", 4, "caption", "Table 1: numbers", 2, ["1 Intro"], "b5", None),
        (1, "b5", 5, "table", "| a | b |\n| --- | --- |\n" + "\n".join(f"| {i} | x |" for i in range(4)), 2, ["1 Intro"], None, None),
        (1, "b6", 6, "paragraph", words(45), 3, ["1 Intro"], None, None),
        (1, "b7", 7, "figure", "fig.png", 3, ["2 Body"], None, ["b2"]),
        (1, "b8", 8, "caption", "Figure 1: shapes", 3, ["2 Body"], "b7", None),
        (1, "b9", 9, "formula", "a = b", 3, ["2 Body"], None, ["b3"]),
        (1, "b10", 10, "formula", "c = d", 3, ["2 Body"], None, None),
        (1, "b11", 11, "paragraph", "[1] Someone.", 4, ["References"], None, None),
        (2, "b0", 0, "paragraph", "Only this. And 中文。再来", None, None, None, None),
    ]
    blocks = spark.createDataFrame(rows, BLOCK)
    about = spark.createDataFrame([(1, "p.pdf", "The Paper", ["A B", "C D"]), (2, "two.pdf", None, None)], PAPER)
    return papers.structure_chunks(blocks, about, target=20, most=28)


def test_kinds_and_order(chunks):
    rows = chunks.where("paper_id = 1").orderBy("chunk_index").collect()
    assert [r["content_type"] for r in rows] == ["abstract", "paragraph", "table", "table", "paragraph", "paragraph", "figure", "formula"]
    assert all(r["token_count"] <= 28 and r["token_count"] == papers.tokens(r["text"]) for r in rows)
    assert rows[0]["text"].startswith("The Paper\nA B, C D\nAbstract\n\nabs0") and rows[0]["retrieval_text"].startswith("The Paper\nAbstract\n")
    assert rows[0]["source_block_ids"] == ["b0", "b1"] and rows[0]["section_path"] == ["Abstract"]
    assert rows[1]["source_block_ids"] == ["b2", "b3"] and (rows[1]["page_start"], rows[1]["page_end"]) == (1, 2)
    assert [(r["row_start"], r["row_end"]) for r in rows[2:4]] == [(1, 2), (3, 4)] or rows[2]["row_start"] == 1
    assert all(r["text"].startswith("Table 1: numbers\n| a | b |\n| --- | --- |") for r in rows if r["content_type"] == "table")
    assert rows[6]["text"].startswith("Figure 1: shapes") and rows[6]["context_block_ids"] == ["b2"] and rows[7]["context_block_ids"] == ["b3"]
    assert rows[4]["chunk_id"] == "1:paragraph:b6:part_0001" and len({r["chunk_id"] for r in rows}) == len(rows)


def test_a_paper_without_anything_but_text(chunks):
    row = chunks.where("paper_id = 2").first()
    assert row["text"] == "Only this. And 中文。再来" and row["retrieval_text"].startswith("two.pdf\n") and row["page_start"] is None and row["section_path"] == []


def test_stats(chunks):
    stats = {r["content_type"]: r for r in papers.chunk_stats(chunks, 28).collect()}
    assert stats["paragraph"]["chunks"] == 4 and sum(r["oversized"] for r in stats.values()) == 0


def test_parts_lose_no_word():
    chance = random.Random(1)
    for _ in range(40):
        text = " ".join(chance.choice(["word", "two.", "中文。", "x" * 30, "end!", "a_b"]) for _ in range(60))
        found = papers.parts_of(text, 7)
        assert "".join("".join(found).split()) == "".join(text.split()) and all(papers.tokens(p) <= 7 for p in found)


def test_tables_without_structure():
    assert [w for *_, w in papers.table_parts("a b\nc d", "cap", 50)] == ["table_row_structure_unavailable"]
    assert {w for *_, w in papers.table_parts("| " + words(40) + "|\n| --- |\n| 1 |", "", 10)} == {"table_core_split"}
    found = papers.table_parts("| a |\n| --- |\n| " + words(40) + " |\n| 1 |", "", 30)
    assert "split_oversized_table_row" in {w for *_, w in found} and found[-1][1:3] == (2, 2)


def test_limits():
    with pytest.raises(ValueError):
        papers.structure_chunks(None, None, 10, 5)

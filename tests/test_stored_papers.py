"""Papers stored as JSON files."""

import json

import pytest

from proofline.sources import collections


@pytest.fixture()
def stored(tmp_path):
    block = lambda i, **more: {"block_id": f"b{i}", "order": i, "type": "paragraph", "text": f"t{i}"} | more
    papers = {
        "x/p1": {"schema_version": "1", "paper_id": "p1", "filename": "a.pdf", "metadata": {"title": "A", "authors": ["M"], "year": 2020}, "sections": [{"section_id": "s", "title": "One", "level": 1}],
                 "blocks": [block(1, page=1, bbox=[0, 0, 1, 1], relations={"section_id": "s"}), block(2, page=2), block(3, text=" ", page=3, bbox=[0, 0, 1, 1])]},
        "p2": {"paper_id": "p2", "filename": "b.pdf", "blocks": []},
    }
    for name, paper in papers.items():
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / "document.json").write_text(json.dumps(paper))
        (tmp_path / name / "other.json").write_text("{}")
    return str(tmp_path)


def test_papers_are_read_with_their_blocks(spark, stored):
    papers = collections.read_papers(spark, stored)
    rows = {r["paper_id"]: r for r in papers.collect()}
    assert set(rows) == {"p1", "p2"} and rows["p1"]["metadata"]["year"] == 2020 and rows["p2"]["metadata"] is None and rows["p1"]["path"].endswith("x/p1/document.json")
    blocks = collections.paper_blocks(papers).orderBy("ord").collect()
    assert [(r["paper_id"], r["ord"], r["text"], r["page"]) for r in blocks] == [("p1", 1, "t1", 1), ("p1", 2, "t2", 2), ("p1", 3, " ", 3)]
    assert json.loads(blocks[0]["relations"]) == {"section_id": "s"} and blocks[1]["bbox"] is None


def test_parse_quality(spark, stored):
    blocks = collections.paper_blocks(collections.read_papers(spark, stored))
    pages = spark.createDataFrame([("p1", 4), ("p2", 2), ("p3", 0)], "paper_id string, total_pages int")
    rows = {r["paper_id"]: r for r in collections.parse_quality(blocks, pages).collect()}
    assert (rows["p1"]["total_blocks"], rows["p1"]["parsed_pages"], rows["p1"]["empty_block_count"], rows["p1"]["empty_page_numbers"]) == (3, 2, 1, [3, 4])
    assert rows["p1"]["provenance_coverage"] == pytest.approx(2 / 3) and rows["p2"]["empty_page_numbers"] == [1, 2] and rows["p3"]["empty_page_numbers"] == [] and rows["p1"]["block_counts"] == {"paragraph": 3}


def test_a_broken_file_fails_the_read(spark, tmp_path):
    (tmp_path / "document.json").write_text("not json")
    with pytest.raises(Exception):
        collections.read_papers(spark, str(tmp_path)).collect()

"""Trees of JSON pointers: order, levels, provenance, refusals and table structures."""

import json

import pytest

from proofline.sources import trees


def ref(kind, i):
    return {"$ref": f"#/{kind}/{i}"}


def item(label, text="", children=(), **more):
    return {"label": label, "text": text, "children": list(children), **more}


def place(page, origin="BOTTOMLEFT"):
    return [{"page_no": page, "bbox": {"l": 1, "t": 20, "r": 3, "b": 10, "coord_origin": origin}}]


CELLS = [
    {"text": "a|b", "start_row_offset_idx": 0, "end_row_offset_idx": 1, "start_col_offset_idx": 0, "end_col_offset_idx": 2, "row_span": 1, "col_span": 2, "column_header": True},
    {"text": "x", "start_row_offset_idx": 1, "end_row_offset_idx": 2, "start_col_offset_idx": 0, "end_col_offset_idx": 1, "row_span": 1, "col_span": 1},
]


def paper():
    return {
        "name": "p", "pages": {"1": {"size": {"width": 60, "height": 100}}}, "body": {"children": [ref("texts", 0), ref("groups", 0), ref("tables", 0), ref("pictures", 0), ref("texts", 5)]},
        "groups": [item("list", children=[ref("texts", 2), ref("groups", 1)]), item("inline", children=[ref("texts", 1)])],
        "texts": [
            item("section_header", " Intro ", [ref("texts", 6)], prov=place(1, "TOPLEFT"), level=2), item("list_item", "second", prov=place(2, "TOPLEFT")), item("list_item", "first", prov=place(1)),
            item("caption", "Figure 1", prov=[]), item("text", "inside the picture"), item("formula", " ", orig=" a = b (1) ", confidence=0.5), item("page_footer", "7", [ref("texts", 7)], content_layer="furniture"),
            item("odd"), item("text", "never reached"),
        ],
        "tables": [item("table", data={"num_rows": 2, "num_cols": 2, "table_cells": CELLS, "grid": [[{"text": "a|b"}, {"text": "a|b"}], [{"text": "x\n y"}, {}]]})],
        "pictures": [item("picture", children=[ref("texts", 3), ref("texts", 4)], captions=[ref("texts", 3)])],
    }


@pytest.fixture()
def stored(tmp_path):
    cycle, lost, shared = paper(), paper(), paper()
    cycle["texts"][1]["children"] = [ref("groups", 0)]
    lost["body"]["children"].append(ref("texts", 99))
    shared["body"]["children"].append(ref("texts", 0))
    for name, tree in {"good": paper(), "cycle": cycle, "lost": lost, "shared": shared, "empty": {}, "odd": {"body": {"children": [{"$ref": "#/body"}]}}, "null": {"body": {"children": [{}]}}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(tree))
    return str(tmp_path)


def test_blocks_in_reading_order(spark, stored):
    blocks, refused = trees.tree_blocks(trees.read_trees(spark, stored))
    rows = blocks.orderBy("ord").collect()
    assert {r["paper_id"].rsplit("/", 1)[1] for r in rows} == {"good.json"}
    assert [(r["type"], r["text"], r["level"]) for r in rows] == [
        ("heading", "Intro", 2), ("odd", "", None), ("list_item", "first", None), ("list_item", "second", None), ("table", "| a&#124;b | a&#124;b |\n| --- | --- |\n| x y |  |", None), ("figure", "", None),
        ("caption", "Figure 1", None), ("formula", "a = b (1)", None),
    ]
    assert [r["block_id"] for r in rows] == [f"block_{i:06d}" for i in range(8)] and [r["page"] for r in rows][:4] == [1, None, 1, 2]
    assert rows[0]["bbox"] == [1, 80, 3, 90] and rows[2]["bbox"] == [1, 20, 3, 10] and rows[3]["bbox"] is None and rows[7]["formula_text_source"] == "orig_fallback" and rows[7]["confidence"] == 0.5
    assert {r["paper_id"].rsplit("/", 1)[1]: r["reason"] for r in refused.collect()} == {"cycle.json": "repeated", "shared.json": "repeated", "lost.json": "dangling", "odd.json": "dangling", "null.json": "dangling"}


def test_furniture_on_demand(spark, stored):
    blocks, _ = trees.tree_blocks(trees.read_trees(spark, stored), layers=("body", "furniture"))
    assert ("page_footer", "7") in {(r["type"], r["text"]) for r in blocks.collect()}


def test_json_text_and_broken_rows(spark):
    rows = spark.createDataFrame([(1, json.dumps(paper())), (2, "{"), (3, None), (4, "{}")], "paper_id long, json string")
    blocks, refused = trees.tree_blocks(trees.parse_trees(rows, "json"))
    assert blocks.groupBy("paper_id").count().collect() == [(1, 8)] and refused.count() == 0


def test_a_broken_file_fails_the_read(spark, tmp_path):
    (tmp_path / "x.json").write_text("not json")
    with pytest.raises(Exception):
        trees.read_trees(spark, str(tmp_path)).collect()


def changed(i, **more):
    return [c | more if j == i else c for j, c in enumerate(CELLS)]


def test_table_structures(spark):
    cases = [
        (2, CELLS, "1 unrecognized grid slots exported as empty cells"), (1, CELLS, "cell 1: out-of-bounds offsets"), (0, CELLS, "invalid table dimensions"), (200_000, CELLS, "table exceeds safe grid size"),
        (2, [], "missing or excessive table cells"), (2, changed(1, start_row_offset_idx=0, row_span=2), "cell 1: overlapping cells"), (2, changed(0, col_span=1), "cell 0: spans disagree with offsets"),
        (2, changed(1, text=None), "cell 1: text is not a string"), (2, changed(1, row_span=None), "cell 1: offsets/spans must be integers"), (2, changed(1, bbox={"l": 1}), "cell 1: invalid bbox coordinates"),
        (2, changed(1, start_row_offset_idx=0, row_span=2) + [{}], "cell 1: overlapping cells"), (2, [None, *CELLS], "cell 0: invalid cell payload"),
        (2, [*CELLS, CELLS[1] | {"start_col_offset_idx": 1, "end_col_offset_idx": 2}], None),
    ]
    tree = lambda rows, cells: {"body": {"children": [ref("tables", 0)]}, "tables": [item("table", data={"num_rows": rows, "num_cols": 2, "table_cells": cells})]}
    given = spark.createDataFrame([(i, json.dumps(tree(rows, cells))) for i, (rows, cells, _) in enumerate(cases)], "paper_id long, json string")
    found = {r["paper_id"]: r for r in trees.table_structures(trees.tree_blocks(trees.parse_trees(given, "json"))[0]).collect()}
    for i, (_, _, warning) in enumerate(cases):
        assert found[i]["warnings"] == ([warning] if warning else []), i
        assert found[i]["valid"] == (warning is None or warning.startswith("1 ")), i


def test_from_json_to_chunks(spark):
    from proofline.operators.papers import bound_blocks, structure_chunks

    one = place(1)
    texts = [
        item("section_header", "1 Method", prov=one), item("text", "Figure 2 shows the flow.", prov=one), item("caption", "Figure 2: the flow", prov=one), item("text", "We define", prov=one), item("formula", "a = b (1)", prov=one),
        item("text", "where a is known.", prov=one), item("caption", "Table 1: sizes", prov=one), item("section_header", "2 Results", prov=one), item("text", "By Eq. (1) all is well.", prov=one), item("caption", "Figure 9: no picture", prov=one),
    ]
    order = [*(ref("texts", i) for i in range(2)), ref("pictures", 0), *(ref("texts", i) for i in range(2, 7)), ref("tables", 0), *(ref("texts", i) for i in range(7, 10))]
    table = item("table", prov=one, data={"num_rows": 2, "num_cols": 1, "grid": [[{"text": "n"}], [{"text": "5"}]]})
    tree = {"body": {"children": order}, "texts": texts, "tables": [table], "pictures": [item("picture", prov=one)]}
    given = spark.createDataFrame([("p", json.dumps(tree))], "paper_id string, json string")
    blocks, _ = trees.tree_blocks(trees.parse_trees(given, "json"))
    held = bound_blocks(blocks)
    bound = {r["ord"]: r for r in held.collect()}
    b = "block_{:06d}".format
    assert {k: r["caption_of"] for k, r in bound.items() if r["caption_of"]} == {3: b(2), 7: b(8)}
    assert {k: r["context_ids"] for k, r in bound.items() if r["context_ids"]} == {2: [b(1)], 5: [b(4), b(6)]}
    assert bound[10]["section_path"] == ["2 Results"]
    about = spark.createDataFrame([("p", "p.pdf", "A paper", [])], "paper_id string, filename string, title string, authors array<string>")
    rows = structure_chunks(held, about).orderBy("chunk_index").collect()
    assert [r["content_type"] for r in rows] == ["paragraph", "figure", "paragraph", "formula", "paragraph", "table", "paragraph"]
    assert rows[1]["text"] == "Figure 2: the flow\n\nFigure 2 shows the flow." and rows[3]["context_block_ids"] == [b(4), b(6)]
    assert rows[5]["text"] == "Table 1: sizes\n| n |\n| --- |\n| 5 |" and rows[5]["page_start"] == 1 and rows[0]["source_block_ids"] == [b(1)]

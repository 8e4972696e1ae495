"""Checks of bindings and re-reads of cells, by cases."""

import pytest

from proofline.operators import rereads

CELL = "table_id long, cell_id long, row int, col int, row_span int, col_span int, header boolean, bbox array<double>"
WORD = "table_id long, ocr_id long, cell_id long, text string, bbox array<double>"
LINE = "table_id long, cell_id long, line_id long, text string, score double, bbox array<double>"
TRACE = (
    "table_id long, physical_boxes int, cells array<struct<cell_id:long,row:int,col:int,row_span:int,col_span:int,bbox:array<double>,text:string,ocr_ids:array<long>>>,"
    "words array<struct<ocr_id:long,text:string,bbox:array<double>>>"
)


def trace():
    cells = [[k, 0, k, 1, 1, [k * 10.0, 0.0, k * 10 + 10.0, 10.0], f"w{k}", [k]] for k in range(3)]
    return [1, 3, cells, [[k, f"w{k}", [k * 10 + 1.0, 1.0, k * 10 + 9.0, 9.0]] for k in range(3)]]


def change(path, value):
    found = trace()
    at = found
    for step in path[:-1]:
        at = at[step]
    at[path[-1]] = value
    return found


@pytest.fixture(scope="module")
def verdicts(spark):
    cases = {
        "right": (trace(), []), "count": (change([1], 4), ["cell_count"]), "no boxes known": (change([1], None), ["cell_count"]),
        "cell id": (change([2, 1, 0], 0), ["repeated_cell_id"]), "place": (change([2, 1, 2], 0), ["repeated_position"]), "negative": (change([2, 1, 1], -1), ["invalid_position"]),
        "span": (change([2, 1, 3], 0), ["invalid_position"]), "null place": (change([2, 1, 2], None), ["invalid_position"]), "no box": (change([2, 1, 5], None), ["missing_geometry"]),
        "flat box": (change([2, 1, 5], [10.0, 0.0, 10.0, 10.0]), ["missing_geometry"]), "word id": (change([3, 1, 0], 0), ["repeated_word_id", "unknown_word"]),
        "unknown": (change([2, 1, 7], [1, 9]), ["unknown_word", "low_overlap"]), "unbound": (change([2, 1, 7], None), ["unbound_word", "text_mismatch"]),
        "twice": (change([2, 1, 7], [1, 1]), ["word_bound_twice", "text_mismatch"]), "elsewhere": (change([3, 1, 2], [15.0, 1.0, 25.0, 9.0]), ["low_overlap"]),
        "text": (change([2, 1, 6], "other"), ["text_mismatch"]), "spaces": (change([2, 1, 6], "  w1\n"), []), "null text": (change([2, 1, 6], None), ["text_mismatch"]),
        "no cells": ([1, 0, None, None], ["cell_count"]),
    }
    rows = [[i, *row[1:]] for i, (row, _) in enumerate(cases.values())]
    found = {r["table_id"]: r for r in rereads.trace_anomalies(spark.createDataFrame(rows, TRACE)).collect()}
    return {name: (found[i], want) for i, (name, (_, want)) in enumerate(cases.items())}


def test_anomalies_of_traces(verdicts):
    for name, (found, want) in verdicts.items():
        assert found["reasons"] == want and found["accepted"] == (want == []), name


def grid(table_id=1):
    """Two rows of two cells; the word AB 7 lies over both cells of the second row."""
    cells = [[table_id, r * 2 + c, r, c, 1, 1, False, [c * 50.0, r * 50.0, c * 50 + 50.0, r * 50 + 50.0]] for r in range(2) for c in range(2)]
    words = [[table_id, 0, 0, "Head A", [5.0, 5.0, 20.0, 15.0]], [table_id, 1, 1, "Head B", [55.0, 5.0, 70.0, 15.0]], [table_id, 2, None, "AB", [40.0, 60.0, 60.0, 70.0]], [table_id, 3, 2, "7", [5.0, 75.0, 15.0, 85.0]]]
    lines = [[table_id, 2, 0, "A 7", 0.99, [10.0, 60.0, 20.0, 70.0]], [table_id, 3, 0, "B", 0.99, [60.0, 60.0, 70.0, 70.0]]]
    return cells, words, lines


def broken(case, table_id):
    cells, words, lines = grid(table_id)
    if case == "missing":
        lines.pop()
    if case == "another cell":
        lines.append([table_id, 0, 0, "x", 0.9, [5.0, 5.0, 9.0, 9.0]])
    if case == "blank":
        lines[0][3] = " \t"
    if case == "null text":
        lines[0][3] = None
    if case == "low":
        lines[0][4] = 0.1
    if case == "nan":
        lines[0][4] = float("nan")
    if case == "outside":
        lines[0][5] = [0.0, 0.0, 9.0, 9.0]
    if case == "repeated":
        lines.append([table_id, 2, 1, *lines[0][3:]])
    if case == "number":
        lines[0][3] = "A"
    if case == "one cell":
        words[2][4] = [10.0, 60.0, 20.0, 70.0]
    if case == "two rows":
        words[2][4] = [40.0, 40.0, 60.0, 60.0]
    if case == "off the table":
        words[2][4] = [90.0, 60.0, 110.0, 70.0]
    if case == "span":
        cells[2][4] = 2
    if case == "narrow":
        cells[3][7][2] = 62.0
    return cells, words, lines


WANT = {
    "right": [], "missing": ["invalid_or_missing_reread"], "another cell": ["invalid_or_missing_reread"], "blank": ["invalid_or_missing_reread"], "null text": ["invalid_or_missing_reread"],
    "low": ["invalid_or_missing_reread"], "nan": ["invalid_or_missing_reread"], "outside": ["invalid_or_missing_reread"], "repeated": ["invalid_or_missing_reread"], "number": ["numbers_lost"],
    "one cell": None, "two rows": None, "off the table": None, "span": None, "narrow": None,
}


def test_rereads(spark):
    parts = [broken(case, i) for i, case in enumerate(WANT)]
    frames = [spark.createDataFrame([row for part in parts for row in part[k]], schema) for k, schema in enumerate((CELL, WORD, LINE))]
    verdict, words = rereads.apply_rereads(*frames)
    found = {r["table_id"]: r for r in verdict.collect()}
    for i, (case, want) in enumerate(WANT.items()):
        assert (found[i]["reasons"] if i in found else None) == want, case
    after = sorted((r["table_id"], r["cell_id"], r["source"], r["text"]) for r in words.collect())
    assert after == [(0, 0, "original", "Head A"), (0, 1, "original", "Head B"), (0, 2, "reread", "A 7"), (0, 3, "reread", "B")]
    assert found[list(WANT).index("number")]["lost_numbers"] == 1


def test_nothing_to_read_anew(spark):
    cells, words, _ = grid()
    none = spark.createDataFrame([], LINE)
    verdict, after = rereads.apply_rereads(spark.createDataFrame(cells, CELL), spark.createDataFrame([w for w in words if w[2] is not None], WORD), none)
    assert verdict.collect() == [] and after.collect() == []

"""Records in table rows: cases by hand, and random rows against a plain restatement."""

import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from proofline.operators import records

CELL = "table_id long, cell_id long, row int, col int, row_span int, col_span int, header boolean, bbox array<double>"
WORD = "table_id long, cell_id long, ocr_id long, text string, bbox array<double>"


def table(count=4, wrap=True, extra=False, table_id=1):
    """A header row, a row of ``count`` records in three columns, and perhaps a row below."""
    bounds = [0, 40, 40 + count * 40] + ([70 + count * 40] if extra else [])
    cells = [[table_id, r * 3 + c, r, c, 1, 1, False, [c * 120.0, float(bounds[r]), c * 120 + 120.0, float(bounds[r + 1])]] for r in range(len(bounds) - 1) for c in range(3)]
    words = []

    def add(row, col, y, text, indent=5, width=100):
        words.append([table_id, row * 3 + col, len(words), text, [col * 120.0 + indent, float(y), col * 120.0 + indent + width, y + 10.0]])

    for c, name in enumerate(("Input", "Size", "Output")):
        add(0, c, 10, name)
    for i in range(count):
        y = 48 + i * 40
        add(1, 0, y, f"Sample {i + 1} alpha" + ("-" if wrap and i % 2 == 0 else ""))
        add(1, 1, y, f"{i + 2} kg", width=40)
        add(1, 2, y, f"Batch {i + 10} beta" + ("-" if wrap and i % 2 else ""))
        if wrap:
            add(1, i % 2 * 2, y + 15, "continued", indent=15, width=70)
    if extra:
        for c in range(3):
            add(2, c, bounds[2] + 8, "unchanged")
    return cells, words


def split(spark, cells, words):
    found, audit = records.split_records(spark.createDataFrame(cells, CELL), spark.createDataFrame(words, WORD))
    return found.collect(), {r["row"]: r for r in audit.collect()}


def test_records_are_split_and_no_word_is_lost(spark):
    cells, words = table(extra=True)
    found, audit = split(spark, cells, words)
    text = {(r["row"], r["col"]): r["text"] for r in found}
    assert len(found) == 18 and audit[1]["records"] == 4 and audit[1]["reasons"] == []
    assert (text[1, 0], text[2, 2], text[4, 1]) == ("sample 1 alpha- continued".capitalize(), "Batch 11 beta- continued", "5 kg")
    assert [text[5, c] for c in range(3)] == ["unchanged"] * 3 and {r["operation"] for r in found if r["row"] == 5} == {"moved"}
    assert sorted(i for r in found for i in r["ocr_ids"]) == list(range(len(words)))


def broken(cells, words, case):
    if case == "no anchor":
        for w in words:
            w[3] = "ordinary text" if w[1] == 4 else w[3]
    if case == "labels of one column":
        for w in words:
            w[3] = "wrapped sentence" if w[1] == 3 else w[3]
    if case == "continuation at the edge":
        words[3][3], words[6][4] = "Sample 1 alpha", [5.0, 63.0, 75.0, 73.0]
    if case == "span":
        cells[3][4] = 2
    if case == "header":
        for c in cells[3:]:
            c[6] = True
    if case == "uneven row":
        cells[4][7] = [120.0, 41.0, 240.0, 200.0]
    if case == "typed continuation":
        words[6][3] = "Sample 9 more"
    return cells, words


@pytest.mark.parametrize(
    "case, reason",
    [("no anchor", "no_record_partition"), ("labels of one column", "insufficient_labels"), ("continuation at the edge", "unsupported_continuation"),
     ("span", "span_or_header"), ("uneven row", "inconsistent_geometry"), ("typed continuation", "unsupported_continuation")],
)
def test_what_forbids_a_split(spark, case, reason):
    cells, words = broken(*table(), case)
    found, audit = split(spark, cells, words)
    assert reason in audit[1]["reasons"] and all(r["operation"] == "unchanged" for r in found)
    assert sorted(i for r in found for i in r["ocr_ids"]) == list(range(len(words)))


def test_headers_short_rows_and_empty_tables_are_in_no_doubt(spark):
    for cells, words in (broken(*table(), "header"), table(2, False), (table()[0], []), ([], [])):
        found, audit = split(spark, cells, words)
        assert audit == {} and len(found) == len(cells)


def test_a_table_with_one_uncertain_row_stays_whole_and_others_dont(spark):
    bad, good = broken(*table(extra=True), "no anchor"), table(5, False, True, 2)
    found, audit = split(spark, bad[0] + good[0], bad[1] + good[1])
    assert {r["operation"] for r in found if r["table_id"] == 1} == {"unchanged"}
    assert max(r["row"] for r in found if r["table_id"] == 2) == 6


def test_null_texts_and_repeated_boxes(spark):
    cells, words = table(3, False)
    words += [[1, 0, 90, None, [5.0, 10.0, 20.0, 20.0]], [1, 0, 91, "", [5.0, 10.0, 20.0, 20.0]]]
    found, _ = split(spark, cells, words)
    assert sorted(i for r in found for i in r["ocr_ids"]) == sorted(w[2] for w in words)


def test_typed_starts(spark):
    cases = {"5 kg": "number_unit:kg", "-3,5 %": "number_unit:%", "7": "number_unit:", "4 km/h": "number_unit:km/h", "Sample 2 b": "prefix_number:sample", "a b-c 1": "prefix_number:a b-c",
             "a b c d 1": None, "５ ＫＧ": "number_unit:kg", "1.2.3": None, "": None, "x" * 101: None, "word": None, None: None, "  5\t kg ": "number_unit:kg"}
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", records.typed_start(F.col("t")).alias("k"))
    assert {r["t"]: r["k"] for r in rows.collect()} == cases


def plain_lines(words):
    """Words as (middle, id, box); lines as lists of ids from the top."""
    height = median(b[3] - b[1] for _, _, b in words)
    lines = []
    for y, i, _ in sorted(words):
        if not lines or abs(y - median(v for v, _ in lines[-1])) > height * 0.35:
            lines.append([])
        lines[-1].append((y, i))
    return [(median(v for v, _ in line), sorted(i for _, i in line)) for line in lines]


def test_lines_equal_a_plain_restatement(spark):
    rng = random.Random(3)
    words = [[t, 0, i, "w", [float(rng.randrange(90)), y, 95.0, y + rng.randint(6, 14)]] for t in range(60) for i in range(rng.randint(1, 30)) for y in [rng.randrange(400) / 4]]
    found = records.text_lines(spark.createDataFrame(words, WORD)).orderBy("table_id", "line").collect()
    for t in range(60):
        want = plain_lines([((w[4][1] + w[4][3]) / 2, w[2], w[4]) for w in words if w[0] == t])
        assert [(r["y"], sorted(r["ocr_ids"])) for r in found if r["table_id"] == t] == want


def test_pairs_in_doubt_equal_a_plain_restatement(spark):
    rng = random.Random(4)
    cells, words = [], []
    for t in range(40):
        for c in range(4):
            cells.append([t, c, 1, c, 1, 1, False, [c * 100.0, 0.0, c * 100 + 100.0, 200.0]])
            for i in range(rng.randint(2, 6)):
                y = 10.0 + i * 14 + rng.randrange(9)
                words.append([t, c, c * 10 + i, "w", [c * 100.0, y, c * 100 + 50.0, y + 10]])
    lines = records.text_lines(spark.createDataFrame(words, WORD))
    found = {(r["table_id"], r["cell_id"], r["other_id"]): r["aligned"] for r in records.rows_in_doubt(spark.createDataFrame(cells, CELL), lines).collect()}
    want = {}
    for t in range(40):
        ys = {c: [y for y, _ in plain_lines([((w[4][1] + w[4][3]) / 2, w[2], w[4]) for w in words if w[0] == t and w[1] == c])] for c in range(4)}
        for a in range(4):
            for b in range(a + 1, 4):
                free, n = list(range(len(ys[b]))), 0
                for y in ys[a] if min(len(ys[a]), len(ys[b])) >= 3 else []:
                    near = min(free, key=lambda j: (abs(ys[b][j] - y), j), default=None)
                    if near is not None and abs(ys[b][near] - y) <= 4:
                        free.remove(near)
                        n += 1
                if n >= 3:
                    want[t, a, b] = n
    assert found == want and len(want) > 10

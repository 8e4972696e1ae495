"""Logical tables: cases by hand, and random papers against a plain restatement block by block."""

import random
import re

from proofline.operators import caption_tables

BLOCK = "paper_id string, ord int, page int, type string, text string"
LABEL = re.compile(r"\b(Table|Fig\.?|Figure)\s+((?:\d+(?:\.\d+)*[A-Za-z]?|[A-Za-z]+\.?\d+(?:\.\d+)*[A-Za-z]?))\s*[:.]", re.I)


def recovered(spark, blocks):
    rows = [("p", n, *b) for n, b in enumerate(blocks)]
    found = caption_tables.recover_tables(spark.createDataFrame(rows, BLOCK)).collect()
    return sorted((r["source_ords"], r["caption_ords"], r["identifier"], r["status"], r["table_id"]) for r in found)


def test_captions_and_their_tables(spark):
    cases = [
        ([(1, "caption", "Table 1: Results"), (1, "table", "| a |")], [([1], [0], "1", "caption_attached", "logical_table_0001")]),
        ([(1, "table", "Table 2. Own | a |"), (1, "caption", "Table 2: Own")], [([0], [1], "2", "correct", "logical_table_0002")]),
        ([(1, "caption", "Table 1: x"), (1, "table", "a"), (1, "table", "b"), (2, "table", "c")], [([1, 2], [0], "1", "merged_fragments", "logical_table_0001"), ([3], [], None, "caption_missing", "logical_table_unlabelled_0002")]),
        ([(1, "table", "a"), (1, "paragraph", "text"), (1, "table", "b")], [([0], [], None, "caption_missing", "logical_table_unlabelled_0001"), ([2], [], None, "caption_missing", "logical_table_unlabelled_0002")]),
        ([(1, "table", "Table A.1: one"), (1, "table", "Table a.1: goes on")], [([0, 1], [], "A.1", "merged_fragments", "logical_table_a_1")]),
        # the next table's caption stands in this one's grid and again behind it
        ([(1, "table", "Table 3: next | Table 2: own | a |"), (1, "caption", "Table 3: next"), (1, "table", "b")],
         [([0], [], "2", "caption_collision_recovered", "logical_table_0002"), ([2], [1], "3", "caption_attached", "logical_table_0003")]),
        # two captions want one table: the nearer has it
        ([(1, "caption", "Table 4: far"), (1, "paragraph", "x"), (1, "table", "Table 4: y"), (1, "caption", "Table 4: near")], [([2], [3], "4", "correct", "logical_table_0004")]),
        # a repeated caption between two fragments of a labelled table
        ([(1, "table", "Table 5: y"), (1, "caption", "Table 5: y"), (1, "table", "more")], [([0, 2], [1], "5", "merged_fragments", "logical_table_0005")]),
        ([(1, "table", "Figure 1: a plot"), (1, "caption", "Figure 1: a plot"), (1, "table", "t")], [([2], [], None, "caption_missing", "logical_table_unlabelled_0001")]),
        ([(1, "table", "Table 1: a"), (2, "table", "x"), (2, "table", "Table 1: b")], [([0], [], "1", "caption_missing", "logical_table_0001"), ([1], [], None, "caption_missing", "logical_table_unlabelled_0002"), ([2], [], "1", "caption_missing", "logical_table_0001_0003")]),
        ([(None, "caption", "Table 1: x"), (None, "table", "a")], [([1], [], None, "caption_missing", "logical_table_unlabelled_0001")]),
    ]
    for blocks, want in cases:
        assert recovered(spark, blocks) == want, blocks


def test_embedded_captions_and_pages(spark):
    rows = [("p", 0, 3, "table", "| x |\nTable 7: The caption |\n| y |"), ("p", 1, 4, "paragraph", None), ("p", 2, 4, "table", "**Table 8. In front** | a |\n| b |")]
    found = {r["source_ords"][0]: r for r in caption_tables.recover_tables(spark.createDataFrame(rows, BLOCK)).collect()}
    assert found[2]["caption"] == "Table 8. In front** | a" and (found[2]["page_start"], found[2]["page_end"]) == (4, 4)
    rows = [("p", 0, 1, "table", "Table 2: y Table 1: z |\nmore"), ("p", 1, 1, "caption", "Table 2: y"), ("p", 2, 1, "table", "b")]
    assert [r["caption"] for r in caption_tables.recover_tables(spark.createDataFrame(rows, BLOCK)).orderBy("page_start", "table_id").collect()] == ["Table 1: z", "Table 2: y"]
    assert found[0]["identifier"] is None and found[0]["caption"] is None and found[0]["warnings"] == ["caption_missing"]
    assert caption_tables.recover_tables(spark.createDataFrame([], BLOCK)).count() == 0


def plain(blocks):
    """(source places, caption places, identifier) of each table, claim by claim."""
    names = [[("f" if m[1].lower().startswith("f") else "t", m[2].upper() if m[2][0].isalpha() else m[2].lower(), m.start()) for m in LABEL.finditer(text)] for _, _, text in blocks]
    leads = [n[0][:2] if n and not text[: n[0][2]].strip(" \t\r\n|#*_") else None for n, (_, _, text) in zip(names, blocks)]
    page, n = [b[0] for b in blocks], len(blocks)
    is_table = [b[1] == "table" and not (lead and lead[0] == "f") for b, lead in zip(blocks, leads)]
    caption = {i: leads[i][1] for i in range(n) if blocks[i][1] == "caption" and leads[i] and leads[i][0] == "t"}
    own = {i: leads[i][1] if leads[i] else None for i in range(n) if is_table[i]}
    ids = [list(dict.fromkeys(i for kind, i, _ in found if kind == "t")) for found in names]
    wants = {}
    for i in own:
        if len(ids[i]) > 1 and caption.get(i + 1) == ids[i][0] and i + 2 in own and not ids[i + 2] and page[i] is not None and page[i] == page[i + 2]:
            own[i], wants[i + 1] = ids[i][1], (0, i + 2)
    for c, number in caption.items():
        if c in wants:
            continue
        here = [i for i in own if page[i] is not None and page[i] == page[c]]
        near = sorted((abs(i - c), i) for i in here if own[i] == number) or [(1, i) for i in (c + 1, c - 1) if i in here and own[i] is None and not ids[i]]
        if near:
            wants[c] = (1, near[0][1])
    taken = {}
    for c in sorted(wants, key=lambda c: (wants[c][0], abs(c - wants[c][1]), c)):
        taken.setdefault(wants[c][1], c)
    for target, c in taken.items():
        own[target] = caption[c]
    owner = {}
    for target, c in sorted(taken.items(), key=lambda p: p[1]):
        found, steps = [target], [1] if target > c else [-1, 1] if target == c - 1 and leads[target] == ("t", caption[c]) else [-1]
        for step in steps:
            i = c + step
            while i in own and taken.get(i, c) == c and own[i] in (None, caption[c]) and page[i] == page[c]:
                found.append(i)
                i += step
        for i in found:
            if owner.setdefault(i, c) == c:
                own[i] = caption[c]
    groups, last = {}, None
    for i in sorted(own):
        if i in owner:
            key, last = ("c", owner[i]), None
        else:
            key = last if last and own[i] is not None and own[i - 1 if i - 1 in own else i] == own[i] and groups[last][-1] == i - 1 else ("t", i)
            last = key
        groups.setdefault(key, []).append(i)
    return sorted((members, [key[1]] if key[0] == "c" else [], own[members[0]]) for key, members in groups.items())


def test_random_papers_equal_a_plain_version(spark):
    chance = random.Random(9)
    texts = ["", "| a |", "Table 1: x", "Table 2: y", "Table 2. y Table 1: z", "Fig. 1: f", "text Table 1: in", "**Table A.1: b", "Table 1: x Table 2: y"]
    papers = []
    for p in range(300):
        page, blocks = 1, []
        for _ in range(chance.randint(1, 12)):
            page += chance.random() < 0.15
            kind = chance.choice(["table", "table", "caption", "caption", "paragraph"])
            blocks.append((None if chance.random() < 0.03 else page, kind, chance.choice(texts if kind == "table" else texts[2:])))
        papers.append(blocks)
    rows = [(f"p{p}", n, *b) for p, blocks in enumerate(papers) for n, b in enumerate(blocks)]
    found = {}
    for r in caption_tables.recover_tables(spark.createDataFrame(rows, BLOCK)).collect():
        found.setdefault(r["paper_id"], []).append((r["source_ords"], r["caption_ords"], r["identifier"]))
    for p, blocks in enumerate(papers):
        assert sorted(found.get(f"p{p}", []), key=repr) == sorted(plain(blocks), key=repr), blocks

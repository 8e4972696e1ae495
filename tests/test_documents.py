"""Scope, tables, evidence and evaluation runs on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from proofline.operators import evidence, fusion, scope, structure, tables
from proofline.plans import harness


def values(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def catalog(spark):
    rows = [("2401.00001v2_LoRA.pdf", "LoRA: Low-Rank Adaptation"), ("QLoRA technical report.pdf", None), ("lora_plus.pdf", "LoRA Plus"), ("one.pdf", "Same Name"), ("two.pdf", "Same Name")]
    return spark.createDataFrame(rows, "filename string, title string")


def test_aliases(catalog):
    found = {}
    for name, alias in values(scope.aliases(catalog), "filename", "alias"):
        found.setdefault(name, set()).add(alias)
    assert found["2401.00001v2_LoRA.pdf"] == {"2401.00001v2 lora.pdf", "lora", "lora: low rank adaptation"}
    assert found["QLoRA technical report.pdf"] == {"qlora technical report.pdf", "qlora technical report", "qlora"}


@pytest.mark.parametrize(
    "question, status, names",
    [
        ("How does LoRA work?", "resolved", ["2401.00001v2_LoRA.pdf"]),
        ("How does LoRA Plus work?", "resolved", ["lora_plus.pdf"]),
        ("Compare LoRA and QLoRA", "resolved", ["2401.00001v2_LoRA.pdf", "QLoRA technical report.pdf"]),
        ("Compare LoRA with others", "unresolved", []),
        ("based only on “Unknown Paper”, what is it?", "unresolved", []),
        ("According to BERT: what is it?", "unresolved", []),
        ("What about Same Name?", "ambiguous", []),
        ("What is a loratadine?", "unrestricted", []),
        ("based on all papers, what is best?", "unrestricted", []),
        ("仅根据 LoRA 论文，不要看 QLoRA", "resolved", ["2401.00001v2_LoRA.pdf"]),
        (None, "unrestricted", []),
    ],
)
def test_scopes(spark, catalog, question, status, names):
    asked = spark.createDataFrame([(1, question)], "question_id long, question string")
    row = scope.resolve_scope(asked, catalog).first()
    assert (row["status"], row["filenames"]) == (status, names), row["reason"]


def test_targets(spark):
    files = spark.createDataFrame([("Parameter_Efficient_Fine_Tuning_2023.pdf",), ("BERT-large.pdf",), ("bert_small.pdf",), ("PMC12345_Swin.pdf",)], "filename string")
    targets = spark.createDataFrame([("PEFT",), ("Swin Model",), ("bert",), ("nothing here",)], "target string")
    found = {r["target"]: (r["filename"], r["reason"]) for r in scope.resolve_targets(targets, files).collect()}
    assert found["Swin Model"] == ("PMC12345_Swin.pdf", "unique_lexical_match") and found["PEFT"][0] == "Parameter_Efficient_Fine_Tuning_2023.pdf"
    assert found["bert"] == (None, "ambiguous") and found["nothing here"] == (None, "low_confidence")


def test_section_rerank(spark):
    kind = "query_id long, question string, id string, position int, score double, content_type string, section string, text string"
    rows = [(1, "Which method?", "a", 1, 0.9, "paragraph", "Intro", "[1] [2] [3]"), (1, "Which method?", "b", 2, 0.5, "paragraph", "3 Method", "x"), (2, "Who?", "a", 1, 0.9, "reference", "References", "x"), (2, "Who?", "b", 2, 0.5, "p", "y", "x")]
    found = fusion.rerank_by_section(spark.createDataFrame(rows, kind))
    assert [(r["id"], round(r["adjusted"], 6)) for r in found.where("query_id = 1").orderBy("rank").collect()] == [("b", 0.92), ("a", 0.72)]
    assert [r["id"] for r in found.where("query_id = 2").orderBy("rank").collect()] == ["a", "b"]
    assert values(fusion.only_section_matches(found, 5), "query_id", "id") == [(1, "b"), (2, "a"), (2, "b")]


GOOD = "<table><tr><th colspan=2>Head</th><th>x</th></tr><tr><td rowspan=2>a</td><td>1 <b>2</b></td><td>c</td></tr><tr><td>d<br>e</td><td></td></tr></table>"


def test_table_cells(spark):
    cells = tables.table_cells(GOOD)
    assert [(c["row"], c["col"], c["row_span"], c["col_span"], c["text"]) for c in cells] == [(0, 0, 1, 2, "Head"), (0, 2, 1, 1, "x"), (1, 0, 2, 1, "a"), (1, 1, 1, 1, "1 2"), (1, 2, 1, 1, "c"), (2, 1, 1, 1, "d\ne"), (2, 2, 1, 1, "")]
    bad = [None, "", "text", "<table></table>", GOOD + GOOD, GOOD[:-8], GOOD.replace("colspan=2", "colspan=3"), GOOD.replace("rowspan=2", "rowspan=9"), GOOD.replace("<td></td>", ""), GOOD.replace("<td>c", "c<td>"), GOOD.replace("<td>c", "<td><p>c"), GOOD.replace("<td>c", "<!-- --><td>c")]
    for raw in bad:
        with pytest.raises(ValueError):
            tables.table_cells(raw)
    assert tables.table_cells(f"<html><body class=x>{GOOD.replace('<b>2</b>', '<span style=y>2</span>')}</body></html>") == cells
    for raw in (GOOD.replace("<td>c", "<td onclick=x>c"), GOOD.replace("<table>", "<table onload=x>"), GOOD.replace("<b>2</b>", "<b>2</i>"), GOOD.replace("rowspan=2", "rowspan=501"),
                "<table>" + "<tr><td>x</td></tr>" * 501 + "</table>", GOOD.replace("<br>", "<b/>")):
        with pytest.raises(ValueError):
            tables.table_cells(raw)
    assert len(tables.table_cells("<table>" + "<tr><td>x</td></tr>" * 500 + "</table>")) == 500
    frame = tables.explode_cells(spark.createDataFrame([(1, GOOD), (2, "x"), (3, None)], "id long, html string"), "id", "html")
    assert frame.where("error is null").count() == 7 and values(frame.where("error is not null"), "table_id") == [(2,), (3,)]
    assert values(tables.header_paths(frame), "table_id", "col", "path") == [(1, 0, ["Head"]), (1, 1, ["Head"]), (1, 2, ["x"])]
    assert tables.aligned_cells(frame.where("col > 0"), frame.where("error is null")).where("equal").count() == 5


def test_grids(spark):
    xs, ys = [0.0, 30.0, 50.0, 100.0], [0.0, 10.0, 25.0]
    boxes = [(1, [xs[i] + 0.2 * j, ys[j], xs[i + 1] - 0.2, ys[j + 1]]) for i in range(3) for j in range(2) if (i, j) != (1, 1)]
    cells = [(1, 3 * j + i, j, i, 1, 1) for j in range(2) for i in range(3)]
    grids = tables.infer_grids(spark.createDataFrame(boxes + boxes[:1], "table_id long, bbox array<double>"))
    placed = tables.grid_cells(spark.createDataFrame(cells, "table_id long, cell_id long, row int, col int, row_span int, col_span int"), grids)
    assert placed.count() == 6 and all(b[2] > b[0] for _, b in values(placed, "cell_id", "bbox"))
    texts = spark.createDataFrame([(1, 7, [32.0, 12.0, 45.0, 20.0])], "table_id long, text_id int, bbox array<double>")
    assert values(structure.assign_boxes(placed, texts), "text_id", "cell_id") == [(7, 4)]
    wrong = spark.createDataFrame(cells[:5], "table_id long, cell_id long, row int, col int, row_span int, col_span int")
    assert tables.grid_cells(wrong.where("col < 2"), grids).count() == 0


def test_orientation(spark):
    def probe(table, angle, confidence, wide):
        box = [0.0, 0.0, 50.0, 10.0] if wide else [0.0, 0.0, 10.0, 50.0]
        return [(table, angle, "twelve chars", confidence, box)] * 5

    rows = probe(1, 0, 0.4, True) + probe(1, 90, 0.9, True) + probe(1, 180, 0.3, True) + probe(1, 270, 0.2, False) + probe(2, 0, 0.8, True) + probe(2, 90, 0.84, True)
    quality = tables.orientation_quality(spark.createDataFrame(rows, "table_id long, angle int, text string, confidence double, bbox array<double>"))
    assert values(tables.choose_orientation(quality), "table_id", "angle", "best_probe") == [(1, 90, 90), (2, 0, 90)]


def test_numbers(spark):
    f1 = spark.range(1).select(tables.numbers_f1(F.lit("1.5 and 20% and 1.5"), F.lit("1.5, 20%")).alias("x")).first()["x"]
    assert f1 == pytest.approx(2 * 2 / 5)


@pytest.fixture(scope="module")
def paper(spark):
    rows = [
        (0, "heading", "1 A"), (1, "paragraph", "As Figure 2 shows"), (2, "figure", "Figure 2: x"), (3, "paragraph", "See Eq. (3) below"), (4, "formula", "a = b (3)"),
        (5, "formula", "c = d"), (6, "paragraph", "where c is"), (7, "heading", "2 B"), (8, "paragraph", "Fig. 2 again, Equation 3"),
    ]
    return spark.createDataFrame([(1, i, 1, k, t, ["s1"] if i < 7 else ["s2"]) for i, k, t in rows], "paper_id long, ord int, page int, type string, text string, section_path array<string>")


def test_evidence_around_figures_and_formulas(paper):
    assert values(evidence.figure_explanations(paper), "figure_ord", "context_ord") == [(2, 1)]
    assert values(evidence.formula_contexts(paper), "formula_ord", "context_ord") == [(4, 3), (5, 6)]


def test_rendered_claims(spark):
    rows = spark.createDataFrame([(1, 1, "First é.", ["S1", "S2"]), (1, 2, "Second.", ["S3"])], "answer_id long, position int, text string, source_ids array<string>")
    answer = evidence.rendered_answers(rows).first()["answer"]
    assert answer == "First é. [S1][S2]\n\nSecond. [S3]"
    for r in evidence.rendered_claims(rows).collect():
        assert answer[r["answer_start"] : r["answer_end"]] == r["text"]


def test_units_packets_and_contract(spark):
    anchors = spark.createDataFrame([("a1", "u1", 2, "t1"), ("a2", "u1", 2, "t2"), ("a3", "u2", 1, "t3")], "anchor_id string, unit_id string, parts int, text string")
    chosen = spark.createDataFrame([(1, "a1"), (1, "a3"), (2, "a1"), (2, "a2")], "claim_id long, anchor_id string")
    assert values(evidence.whole_units(chosen, anchors), "claim_id", "unit_id", "complete") == [(1, "u1", False), (1, "u2", True), (2, "u1", True)]
    kind = "claim_id long, question string, claim string, anchor_ids array<string>"
    packets = evidence.review_packets(spark.createDataFrame([(1, "q", "c", ["a2", "a1"]), (2, "q", "c", ["a1", "a2"])], kind), anchors).collect()
    assert len({p["packet_id"] for p in packets}) == 2 and [a["text"] for a in sorted(packets, key=lambda p: p["claim_id"])[0]["anchors"]] == ["t2", "t1"]
    with pytest.raises(Exception, match="isn't there"):
        evidence.review_packets(spark.createDataFrame([(1, "q", "c", ["zz"])], kind), anchors).collect()
    assert evidence.canonical_digest({"b": 1, "a": [2]}) == evidence.canonical_digest({"a": [2], "b": 1})
    answers = spark.createDataFrame([(1, ["a", "x"], ["a", "b"], ["a", "b"], [["b"], ["a"]]), (2, ["a"], ["a"], [], [["a", "b"]])], "answer_id long, cited array<string>, sources array<string>, required array<string>, gold_sets array<array<string>>")
    assert values(evidence.citation_contract(answers), "answer_id", "syntax", "coverage", "gold_hit") == [(1, False, 0.5, True), (2, True, 1.0, False)]


def test_harness(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"arms": [{"ndcg": 0.7}], "n": 3}))
    config = {"stages": [{"id": "s", "source": {"path": str(tmp_path / "m.json")}, "metrics": [{"id": "ndcg", "path": "arms.0.ndcg", "direction": "higher"}, {"id": "n", "path": "n"}], "gates": [{"metric": "ndcg", "operator": ">=", "value": 0.6}]}]}
    (tmp_path / "c.json").write_text(json.dumps(config))
    stages = harness.load_config(str(tmp_path / "c.json"))
    measured, judged = harness.run(spark, stages)
    assert values(measured, "metric_id", "value") == [("n", 3.0), ("ndcg", 0.7)] and harness.status(measured, judged) == "PASS"
    assert harness.report(measured, judged).startswith("# PASS")
    lower = [harness.Stage("s", stages[0].artifact, stages[0].metrics, (("ndcg", ">", 0.7),))]
    assert harness.status(*harness.run(spark, lower)) == "FAIL"
    assert harness.status(*harness.run(spark, [harness.Stage("s", stages[0].artifact, (("x", "gone", "neutral"),))])) == "ERROR"
    config["stages"][0]["gates"][0]["operator"] = "=~"
    (tmp_path / "c.json").write_text(json.dumps(config))
    with pytest.raises(ValueError):
        harness.load_config(str(tmp_path / "c.json"))


def test_evidence_stays_together(spark):
    rows = [(1, 1, 1, "paragraph", 1), (1, 1, 2, "caption", 4), (1, 1, 3, "table", 2), (1, 1, 4, "paragraph", 3), (1, 1, 5, "caption", 5)]
    found = structure.keep_evidence_together(spark.createDataFrame(rows, "paper_id long, page int, ord int, type string, reading_index int"))
    assert [r["ord"] for r in found.orderBy("reading_index").collect()] == [1, 2, 3, 4, 5]


def test_logical_tables(spark):
    rows = [(1, 1, 0, "caption", "Table 1. a"), (1, 1, 1, "table", ""), (1, 1, 2, "table", ""), (1, 2, 3, "table", ""), (1, 3, 4, "caption", "Table 1: again"), (1, 3, 5, "table", "")]
    found = structure.logical_tables(spark.createDataFrame(rows, "paper_id long, page int, ord int, type string, text string"))
    assert values(found, "table_id", "ords", "status") == [("table_1", [1, 2], "merged"), ("table_1:2", [5], "caption_attached"), ("table_3", [3], "caption_missing")]


def test_plans_and_fallbacks(spark):
    plan = spark.createDataFrame([(c, q) for c in (1, 2, 3) for q in ("original", "x", "y") if c != 3 or q == "original"], "case_id long, query_id string")
    rows = [(c, q, f"{q}{i}", i, 1.0 / i) for c in (1, 2, 3) for q in ("original", "x", "y") for i in range(1, 6) if (c, q) != (2, "y") and (c < 3 or q == "original")]
    hits = spark.createDataFrame(rows, "case_id long, query_id string, chunk_id string, rank int, score double")
    found = fusion.execute_plan(plan, hits, 8)
    assert {c: (n, r) for c, n, r in ((r["case_id"], r["count"], r["reason"]) for r in found.groupBy("case_id", "reason").count().collect())} == {
        1: (8, None), 2: (5, "target_retrieval_failed"), 3: (5, "single_query"),
    }
    chosen = {r["chunk_id"] for r in found.where("case_id = 1").collect()}
    assert chosen == {*(f"original{i}" for i in range(1, 5)), "x1", "x2", "y1", "y2"}
    assert {r["reason"] for r in fusion.execute_plan(plan, hits, 7).where("case_id < 3").collect()} == {"insufficient_top_k_for_coverage"}
    assert fusion.named_reserves(10, 3) == (4, 2) and fusion.named_reserves(4, 3) == (1, 1)
    with pytest.raises(ValueError):
        fusion.named_reserves(10, 4)


def test_planner_replies():
    from proofline.operators import claims

    reply = lambda *s: "Sure:\n```json\n" + json.dumps({"subqueries": [{"target": t, "query": q} for t, q in s]}) + "\n```"
    assert claims.read_plan(reply(("A", "what is a"), ("B", "what is b")), "a or b") == [("A", "what is a"), ("B", "what is b")]
    for bad in (reply(("A", "q")), reply(("A", "q"), ("a!", "r")), reply(("A", "q"), ("B", "Q?")), reply(("A", "a or b"), ("B", "q")), reply(("A", "x" * 501), ("B", "q")), "none"):
        with pytest.raises(ValueError):
            claims.read_plan(bad, "a or b")


def test_audits_and_rates(spark):
    from proofline.operators import metrics

    gold = spark.createDataFrame([("a", "f", 1), ("b", None, 2), ("z", "f", 1)], "id string, file string, page int")
    corpus = spark.createDataFrame([("a", "g", 1), ("b", None, 2)], "id string, file string, page int")
    assert values(metrics.audit(gold, corpus, "id", ["file", "page"]), "id", "problem") == [("a", "file"), ("z", "missing")]
    score = spark.range(1).select(metrics.set_scores(F.array(F.lit("A B"), F.lit("x")), F.array(F.lit("a b "))).alias("s")).first()["s"]
    assert tuple(score) == (0.5, 1.0, False)
    rows = spark.createDataFrame([(1, 2, 0, 0), (0, 2, 0, 0)], "p int, w int, q int, v int")
    assert tuple(metrics.rates(rows, {"r": ("p", "w"), "s": ("q", "v")}).first()) == (0.25, 1.0)
    assert tuple(metrics.rates(rows, {"s": ("q", "v")}, None).first()) == (None,)


def test_rows_by_label(spark):
    kind = "table_id long, row int, col int, text string"
    gold = spark.createDataFrame([(1, 0, 0, "A"), (1, 0, 1, "1"), (1, 1, 0, "b"), (1, 1, 1, "2"), (1, 2, 0, "b"), (1, 2, 1, "3")], kind)
    predicted = spark.createDataFrame([(1, 5, 0, "a "), (1, 5, 1, "1"), (1, 6, 0, "b"), (1, 6, 1, "9")], kind)
    assert values(tables.labelled_agreement(predicted, gold), "table_id", "cells", "equal") == [(1, 1, 1)]


def test_crops_and_turns(spark):
    box = lambda *v: F.array(*map(F.lit, v))
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(tables.crop_box(box(10.0, 20.0, 30.0, 40.0), box(100.0, 200.0), box(200, 400))) == [8, 308, 72, 372]
    width, height, inner = 100.0, 60.0, (10.0, 5.0, 40.0, 20.0)
    turned = {0: inner, 90: (inner[1], width - inner[2], inner[3], width - inner[0]), 180: (width - inner[2], height - inner[3], width - inner[0], height - inner[1]), 270: (height - inner[3], inner[0], height - inner[1], inner[2])}
    for angle, seen in turned.items():
        assert one(tables.turned_back(box(*seen), box(width, height), F.lit(angle))) == list(inner)

"""What the fourth round found, on small tables."""

import json
import random

from proofline.operators import evidence, papers, structure
from proofline.plans import QUERIES
from pyspark.sql import functions as F


def files_of_checkpoints(spark):
    import os

    return sum(len(names) for _, _, names in os.walk(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")))


def test_chunks_of_trees_come_by_one_shuffle_without_joins_or_checkpoints(spark, sf_dir):
    before = files_of_checkpoints(spark)
    plan = QUERIES["tree_chunks"][0](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert files_of_checkpoints(spark) == before
    assert "Join" not in plan and "Window" not in plan and plan.count("Exchange hashpartitioning") == 1


def papers_of_all_kinds():
    chance, rows = random.Random(4), []
    for paper in [*range(40), None]:
        at = 0
        for _ in range(chance.randint(1, 50)):
            at, n, kind = at + chance.choice([1, 1, 1, 2, 9]), chance.randint(1, 3), chance.choice("heading title paragraph paragraph paragraph list_item caption caption figure table formula odd".split())
            text = {
                "heading": ["1 Intro", "2 Method", "2.1 Sub", "Abstract", ""], "caption": [f"Figure {n}: a", f"Fig. {n} b", f"Table {n}: c", f"**Tab. {n}** d", "none"], "figure": ["x.png", f"Figure {n}", None],
                "formula": ["a=b", f"a=b ({n})", f"c ( {n}.1a ) ", None], "table": ["| a |\n| --- |\n| 1 |", None],
            }.get(kind, [f"As Figure {n} shows.", f"fig.{n} and Eq. ({n}) say.", f"Equation {n}.1A or (eq {n})", f"Figure {n}0 not", "plain text. More.", "", None, f"Eq.{n}.Eq 2"])
            rows.append((paper, at, f"b{at}", kind, chance.choice(text), chance.choice([None, 1, 1, 2, 4])))
    return rows


def test_blocks_bound_in_one_fold_are_those_that_the_steps_bind(spark):
    blocks = spark.createDataFrame(papers_of_all_kinds(), "paper_id long, ord int, block_id string, type string, text string, page int").repartition(3)
    bound = papers.bound_blocks(blocks)
    rows = {(r["paper_id"], r["ord"]): r for r in bound.collect()}
    assert len(rows) == blocks.count()
    placed = structure.with_section_paths(blocks).drop("level")
    assert {k: r["section_path"] for k, r in rows.items()} == {(r["paper_id"], r["ord"]): r["section_path"] for r in placed.collect()}
    owner = {(r["paper_id"], r["caption_ord"]): r["figure_ord"] for r in structure.figure_claims(placed.where("paper_id is not null")).collect()}
    owner |= {(r["paper_id"], r["caption_ord"]): r["target_ord"] for r in structure.caption_targets(placed, "table").collect()}
    assert {k: r["caption_of"] for k, r in rows.items() if r["caption_of"]} == {k: f"b{at}" for k, at in owner.items()} and len(owner) > 40
    said = {(paper, at): rows[paper, caption]["text"] for (paper, caption), at in sorted(owner.items(), reverse=True)}
    shown = placed.join(spark.createDataFrame([(*k, t) for k, t in said.items()], "paper_id long, ord int, said string"), ["paper_id", "ord"], "left")
    shown = shown.withColumn("text", F.when(F.col("type") == "figure", F.coalesce("said", "text")).otherwise(F.col("text")))
    contexts = {}
    for found, name in ((evidence.figure_explanations(shown), "figure_ord"), (evidence.formula_contexts(placed), "formula_ord")):
        for r in found.collect():
            contexts.setdefault((r["paper_id"], r[name]), set()).add(r["context_ord"])
    assert {k: r["context_ids"] for k, r in rows.items() if r["context_ids"]} == {k: [f"b{i}" for i in sorted(at)] for k, at in contexts.items()} and len(contexts) > 40
    about = spark.createDataFrame([(n, f"{n}.pdf", None if n % 3 else f"T{n}", ["A"] if n % 2 else None) for n in [*range(30), 3]] + [(None, "n.pdf", "N", None)], "paper_id long, filename string, title string, authors array<string>")
    told = lambda chunks: sorted(json.dumps(r.asDict(True), sort_keys=True) for r in chunks.collect())
    assert told(papers.chunks_of_blocks(blocks, about, 20, 40)) == told(papers.structure_chunks(bound, about, 20, 40))


def test_an_index_is_built_without_copies_of_its_postings(spark, monkeypatch):
    from proofline.functions.shared import shared_folder, written
    from proofline.operators import postings

    docs, rows = spark.range(100).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 500), i -> concat('word', i))) as text"), []
    monkeypatch.setattr(postings, "written", lambda df: rows.append((found := written(df)).count()) or found)
    postings.build(docs, folder := shared_folder(spark, "postings"))
    assert rows and max(rows) <= 100  # what is known of each document, and none of the 50,000 postings
    assert spark.read.parquet(f"{folder}/maxima").selectExpr("sum(postings)").first()[0] == 50_000


def test_whole_blocks_are_listed_at_once(monkeypatch):
    import pyarrow as pa
    from proofline.operators import postings

    chance = random.Random(2)
    rows = [(block, block * 10 + n, chance.choices("abcdefgh", k=chance.randint(0, 9))) for block in range(12) for n in range(5)]
    schema = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("tokens", pa.list_(pa.string()))])
    batches = lambda n: (pa.RecordBatch.from_arrays([pa.array(column, kind.type) for column, kind in zip(zip(*rows[i : i + n]), schema)], schema=schema) for i in range(0, len(rows), n))
    listed = lambda n: [r for batch in postings._lists(batches(n)) for r in batch.to_pylist()]
    want = {}
    for block, doc, words in rows:
        for word in set(words):
            want.setdefault((word, block), []).append({"doc_id": doc, "tf": words.count(word), "length": len(words)})
    for n, most in ((60, 1_000_000), (4, 20), (1, 1), (60, 1)):
        monkeypatch.setattr(postings, "TOKENS_AT_ONCE", most)
        found = listed(n)
        assert {(r["token"], r["block"]): r["p"] for r in found} == want and len(found) == len(want)
        assert all(r["most"] == max(x["tf"] for x in r["p"]) and r["least"] == min(x["length"] for x in r["p"]) and r["times"] == 1 and r["words"] == sum(x["tf"] for x in r["p"]) for r in found)


def stored_and_sql(spark, folder, docs):
    """The rows of stored_bm25 and of its SQL on ``docs`` (doc_id, text)."""
    import duckdb

    query, sql = QUERIES["stored_bm25"]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "a b c"), (2, "d d e"), (3, "zz"), (4, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    connection = duckdb.connect()
    for table in ("documents", "benchmark"):
        connection.sql(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    want = connection.sql(sql)
    return sorted(map(tuple, query(spark, str(folder)).select(*want.columns).collect())), sorted(want.fetchall())


def test_a_stored_index_equals_its_sql_on_repeated_ids_and_texts_without_tokens(spark, tmp_path):
    chance = random.Random(3)
    docs = [(i, " ".join(chance.choices("abcdefghij", k=chance.randint(1, 30)))) for i in range(60)]
    docs += [(5, "a b c d"), (5, "a b c d"), (6, "a e " * 40), (7, docs[7][1]), (100, None), (101, ""), (102, "...")]
    found, want = stored_and_sql(spark, tmp_path, docs)
    assert found == want and len(want) == 20


def test_a_stored_index_of_no_tokens_finds_nothing(spark, tmp_path):
    assert stored_and_sql(spark, tmp_path, [(1, None), (2, " ")]) == ([], [])


def test_records_of_orders_are_split_after_one_shuffle_in_one_fold(spark, sf_dir):
    plan = QUERIES["order_records"][0](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1 and plan.count("MapInArrow") == 1


def random_tables():
    chance, cells, words = random.Random(12), [], []
    for table in range(90):
        columns, noise, top, own = chance.choice([3, 3, 4]), chance.choice([0, 0, 0.1, 0.5]), 40.0, []
        cells += [[table, k, 0, k, 1, 1, True, [k * 100.0, 0.0, k * 100 + 100.0, 40.0]] for k in range(columns)]
        for row in range(1, chance.choice([2, 2, 3, 12 if chance.random() < 0.1 else 2])):
            n, anchor, second = chance.choice([1, 3, 4, 5, 33 if chance.random() < 0.1 else 4]), chance.randrange(columns), chance.random() < 0.3
            for k in range(columns):
                cell, name = row * columns + k, chance.choice(["Part ", "Odd Part ", "TEIL "])
                cells.append([table, cell, row, k, 1, 1, chance.choice([False, None]), [k * 100.0, top, k * 100 + 100.0, top + n * 40 + 20]])
                for i in range(n):
                    y, number = top + 10 + i * 40 + chance.choice([0, 1, 2, 3]), chance.randint(1, 99)
                    text = f"{number} kg" if k == anchor else f"{number} m/s" if second and k == (anchor + 1) % columns else name + str(number) + chance.choice(["", " x-", " y"])
                    own.append([table, cell, len(own), chance.choice(["plain", None, "５ ＫＧ"]) if chance.random() < noise * 0.1 else text, [k * 100.0 + 5, y, k * 100.0 + 65, y + 10]])
                    if chance.random() < noise * 0.4:
                        low = y + chance.choice([2, 4, 14, 16, 24])
                        own.append([table, cell, len(own), chance.choice(["more", "goes-", "A 1"]), [k * 100.0 + 5 + chance.choice([0, 4, 10, 70]), low, k * 100.0 + 90, low + chance.choice([9, 10])]])
            top += n * 40 + 20
        if table % 5 == 0:  # what is unknown, or spans
            cells[-1][chance.choice([2, 4, 7])] = None
            own[-1][4] = chance.choice([None, [5.0, None, 65.0, 10.0]])
        if table % 7 == 0:
            cells[-2][5] = 2
        words += own
    return cells, words


def test_tables_folded_one_by_one_are_split_as_the_audit_says(spark):
    from proofline.operators import records

    kind = "table_id long, cell_id long, {}, bbox array<double>"
    given = [spark.createDataFrame(rows, kind.format(more)) for rows, more in zip(random_tables(), ("row int, col int, row_span int, col_span int, header boolean", "ocr_id long, text string"))]
    found = [r.asDict() for r in records.split_records(*given)[0].collect()]
    audit, parts = (df.collect() for df in records.propose_records(*given))
    refused = {r["table_id"] for r in audit if r["reasons"]}
    want = {(r["table_id"], r["cell_id"], r["record"]): (list(r["ocr_ids"]), r["text"]) for r in parts if r["table_id"] not in refused}
    assert {(r["table_id"], r["source_id"], r["record"]): (r["ocr_ids"], r["text"]) for r in found if r["operation"] == "split"} == want and len(want) > 150 and len(refused) > 10
    bounds = {(r["table_id"], r["row"]): r["boundaries"] for r in audit}
    row_of = {(c[0], c[1]): c[2] for c in random_tables()[0]}
    for r in found:
        if r["operation"] == "split":
            edges = bounds[r["table_id"], row_of[r["table_id"], r["source_id"]]]
            assert (r["bbox"][1], r["bbox"][3]) == (edges[r["record"]], edges[r["record"] + 1])
    assert sorted((r["table_id"], i) for r in found for i in r["ocr_ids"]) == sorted((w[0], w[2]) for w in random_tables()[1])


def test_labels_of_the_fold_are_those_of_the_plan(spark):
    from proofline.operators import record_folds, records

    texts = ["5 kg", "-3,5 %", "7", "4 km/h", "Sample 2 b", "a b-c 1", "a b c d 1", "５ ＫＧ", "1.2.3", "", "x" * 101, "word", "  5\t kg ", "a_b 3", "½ x", "5 ½", "x² 4", "Ⅷ 8", "表 3", "3 表", "5 kg", "5 kg", "Straße 4", "STRASSE 4", "a 1 ", "+.5", "a  -b 2"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", records.typed_start(F.col("t")).alias("k"))
    assert {r["t"]: r["k"] for r in rows.collect()} == {t: record_folds.typed_start(t) for t in texts}

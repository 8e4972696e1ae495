"""Queries against their SQL on rows that the given tables don't have."""

import duckdb

from proofline.plans import QUERIES


def both(spark, folder, name, *tables):
    """The rows of a query and of its SQL over the tables of ``folder``."""
    query, sql = QUERIES[name]
    connection = duckdb.connect()
    for table in tables:
        connection.sql(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    want = connection.sql(sql)
    columns = want.columns
    return sorted(map(tuple, query(spark, str(folder)).select(*columns).collect())), sorted(want.fetchall())


def test_a_page_whose_heading_begins_with_a_number_or_a_usual_name_has_a_title_as_in_sql(spark, tmp_path):
    page = lambda head: f"<html><body>Site<h1>{head}</h1><p>one</p><p>two</p><p>three</p><p>four</p></body></html>"
    pages = [(1, "u", page("8294846167456848 Inly onhe")), (2, "u", page("Results")), (3, "u", page("3 May")), (4, "u", page("Plain")), (5, "u", "<h1>1. Alone</h1>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found, want = both(spark, tmp_path, "paper_titles", "pages")
    assert found == want == [(1, 1), (2, 1), (4, 1)]


def test_the_split_of_records_leaves_nothing_on_disk_and_moves_words_once(spark, sf_dir):
    import os

    written = lambda: sum(len(names) for _, _, names in os.walk(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")))
    before = written()
    plan = QUERIES["order_records"][0](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert written() == before
    exchanges = [line for line in plan.split("\n") if " Exchange hashpartitioning" in line]
    # the lines of an order as they are read, for each branch, and lines of text once after their labels
    assert len(exchanges) <= 5 and all(len(line.split("hashpartitioning(")[1].split(")")[0].split(",")) == 2 for line in exchanges)


def test_papers_go_through_python_in_batches_and_not_one_by_one(spark, sf_dir):
    for name in ("tree_chunks", "page_chunks", "page_sections"):
        plan = QUERIES[name][0](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" in plan and "FlatMapGroupsInPandas" not in plan
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 256


def test_parts_joined_by_running_sums_are_as_long_as_their_tokens_say():
    from proofline.operators.papers import parts_of, tokens

    text = " ".join(f"Word {n}, a_b 中文 x{n}." for n in range(400))
    parts = parts_of(text, 90)
    assert " ".join(parts) == text and all(tokens(p) <= 90 for p in parts)
    assert all(tokens(f"{a} {b.split('.')[0]}.") > 90 for a, b in zip(parts, parts[1:]))


def test_boxes_are_assigned_without_a_window_over_pairs(spark, sf_dir):
    plan = QUERIES["box_assignment"][0](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_texts_reach_python_in_small_batches(spark, sf_dir):
    rows, size = (f"spark.sql.execution.arrow.{name}" for name in ("maxRecordsPerBatch", "maxBytesPerBatch"))
    for name in ("stitched_pages", "sentence_units"):
        spark.conf.unset(rows)
        spark.conf.unset(size)
        QUERIES[name][0](spark, sf_dir)
        assert int(spark.conf.get(rows)) <= 256 and spark.conf.get(size) == "2m"


def test_lines_of_reread_tables_are_derived_once(spark, sf_dir, monkeypatch):
    from proofline.plans import grids

    read = []
    monkeypatch.setattr(grids, "written", lambda df: read.append(df) or df.limit(0), raising=False)
    grids.reread_verdicts(spark, sf_dir)
    assert len(read) == 1


def test_logical_tables_meet_in_tasks_of_bounded_rows_after_one_shuffle(spark, sf_dir, monkeypatch):
    from proofline.operators import caption_tables

    want = sorted(map(tuple, QUERIES["recovered_tables"][0](spark, sf_dir).collect()))
    monkeypatch.setattr(caption_tables, "TASK_ROWS", 500)
    found = QUERIES["recovered_tables"][0](spark, sf_dir)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber").distinct().count()
    assert f", {-(-rows // 500)}), REPARTITION_BY_NUM" in plan
    assert sorted(map(tuple, found.collect())) == want


def test_long_texts_are_dealt_out_by_their_bytes(spark, monkeypatch):
    from proofline.operators import caption_tables

    monkeypatch.setattr(caption_tables, "TASK_BYTES", 1000)
    blocks = spark.range(80).selectExpr("id as paper_id", "0 as ord", "1 as page", "'table' as type", "repeat('a', 100) as text")
    assert caption_tables._dealt(blocks).rdd.getNumPartitions() == 8
    assert caption_tables.recover_tables(blocks).where("status = 'caption_missing' and length(text) = 100").count() == 80

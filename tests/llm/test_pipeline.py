"""The corpus pipeline, each stage against a brute-force version on its own input, and the registered queries."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from proofline.llm import language, lines
from proofline.llm.common import held_out

from tests.llm.test_operators import plain_lines, plain_targets, tokenizer  # noqa: F401
from tests.llm.test_similar import plain_kept

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """Input and output of each stage, written and read again."""
    folder = str(tmp_path_factory.mktemp("stages"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 150")
    extra = [(1000, "12 34", "en", "src0", 5), (1001, None, None, None, None), (1002, "Common line here.", "en", "src1", 17)]
    extra += [(1010 + i, f"Common line here.\nText of page number {i}, written in English words.", "en", "src1", 60) for i in range(30)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    found = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, before, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        found.append((before, docs))
    return found


def test_stages_are_in_order_and_keep_the_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "SimHash near-dedup", "mixing", "byte-level BPE"]
    for _, after in stages[:-1]:
        assert after.columns == COLUMNS
    assert corpus_pipeline.ORACLE_SQL is None


def test_language_stage(stages):
    before, after = stages[0]
    prototypes = language.learn_prototypes(before.where(~held_out(F.col("doc_id"), 4, 2)))
    told = language.predict_language(before, prototypes).collect()
    want = sorted(repr(tuple(r[c] for c in COLUMNS)) for r in told if r["lang_pred"] != "und" and r["score"] >= corpus_pipeline.LEAST_LIKENESS)
    assert sorted(repr(tuple(r)) for r in after.collect()) == want
    assert not {1000, 1001} & {r["doc_id"] for r in after.collect()}


def test_line_stage(stages):
    before, after = stages[1]
    rows = before.collect()
    want = plain_lines([(r["text"], r["source"]) for r in rows], lines.MOST_SHARE, lines.LEAST_PAGES)
    assert sum(n for _, _, n in want) >= 30
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in after.collect()}
    assert got == {r["doc_id"]: (w[0], len(w[0])) for r, w in zip(rows, want)}


def test_near_dedup_stage(stages):
    before, after = stages[2]
    rows = before.collect()
    kept = sorted(r["doc_id"] for r in after.collect())
    assert kept == plain_kept([(r["doc_id"], r["text"]) for r in rows]) and len(kept) < len(rows)


def test_mixing_stage(stages):
    before, after = stages[3]
    rows = before.collect()
    words = lambda t: len((t or "").split())
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + words(r["text"])
    want, longest = plain_targets(sizes), max(words(r["text"]) for r in rows)
    given, texts = {}, {r["doc_id"]: r["text"] for r in rows}
    for r in after.collect():
        assert texts[r["doc_id"]] == r["text"]
        given[r["source"]] = given.get(r["source"], 0) + words(r["text"])
    for source, target in want.items():
        assert abs(given.get(source, 0) - target) <= longest


def test_encoding_stage(stages, tokenizer):  # noqa: F811
    before, after = stages[4]
    _, library = tokenizer
    assert after.count() == before.count()
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    for r in after.collect():
        assert r["ids"] == library.encode_ordinary(texts[r["doc_id"]]) and bytes(r["decoded"]).decode() == texts[r["doc_id"]]


def test_run_applies_the_stages(spark, sf_dir):
    docs = corpus_pipeline.run(spark, sf_dir)
    rows = docs.select("doc_id", "n_tokens").collect()
    assert rows and all(r["n_tokens"] > 0 for r in rows)


def test_run_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_number_is_registered():
    names = list(__spark_entry__.queries())
    assert [n for k in range(1, 14) for n in names if n.startswith(f"op{k}_")] == [n for n in names if n.startswith("op")]
    assert sum(n.startswith("op") for n in names) == 13 and "pipeline" in names


@pytest.mark.parametrize("name", ["op4_line_dedup", "op6_mixing"])
def test_sql_agrees(spark, sf_dir, name):
    import duckdb

    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = duck.sql(__spark_entry__.oracle_sql()[name])
    rows = __spark_entry__.queries()[name](spark, sf_dir).select(*want.columns).collect()
    show = lambda r: repr(tuple(round(v, 9) if isinstance(v, float) else v for v in r))
    assert sorted(map(show, rows)) == sorted(map(show, want.fetchall()))

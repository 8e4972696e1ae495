"""The Merkle manifest against a plain restatement and against its SQL."""

import random
from hashlib import sha256
from itertools import batched
from zlib import crc32

import duckdb
import pytest
from pyspark.sql import functions as F

from proofline.llm import manifest, queries

from tests.llm.test_operators import none, odd  # noqa: F401

H = lambda text: sha256(text.encode()).hexdigest()


def plain_leaf(values):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(digests, fanout):
    """The root, and for each leaf its steps (left siblings, right siblings)."""
    steps, at, now = [[] for _ in digests], list(range(len(digests))), digests
    while len(now) > 1:
        for i, place in enumerate(at):
            run, slot = now[place - place % fanout : place - place % fanout + fanout], place % fanout
            steps[i].append((run[:slot], run[slot + 1 :]))
            at[i] = place // fanout
        now = [H("".join(run)) for run in batched(now, fanout)]
    return now[0], steps


def plain_manifest(rows, fanout):
    """rows: doc_id, source, lang, n_chars, text, tampered text."""
    by_source = {}
    for row in rows:
        by_source.setdefault(row[1], []).append((row[0], plain_leaf(row[:5]), plain_leaf((*row[:4], row[5]))))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for source in order:
        leaves = sorted(by_source[source], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees.append((leaves, *plain_tree([d for _, d, _ in leaves], fanout)))
    root, above = plain_tree([subroot for _, subroot, _ in trees], fanout)
    found = []
    for (leaves, subroot, steps), upper in zip(trees, above):
        for (doc_id, digest, changed), own in zip(leaves, steps):
            path = [*own, *upper]
            proof = H("".join("".join(left + right) for left, right in path))
            folded = changed
            for left, right in path:
                folded = H("".join([*left, folded, *right]))
            found.append((doc_id, digest, subroot, root, proof, folded, folded == root))
    return sorted(found, key=repr)


def lowered(row):
    doc_id, text = row["doc_id"], row["text"]
    if text is None or doc_id is None or crc32(str(doc_id).encode()) % 5:
        return text
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def changes():
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return {"text": F.when(hit, manifest.lower_ascii(F.col("text"))).otherwise(F.col("text"))}


@pytest.mark.parametrize("fanout", [2, 3, 16])
def test_manifest_equals_a_plain_one(spark, sf_dir, fanout):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 120")
    chance = random.Random(fanout)
    many = [(1000 + chance.randrange(60), f"Text {i} of A-Z.", None, "hot" if i % 3 else None, i) for i in range(90)]
    docs = docs.unionByName(spark.createDataFrame(many, "doc_id long, text string, lang string, source string, n_chars long"))
    rows = [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"], lowered(r)) for r in docs.collect()]
    found = manifest.audit(docs, changes(), fanout=fanout)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, found.collect()), key=repr) == plain_manifest(rows, fanout)


def test_odd_rows_and_none(spark, odd, none):  # noqa: F811
    """Nulls in every column, an empty and a long text, repeated rows, clashing names; no row at all; one row."""
    rows = [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"], lowered(r)) for r in odd.collect()]
    assert sorted(map(tuple, manifest.audit(odd, changes()).collect()), key=repr) == plain_manifest(rows, 16)
    assert manifest.audit(none, changes()).collect() == []
    alone = odd.where("doc_id = 4")
    only = manifest.audit(alone).first()
    assert only["leaf"] == only["subroot"] == only["root"] == only["folded_root"] and only["verified"] and only["proof_sha256"] == H("")


def test_a_tree_of_equal_rows_is_dealt_over_tasks(spark):
    """Rows that are equal in all fields are leaves of their own and aren't kept together."""
    docs = spark.range(400).selectExpr("7L AS doc_id", "'same' AS text", "'en' AS lang", "'s' AS source", "4L AS n_chars")
    leaves = docs.select(manifest.tree_key(F.col("source")).alias("tree"), "doc_id", manifest.leaf([F.col(c) for c in manifest.FIELDS]).alias("hash"))
    placed = manifest.in_order(leaves.repartition(4), ["doc_id", "hash"])
    assert sorted(r["idx"] for r in placed.collect()) == list(range(400)) and {r["n"] for r in placed.collect()} == {400}
    rows = [(7, "s", "en", 4, "same", "same")] * 400
    assert sorted(map(tuple, manifest.audit(docs).collect()), key=repr) == plain_manifest(rows, 16)


def test_a_changed_field_is_found(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 50")
    found = manifest.audit(docs, {"lang": F.when(F.col("doc_id") == 7, "xx").otherwise(F.col("lang"))})
    assert {r["doc_id"] for r in found.collect() if not r["verified"]} == {7}


def test_registered_query_equals_sql(spark, sf_dir):
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = duck.sql(queries.ORACLES["op11_merkle_manifest"])
    found = queries.op11_merkle_manifest(spark, sf_dir)
    assert found.columns == want.columns
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want.fetchall(), key=repr)

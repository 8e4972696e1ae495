"""The near-duplicate stage against all pairs, by five words at a similarity of 0.8."""

import itertools
import random

import corpus_pipeline
import pytest

from proofline.llm import similar

from tests.llm.test_operators import plain_bits


def plain_shingles(text):
    found = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return {b" ".join(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()


def plain_kept(rows):
    """The smallest id of each component of texts within two bits or alike, all pairs compared."""
    sets, bits, parent = [plain_shingles(t) for _, t in rows], [plain_bits(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (bits[i] ^ bits[j]).bit_count() <= 2 or (sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])):
            parent[root(i)] = root(j)
    least = {}
    for i, (id_, _) in enumerate(rows):
        least[root(i)] = min(id_, least.get(root(i), id_))
    return sorted(least.values())


def made():
    """Edited copies of some texts, chains of them, a large group about one text, and a passage that many share."""
    chance = random.Random(11)
    word = lambda: "w" + str(chance.randrange(5000))
    texts, passage = [], [word() for _ in range(30)]

    def edited(base, most):
        new = list(base)
        for _ in range(chance.randint(0, most)):
            new[chance.randrange(len(new))] = word()
        return new

    for _ in range(25):
        at = [word() for _ in range(chance.randint(5, 90))]
        for _ in range(4):
            texts.append(at)
            at = edited(at, 3)
    base = [word() for _ in range(100)]
    texts += [edited(base, 3) for _ in range(60)]
    texts += [[word() for _ in range(chance.randint(0, 25))] + passage for _ in range(60)]
    texts += [[], [], ["one"], ["one"], ["ONE", "two"]]
    chance.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("many", [1, 64])
def test_near_copies_by_five_words_go(spark, monkeypatch, many):
    monkeypatch.setattr(similar, "MANY", many)
    rows = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == plain_kept(rows)


def test_near_copies_of_the_given_documents_go(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()}
    assert sorted(kept) == plain_kept([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert not {145, 177} & kept  # alike, but 7 and 11 bits apart


def test_a_large_family_without_a_centre_is_not_torn_apart(spark):
    """Ten places with one of twelve words each: more components than are compared at once, and links off the centre."""
    chance = random.Random(5)
    rows = []
    for i in range(900):
        found = [f"b{k}" for k in range(300)]
        for k in range(10):
            found[15 + 28 * k] = f"v{15 + 28 * k}_{chance.randrange(12)}"
        rows.append((i, " ".join(found)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert len(kept) == 3 and kept == plain_kept(rows)

"""Quality rules: counts against plain restatements, references against plain medians, verdicts on clean and on odd texts."""

import random
import re
from collections import Counter
from math import log2, sqrt

import numpy as np
import pyarrow as pa
import pytest

from proofline.llm import divergence, queries

from tests.llm.test_operators import none, odd  # noqa: F401

WORD = re.compile("[^\x20\x09-\x0d]+")
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times, hit = Counter(windows), set()
    for i, window in enumerate(windows):
        if times[window] > 1:
            hit.update(range(i, i + 5))
    lines, seen, again = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    symbols = len(re.findall("[#*$%&|<>]", text))
    return (len(words), sum(map(len, words)), symbols, again, len(hit), len(words) < 10 or 100 * len(hit) > 20 * len(words))


def test_counts_equal_plain_ones():
    chance = random.Random(5)
    for _ in range(2000):
        text = "".join(chance.choice(["a", "b", "c ", " ", "\n", "é ", "\x1f", "#", "| ", "日 ", "\r\n", "x y z w v "]) for _ in range(chance.randint(0, 60)))
        found = divergence.profile(text)
        assert (*(getattr(found, n) for n in COUNTS[:5]), found.failed) == plain_counts(text), text
        assert found.classes.sum() == len(text)


def test_windows_stay_exact_with_very_many_words():
    ids = np.concatenate([np.arange(5000), np.arange(4000, 4007), np.arange(10_000, 14_000), [3, 4, 5, 6]])
    assert divergence.repeated_words(ids, 14_000) == 14
    assert divergence.repeated_words(ids, 1 << 30) == 14


def test_distance_is_that_of_jensen_and_shannon():
    p, q = np.array([0.5, 0.5, 0.0]), np.array([0.25, 0.0, 0.75])
    m = (p + q) / 2
    divergence_of = lambda a: sum(x * log2(x / y) for x, y in zip(a, m) if x)
    assert divergence.distance(p, q) == pytest.approx(sqrt((divergence_of(p) + divergence_of(q)) / 2))
    assert divergence.distance(p, p) == 0 and divergence.distance(np.array([1.0, 0]), np.array([0, 1.0])) == 1


def plain_references(rows):
    """For each language the classes' and common words' median levels, as the docstring has them."""
    found = {}
    for language in {lang for lang, _ in rows if lang is not None}:
        texts = [t for lang, t in rows if lang == language and t is not None and len(WORD.findall(t)) >= divergence.WORDS_GUARD]
        if not texts:
            continue
        words = [Counter(divergence.folded(w.encode()) for w in WORD.findall(t)) for t in texts]
        lower_median = lambda levels: sorted(levels)[(len(levels) - 1) // 2]
        sizes = [len(WORD.findall(t)) for t in texts]
        level = lambda w: [round(n[w] * divergence.LEVELS / size) for size, n in zip(sizes, words)]
        common = {w: lower_median(level(w)) for w in set().union(*words) - {""}}
        shares = np.array([divergence.class_counts(t) / len(t) for t in texts])
        classes = [lower_median(list(np.rint(column * divergence.LEVELS))) / divergence.LEVELS for column in shares.T]
        found[language] = (np.array(classes) / sum(classes), {w: n / divergence.LEVELS for w, n in common.items() if n})
    return found


def same(found, want):
    assert found.languages == sorted(want)
    for i, language in enumerate(found.languages):
        classes, words = want[language]
        assert found.classes[i] == pytest.approx(classes)
        assert {w: pytest.approx(found.shares[i][k]) for w, k in found.words[i].items()} == words
        assert found.shares[i].sum() == pytest.approx(1)


def test_references_are_medians(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text")
    want = plain_references([tuple(r) for r in docs.collect()])
    assert len(want) == 4 and "the" in want["en"][1]
    same(divergence.learn_references(docs.repartition(5)), want)


def test_common_words_are_found_from_small_tables():
    """A word of half of the texts is named by the tables of some tasks even if these hold very few words each."""
    chance = random.Random(2)
    texts = [" ".join(chance.choices(["all", f"w{i}", f"x{i % 7}"], [5, 3, 2], k=120)) + (" half" if i % 2 else "") for i in range(60)]
    batch = pa.RecordBatch.from_pydict({"lang": ["l"] * 60, "text": texts})
    rows = pa.Table.from_batches(divergence._frequent([batch], divergence.COMMON_IN / 2, held=10)).to_pylist()
    docs = sum(r["n"] for r in rows if r["kind"] == "docs")
    words = Counter()
    for r in rows:
        if r["kind"] == "word":
            words[r["key"]] += r["n"]
    assert docs == 60 and words["all"] == 60 and words["half"] == 30 and len([r for r in rows if r["kind"] == "docs"]) > 5


def test_copies_and_junk_do_not_make_the_references(spark, sf_dir):
    """A third of the rows are one text and some are junk: the clean texts are kept and the junk goes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang = 'en' and length(text) > 900").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    clean = docs.join(labels.select("doc_id"), "doc_id")
    rows = clean.collect()
    chance = random.Random(1)
    upper = [(10_000 + i, " ".join(w.upper() + "!!" for w in r["text"].split()), "en") for i, r in enumerate(rows[: len(rows) // 5])]
    piped = [(20_000 + i, " | ".join(sorted({w for w in r["text"].split() if len(w) > 5}, key=lambda w: chance.random())[:80]), "en") for i, r in enumerate(rows[: len(rows) // 8])]
    copies = [(30_000 + i, "An entirely different text, which speaks of nothing that any other one mentions. " + rows[0]["text"], "en") for i in range(len(rows) // 2)]
    found = divergence.judge(clean.unionByName(spark.createDataFrame(upper + piped + copies, clean.schema)))
    kept = {r["doc_id"]: r["kept"] for r in found.where("not base_failed").collect()}
    assert all(v for k, v in kept.items() if k < 10_000) and not any(v for k, v in kept.items() if 10_000 <= k < 30_000)


def test_odd_rows_and_none(spark, odd, none):  # noqa: F811
    found = divergence.judge(odd)
    rows = sorted([(r["doc_id"], *[r[n] for n in COUNTS]) for r in found.collect()], key=repr)
    assert rows == sorted([(r["doc_id"], *plain_counts(r["text"])) for r in odd.collect()], key=repr)
    assert not any(r["kept"] for r in found.where("base_failed").collect())
    assert divergence.judge(none).collect() == []
    few = spark.createDataFrame([(1, "Ten plain words are enough for a text to pass here.", None)], "doc_id long, text string, lang string")
    only = divergence.judge(few).first()
    assert only["kept"] and only["nearest_lang"] is None


def test_registered_query(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    good = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    found = queries.op13_quality_rules(spark, sf_dir)
    assert found.columns[:8] == ["doc_id", *COUNTS, "kept"]
    rows = found.collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert tuple(r[n] for n in COUNTS) == plain_counts(docs[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])
    passed = [(good[r["doc_id"]], r["kept"]) for r in rows if r["doc_id"] in good and not r["base_failed"] and r["n_words"] > 60]
    assert all(kept for quality, kept in passed if quality == 1) and not any(kept for quality, kept in passed if quality == 0)

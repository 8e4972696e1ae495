"""Each numbered operator against a plain restatement, and on nulls, empty, long, tied and repeated rows."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from proofline.llm import bpe, digests, html_text, language, lines, mixing, neighbours, quality, simhash, token_count
from proofline.llm.common import held_out

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, bits string, n string, rank int"
LONG = "Many words, again and again. " * 4000


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns with names that operators use."""
    rows = [
        (1, "The first text of all, in plain words.", "en", "a"),
        (1, "The first text of all, in plain words.", "en", "a"),
        (2, None, "en", "a"), (3, "", None, "b"), (None, "A text without an id.", "en", None), (4, LONG, "en", "b"),
        (5, "Ünïcode ＴＥＸＴ ﬁne　and 日本語 😀", "de", "a"), (6, " \t\n ", "de", None), (7, "12345 67", "fr", "c"), (None, None, None, None),
        (8, "the first TEXT of all, in plain words.", "en", "a"),
    ]
    return spark.createDataFrame([(*r, None, "s", "x", "b", "n", 7) for r in rows], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df, *names):
    return sorted(((r["doc_id"], *[r[n] for n in names]) for r in df.collect()), key=repr)


def test_token_counts_equal_the_library(spark, odd, none, sf_dir):
    from tokenizers import Tokenizer, models

    path = public_tokenizers.path("piece_bpe_32k.model")
    vocabulary, fallback = token_count.read_vocabulary(path)
    assert fallback
    byte_pieces = [(f"<0x{i:02X}>", -1e4) for i in range(256)]
    library = Tokenizer(models.Unigram([("￿unk", 0.0), *byte_pieces, *vocabulary], unk_id=0, byte_fallback=True))
    mark = lambda t: token_count.SPACE + t.replace(" ", token_count.SPACE)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars"))
    for row in token_count.count_tokens(docs, path).collect():
        assert row["n_tokens"] == (len(library.encode(mark(row["text"])).ids) if row["text"] else 0)
    assert token_count.count_tokens(none, path).count() == 0


def test_vocabularies_are_told_apart(spark, monkeypatch):
    """Vocabularies that differ only in between have counters of their own, and an empty one counts bytes."""
    docs = spark.createDataFrame([("abab",)], "text string")
    outer = [("a", -1.0)], [("b", -1.0)]
    for inner, want in (([("ab", -1.0)], 5), ([("xy", -1.0)], 7)):
        monkeypatch.setattr(token_count, "read_vocabulary", lambda path: ([*outer[0], *inner, *outer[1]], True))  # noqa: B023
        assert token_count.count_tokens(docs, "").first()["n_tokens"] == want
    monkeypatch.setattr(token_count, "read_vocabulary", lambda path: ([], True))
    assert token_count.count_tokens(docs, "").first()["n_tokens"] == 4 + len(token_count.SPACE.encode())


def test_token_count_ties():
    """Scores of few values make ties everywhere; the library's choice decides the count."""
    from tokenizers import Tokenizer, models

    chance = random.Random(3)
    pieces = list(dict.fromkeys("".join(chance.choices("ab▁", k=chance.randint(1, 4))) for _ in range(60)))
    for byte_fallback in (True, False):
        scored = [(p, -float(chance.randint(1, 2))) for p in pieces]
        extra = [(f"<0x{i:02X}>", -2.0) for i in range(256)] if byte_fallback else []
        library = Tokenizer(models.Unigram([("￿unk", 0.0), *extra, *scored], unk_id=0, byte_fallback=byte_fallback))
        own = token_count.CountOnlyViterbi(scored, byte_fallback)
        for _ in range(300):
            text = "".join(chance.choices("abc é", k=chance.randint(1, 12)))
            assert own.count(text) == len(library.encode(token_count.SPACE + text.replace(" ", token_count.SPACE)).ids), text


PAGE = """<html><head><title>T</title><script>if (a</b) "</p>"</script></head><body class="has-sidebar"><header><p>Site name</p></header>
<nav><ul><li><a href=1>Home</a><li>More</ul></nav><div id="cookie-notice"><p>We use cookies, many of them, really. Do you agree?</p></div>
<article><h1>The &eacute;tude</h1><p>First   paragraph, with <b>bold</b> text&nbsp;here.<br>It goes on, and on.<p>Short.
<div class="ad"><p>Buy now, it is cheap, good and fast.</p></div><p>Last, 1 &lt; 2.</p></article>
<section id="comments"><p>Nice post, I liked it, thanks for sharing it with us.</p></section><form><p>Your mail, please.</p></form>
<aside><p>Side text, which is long enough to pass, by itself.</p></aside><footer>&copy; 2020</footer></body></html>"""


def test_main_text(spark):
    want = "The étude\nFirst paragraph, with bold text here. It goes on, and on.\nShort.\nLast, 1 < 2."
    pages = spark.createDataFrame(
        [(1, PAGE, "x"), (1, PAGE, "x"), (2, None, None), (3, "", "y"), (None, "<p>" + LONG + "</p>", "z"), (4, "<", "z"), (5, "<script>x", "z")],
        "page_id long, html string, text string",
    )
    found = html_text.extract(pages).collect()
    assert len(found) == 7
    texts = {r["page_id"]: r["text"] for r in found}
    assert texts[1] == want and texts[2] == texts[3] == texts[5] == "" and texts[None] == " ".join(LONG.split()) and texts[4] == "<"
    assert all(r["n_chars"] == len(r["text"]) for r in found)
    assert html_text.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    "page, want",
    [
        ("<p title=it's>don't</p><p>can't</p>", "don't\ncan't"), ('<p title="a>b">x</p>', "x"), ("<p title='a>b' class=c>x</p>", "x"), ('<p title="open>x</p>', "x"), ("a < b and c > d", "a < b and c > d"),
        ("<ul><li>one, two<li>three, four</ul>", "one, two\nthree, four"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"), ("<div>a<br>b<p>c</div>d", "a b\nc\nd"), ("&#65;&eacute;&nbsp;&amp;lt;", "Aé &lt;"),
        ("<nav>x<p>y</nav><p>z", "z"), ("<P CLASS='Ad-Box'>x</P><P>y</P>", "y"), ("<p>x</section></b>y</p>", "xy"), ("<textarea><p>x</textarea><p>y", "y"), ("<p>a</p><!-- <p>b</p> --><p>c</p>", "a\nc"),
    ],
)
def test_main_text_of_bad_markup(page, want):
    assert html_text.main_text(page) == want


def test_main_text_of_the_given_pages(spark, sf_dir):
    import html
    import re

    for row in html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect():
        article = re.search(r"<article>(.*?)</article>", row["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert row["text"] == "\n".join(filter(None, blocks))


def test_language_of_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet").withColumn("held_out", held_out(F.col("doc_id"), 4, 2))
    prototypes = language.learn_prototypes(docs.where("not held_out"))
    assert [n for n, _ in prototypes] == ["de", "en", "es", "fr"]
    found = language.predict_language(docs, prototypes).where("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in found)
    assert sum(r["lang"] == r["lang_pred"] for r in found) / len(found) > 0.98
    assert all(0 <= r["score"] <= 1 for r in found)


def test_trigrams_are_bound_in_order():
    space = language.LetterSpace(64, 1)
    a, b, c = (space.letter(ord(x)) for x in "abc")
    code = ord("a") << 42 | ord("b") << 21 | ord("c")
    assert np.array_equal(space.bound(np.array([code]))[0], np.roll(a, 2) * np.roll(b, 1) * c)
    bundle = space.bundled(["abc abc", None, "12"])
    grams, counts = language.trigram_counts("ABC, abc!")
    assert np.allclose(bundle[0], (space.bound(grams) * counts[:, None]).sum(axis=0)) and not bundle[1:].any()


def test_what_isalpha_says_is_a_letter(spark):
    docs = spark.createDataFrame([(1, "½ ②", "de"), (2, "Ⅷ ² 12_3", "de"), (3, "a²b ein Wort", "de"), (4, "ein Wort", "en")], "doc_id long, text string, lang string")
    prototypes = language.learn_prototypes(docs)
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict_language(docs, prototypes).collect()}
    assert found[1] == found[2] == ("und", 0.0) and found[3][0] == "de" and found[4][0] == "en"
    assert [sorted(g.tolist()) for g, _ in map(language.trigram_counts, ("a²b", "a b"))][0] == sorted(language.trigram_counts("a b")[0].tolist())


def test_predictions_equal_a_plain_version(spark, sf_dir):
    """Every score and language restated from the definitions, trigram by trigram, without sharing code but the letters' vectors."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", held_out(F.col("doc_id"), 4, 2)).where("length(text) < 1500")
    rows, space = docs.collect(), language.LetterSpace(language.DIMENSIONS, language.SEED)

    def plain(text):
        kept = " ".join("".join(c if c.isalpha() else " " for c in (text or "").lower()).split())
        total = np.zeros(language.DIMENSIONS)
        for a, b, c in zip(f" {kept} ", f" {kept} "[1:], f" {kept} "[2:]) if kept else ():
            total += np.roll(space.letter(ord(a)), 2).astype(float) * np.roll(space.letter(ord(b)), 1) * space.letter(ord(c))
        return total

    bundles, profiles = [plain(r["text"]) for r in rows], {}
    for r, bundle in zip(rows, bundles):
        if not r["held_out"] and r["lang"] is not None and r["text"] is not None:
            profiles[r["lang"]] = profiles.get(r["lang"], 0) + bundle
    names = sorted(profiles)
    unit = np.stack([profiles[n] / np.linalg.norm(profiles[n]) for n in names])
    found = {r["doc_id"]: r for r in language.predict_language(docs, language.learn_prototypes(docs.where("not held_out"))).collect()}
    for r, bundle in zip(rows, bundles):
        cosines = unit @ bundle / max(np.linalg.norm(bundle), 1e-9)
        got = found[r["doc_id"]]
        assert got["lang_pred"] == (names[cosines.argmax()] if bundle.any() else "und") and got["score"] == pytest.approx(max(0, cosines.max()), abs=1e-4)


def test_language_edges(odd, none):
    prototypes = language.learn_prototypes(odd)
    found = by_id(language.predict_language(odd, prototypes), "text", "lang_pred", "score")
    assert len(found) == 11
    for _, text, lang, score in found:
        if not any(ch.isalpha() for ch in text or ""):
            assert (lang, score) == ("und", 0.0)
        else:
            assert lang in {"de", "en"}
    assert language.learn_prototypes(none) == []
    assert {r["lang_pred"] for r in language.predict_language(odd, []).collect()} == {"und"}
    assert language.predict_language(none, prototypes).count() == 0


def plain_lines(rows, share, least):
    """rows: (text, host) -> (text, n_lines, n_dropped)."""
    pages, on = {}, {}
    for text, host in {(t, h) for t, h in rows if t is not None}:
        pages[host] = pages.get(host, 0) + 1
        for line in {x.strip(" ") for x in text.split("\n")} - {""}:
            on[host, line] = on.get((host, line), 0) + 1
    found = []
    for text, host in rows:
        lost = lambda x: x.strip(" ") != "" and (n := on.get((host, x.strip(" ")), 0)) >= least and n > share * pages[host]  # noqa: B023, E731
        split = [] if text is None else text.split("\n")
        kept = [x for x in split if not lost(x)]
        count = lambda xs: sum(x.strip(" ") != "" for x in xs)
        found.append((None if text is None else "\n".join(kept), count(split), count(split) - count(kept)))
    return found


def test_line_dedup(spark, odd, none):
    chance = random.Random(5)
    rows = [("\n".join(chance.choice(["common", " common ", f"own {i}", "", "rare"]) for _ in range(chance.randint(1, 5))), chance.choice("ab")) for i in range(80)]
    rows += [("common", None)] * 7 + [(f"common\n{i}", None) for i in range(6)] + [(None, "a"), ("", "a")]
    docs = spark.createDataFrame(rows, "text string, source string")
    for share, least in ((0.1, 5), (0.6, 1), (0.0, 2)):
        found = lines.drop_boilerplate(docs, most_share=share, least_pages=least).select("text", "n_lines", "n_dropped").collect()
        assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, plain_lines(rows, share, least)))
    assert lines.drop_boilerplate(odd).count() == 11 and lines.drop_boilerplate(none).count() == 0


def plain_bits(text):
    found = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    shingles = [b" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))] if found else []
    ones = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def plain_components(bits, ids):
    """The smallest id of each row's component, all pairs compared."""
    parent = list(range(len(bits)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(bits)):
        for j in range(i):
            if (bits[i] ^ bits[j]).bit_count() <= 2:
                parent[root(i)] = root(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[root(i)] = min(x, least.get(root(i), x))
    return [least.get(root(i)) for i in range(len(bits))]


def test_simhash_of_documents(spark, odd, none, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(odd.select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    rows = docs.collect()
    bits = [plain_bits(r["text"]) for r in rows]
    want = sorted(zip([r["doc_id"] for r in rows], [f"{b:016x}" for b in bits], plain_components(bits, [r["doc_id"] for r in rows])), key=repr)
    assert by_id(simhash.near_groups(docs), "fingerprint", "component_id") == want
    assert simhash.near_groups(none).count() == 0


@pytest.mark.parametrize("paired", [1, 4, 1000])
def test_links_lose_none(spark, monkeypatch, paired):
    """Chains and dense balls of fingerprints, by pairs, by neighbours and by both."""
    monkeypatch.setattr(simhash, "PAIRED", paired)
    chance = random.Random(paired)
    bits = set()
    for _ in range(6):
        at = chance.getrandbits(64)
        bits.add(at)
        for _ in range(40):  # a chain by steps of one to three bits
            for b in chance.sample(range(64), chance.randint(1, 3)):
                at ^= 1 << b
            bits.add(at)
    centre = chance.getrandbits(64)
    bits |= {centre ^ 1 << chance.randrange(64) ^ 1 << chance.randrange(64) for _ in range(60)}
    bits = sorted(b - (1 << 64) if b >> 63 else b for b in bits)
    edges = simhash.links(spark.createDataFrame([(b,) for b in bits], "bits long"))
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    unsigned = [b % (1 << 64) for b in bits]
    groups = plain_components(unsigned, bits)
    assert [roots.get(b, b) for b in bits] == groups
    for r in edges.collect():
        assert ((r["a"] ^ r["b"]) % (1 << 64)).bit_count() <= 2


def test_components_of_long_chains(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 7), (2001, 2000), (2001, 2002)]
    random.Random(1).shuffle(chain)
    found = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(1, 301)}, 1000: 0, 2001: 2000, 2002: 2000}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_group_stays(spark, odd, none):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=repr)
    assert len(ids) == len(set(ids)) and 1 in ids and 8 not in ids and simhash.keep_one(none).count() == 0
    rows = [(5, "same words here now"), (5, "same words here now"), (5, "others"), (3, "same words here now"), (None, "alone it is")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(repr, map(tuple, kept))) == sorted(map(repr, [(3, "same words here now"), (5, "others"), (None, "alone it is")]))


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in capped]
        level = (total - sum(capped.values())) / sum(weight[s] for s in open_)
        above = [s for s in open_ if level * weight[s] > 3 * sizes[s]]
        if not above:
            return {**capped, **{s: level * weight[s] for s in open_}}
        capped |= {s: 3 * sizes[s] for s in above}


def test_mixing(spark, odd, none):
    chance = random.Random(9)
    rows = [(i // 2, " ".join("w" * chance.randint(1, 60)), chance.choice(["a", "a", "a", "B", "c", "é", None])) for i in range(300)]
    rows += [(500, "only three words", "tiny"), (501, None, "tiny"), (502, "", "void")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(docs).collect()
    sizes, taken = {}, {}
    for r in found:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    want = plain_targets(sizes)
    assert len(found) == len(rows)
    for r in found:
        s = r["source"]
        assert r["size"] == len((r["text"] or "").split()) and r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 1 and r["taken"] <= 3 * r["size"]
        assert (r["position"] is None) == (r["taken"] == 0) and (r["position"] is None or 0 <= r["position"] <= 1)
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda rs: sorted((repr(r["doc_id"]), r["size"], r["taken"]) for r in rs)
    assert key(found) == key(again)
    assert mixing.mix(odd).count() == 11 and mixing.mix(none).count() == 0


def test_the_curriculum_varies_in_time(spark):
    """Of three sources one fades, one peaks half way and one grows; their shares of all words are 1 to 2 to 3."""
    rows = [(i, "one two three", "abc"[i % 3]) for i in range(3000)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert [mixing.integral(s) for s in mixing.CURRICULUM] == [1.0, 2.0, 3.0]
    for source, weight in zip("abc", (1, 2, 3)):
        times = [p for r in found if r["source"] == source for p in r["positions"]]
        assert sum(r["taken"] for r in found if r["source"] == source) == 1500 * weight
        early, late = (sum(low <= p < low + 0.25 for p in times) / len(times) for low in (0.0, 0.75))
        knots = mixing.CURRICULUM["abc".index(source)]
        area = lambda a, b: np.trapezoid(np.interp(np.linspace(a, b, 1001), *zip(*knots)), np.linspace(a, b, 1001)) / weight  # noqa: B023, E731
        assert early == pytest.approx(area(0, 0.25), abs=0.01) and late == pytest.approx(area(0.75, 1), abs=0.01)


def test_columns_keep_their_names(spark):
    """Columns with names that the operators use within stay what they are."""
    names = ["_rank", "_host", "_size", "_digest", "_slice", "_start", "_row", "_id", "_text", "_of", "_position", "_lost", "_page", "_key", "_none", "_nth", "_absent", "size", "n_lines"]
    rows = [(i, f"some words {i}\nand {i % 3} more", "a", *range(len(names))) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    for after in (mixing.mix(docs), lines.drop_boilerplate(docs), mixing.in_training_order(docs), simhash.keep_one(docs), simhash.keep_one(docs, by_shingles=True)):
        given = [n for n in names if n in after.columns and not (n == "size" and "taken" in after.columns) and not (n == "n_lines" and "n_dropped" in after.columns)]
        assert len(given) >= len(names) - 1
        for r in after.collect():
            assert [r[n] for n in given] == [names.index(n) for n in given]


def test_rows_of_one_id_are_spread(spark):
    """Documents without an id, or with the same one, fall in different slices of their source."""
    rows = [(None, f"word{i} " * (i % 7 + 1), "s") for i in range(400)] + [(7, f"other{i}", "s") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(docs).collect()
    assert len(found) == 600 and abs(sum(r["taken"] for r in found) - sum(r["size"] for r in found)) <= 1
    assert len({r["position"] for r in found}) == 600


def test_positions_follow_the_schedule(spark):
    """Words are placed so that by time t a source has given the share of them that its schedule has asked for."""
    schedule = ((0.0, 0.0), (0.5, 2.0), (1.0, 2.0))
    docs = spark.createDataFrame([(i, "one two", "s") for i in range(2000)], "doc_id long, text string, source string")
    found = sorted(r["position"] for r in mixing.mix(docs, (schedule,)).collect())
    for t in (0.1, 0.3, 0.5, 0.8):
        asked = (2 * t * t if t <= 0.5 else 0.5 + 2 * (t - 0.5)) / 1.5
        assert sum(p < t for p in found) / 2000 == pytest.approx(asked, abs=0.002)


def test_training_order_repeats_whole_documents(spark, odd):
    rows = [(i, f"word{i} " * 10, "big") for i in range(60)] + [(100, "small text here", "zmall")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = [r["doc_id"] for r in mixing.in_training_order(docs).collect()]
    assert found.count(100) == 3 and mixing.in_training_order(docs).columns == docs.columns
    assert mixing.in_training_order(odd).columns == odd.columns


@pytest.fixture(scope="module")
def tokenizer():
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return path, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_round_trip(spark, odd, none, tokenizer, sf_dir):
    path, library = tokenizer
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect() if r["doc_id"] is not None}
    for row in bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path).collect():
        assert row["ids"] == library.encode_ordinary(row["text"] or "") and bytes(row["decoded"]).decode() == (row["text"] or "")
    for row in bpe.round_trip_digests(docs.where("doc_id > 8"), path, public_tokenizers.PATTERN).collect():
        ids = library.encode_ordinary(texts[row["doc_id"]])
        assert row["n_tokens"] == len(ids) and row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(texts[row["doc_id"]].encode()).hexdigest()
    assert bpe.round_trip_digests(none, path, public_tokenizers.PATTERN).count() == 0


def test_another_pattern_is_not_split(spark, tokenizer):
    import tiktoken

    path, library = tokenizer
    pattern, text = r"[a-z]+ [a-z]+|[\s\S]", "two words " * 20_000
    own = tiktoken.Encoding("two", pat_str=pattern, mergeable_ranks=library._mergeable_ranks, special_tokens={})
    row = bpe.encode(spark.createDataFrame([(text,)], "text string"), path, pattern).first()
    assert row["ids"] == own.encode_ordinary(text)


def test_long_texts_are_split_where_nothing_crosses(tokenizer):
    import tiktoken

    _, library = tokenizer
    chance = random.Random(2)
    parts = [" ", "  ", "\n", "\t ", "it's", "don't ", "word", " 12", "é", "日本", "!!", "'s", "　", " " * 5000, "\n" * 4500, "x" * 70000]
    for _ in range(25):
        text = "".join(chance.choices(parts, weights=[9] * 13 + [1] * 3, k=400)) * 3
        chunks = list(bpe.safe_chunks(text, 500))
        assert "".join(c for c, _ in chunks) == text and len(chunks) > 1
        as_one = tiktoken.Encoding("one", pat_str=bpe.AS_ONE, mergeable_ranks=library._mergeable_ranks, special_tokens={})
        assert bpe.encode_text(library, text, as_one).tolist() == bpe.encode_text(library, text).tolist() == library.encode_ordinary(text)
    with pytest.raises(IndexError):
        bpe.token_bytes(b"YQ== 0")[[5]]


def test_fingerprints_and_edits(spark, odd, none, sf_dir, monkeypatch):
    monkeypatch.setattr(digests, "SLICE_ROWS", 40)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(9001, None), (9002, ""), (9003, "abc"), (9004, LONG)], "doc_id long, text string"))
    rows = [(r["doc_id"], r["text"] or "") for r in docs.orderBy("doc_id").collect()]
    found = {r["doc_id"]: r for r in digests.fingerprints_and_edits(docs.repartition(6)).collect()}
    assert len(found) == len(rows)
    for i, (doc_id, text) in enumerate(rows):
        following, r = rows[(i + 1) % len(rows)][1], found[doc_id]
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + following[:quarter]
        name = lambda t: digests.digest(digests.canonical(t)).hex()
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (name(text), name(edited))
        assert (r["near_edited"], r["near_next"]) == (float(name(text) == name(edited)), float(name(text) == name(following)))
    assert digests.fingerprints_and_edits(odd).count() == 11 and digests.fingerprints_and_edits(none).count() == 0
    one = digests.fingerprints_and_edits(spark.createDataFrame([(1, "only one here")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0


def test_folding():
    same = ["Straße ﬁne", "STRASSE  FINE", "strasse fine ", "\tStrasse\nfine"]
    assert len({digests.canonical(t) for t in same}) == 1 and digests.canonical(None) == digests.canonical("") == b""
    assert digests.canonical("é") == digests.canonical("é") != digests.canonical("e")


def test_equal_hashes_of_different_texts_part(spark):
    """With a hash of four bits many texts meet; they are told apart by their bytes."""
    texts = [f"text number {i}" for i in range(60)]
    docs = spark.createDataFrame([(i, t.upper() if i % 2 else t) for i, t in enumerate([*texts, *texts])], "doc_id long, text string")
    assert digests.clashes(docs).count() == 0 and digests.clashes(docs, bits=4).count() > 8
    for bits in (128, 4):
        names = {}
        for r in digests.fingerprints(docs, bits=bits).collect():
            names.setdefault(digests.canonical(r["text"]), set()).add(r["fingerprint"])
        assert len(names) == 60 and all(len(n) == 1 for n in names.values()) and len(set.union(*names.values())) == 60


def test_equal_hashes_of_edited_texts_part(spark):
    """Edited texts that meet each other, or other documents, in a bucket have fingerprints of their own too."""
    texts = [f"{i} text {i * i} of a number" for i in range(40)]
    edited = [t[: len(t) - len(t) // 4] + n[: len(t) // 4] for t, n in zip(texts, [*texts[1:], texts[0]])]
    docs = spark.createDataFrame(list(enumerate([*texts, *edited[:20]])), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in digests.fingerprints_and_edits(docs, bits=4).collect()}
    names = {}
    for i, r in rows.items():
        text, after = ([*texts, *edited[:20]] * 2)[i : i + 2]
        quarter = len(text) // 4
        names.setdefault(digests.canonical(text), set()).add(r["fingerprint"])
        names.setdefault(digests.canonical(text[: len(text) - quarter] + after[:quarter]), set()).add(r["edited_fingerprint"])
    assert len(names) > 75 and all(len(n) == 1 for n in names.values()) and len(set.union(*names.values())) == len(names)
    few = spark.createDataFrame([(1, "aaaa bbbb"), (2, "cc")], "doc_id long, text string")
    assert len({r[c] for r in digests.fingerprints_and_edits(few, bits=1).collect() for c in ("fingerprint", "edited_fingerprint")}) == 3


def test_the_filter_has_all_shared_hashes(spark):
    shared = [b"\x00" * 16, b"\xff" * 16, b"a" * 12 + b"\x00\x00\x80\x00", *[hashlib.md5(bytes([i])).digest() for i in range(50)]]
    once = [hashlib.md5(b"x" + bytes([i])).digest() for i in range(200)]
    rows = spark.createDataFrame([(bytearray(h),) for h in [*shared, *shared, *once]], "hash binary")
    bits = digests.shared_bits(rows)
    assert len(bits) == 1 << 21 and all(digests.may_be_shared(bits, h) for h in shared)
    assert sum(bin(b).count("1") for b in bits) == len(shared) and not any(digests.may_be_shared(bits, h) for h in once)


def test_quality_of_held_out_documents(spark, odd, none, sf_dir):
    folder = sf_dir.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    found = quality.classify(docs, labels, lambda c: held_out(c, 5, 0))
    rows = found.where("held_out").join(labels, "doc_id").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    assert sum(r["quality"] == r["predicted"] for r in rows) / len(rows) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def plain_statistics(text):
    """The statistics of a text by their definitions: a share is counted with what is known beforehand, then its log odds."""
    text = text or ""
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    before = quality.BEFOREHAND

    def mean(name, values, of):
        typical, weight = before[name]
        return (sum(values) + typical * weight) / (of + weight)

    def odds(name, values, of):
        p = min(mean(name, values, of), 1.0)
        return np.log((p + 0.005) / (1 + 0.005 - p))

    long_ = mean("word_length", [len(w) for w in words], len(words))
    alpha = [c for c in text if c.isalpha()]
    return [
        np.log(1 + len(words)), np.log(1 + long_), np.log(1 + mean("word_length_variance", [(len(w) - long_) ** 2 for w in words], len(words))),
        odds("upper", [c.isupper() for c in text], len(alpha)), odds("letters", [1 for _ in alpha], len(text)), odds("digits", [c.isdigit() for c in text], len(text)),
        odds("symbols", [c in "#$%&*|<>{}[]\\^~=+@_/" for c in text], len(text)), odds("marks", [c in ".!?,;:" for c in text], len(text)),
        odds("distinct", [1 for _ in set(words)], len(words)), odds("commonest", [max(map(words.count, set(words)), default=0)], len(words)),
        np.log(1 + mean("line", [len(words)], len(lines))), odds("repeated", [len(lines) - len(set(lines))], len(lines)), odds("short", [len(w) <= 3 for w in words], len(words)),
    ]


def test_quality_equals_a_plain_version(spark, sf_dir):
    """Statistics, moments, shrinkage and scores restated in plain numpy over all labelled rows."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.where("length(text) < 3000")
    found = {r["doc_id"]: r["score"] for r in quality.classify(docs, labels, lambda c: held_out(c, 5, 0)).collect()}
    x = {r["doc_id"]: np.array(plain_statistics(r["text"])) for r in docs.collect()}
    taught = [(x[r["doc_id"]], r["quality"]) for r in labels.collect() if r["doc_id"] in x and r["quality"] in (0, 1) and zlib.crc32(str(r["doc_id"]).encode()) % 5]
    groups = [np.stack([v for v, q in taught if q == k]) for k in (0, 1)]
    own = [np.cov(g.T, bias=True) for g in groups]
    pooled = sum(len(g) * c for g, c in zip(groups, own)) / len(taught)
    centre, scale = np.stack([v for v, _ in taught]).mean(axis=0), np.sqrt(np.diag(pooled))
    logs = {}
    for g, c in zip(groups, own):
        shrunk = (0.5 * c + 0.5 * pooled) / np.outer(scale, scale)
        shrunk = 0.95 * shrunk + 0.05 * np.trace(shrunk) / len(scale) * np.eye(len(scale))
        inverse, away = np.linalg.inv(shrunk), {i: (v - g.mean(axis=0)) / scale for i, v in x.items()}
        for i, v in away.items():
            logs.setdefault(i, []).append(np.log(len(g) / len(taught)) - 0.5 * np.linalg.slogdet(shrunk)[1] - 0.5 * v @ inverse @ v)
    assert len(found) == len(x) and np.isfinite(centre).all()
    for i, (bad, good) in logs.items():
        assert found[i] == pytest.approx(1 / (1 + np.exp(np.clip(bad - good, -700, 700))), abs=1e-6)


def test_quality_edges(spark, odd, none):
    held = lambda c: held_out(c, 5, 0)
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (5, None, 0), (None, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.classify(odd, labels, held).collect()
    assert len(rows) == 11 and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in quality.classify(odd, labels.limit(0), held).collect()} == {0.5}
    assert {r["score"] for r in quality.classify(odd, labels.where("quality = 1"), held).collect()} == {1.0}
    assert quality.classify(none, labels, held).count() == 0


def test_discriminant_equals_the_densities():
    """The score is the posterior of two normal densities with the shrunk covariances."""
    random_ = np.random.default_rng(4)
    covariance = [np.cov(random_.normal(size=(3, 50))), np.cov(random_.normal(size=(3, 50)) * 2)]
    means, x = [np.zeros(3), np.ones(3)], random_.normal(size=(20, 3))
    classes = []
    for prior, mean, c in zip((0.25, 0.75), means, covariance):
        factor = np.linalg.cholesky(c)
        classes.append((np.log(prior), mean, np.linalg.inv(factor), np.log(np.diag(factor)).sum()))
    got = quality.Discriminant(np.zeros(3), np.ones(3), classes).score(x)
    density = [p * np.exp(-0.5 * np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(c), x - m)) / np.sqrt(np.linalg.det(c)) for p, m, c in zip((0.25, 0.75), means, covariance)]
    assert np.allclose(got, density[1] / (density[0] + density[1]))


def test_hilbert_curve_visits_neighbours():
    for dimensions, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dimensions, indexing="ij"), -1).reshape(-1, dimensions)
        keys = neighbours.hilbert_keys(grid, bits)
        assert sorted(keys) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def recall_of(rows, **settings):
    """Share of the true ten nearest that are found for every hundredth row; checks ranks and scores on the way."""
    local = rows.toPandas().sort_values("vec_id")
    x, ids = np.stack(local["embedding"]).astype(float), local["vec_id"].to_numpy()
    found = neighbours.nearest(rows, F.col("vec_id") % 100 == 0, **settings).toPandas()
    hits = total = 0
    for i in np.nonzero(ids % 100 == 0)[0]:
        distance = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        distance[i] = np.inf
        mine = found[found.query_id == ids[i]].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 11)) and ids[i] not in set(mine.vec_id)
        assert np.allclose(mine.score, distance[np.searchsorted(ids, mine.vec_id)], rtol=0, atol=1e-12)
        hits += len(set(mine.vec_id) & set(ids[np.lexsort((ids, distance))[:10]]))
        total += 10
    return hits / total


@pytest.fixture()
def built(monkeypatch):
    """The indexes that a test builds."""
    kept, real = [], neighbours.build

    def build(*given):
        kept.append(real(*given)[0])
        return real(*given)

    monkeypatch.setattr(neighbours, "build", build)
    return kept


def vectors_of(spark, x):
    import pyarrow as pa

    rows = pa.table({"vec_id": pa.array(range(len(x)), pa.int64()), "embedding": pa.array(x.astype(np.float32).tolist(), pa.list_(pa.float32()))})
    return spark.createDataFrame(rows).repartition(6)


@pytest.mark.parametrize("table", ["sf0.01", "sf0.1"])
def test_neighbours_recall(spark, table):
    assert recall_of(spark.read.parquet(f"/root/testdata/{table}/embeddings.parquet")) >= 0.9


def test_recall_of_vectors_that_fill_the_space(spark, built):
    """Nothing keeps them together but wide windows; still on no curve does a query meet all rows."""
    rows = vectors_of(spark, np.random.default_rng(1).normal(size=(20_000, 64)))
    assert recall_of(rows) >= 0.9
    index = built[0]
    assert all(len(cuts) >= 20 for cuts in index.cuts) and 0.02 < index.half_window < 0.15
    assert 8 * 2 * index.half_window <= index.distances() < 8 * 2 * (index.half_window + 0.03)


def test_recall_of_clustered_vectors(spark, built):
    """Narrow windows are found for them: a query meets a small share of 20,000 rows, in hundreds of blocks."""
    random_ = np.random.default_rng(2)
    centres = random_.normal(size=(400, 64))
    rows = vectors_of(spark, centres[random_.integers(0, 400, 20_000)] + 0.02 * random_.normal(size=(20_000, 64)))
    assert recall_of(rows) >= 0.9
    assert built[0].half_window < 0.02 and built[0].distances() < 0.3


def test_a_given_window_is_kept(spark, built):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    assert recall_of(rows, half_window=0.5) == 1.0
    assert recall_of(rows, half_window=0.001) < 0.9 and built[1].distances() < built[0].distances()


def test_groups_stay_small_for_any_ids():
    for ids in (np.arange(0, 10**6, 100), np.arange(1000) * 64, -np.arange(1000)):
        counts = np.bincount(neighbours._spread(ids) % 16, minlength=16)
        assert counts.max() < 1.6 * len(ids) / 16


def test_neighbours_edges(spark):
    nan, inf = float("nan"), float("inf")
    same = [(i, [1.0, 2.0]) for i in range(100, 140)]
    rows = [*same, (0, [1.0, 2.0]), (200, [1.0, 2.5]), (200, [1.0, 2.5]), (300, None), (400, [0.0, 0.0]), (500, [nan, 1.0]), (600, [inf, 1.0]), (700, [None, 1.0]), (800, [1.0]), (None, [1.0, 1.0])]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = neighbours.nearest(data, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()
    answers = {}
    for r in found:
        answers.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(answers) == {0, 100, 200}
    assert answers[0] == [(i, 0.0) for i in range(100, 110)] and answers[100] == [(i, 0.0) for i in (0, *range(101, 110))]
    assert answers[200] == [(i, 0.5) for i in (0, *range(100, 109))]
    few = neighbours.nearest(data.where("vec_id in (0, 200)"), F.col("vec_id") % 100 == 0).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in few) == [(0, 1, 200), (200, 1, 0)]
    assert neighbours.nearest(data.limit(0), F.lit(True)).count() == 0


def test_lines_by_the_bare_ratio(spark):
    """Copies of a page count where pages needn't be distinct; a line of one page in nine is over a tenth."""
    rows = [(i, f"own {i}\nshared by few" if i < 3 else f"own {i}", "h") for i in range(20)] + [(100 + i, "a copied page", "h") for i in range(10)] + [(200, "alone", "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    bare = {r["doc_id"]: r["text"] for r in lines.drop_boilerplate(docs, least_pages=1, distinct_pages=False).collect()}
    assert bare[100] == "" and bare[200] == "" and bare[0] == "own 0\nshared by few" and bare[19] == "own 19"
    kept = {r["doc_id"]: r["text"] for r in lines.drop_boilerplate(docs).collect()}
    assert kept[100] == "a copied page" and kept[200] == "alone" and kept[0] == "own 0"


def test_mixing_and_edits_in_small_slices(spark, sf_dir, monkeypatch):
    """Slices follow the rows: the same result with very few rows in each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = lambda: sorted(tuple(r) for r in mixing.mix(docs.select("doc_id", "text", "source")).select("doc_id", "taken", "position").collect())
    printed = lambda: sorted(tuple(r) for r in digests.fingerprints_and_edits(docs).collect())
    few = mixed(), printed()
    monkeypatch.setattr(mixing, "SLICE_ROWS", 0.001)
    monkeypatch.setattr(digests, "SLICE_ROWS", 3)
    assert (mixed(), printed()) == few

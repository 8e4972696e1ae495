"""Quality rules: counts of whole texts, and divergence from what characters and common words of a language are like."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofline.llm.common import bounded_batches, cut, pieces

#: Base rules: least words, and the most hundredths of them in windows that are found twice or more.
LEAST_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5
#: A language's common words are in so much of its texts. Shares are counted at so many levels.
COMMON_IN, LEVELS = 0.5, 2000
#: Guards: characters from which the classes are judged, and words from which the common words are.
CHARS_GUARD, WORDS_GUARD = 150, 100
#: Jensen-Shannon distances (0 to 1) up to which a text is like its language: of long texts, and what is allowed
#: besides for n characters or words as a share of 1 / sqrt(n), since short texts differ by chance.
CLASS_LIMIT, CLASS_SLACK = 0.06, 1.8
WORD_LIMIT, WORD_SLACK = 0.10, 3.4
#: Distinct words that a task counts before it hands its frequent ones on.
HELD = 100_000

_SPACES, _SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"
#: Classes of characters: by general category, with marks of sentences apart. Digits count as small letters: how many numbers
#: and addresses a text has is its subject's matter, and one of nothing else has no common words.
CLASSES = ("lower", "upper", "other letter", "mark", "space", "sentence mark", "punctuation", "symbol", "other")
_SENTENCE = ".,;:!?"
_EDGES = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "«»“”‘’„…¡¿–—"


def _class_of(code: int) -> int:
    character = chr(code)
    category = unicodedata.category(character)
    if character in _SENTENCE:
        return CLASSES.index("sentence mark")
    if character in _SPACES:
        return CLASSES.index("space")
    by_category = {"Ll": "lower", "Lu": "upper", "L": "other letter", "M": "mark", "N": "lower", "Z": "space", "P": "punctuation", "S": "symbol"}
    return CLASSES.index(by_category.get(category) or by_category.get(category[0], "other"))


@cache
def class_table() -> np.ndarray:
    """The class of each code point."""
    return np.fromiter(map(_class_of, range(0x110000)), np.uint8, 0x110000)


def class_counts(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = np.zeros(len(CLASSES), np.int64)
    for start in range(0, len(codes), 1 << 18):
        counts += np.bincount(class_table()[codes[start : start + (1 << 18)]], minlength=len(CLASSES))
    return counts


def repeated_words(ids: np.ndarray, distinct: int, window: int = WINDOW) -> int:
    """Words in windows of neighbouring words that are found twice or more, the first time included."""
    if len(ids) <= window:
        return 0
    keys, values = ids.astype(np.int64), max(distinct, 1)
    codes, size = keys[: len(keys) - window + 1], values
    for k in range(1, window):
        if size * values >= 1 << 62:  # so that keys stay exact: number what there is
            found, codes = np.unique(codes, return_inverse=True)
            size = len(found)
        codes = codes * values + keys[k : len(keys) - window + 1 + k]
        size *= values
    ordered = np.sort(codes)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return 0
    starts = np.zeros(len(ids) + 1, np.int64)
    hit = np.flatnonzero(np.isin(codes, again))
    starts[hit] += 1
    starts[hit + window] -= 1
    return int((np.cumsum(starts)[:-1] > 0).sum())


@dataclass
class Profile:
    """Counts of one whole text."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    classes: np.ndarray
    words: Counter

    @property
    def failed(self) -> bool:
        return self.n_words < LEAST_WORDS or 100 * self.n_repeat_words > MOST_REPEATED * self.n_words


def folded(word: bytes) -> str:
    """A word as common words are counted: lower case, without marks at its ends; empty if it has only marks."""
    return word.decode("utf-8", "surrogatepass").strip(_EDGES).lower()


def profile(text: str | None) -> Profile:
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at ASCII white space only
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int32, len(words))
    times = np.bincount(ids, minlength=len(numbers)).tolist()
    common: Counter = Counter()
    for word, n in zip(numbers, times):
        common[folded(word)] += n
    common.pop("", None)
    lines = [line for line in text.split("\n") if line.strip(_SPACES)]
    return Profile(
        len(words),
        len(text) - sum(text.count(c) for c in _SPACES),
        sum(text.count(c) for c in _SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(ids, len(numbers)),
        class_counts(text),
        common,
    )


@dataclass
class References:
    """For each language the shares of the classes, and of its common words with all others as the last."""

    languages: list[str]
    classes: np.ndarray
    words: list[dict[str, int]]
    shares: list[np.ndarray]


def _table(rows: list[tuple], names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column) for column in zip(*rows)], names.split())


def _frequent(batches: Iterable[pa.RecordBatch], least: float, held: int = HELD) -> Iterator[pa.RecordBatch]:
    """(lang, kind, key, n, of) over the texts of a task that have WORDS_GUARD words: how many there are, how many have a class at
    each level, and of the words that at least a share ``least`` of the ``of`` texts of a language have, how many do.

    Its table is handed on and begun anew whenever it has ``held`` words.
    """
    docs, levels, words = Counter(), Counter(), {}

    def handed_on() -> pa.RecordBatch:
        rows = [(language, "docs", "", n, n) for language, n in docs.items()]
        rows += [(language, "class", key, n, docs[language]) for (language, key), n in levels.items()]
        rows += [(language, "word", word, n, docs[language]) for language, found in words.items() for word, n in found.items() if n >= least * docs[language]]
        for table in (docs, levels, words):
            table.clear()
        return _table(rows, "lang kind key n of")

    for batch in batches:
        for languages, texts in zip(pieces(batch.column("lang")), pieces(batch.column("text"))):
            for language, value in zip(languages, texts):
                found = set(value.encode("utf-8", "surrogatepass").split())
                if len(found) < WORDS_GUARD and len(value.encode("utf-8", "surrogatepass").split()) < WORDS_GUARD:
                    continue
                docs[language] += 1
                classes = class_counts(value)
                levels.update((language, f"{name}:{level}") for name, level in zip(CLASSES, np.rint(classes * (LEVELS / classes.sum())).astype(int).tolist()))
                words.setdefault(language, Counter()).update({folded(w) for w in found} - {""})
                if sum(map(len, words.values())) > held:
                    yield handed_on()
    if docs:
        yield handed_on()


def _shares(batches: Iterable[pa.RecordBatch], known: dict[str, frozenset[str]]) -> Iterator[pa.RecordBatch]:
    """(lang, word, level, n): how many texts with WORDS_GUARD words have each known word of their language at each level."""
    levels: Counter = Counter()
    for batch in batches:
        for languages, texts in zip(pieces(batch.column("lang")), pieces(batch.column("text"))):
            for language, value in zip(languages, texts):
                words = value.encode("utf-8", "surrogatepass").split()
                if len(words) >= WORDS_GUARD and language in known:
                    times: Counter = Counter()
                    for word, n in Counter(words).items():
                        times[folded(word)] += n
                    levels.update((language, word, round(times[word] * LEVELS / len(words))) for word in known[language] & times.keys())
    if levels:
        yield _table([(*key, n) for key, n in levels.items()], "lang word level n")


def _medians(counts: DataFrame, keys: list[str], docs: DataFrame) -> DataFrame:
    """keys and ``level``, the median over the language's texts; texts that ``counts`` (keys, level, n) leave out are at level 0."""
    up_to = Window.partitionBy(*keys).orderBy("level")
    told = counts.withColumn("upto", F.sum("n").over(up_to)).withColumn("held", F.sum("n").over(Window.partitionBy(*keys))).join(F.broadcast(docs), "lang")
    return told.where(2 * (F.col("docs") - F.col("held") + F.col("upto")) >= F.col("docs")).groupBy(*keys).agg(
        F.min(F.when(2 * (F.col("docs") - F.col("held")) >= F.col("docs"), 0).otherwise(F.col("level"))).alias("level")
    )


def learn_references(docs: DataFrame, text: str = "text", lang: str = "lang") -> References:
    """References of all languages (non-null ``lang``) over all their texts with WORDS_GUARD words.

    A class or word has the median of its shares in the language's texts, so neither a third of copies nor long texts nor junk
    make it; common words are then those that half of the texts have. Two readings find them exactly with little to
    shuffle. The first takes from each table of a task the words that a quarter of its texts have. A word of half of all texts has
    at least n / 4 + m / 4 of them there, where m of all n texts were in tables that named it; not more than four times as
    many words as a text has on average pass this. The second reading counts the levels of those only.
    """
    taught = bounded_batches(docs).where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    found = taught.mapInArrow(lambda batches: _frequent(batches, COMMON_IN / 2), "lang string, kind string, key string, n long, of long")
    counts = cut(found.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"), F.sum("of").alias("of")))
    of_lang = cut(counts.where("kind = 'docs'").select("lang", F.col("n").alias("docs")))
    local = F.lit(COMMON_IN / 2)
    passing = counts.where("kind = 'word'").join(F.broadcast(of_lang), "lang").where(F.col("n") >= local * F.col("docs") + local * F.col("of"))
    known: dict[str, set[str]] = {}
    for row in passing.select("lang", "key").collect():
        known.setdefault(row["lang"], set()).add(row["key"])
    frozen = {language: frozenset(words) for language, words in known.items()}
    shares = taught.mapInArrow(lambda batches: _shares(batches, frozen), "lang string, word string, level long, n long")
    words = _medians(shares.groupBy("lang", "word", "level").agg(F.sum("n").alias("n")), ["lang", "word"], of_lang).where("level > 0")
    leveled = counts.where("kind = 'class'").select("lang", F.split("key", ":")[0].alias("word"), F.split("key", ":")[1].cast("long").alias("level"), "n")
    by_lang: dict[str, tuple[dict, dict]] = {}
    for k, rows in enumerate((_medians(leveled, ["lang", "word"], of_lang), words)):
        for row in rows.collect():
            by_lang.setdefault(row["lang"], ({}, {}))[k][row["word"]] = row["level"] / LEVELS
    languages = sorted(by_lang)
    classes = np.array([[by_lang[language][0].get(name, 0.0) for name in CLASSES] for language in languages]).reshape(-1, len(CLASSES))
    ordered = [sorted(by_lang[language][1]) for language in languages]
    held = [np.array([by_lang[language][1][word] for word in own], float) for language, own in zip(languages, ordered)]
    return References(
        languages,
        classes / np.maximum(classes.sum(axis=1, keepdims=True), 1e-9),
        [{word: k for k, word in enumerate(own)} for own in ordered],
        [np.append(own, max(0.0, 1.0 - own.sum())) for own in held],
    )


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms that add up to 1: 0 if they are equal, 1 if they share nothing."""

    def entropy(x: np.ndarray) -> float:
        x = x[x > 0]
        return float(-(x * np.log2(x)).sum())

    return float(np.sqrt(min(1.0, max(0.0, entropy((p + q) / 2) - (entropy(p) + entropy(q)) / 2))))


def nearest(found: Profile, known: References) -> tuple[int, float, float]:
    """The language whose common words are the nearest, and the distances of words and classes to it."""
    best = (-1, 1.0, 1.0)
    for i, places in enumerate(known.words):
        own = np.zeros(len(places) + 1)
        for word in found.words.keys() & places.keys():
            own[places[word]] = found.words[word]
        own[-1] = found.n_words - own.sum()
        apart = distance(own / max(found.n_words, 1), known.shares[i])
        if best[0] < 0 or apart < best[1]:
            best = (i, apart, 1.0)
    if best[0] < 0:
        return best
    classes = found.classes / max(int(found.classes.sum()), 1)
    return best[0], best[1], distance(classes, known.classes[best[0]])


def like_a_language(found: Profile, words: float, classes: float) -> bool:
    """The verdict of the divergences, each from its guard on; what is shorter passes."""
    n_chars = int(found.classes.sum())
    odd_classes = n_chars >= CHARS_GUARD and classes > CLASS_LIMIT + CLASS_SLACK / n_chars**0.5
    odd_words = found.n_words >= WORDS_GUARD and words > WORD_LIMIT + WORD_SLACK / found.n_words**0.5
    return not (odd_classes or odd_words)


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_KIND = pa.struct(
    [*[(name, pa.int64()) for name in _COUNTS], ("base_failed", pa.bool_()), ("kept", pa.bool_())]
    + [("nearest_lang", pa.string()), ("word_distance", pa.float64()), ("class_distance", pa.float64())]
)
_DDL = "struct<" + ",".join(f"{n}:long" for n in _COUNTS) + ",base_failed:boolean,kept:boolean,nearest_lang:string,word_distance:double,class_distance:double>"


def rules(docs: DataFrame, references: References, text: str = "text", name: str = "rules") -> DataFrame:
    """``docs`` with the struct ``name``: counts, verdicts, nearest language and distances of each whole text.

    Rows are independent and nothing is shuffled. A null text counts as empty and fails the base rules, as does one of less
    than ten words; without references only the base rules decide. Repeated rows and other columns stay.
    """
    sent = docs.sparkSession.sparkContext.broadcast(references)

    def judged(value: str | None) -> dict:
        found, known = profile(value), sent.value
        at, words, classes = nearest(found, known)
        kept = not found.failed and (at < 0 or like_a_language(found, words, classes))
        counts = {n: getattr(found, n) for n in _COUNTS}
        return {**counts, "base_failed": found.failed, "kept": kept, "nearest_lang": known.languages[at] if at >= 0 else None, "word_distance": words, "class_distance": classes}

    @F.arrow_udf(_DDL)
    def of(column: pa.Array) -> pa.Array:
        return pa.array([judged(value) for part in pieces(column) for value in part], _KIND)

    return bounded_batches(docs).withColumn(name, of(F.col(text)))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept, nearest_lang, word_distance and class_distance of each row of ``docs``.

    The references are learned from all rows of ``docs`` with a language; that is no input of a verdict, so rows with a null or
    wrong one are judged like others. ``doc_id`` is only handed on. An empty table gives no rows.
    """
    return rules(docs.select("doc_id", "text"), learn_references(docs)).select("doc_id", "rules.*")

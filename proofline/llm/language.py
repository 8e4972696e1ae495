"""Language identification with hyperdimensional letter-trigram profiles."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.llm.common import bounded_batches, fresh, pieces

#: Components of a profile.
DIMENSIONS = 1024
#: Seed of the letters' random vectors.
SEED = 20177
#: Language of a text without letters.
UNDETERMINED = "und"
#: Documents and trigrams that are multiplied at once, and trigram vectors that a worker keeps.
TOGETHER, AT_ONCE, KEPT = 64, 1 << 12, 1 << 15

_others = re.compile(r"[\W\d_]+")
_spaces: dict[tuple[int, int], "LetterSpace"] = {}


class LetterSpace:
    """Random sign vectors of letters, bound into trigram vectors.

    A letter's vector is drawn from its code point, so every worker has the same. The trigram abc is the
    product of a's vector shifted twice, b's shifted once and c's: permutation keeps the order of letters.
    """

    def __init__(self, dimensions: int, seed: int) -> None:
        self.dimensions, self.seed = dimensions, seed
        self.letters: dict[int, np.ndarray] = {}
        self.forget()

    def forget(self) -> None:
        self.rows: dict[int, int] = {}
        self.vectors = np.empty((KEPT, self.dimensions), np.int8)  # touched as it fills

    def letter(self, code: int) -> np.ndarray:
        found = self.letters.get(code)
        if found is None:
            random = np.random.default_rng((self.seed, code))
            found = self.letters[code] = random.integers(0, 2, self.dimensions).astype(np.int8) * 2 - 1
        return found

    def bound(self, trigrams: np.ndarray) -> np.ndarray:
        """One vector for each of up to KEPT trigram codes."""
        if len(self.rows) + len(trigrams) > KEPT:
            self.forget()
        at = np.empty(len(trigrams), np.int64)
        for i, gram in enumerate(trigrams.tolist()):
            row = self.rows.get(gram)
            if row is None:
                row = self.rows[gram] = len(self.rows)
                a, b, c = gram >> 42, gram >> 21 & 0x1FFFFF, gram & 0x1FFFFF
                self.vectors[row] = np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)
            at[i] = row
        return self.vectors[at]

    def bundled(self, texts: list[str | None]) -> np.ndarray:
        """The sum of the trigram vectors of each text; zeros for a text without letters."""
        counted = [trigram_counts(text) for text in texts]
        grams, place = np.unique(np.concatenate([g for g, _ in counted]), return_inverse=True)
        counts = np.zeros((len(texts), len(grams)), np.float32)
        at = 0
        for i, (g, n) in enumerate(counted):
            counts[i, place[at : at + len(g)]] = n
            at += len(g)
        bundles = np.zeros((len(texts), self.dimensions), np.float32)
        for start in range(0, len(grams), AT_ONCE):  # whole numbers, so the sum is the same in any order
            bundles += counts[:, start : start + AT_ONCE] @ self.bound(grams[start : start + AT_ONCE]).astype(np.float32)
        return bundles


def trigram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the distinct trigrams of a text and how often each occurs.

    Letters (``str.isalpha``) are lower-cased; whatever lies between words is one space, and so is each end.
    """
    text = (text or "").lower()
    numerals = {ord(c): " " for c in set(text) if c.isalnum() and not c.isalpha()}  # such as a superscript two
    words = _others.sub(" ", text.translate(numerals) if numerals else text).strip()
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.float32)
    codes = np.frombuffer(f" {words} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    grams, n = np.unique(codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:], return_counts=True)
    return grams, n.astype(np.float32)


def letter_space(dimensions: int, seed: int) -> LetterSpace:
    key = (dimensions, seed)
    if key not in _spaces:
        _spaces[key] = LetterSpace(*key)
    return _spaces[key]


def learn_prototypes(
    df: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS, seed: int = SEED
) -> list[tuple[str, list[float]]]:
    """(language, unit vector) of each language in ``df``, in order of the language's name.

    All rows with a non-null language and text are bundled where they lie; each task passes on one vector
    for each language, which are summed by component. What reaches the driver is languages x dimensions.
    """
    work = df.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")

    def bundle(batches):
        import pandas as pd

        space, sums = letter_space(dimensions, seed), {}
        for batch in batches:
            for start in range(0, len(batch), TOGETHER):
                part = batch.iloc[start : start + TOGETHER]
                vectors = space.bundled(part["text"].tolist())
                for name, vector in zip(part["lang"], vectors):
                    if name in sums:
                        sums[name] += vector
                    else:
                        sums[name] = vector.astype(np.float64)
        for name, vector in sums.items():
            yield pd.DataFrame({"lang": name, "component": np.arange(dimensions), "value": vector})

    summed = (
        bounded_batches(work).mapInPandas(bundle, "lang string, component int, value double")
        .groupBy("lang", "component")
        .agg(F.sum("value").alias("value"))
        .groupBy("lang")
        .agg(F.array_sort(F.collect_list(F.struct("component", "value"))).alias("vector"))
        .orderBy("lang")
        .collect()
    )
    found = []
    for row in summed:
        vector = np.array([x["value"] for x in row["vector"]])
        norm = np.linalg.norm(vector)
        if norm > 0:
            found.append((row["lang"], (vector / norm).tolist()))
    return found


def predict_language(
    df: DataFrame,
    prototypes: list[tuple[str, list[float]]],
    text: str = "text",
    lang_pred: str = "lang_pred",
    score: str = "score",
    dimensions: int = DIMENSIONS,
    seed: int = SEED,
) -> DataFrame:
    """Add ``lang_pred`` (string) and ``score`` (double, 0 to 1) for each whole text.

    The language is the one whose prototype has the largest cosine with the text's bundle, of equal cosines
    the first by name; the score is that cosine, 0 where it is negative. A text that is null or has no
    letters is ``und`` with score 0, as is every text if there is no prototype. Other columns and repeated
    rows stay; existing columns of the two names are replaced. Nothing is shuffled.
    """
    names = [name for name, _ in prototypes]
    matrix = np.array([vector for _, vector in prototypes], np.float32).reshape(len(names), dimensions)

    @F.arrow_udf("struct<lang:string,score:double>")
    def nearest(column: pa.Array) -> pa.Array:
        space, langs, scores = letter_space(dimensions, seed), [], []
        for part in pieces(column, TOGETHER):
            vectors = space.bundled(part)
            norms = np.linalg.norm(vectors, axis=1)
            if not names:
                norms[:] = 0
            cosines = vectors @ matrix.T / np.where(norms > 0, norms, 1)[:, None] if names else np.zeros((len(part), 1))
            best = cosines.argmax(axis=1)
            langs += [names[b] if n > 0 else UNDETERMINED for b, n in zip(best, norms)]
            scores.append(np.where(norms > 0, cosines[np.arange(len(part)), best], 0).clip(0, 1).astype(np.float64))
        flat = np.concatenate(scores) if scores else np.empty(0)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(flat)], ["lang", "score"])

    found = fresh(df, "nearest")
    return (
        bounded_batches(df).withColumn(found, nearest(F.col(text)))
        .withColumns({lang_pred: F.col(f"{found}.lang"), score: F.col(f"{found}.score")})
        .drop(found)
    )


def identify(df: DataFrame, learn_from: Column) -> DataFrame:
    """doc_id, lang_pred and score of each row of ``df``; learned from its rows where ``learn_from`` is true."""
    prototypes = learn_prototypes(df.where(learn_from))
    return predict_language(df.select("doc_id", "text"), prototypes).drop("text")

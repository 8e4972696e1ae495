"""Quality classifier: regularised quadratic discriminant over document statistics."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from math import log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.llm.common import bounded_batches, cut, fresh, pieces

#: Transformed statistics of a text, in the order in which ``statistics`` returns them.
STATISTICS = (
    "log_words", "mean_word_length", "word_length_spread", "upper_letters", "letters", "digits", "symbols",
    "end_marks", "distinct_words", "commonest_word", "words_per_line", "repeated_lines", "short_words",
)
#: Share of the pooled covariance in each class's, and of the mean variance in that.
TO_POOLED, TO_SPHERE = 0.5, 0.05
#: From this score on a document is predicted to be good.
THRESHOLD = 0.3

_symbols = frozenset("#$%&*|<>{}[]\\^~=+@_/")
_marks = frozenset(".!?,;:")


#: What each statistic of a text counts beforehand: (typical value, as if of so many words or characters).
#: So a text of few words is near the typical values instead of at an extreme.
BEFOREHAND = {
    "word_length": (5.0, 10), "word_length_variance": (6.0, 10), "upper": (0.03, 30), "letters": (0.82, 40), "digits": (0.003, 40),
    "symbols": (0.002, 40), "marks": (0.025, 40), "distinct": (0.7, 15), "commonest": (0.05, 15), "line": (40.0, 1),
    "repeated": (0.01, 2), "short": (0.35, 15),
}


def _mean(name: str, total: float, of: int) -> float:
    typical, weight = BEFOREHAND[name]
    return (total + typical * weight) / (of + weight)


def _share(name: str, part: int, of: int) -> float:
    mean = min(_mean(name, part, of), 1.0)
    return log((mean + 0.005) / (1.005 - mean))


def statistics(text: str | None) -> list[float]:
    """The statistics of one whole text; those of an empty one for null."""
    text = text or ""
    words = text.split()
    n, size = len(words), len(text)
    lines = [line for line in text.split("\n") if line.strip()]
    lengths = np.fromiter(map(len, words), float, n)
    word_length = _mean("word_length", float(lengths.sum()), n)
    characters, common = Counter(text), Counter(words)
    letters = sum(k for c, k in characters.items() if c.isalpha())
    return [
        log1p(n),
        log1p(word_length),
        log1p(_mean("word_length_variance", float(((lengths - word_length) ** 2).sum()), n)),
        _share("upper", sum(k for c, k in characters.items() if c.isupper()), letters),
        _share("letters", letters, size),
        _share("digits", sum(k for c, k in characters.items() if c.isdigit()), size),
        _share("symbols", sum(characters[c] for c in _symbols), size),
        _share("marks", sum(characters[c] for c in _marks), size),
        _share("distinct", len(common), n),
        _share("commonest", max(common.values(), default=0), n),
        log1p(_mean("line", n, len(lines))),
        _share("repeated", len(lines) - len(set(lines)), len(lines)),
        _share("short", int((lengths <= 3).sum()), n),
    ]


def with_statistics(df: DataFrame, text: str = "text", name: str = "statistics") -> DataFrame:
    """Add the array<double> ``name`` of the statistics of each whole text."""

    @F.arrow_udf("array<double>")
    def of(column: pa.Array) -> pa.Array:
        return pa.array([statistics(value) for part in pieces(column) for value in part], pa.list_(pa.float64()))

    return bounded_batches(df).withColumn(name, of(F.col(text)))


@dataclass
class Discriminant:
    """Of classes 0 and 1: log prior, mean, inverse of the covariance's Cholesky factor, half log determinant.

    ``constant`` replaces them where there are not two classes to tell apart.
    """

    centre: np.ndarray
    scale: np.ndarray
    classes: list[tuple[float, np.ndarray, np.ndarray, float]]
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        """Posterior of class 1 for each row of ``x``."""
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = (x - self.centre) / self.scale
        density = [
            prior - half_log_det - 0.5 * (((z - mean) @ whiten.T) ** 2).sum(axis=1)
            for prior, mean, whiten, half_log_det in self.classes
        ]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def fit(
    labelled: DataFrame, features: str, label: str, to_pooled: float = TO_POOLED, to_sphere: float = TO_SPHERE
) -> Discriminant:
    """Fit on all rows of ``labelled`` with label 0 or 1; other labels and null are left out.

    Counts, sums and products of the features are summed in Spark, so one row for each class reaches the
    driver. Each class's covariance is shrunk towards the pooled one and that towards a sphere, which keeps
    it invertible when a statistic is constant or a class has few rows. With one class only, every score
    is 1 or 0 after it; without labels it is 0.5.
    """
    d = len(STATISTICS)
    x = [F.col(features)[i] for i in range(d)]
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    rows = (
        labelled.where(F.col(label).isin(0, 1))
        .groupBy(F.col(label).cast("int").alias("label"))
        .agg(F.count("*").alias("n"), *[F.sum(v) for v in x], *[F.sum(x[i] * x[j]) for i, j in pairs])
        .collect()
    )
    found = {}
    for row in rows:
        products = np.zeros((d, d))
        for (i, j), value in zip(pairs, row[2 + d :]):
            products[i, j] = products[j, i] = value
        found[row["label"]] = (row["n"], np.array(row[2 : 2 + d], float), products)
    if len(found) < 2:
        return Discriminant(np.zeros(d), np.ones(d), [], float(next(iter(found))) if found else 0.5)
    total = sum(n for n, _, _ in found.values())
    within = {k: products / n - np.outer(s / n, s / n) for k, (n, s, products) in found.items()}
    pooled = sum(found[k][0] * within[k] for k in found) / total
    centre = sum(s for _, s, _ in found.values()) / total
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-8))
    classes = []
    for k in (0, 1):
        n, s, _ = found[k]
        shrunk = ((1 - to_pooled) * within[k] + to_pooled * pooled) / np.outer(scale, scale)
        shrunk = (1 - to_sphere) * shrunk + to_sphere * max(np.trace(shrunk) / d, 1e-6) * np.eye(d)
        factor = np.linalg.cholesky((shrunk + shrunk.T) / 2)
        classes.append((log(n / total), (s / n - centre) / scale, np.linalg.inv(factor), float(np.log(np.diag(factor)).sum())))
    return Discriminant(centre, scale, classes)


def score_quality(df: DataFrame, model: Discriminant, features: str, score: str = "score") -> DataFrame:
    """Add ``score``, the probability of label 1; rows are independent and nothing is shuffled."""

    @F.arrow_udf("double")
    def posterior(column: pa.Array) -> pa.Array:
        x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(STATISTICS))
        return pa.array(model.score(x))

    return df.withColumn(score, posterior(F.col(features)))


def classify(df: DataFrame, labels: DataFrame, held_out) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from a score of 0.3 on) of each row of ``df``.

    ``labels`` has doc_id and quality, and teaches by the rows of ``df`` that aren't held out; a document
    that it names more than once counts as often. Rows with a null doc_id or label teach nothing but are
    scored. A null text scores as an empty one. The statistics are computed once and cut to the shared folder.
    """
    source = df.select("doc_id", "text")
    stats = fresh(source, "statistics")
    known = cut(with_statistics(source, "text", stats).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), stats))
    taught = known.where("not held_out").join(labels.select("doc_id", "quality").where("quality is not null"), "doc_id")
    scored = score_quality(known, fit(taught, stats, "quality"), stats)
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))

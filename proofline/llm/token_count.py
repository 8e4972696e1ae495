"""Token counts of a unigram tokenizer without building tokens."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from math import inf

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.llm.common import bounded_batches, pieces

#: White space mark of the vocabulary's pieces.
SPACE = "▁"
#: What an unknown character scores below the least piece; fixed by the tokenizer's rules.
UNKNOWN_PENALTY = 10.0
#: A Python worker remembers the counts of the last so many words, and of as many before them.
REMEMBERED = 300_000

_between = re.compile(f"[^{SPACE}]{SPACE}")
_words = re.compile(f"{SPACE}+[^{SPACE}]*")
_words_in_lines = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")
_built: dict[str, "CountOnlyViterbi"] = {}


def read_vocabulary(model_path: str) -> tuple[list[tuple[str, float]], bool]:
    """The ordinary pieces of a vocabulary file with their stored scores, and if it has all byte pieces.

    Control, unknown, unused and byte pieces match no text, so they are left out.
    """
    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    ids = range(model.get_piece_size())
    ordinary = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
    return [(model.id_to_piece(i), model.get_score(i)) for i in ordinary], sum(map(model.is_byte, ids)) == 256


class CountOnlyViterbi:
    """Number of pieces of the best segmentation.

    An Aho-Corasick automaton enumerates all vocabulary matches by their ends. For each position the
    dynamic programme keeps the best score and, beside it, the number of pieces of that path; no lattice
    or back pointer is stored. Ties, as the tokenizer has them: the best path to a position is replaced
    only by a higher score, and pieces are tried by ascending start, so of equal paths the one whose last
    piece starts first stays. A character without a piece of its own scores as unknown, and counts one for
    each of its bytes if the vocabulary has byte pieces, else one for a run of unknown characters.
    """

    def __init__(self, vocabulary: Iterable[tuple[str, float]], byte_fallback: bool) -> None:
        self.byte_fallback = byte_fallback
        known = dict(vocabulary)
        self.characters = frozenset(piece for piece in known if len(piece) == 1)
        self.automaton = ahocorasick.Automaton()
        for piece, score in known.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(known.values(), default=0.0) - UNKNOWN_PENALTY
        self.segments = _words if any("\n" in piece and len(piece) > 1 for piece in known) else _words_in_lines
        # no piece may cross from text into the next word, else words aren't independent
        self.by_word = (byte_fallback or {SPACE, "\n"} <= set(known)) and not any(_between.search(piece) for piece in known)
        self.counts: dict[str, int] = {}
        self.earlier: dict[str, int] = {}

    def count(self, text: str | None) -> int:
        """Tokens of a whole text; none for null or empty."""
        if not text:
            return 0
        marked = SPACE + text.replace(" ", SPACE)
        total = 0
        for segment in self.segments.findall(marked) if self.by_word else [marked]:
            n = self.counts.get(segment)
            if n is None:
                n = self.earlier.get(segment)
                if n is None:
                    n = self.best(segment)
                if len(segment) < 64:
                    if len(self.counts) >= REMEMBERED:
                        self.earlier, self.counts = self.counts, {}
                    self.counts[segment] = n
            total += n
        return total

    def best(self, segment: str) -> int:
        """Pieces of the best path over one segment.

        The automaton yields matches by ascending end, and of one end the longest first, so by ascending
        start: the order that the tie rule needs.
        """
        size = len(segment)
        score, count = [-inf] * (size + 1), [0] * (size + 1)
        score[0] = 0.0
        if self.characters and self.characters.issuperset(segment):
            for last, (length, value) in self.automaton.iter(segment):
                start = last + 1 - length
                candidate = score[start] + value
                if candidate > score[last + 1]:
                    score[last + 1] = candidate
                    count[last + 1] = count[start] + 1
            return count[size]
        matches = self.automaton.iter(segment) if self.characters or len(self.automaton) else iter(())
        last, match = next(matches, (size, None))
        in_unknown = [False] * (size + 1)
        for end in range(1, size + 1):
            while last + 1 == end:
                start = end - match[0]
                if score[start] + match[1] > score[end]:
                    score[end], count[end] = score[start] + match[1], count[start] + 1
                last, match = next(matches, (size, None))
            if segment[end - 1] not in self.characters and score[end - 1] + self.unknown > score[end]:
                bytes_ = len(segment[end - 1].encode("utf-8", "surrogatepass"))
                score[end], in_unknown[end] = score[end - 1] + self.unknown, True
                count[end] = count[end - 1] + (bytes_ if self.byte_fallback else 1 - in_unknown[end - 1])
        return count[size]


def counter(name: str, vocabulary: list[tuple[str, float]], byte_fallback: bool) -> CountOnlyViterbi:
    """The counter of a vocabulary, which ``name`` tells from all others; built once in each Python worker."""
    if name not in _built:
        _built.clear()
        _built[name] = CountOnlyViterbi(vocabulary, byte_fallback)
    return _built[name]


def count_tokens(df: DataFrame, model_path: str, text: str = "text", n_tokens: str = "n_tokens") -> DataFrame:
    """Add the column ``n_tokens`` (long): unigram tokens of each whole text, 0 for null or empty.

    The tokenizer is the unigram model over the pieces and scores stored in ``model_path``: a space mark is
    put before the text, spaces become marks, nothing else is normalised. Scores are added in double
    precision. Other columns and repeated rows stay; an existing ``n_tokens`` is replaced. No shuffle; the
    vocabulary that is broadcast has the size of its file.
    """
    vocabulary = read_vocabulary(model_path)
    shipped = df.sparkSession.sparkContext.broadcast((hashlib.sha256(repr(vocabulary).encode()).hexdigest(), *vocabulary))

    @F.arrow_udf("long")
    def counts(column: pa.Array) -> pa.Array:
        viterbi = counter(*shipped.value)
        return pa.array([viterbi.count(value) for part in pieces(column) for value in part], pa.int64())

    return bounded_batches(df).withColumn(n_tokens, counts(F.col(text)))

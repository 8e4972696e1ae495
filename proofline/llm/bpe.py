"""Byte-level BPE encoding and decoding with tiktoken and a local rank file."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute
import tiktoken
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.llm.common import bounded_batches, fresh, pieces

#: Texts are handed to the tokenizer in chunks of about this many code points.
CHUNK = 1 << 16
#: A run of white space from this length on is one match that is encoded without the pattern.
LONG_RUN = 1 << 12

#: The pattern of which all of a text is one match.
AS_ONE = r"[\s\S]+"

_run = re.compile(r"\s+")
_loaded: dict[tuple[bytes, str], tiktoken.Encoding] = {}
_tables: dict[bytes, np.ndarray] = {}


def encoding(rank_file: bytes, pattern: str) -> tiktoken.Encoding:
    """The tokenizer of a rank file and a pattern; built once in each Python worker, which keeps those of one file."""
    key = (hashlib.sha256(rank_file).digest(), pattern)
    if key not in _loaded:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, rank_file.splitlines())}
        for other in [k for k in _loaded if k[0] != key[0]]:
            del _loaded[other]
        _loaded[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[key]


def safe_chunks(text: str, size: int = CHUNK) -> Iterator[tuple[str, bool]]:
    """Split a text only where no match of the pattern can cross; yields (chunk, is one match).

    In the pattern white space begins a match or is all of it, and looks ahead to the end of its run at
    most. So a cut before a run of white space is safe. Of a long run followed by other text, all but the
    last character is one match (all of it at the end of the text); it is yielded by itself, as matching
    it by backtracking would be slow. A text without white space stays whole.
    """
    start = 0
    for run in _run.finditer(text) if len(text) > size else ():
        if run.end() - run.start() >= LONG_RUN:
            if run.start() > start:
                yield text[start : run.start()], False
            start = run.end() - (run.end() < len(text))
            yield text[run.start() : start], True
        elif run.start() - start >= size:
            yield text[start : run.start()], False
            start = run.start()
    if start < len(text):
        yield text[start:], False


def token_bytes(rank_file: bytes) -> np.ndarray:
    """The bytes of each id, None where there is none; built once in each Python worker."""
    key = hashlib.sha256(rank_file).digest()
    if key not in _tables:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, rank_file.splitlines())}
        table = np.empty(max(ranks) + 1, object)
        for rank, token in ranks.items():
            table[rank] = token
        _tables.clear()
        _tables[key] = table
    return _tables[key]


def encode_text(tokenizer: tiktoken.Encoding, text: str | None, as_one: tiktoken.Encoding | None = None) -> np.ndarray:
    """Token ids of one text; none for null or empty.

    ``as_one`` has the same ranks and takes all it is given for one match; without it the text stays whole.
    """
    chunks = [(text, False)] if text and as_one is None else safe_chunks(text or "")
    found = [np.array((as_one if whole else tokenizer).encode_ordinary(chunk), dtype=np.uint32) for chunk, whole in chunks]
    return np.concatenate(found) if found else np.empty(0, dtype=np.uint32)


def _shipped(df: DataFrame, path: str) -> Broadcast:
    """The rank file's bytes; a vocabulary file is under a megabyte whatever the corpus."""
    with open(path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode(df: DataFrame, rank_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the column ``ids`` (array<int>): the tokens of each whole text, without special tokens.

    Each match of ``pattern`` is encoded by itself, as tiktoken does. A null or empty text has no ids.
    Texts that spell special tokens are ordinary text. Other columns and repeated rows are kept as they
    are; an existing column ``ids`` is replaced. Rows are independent, so nothing is shuffled. Long texts are split
    at boundaries that are safe for the tokenizers' common pattern; with another pattern they stay whole.
    """
    shipped = _shipped(df, rank_path)

    @F.arrow_udf("array<int>")
    def token_ids(column: pa.Array) -> pa.Array:
        tokenizer, found, ends = encoding(shipped.value, pattern), [], [0]
        as_one = encoding(shipped.value, AS_ONE) if pattern == public_tokenizers.PATTERN else None
        for part in pieces(column):
            for value in part:
                found.append(encode_text(tokenizer, value, as_one))
                ends.append(ends[-1] + len(found[-1]))
        flat = np.concatenate(found).astype(np.int32) if found else np.empty(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))

    return bounded_batches(df).withColumn(ids, token_ids(F.col(text)))


def decode(df: DataFrame, rank_path: str, ids: str = "ids", data: str = "decoded") -> DataFrame:
    """Add the column ``data`` (binary): the exact bytes that the ids stand for, valid UTF-8 or not.

    Null ids, or an empty list, give empty bytes. An id without a token fails the job: it would lose data.
    """
    shipped = _shipped(df, rank_path)

    @F.arrow_udf("binary")
    def raw_bytes(column: pa.Array) -> pa.Array:
        table, found = token_bytes(shipped.value), []
        for start in range(0, len(column), 256):
            part = column.slice(start, 256)
            ids, ends = part.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.append(0, [n or 0 for n in pa.compute.list_value_length(part).to_pylist()]))
            if len(ids) and ids.min() < 0:
                raise IndexError("an id below zero has no token")
            found += [b"".join(table[ids[a:b]].tolist()) for a, b in zip(ends, ends[1:])]
        return pa.array(found, pa.binary())

    return bounded_batches(df).withColumn(data, raw_bytes(F.col(ids)))


def round_trip_digests(df: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """Per row of ``df``: doc_id, n_tokens, SHA-256 of the comma-joined ids and of the decoded bytes."""
    source = df.select("doc_id", "text")
    ids, data = fresh(source, "ids"), fresh(source, "decoded")
    both = decode(encode(source, rank_path, pattern, "text", ids), rank_path, ids, data)
    return both.select(
        "doc_id",
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids).cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col(data), 256).alias("decoded_sha256"),
    )

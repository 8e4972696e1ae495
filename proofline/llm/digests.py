"""Canonical exact fingerprints of documents."""

from __future__ import annotations

import hashlib
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofline.llm.common import bounded_batches, cut, fresh, pieces

#: Bits of the hash by which folded texts are grouped.
BITS = 128
#: log2 of the bits of the filter of hashes that occur more than once: 2 MB whatever the corpus.
FILTER_BITS = 24
#: Rows of one slice of the order by doc_id, and the most slices, which are as many quantiles.
SLICE_ROWS, MOST_SLICES = 4096, 1 << 16


def canonical(text: str | None) -> bytes:
    """The folded text: NFKC, case folding, NFKC again, runs of white space to one space, ends stripped."""
    text = text or ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    return " ".join(text.split()).encode("utf-8", "surrogatepass")


def digest(folded: bytes, bits: int = BITS) -> bytes:
    """The bits by which folded texts are grouped; fewer than BITS (for tests) make different texts meet."""
    found = xxhash.xxh3_128_digest(folded)
    return found if bits == BITS else (int.from_bytes(found, "big") >> (BITS - bits)).to_bytes(16, "big")


def _text_udf(kind: str, of, arrow_type: pa.DataType):
    @F.arrow_udf(kind)
    def applied(column: pa.Array) -> pa.Array:
        return pa.array([of(value) for part in pieces(column) for value in part], arrow_type)

    return applied


def shared_bits(hashes: DataFrame) -> bytes:
    """The filter of the hashes (hash) that occur more than once: bit v is set if one of them ends with v.

    What reaches the driver is 4 kB for each 32768 bits of which one is set, so 2 MB at most.
    """
    value = F.conv(F.substring(F.hex("hash"), 25, 8), 16, 10).cast("long") % (1 << FILTER_BITS) + 1  # Spark's bitmaps count from 1
    shared = hashes.groupBy("hash").count().where("count > 1").select(value.alias("value"))
    maps = (
        shared.groupBy(F.bitmap_bucket_number("value").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("value")).alias("map"))
        .collect()
    )
    bits = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for row in maps:
        start = (row["bucket"] - 1) * 4096
        bits[start : start + 4096] = np.frombuffer(row["map"], np.uint8)
    return bits.tobytes()


def may_be_shared(bits: bytes, found: bytes) -> bool:
    value = int.from_bytes(found[-4:], "big") % (1 << FILTER_BITS)
    return bool(bits[value >> 3] >> (value & 7) & 1)


def clashes(docs: DataFrame, text: str = "text", bits: int = BITS) -> DataFrame:
    """hash (binary) of the buckets in which folded texts with different bytes meet; none is to be expected.

    Only hashes of 16 bytes are grouped to find the buckets with several rows. Those set bits of a filter of
    fixed size, by which a second reading of the texts sends only rows of such buckets on. There the folded
    texts themselves, compressed, are part of the key, so Spark compares their bytes; copies are merged before
    they move. The filter's size doesn't grow with the corpus: with over 10 million shared buckets it lets most rows
    pass, which costs a shuffle of compressed texts, and never fewer than must be compared.
    """
    source = bounded_batches(docs).select(F.col(text).alias("text"))
    hashes = source.select(_text_udf("binary", lambda t: digest(canonical(t), bits), pa.binary())(F.col("text")).alias("hash"))
    shipped = docs.sparkSession.sparkContext.broadcast(shared_bits(hashes))

    def bucketed(value: str | None) -> dict | None:
        folded = canonical(value)
        found = digest(folded, bits)
        return {"hash": found, "folded": zlib.compress(folded, 1)} if may_be_shared(shipped.value, found) else None

    kept = source.select(
        _text_udf("struct<hash:binary,folded:binary>", bucketed, pa.struct([("hash", pa.binary()), ("folded", pa.binary())]))(F.col("text")).alias("b")
    ).where("b is not null")
    variants = kept.select("b.hash", "b.folded").distinct()
    return cut(variants.groupBy("hash").count().where("count > 1").select("hash"))


def edited_clashes(rows: DataFrame) -> DataFrame:
    """hash of the buckets of own and edited texts (structs of hash and sure) in which different texts meet.

    Edited texts are written nowhere, so they are told apart, from each other and from own ones, by SHA-256 and not
    by their bytes once more.
    """
    both = rows.select(F.explode(F.array("own", "edited")).alias("b")).select("b.hash", "b.sure")
    return both.groupBy("hash").agg(F.min("sure").alias("low"), F.max("sure").alias("high")).where("low <> high").select("hash")


def in_order_with_next(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text and next: each row with the text that follows by doc_id, the first after the last.

    The order is cut into slices at values of doc_id, so that no task sorts all rows; the rows that begin a
    slice are also sent to the end of the one before, where they are only looked at. Null ids come first, null
    texts are empty; rows of one id, or without one, are in the order of a hash of their texts, and in one slice.
    Whole texts move once, and are no sort key.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows, first, nulls = source.agg(F.count("*"), F.min("doc_id"), F.count(F.when(F.col("doc_id").isNull(), 1))).first()
    slices = max(1, min(-(-rows // SLICE_ROWS), MOST_SLICES))
    marks = [i / slices for i in range(1, slices)]
    bounds = source.agg(F.percentile_approx("doc_id", marks or [0.5], max(10_000, 20 * slices))).first()[0] or []
    bounds = np.array(sorted({b for b in bounds if b > first}) if marks and first is not None else [], np.int64)
    last, first = len(bounds), None if nulls else first

    places = pa.list_(pa.struct([("slice", pa.int32()), ("ahead", pa.int32())]))

    @F.arrow_udf("array<struct<slice:int,ahead:int>>")
    def placed(column: pa.Array) -> pa.Array:
        found = []
        for part in pieces(column, 4096):
            for value in part:
                own = 0 if value is None else int(np.searchsorted(bounds, value, side="right"))
                at = [{"slice": own, "ahead": 0}]
                if own and value == bounds[own - 1]:
                    at.append({"slice": own - 1, "ahead": 1})
                if value == first:
                    at.append({"slice": last, "ahead": 2})
                found.append(at)
        return pa.array(found, places)

    spread = source.select("doc_id", "text", F.explode(placed(F.col("doc_id"))).alias("at")).select("doc_id", "text", "at.slice", "at.ahead")
    order = Window.partitionBy("slice").orderBy("ahead", "doc_id", F.xxhash64("text"))
    return spread.withColumn("next", F.lead("text").over(order)).where("ahead = 0").select("doc_id", "text", "next")


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint", bits: int = BITS) -> DataFrame:
    """``docs`` with the string ``name``: equal exactly where the folded texts are equal.

    It is the hash as 32 hex digits. In a bucket where different folded texts meet, their SHA-256 follows, so
    that a fingerprint depends on the text alone. Null counts as empty; other columns and repeated rows stay.
    """
    both = fresh(docs, "both")
    kind = pa.struct([("hash", pa.binary()), ("sure", pa.binary())])

    def of(value: str | None) -> dict:
        folded = canonical(value)
        return {"hash": digest(folded, bits), "sure": hashlib.sha256(folded).digest()}

    hashed = docs.withColumn(both, _text_udf("struct<hash:binary,sure:binary>", of, kind)(F.col(text)))
    return _named(hashed, clashes(docs, text, bits), both, name).drop(both)


def _named(hashed: DataFrame, clashing: DataFrame, struct: str, name: str) -> DataFrame:
    """The fingerprint of the struct (hash, sure); clashes are few or none, so Spark will broadcast them."""
    hit, key = fresh(hashed, "hit"), fresh(hashed, "clashing")
    joined = hashed.join(
        clashing.select(F.col("hash").alias(key), F.lit(True).alias(hit)), F.col(f"{struct}.hash") == F.col(key), "left"
    )
    digits = F.lower(F.hex(f"{struct}.hash"))
    return joined.withColumn(name, F.when(F.col(hit), F.concat(digits, F.lit(":"), F.lower(F.hex(f"{struct}.sure")))).otherwise(digits)).drop(hit, key)


def fingerprints_and_edits(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """Fingerprints of each text, of its edit, and their likeness; see ``op8`` of the registered queries.

    The edited text has its last quarter of code points replaced by the first as many of the next document's.
    ``near_edited`` and ``near_next`` are 1 if the folded bytes are the same, else 0: an exact digest knows no
    degrees. Rows with null text count as empty, null and repeated ids are ordered as in
    ``in_order_with_next``, and a single document follows itself. Own and edited texts of one bucket with different
    bytes get different fingerprints. Other columns are not returned.
    """
    sure = pa.struct([("hash", pa.binary()), ("sure", pa.binary())])
    kind = pa.struct(
        [("n_chars", pa.int64()), ("edited_sha256", pa.binary()), ("own", sure), ("edited", sure), ("near_edited", pa.float64()), ("near_next", pa.float64())]
    )

    @F.arrow_udf(
        "struct<n_chars:long,edited_sha256:binary,own:struct<hash:binary,sure:binary>,edited:struct<hash:binary,sure:binary>,"
        "near_edited:double,near_next:double>"
    )
    def compared(texts: pa.Array, nexts: pa.Array) -> pa.Array:
        found = []
        for part, following in zip(pieces(texts), pieces(nexts)):
            for text, after in zip(part, following):
                quarter = len(text) // 4
                edited = text[: len(text) - quarter] + after[:quarter]
                own, changed = canonical(text), canonical(edited)
                found.append(
                    {
                        "n_chars": len(text),
                        "edited_sha256": hashlib.sha256(edited.encode("utf-8", "surrogatepass")).digest(),
                        "own": {"hash": digest(own, bits), "sure": hashlib.sha256(own).digest()},
                        "edited": {"hash": digest(changed, bits), "sure": hashlib.sha256(changed).digest()},
                        "near_edited": float(own == changed),
                        "near_next": float(own == canonical(after)),
                    }
                )
        return pa.array(found, kind)

    ordered = in_order_with_next(docs, "doc_id", "text")
    rows = cut(ordered.select("doc_id", compared(F.col("text"), F.col("next")).alias("r")).select("doc_id", "r.*"))
    clashing = clashes(docs, bits=bits).union(edited_clashes(rows)).distinct()
    named = _named(_named(rows, clashing, "own", "fingerprint"), clashing, "edited", "edited_fingerprint")
    return named.select(
        "doc_id", "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next"
    )

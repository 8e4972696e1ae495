"""Similarity join of word shingles: pairs of texts with a Jaccard similarity of 0.8 or more, checked exactly."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.llm.common import bounded_batches, cut, cut_small, pieces

#: Words of a shingle, and the similarity from which texts link, as a fraction.
SHINGLE, LEAST = 5, (4, 5)
#: Shingles of a text's sketch, the least by hash, and those of them at which it meets other texts. Two texts of the
#: least similarity share none of the least m shingles of both with a probability of 0.2^m at most: 7e-12 for 16.
SKETCH, MEETS = 32, 16
#: A shingle of more texts than these is met only together with the next one, by texts with too few others; and where
#: even that has more, so many of the most central texts are compared with the others before the rest is.
MANY, PIVOTS = 64, 8
#: Texts of fewer shingles than these are not filtered by their SimHash, where that is asked for.
LEAST_FILTERED = 64
#: Bits of the filter that keeps texts without a pair out of a shuffle, for each text with one, and most bits (16 MB).
FILTER_SHARE, FILTER_BITS = 8, 1 << 27

#: Longs of a text's bits: two of its SimHash, and four of the parity of its shingles by the first byte of their hashes.
_BITS = ["low", "high", "p0", "p1", "p2", "p3"]
SIGNATURE = f"struct<h:binary,n:int,near:struct<{','.join(f'{b}:long' for b in _BITS)}>,sketch:array<long>>"
_kind = pa.struct([("h", pa.binary()), ("n", pa.int32()), ("near", pa.struct([(b, pa.int64()) for b in _BITS])), ("sketch", pa.list_(pa.int64()))])


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # as simhash.fingerprint


def _shingles(found: list[bytes]) -> np.ndarray:
    if not found:
        return np.empty(0, np.int64)
    each = np.array([xxhash.xxh3_64_intdigest(w) for w in found], np.uint64)
    width = min(SHINGLE, len(each))
    mixed = np.full(len(each) - width + 1, width, np.uint64)
    for i in range(width):
        mixed = (mixed ^ each[i : len(each) - width + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed.view(np.int64))


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes (signed, 64 bits) of a text's shingles; one for a shorter text, none without words."""
    return _shingles(words(text))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared * LEAST[1] >= LEAST[0] * (len(a) + len(b) - shared)


def _majority(hashes: np.ndarray) -> int:
    """64 bits, each 1 if over half of the hashes have it; signed."""
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 14):
        part = hashes[start : start + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def signature(text: str | None) -> dict:
    """h, the 128 bits that stand for a text's words; n, its shingles; near, their SimHash; and their sketch."""
    found = words(text)
    tokens = _shingles(found)
    again = tokens.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)  # a second hash of each shingle
    again ^= again >> np.uint64(32)
    odd = np.bincount(tokens.view(np.uint64) >> np.uint64(56), minlength=256) & 1
    parity = np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").tolist()
    return {
        "h": xxhash.xxh3_128_digest(b" ".join(found)),
        "n": len(tokens),
        "near": dict(zip(_BITS, [_majority(tokens), _majority(again * np.uint64(0xD6E8FEB86659FD93)), *parity])),
        "sketch": tokens[:SKETCH],
    }


def mark_of(text: Column) -> Column:
    """The 128 bits by which a whole text is fetched."""
    return F.unhex(F.md5(text.cast("binary")))


def sign(text: Column) -> Column:
    """``signature`` of each whole text."""

    @F.arrow_udf(SIGNATURE)
    def of(column: pa.Array) -> pa.Array:
        return pa.array([signature(value) for part in pieces(column) for value in part], _kind)

    return of(text)


def _may_be_alike(most_apart: int | None) -> Column:
    """By the sizes of x and y, the parity of their shingles, and, if ``most_apart`` is given, their SimHash.

    At a similarity of 0.8 the sets differ by a ninth of their sizes' sum at most, and so do their parities. That loses nothing;
    a bound on the differing bits of the SimHash does: pairs at 0.8 differ by 19 of 128 on average, one in 50 million by over 44.
    """
    part, whole = LEAST

    def apart(names: list[str]) -> Column:
        return sum((F.bit_count(F.col(f"x.near.{b}").bitwiseXOR(F.col(f"y.near.{b}"))) for b in names[1:]), F.bit_count(F.col(f"x.near.{names[0]}").bitwiseXOR(F.col(f"y.near.{names[0]}"))))

    both = F.col("x.n") + F.col("y.n")
    sizes = whole * F.least("x.n", "y.n") >= part * F.greatest("x.n", "y.n")
    few_differ = (part + whole) * apart(_BITS[2:]) <= (whole - part) * both
    if most_apart is None:
        return sizes & few_differ
    return sizes & few_differ & ((F.least("x.n", "y.n") < LEAST_FILTERED) | (apart(_BITS[:2]) <= most_apart))


def _filter_of(keys: DataFrame) -> bytes:
    """A filter of the column ``key`` with a power of two of bits, at most FILTER_BITS; fuller ones pass more."""
    bits = 1 << 15
    wanted = FILTER_SHARE * keys.count()
    while bits < min(wanted, FILTER_BITS):
        bits *= 2
    value = F.pmod("key", F.lit(bits)) + 1  # Spark's bitmaps count from 1
    maps = (
        keys.select(value.alias("value"))
        .groupBy(F.bitmap_bucket_number("value").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("value")).alias("map"))
    )
    filled = np.zeros(bits // 8, np.uint8)
    for row in maps.toLocalIterator():
        start = (row["bucket"] - 1) * 4096
        filled[start : start + 4096] = np.frombuffer(row["map"], np.uint8)
    return filled.tobytes()


def _verified(pairs: DataFrame, once: DataFrame, texts: DataFrame) -> DataFrame:
    """Of the pairs of x and y (h, bits) the bits (a, b) of those whose texts are alike.

    Each text that has a pair is fetched once, by digests of the whole text; a filter of bounded size keeps the
    others where they are.
    """

    @F.arrow_udf("boolean")
    def are_alike(left: pa.Array, right: pa.Array) -> pa.Array:
        last, found = (None, None), []
        for a, b in zip(left, right):
            a, b = a.as_py(), b.as_py()
            if last[0] != a:
                last = (a, shingles(a))
            found.append(alike(last[1], shingles(b)))
        return pa.array(found, pa.bool_())

    ordered = F.col("x.h") < F.col("y.h")
    low, high = F.when(ordered, F.col("x")).otherwise(F.col("y")), F.when(ordered, F.col("y")).otherwise(F.col("x"))
    sides = pairs.select(low.alias("x"), high.alias("y"))
    sides = cut_small(sides.select(F.col("x.h").alias("p"), F.col("y.h").alias("q"), F.col("x.bits").alias("a"), F.col("y.bits").alias("b")).distinct())
    needed = sides.select(F.col("p").alias("h")).union(sides.select("q")).distinct()
    needed = cut_small(needed.join(once.select("h", "key", "mark"), "h"))
    shipped = texts.sparkSession.sparkContext.broadcast(_filter_of(needed.select("key")))

    @F.arrow_udf("boolean")
    def may_be_needed(keys: pa.Array) -> pa.Array:
        filled = np.frombuffer(shipped.value, np.uint8)
        at = keys.to_numpy(zero_copy_only=False) % (8 * len(filled))
        return pa.array((filled[at >> 3] >> (at & 7) & 1).astype(bool))

    wanted = bounded_batches(texts).select("text", F.xxhash64("text").alias("key")).where(may_be_needed("key"))
    named = wanted.withColumn("mark", mark_of(F.col("text"))).join(needed, ["key", "mark"]).groupBy("h").agg(F.min("text").alias("text"))
    named = cut(named)
    sided = sides.join(named.select(F.col("h").alias("p"), F.col("text").alias("left")), "p").join(
        named.select(F.col("h").alias("q"), F.col("text").alias("right")), "q"
    )
    return cut_small(sided.where(are_alike("left", "right")).select("a", "b").distinct())


def _meetings(once: DataFrame) -> DataFrame:
    """key, many (if over MANY texts meet), and y (h, bits, n, near, weight) of the texts that meet at a key.

    A key is a shingle of the sketch that MANY texts at most have, the first MEETS of a text by hash. A text with
    fewer of these also meets others at pairs of shingles that follow each other in its sketch and that more texts
    have; two alike share such a pair, or a rarer shingle, but for one in a billion. ``weight`` adds up how many texts
    have the shingles of a text's sketch: the most central one of near copies has most. Counts are group sums, and a
    text's own keys are windows of 32 rows.
    """
    posted = once.select("h", F.size("sketch").alias("held"), F.posexplode("sketch").alias("at", "token"))
    counted = cut_small(posted.groupBy("token").agg(F.count("*").alias("texts")).where("texts > 1"))
    met = posted.join(counted, "token").withColumn("many", F.when(F.col("texts") > MANY, 1).otherwise(0))
    of_text = Window.partitionBy("h")
    in_order = of_text.orderBy("at")
    before = F.coalesce(F.sum("many").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    follows = (F.lead("at").over(in_order) == F.col("at") + 1) & (F.lead("many").over(in_order) == 1)
    met = met.withColumns(
        {
            "rank": F.col("at") - before,
            "others": F.col("held") - F.sum("many").over(of_text),
            "following": F.when(F.col("held") == 1, F.col("token")).when(follows, F.lead("token").over(in_order)),
            "weight": F.sum("texts").over(of_text),
        }
    )
    single = F.when((F.col("many") == 0) & (F.col("rank") < MEETS), F.col("token"))
    double = F.when((F.col("many") == 1) & (F.col("others") < MEETS) & F.col("following").isNotNull(), F.xxhash64("token", "following"))
    keyed = cut_small(met.select(F.coalesce(single, double).alias("key"), "h", "weight").where("key is not null"))
    shared = keyed.groupBy("key").agg((F.count("*") > MANY).alias("many"), F.count("*").alias("texts")).where("texts > 1").drop("texts")
    shared = cut_small(shared)
    described = once.select("h", "bits", "n", "near")
    return cut_small(keyed.join(shared, "key").join(described, "h").select("key", "many", F.struct("h", "bits", "n", "near", "weight").alias("y")))


def links(
    signed: DataFrame, texts: DataFrame, known_links: DataFrame, components: Callable[[DataFrame], DataFrame], most_apart: int | None = None
) -> DataFrame:
    """Pairs (a, b) of bits that connect, with ``known_links``, the texts that are alike.

    ``signed`` has key (xxhash64 of the text), mark (``mark_of`` it), bits (a function of its words) and the fields of
    ``signature``. Texts meet at keys of their sketches, and every two texts that meet are compared unless they are connected
    already, so no link is lost; the order of comparisons keeps their number down. First the most central of those who meet is
    compared with the others. Then, where up to MANY meet, all pairs from different components are. Where more meet, each of two
    neighbouring shingles is that common: they are many edited copies of some text, and nearly all of them are connected through
    the most central ones. So there the most central texts of the PIVOTS most central components are compared with all others,
    again and again while that halves the components at such keys; in the end each text outside the largest component of a
    key is compared with all texts of other components. Sizes and parities of shingles (and with ``most_apart`` SimHash
    bits) thin the pairs out; the words of the rest are compared. Equal words are one text.
    """
    may_be = _may_be_alike(most_apart)
    once = cut(signed.groupBy("h").agg(F.any_value(F.struct("key", "mark", "bits", "n", "near", "sketch")).alias("s")).select("h", "s.*"))
    members = _meetings(once)
    pivots = cut_small(members.groupBy("key").agg(F.max_by("y", F.struct("y.weight", "y.h")).alias("x")))  # a table, so that a key of many is split in the join
    found = _verified(members.join(pivots, "key").where((F.col("x.bits") != F.col("y.bits")) & may_be), once, texts)

    def still_apart(among: DataFrame) -> DataFrame:
        """key, y and root of the members of keys at which several components meet."""
        rooted = among.select("key", "many", "y").join(components(known_links.union(found)).withColumnRenamed("node", "bits"), F.col("y.bits") == F.col("bits"), "left")
        rooted = cut(rooted.select("key", "many", "y", F.coalesce("root", "y.bits").alias("root")))
        apart = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
        return cut_small(rooted.join(cut_small(apart), "key"))

    rooted = still_apart(members)
    few, many = rooted.where("not many"), rooted.where("many")
    pairs = few.select("key", F.col("y").alias("x"), F.col("root").alias("of")).join(few, "key").where((F.col("of") < F.col("root")) & may_be).select("x", "y")
    held = many.select("key", "root").distinct().count()
    while True:
        central = many.groupBy("key", "root").agg(F.max_by("y", F.struct("y.weight", "y.h")).alias("x")).withColumnRenamed("root", "of")
        nth = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("x.weight"), "x.h"))
        central = cut_small(central.withColumn("nth", nth).where(F.col("nth") <= PIVOTS))
        crossed = many.join(central, "key").where((F.col("of") != F.col("root")) & may_be).select("x", "y")
        found = found.union(_verified(pairs.union(crossed), once, texts))
        if not held:
            return found
        many, before = still_apart(many), held
        held, pairs = many.select("key", "root").distinct().count(), crossed.limit(0)
        if not held:
            return found
        if 2 * held > before:
            break
    # a pair is compared at the least of the keys that both have, and so once
    keys = cut_small(many.groupBy(F.col("y.h").alias("h")).agg(F.collect_set("key").alias("keys")))
    many = cut_small(many.join(keys, F.col("y.h") == F.col("h")).drop("h"))
    sizes = many.groupBy("key", "root").agg(F.count("*").alias("n"))
    largest = cut_small(sizes.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("largest")))
    outside = many.join(largest, "key").where("root <> largest").select("key", F.col("y").alias("x"), F.col("root").alias("of"), F.col("keys").alias("other_keys"))
    apart = (F.col("of") != F.col("root")) & ((F.col("root") == F.col("largest")) | (F.col("of") < F.col("root")))
    first_key = F.array_min(F.array_intersect("keys", "other_keys")) == F.col("key")
    rest = many.join(largest, "key").join(cut_small(outside), "key").where(apart & may_be & first_key)
    return found.union(_verified(rest.select("x", "y"), once, texts))

"""SimHash near-duplicates: candidates by pigeonring filtering, groups by connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.llm import similar
from proofline.llm.common import bounded_batches, cut, cut_small, fresh, pieces

#: Words of a shingle, and seed of its hash.
SHINGLE, SEED = 3, 42
#: Fingerprints link at this many differing bits or fewer.
MOST_BITS = 2
#: Fingerprints that share two segments are compared in pairs up to this many; larger buckets link by neighbours.
PAIRED = 16

#: Bits of a segment; the 64 bits are a ring of four.
_SEGMENT, _RING = 16, 4
#: Pairs of segments that a chain can begin with: neighbours, or two with one between them.
_STARTS = ((0, 1), (1, 2), (2, 3), (3, 0), (0, 2), (1, 3))


def fingerprint(text: str | None) -> int:
    """The signed 64 bits of a whole text; 0 for null or a text without words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII splits
    if not found:
        return 0
    shingles = [b" ".join(found)] if len(found) < SHINGLE else map(b" ".join, zip(*(found[i:] for i in range(SHINGLE))))
    hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], "<u8")
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 14):
        part = hashes[start : start + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def with_fingerprint(df: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """Add the long ``name``; rows are independent, other columns stay."""

    @F.arrow_udf("long")
    def of(column: pa.Array) -> pa.Array:
        return pa.array([fingerprint(value) for part in pieces(column) for value in part], pa.int64())

    return bounded_batches(df).withColumn(name, of(F.col(text)))


def _segment(bits: Column, i: int) -> Column:
    return F.shiftrightunsigned(bits, _SEGMENT * i).bitwiseAND(F.lit((1 << _SEGMENT) - 1))


def _chain_holds(a: Column, b: Column, start: Column) -> Column:
    """If a chain from one of a key's segments stays within its budgets.

    The budget of a chain of l segments is l * MOST_BITS / 4, rounded down: 0, 1, 1 and 2 differing bits. Two
    fingerprints within MOST_BITS have a segment from which all four chains stay within them.
    """
    differ = [F.bit_count(_segment(a.bitwiseXOR(b), i)) for i in range(_RING)]

    def within(i: int) -> Column:
        total, holds = F.lit(0), F.lit(True)
        for length in range(1, _RING + 1):
            total = total + differ[(i + length - 1) % _RING]
            holds = holds & (total <= length * MOST_BITS // _RING)
        return holds

    found = F.lit(False)
    for k, (first, second) in enumerate(_STARTS):
        chains = within(first) if (first + 1) % _RING == second else within(first) | within(second)
        found = F.when(start == k, chains).otherwise(found)
    return found


def links(fingerprints: DataFrame, bits: str = "bits") -> DataFrame:
    """Pairs (a, b) that connect what links: every two distinct fingerprints within MOST_BITS share a component.

    A chain within its budgets begins with two equal neighbouring segments, or with two equal segments around
    one that differs by one bit. So six keys of two segments each find all candidates; a fingerprint whose keys
    nobody shares is out. Within a key, up to PAIRED fingerprints are compared in pairs: first the chain, then
    the Hamming distance. A larger bucket would make many pairs, so there each fingerprint is joined to its 33
    neighbours at one differing bit of the segments that aren't in the key, and each neighbour links those who
    share it to the least of them: two fingerprints within two bits share such a neighbour, and those who share
    one are within two bits. That is as exact, and grows with the bucket, not with its square. It is the rest of the
    chain as a key: with two segments equal, the other two may differ by two bits in all, and no narrower key of
    whole segments has all such pairs.
    """
    key = F.array(
        *[
            F.struct(F.lit(k).alias("start"), (F.shiftleft(_segment(F.col(bits), i), _SEGMENT) + _segment(F.col(bits), j)).alias("value"))
            for k, (i, j) in enumerate(_STARTS)
        ]
    )
    keyed = fingerprints.select(F.col(bits).alias("bits"), F.explode(key).alias("key")).select("bits", "key.start", "key.value")
    counted = keyed.groupBy("start", "value").agg(F.count("*").alias("n")).where("n > 1")
    members = cut_small(keyed.join(counted, ["start", "value"]))
    few = members.where(F.col("n") <= PAIRED).drop("n")
    pairs = few.withColumnRenamed("bits", "a").join(few.withColumnRenamed("bits", "b"), ["start", "value"])
    pairs = pairs.where(
        (F.col("a") < F.col("b"))
        & _chain_holds(F.col("a"), F.col("b"), F.col("start"))
        & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MOST_BITS)
    ).select("a", "b")

    free = F.lit(None).cast("array<long>")
    for k, (i, j) in enumerate(_STARTS):
        flips = [1 << (_SEGMENT * s + t) for s in range(_RING) if s not in (i, j) for t in range(_SEGMENT)]
        flips = [0, *(f - (1 << 64) if f >> 63 else f for f in flips)]
        free = F.when(F.col("start") == k, F.array(*map(F.lit, flips)).cast("array<long>")).otherwise(free)
    beside = (
        members.where(F.col("n") > PAIRED)
        .select("bits", F.explode(free).alias("flip"))
        .select("bits", F.col("bits").bitwiseXOR(F.col("flip")).alias("beside"))
        .distinct()
    )
    least = beside.groupBy("beside").agg(F.min("bits").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    starred = beside.join(least, "beside").where("bits <> a").select("a", F.col("bits").alias("b"))
    return pairs.union(starred).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b): the least node that it is connected to.

    Alternates two steps until nothing changes: every node points its larger neighbours at the least one, then
    its smaller ones. Each step is a group minimum and a join, written to the shared folder, so neither links
    nor components ever meet in one place, and a chain of n nodes takes about log n rounds.
    """
    now = cut_small(edges.select("a", "b").where("a <> b"))
    state = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        joined = large.join(least, "a")
        small = joined.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        now = cut_small(small.union(least.select("a", F.col("least").alias("b"))).where("a <> b").distinct())
        before, state = state, now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", by_shingles: bool = False) -> DataFrame:
    """doc_id, key, bits (long), fingerprint (16 hex digits), root, component_id and group_size of each row.

    Texts with one fingerprint are one class; only classes are compared. ``component_id`` is the smallest doc_id
    of the component, null only if all of them are null; ``root`` is its least fingerprint as a long and names it,
    ``group_size`` counts its rows and ``key`` is xxhash64 of the text. Null and empty texts have fingerprint zero and link
    like any other. Repeated rows stay. An empty table gives no rows.

    With ``by_shingles`` texts with a Jaccard similarity of 0.8 or more by five words link too, however many bits
    they differ by: no radius of 64 bits that still has selective segments has all of them.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    signed = with_fingerprint(source, "text", "bits").withColumn("key", F.xxhash64("text"))
    if by_shingles:
        signed = signed.withColumns({"s": similar.sign(F.col("text")), "mark": similar.mark_of(F.col("text"))})
    known = cut(signed.drop("text"))
    classes = known.groupBy("bits").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    edges = links(classes.select("bits"))
    if by_shingles:
        edges = cut_small(edges)
        edges = edges.union(similar.links(known.select("key", "mark", "bits", "s.*"), source.select("text"), edges, components)).distinct()
    rooted = (
        classes.join(components(edges).withColumnRenamed("node", "bits"), "bits", "left")
        .withColumn("root", F.coalesce("root", "bits"))
    )
    groups = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("n").alias("group_size"))
    by_class = rooted.join(groups, "root").select("bits", "root", "component_id", "group_size")
    return known.join(by_class, "bits").select(
        "doc_id", "key", "bits", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "root", "component_id", "group_size"
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", by_shingles: bool = False) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row with the smallest doc_id stays.

    Of repeated rows with that doc_id one stays, as of rows that share it with different texts. A component in
    which all ids are null keeps one of them. Other columns stay; an empty table gives no rows. Whole texts move once, to meet
    the list of those that stay.
    """
    key, none, id_, nth = (fresh(docs, name) for name in ("_key", "_none", "_id", "_nth"))
    stays = (
        near_groups(docs, doc_id, text, by_shingles)
        .where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("root")
        .agg(F.min("doc_id").alias("kept"), F.min("key").alias(key), F.count("*").alias("n"))
        .select(F.col("kept").isNull().alias(none), F.coalesce("kept", F.lit(0)).alias(id_), key, "n")
    )
    stays = cut(stays)
    keyed = docs.withColumns({key: F.xxhash64(F.col(text)), none: F.col(doc_id).isNull(), id_: F.coalesce(F.col(doc_id), F.lit(0))})
    kept = keyed.join(stays.drop("n").hint("shuffle_hash"), [none, id_, key], "left_semi")  # texts pass by a hash table of ids
    if stays.where("n > 1").limit(1).count():  # rows that share an id: one of each text is left
        first = F.row_number().over(Window.partitionBy(none, id_, key).orderBy(F.length(text)))
        kept = kept.withColumn(nth, first).where(F.col(nth) == 1).drop(nth)
    return kept.drop(none, id_, key)

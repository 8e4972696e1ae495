"""Merkle manifest of a dataset: one tree for each source, one over the sources, and a proof for every row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.llm.common import cut, cut_small

#: Children of a node.
FANOUT = 16
#: What of a document goes into its leaf, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """A value as a leaf holds it: ``-`` for null, else its UTF-8 bytes after their number and a colon."""
    shown = value.cast("string")
    return F.when(shown.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown))


def leaf(values: Sequence[Column]) -> Column:
    """Lower-case hex SHA-256 of the fields one after the other."""
    return F.sha2(F.concat(*map(field, values)), 256)


def tree_key(source: Column) -> Column:
    """A string that sorts by UTF-8 bytes with null before everything else, the empty source included."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def _hex(packed: Column) -> Column:
    return F.lower(F.hex(packed))


def in_order(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` (tree, ...) with ``idx``, the place from 0 by ``order`` within the tree, and ``n``, the tree's rows.

    The whole table is cut into ranges of (tree, order), written, and places are counted within a range and then over the
    ranges of a tree; so a tree with most of the rows is spread over as many tasks as any other rows. Rows that tie are
    dealt by their place in the input, so that equal rows are spread too.
    """
    ranged = rows.withColumn("nth", F.monotonically_increasing_id()).repartitionByRange("tree", *order, "nth")
    written = cut(ranged.withColumn("part", F.spark_partition_id()))
    held = written.groupBy("tree", "part").agg(F.count("*").alias("held"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select("tree", "part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start"), F.sum("held").over(tree).alias("n"))
    inside = F.row_number().over(Window.partitionBy("tree", "part").orderBy(*order, "nth")) - 1
    return written.withColumn("inside", inside).join(starts, ["tree", "part"]).withColumn("idx", F.col("start") + F.col("inside")).drop("nth", "part", "start", "inside")


def slot_zero(idx: Column, fanout: int) -> Column:
    """Index of the sibling in slot zero: by XOR with the slot's bit for two children, else shifted back by the slot."""
    return idx.bitwiseXOR(idx.bitwiseAND(F.lit(1))) if fanout == 2 else idx - idx % fanout


def meet_siblings(nodes: DataFrame, fanout: int) -> DataFrame:
    """One row for each parent of ``nodes`` (tree, idx, n, hash, ...): tree, idx, n, hash, alone, members.

    Every node is joined to the sibling in slot zero by that one's computed index. The rows of slot zero, which have then met all their siblings, emit the parent: ``members`` are the
    nodes of the run by index and ``hash`` is the digest of their digests, or, in a tree of one node (``alone``), the node's own.
    A run is one key of the join, so nodes move once a level and the parents are made where they met.
    """
    zero = slot_zero(F.col("idx"), fanout)
    heads = nodes.where(F.col("idx") == zero).select("tree", F.col("idx").alias("zero"))
    members = F.array_sort(F.collect_list(F.struct("idx", *[c for c in nodes.columns if c not in ("tree", "idx", "n")])))
    met = heads.join(nodes.withColumn("zero", zero), ["tree", "zero"]).groupBy("tree", "zero").agg(F.max("n").alias("was"), members.alias("members"))
    digest = F.sha2(F.array_join(F.transform("members", lambda m: m["hash"]), ""), 256)
    return met.select(
        "tree",
        (F.col("zero") / fanout).cast("long").alias("idx"),
        F.ceil(F.col("was") / fanout).cast("long").alias("n"),
        F.when(F.col("was") > 1, digest).otherwise(F.col("members")[0]["hash"]).alias("hash"),
        (F.col("was") == 1).alias("alone"),
        "members",
    )


def grow(nodes: DataFrame, fanout: int = FANOUT) -> tuple[list[DataFrame], DataFrame]:
    """The levels of the trees over ``nodes`` (tree, idx, n, hash, ...) from below, and the root of each (tree, hash).

    A level is the table of ``meet_siblings``. Trees of fewer levels hand their root on to the highest. Each level is written,
    so that a lost executor repeats one level at most, and has a ``fanout``-th of the rows of the one below.
    """
    levels, now = [], nodes
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1 or not levels:
        level = (cut if not levels else cut_small)(meet_siblings(now, fanout))
        levels.append(level)
        now, most = level.select("tree", "idx", "n", "hash"), -(-most // fanout)
    return levels, now.select("tree", "hash")


def with_paths(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """The lowest members (tree, member, path, ...) of ``levels``, each with its path to the root.

    A path is an array of steps (left, right) from the leaf up: the digests of the siblings on either side as bytes. ``above`` has
    tree, idx (0) and the path that leads on from each tree's root, and may have other columns, which come down with it. Paths
    go down by joins of parents, which have a ``fanout``-th of the rows of their children.
    """
    passed = [c for c in above.columns if c not in ("tree", "idx", "path")]
    for k, level in reversed(list(enumerate(levels))):
        digests = F.transform("members", lambda m: m["hash"])
        found = level.select("tree", "idx", "alone", "members").join(above, ["tree", "idx"])
        spread = found.select("tree", "alone", "path", *passed, digests.alias("digests"), F.posexplode("members").alias("slot", "member"))
        packed = lambda part: F.unhex(F.array_join(part, ""))
        step = F.struct(
            packed(F.slice("digests", F.lit(1), F.col("slot"))).alias("left"),
            packed(F.slice("digests", F.col("slot") + 2, F.size("digests"))).alias("right"),
        )
        path = F.when(F.col("alone"), F.col("path")).otherwise(F.concat(F.array(step), F.col("path")))
        above = spread.select("tree", F.col("member.idx").alias("idx"), path.alias("path"), *passed, *([] if k else ["member"]))
    return above


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest leads to along its path."""
    return F.aggregate(path, digest, lambda now, step: F.sha2(F.concat(_hex(step["left"]), now, _hex(step["right"])), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings along a path, from the leaf's run up to the root's and left to right in a run."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(_hex(step["left"]), _hex(step["right"]))), ""), 256)


_NO_STEPS = "array<struct<left:binary,right:binary>>"


def prove(leaves: DataFrame, order: Sequence[str], fanout: int = FANOUT) -> DataFrame:
    """Each row of ``leaves`` (tree, hash, and the columns of ``order``) with ``subroot``, ``root`` and ``path``.

    Leaves of a tree stand in the order of ``order``, nulls first, ties by their digests. Every ``fanout`` neighbours, or fewer at
    the end, become a node until one is left, the subroot; the subroots by tree become the root in the same way. A tree of one leaf
    has that as its subroot, and of a single tree the subroot is the root. An empty table gives no rows. Columns of ``leaves`` must
    have none of the names idx, n, nth and part.
    """
    payload = [c for c in leaves.columns if c not in ("tree", "hash")]
    levels, subroots = grow(in_order(leaves, [*order, "hash"]), fanout)
    subroots = cut_small(subroots)
    forest = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "hash")
    top, roots = grow(in_order(forest, ["of"]), fanout)
    found = roots.first()
    root = F.lit(found["hash"] if found else None).cast("string")
    start = roots.select("tree", F.lit(0).cast("long").alias("idx"), F.array().cast(_NO_STEPS).alias("path"))
    of_trees = with_paths(top, start).select(
        F.col("member.of").alias("tree"), F.lit(0).cast("long").alias("idx"), "path", F.col("member.hash").alias("subroot")
    )
    down = with_paths(levels, of_trees)
    return down.select("tree", *[F.col(f"member.`{c}`").alias(c) for c in payload], F.col("member.hash").alias("hash"), "subroot", root.alias("root"), "path")


def audit(docs: DataFrame, tampered: dict[str, Column] | None = None, fields: Sequence[str] = FIELDS, doc_id: str = "doc_id", source: str = "source", fanout: int = FANOUT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row of ``docs``.

    The manifest is made of the rows as they are. ``folded_root`` is what the row leads to along the original siblings after the
    fields in ``tampered`` have been replaced, and ``verified`` says whether that is the root. Nulls have a mark of their own, so
    null and empty texts differ; a null source is a source and comes first; null ids come first in their source; repeated rows
    are leaves of their own. Other columns are not returned. Texts are read once and never moved: leaves are digests.
    """
    own = [F.col(f"`{name}`") for name in fields]
    changed = [(tampered or {}).get(name, F.col(f"`{name}`")) for name in fields]
    same = F.lit(True)
    for before, after in zip(own, changed):
        same = same & before.eqNullSafe(after)
    leaves = docs.select(
        tree_key(F.col(f"`{source}`")).alias("tree"),
        F.col(f"`{doc_id}`").alias("doc_id"),
        leaf(own).alias("hash"),
        (F.when(~same, leaf(changed)) if tampered else F.lit(None).cast("string")).alias("changed"),
    )
    proved = prove(leaves, ["doc_id"], fanout)
    folded = proved.withColumn("folded_root", fold(F.coalesce("changed", "hash"), F.col("path")))
    return folded.select(
        "doc_id", F.col("hash").alias("leaf"), "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; all other letters as they are."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def _level_sql(k: int, rows: str) -> str:
    return f"""
{rows}{k + 1} AS (SELECT tree, idx // {FANOUT} AS idx, (n + {FANOUT - 1}) // {FANOUT} AS n, n = 1 AS alone, list(hash ORDER BY idx) AS run,
  CASE WHEN n > 1 THEN sha256(string_agg(hash, '' ORDER BY idx)) ELSE min(hash) END AS hash FROM {rows}{k} GROUP BY tree, idx // {FANOUT}, n),"""


def oracle(levels: int = 6) -> str:
    """DuckDB SQL for ``op11`` over documents, with so many levels in a source and among the sources."""
    below = range(levels)
    joins = "".join(f" JOIN {r}{k + 1} {r}_{k + 1} ON {r}_{k + 1}.tree = {t} AND {r}_{k + 1}.idx = {i} // {FANOUT ** (k + 1)}" for r, t, i in (("l", "d.tree", "d.idx"), ("t", "''", "s.idx")) for k in below)
    steps = [(r, i, k) for r, i in (("l", "d.idx"), ("t", "s.idx")) for k in below]
    slot = lambda r, i, k: f"{i} // {FANOUT**k} % {FANOUT}"
    before = lambda r, i, k: f"CASE WHEN {r}_{k + 1}.alone THEN '' ELSE array_to_string({r}_{k + 1}.run[:{slot(r, i, k)}], '') END"
    after = lambda r, i, k: f"CASE WHEN {r}_{k + 1}.alone THEN '' ELSE array_to_string({r}_{k + 1}.run[{slot(r, i, k)} + 2:], '') END"
    step_list = ", ".join(f"{{'alone': {r}_{k + 1}.alone, 'a': {before(r, i, k)}, 'b': {after(r, i, k)}}}" for r, i, k in steps)
    shown = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
    head, upper = " || ".join(shown(c) for c in FIELDS[:-1]), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    crc = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(len(CAST(doc_id AS VARCHAR))), lambda i: ascii(substr(CAST(doc_id AS VARCHAR), i + 1, 1))::BIGINT)),
      lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda c, i: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"""
    return f"""
WITH h AS (SELECT coalesce('=' || source, '') AS tree, doc_id, sha256({head} || {shown("text")}) AS hash,
  CASE WHEN {crc} % 5 = 0 THEN sha256({head} || {shown(f"translate(text, '{upper}', '{upper.lower()}')")}) END AS changed FROM documents),
d AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, hash) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM h),
l0 AS (SELECT tree, idx, n, hash FROM d),{"".join(_level_sql(k, "l") for k in below)}
s AS (SELECT tree, hash AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS idx, count(*) OVER () AS n FROM l{levels}),
t0 AS (SELECT '' AS tree, idx, n, subroot AS hash FROM s),{"".join(_level_sql(k, "t") for k in below)}
p AS (SELECT d.doc_id, d.hash AS leaf, coalesce(d.changed, d.hash) AS now, s.subroot, t_{levels}.hash AS root, [{step_list}] AS steps
  FROM d JOIN s ON s.tree = d.tree{joins}),
f AS (SELECT *, list_reduce(list_concat([{{'alone': true, 'a': now, 'b': ''}}], steps),
  lambda x, y: CASE WHEN y.alone THEN x ELSE {{'alone': true, 'a': sha256(y.a || x.a || y.b), 'b': ''}} END).a AS folded_root FROM p)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda x: x.a || x.b), '')) AS proof_sha256, folded_root,
  folded_root = root AS verified FROM f
"""

"""Registered queries of stored documents: texts as trees of JSON pointers, read back as blocks and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.operators import papers
from proofline.sources import trees
from proofline.sources.collections import read_table


def _document_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as the JSON of a tree whose texts are its lines, three to a group, the groups from the last to the first.

    A group holds its first two lines, the second holds the third. Every tenth document has a pointer to nothing, every tenth a cycle.
    """
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), lines.alias("lines")).withColumn("n", F.size("lines"))
    pointer = lambda kind, i: F.struct(F.concat(F.lit(f"#/{kind}/"), i.cast("string")).alias("$ref"))
    label = lambda i: F.element_at(F.array(*map(F.lit, ("section_header", "text", "list_item", "formula", "page_footer"))), (i % 5 + 1).cast("int"))
    cycle = F.col("paper_id") % 10 == 7

    def text(line, i):
        below = F.when((i % 3 == 1) & (i + 1 < F.col("n")), F.array(pointer("texts", i + 1))).when(cycle & (i == F.col("n") - 1), F.array(pointer("groups", F.lit(0))))
        box = F.struct(F.lit(1.0).alias("l"), (i % 10 * 5.0 + 4).alias("t"), F.lit(9.0).alias("r"), (i % 10 * 5.0).alias("b"), F.when(i % 2 == 0, "TOPLEFT").otherwise("BOTTOMLEFT").alias("coord_origin"))
        prov = F.array(F.struct((F.floor(i / 10) + 1).cast("int").alias("page_no"), box.alias("bbox")))
        return F.struct(label(i).alias("label"), F.when(i % 5 == 4, "furniture").otherwise("body").alias("content_layer"), line.alias("text"), below.alias("children"), prov.alias("prov"))

    count = F.ceil(F.col("n") / 3).cast("int")
    group = lambda g: F.struct(F.filter(F.array(pointer("texts", g * 3), F.when(g * 3 + 1 < F.col("n"), pointer("texts", g * 3 + 1))), lambda c: c.isNotNull()).alias("children"))
    groups = F.transform(F.sequence(F.lit(0), count - 1), group)
    top = F.transform(F.sequence(count - 1, F.lit(0), F.lit(-1)), lambda g: pointer("groups", g))
    lost = F.when(F.col("paper_id") % 10 == 3, F.array(pointer("texts", F.col("n")))).otherwise(F.array().cast("array<struct<`$ref`:string>>"))
    page = F.struct(F.struct(F.lit(60.0).alias("width"), F.lit(100.0).alias("height")).alias("size"))
    tree = F.struct(F.struct(F.concat(top, lost).alias("children")).alias("body"), F.create_map(F.lit("1"), page).alias("pages"), groups.alias("groups"), F.transform("lines", text).alias("texts"))
    return docs.select("paper_id", F.to_json(tree).alias("json"))


def tree_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of the documents' trees; a tree that is refused is one row with the reason as its type."""
    blocks, refused = trees.tree_blocks(trees.parse_trees(_document_trees(spark, sf_dir), "json"))
    told = blocks.select(
        F.col("paper_id").alias("doc_id"), "ord", "type", F.md5("text").alias("text_md5"), "page", F.col("bbox")[1].alias("top"), F.col("bbox")[3].alias("bottom"), "level", "formula_text_source"
    )
    none = {name: F.lit(None) for name in ("ord", "text_md5", "page", "top", "bottom", "level", "formula_text_source")}
    return told.unionByName(refused.select(F.col("paper_id").alias("doc_id"), F.col("reason").alias("type")).withColumns(none))


TREE_BLOCKS = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM d WHERE doc_id % 10 NOT IN (3, 7)),
b AS (SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) AS text, CAST(i // 10 + 1 AS INT) AS page, i % 10 * 5.0::DOUBLE AS edge FROM l WHERE i % 5 <> 4)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i // 3 DESC, i) - 1 AS INT) AS ord, ['heading', 'paragraph', 'list_item', 'formula'][i % 5 + 1] AS type, md5(text) AS text_md5, page,
       CASE WHEN i % 2 = 1 THEN edge + 4 WHEN page = 1 THEN 96 - edge END AS top, CASE WHEN i % 2 = 1 THEN edge WHEN page = 1 THEN 100 - edge END AS bottom,
       CASE WHEN i % 5 = 0 THEN CASE WHEN i % 3 = 2 THEN 3 ELSE 2 END END AS level, CASE WHEN i % 5 = 3 THEN CASE WHEN text = '' THEN 'missing' ELSE 'text' END END AS formula_text_source FROM b
UNION ALL SELECT doc_id, NULL, CASE WHEN doc_id % 10 = 3 THEN 'dangling' ELSE 'repeated' END, NULL, NULL, NULL, NULL, NULL, NULL FROM d WHERE doc_id % 10 IN (3, 7)"""


def tree_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' trees from JSON to chunks: sections, captions, contexts and parts."""
    blocks, _ = trees.tree_blocks(trees.parse_trees(_document_trees(spark, sf_dir), "json"))
    about = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), F.col("source").alias("filename"), F.lit("").alias("title"), F.array().cast("array<string>").alias("authors"))
    return papers.chunks_of_blocks(blocks, about)


QUERIES = {
    "tree_blocks": (tree_blocks, TREE_BLOCKS),
    "tree_chunks": (tree_chunks, None),
}

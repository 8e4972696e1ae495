"""Readers and writers of chunk collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: An upload: one file with its chunks. Document metadata wins over a chunk's on the same key.
UPLOAD = (
    "filename string, data struct<chunks:array<struct<chunk_id:string,text:string,retrieval_text:string,metadata:map<string,string>>>,"
    "metadata:map<string,string>>"
)
CHUNKS = "chunk_text string, filename string, file_id string, metadata map<string,string>"


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all upload files under ``path`` (JSON, one payload a file)."""
    return upload_rows(spark.read.schema(UPLOAD).option("multiLine", True).option("recursiveFileLookup", True).json(path))


def upload_rows(payloads: DataFrame) -> DataFrame:
    """A row for each chunk with text: the retrieval text, else the text; blank chunks are left out."""
    rows = payloads.select("filename", F.col("data.metadata").alias("document"), F.explode("data.chunks").alias("chunk"))
    text = F.coalesce(F.nullif(F.trim("chunk.retrieval_text"), F.lit("")), F.col("chunk.text"))
    empty = F.create_map().cast("map<string,string>")
    own = F.map_concat(F.coalesce("chunk.metadata", empty), F.create_map(F.lit("chunk_id"), F.col("chunk.chunk_id")))
    document = F.coalesce("document", empty)
    merged = F.map_concat(F.map_filter(own, lambda k, _: ~F.map_contains_key(document, k)), document)
    return rows.select(text.alias("chunk_text"), "filename", document["file_id"].alias("file_id"), merged.alias("metadata")).where("trim(chunk_text) <> ''")


def read_collection(spark: SparkSession, path: str, collection: str) -> DataFrame:
    """One collection of a store that is partitioned by collection_id; the others' files aren't read."""
    return spark.read.parquet(path).where(F.col("collection_id") == collection)


def append(rows: DataFrame, path: str, collection: str) -> None:
    """Add rows to a collection of the store."""
    rows.withColumn("collection_id", F.lit(collection)).write.mode("append").partitionBy("collection_id").parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_results_csv(spark: SparkSession, path: str) -> DataFrame:
    """A table of results with a header."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def check_embeddings(rows: DataFrame, item: str, index: str, vector: str) -> DataFrame:
    """Why a batch of embeddings is refused, one row for each reason; none if it is right.

    Indexes must be a permutation of 0..n-1, values finite, and widths equal.
    """
    facts = rows.agg(
        F.count("*").alias("n"), F.countDistinct(index).alias("indexes"), F.min(index).alias("low"), F.max(index).alias("high"),
        F.countDistinct(F.size(vector)).alias("widths"),
        F.coalesce(F.max(F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))).cast("int")), F.lit(0)).alias("bad"),
    )
    order = (F.col("n") > 0) & ((F.col("indexes") != F.col("n")) | (F.col("low") != 0) | (F.col("high") != F.col("n") - 1))
    reasons = F.array_compact(F.array(F.when(order, "indexes"), F.when(F.col("bad") == 1, "not finite"), F.when(F.col("widths") > 1, "widths")))
    return facts.select(F.explode(reasons).alias("reason"))


#: A stored paper: its metadata, sections, blocks in order and the report of its parsing. What varies by block stays JSON text.
PAPER = (
    "schema_version string, paper_id string, file_id string, filename string,"
    "metadata struct<title:string,authors:array<string>,abstract:string,year:int,doi:string,arxiv_id:string,language:string>,"
    "sections array<struct<section_id:string,title:string,level:int,parent_id:string,page:int,kind:string>>,"
    "blocks array<struct<block_id:string,`order`:int,type:string,text:string,page:int,bbox:array<double>,section_path:array<string>,"
    "confidence:double,source_label:string,relations:string,table_structure:string>>,"
    "quality struct<total_pages:int,parsed_pages:int,total_blocks:int,block_counts:map<string,int>,provenance_coverage:double,"
    "empty_page_numbers:array<int>,empty_block_count:int,warnings:array<string>>"
)


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    """All papers that are stored as document.json anywhere under ``path``, as typed rows with the file they are from.

    Missing fields are null. A file that is no JSON object fails the read, as a paper left out would go unseen.
    """
    reader = spark.read.schema(PAPER).option("multiLine", True).option("mode", "FAILFAST").option("recursiveFileLookup", True).option("pathGlobFilter", "document.json")
    return reader.json(path).withColumn("path", F.input_file_name())


def paper_blocks(papers: DataFrame) -> DataFrame:
    """A row for each block of the papers: paper_id, file_id, filename and the block's fields, its order as ``ord``."""
    blocks = papers.select("paper_id", "file_id", "filename", F.explode("blocks").alias("b"))
    return blocks.select("paper_id", "file_id", "filename", "b.*").withColumnRenamed("order", "ord")


def parse_quality(blocks: DataFrame, total_pages: DataFrame) -> DataFrame:
    """A row for each paper of its blocks (paper_id, type, text, page, bbox) and pages (paper_id, total_pages).

    total_blocks, block_counts (by type), parsed_pages (with a block with text), provenance_coverage (blocks of a known type
    that have page and box; 0 of none), empty_block_count and empty_page_numbers. A paper without blocks has zeros and all its
    pages empty.
    """
    has_text, known = F.coalesce(F.trim("text") != "", F.lit(False)), F.col("type") != "unknown"
    found = blocks.groupBy("paper_id").agg(
        F.count("*").alias("total_blocks"), F.countDistinct(F.when(has_text, F.col("page"))).alias("parsed_pages"),
        F.avg(F.when(known, (F.col("page").isNotNull() & F.col("bbox").isNotNull()).cast("double"))).alias("provenance_coverage"),
        F.count_if(~has_text).alias("empty_block_count"), F.collect_set(F.when(has_text, F.col("page"))).alias("_pages"),
    )
    each = blocks.groupBy("paper_id", "type").agg(F.count("*").alias("n"))
    counts = each.groupBy("paper_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("block_counts"))
    zero = {"total_blocks": 0, "parsed_pages": 0, "provenance_coverage": 0.0, "empty_block_count": 0}
    joined = total_pages.join(found, "paper_id", "left").join(counts, "paper_id", "left").fillna(zero)
    all_pages = F.when(F.col("total_pages") > 0, F.sequence(F.lit(1), F.col("total_pages"))).otherwise(F.array().cast("array<int>"))
    empty = F.array_except(all_pages, F.coalesce("_pages", F.array().cast("array<int>")))
    return joined.withColumn("empty_page_numbers", empty).drop("_pages")

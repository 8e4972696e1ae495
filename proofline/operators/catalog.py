"""Collections: catalog, statistics, scope predicates, and changes that check themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def document_catalog(chunks: DataFrame, filename: str, chunk_id: str, created: str) -> DataFrame:
    """A row for each file: chunks, first chunk id, latest creation; newest first, then by name."""
    return chunks.groupBy(F.col(filename).alias("filename")).agg(
        F.count("*").alias("chunks"), F.min(chunk_id).alias("first_chunk"), F.max(created).alias("created")
    ).orderBy(F.desc("created"), "filename")


def collection_stats(chunks: DataFrame, filename: str, created: str) -> DataFrame:
    """Rows, distinct files and latest creation of a whole collection; exact at any size."""
    return chunks.agg(F.count("*").alias("n_rows"), F.countDistinct(filename).alias("files"), F.max(created).alias("latest"))


def all_stats(chunks: DataFrame, collection: str, filename: str) -> DataFrame:
    """Rows and files of each collection, and of all of them in the row with is_total."""
    return chunks.rollup(collection).agg(
        F.count("*").alias("n_rows"), F.countDistinct(filename).alias("files"), F.grouping(collection).cast("int").alias("is_total")
    )


def knowledge_bases(chunks: DataFrame, names: DataFrame, collection: str) -> DataFrame:
    """Each collection with its display name, or its id where it has none."""
    found = chunks.select(F.col(collection).alias("collection")).distinct()
    return found.join(names, "collection", "left").select("collection", F.coalesce("display_name", "collection").alias("display_name"))


def in_scope(ids: list[str], names: list[str], file_id: Column, filename: Column) -> Column:
    """If a row's file id is among ``ids`` or its name among ``names``; a row without an id goes by name."""
    return F.coalesce(file_id.isin(ids), F.lit(False)) | F.coalesce(filename.isin(names), F.lit(False))


def already_present(incoming: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows of which any key is stored already; an ingest may go on only if there are none."""
    found = None
    for key in keys:
        hits = incoming.join(stored.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_semi")
        found = hits if found is None else found.unionByName(hits)
    return found.distinct()


def only_new(incoming: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Incoming rows whose key isn't stored; a null key is new."""
    return incoming.join(stored.select(key).distinct(), key, "left_anti")


def without(stored: DataFrame, gone: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(what is left, one row with the number of removed rows)."""
    keys = gone.select(key).distinct()
    return stored.join(keys, key, "left_anti"), stored.join(keys, key, "left_semi").agg(F.count("*").alias("removed"))


def dangling(references: DataFrame, known: DataFrame, reference: str, key: str) -> DataFrame:
    """Rows of ``references`` whose non-null reference names nothing known."""
    return references.where(F.col(reference).isNotNull()).join(known.select(F.col(key).alias(reference)).distinct(), reference, "left_anti")


def top_per_group(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group as ``position`` from 1."""
    from pyspark.sql import Window

    return rows.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("position") <= k)


def filenames(chunks: DataFrame, filename: str) -> DataFrame:
    """The distinct names of files, in order; null and blank ones are left out."""
    return chunks.where(F.trim(F.col(filename)) != "").select(F.col(filename).alias("filename")).distinct().orderBy("filename")


def chunks_of(chunks: DataFrame, filename: str, name: str, k: int = 10) -> DataFrame:
    """Up to ``k`` rows of one file."""
    return chunks.where(F.col(filename) == name).limit(k)


def searched(catalog: DataFrame, text: str, *columns: str) -> DataFrame:
    """Rows of which some column has the text in it, whatever its case; all for a blank text."""
    asked = text.strip().lower()
    found = F.lit(not asked)
    for column in columns:
        found = found | F.coalesce(F.contains(F.lower(column), F.lit(asked)), F.lit(False))
    return catalog.where(found)


def upsert_names(names: DataFrame, changes: DataFrame) -> DataFrame:
    """Display names (collection, display_name) after changes of them; of several for one collection the last by name."""
    new = changes.groupBy("collection").agg(F.max("display_name").alias("display_name"))
    return names.join(new.select("collection"), "collection", "left_anti").unionByName(new)


def drop_collection(chunks: DataFrame, names: DataFrame, collection: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(chunks, display names) without one collection."""
    return chunks.where(~F.col(collection).eqNullSafe(F.lit(name))), names.where(~F.col("collection").eqNullSafe(F.lit(name)))


def totals(chunks: DataFrame, collection: str, filename: str) -> DataFrame:
    """One row: collections, files and chunks of the whole store; a file in two collections counts in both."""
    return chunks.groupBy(collection).agg(F.countDistinct(filename).alias("f"), F.count("*").alias("n")).agg(
        F.count("*").alias("collections"), F.coalesce(F.sum("f"), F.lit(0)).alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunks")
    )


def recent(rows: DataFrame, by: str, key: str, k: int = 50) -> DataFrame:
    """The ``k`` latest rows; equal times go by key."""
    return rows.orderBy(F.desc(by), key).limit(k)

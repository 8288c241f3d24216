"""The sentence collection: a Parquet table partitioned by business."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from disputatio.operators.ranking import top_k

# Fixed value: address of a source.
SOURCE_URL = "https://www.parlament.ch/de/ratsbetrieb/suche-curia-vista/geschaeft?AffairId="

COLLECTION_SCHEMA = (
    "id string, document string, "
    "metadata struct<business_id string, filename string, original_sentence string, context string, url string>, "
    "embedding array<float>, business_id string"
)


def source_url(business_id: Column, prefix: str = SOURCE_URL) -> Column:
    return F.concat(F.lit(prefix), business_id)


def as_entries(prepared: DataFrame, business_id: str, filename: str, number: Column, url_prefix: str = SOURCE_URL) -> DataFrame:
    """Collection entries of prepared sentences: ``id, document, metadata, business_id``.

    ``number`` numbers a business's sentences; the id is ``{business}-{number}``.
    """
    metadata = F.struct(
        F.col(business_id).alias("business_id"),
        F.col(filename).alias("filename"),
        F.col("original_sentence"),
        F.col("context"),
        source_url(F.col(business_id), url_prefix).alias("url"),
    )
    return prepared.select(
        F.concat_ws("-", F.col(business_id), number).alias("id"),
        F.col("new_sentence").alias("document"),
        metadata.alias("metadata"),
        F.col(business_id).alias("business_id"),
    )


def new_entries(existing: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """Incoming rows whose id is not there yet. Only ids of the existing side are read."""
    return incoming.join(existing.select(key), key, "left_anti")


def upsert(existing: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """Existing rows unchanged, plus the new ones."""
    return existing.unionByName(new_entries(existing, incoming, key))


def get_or_create(spark: SparkSession, table: str, schema: str = COLLECTION_SCHEMA, path: str | None = None) -> DataFrame:
    """The named collection table, created empty if it does not exist."""
    if not spark.catalog.tableExists(table):
        location = f" LOCATION '{path}'" if path else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({schema}) USING parquet PARTITIONED BY (business_id){location}")
    return spark.table(table)


def add_to_collection(spark: SparkSession, table: str, entries: DataFrame) -> None:
    """Append the entries whose ids are new; entries with a known id are left as they are.

    A batch may hold an id twice: the first by document text is taken, found with partial minima.
    """
    existing = get_or_create(spark, table)
    columns = existing.columns
    if "embedding" not in entries.columns:
        entries = entries.withColumn("embedding", F.lit(None).cast("array<float>"))
    rest = [c for c in ("document", "metadata", "embedding", "business_id")]
    once = entries.groupBy("id").agg(F.min(F.struct(*rest)).alias("r")).select("id", "r.*")
    new_entries(existing, once).select(*columns).write.insertInto(table)


def scan_collection(entries: DataFrame, columns: list[str], limit: int | None = None, offset: int = 0, key: str = "id") -> DataFrame:
    """Chosen columns of the whole collection; with a limit or an offset, that part of it in id order."""
    chosen = entries.select(key, *columns)
    if limit is None and not offset:
        return chosen
    if limit is None:
        return chosen.orderBy(key).offset(offset)
    return top_k(chosen, [F.col(key)], offset + limit).orderBy(key).offset(offset)

"""Text corpora and business records."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from disputatio.functions.text import strip_html


def scan_text_corpus(spark: SparkSession, root: str, pattern: str = "*.txt") -> DataFrame:
    """One row per file below ``root/<business_id>/``: ``business_id, filename, html``.

    Each file is one document. The business id is the name of the file's directory.
    """
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return files.select(
        F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("business_id"),
        F.regexp_extract(path, r"([^/]+)$", 1).alias("filename"),
        F.col("value").alias("html"),
    )


def resolve_text(spark: SparkSession, text: str, separator: str = "\n") -> DataFrame:
    """A path to a text file is read and stripped of markup; any other string is the text itself.

    An existing file of another kind is an error.
    """
    if "\n" not in text and _exists(spark, text):
        if not text.endswith("txt"):
            raise ValueError("only text files can be read")
        return spark.read.text(text, wholetext=True).select(strip_html(F.col("value"), separator).alias("text"))
    return spark.createDataFrame([(text,)], "text string")


def _exists(spark: SparkSession, path: str) -> bool:
    if os.path.exists(path):
        return True
    if not re.match(r"[a-z][a-z0-9+.-]*://\S+$", path):
        return False
    probe = spark.read.format("binaryFile").option("ignoreMissingFiles", "true")
    try:
        return not probe.load(path).select("path").isEmpty()
    except Exception as error:  # Spark reports a missing path with its own error class
        if "PATH_NOT_FOUND" in str(error):
            return False
        raise


def read_business_records(spark: SparkSession, path: str, schema: str, ids: list[int] | None = None, fmt: str = "json") -> DataFrame:
    """Landed business records, all languages; ``ids`` is pushed down to the files where the format allows it."""
    rows = spark.read.schema(schema).format(fmt).load(path)
    return rows if ids is None else rows.where(F.col("ID").isin(ids))

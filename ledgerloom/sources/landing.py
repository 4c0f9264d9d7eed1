"""Files as they land: contents, hashes, sentinels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import escapes_root

# Suffixes of sentinels and of files that are still being written.
IGNORED = (".done", ".tmp", ".part", ".filepart", ".crdownload", ".swp")
SENTINEL = ".done"


def landed(spark: SparkSession, path: str, ignored: Sequence[str] = IGNORED) -> DataFrame:
    """(arrival_id, name, size, modified, sha256, has_sentinel, content) of the files of a folder, not of its subfolders.

    Dot files and files with an ignored suffix are left out. The hash is taken in the scan.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path)
    named = found.withColumn("name", F.element_at(F.split("path", "/"), -1))
    keep = ~F.col("name").startswith(".") & ~F.col("name").rlike("(?:" + "|".join(s.replace(".", r"\.") for s in ignored) + ")$")
    marks = named.where(F.col("name").endswith(SENTINEL)).select(F.regexp_replace("name", r"\.done$", "").alias("name"), F.lit(True).alias("_mark"))
    files = named.where(keep).join(marks.distinct(), "name", "left")
    digest = F.sha2("content", 256)
    return files.select(
        F.concat(F.lit("arr-"), F.left(digest, F.lit(16)), F.lit("-"), F.left(F.sha2("path", 256), F.lit(8))).alias("arrival_id"), "name",
        F.col("length").alias("size"), F.col("modificationTime").alias("modified"), digest.alias("sha256"),
        F.coalesce("_mark", F.lit(False)).alias("has_sentinel"), "content",
    )


def safe_paths(df: DataFrame, path: str) -> DataFrame:
    """Rows whose path stays below its root."""
    return df.where(~escapes_root(F.col(path)))


def file_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A topic as a folder of JSON files, from the earliest on; unknown fields are ignored."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).json(path)

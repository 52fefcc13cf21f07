"""Inbox of files: listing, validity, content hash, first arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# What is taken in.
EXTENSIONS = ["pdf", "jpg", "jpeg", "png", "tif", "tiff"]


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """Files of the known kinds, without temporary ones and images that lie beside their PDF."""
    f = spark.read.format("binaryFile").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    f = f.withColumns({"name": name, "ext": F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)), "stem": F.regexp_replace(name, r"\.[^.]+$", "")})
    f = f.where(F.col("ext").isin(EXTENSIONS) & ~F.col("name").startswith("temp_"))
    pdfs = f.where(F.col("ext") == "pdf").select(F.col("stem").alias("pdf_stem")).distinct()
    return f.join(pdfs, (F.col("stem") == F.col("pdf_stem")) & (F.col("ext") != "pdf"), "left_anti")


def hashed(files: DataFrame) -> DataFrame:
    valid = (F.col("length") > 0) & ((F.col("ext") != "pdf") | (F.substring("content", 1, 4) == F.lit(b"%PDF")))
    return files.withColumns({"file_hash": F.sha2("content", 256), "valid": valid}).drop("content")


def first_arrivals(rows: DataFrame, known: DataFrame | None = None, key: str = "file_hash", order: str = "name") -> DataFrame:
    """``rows`` with ``duplicate``: whether an earlier row, or one of ``known``, has its key."""
    w = Window.partitionBy(key).orderBy(F.lower(F.col(order).cast("string")), order)
    rows = rows.withColumn("duplicate", F.row_number().over(w) > 1)
    if known is None:
        return rows
    seen = known.select(F.col(key).alias("__seen")).distinct()
    return rows.join(seen, rows[key] == seen["__seen"], "left").withColumn("duplicate", F.col("duplicate") | F.col("__seen").isNotNull()).drop("__seen")

"""Incremental intake: each micro-batch of the inbox goes through the batch path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from drayage.sources import inbox

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def ingest(spark: SparkSession, folder: str, target: str, checkpoint: str):
    """Appends files whose content is not in ``target`` yet; runs what is there and ends.

    Duplicates are found against the target table, so no state grows with the stream.
    """
    stream = spark.readStream.format("binaryFile").schema(SCHEMA).load(folder)

    def step(batch: DataFrame, _: int) -> None:
        from pyspark.sql import functions as F

        s = batch.sparkSession
        name = F.element_at(F.split("path", "/"), -1)
        rows = inbox.hashed(batch.withColumns({"name": name, "ext": F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))}))
        try:
            known = s.read.parquet(target)
        except Exception as e:  # nothing taken in yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = None
        new = inbox.first_arrivals(rows.where("valid"), known).where("NOT duplicate").drop("duplicate")
        new.write.mode("append").parquet(target)

    q = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q

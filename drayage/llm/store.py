"""What operators share: lineage cuts, held-out folds, column checks."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so a lost executor loses none of it.

    Spark removes the files once nothing refers to them, where the session has
    its cleaner on.
    """
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


def folder(spark: SparkSession) -> str:
    """The shared checkpoint folder: the one set on the context, else the session's spark.checkpoint.dir.

    Where neither is set, a temporary one is made for a master on one machine;
    on a cluster that is an error, as executors don't share such a folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = sc.getConf().get("spark.checkpoint.dir")
        if path is None:
            if not sc.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir is not set: a folder that all executors share is needed")
            path = tempfile.mkdtemp(prefix="drayage-")
        sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def spare(columns: list[str], *names: str) -> list[str]:
    """``names``, made longer where ``columns`` has them already in any case: for columns of an operator's own."""
    held, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in held:
            n += "_"
        held.add(n.lower())
        out.append(n)
    return out


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % k


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

"""The corpus pipeline: stages over ``documents``, each kept as Parquet for the next.

Every stage works on all that the one before kept. Stages but the last return
the columns of documents; the last returns where each piece of a text is packed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drayage.llm import jaccard, langid, packing, pii, substring
from drayage.llm.store import cut, folder

#: Least posterior of its language with which a document stays.
SURE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: a null text, one without a letter, or one whose best language has a posterior under ``SURE``.

    Where no document has a language to learn from, all stay.
    """
    train = docs.where(~langid.held_out(docs)).select("doc_id", "text", "lang")
    if train.where("lang IS NOT NULL AND text IS NOT NULL").isEmpty():
        return docs
    pred, score = "lang_pred", "score"
    own = [c for c in docs.columns if c.lower() in (pred, score)]
    if own:  # columns that identify would replace
        docs = docs.withColumnsRenamed({c: f"__{c}" for c in own})
    out = langid.identify(docs, train).where(f"lang_pred <> 'und' AND score >= {SURE}").drop(pred, score)
    return out.withColumnsRenamed({f"__{c}": c for c in own})


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each component of five-word shingle sets that are 80 % alike.

    Rows that repeat a doc_id are one document: one of them stays. Rows without a
    doc_id link with nothing and stay.
    """
    drop = cut(jaccard.join(docs).where("component_id <> doc_id").select("doc_id").distinct())
    kept = docs.join(jaccard.small(drop, drop.count()), "doc_id", "left_anti").select(*docs.columns)
    again = cut(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if again.isEmpty():
        return kept
    many = kept.join(jaccard.small(again, again.count()), "doc_id", "left_semi").select(*docs.columns)
    others = kept.join(jaccard.small(again, again.count()), "doc_id", "left_anti").select(*docs.columns)
    one = many.groupBy("doc_id").agg(F.min(F.struct(*[c for c in docs.columns if c != "doc_id"])).alias("__one"))
    return others.unionByName(one.select("doc_id", "__one.*"))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages that a document of smaller id holds."""
    return substring.deduplicate(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts personal data, and terms that disclose it, in general terms."""
    return pii.sanitise(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4,096 tokens: one row for each piece of a document."""
    return packing.packed(docs)


STAGES = [("language_id", language), ("jaccard_join", near_duplicates), ("substring_dedup", substrings), ("pii", personal_data), ("packing", pack)]

#: SQL states neither content-defined chunks nor the tokenizer; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared checkpoint folder and read again.

    What a stage read is removed once the stage after it is written; the last
    one's table stays for whoever reads the result.
    """
    top = f"{folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = f"{top}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            old = spark._jvm.org.apache.hadoop.fs.Path(before)
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        before = path
    return docs

"""What becomes of a second reading of a bill's doubtful fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drayage.functions import shapes as S
from drayage.functions.exprs import collapse, is_missing, letters_only_stub

# Reasons to ask again.
MISSING, LOW, STUB, AMBIGUOUS, JOINT, CONFLICT, INCONSISTENT = "missing_field", "low_confidence", "weak_ocr_stub", "candidate_ambiguity", "joint_decode_uncertain", "consistency_conflict", "inconsistent_with_ticket"
WEAK = [LOW, MISSING, STUB, INCONSISTENT]
DOUBT = [AMBIGUOUS, CONFLICT, INCONSISTENT]


def action(previous: Column, answer: Column, reasons: Column, strong: Column, usable: Column) -> Column:
    """accept, keep, or keep_disagreement: a strong value is not overwritten unless it is inconsistent."""
    has = lambda rs: F.arrays_overlap(reasons, F.array(*map(F.lit, rs)))
    empty = is_missing(previous, "rescue")
    agreed = collapse(previous) == collapse(answer)
    weak = has(WEAK) | letters_only_stub(previous)
    return (
        F.when(~usable, "keep").when(empty, "accept").when(agreed & (collapse(answer) != ""), "keep")
        .when(~strong & (weak | has(DOUBT)), "accept").when(strong & has([INCONSISTENT]), "accept").otherwise("keep_disagreement")
    )


def merge(plan: DataFrame) -> DataFrame:
    """``plan`` (doc_id, field, previous, answer, reasons, strong) with ``action`` and the merged ``value``."""
    usable = ~is_missing(F.col("answer"), "rescue") & ~S.is_header(F.col("answer")) & ~S.is_junk(F.col("answer"))
    reasons, strong = F.coalesce("reasons", F.array().cast("array<string>")), F.coalesce("strong", F.lit(False))
    out = plan.withColumn("action", action(F.col("previous"), F.col("answer"), reasons, strong, usable))
    return out.withColumn("value", F.when(F.col("action") == "accept", F.col("answer")).otherwise(F.col("previous")))


def select(plan: DataFrame, most: int = 8) -> DataFrame:
    """(doc_id, field, reasons, priority, rank): the fields to ask again, the most pressing first; ``plan`` (doc_id, field, ord, reasons).

    Low confidence, a stub and a value that doesn't fit its ticket weigh once.
    """
    has = lambda *rs: F.arrays_overlap("reasons", F.array(*map(F.lit, rs)))
    weight = lambda ok, n: F.when(ok, n).otherwise(0)
    p = weight(has(MISSING), 8) + weight(has(LOW, STUB, INCONSISTENT), 4) + weight(has(AMBIGUOUS), 2) + weight(has(CONFLICT), 2) + weight(has(JOINT), 1)
    w = Window.partitionBy("doc_id").orderBy(F.desc("priority"), "ord")
    out = plan.where(F.size("reasons") > 0).withColumn("reasons", F.array_distinct("reasons")).withColumn("priority", p)
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("doc_id", "field", "reasons", "priority", "rank")


def ambiguous(candidates: DataFrame, gap: float = 0.08, least: float = 0.70) -> DataFrame:
    """(doc_id, field, gap) of the fields whose two best ``candidates`` (doc_id, field, rank, score) lie close together."""
    w = Window.partitionBy("doc_id", "field").orderBy("rank")
    # whole ten-thousandths: a gap of 0.08 is one
    score = F.round(F.col("score") * 10_000).cast("long")
    c = candidates.withColumn("s", score).withColumn("next", F.lead("s").over(w)).where("rank = 1 AND next IS NOT NULL")
    return c.where((F.col("s") - F.col("next") <= round(gap * 10_000)) & (F.col("s") >= round(least * 10_000))).select("doc_id", "field", ((F.col("s") - F.col("next")) / 10_000).alias("gap"))

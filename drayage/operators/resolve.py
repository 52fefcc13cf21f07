"""Candidates of a field, and the joint choice of all fields of a bill by what history says goes together.

Scores are whole numbers of millionths, so sums do not depend on their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from drayage.functions.exprs import collapse
from drayage.operators import priors

# Order of the fields, weights in hundredths, guard bounds in ten-thousandths.
ORDER = ["consignor", "consignee", "origin", "destination", "carrier", "driver_name"]
FUZZY, UNARY, PAIR, TRIPLE, FULL, GUARD = 100, 15, 15, 28, 32, 50
STRONG, MARGIN = 9200, 1200
#: Hundredths of history's share that a candidate's score gets on top.
BONUS = 5
TOP, BEAM, PER_FIELD = 5, 8, 4

#: Relation and weight by the field that completes it.
COMPLETES = {f: [(r, w) for rs, w in ((priors.PAIRS, PAIR), (priors.TRIPLES, TRIPLE), (priors.FULL, FULL)) for r in rs if max(r, key=ORDER.index) == f] for f in ORDER}


def rank_candidates(found: DataFrame, k: int = TOP) -> DataFrame:
    """The ``k`` best values of each (doc_id, field).

    ``found`` (doc_id, field, value, source, fuzzy, prior_count, prior_prob): one
    row per finding. Values of one collapsed key are one candidate with the best
    of its scores; empty values are none. Ties go to share, count, then value.
    """
    key = collapse(F.col("value"))
    one = found.where(key != "").groupBy("doc_id", "field", key.alias("key")).agg(
        F.min_by("value", F.struct(-F.col("fuzzy"), F.col("value"))).alias("value"), F.array_sort(F.collect_set("source")).alias("sources"),
        F.round(F.max("fuzzy"), 4).alias("fuzzy"), F.coalesce(F.max("prior_count"), F.lit(0)).cast("long").alias("prior_count"), F.round(F.coalesce(F.max("prior_prob"), F.lit(0.0)), 4).alias("prior_prob"),
    )
    # whole millionths: f in ten-thousandths times 100, and BONUS of p; four decimals, half up
    tens = lambda c: F.round(F.col(c) * 10_000).cast("long")
    score = F.floor((100 * tens("fuzzy") + BONUS * tens("prior_prob") + 50) / 100) / 10_000
    w = Window.partitionBy("doc_id", "field").orderBy(F.desc("score"), F.desc("prior_prob"), F.desc("prior_count"), F.lower("value"))
    return one.withColumn("score", score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("doc_id", "field", "rank", "value", "sources", "fuzzy", "prior_count", "prior_prob", "score")


def _pools(candidates: DataFrame) -> DataFrame:
    """(doc_id, and for each field an array of its best candidates by rank with their own score)."""
    whole = lambda c: F.round(F.col(c) * 10_000).cast("long")
    c = candidates.select("doc_id", "field", "rank", "value", whole("fuzzy").alias("f"), whole("prior_prob").alias("p"))
    best = F.max("f").over(Window.partitionBy("doc_id", "field"))
    guard = F.when((best >= STRONG) & (best - F.col("f") > MARGIN), GUARD * 10_000).otherwise(0)
    c = c.withColumn("own", FUZZY * F.col("f") + UNARY * F.col("p") - guard).where(F.col("rank") <= PER_FIELD)
    slot = F.struct("rank", "value", "own")
    return c.groupBy("doc_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("field") == f, slot))).alias(f"of_{f}") for f in ORDER])


def joint(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, the chosen value of each field, joint_score): a beam search, field by field, in each bill.

    ``candidates`` as from ``rank_candidates``; ``edges`` as from ``priors.edges``.
    A bill keeps at most ``BEAM`` partial choices, each tried with at most
    ``PER_FIELD`` candidates, so a step's rows are bounded by the bills and what
    history says is an equi-join. A field without candidates stays null.
    """
    hit = edges.select("relation", "given_key", collapse(F.col("target")).alias("target_key"), F.round(F.col("prob") * 10_000).cast("long").alias("prob"))
    beam = _pools(candidates)
    beam = beam.select("*", F.lit(1).alias("place"), F.lit(0).cast("long").alias("score"))
    done: list[str] = []
    for f in ORDER:
        beam = beam.select("*", F.explode_outer(f"of_{f}").alias("s")).drop(f"of_{f}")
        beam = beam.withColumns({f: F.col("s.value"), "try": F.coalesce("s.rank", F.lit(0)), "score": F.col("score") + F.coalesce("s.own", F.lit(0))}).drop("s")
        if COMPLETES[f]:
            asks = [F.when(_known(r), F.struct(F.lit(">".join(r)).alias("relation"), F.concat_ws("|", *[collapse(F.col(c)) for c in r[:-1]]).alias("given_key"), collapse(F.col(r[-1])).alias("target_key"), F.lit(w).alias("w"))) for r, w in COMPLETES[f]]
            ask = beam.select("doc_id", "place", "try", F.explode(F.array_compact(F.array(*asks))).alias("a")).select("doc_id", "place", "try", "a.*")
            gain = ask.join(hit, ["relation", "given_key", "target_key"]).groupBy("doc_id", "place", "try").agg(F.sum(F.col("w") * F.col("prob")).alias("gain"))
            beam = beam.join(gain, ["doc_id", "place", "try"], "left").withColumn("score", F.col("score") + F.coalesce("gain", F.lit(0))).drop("gain")
        done.append(f)
        # scores are compared at four decimals
        order = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc(F.floor((F.col("score") + 50) / 100)), "place", "try"))
        beam = beam.withColumn("next", order).where(F.col("next") <= BEAM).drop("place", "try").withColumnRenamed("next", "place")
    return beam.where("place = 1").select("doc_id", *ORDER, (F.floor((F.col("score") + 50) / 100) / 10_000).alias("joint_score"))


def _known(r: tuple[str, ...]):
    ok = F.lit(True)
    for c in r:
        ok &= F.col(c).isNotNull()
    return ok

"""Co-occurrence priors of reviewed bills: counts, shares and ranks by relation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drayage.functions.exprs import collapse

# Relations, as what is given and what follows.
PAIRS = [("consignor", "consignee"), ("consignor", "carrier"), ("consignee", "carrier"), ("carrier", "driver_name"), ("origin", "destination")]
TRIPLES = [("consignor", "consignee", "carrier"), ("consignor", "carrier", "driver_name")]
FULL = [("consignor", "consignee", "origin", "destination", "carrier"), ("consignor", "carrier", "origin", "driver_name")]


def edges(reviewed: DataFrame, relations: list[tuple[str, ...]]) -> DataFrame:
    """(relation, given_key, target, cnt, prob, rank): one pass over the bills, whatever the relations.

    Bills that say the same are counted first, so keys are made once for each
    distinct bill and not for each bill and relation.
    """
    fields = list(dict.fromkeys(c for r in relations for c in r))
    alike = reviewed.groupBy(*fields).agg(F.count("*").alias("n")).select("n", *fields, *[collapse(F.col(c)).alias(f"{c}_key") for c in fields])
    whole = [F.struct(F.lit(">".join(r)).alias("relation"), F.concat_ws("|", *[f"{c}_key" for c in r[:-1]]).alias("given_key"), F.col(f"{r[-1]}_key").alias("target_key"), F.col(r[-1]).alias("target"), _all(r).alias("ok")) for r in relations]
    e = alike.select("n", F.explode(F.array(*whole)).alias("e")).select("n", "e.*").where("ok")
    e = e.groupBy("relation", "given_key", "target_key").agg(F.min("target").alias("target"), F.sum("n").alias("cnt"))
    group = Window.partitionBy("relation", "given_key")
    rank = F.row_number().over(group.orderBy(F.desc("cnt"), F.lower("target")))
    return e.select("relation", "given_key", "target", "cnt", F.round(F.col("cnt") / F.sum("cnt").over(group), 4).alias("prob"), rank.alias("rank"))


def _all(r: tuple[str, ...]) -> Column:
    ok = F.lit(True)
    for c in r:
        ok &= F.coalesce(F.col(f"{c}_key") != "", F.lit(False))
    return ok


def edges_sql(relations: list[tuple[str, ...]]) -> str:
    key = lambda c: f"regexp_replace(lower({c}), '[^a-z0-9&]+', '', 'g')"
    parts = " UNION ALL ".join(f"SELECT '{'>'.join(r)}' AS relation, concat_ws('|', {', '.join(map(key, r[:-1]))}) AS given_key, {r[-1]} AS target FROM bills WHERE reviewed" for r in relations)
    return f"""e AS ({parts}),
c AS (SELECT relation, given_key, {key('target')} AS target_key, min(target) AS target, count(*) AS cnt FROM e GROUP BY 1, 2, 3),
edges AS (SELECT relation, given_key, target, cnt, round(cnt / sum(cnt) OVER (PARTITION BY relation, given_key), 4) AS prob,
  CAST(row_number() OVER (PARTITION BY relation, given_key ORDER BY cnt DESC, lower(target)) AS INTEGER) AS rank FROM c)"""

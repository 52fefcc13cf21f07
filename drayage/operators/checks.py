"""Normalising a bill, what speaks against it, and the status that follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drayage.functions import shapes as S
from drayage.functions.exprs import collapse, party_key

# Tolerance of sums, codes that send a bill to review, and least overall confidence.
TOLERANCE, LEAST_OVERALL, REVIEWED_OVERALL = 0.05, 0.70, 0.95
REVIEW_CODES = ["CONSIGNOR_EQUALS_CONSIGNEE", "NEGATIVE_VALUE", "DESTINATION_COPIED_FROM_ORIGIN"]
ITEM = "struct<code:string,severity:string,fields:array<string>,item:int>"


def normalize(raw: DataFrame) -> DataFrame:
    """``raw`` with every schema field that it has put in form; text fields only. ``raw_text``, if there, gives a missing date."""
    out = {}
    for f in S.SCHEMA_FIELDS:
        if f not in raw.columns:
            continue
        c = F.col(f)
        if f == "invoice_number":
            new = F.lit(None).cast("string")
        elif f in ("bill_number", "vehicle_number"):
            new = S.clean_identifier(c)
        elif f == "bill_date":
            new = F.coalesce(S.clean_date(c), S.boxed_date(F.col("raw_text"))) if "raw_text" in raw.columns else S.clean_date(c)
        elif f in S.MONEY_FIELDS:
            new = S.clean_money(c)
        elif f == "weight":
            new = S.clean_weight(c)
        elif f in ("origin", "destination"):
            new = S.let(S.clean_place(c), lambda t: F.when(~S.is_junk(t), t))
        elif f in ("consignor", "consignee", "carrier", "commodity_description", "driver_name"):
            odd = "(?i)hours|miles|payroll" if f == "driver_name" else "x^"
            new = _named(c, odd)
        elif f in ("pickup_time", "delivery_time"):
            new = S.clean_clock(c)
        elif f == "special_instructions":
            new = S.let(S.clean_text(c), lambda t: F.when(F.length(S.letters(t)) >= 4, t))
        else:
            new = S.clean_text(c)
        out[f] = new
    df = raw.withColumns(out)
    if {"consignor", "consignee"} <= set(raw.columns):
        same = (party_key(F.col("consignor")) == party_key(F.col("consignee"))) & (party_key(F.col("consignee")) != "")
        df = df.withColumn("consignee", F.when(~F.coalesce(same, F.lit(False)), F.col("consignee")))
    return df


def _named(c: Column, odd: str) -> Column:
    return S.let(S.unglue(S.clean_text(c)), lambda t: F.when(~S.is_junk(t) & ~t.rlike(odd), t))


def clean_items(items: Column) -> Column:
    """Line items with a description or a load, their values in form; those without a number take their place."""
    loads = ("weight", "load_arrive", "load_depart", "unload_arrive", "unload_depart", "tag")
    has = lambda i: F.coalesce(sum((F.when(F.coalesce(i[k], F.lit("")) != "", 1).otherwise(0) for k in loads), F.lit(0)) > 0, F.lit(False))
    kept = F.filter(items, lambda i: S.clean_text(i["description"]).isNotNull() | has(i))
    return F.transform(kept, lambda i, n: F.struct(
        F.coalesce(i["item_no"], (n + 1).cast("string")).alias("item_no"), S.clean_text(i["description"]).alias("description"), S.clean_text(i["quantity"]).alias("quantity"),
        S.clean_money(i["rate"]).alias("rate"), S.clean_money(i["amount"]).alias("amount"), S.clean_text(i["tag"]).alias("tag"), S.clean_weight(i["weight"]).alias("weight"),
        *[S.clean_clock(i[k]).alias(k) for k in loads[1:5]],
    ))


def usable_items(items: Column) -> Column:
    """How many items say anything but their number."""
    return F.size(F.filter(items, lambda i: F.coalesce(F.concat_ws("", *[F.nullif(i[k], F.lit("")) for k in ("description", "quantity", "rate", "amount", "tag", "weight")]), F.lit("")) != ""))


def confidences(df: DataFrame, fields: list[str], reviewed: str = "reviewed") -> DataFrame:
    """``df`` with ``field_confidence`` (map) and ``overall``: the mean of what is positive, of two decimals."""
    conf = {f: S.confidence(f, F.col(f), F.col(reviewed)) for f in fields}
    # hundredths, so that the mean doesn't depend on their order
    above = F.filter(F.transform(F.map_values("field_confidence"), lambda c: F.round(c * 100).cast("int")), lambda x: x > 0)
    mean = lambda xs: F.when(F.size(xs) > 0, F.floor((2 * F.aggregate(xs, F.lit(0), lambda a, x: a + x) + F.size(xs)) / (2 * F.size(xs))) / 100).otherwise(0.0)
    return df.withColumn("field_confidence", F.create_map(*[x for f, c in conf.items() for x in (F.lit(f), c)])).withColumn("overall", S.let(above, mean))


def validate(df: DataFrame) -> DataFrame:
    """``df`` (critical fields, overall, reviewed, line_sum) with ``missing``, ``warnings`` and ``status``."""
    missing = F.array_compact(F.array(*[F.when(S.is_header(F.col(f)), f) for f in S.CRITICAL]))
    kept = df.columns
    df = df.withColumns({"missing": missing, "__freight": S.amount(F.col("freight_amount")), "__total": S.amount(F.col("total_amount"))})
    freight, total = F.col("__freight"), F.col("__total")
    warnings = F.array_compact(F.array(
        F.when(F.size("missing") > 0, F.concat(F.lit("Missing critical field(s): "), F.array_join("missing", ", "))),
        F.when(F.col("overall") < LEAST_OVERALL, F.concat(F.lit("Low overall confidence ("), F.format_number(F.col("overall") * 100, 1), F.lit("%)"))),
        F.when(freight > total, F.concat(F.lit("Freight amount ($"), F.format_number(freight, 2), F.lit(") exceeds Total amount ($"), F.format_number(total, 2), F.lit(")"))),
        F.when((F.col("line_sum") > 0) & (F.abs(F.col("line_sum") - total) > TOLERANCE), F.concat(F.lit("Line item sum ($"), F.format_number("line_sum", 2), F.lit(") mismatches total amount ($"), F.format_number(total, 2), F.lit(")"))),
    ))
    df = df.withColumn("warnings", warnings)
    blocking = F.size(F.array_except("missing", F.array(*map(F.lit, S.OPTIONAL_WHEN_REVIEWED))))
    done = F.coalesce(F.col("reviewed"), F.lit(False)) & (blocking == 0)
    df = df.withColumn("status", F.when(done | (F.size("warnings") == 0), "COMPLETED").otherwise("REVIEW"))
    overall = F.when(done, F.greatest("overall", F.lit(REVIEWED_OVERALL))).otherwise(F.col("overall"))
    return df.withColumn("overall", overall).select(*kept, "missing", "warnings", "status")


def _one(ok: Column, code: str, severity: str, fields: list[str]) -> Column:
    row = F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.array(*map(F.lit, fields)).alias("fields"), F.lit(None).cast("int").alias("item"))
    return F.when(F.coalesce(ok, F.lit(False)), F.array(row)).otherwise(F.array().cast(f"array<{ITEM}>"))


def findings(df: DataFrame) -> DataFrame:
    """``df`` with ``findings``: what speaks against a bill, in the order of the checks (history apart).

    Fields are text; ``line_items`` has text quantity, rate, amount and tag.
    ``origin_state`` and ``destination_state`` come from ``matching.state_of``,
    ``peer`` (or null) is another bill with its consignee, date and a tag.
    """
    c = F.col
    a, b = collapse(c("consignor")), collapse(c("consignee"))
    parties = _one((a == b) & (a != ""), "CONSIGNOR_EQUALS_CONSIGNEE", "error", ["consignor", "consignee"])
    freight, total = (F.when(S.clean_money(c(k)).isNotNull(), S.signed(c(k))) for k in ("freight_amount", "total_amount"))
    above = _one(freight > total, "FREIGHT_EXCEEDS_TOTAL", "error", ["freight_amount", "total_amount"])
    kept = df.columns
    raw = F.coalesce("line_items", F.array().cast(df.schema["line_items"].dataType))
    # numbers are read once, and asked several times
    df = df.withColumn("__items", F.transform(raw, lambda i: F.struct(*[S.signed(i[k]).alias(k) for k in ("quantity", "rate", "amount")], F.lower(S.strip(i["tag"])).alias("tag"))))
    items = c("__items")
    per_item = lambda code, severity, n: F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.array(F.lit("line_items")).alias("fields"), n.cast("int").alias("item"))
    off = lambda i: F.abs(i["quantity"] * i["rate"] - i["amount"]) > TOLERANCE
    arithmetic = F.array_compact(F.transform(items, lambda i, n: F.when(off(i), per_item("LINE_ITEM_QTY_RATE_AMOUNT_MISMATCH", "warning", n))))
    amounts = F.array_compact(F.transform(items, lambda i: i["amount"]))
    sum_ = F.aggregate(amounts, F.lit(0.0), lambda s, x: s + x)
    sums = _one((sum_ > 0) & (F.abs(sum_ - total) > TOLERANCE), "LINE_ITEM_SUM_MISMATCH", "error", ["line_items", "total_amount"])
    fields = [f for f in (*S.MONEY_FIELDS, "weight", "quantity") if f in df.columns]
    negative = [_one((S.signed(c(f)) < 0) & (S.clean_money(c(f)).isNotNull() if f in S.MONEY_FIELDS else F.lit(True)), "NEGATIVE_VALUE", "error", [f]) for f in fields]
    item_negative = F.array_compact(F.flatten(F.transform(items, lambda i, n: F.array(*[F.when(i[k] < 0, per_item("NEGATIVE_VALUE", "error", n)) for k in ("quantity", "rate", "amount")]))))
    states = _one(c("origin_state") != c("destination_state"), "ORIGIN_DESTINATION_STATE_MISMATCH", "warning", ["origin", "destination"])
    copied = _one(S.copied_destination(c("origin"), c("destination")), "DESTINATION_COPIED_FROM_ORIGIN", "error", ["origin", "destination"])
    tags = F.filter(F.transform(items, lambda i: i["tag"]), lambda t: t != "")
    twice = _one(F.size(tags) > F.size(F.array_distinct(tags)), "DUPLICATE_TAG", "warning", ["line_items"])
    peers = _one(c("peer").isNotNull(), "DUPLICATE_TAG_DATE", "warning", ["line_items", "bill_date", "consignee"])
    every = F.concat(parties, above, arithmetic.cast(f"array<{ITEM}>"), sums, *negative, item_negative.cast(f"array<{ITEM}>"), states, copied, twice, peers)
    return df.withColumn("findings", every).select(*kept, "findings")


def peers(tags: DataFrame) -> DataFrame:
    """(doc_id, peer): the least other bill of the same consignee and date with one of a bill's tags; ``tags`` (doc_id, consignee, bill_date, tag).

    The two least holders of a tag answer for all of them, so no pairs are made.
    """
    k = ["key", "bill_date", "low"]
    t = tags.select("doc_id", collapse(F.col("consignee")).alias("key"), "bill_date", F.lower(S.strip(F.col("tag"))).alias("low")).where("key <> '' AND bill_date <> '' AND low <> ''").distinct()
    least = t.groupBy(*k).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    least = least.where(F.col("first") < F.col("last")).select(*k, "first")
    held = t.join(least, k)
    second = held.where(F.col("doc_id") > F.col("first")).groupBy(*k).agg(F.min("doc_id").alias("second"))
    return held.join(second, k).select("doc_id", F.when(F.col("doc_id") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("peer")).groupBy("doc_id").agg(F.min("peer").alias("peer"))

"""The value that belongs to a label, by its place on the page."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Labels whose value is looked for to the right before it is looked for below.
LINE_FIRST = ["freight_amount", "fuel_surcharge", "handling_charge", "total_amount", "bill_number", "invoice_number", "bill_date", "pickup_time", "delivery_time"]
_NEEDS = {
    "pickup_time": r"\b[0-9]{1,2}:[0-9]{2}\b", "delivery_time": r"\b[0-9]{1,2}:[0-9]{2}\b", "weight": r"\d", "vehicle_number": r"\d",
    "bill_date": r"(?i)\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}|\d{4}[/.-]\d{1,2}[/.-]\d{1,2}|\b(?:MO|DAY|YR)\.?\s*\d{1,4}\b",
}
_REFUSES = {"bill_date": r"(?i)\bJOB\b", "vehicle_number": r"(?i)miles|hours|license|trailer"}


def values_of_labels(labels: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, page, field, value, conf): the nearest fitting item on the label's line, or below it.

    ``labels`` (doc_id, page, field, x0, y0, x1, y1), ``items`` (doc_id, page,
    pos, text, conf, x0, y0, x1, y1). A page's items are few, so the join by
    page with a range condition has a bounded group.
    """
    a, b = labels.alias("a"), items.alias("b")
    j = a.join(b, ["doc_id", "page"]).where(F.trim("b.text") != "")
    rules = lambda table, other: F.coalesce(*[F.when(F.col("field") == f, F.col("b.text").rlike(p)) for f, p in table.items()], F.lit(other))
    j = j.where(rules(_NEEDS, True) & ~rules(_REFUSES, False))
    h, w = F.col("a.y1") - F.col("a.y0"), F.col("a.x1") - F.col("a.x0")
    dy, dx = F.col("b.y0") - F.col("a.y1"), F.abs(F.col("b.x0") - F.col("a.x0"))
    middle = F.abs((F.col("b.y0") + F.col("b.y1") - F.col("a.y0") - F.col("a.y1")) / 2)
    line = (middle <= F.greatest(1.5 * h, F.lit(35.0))) & (F.col("b.x0") >= F.col("a.x0") - 20)
    below = (dy >= -15) & (dy <= F.greatest(4.0 * h, F.lit(180.0))) & (dx <= F.greatest(w, F.lit(350.0)))
    ways = F.array(F.when(line, F.struct(F.lit("line").alias("way"), (F.col("b.x0") - F.col("a.x1")).cast("double").alias("cost"))), F.when(below, F.struct(F.lit("below").alias("way"), (dy + 0.5 * dx).cast("double").alias("cost"))))
    j = j.select("doc_id", "page", "field", "pos", F.trim("b.text").alias("value"), "conf", F.explode(F.array_compact(ways)).alias("w")).select("*", "w.way", "w.cost")
    first = F.when((F.col("way") == "line") & F.col("field").isin(LINE_FIRST), 0).when(F.col("way") == "below", 1).otherwise(2)
    r = F.row_number().over(Window.partitionBy("doc_id", "page", "field").orderBy(first, "cost", "pos"))
    return j.withColumn("r", r).where("r = 1").select("doc_id", "page", "field", "value", F.round("conf", 3).alias("conf"))

"""Layout class of a page set by weighted evidence in its text and boxes.

Scores are whole hundredths, so that no sum depends on its order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that speak for a class.
FREIGHT = ["freight bill", "bill of lading", "point of origin", "point of destination", "consignor", "consignee", "shipper", "carrier", "waybill", "origin", "destination"]
INVOICE = ["invoice number", "invoice no", "invoice date", "amount due", "bill to", "subtotal", "sales tax", "remit payment", "invoice"]
TABLE = ["quantity", "qty", "description", "unit price", "rate", "amount", "tag number", "tag no", "hours", "tons", "line items"]
BILL_LABELS, INVOICE_HEADER, FREIGHT_HEADER = ["bill no", "bill number", "ticket no", "ticket number"], ["invoice", "tax invoice", "commercial invoice"], ["freight bill", "bill of lading", "straight bill of lading"]
# Classes in the order in which ties go, least score, least margin (hundredths), grid and what makes a line of it strong.
CLASSES = ["standard_freight_bill", "invoice_style", "table_heavy", "handwritten_heavy"]
MIN_SCORE, MIN_MARGIN, SECOND = 40, 12, 30
COLUMNS, ROWS, STRONG_COLUMN, STRONG_ROW, LEAST_ITEMS = 8, 16, 4, 3, 8


def blob(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))


def hits(c: Column, words: list[str]) -> Column:
    return sum((F.when(c.contains(w), 1).otherwise(0) for w in words), F.lit(0))


def _any(c: Column, words: list[str]) -> Column:
    return hits(c, words) > 0


def page_extent(items: DataFrame) -> DataFrame:
    """``items`` (id, text, cx, cy, x1, y1) with the width and height of their page set, from one up."""
    w = Window.partitionBy("id")
    return items.withColumns({"width": F.greatest(F.lit(1.0), F.max(F.greatest("x1", "cx")).over(w)), "height": F.greatest(F.lit(1.0), F.max(F.greatest("y1", "cy")).over(w))})


def grid(items: DataFrame) -> DataFrame:
    """(id, strong_columns, strong_rows) of ``items`` as from ``page_extent``; of few items, none."""
    line = lambda c, size, n: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(0.99), F.col(c) / F.col(size))) * n).cast("int")
    x = items.select("id", F.explode(F.array(F.struct(F.lit("c").alias("kind"), line("cx", "width", COLUMNS).alias("bin")), F.struct(F.lit("r").alias("kind"), line("cy", "height", ROWS).alias("bin")))).alias("b"))
    x = x.groupBy("id", "b.kind", "b.bin").count().groupBy("id").agg(
        F.sum(F.when(F.col("kind") == "c", F.col("count"))).alias("n"),
        F.count_if((F.col("kind") == "c") & (F.col("count") >= STRONG_COLUMN)).alias("cols"), F.count_if((F.col("kind") == "r") & (F.col("count") >= STRONG_ROW)).alias("rows"),
    )
    few = F.col("n") < LEAST_ITEMS
    return x.select("id", F.when(few, 0).otherwise(F.col("cols")).alias("strong_columns"), F.when(few, 0).otherwise(F.col("rows")).alias("strong_rows"))


def classify(pages: DataFrame, items: DataFrame) -> DataFrame:
    """(id, layout_class, confidence, evidence) of ``pages`` (id, text, pages, source) and their ``items`` (id, text, cx, cy, x1, y1)."""
    items = page_extent(items.where(F.trim("text") != ""))
    low = F.lower("text")
    head = (F.col("cy") <= 150) | (F.col("height") > 200) & (F.col("cy") <= 0.28 * F.col("height"))
    flags = items.groupBy("id").agg(*[F.max(head & _any(low, ws)).alias(k) for k, ws in (("h_freight", FREIGHT_HEADER), ("h_invoice", INVOICE_HEADER), ("h_bill", BILL_LABELS))])
    p = pages.withColumn("blob", blob(F.col("text"))).join(flags, "id", "left").join(grid(items), "id", "left")
    start = F.substring("blob", 1, 400)
    p = p.withColumns({"h_freight": F.coalesce("h_freight", _any(F.col("blob"), FREIGHT_HEADER)), "h_invoice": F.coalesce("h_invoice", _any(start, INVOICE_HEADER)), "h_bill": F.coalesce("h_bill", _any(start, BILL_LABELS))})
    n = F.greatest(F.coalesce("pages", F.lit(0)), F.lit(1))
    size, alnum = F.length(F.coalesce("text", F.lit(""))), F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\p{L}\p{N}]", ""))
    b = F.col("blob")
    p = p.withColumns({
        "alnum": alnum, "sparse": (alnum / n < 80) | (size / n < 160), "printed": (alnum / n >= 120) & (size / n >= 220), "freight": hits(b, FREIGHT), "invoice": hits(b, INVOICE), "table": hits(b, TABLE),
        "parties": hits(b, ["consignor", "consignee"]) >= 2, "route": hits(b, ["origin", "destination"]) >= 2, "cols": F.coalesce("strong_columns", F.lit(0)), "rows": F.coalesce("strong_rows", F.lit(0)),
    })
    c = F.col
    image = c("source").isin("preprocessed_image", "empty") & c("sparse")
    weights = [
        ("handwritten_heavy", c("sparse"), 45, "low_ocr_density"), ("handwritten_heavy", image, 20, "handwriting_indicators"), ("handwritten_heavy", c("alnum") < 40, 15, "sparse_ocr_text"), ("handwritten_heavy", c("printed"), -35, None),
        ("standard_freight_bill", c("freight") >= 3, 42, "freight_bill_keywords"), ("standard_freight_bill", c("freight") == 2, 22, "freight_bill_keywords"), ("standard_freight_bill", c("parties"), 18, "party_labels"),
        ("standard_freight_bill", c("route"), 12, "route_labels"), ("standard_freight_bill", c("h_freight"), 16, "freight_header_region"), ("standard_freight_bill", c("h_bill"), 8, "bill_number_region"),
        ("standard_freight_bill", c("printed") & (c("freight") >= 2), 10, "printed_form_density"), ("invoice_style", c("invoice") >= 3, 48, "invoice_keywords"), ("invoice_style", c("invoice") == 2, 32, "invoice_keywords"),
        ("invoice_style", c("h_invoice"), 22, "invoice_header_region"), ("invoice_style", b.contains("amount due") | b.contains("subtotal"), 12, "invoice_totals"), ("standard_freight_bill", (c("invoice") >= 2) & (c("freight") < 2), -12, None),
        ("table_heavy", c("table") >= 3, 40, "table_headers"), ("table_heavy", (c("cols") >= 3) & (c("rows") >= 3), 32, "table_structure"), ("table_heavy", (c("cols") >= 3) & (c("rows") < 3), 18, "aligned_columns"),
        ("table_heavy", (c("table") >= 3) & ((c("cols") >= 3) | (c("rows") >= 3)), 12, None),
    ]
    own = lambda k: F.greatest(F.lit(0), F.least(F.lit(100), sum((F.when(ok, w).otherwise(0) for kind, ok, w, _ in weights if kind == k), F.lit(0))))
    ranked = F.array_sort(F.array(*[F.struct((-own(k)).alias("s"), F.lit(i).alias("i")) for i, k in enumerate(CLASSES)]))
    p = p.withColumn("ranked", ranked).withColumn("evidence", F.array_distinct(F.array_compact(F.array(*[F.when(ok, e) for _, ok, _, e in weights if e]))))
    best, second = -c("ranked")[0]["s"], -c("ranked")[1]["s"]
    p = p.withColumns({"best": best, "margin": best - second, "second": second, "kind": F.element_at(F.array(*map(F.lit, CLASSES)), c("ranked")[0]["i"] + 1)})
    weak, close = c("best") < MIN_SCORE, (c("margin") < MIN_MARGIN) & (c("second") >= SECOND)
    # ten-thousandths, rounded half up to hundredths
    cents = lambda x: F.floor((x + 50) / 100) / 100
    sure = F.greatest(F.lit(0.55), F.least(F.lit(0.95), cents(5200 + 35 * c("best") + 40 * F.least("margin", F.lit(40)))))
    conf = F.when(weak, F.when(c("best") == 0, 0.2).otherwise(c("best") / 100)).when(close, cents(2000 + 25 * c("best"))).otherwise(sure)
    none = F.array(F.lit("weak_or_ambiguous"))
    why = F.when(weak & (F.size("evidence") == 0), none).when(~weak & close, F.concat("evidence", F.array(F.lit("ambiguous_layout_scores")))).otherwise(c("evidence"))
    return p.select("id", F.when(weak | close, "unknown").otherwise(c("kind")).alias("layout_class"), conf.alias("confidence"), why.alias("evidence"))


def reading_order(blocks: DataFrame, most: int = 200, chars: int = 500) -> DataFrame:
    """``blocks`` (id, page, text, x0, y0) with reading_order by page; the first ``most`` of a document, texts cut at ``chars``."""
    w = Window.partitionBy("id", "page").orderBy("y0", "x0", "text")
    whole = Window.partitionBy("id").orderBy("page", "reading_order")
    out = blocks.withColumn("text", F.substring(F.trim("text"), 1, chars)).where("text <> ''").withColumn("reading_order", F.row_number().over(w))
    return out.withColumn("place", F.row_number().over(whole)).where(F.col("place") <= most).drop("place")

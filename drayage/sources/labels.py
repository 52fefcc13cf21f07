"""Gold labels from files, and what an evaluation writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ["carrier", "consignor", "consignee", "driver_name", "origin", "destination", "bill_number", "bill_date", "weight", "total_amount"]
_ROW = "id string, bill_id string, document_id string, path string, file string, pdf string, layout_class string, layout string, gold map<string,string>, " + ", ".join(f"{f} string" for f in FIELDS)


def _text(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _gold(df: DataFrame, line: Column) -> DataFrame:
    """(id, path, gold, layout_class, error) of rows with a struct ``r``, null where a line is no object."""
    r = lambda k: F.col(f"r.{k}")
    path = F.coalesce(_text(r("path")), _text(r("file")), _text(r("pdf")), F.lit(""))
    own = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, FIELDS)), F.array(*map(r, FIELDS))), lambda _, v: v.isNotNull())
    gold = F.when(F.size(F.coalesce(r("gold"), F.create_map().cast("map<string,string>"))) > 0, r("gold")).otherwise(own)
    stem = F.nullif(F.regexp_extract(path, r"([^/\\]+?)(\.[^./\\]*)?$", 1), F.lit(""))
    error = F.when(F.col("r").isNull(), "invalid_json").when(path == "", "missing_path")
    return df.select(F.coalesce(_text(r("id")), _text(r("bill_id")), _text(r("document_id")), stem, line).alias("id"), F.coalesce(path, F.lit("")).alias("path"), gold.alias("gold"), F.coalesce(_text(r("layout_class")), _text(r("layout"))).alias("layout_class"), error.alias("error"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Labels of a ``.jsonl``, ``.csv`` or ``.json`` file; lines that do not parse stay, with an error."""
    if path.endswith(".jsonl"):
        lines = spark.read.text(path).where(F.trim("value") != "")
        parsed = F.from_json("value", _ROW + ", bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"})
        return _gold(lines.select("value", parsed.alias("p")).select("value", F.when(F.col("p.bad").isNull(), F.col("p")).alias("r")), F.concat(F.lit("line-"), F.substring(F.sha2("value", 256), 1, 12)))
    if path.endswith(".csv"):
        rows = spark.read.csv(path, header=True)
        held = [c for c in _ROW.replace(" map<string,string>", "").split(", ") for c in [c.split(" ")[0]]]
        whole = [(F.col(c) if c in rows.columns and c != "gold" else F.lit(None).cast("map<string,string>" if c == "gold" else "string")).alias(c) for c in held]
        return _gold(rows.select(F.struct(*whole).alias("r"), F.to_json(F.struct(*rows.columns)).alias("value")), F.concat(F.lit("row-"), F.substring(F.sha2("value", 256), 1, 12)))
    whole = spark.read.text(path, wholetext=True)
    many = F.coalesce(F.from_json("value", f"bills array<struct<{_ROW.replace(' ', ': ')}>>".replace(",: ", ", "))["bills"], F.from_json("value", f"array<struct<{_ROW.replace(' ', ': ')}>>".replace(",: ", ", ")))
    return _gold(whole.select(F.posexplode(many).alias("at", "r")), F.concat(F.lit("bill-"), F.col("at").cast("string")))


def report(summary: DataFrame) -> DataFrame:
    """One ``line`` of text per row of ``summary`` (name, n, correct), best first; the share has one decimal."""
    share = F.when(F.col("n") > 0, F.format_string("%.1f%%", 100.0 * F.col("correct") / F.col("n"))).otherwise("-")
    return summary.orderBy(F.desc(F.col("correct") / F.nullif(F.col("n"), F.lit(0))), "name").select(F.format_string("%-20s %6d %6d %8s", "name", "correct", "n", share).alias("line"))


def write_outputs(bills: DataFrame, summary: DataFrame, folder: str) -> None:
    """bills as JSON and CSV, the summary as JSON, the report as text; each in a folder of its own."""
    bills.write.mode("overwrite").json(f"{folder}/bills.json")
    plain = [c for c, t in bills.dtypes if not t.startswith(("map", "array", "struct"))]
    bills.select(*plain).write.mode("overwrite").csv(f"{folder}/bills.csv", header=True)
    summary.coalesce(1).write.mode("overwrite").json(f"{folder}/summary.json")
    report(summary).coalesce(1).write.mode("overwrite").text(f"{folder}/report.txt")

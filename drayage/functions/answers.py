"""What a model's answer says: its message, the object in it, and texts without accents."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from drayage.functions import shapes as S

# Kinds of message parts that are text.
TEXT_PARTS = ["text", "output_text"]


def message_text(body: Column) -> Column:
    """The text of the first choice of an answer (JSON text): its content, whole or in parts, then its reasoning, a line each.

    Empty where the body is null, no JSON, or holds no choice.
    """
    v = F.try_parse_json(body)
    path = "$.choices[0].message."
    kind = lambda x: F.coalesce(F.schema_of_variant(x), F.lit("VOID"))
    content = F.try_variant_get(v, path + "content", "variant")
    parts = F.try_variant_get(content, "$", "array<variant>")
    kept = F.filter(parts, lambda p: (kind(p) == "STRING") | kind(p).startswith("OBJECT") & F.coalesce(F.try_variant_get(p, "$.type", "string").isin(TEXT_PARTS), F.lit(False)))
    texts = F.transform(kept, lambda p: F.when(kind(p) == "STRING", F.try_variant_get(p, "$", "string")).otherwise(F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit(""))))
    one = lambda x: F.when(F.coalesce(x, F.lit("")) != "", F.array(x)).otherwise(F.array().cast("array<string>"))
    own = F.when(kind(content).startswith("ARRAY"), texts).otherwise(one(F.try_variant_get(content, "$", "string")))
    more = [one(F.try_variant_get(v, path + k, "string")) for k in ("reasoning", "reasoning_content")]
    return F.coalesce(F.array_join(F.concat(own, *more), "\n"), F.lit(""))


@F.pandas_udf(StringType())
def _first_object(texts: pd.Series) -> pd.Series:
    decoder = json.JSONDecoder()

    def first(t: str | None) -> str | None:
        at = -1 if t is None else t.find("{")
        while at >= 0:
            try:
                return json.dumps(decoder.raw_decode(t, at)[0], ensure_ascii=False, separators=(",", ":"))
            except (ValueError, RecursionError):
                at = t.find("{", at + 1)
        return None

    return texts.map(first)


def json_object(text: Column) -> Column:
    """The first JSON object of a text, written shortly, without what stands in think tags or around a fence; null if none.

    Spark parses whole texts only, so the search is an Arrow UDF.
    """
    t = F.regexp_replace(S.strip(text), r"(?is)<think>.*?</think>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")
    fenced = F.regexp_extract(t, r"(?is)```(?:json)?\s*(\{.*?\})\s*```", 1)
    return _first_object(F.when(fenced != "", fenced).otherwise(t))


_MARKS = re.compile("[\u0900-\u0dff]")


@F.pandas_udf(StringType())
def fold(texts: pd.Series) -> pd.Series:
    """Texts in compatibility form without marks over letters, but for those of Indic scripts; no replacement characters.

    Spark has no Unicode normalisation, so this is an Arrow UDF.
    """

    def one(t: str | None) -> str:
        if not t or t.isascii():
            return t or ""
        wide = unicodedata.normalize("NFKD", t.replace("\ufffd", ""))
        return "".join(ch for ch in wide if unicodedata.category(ch) != "Mn" or _MARKS.match(ch))

    return texts.map(one, na_action=None)

"""Fields from the text of a page, line by line: columns over an array of lines.

A page's lines are an array in its row, so no line leaves its bill and nothing
is shuffled. Rules that take the first fitting line filter the array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drayage.functions import shapes as S

# Patterns.
COMPANY = r"(?i)\b(INC|LLC|CORP|LTD)\.?\b"
TRUCK_LABEL = r"(?i)(?:vehicle\s*(?:number|no\.?)|truck\s*(?:number|no\.?)|truckno\.?)"
TRUCK_SKIP = r"(?i)miles|hours|license|trailer|axle|length|tonnage|hourly"
IMPORT_FILL = r"(?i)im\s*por\s*[t+]?\s*fill|import\s*fill|t?mport\s*fill|\b1\.?\s*t?mport\b|\btmport\b"
SIGNATURE_LABELS = ["SIGNATURE", "DRIVER", "DRIVERSIGNATURE", "DRIVERSIG"]


def lines(text: Column, empty: bool = True) -> Column:
    """A text's lines without white space at their ends."""
    ls = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), S.strip)
    return ls if empty else F.filter(ls, lambda x: x != "")


def _spelled(words: list[str], whole: bool = False) -> str:
    """Pattern, for upper case, of words whose letters may have anything but letters between them."""
    gap = "[^A-Z]*"
    any_ = "|".join(gap.join(w) for w in words)
    return f"^{gap}(?:{any_}){gap}$" if whole else any_


def _first(values: Column) -> Column:
    return F.get(F.array_compact(values), F.lit(0))


def letterhead_carrier(text: Column) -> Column:
    """First of 25 lines that looks like a registered company."""
    ok = lambda x: (F.length(x) >= 8) & x.rlike(COMPANY) & ~S.stripped_header(x) & (F.length(S.letters(x)) >= 8)
    return F.get(F.filter(F.slice(lines(text), 1, 25), ok), F.lit(0))


def _place_of(values: Column, test, last: bool = False) -> Column:
    """Position, from one, of the first (or last) element that passes; null if none does."""
    marked = F.filter(F.transform(values, lambda x, i: F.when(test(x), i + 1)), lambda x: x.isNotNull())
    return F.array_max(marked) if last else F.array_min(marked)


def route(text: Column) -> Column:
    """struct(origin, destination) of the lines after the point-of-origin header."""

    def found(geo: Column) -> Column:
        rest = F.slice(geo, F.lit(2), F.lit(5))
        end = _place_of(rest, lambda x: x.rlike("(?i)load|commodity|tag|weight|unload"))
        parts = F.slice(rest, F.lit(1), F.least(F.coalesce(end - 1, F.lit(4)), F.lit(4)))
        return F.struct(F.get(geo, F.lit(0)).alias("origin"), F.nullif(F.array_join(parts, " "), F.lit("")).alias("destination"))

    def ahead(window: Column) -> Column:
        stop = _place_of(window, lambda x: x.rlike(r"(?i)load|commodity|tag\s*number|weight|unload") & (F.length(x) < 24))
        return S.let(F.slice(window, F.lit(1), F.least(F.coalesce(stop - 1, F.lit(6)), F.lit(6))), found)

    def after(ls: Column) -> Column:
        place = _place_of(ls, lambda x: F.upper(x).rlike(_spelled(["POINTOFORIGIN", "POINTOFDESTINATION"])))
        own = lambda x: ~S.stripped_header(x) & ~x.rlike(r"(?i)^(YR|MO|DAY|DATE)[\s.]*\d*$") & ~x.rlike(r"(?i)^YR\.?\s*\d+")
        return S.let(place, lambda start: F.when(start.isNotNull(), S.let(F.filter(F.slice(ls, start + 1, F.lit(13)), own), ahead)))

    return S.let(lines(text, empty=False), after)


def import_fill(text: Column) -> Column:
    # all of the patterns have these letters in them
    apart = text.rlike(r"(?i)\bt?mport\b|\bimport\b") & text.rlike(r"(?i)(?:^|\n)\s*fill\s*(?:\n|$)")
    return F.when(F.lower(text).contains("por") & (text.rlike(IMPORT_FILL) | apart), "Import Fill")


def aggregate_commodity(text: Column) -> Column:
    """struct(quantity, commodity) of a size and a product, even when a tag is glued on; else import fill."""
    named, glued = r"(?i)(\d+)\s*[x×]\s*(\d+)\s+(Rock|Gravel|Sand|Dirt|Base|Stone)\b", r"(?i)(?:(?<=\n)|(?<=\s)|^)(?:(\d)\s*)?[x×]\s*(\d)\s*([A-Za-z]{3,8})(\d{5,})"
    part = lambda p, i: F.nullif(F.regexp_extract(text, p, i), F.lit(""))
    sized = text.rlike(r"[xX×]\s*\d")
    first = F.when(sized & text.rlike(named), F.struct(part(named, 1).alias("quantity"), F.concat(part(named, 1), F.lit(" x "), part(named, 2), F.lit(" "), F.initcap(part(named, 3))).alias("commodity")))
    n = F.coalesce(part(glued, 1), F.lit("1"))
    word = F.when(part(glued, 3).rlike("(?i)^[br]o?c?k"), "Rock").otherwise(F.initcap(part(glued, 3)))
    second = F.when(sized & text.rlike(glued), F.struct(n.alias("quantity"), F.concat(n, F.lit(" x "), part(glued, 2), F.lit(" "), word).alias("commodity")))
    fill = S.let(import_fill(text), lambda x: F.when(x.isNotNull(), F.struct(F.lit(None).cast("string").alias("quantity"), x.alias("commodity"))))
    return F.coalesce(first, second, fill)


def table_commodity(text: Column) -> Column:
    """A product that stands alone on its line, or behind its label."""
    alone = F.regexp_extract(text, r"(?im)^\s*(Dirt|Rock|Gravel|Sand)\s*$", 1)
    told = F.regexp_extract(text, r"(?i)(?:commodity|load|description)\s*[:#.]?\s*(Dirt|Rock|Gravel|Sand)\b", 1)
    return F.coalesce(import_fill(text), F.initcap(F.nullif(alone, F.lit(""))), F.initcap(F.nullif(told, F.lit(""))))


def truck_number(text: Column) -> Column:
    """The value under a truck label; miles, long stamps and headers are skipped."""
    behind = F.regexp_extract(text, rf"(?s)^.*?{TRUCK_LABEL}(.*)$".replace("(?i)", "").replace("(?s)", "(?is)"), 1)
    some = F.slice(F.filter(lines(behind), lambda x: x != ""), 1, 8)
    unit = lambda x: F.nullif(F.regexp_extract(x, r"\b(\d{1,4}[A-Za-z]?)\b", 1), F.lit(""))
    ok = lambda x: x.rlike(r"\d") & ~S.stripped_header(x) & ~x.rlike("(?i)^CMAT$") & (F.length(F.regexp_replace(x, r"\D", "")) < 5)
    return F.when(text.rlike(TRUCK_LABEL), _first(F.transform(some, lambda x: F.when(ok(x), F.coalesce(unit(x), F.when(F.length(x) <= 12, x))))))


def signature_driver(text: Column) -> Column:
    """First person's name from the last signature label on, or in the last 16 lines."""

    def named(ls: Column) -> Column:
        start = _place_of(ls, lambda x: F.upper(x).rlike(_spelled(SIGNATURE_LABELS, whole=True)), last=True)
        some = F.slice(ls, F.coalesce(start, F.greatest(F.size(ls) - 15, F.lit(1))), F.greatest(F.size(ls), F.lit(1)))
        return F.get(F.filter(some, S.stripped_person), F.lit(0))

    return S.let(lines(text, empty=False), named)


def cargo_line(text: Column) -> Column:
    """struct(quantity, commodity, weight, pickup_time, delivery_time) of a scale ticket's glued row."""
    rock = S.strip(F.nullif(F.regexp_extract(text, r"(?i)(\d+\s*[x×]\s*\d+\s+[A-Za-z]+(?:\s+[A-Za-z]+)?)", 1), F.lit("")))
    glued = r"(\d+\.\d{2})(\d{1,2}:\d{2})\s+(\d{1,2}:\d{2})"

    def row(x):
        times = F.regexp_extract_all(x, F.lit(r"(?<!\d)(\d{1,2}:\d{2}(?:\s*[AaPp]\.?\s*[Mm]\.?)?)(?!\d)"), F.lit(1))
        part = lambda p, i: F.nullif(F.regexp_extract(x, p, i), F.lit(""))
        scale = x.rlike(r"(?i)\d+\s*[x×]\s*\d+") | x.rlike(r"\d{6,}\s+\d+(?:\.\d+)?\s+\d{1,2}:\d{2}") | x.rlike(r"\d{6,}\d+\.\d{2}\d{1,2}:\d{2}") | x.rlike(glued)
        early = part(glued, 2)
        late = (F.get(F.split(early, ":"), F.lit(0)).try_cast("int") > 12) & (F.get(F.split(part(glued, 3), ":"), F.lit(0)).try_cast("int") <= 12) & early.startswith("1")
        early = F.when(late, F.substring(early, 2, 9)).otherwise(early)
        mashed = r"(?i)(?:\b(?:tag|ticket)\s*(?:number|#)?\s*)?(\d{6,})\s+(\d+(?:\.\d+)?)\s+\d{1,2}:\d{2}"
        weight = F.coalesce(part(mashed, 2), part(r"(\d{6,})(\d+\.\d{2})(\d{1,2}:\d{2})", 2), part(r"(?<!\d)(\d+\.\d{2})(?!\d)", 1), part(glued, 1))
        two = F.size(times) >= 2
        return F.when(
            scale & (weight.isNotNull() | two),
            F.struct(weight.alias("weight"), F.when(two, F.try_element_at(times, F.lit(-2))).otherwise(early).alias("pickup_time"), F.when(two, F.try_element_at(times, F.lit(-1))).otherwise(part(glued, 3)).alias("delivery_time")),
        )

    hit = _first(F.transform(F.split(text, r"\r\n|\r|\n"), row))
    return F.struct(F.nullif(F.regexp_extract(rock, r"^(\d+)", 1), F.lit("")).alias("quantity"), rock.alias("commodity"), hit["weight"].alias("weight"), hit["pickup_time"].alias("pickup_time"), hit["delivery_time"].alias("delivery_time"))


def load_rows(text: Column) -> Column:
    """array of loads: weight with two clocks, or three clocks; a tag of four to eight digits that is no clock."""

    def row(x):
        weight = F.nullif(F.regexp_extract(x, r"(?<!\d)(\d{1,3}\.\d{2})(?!\d)", 1), F.lit(""))
        tag = F.nullif(F.regexp_extract(x, r"(?<!\d)(\d{4,8})(?!\d)", 1), F.lit(""))
        c = S.clocks(x)
        at = lambda i: F.get(c, F.lit(i))
        return F.when(
            weight.isNotNull() & (F.size(c) >= 2) | (F.size(c) >= 3),
            F.struct(F.when(S.compact_clock(tag).isNull(), tag).alias("tag"), weight.alias("weight"), at(0).alias("load_arrive"), at(1).alias("load_depart"), at(2).alias("unload_arrive"), at(3).alias("unload_depart")),
        )

    rows = F.array_compact(F.transform(lines(text, empty=False), row))
    return F.transform(rows, lambda r, i: F.struct((i + 1).cast("string").alias("item_no"), *[r[k].alias(k) for k in ("tag", "weight", "load_arrive", "load_depart", "unload_arrive", "unload_depart")]))


def load_summary(rows: Column) -> Column:
    """struct(pickup_time, delivery_time, quantity, weight) of a bill's loads; quantity and weight only of several."""
    first, last = F.get(rows, F.lit(0)), F.try_element_at(rows, F.lit(-1))
    weights = F.array_compact(F.transform(rows, lambda r: r["weight"].try_cast("decimal(18,2)")))
    total = F.aggregate(weights, F.lit(0).cast("decimal(18,2)"), lambda a, w: (a + w).cast("decimal(18,2)"))
    many = F.size(rows) > 1
    return F.struct(
        first["load_arrive"].alias("pickup_time"), F.coalesce(last["unload_depart"], last["load_depart"], last["unload_arrive"]).alias("delivery_time"),
        F.when(many, F.size(rows).cast("string")).alias("quantity"), F.when(many & (F.size(weights) > 0), total.cast("string")).alias("weight"),
    )


def pick_value(field: str, spatial: Column, text: Column) -> Column:
    """The better of a value found by place and one found in the text."""
    names = ("consignor", "consignee", "origin", "destination", "commodity_description", "driver_name")
    told = None
    if field == "commodity_description":
        told = F.coalesce(table_commodity(F.coalesce(text, F.lit(""))), table_commodity(F.coalesce(spatial, F.lit(""))))
        spatial, text = (F.when(~S.strip(c).rlike(r"^\d{1,2}\.?$"), c) for c in (spatial, text))
    if field == "vehicle_number":
        spatial, text = (F.when(c.rlike(r"\d") & ~c.rlike("(?i)miles|hours"), c) for c in (spatial, text))
    spatial = F.when(~S.is_header(spatial) & (~S.is_junk(spatial) if field in names else F.lit(True)), spatial)
    text = F.when(~S.is_header(text) & (~S.is_junk(text) if field in names[:-1] else F.lit(True)), text)
    out = spatial
    if field in (*names, "carrier"):
        s, t = S.strip(spatial), S.strip(text)
        key = lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", ""))
        n = lambda c: F.length(S.letters(c))
        better = s.rlike("^[A-Za-z]{1,4}[+.]?$") & (n(t) >= 6) | (key(s) != "") & F.startswith(key(t), key(s)) & (F.length(t) > F.length(s)) | (n(t) >= n(s) + 6)
        if field == "commodity_description":
            better |= s.rlike(r"\d{5,}") & ~t.rlike(r"\d{5,}")
        out = F.when(better, text).otherwise(spatial)
    out = F.when(spatial.isNull(), text).when(text.isNull(), spatial).otherwise(out)
    return F.coalesce(told, out) if told is not None else out


def fill_gaps(structured: DataFrame, text: DataFrame, fields: list[str]) -> DataFrame:
    """Rows of ``structured`` (id, fields) with what ``text`` (id, fields) has where they are empty."""
    other = text.select("id", *[F.col(f).alias(f"_{f}") for f in fields])
    return structured.join(other, "id", "left").select("id", *[F.coalesce(F.nullif(f, F.lit("")), f"_{f}").alias(f) for f in fields])

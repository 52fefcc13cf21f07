"""Tests and cleaners of field values: what is a form's own print, junk, a name, a place; and typed clean-up.

All are native columns. A test of a null value says what an empty one says. White
space at the ends counts for nothing. A value that can't be read is null, never an
error: casts are ``try_cast`` and dates ``try_to_timestamp``, as the session runs in
ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from drayage.functions.exprs import INDIC_DIGITS, collapse, indic_digits

# Words that a form prints itself, as their letters alone.
LABEL_WORDS = [
    "HANDWRITTEN", "BILL", "NUMBER", "NO", "NUM", "INVOICE", "VEHICLE", "TRUCK", "DATE", "WEIGHT", "FREIGHT", "TOTAL", "AMOUNT",
    "NONE", "NULL", "UNKNOWN", "CARGO", "ITEM", "VAL", "VALUE", "NAME", "DESCRIPTION", "LOCATION", "CONSIGNEE", "SHIPPER", "CONSIGOR", "CONSIGNOR",
    "RECEIVER", "CARRIER", "COMMODITY", "QUANTITY", "DRIVER", "SPECIAL", "INSTRUCTIONS", "ORIGIN", "DESTINATION", "TIME", "PICKUP", "DELIVERY", "RECIEVER",
    "BILLNO", "BILLNUMBER", "INVOICENUMBER", "VEHICLENUMBER", "FREIGHTAMOUNT", "TOTALAMOUNT", "FREIGHTBILL", "BILLOFLADING",
    "SPECIALINSTRUCTIONS", "DRIVERNAME", "COMMODITYDESCRIPTION", "COMODTVDESCRPTON", "PICKUPIDELIVERYTIME", "EREGHTAMOUNT", "DESTNATON", "NVOICE", "NOMBER", "NVOICENOMBER", "MANIFEST",
    "DE", "DEL", "LA", "EL", "LOS", "LAS", "OF", "THE", "AND", "ADDRESS", "SUBHAUL", "TAGNUMBER", "STREETCITY", "STREETANDCITY", "POINTOFORIGIN", "POINTOFDESTINATION",
    "ARRIVED", "DEPART", "REMARKS", "TONNAGE", "HOURLY", "LOADING", "UNLOADING", "BILLTO", "JOBNAME", "TRAILEROWNER", "TRUCKNO", "TRUCKLICENSE", "TRAILERLICENSE",
    "PAYROLL", "SIGNATURE", "START", "MILES", "HOURS", "TOTALHOURS", "MHOURS", "STARTHOURS", "TOTALMILES", "STARTMILES",
]
# What the letters of a form's header hold.
HEADER_PARTS = ["POINTOFORIGIN", "POINTOFDESTINATION", "SUBHAUL", "TAGNUMBER", "STREETCITY", "STREETANDCITY", "ADDRESSORJOB", "TRAILEROWNER", "TRUCKLICENSE", "TRAILERLICENSE"]
# Schema fields, those that a bill can't do without, and those of them that a reviewed bill can.
SCHEMA_FIELDS = [
    "bill_number", "bill_date", "carrier", "invoice_number", "consignor", "consignee", "origin", "destination", "commodity_description", "quantity", "weight", "freight_amount",
    "fuel_surcharge", "handling_charge", "total_amount", "vehicle_number", "driver_name", "pickup_time", "delivery_time", "special_instructions", "driver_signature", "consignee_signature", "received_datetime",
]
CRITICAL = ["bill_number", "consignor", "consignee", "origin", "destination", "freight_amount", "total_amount"]
OPTIONAL_WHEN_REVIEWED = ["freight_amount", "total_amount"]
MONEY_FIELDS = ["freight_amount", "fuel_surcharge", "handling_charge", "total_amount"]
NUMERIC_FIELDS = ["weight", "quantity", *MONEY_FIELDS, "rate"]
NAME_FIELDS = ["consignee", "consignor", "carrier", "driver_name", "origin", "destination", "driver_signature", "consignee_signature"]
# Least confidence to post without review.
THRESHOLDS = {"numeric": 0.90, "name": 0.70, "other": 0.80}
# Patterns.
LABEL_PREFIX = r"(?i)^(?:address|street(?:\s+and)?\s+city|tag\s*(?:number|#)?|sub[\s-]*haul\s*#?)\s*[:#-]?\s*"
ID_PREFIX = r"(?i)^(?:cargo\s*manifest\b\s*(?:no|number)?|manifest\b\s*(?:no|number)?|bill\s*of\s*lading\b\s*(?:no|number)?|bol\b\s*(?:no|number)?|bill\b\s*(?:no|number)?|invoice\b\s*(?:no|number)?|inv\b\s*(?:no|number)?|vehicle\b\s*(?:no|number)?|truck\b\s*(?:no|number)?)\s*[:#\s]+"
GLUED_SUFFIX = r"(?i)(?<=[A-Za-z])(MATERIALS|TRUCKING|CONCRETE|LOGISTICS|TRANSPORT|HAULING|EXPRESS|CARRIERS)\b"
DATE_BOX = r"(?i)^(?:YRZ?\d|YR\.?\s*\d|MO\.?\s*\d|DAY\.?\s*\d)"
KNOWN_SLASHED = "(?i)discovery|hooper|stockton|tracy|vernalis|palm|orwood|manteca"
PLACE_WORDS = r"(?i)\b(st|rd|ave|ca|stockton|tracy|discovery|hooper|bay)\b"
CASE_FLIPS = "[a-z][A-Z]+[a-z]+[A-Z]|[A-Z][a-z]+[A-Z]+[a-z]"
INDIC_PREFIXES = {"एफबी": "FB", "एचबी": "HB", "आईएनवी": "INV", "इन्व": "INV"}
STREET = r"(?i)(.+?\s+(?:st|street|rd|road|ave|avenue|blvd|dr|drive|ln|lane|way|ct|court|hwy|highway)\.?)\b"
ZIP = r"\b(\d{5})(?:-\d{4})?\b"


def let(value: Column, fn) -> Column:
    """``fn`` of ``value``, which is evaluated once however often ``fn`` names it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def letters(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z]", "")


def is_label(c: Column) -> Column:
    """A value that is nothing but a form's word; one with a digit is not."""
    return F.when(c.isNull() | (c == ""), True).otherwise(~c.rlike("[0-9]") & F.regexp_replace(F.upper(c), "[^A-Z]", "").isin(LABEL_WORDS))


def _header(t: Column) -> Column:
    # spelled-out points of origin and sub-hauls have their letters among the parts
    of = lambda own: ~t.rlike("[0-9]") & own.isin(LABEL_WORDS) | own.rlike("|".join(HEADER_PARTS))
    return F.when(t.isNull() | (t == ""), True).otherwise(let(F.regexp_replace(F.upper(t), "[^A-Z]+", ""), of))


def is_header(c: Column) -> Column:
    """What a form prints itself, in whole or as a glued header; empty values too."""
    return let(strip(c), _header)


def stripped_header(t: Column) -> Column:
    """``is_header`` of a value that has no white space at its ends."""
    return _header(t)


def _junk(t: Column) -> Column:
    def of(words: Column) -> Column:
        n = F.size(words)
        return (
            F.length(letters(t)).between(1, 3) | t.rlike(DATE_BOX) | t.rlike(r"^[A-Z]{2,4}\d+\s+[A-Za-z]")
            | (n >= 3) & F.forall(words, lambda w: F.length(w) <= 3) | (n >= 1) & t.contains("/") & ~t.rlike(KNOWN_SLASHED)
            | (n >= 4) & t.rlike(r"\d") & ~t.rlike(PLACE_WORDS) | F.exists(words, lambda w: (F.length(w) <= 7) & w.rlike(CASE_FLIPS))
        )

    return F.when(t.isNull() | (t == ""), False).otherwise(_header(t) | let(F.regexp_extract_all(t, F.lit("[A-Za-z]+"), F.lit(0)), of))


def is_junk(c: Column) -> Column:
    """Glyph salad that no name is made of; an empty value isn't junk."""
    return let(strip(c), _junk)


def shape_ok(field: str, c: Column) -> Column:
    """Whether a cleaned value looks like its field."""
    return let(strip(c), lambda t: _fits(field, t))


def _fits(field: str, t: Column) -> Column:
    if field == "bill_date":
        ok = t.rlike(r"^\d{4}-\d{2}-\d{2}$")
    elif field in MONEY_FIELDS:
        ok = t.rlike(r"^\$\d")
    elif field == "weight":
        ok = t.rlike(r"\d") & ~t.rlike(r"\d{1,2}:\d{2}")
    elif field in ("pickup_time", "delivery_time"):
        ok = t.rlike(r"\d{1,2}:\d{2}")
    elif field == "vehicle_number":
        ok = t.rlike(r"\d") & ~t.rlike("(?i)miles|hours")
    elif field == "special_instructions":
        ok = F.length(letters(t)) >= 4
    elif field in ("consignor", "consignee", "origin", "destination", "commodity_description", "driver_name"):
        ok = ~t.rlike("(?i)hours|miles") & ~_junk(t)
        return F.when(t.isNull() | (t == ""), False).otherwise(ok)  # junk has headers among it
    else:
        ok = F.lit(True)
    return F.when(t.isNull() | (t == ""), False).otherwise(~_header(t) & ok)


def harvestable(field: str, c: Column) -> Column:
    """A name good enough to be learned."""
    return let(strip(c), lambda t: _learned(field, t))


def _learned(field: str, t: Column) -> Column:
    ok = ~_junk(t) & (F.length(F.regexp_replace(t, r"[^\p{L}]", "")) >= 3) & ~t.rlike(r"[^\p{L}\p{N}_\s.&,'/#-]")
    if field in ("driver_name", "driver_signature"):
        ok &= ~t.rlike(r"^\d{3,}$")
    return F.when(t.isNull() | (t == ""), False).otherwise(ok)


def trusted(field: str, c: Column) -> Column:
    """A value that is learned though nobody reviewed it."""
    if field == "carrier":
        mark = c.rlike(r"(?i)\b(inc|llc|corp|co)\.?\b")
    elif field in ("origin", "destination"):
        mark = c.rlike(r"\b\d{5}\b") | c.rlike(r"(?i)\b(CA|Stockton|Tracy|Discovery Bay|Vernalis|Manteca|Lathrop)\b")
    else:
        mark = F.lit(False)
    return harvestable(field, c) & F.coalesce(mark, F.lit(False))


def person_name(c: Column) -> Column:
    return let(strip(c), stripped_person)


def stripped_person(t: Column) -> Column:
    """``person_name`` of a value that has no white space at its ends."""
    ok = t.rlike(r"^[A-Za-z][A-Za-z'`.-]{1,24}(?:\s+[A-Za-z][A-Za-z'.]{0,20}){1,2}$") & ~t.rlike(r"\d{3,}") & ~t.rlike(r"(?i)\b(INC|LLC|CORP|LTD|MATERIALS|CONCRETE)\b") & ~_header(t)
    return F.coalesce(ok, F.lit(False))


def permit_number(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(c, r"[\s-]+", "").rlike(r"(?i)^CA\d{5,}$"), F.lit(False))


def indic_script(c: Column) -> Column:
    return F.coalesce(c.rlike(r"[\x{0900}-\x{097F}]"), F.lit(False))


def sparse(c: Column) -> Column:
    """Too little text to read fields from: under 40 letters and digits."""
    return F.length(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9]", "")) < 40


def clean_text(c: Column) -> Column:
    """The value without a label before it; null if nothing but a form's print is left."""
    kept = lambda t: let(strip(F.regexp_replace(t, LABEL_PREFIX, "")), lambda rest: F.when(~_header(rest) & ((rest == t) | ~_header(t)), rest))
    return let(strip(c), kept)


def unglue(c: Column) -> Column:
    """Spaces that a reader of print drops, put back."""
    t = F.regexp_replace(strip(c), GLUED_SUFFIX, " $1")
    t = F.regexp_replace(F.regexp_replace(t, "([a-z])([A-Z])", "$1 $2"), "([A-Z]{2,})([A-Z][a-z])", "$1 $2")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)\s*,\s*(INC|LLC|CORP|LTD)\.?", ", $1."), r",\s*,", ",")
    return strip(F.regexp_replace(t, r"\s+", " "))


def indic_identifier(c: Column) -> Column:
    c = indic_digits(c)
    for prefix, latin in INDIC_PREFIXES.items():
        c = F.regexp_replace(c, f"^{prefix}", latin)
    return c


def clean_identifier(c: Column) -> Column:
    """An id without its label; shorter than three only with a digit; ``F3-`` is FB-, ``H3-`` HB-."""

    def of(bare: Column) -> Column:
        ok = lambda t: ~_header(bare) & ((F.length(t) >= 3) | t.rlike(f"[0-9{INDIC_DIGITS}]")) & t.rlike(r"[\p{L}\p{N}]")
        return let(indic_identifier(bare), lambda t: F.when(ok(t), F.regexp_replace(F.regexp_replace(t, "^F3-", "FB-"), "^H3-", "HB-")))

    return let(strip(F.regexp_replace(clean_text(c), ID_PREFIX, "")), of)


def clean_place(c: Column) -> Column:
    """A place with its spaces, ``Rd`` for ``Bd`` and ``City, ST``."""
    t = F.regexp_replace(unglue(clean_text(c)), r"\b([A-Z])([A-Z][a-z]{2,})\b", "$1 $2")
    return F.regexp_replace(F.regexp_replace(t, r"\bBd\b", "Rd"), r"([A-Za-z]+),([A-Za-z]{2})\b", "$1, $2")


def clean_money(c: Column) -> Column:
    """First amount as $#,##0.00 without its sign; a dot before just three digits parts thousands; else null."""
    t = F.regexp_replace(strip(c), r"(\d)\.(\d{3})\b", "$1$2")
    n = F.regexp_replace(F.regexp_extract(t, r"[$₹€£]?\s*([\d,]+\.?\d*)", 1), ",", "").try_cast("double")
    return F.when(~is_label(strip(c)), F.concat(F.lit("$"), F.format_number(n, 2)))


def amount(c: Column) -> Column:
    """The number of a cleaned amount."""
    return F.regexp_replace(clean_money(c), "[^0-9.]", "").try_cast("double")


def clean_weight(c: Column) -> Column:
    """First number without clock times glued to it, with ``lbs`` if a unit of pounds stands there in any spelling."""
    t = F.regexp_replace(clean_text(c), r"\d{1,2}:\d{2}(?:\s*[AaPp]\.?\s*[Mm]\.?)?", " ")
    t = strip(F.regexp_replace(t, r"\s+", " "))
    t = F.regexp_replace(t, r"(\d+)\.(\d{3})(?=[a-zA-Z\s]|$)", "$1,$2")
    t = F.regexp_replace(t, r"(?i)(\d+(?:,\d{3})*(?:\.\d+)?)\s*(?:lbs|los|1os|Ibs|Ib)\b", "$1 lbs")
    number = lambda t: F.nullif(F.regexp_extract(t, r"(\d{1,3}(?:,\d{3})*(?:\.\d+)?|\d+\.\d+)", 1), F.lit(""))
    return let(t, lambda t: F.concat(number(t), F.when(t.rlike(r"(?i)\blbs\b"), " lbs").otherwise("")))


def _iso(y: Column, m: Column, d: Column) -> Column:
    y, m, d = (x.try_cast("int") for x in (y, m, d))
    y = F.when(y < 100, y + 2000).otherwise(y)
    return F.date_format(F.try_to_timestamp(F.format_string("%04d-%02d-%02d", y, m, d), F.lit("yyyy-MM-dd")), "yyyy-MM-dd")


_MO, _YR = r"(?i)\bMO\.?\s*(\d{1,2})\b", r"(?i)\bYR\.?\s*(\d{2,4})\b"
_DAY, _CALENDAR_DAY = r"(?i)\bDAY\.?\s*(\d{1,2})\b", r"(?i)(?<!JOB\s{0,13})\bDAY\.?\s*(\d{1,2})\b"


def _windows(c: Column, pattern: str, before: int, after: int) -> Column:
    """What stands around each match: (match, text from ``before`` characters ahead of it to ``after`` behind)."""
    gaps, found = F.split(c, pattern, -1), F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<m:string,w:string>>").alias("out"))

    def step(a, s):
        start = a["at"] + F.length(s["g"])
        end = start + F.length(s["m"])
        lo = F.greatest(start - before, F.lit(0))
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(s["m"].alias("m"), F.substring(c, lo + 1, end + after - lo).alias("w")))).alias("out"))

    steps = F.filter(F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("g"), m.alias("m"))), lambda s: s["m"].isNotNull())
    return F.aggregate(steps, state, step, lambda a: a["out"])


def boxed_date(c: Column) -> Column:
    """A date in MO, DAY and YR boxes: near a year box, else after the word DATE; the day of a job is none."""
    box = lambda w, p: F.regexp_extract(w, p, 1)
    by_year = F.transform(_windows(c, _YR, 160, 160), lambda x: _iso(box(x["m"], _YR), box(x["w"], _MO), box(x["w"], _CALENDAR_DAY)))
    year = lambda w: F.coalesce(F.nullif(box(w, _YR), F.lit("")), box(w, r"\b(20\d{2}|2[0-9])\b"))
    by_word = F.transform(_windows(c, r"(?i)\bDATE\b", 0, 240), lambda x: _iso(year(x["w"]), box(x["w"], _MO), box(x["w"], _CALENDAR_DAY)))
    return F.get(F.array_compact(F.concat(by_year, by_word)), F.lit(0))


def clean_date(c: Column) -> Column:
    """ISO date: of numbers with slashes, dots or dashes, else year first, else from boxes; one that is no day falls to the next."""
    return let(strip(c), _date)


def _date(t: Column) -> Column:
    a, b, y = (F.regexp_extract(t, r"\b(\d{1,2})[/.-](\d{1,2})[/.-](\d{2,4})\b", i).try_cast("int") for i in (1, 2, 3))
    slash = F.when(a > 12, _iso(y, b, a)).when(b > 12, _iso(y, a, b)).otherwise(_iso(y, a, b))
    p, q, r = (F.regexp_extract(t, r"\b(\d{4})[/.-](\d{1,2})[/.-](\d{1,2})\b", i) for i in (1, 2, 3))
    boxes = _iso(F.regexp_extract(t, _YR, 1), F.regexp_extract(t, _MO, 1), F.regexp_extract(t, _DAY, 1))
    return F.when(~_header(t) & ~t.rlike(r"^\d{1,2}$"), F.coalesce(slash, _iso(p, q, r), boxes, boxed_date(t)))


def compact_clock(c: Column) -> Column:
    """930 as 9:30, from all digits of the value; hours up to 23, minutes up to 59, not 0:00."""
    part = lambda d, i: F.regexp_extract(d, r"^(\d{1,2})(\d{2})$", i).try_cast("int")
    clock = lambda h, m: F.when((h <= 23) & (m <= 59) & (h + m > 0), F.format_string("%d:%02d", h, m))
    return let(F.regexp_replace(c, r"\D", ""), lambda d: let(F.struct(part(d, 1).alias("h"), part(d, 2).alias("m")), lambda x: clock(x["h"], x["m"])))


def clean_clock(c: Column) -> Column:
    """H:MM with the AM or PM that follows somewhere, not converted; else a compact clock."""
    return let(strip(c), _clock)


def _clock(t: Column) -> Column:
    part = lambda i: F.regexp_extract(t, r"\b(\d{1,2}):(\d{2})\b", i).try_cast("int")
    behind = F.regexp_extract(t, r"(?s)\b\d{1,2}:\d{2}\b(.*)$", 1)
    half = F.upper(F.regexp_replace(F.regexp_extract(behind, r"([AaPp]\.?\s*[Mm]\.?)", 1), r"[\s.]", ""))
    at = F.when((part(1) <= 23) & (part(2) <= 59), F.concat(F.format_string("%d:%02d", part(1), part(2)), F.when(half != "", F.concat(F.lit(" "), half)).otherwise("")))
    return F.when(~_header(t), F.coalesce(at, compact_clock(t)))


def clocks(line: Column) -> Column:
    """Clock times of a line: those with a colon; compact ones too if there are three, or two where colons make fewer."""
    colon = F.regexp_extract_all(line, F.lit(r"(?<!\d)(\d{1,2}:\d{2})(?!\d)"), F.lit(1))
    compact = F.array_compact(F.transform(F.regexp_extract_all(line, F.lit(r"(?<!\d)(\d{3,4})(?!\d)"), F.lit(1)), compact_clock))
    return F.when((F.size(compact) >= 3) | (F.size(colon) < 2) & (F.size(compact) >= 2), F.concat(colon, compact)).otherwise(colon)


def confidence(field: str, c: Column, reviewed: Column) -> Column:
    """Heuristic confidence of a cleaned value."""
    t = strip(c)
    forms = {"bill_number": ("^[A-Z0-9-]{3,20}$", 0.95), "invoice_number": ("(?i)^INV-[A-Z0-9-]{3,20}$", 0.95), "bill_date": (r"^\d{4}-\d{2}-\d{2}$", 0.96), "vehicle_number": ("^[A-Z0-9-]{2,10}$", 0.95)}
    forms |= dict.fromkeys(MONEY_FIELDS, (r"^\$\d{1,3}(?:,\d{3})*\.\d{2}$", 0.94))
    base = F.lit(0.88) if field == "weight" else F.when(t.rlike(forms[field][0]), forms[field][1]).otherwise(0.85) if field in forms else F.lit(0.85)
    return F.when(~shape_ok(field, c), 0.0).when(F.coalesce(reviewed, F.lit(False)), 1.0).otherwise(base)


def threshold(field: Column) -> Column:
    return F.when(field.isin(NUMERIC_FIELDS), THRESHOLDS["numeric"]).when(field.isin(NAME_FIELDS), THRESHOLDS["name"]).otherwise(THRESHOLDS["other"])


def name_variants(c: Column) -> Column:
    """What a misread name may be: digits for letters, 9 for &; each once, in order."""
    t = strip(c)
    all_ = F.array(t, F.translate(t, "015", "OIS"), F.replace(t, F.lit("9"), F.lit("&")), F.replace(t, F.lit(" 9 "), F.lit(" & ")))
    all_ = F.transform(all_, lambda v: strip(F.regexp_replace(v, r"\s+", " ")))
    return F.array_distinct(F.filter(all_, lambda v: v != ""))


def zip_code(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, ZIP, 1), F.lit(""))


def street(c: Column) -> Column:
    """What stands up to a street's suffix, as the first line of it."""
    return F.nullif(F.regexp_replace(F.regexp_replace(F.regexp_extract(strip(c), STREET, 1), r"\s+", " "), "^[ ,]+|[ ,]+$", ""), F.lit(""))


def place_core(c: Column) -> Column:
    return collapse(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)\b(ca|california)\b", ""))


def copied_destination(origin: Column, destination: Column) -> Column:
    """The destination is the origin, a city inside of it, or the letterhead's city."""
    o, d = place_core(strip(origin)), place_core(strip(destination))
    head = d.isin("stockton", "stocktonca")
    inside = F.contains(o, d)
    return F.when(d == "", False).when(o == d, True).when((o != "") & inside & (F.length(d) >= 6), True).when(~head, False).when((o == "") | inside, True).otherwise(~F.contains(d, o))


def label_key(c: Column) -> Column:
    """A label as an identifier: lower case, words joined by ``_``."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip(c)), r"[^\p{L}\p{N}_]+", "_"), "^_+|_+$", "")


def download_name(c: Column) -> Column:
    """The name of a bill's report: the stem of the file it came in, safe in a header, of 80 characters at most."""
    stem = F.regexp_replace(F.regexp_replace(F.coalesce(F.nullif(c, F.lit("")), F.lit("freight_bill")), "^.*/", ""), r"(.)\.[^.]*$", "$1")
    safe = F.substring(F.regexp_replace(stem, r"[^\p{L}\p{N}_.-]+", "_"), 1, 80)
    return F.concat(F.coalesce(F.nullif(safe, F.lit("")), F.lit("freight_bill")), F.lit("_extraction_report.pdf"))


def signed(c: Column) -> Column:
    """First number with the sign, mark of currency or parentheses that make it negative; else null."""
    form = r"(?i)-?\s*(?:US\$|\$|₹|€|£)?\s*[\d,]+(?:\.\d+)?"

    def of(x: Column) -> Column:
        n = F.regexp_replace(x["m"], "[^0-9.]+", "").try_cast("double")
        return F.when(x["m"].startswith("-") | x["t"].startswith("(") & x["t"].endswith(")"), -n).otherwise(n)

    return let(strip(c), lambda t: let(F.struct(t.alias("t"), F.regexp_extract(t, form, 0).alias("m")), of))

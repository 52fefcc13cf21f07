"""What a reviewer is shown, and what a field's evidence lets happen to it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drayage.functions import seeds
from drayage.functions import shapes as S
from drayage.functions.exprs import collapse, is_missing
from drayage.operators.resolve import ORDER

# Findings that ask for a second reading, and those that validation reports in its own words.
TRIGGERS = ["HISTORICAL_RELATIONSHIP_CONFLICT", "CONSIGNOR_EQUALS_CONSIGNEE", "DESTINATION_COPIED_FROM_ORIGIN"]
VALIDATED = {"FREIGHT_EXCEEDS_TOTAL": ("freight&exceed",), "LINE_ITEM_SUM_MISMATCH": ("line item sum", "mismatches total")}
# Sources that are evidence, their labels, and the fields that a relation's target stands for.
SOURCE_LABELS = {"ocr": "OCR", "ocr_text": "OCR", "gazetteer": "Gazetteer", "alias": "Alias", "prior": "Prior"}
TARGETS = {"carrier": ["carrier"], "driver": ["driver_name", "driver"], "consignee": ["consignee"], "destination": ["destination"]}
# Least letters of a party and of a place, least confidence of a strong value, and what guards a well read value.
PARTY_LETTERS, PLACE_LETTERS, STRONG, GUARD_SCORE, GUARD_MARGIN = 6, 5, 0.80, 0.92, 0.12
PLACE_WORDS = r"(?i)\b(st|street|rd|road|ave|ca|stockton|tracy|discovery|vernalis|manteca|lathrop|hooper|cannon|landfill)\b"
PARTIES, PLACES, LETTERHEAD = ["consignor", "consignee", "driver_name"], ["origin", "destination"], ["consignor", "consignee"]
# Labels on a page, in the order in which they are tried.
LABELS = {
    "bill_number": r"bill\s*no|bill\s*num|bill\s*#|bol\s*no|waybill|n\.?\s*[ºo°]?\s*de\s+factura|carta\s*de\s*porte", "invoice_number": r"invoice\s*num|invoice\s*no|inv\s*no|inv\s*#|n[úu]mero\s+de\s+factura|numero\s+de\s+factura",
    "bill_date": r"^date\b|^dated\b|ship\s*date|^fecha(?!/?hora)|^mo\.?\s*\d{0,2}$|^day\.?\s*\d{1,2}$|^yr\.?\s*\d{2,4}$", "consignor": r"consignor|shipper|billed\s*from|remitente|expedidor", "consignee": r"consignee|receiver|billed\s*to|destinatario|consignatario",
    "origin": r"point\s*of\s*origin|pointoforigin|pickup\s*loc|origen|\borigin\b", "destination": r"point\s*of\s*destination|pointofdestination|destnaton|delivery\s*loc|destino|\bdestination\b",
    "driver_signature": r"firma\s+del\s+conductor|driver\s*signature", "consignee_signature": r"firma\s+del\s+destinatario|consignee\s*signature|receiver\s*signature",
    "vehicle_number": r"vehicle\s*number|truck\s*number|truck\s*no|truckno|n[úu]mero\s+de\s+veh|numero\s+de\s+vehiculo", "weight": r"weight|gross\s*wt|weght|peso", "carrier": r"carrier\s*name\b|carrier\b|(?<!-)hauler|transporter|transportista",
    "commodity_description": r"commodity\s*description|commodity|comodtv|cargo\s*desc|descripci|mercanc", "quantity": r"quantity|qty|ouantty|pallets|cantidad", "driver_name": r"driver\s*name|^driver$|nombre\s+del\s+conductor",
    "pickup_time": r"pickup\s*time|hora\s+de\s+recogida", "delivery_time": r"delivery\s*time|hora\s+de\s+entrega", "freight_amount": r"ereghtamount|freight\s*amount|freight\s*charges|importe\s+del\s+flete", "fuel_surcharge": r"fuel\s*surcharge|fuel\s*charge",
    "handling_charge": r"handling\s*charge|handling", "total_amount": r"total\s*amount|grand\s*total|importe\s+total|total\s*a\s*pagar", "special_instructions": r"special\s*instructions|instrucciones", "received_datetime": r"received\s*datetime|received\s*date|fecha/?hora\s+de\s+recep",
}
_CARRIERS = sorted({"".join(ch for ch in n.lower() if ch.isascii() and ch.isalnum() or ch == "&") for n in seeds.NAMES["carrier"]})


def _present(c: Column) -> Column:
    return F.coalesce(~F.trim(c).isin("", "—"), F.lit(False))


def _per_field(field: Column, of, names: list[str], other: Column) -> Column:
    return reduce(lambda rest, f: F.when(field == f, of(f)).otherwise(rest), names, other)


def letterhead(field: Column, value: Column, carrier: Column) -> Column:
    """A shipper or receiver that is the bill's carrier or one known from the start."""
    key = collapse(value)
    return F.coalesce(field.isin(LETTERHEAD) & (key != "") & (key.isin(_CARRIERS) | (key == F.coalesce(collapse(carrier), F.lit("")))), F.lit(False))


def harvestable(field: Column, value: Column) -> Column:
    """``shapes.harvestable`` for a field that differs by row."""
    return F.when(field == "driver_name", S.harvestable("driver_name", value)).otherwise(S.harvestable("consignor", value))


def weak_stub(field: Column, value: Column, carrier: Column, origin: Column, known: Column) -> Column:
    """A party or place too poor to keep; ``known``: a place that the gazetteer has, or nearly."""
    n = F.length(F.regexp_replace(F.coalesce(value, F.lit("")), "[^A-Za-z]", ""))
    lone = (n < PLACE_LETTERS) | ~(F.coalesce(known, F.lit(False)) | value.rlike(r"\b\d{5}\b") | value.rlike(PLACE_WORDS))
    poor = F.when(field.isin(PARTIES), n < PARTY_LETTERS).otherwise(lone)
    copied = (field == "destination") & S.copied_destination(origin, value)
    return F.when(~field.isin(PARTIES + PLACES), False).when(F.coalesce(S.strip(value), F.lit("")) == "", True).otherwise(~harvestable(field, value) | letterhead(field, value, carrier) | copied | poor)


def confidence_signal(fields: DataFrame) -> DataFrame:
    """(doc_id, field, heuristic, calibrated, used, threshold, strong): the confidence that a second reading goes by.

    ``fields``: doc_id, field, value, conf, raw, calibrated, fitted, least (null:
    the field's own threshold), carrier, origin, known, near_miss. Calibration
    counts only where it was fitted.
    """
    heuristic = F.coalesce("conf", "raw", F.lit(0.0))
    calibrated = F.coalesce(F.nullif("calibrated", F.lit(0.0)), heuristic)
    f = fields.select("*", heuristic.alias("h"), calibrated.alias("c"), F.coalesce("least", S.threshold(F.col("field"))).alias("threshold"))
    f = f.withColumn("used", F.when(F.coalesce("fitted", F.lit(False)), F.col("c")).otherwise(F.col("h")))
    field, value = F.col("field"), F.col("value")
    bad = weak_stub(field, value, F.col("carrier"), F.col("origin"), F.col("known")) | letterhead(field, value, F.col("carrier")) | S.is_junk(value) | F.coalesce("near_miss", F.lit(False))
    bad |= (field == "destination") & S.copied_destination(F.col("origin"), value)
    strong = ~is_missing(value, "rescue") & (F.col("used") >= F.greatest("threshold", F.lit(STRONG))) & ~bad
    return f.select("doc_id", "field", F.col("h").alias("heuristic"), F.col("c").alias("calibrated"), "used", "threshold", F.coalesce(strong, F.lit(False)).alias("strong"))


def apply_joint(bills: DataFrame, chosen: DataFrame, candidates: DataFrame) -> DataFrame:
    """(doc_id, the fields, status of each): what a joint choice changes on ``bills`` (doc_id, fields of ORDER).

    ``chosen`` (doc_id, field, selected); ``candidates`` (doc_id, field, rank,
    value, fuzzy). Fields are taken in order, as a place is judged by the origin
    already written. A bill without a choice stays, its statuses null. One
    shuffle by bill: a bill has a handful of candidates for a field.
    """
    pick = chosen.groupBy("doc_id", "field").agg(F.first("selected").alias("selected"))
    c = candidates.join(pick, ["doc_id", "field"], "left")
    same = F.when(collapse(F.col("value")) == collapse(F.coalesce("selected", F.lit(""))), F.struct(-F.col("rank"), F.col("fuzzy")))
    best = c.groupBy("doc_id", "field").agg(F.max_by(F.struct("value", "fuzzy"), F.struct("fuzzy", -F.col("rank"))).alias("best"), F.max(same)["fuzzy"].alias("own"))
    slots = pick.join(best, ["doc_id", "field"], "full").groupBy("doc_id").pivot("field", ORDER).agg(F.first(F.struct("selected", "best", "own")))
    given = slots.select(F.col("doc_id"), *[F.col(f).alias(f"_{f}") for f in ORDER])
    has = chosen.select("doc_id").distinct().withColumn("_has", F.lit(True))
    out = bills.join(given, "doc_id", "left").join(has, "doc_id", "left")
    for f in ORDER:
        name, old, slot = F.lit(f), F.col(f), F.col(f"_{f}")
        new, head = slot["selected"], lambda v, n=F.lit(f): letterhead(n, v, F.col("carrier"))
        usable = (F.coalesce(new, F.lit("")) != "") & harvestable(name, new)
        best_, fuzzy = slot["best"]["value"], F.coalesce(slot["best"]["fuzzy"], F.lit(0.0))
        sound = best_.isNotNull() & harvestable(name, best_) & ~weak_stub(name, best_, F.col("carrier"), F.col("origin"), F.lit(False))
        guard = sound & (fuzzy >= GUARD_SCORE) & (fuzzy - F.coalesce(slot["own"], F.lit(0.0)) > GUARD_MARGIN)
        poor = (F.coalesce(old, F.lit("")) != "") & ~harvestable(name, old)
        status = (
            F.when(F.col("_has").isNull(), None).when(head(new), "rejected_letterhead").when(~F.coalesce(usable, F.lit(False)), F.when(poor, "rejected_junk"))
            .when(F.coalesce(guard, F.lit(False)), "ocr_guard").when((F.coalesce(old, F.lit("")) != "") & (collapse(old) == collapse(new)), "unchanged").otherwise("applied")
        )
        out = out.withColumn(f"{f}_status", status)
        mark = F.col(f"{f}_status")
        drop = (mark == "rejected_junk") | (mark == "rejected_letterhead") & head(old)
        out = out.withColumn(f, F.when(mark == "applied", new).when(drop, None).otherwise(old))
    for f in LETTERHEAD:
        out = out.withColumn(f, F.when(F.col("_has").isNotNull() & letterhead(F.lit(f), F.col(f), F.col("carrier")), None).otherwise(F.col(f)))
    return out.drop("_has", *[f"_{f}" for f in ORDER])


def predictions(stored: DataFrame, extracted: DataFrame) -> DataFrame:
    """(doc_id, field, value, confidence): what was predicted before any review, as it is kept.

    ``stored`` has the same columns and is never replaced. Of a document that it
    lacks, ``extracted`` (…, reviewed) is kept unless a reviewer wrote it.
    """
    new = extracted.where(~F.coalesce("reviewed", F.lit(False)) & F.col("field").isin(S.SCHEMA_FIELDS)).join(stored.select("doc_id").distinct(), "doc_id", "left_anti")
    return stored.select("doc_id", "field", "value", "confidence").unionByName(new.select("doc_id", "field", "value", F.round("confidence", 4).alias("confidence")))


def tile(status: Column) -> Column:
    """The tile that a document is counted on; PENDING holds those at work."""
    s = F.upper(F.coalesce(status, F.lit("")))
    return F.when(s.isin("COMPLETED", "REVIEW", "FAILED"), s).when(s.isin("PENDING", "PROCESSING"), "PENDING")


def line_item_count(items: Column, keys: list[str]) -> Column:
    """How many line items say anything beside their number; two make them usable."""
    said = [k for k in keys if k != "item_no"]
    return F.coalesce(F.size(F.filter(items, lambda r: reduce(lambda a, k: a | ~is_missing(r[k], "rescue"), said, F.lit(False)))), F.lit(0))


def findings_of_fields(findings: DataFrame, codes: list[str] | None = None) -> DataFrame:
    """``findings`` (doc_id, code, fields, …), a row for each field it involves; only of ``codes``, if given."""
    f = findings if codes is None else findings.where(F.col("code").isin(codes))
    return f.withColumn("field", F.explode(F.array_distinct("fields"))).drop("fields")


def relations_of_fields(relations: DataFrame, fields: list[str]) -> DataFrame:
    """``relations`` (doc_id, relation, …), a row for each field that the relation names."""
    named = F.array_compact(F.array(*[F.when(F.contains("relation", F.lit(f.replace("_name", ""))), f) for f in fields]))
    return relations.withColumn("field", F.explode(named))


def selectable(value: Column, sources: Column) -> Column:
    """A candidate that a reviewer may choose: it has a value and a source that is evidence."""
    return _present(value) & F.coalesce(F.arrays_overlap(sources, F.array(*map(F.lit, SOURCE_LABELS))), F.lit(False))


def source_label(sources: Column) -> Column:
    """Sources as shown: each once, Prior only where nothing else is."""
    label = lambda s: _per_field(F.lower(s), lambda k: F.lit(SOURCE_LABELS[k]), list(SOURCE_LABELS), s)
    all_ = F.array_distinct(F.filter(F.transform(F.coalesce(sources, F.array().cast("array<string>")), label), lambda s: F.coalesce(s != "", F.lit(False))))
    join = lambda a: F.nullif(F.array_join(a, " · "), F.lit(""))
    return F.coalesce(join(F.array_remove(all_, "Prior")), join(all_), F.lit("Evidence"))


def relation_label(relation: Column) -> Column:
    return F.replace(F.replace(F.coalesce(relation, F.lit("")), F.lit("→"), F.lit(" → ")), F.lit("+"), F.lit(" + "))


def field_label(key: Column) -> Column:
    """A field's key as words, each with a capital."""
    words = F.split(F.regexp_replace(F.replace(key, F.lit("_"), F.lit(" ")), "([a-z])([A-Z])", "$1 $2"), " ")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), " ")


def joint_evidence(field: Column, value: Column, relations: Column) -> Column:
    """Those of ``relations`` (array of structs with relation, target) that speak of a field: by what they end in, or by its value."""

    def speaks(r: Column) -> Column:
        end = F.element_at(F.split(r["relation"], "→"), -1)
        of = _per_field(end, lambda t: field.isin(TARGETS[t]), list(TARGETS), F.lit(True))
        return F.coalesce(of, F.lit(False)) | _present(r["target"]) & _present(value) & (collapse(r["target"]) == collapse(value))

    return F.filter(relations, lambda r: F.coalesce(speaks(r), F.lit(False)))


def history_support(value: Column, candidates: Column, relations: Column, conflicts: Column) -> Column:
    """What history says of a value, as an array of (kind, text, count, probability).

    ``candidates``: structs of value, prior_count, prior_probability;
    ``relations``: relation, given, target, count, probability; ``conflicts``:
    relation, usual, usual_count, usual_prob. Of candidates two are shown.
    """
    row = lambda kind, text, n, p: F.struct(F.lit(kind).alias("kind"), text.alias("text"), n.cast("long").alias("count"), p.cast("double").alias("probability"))
    own = F.slice(F.filter(candidates, lambda c: (F.coalesce(c["prior_count"], F.lit(0)) > 0) & (collapse(c["value"]) == collapse(value))), 1, 2)
    used = F.transform(own, lambda c: row("candidate", F.concat(c["prior_count"].cast("string"), F.when(c["prior_count"] == 1, " historical ticket used “").otherwise(" historical tickets used “"), c["value"], F.lit("”")), F.lit(None), c["prior_probability"]))
    given = lambda r: F.array_join(F.filter(r["given"], lambda g: F.coalesce(g != "", F.lit(False))), " + ")
    told = F.transform(
        F.filter(relations, lambda r: F.coalesce(r["count"] != 0, F.lit(False))),
        lambda r: row("relation", F.when((F.coalesce(given(r), F.lit("")) != "") & (F.coalesce(r["target"], F.lit("")) != ""), F.concat(given(r), F.lit(" → "), r["target"])).otherwise(relation_label(r["relation"])), r["count"], r["probability"]),
    )
    against = F.transform(
        F.filter(conflicts, lambda c: F.coalesce(c["usual"] != "", F.lit(False))),
        lambda c: row("conflict", F.concat(F.lit("Historical "), relation_label(c["relation"]), F.lit(" usually uses “"), c["usual"], F.lit("”")), c["usual_count"], c["usual_prob"]),
    )
    none = F.array().cast("array<struct<kind:string,text:string,count:bigint,probability:double>>")
    return F.concat(*[F.coalesce(a, none) for a in (used, told, against)])


def shown_findings(findings: Column, warnings: Column) -> Column:
    """Findings (structs with code, severity) without those that a warning of validation tells already."""

    def told(code: str) -> Column:
        says = lambda w, p: reduce(lambda a, s: a & F.contains(F.lower(w), F.lit(s)), p.split("&"), F.lit(True))
        return F.exists(warnings, lambda w: reduce(lambda a, p: a | says(w, p), VALIDATED[code], F.lit(False)))

    return F.filter(findings, lambda f: F.coalesce(f["code"] != "", F.lit(False)) & ~reduce(lambda a, code: a | (f["code"] == code) & told(code), VALIDATED, F.lit(False)))


def review_reasons(status: Column, warnings: Column, below: Column, findings: Column) -> Column:
    """Why a bill in review is there, as an array of (key, text); ``below``: how many of its values calibration holds back."""
    warnings = F.coalesce(warnings, F.array().cast("array<string>"))
    item = lambda key, text: F.struct(F.lit(key).alias("key"), text.alias("text"))
    kinds = {"missing": "(?i)missing critical", "overall": "(?i)low overall confidence"}

    def first(key: str) -> Column:
        return F.slice(F.transform(F.filter(warnings, lambda w: w.rlike(kinds[key])), lambda w: item(key, w)), 1, 1)

    def counted(n: Column, key: str, what: str, then: str = "") -> Column:
        text = F.concat(n.cast("string"), F.lit(f" {what}"), F.when(n == 1, "").otherwise("s"), F.lit(then))
        return F.when(n > 0, F.array(item(key, text))).otherwise(none)

    none = F.slice(first("missing"), 1, 0)
    shown = shown_findings(findings, warnings)
    errors, warned = F.size(F.filter(shown, lambda f: f["severity"] == "error")), F.size(F.filter(shown, lambda f: f["severity"] != "error"))
    rest = F.filter(warnings, lambda w: ~reduce(lambda a, p: a | w.rlike(p), kinds.values(), F.lit(False)))
    others = F.transform(rest, lambda w, i: F.struct(F.concat(F.lit("validate-"), i.cast("string")).alias("key"), w.alias("text")))
    reasons = F.concat(first("missing"), first("overall"), counted(below, "autopost", "field", " below auto-post threshold"), counted(errors, "consistency-error", "consistency error"), counted(warned, "consistency-warning", "consistency warning"), others)
    return F.when(F.upper(F.coalesce(status, F.lit(""))) == "REVIEW", reasons).otherwise(none)


def label_regions(items: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, field, label, x0, y0, x1, y1): beside and below a field's first label, where its value is looked for.

    ``items`` (doc_id, pos, text, x0, y0, x1, y1), ``pages`` (doc_id, width,
    height), of which null or 0 bounds nothing.
    """
    t = S.strip(F.col("text"))
    field = F.coalesce(*[F.when(t.rlike("(?iu)" + p), f) for f, p in LABELS.items()])
    seen = items.select("*", field.alias("field")).where("field IS NOT NULL")
    first = seen.groupBy("doc_id", "field").agg(F.min_by(F.struct(t.alias("label"), "x0", "y0", "x1", "y1"), "pos").alias("b")).select("doc_id", "field", "b.*")
    edge = lambda x, side: F.when(F.coalesce(side, F.lit(0)) > 0, F.least(x, side.cast("double"))).otherwise(x)
    at = lambda x: F.round(x.cast("double"), 1)
    right = F.col("x1") + F.greatest(F.col("x1") - F.col("x0"), F.lit(80.0))
    low = F.col("y1") + F.greatest((F.col("y1") - F.col("y0")) * 4, F.lit(180.0))
    return first.join(pages.select("doc_id", "width", "height"), "doc_id", "left").select("doc_id", "field", "label", at(F.col("x0")).alias("x0"), at(F.col("y0")).alias("y0"), edge(at(right), F.col("width")).alias("x1"), edge(at(low), F.col("height")).alias("y1"))


def truth_by_name(files: DataFrame, truths: DataFrame, marks: DataFrame) -> DataFrame:
    """``files`` (name, …) with ``truth``: of the file's stem in ``truths`` (stem, truth), else of the first mark in its name.

    ``marks`` (ord, mark, truth) is a handful of rows that a person keeps; it is
    broadcast by Spark where its size allows.
    """
    stem = F.regexp_replace(F.regexp_replace("name", "^.*/", ""), r"(.)\.[^.]*$", "$1")
    f = files.withColumn("_stem", stem).join(truths.select(F.col("stem").alias("_stem"), F.col("truth").alias("_own")), "_stem", "left")
    hit = files.select("name").distinct().join(marks, F.contains(F.regexp_replace("name", "^.*/", ""), "mark")).groupBy("name").agg(F.min_by("truth", "ord").alias("_marked"))
    return f.join(hit, "name", "left").withColumn("truth", F.coalesce("_own", "_marked")).drop("_stem", "_own", "_marked")


# What a second reading is asked, before its fields.
ASK = [
    "The candidate lists below are evidence only. Read the image.", "You may return a value that is not in the candidate list if the image clearly shows it.",
    "Read every handwritten load row (tag, weight, load in/out, unload in/out) into line_items.", "MO / DAY / YR boxes are bill_date (YYYY-MM-DD). JOB DAY is not the date.", "Return a single JSON object only. No markdown, no explanation.", "",
]


def rescue_prompt(plan: DataFrame, candidates: DataFrame, conflicts: DataFrame, relations: DataFrame, most: int = 5) -> DataFrame:
    """(doc_id, prompt): what a second reading of a bill is asked, with the evidence for its doubtful fields.

    ``plan`` (doc_id, field, rank, reasons, value); ``candidates`` (doc_id,
    field, rank, value, fuzzy, prior_count, sources); ``conflicts`` (doc_id,
    field, usual, usual_count); ``relations`` (doc_id, field, relation, target,
    rank), of which the first is told. All go by bill and field; a bill has some
    twenty fields, so a group is small.
    """
    extras = F.concat_ws("; ", F.concat(F.lit("fuzzy "), F.col("fuzzy").cast("string")), F.when(F.col("prior_count") > 0, F.concat(F.lit("prior "), F.col("prior_count").cast("string"))))
    line = F.concat(F.col("value"), F.lit(" ["), F.coalesce(F.array_join("sources", ","), F.lit("")), F.lit("]"), F.when(extras != "", F.concat(F.lit(" ("), extras, F.lit(")"))).otherwise(""))
    c = candidates.where(~is_missing(F.col("value"), "rescue")).groupBy("doc_id", "field").agg(F.slice(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), 1, most).alias("cands"))
    h = conflicts.where("usual <> ''").groupBy("doc_id", "field").agg(F.min(F.struct("usual", F.coalesce("usual_count", F.lit(0)).alias("n"))).alias("usual"))
    r = relations.groupBy("doc_id", "field").agg(F.min_by(F.struct("relation", "target"), "rank").alias("told"))
    p = reduce(lambda a, b: a.join(b, ["doc_id", "field"], "left"), (c, h, r), plan.where("field <> ''"))
    none = F.array().cast("array<string>")
    listed = F.when(F.size("cands") > 0, F.concat(F.array(F.lit("Top candidates:")), F.transform("cands", lambda x, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), x["line"])))).otherwise(none)
    usual = F.when(F.col("usual").isNotNull(), F.array(F.concat(F.lit("Historical evidence: usual value "), F.col("usual.usual"), F.lit(" ("), F.col("usual.n").cast("string"), F.lit(" tickets).")))).otherwise(none)
    told = F.when(F.col("told").isNotNull(), F.array(F.concat(F.lit("Joint-decode relation: "), F.col("told.relation"), F.lit(" → "), F.col("told.target")))).otherwise(none)
    head = F.array(F.concat(F.lit("Field: "), F.col("field")), F.concat(F.lit("Current deterministic prediction: "), F.when(is_missing(F.col("value"), "rescue"), "(empty)").otherwise(F.col("value"))), F.concat(F.lit("Why uncertain: "), F.coalesce(F.array_join("reasons", ", "), F.lit(""))))
    blocks = p.select("doc_id", F.struct("rank", "field", F.concat(head, listed, usual, told, F.array(F.lit(""))).alias("lines")).alias("b")).groupBy("doc_id").agg(F.array_sort(F.collect_list("b")).alias("b"))
    focus = F.concat(F.lit("Focus especially on these uncertain fields: "), F.array_join(F.transform("b", lambda x: x["field"]), ", "))
    text = F.concat(F.array(F.lit("Extract freight-bill fields from this scanned page."), focus, *map(F.lit, ASK)), F.flatten(F.transform("b", lambda x: x["lines"])))
    return blocks.select("doc_id", S.strip(F.array_join(text, "\n")).alias("prompt"))

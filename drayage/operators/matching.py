"""Entity matching: aliases, gazetteer, ZIP and street hints, and what must not stand in a party or a destination.

The tables of names, aliases, ZIPs and streets are small by nature (a person
keeps them); each is joined by key, and broadcast by Spark where its size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drayage.functions import seeds
from drayage.functions import shapes as S
from drayage.functions.exprs import collapse, glyph_repair
from drayage.functions.fuzzy import similarity

# Least similarity of a match, of a near miss, and of a street.
MATCH, NEAR, STREET = 0.86, 0.80, 0.84


def resolve_aliases(values: DataFrame, aliases: DataFrame) -> DataFrame:
    """``values`` (id, field, value) with ``alias``: of the first variant that ``aliases`` (field, alias_key, canonical) has, else by rule."""
    v = values.select("id", "field", F.posexplode(S.name_variants(F.col("value"))).alias("ord", "variant")).withColumn("alias_key", collapse(F.col("variant")))
    hit = v.join(aliases, ["field", "alias_key"]).groupBy("id", "field").agg(F.min_by("canonical", "ord").alias("found"))
    key = collapse(F.col("value"))
    rule = (F.col("field") == "consignor") & (key.contains("planethooper") & (key != "cleanplanethooper") | key.endswith("planet") & (F.length(key) >= 8))
    return values.join(hit, ["id", "field"], "left").withColumn("alias", F.coalesce("found", F.when(rule, "Clean Planet Hooper"))).drop("found")


def _first_word(c: Column) -> Column:
    return F.get(F.split(S.strip(c), r"[,\s]+"), F.lit(0))


def scored(pairs: DataFrame) -> DataFrame:
    """``pairs`` (…, value, name, ord) with ``score``, the best of all variants of the value, and words of it that are nearly the name's first."""
    keep = pairs.columns
    v = pairs.withColumn("variant", F.explode(S.name_variants(F.col("value")))).withColumn("first", _first_word(F.col("name")))
    v = v.withColumns({"a": collapse(F.col("variant")), "b": collapse(F.col("name")), "w": collapse(F.col("first"))})
    v = v.withColumns({"s": similarity(F.col("a"), F.col("b")), "t": similarity(F.col("a"), F.col("w")), "words": F.transform(F.regexp_extract_all("variant", F.lit("[A-Za-z]{6,}"), F.lit(0)), collapse)})
    long = (F.length("a") >= 6) & (F.length("w") >= 6)
    whole = F.when(long & F.col("t").between(0.86, 0.99899999), F.col("t"))
    v = v.withColumn("s", F.greatest("s", F.coalesce(whole, F.lit(0.0)))).withColumn("words", F.when(long & whole.isNull(), F.col("words")).otherwise(F.array().cast("array<string>")))
    v = v.withColumn("word", F.explode_outer("words")).withColumn("u", F.coalesce(similarity(F.col("word"), F.col("w")), F.lit(0.0)))
    v = v.withColumn("s", F.greatest("s", F.when(F.col("u").between(0.82, 0.99899999), F.greatest("u", F.lit(0.88))).otherwise(0.0)))
    return v.groupBy(*keep).agg(F.max("s").alias("score"))


def gazetteer_match(values: DataFrame, names: DataFrame, least: float = MATCH) -> DataFrame:
    """``values`` (id, field, value) with ``match``: the name of ``names`` (field, ord, name) that it stands for, or null.

    Best score, then the longer name, then the first. A longer value isn't cut
    down to a name inside of it, and a short place isn't made a street.
    """
    ok = ~S.is_header(F.col("value")) & ~S.is_junk(F.col("value")) & ~S.strip(F.col("value")).rlike(r"^\d{3,}$")
    pairs = values.where(ok).select("id", "field", S.strip(F.col("value")).alias("value")).join(names, "field")
    best = Window.partitionBy("id", "field").orderBy(F.desc("score"), F.desc(F.length(collapse(F.col("name")))), "ord")
    every = scored(pairs)
    a, b = collapse(F.col("value")), collapse(F.col("name"))
    place = F.when(b == a, F.struct(F.lit(0).alias("k"), F.col("ord"), F.col("name"))).when(F.col("name").contains(",") & b.startswith(a), F.struct(F.lit(1).alias("k"), F.col("ord"), F.col("name")))
    top = every.withColumns({"r": F.row_number().over(best), "other": F.min(place).over(Window.partitionBy("id", "field"))["name"]}).where(F.col("r") == 1).where(F.col("score") >= least)
    inside = b.isNotNull() & a.contains(b) & (F.length(a) > F.length(b) + 2)
    around = (a != b) & b.contains(a) & (F.length(b) > F.length(a) + 2)
    found = top.select("id", "field", F.when(inside, None).when(around, F.col("other")).otherwise(F.col("name")).alias("match"))
    return values.join(found, ["id", "field"], "left")


def near_miss(matched: DataFrame) -> Column:
    """Whether a match at ``NEAR`` is another name than the value."""
    return F.coalesce(collapse(F.col("match")) != collapse(F.col("value")), F.lit(False))


def zip_hint(places: DataFrame, zips: DataFrame) -> DataFrame:
    """``places`` (id, field, value) with ``hinted``: the place as ``zips`` (zip, city, state) has its ZIP, or as it was."""
    p = places.withColumn("zip", S.zip_code(F.col("value"))).join(zips, "zip", "left")
    street, raw = S.street(F.col("value")), S.strip(F.col("value"))
    full = F.concat_ws(" ", F.concat_ws(", ", F.col("city"), F.col("state")), F.col("zip"))
    said = collapse(F.col("value")).contains(collapse(F.col("city"))) & F.lower(F.col("value")).contains(F.lower("state"))
    return p.select("id", "field", "value", F.when(F.col("city").isNull() | (raw == ""), F.col("value")).when(street.isNotNull(), F.concat_ws(", ", street, full)).when(said, F.col("value")).otherwise(full).alias("hinted"))


def street_hint(places: DataFrame, zips: DataFrame, by_zip: DataFrame, by_city: DataFrame) -> DataFrame:
    """``places`` (id, field, value) with ``hinted``: its street as ``by_zip`` (zip, street, ord), or ``by_city`` (city, street, ord), knows it.

    Streets of the ZIP and of its city come first; only a place that has none of
    them is looked up by the cities that its text names.
    """
    p = places.where(S.street(F.col("value")).isNotNull()).select("id", "field", S.strip(F.col("value")).alias("raw"), S.street(F.col("value")).alias("value"), S.zip_code(F.col("value")).alias("zip"))
    p = p.join(zips.withColumnRenamed("city", "zip_city"), "zip", "left")
    c = by_city.withColumnRenamed("city", "known")
    own = p.join(by_zip, "zip").select("id", "field", "value", F.col("street").alias("name"), "ord", F.col("zip_city").alias("city"), "state", "zip")
    own = own.unionByName(p.join(c, F.lower("zip_city") == F.col("known")).select("id", "field", "value", F.col("street").alias("name"), (F.col("ord") + 100).alias("ord"), F.col("zip_city").alias("city"), "state", "zip"))
    free = p.join(own.select("id", "field").distinct(), ["id", "field"], "left_anti").join(c, F.contains(collapse(F.col("raw")), collapse(F.col("known"))))
    none = F.lit(None).cast("string")
    named = free.select("id", "field", "value", F.col("street").alias("name"), "ord", F.initcap("known").alias("city"), none.alias("state"), none.alias("zip"))
    pool = own.unionByName(named)
    hit = _pool_match(pool)
    where = pool.groupBy("id", "field").agg(F.last("city").alias("city"), F.max("state").alias("state"), F.max("zip").alias("zip"))
    out = places.join(hit.join(where, ["id", "field"]), ["id", "field"], "left")
    text = F.when(F.col("zip").isNotNull() & F.col("city").isNotNull() & F.col("state").isNotNull(), F.concat(F.concat_ws(", ", "match", "city", "state"), F.lit(" "), F.col("zip"))).otherwise(F.concat_ws(", ", "match", "city"))
    return out.select(*places.columns, F.when(F.col("match").isNotNull(), text).otherwise(places["value"]).alias("hinted"))


def _pool_match(pool: DataFrame) -> DataFrame:
    """(id, field, match): the best of each row's own pool of names."""
    s = scored(pool.select("id", "field", "value", "name", "ord").where(~S.is_junk(F.col("value"))))
    a, b = collapse(F.col("value")), collapse(F.col("name"))
    best = Window.partitionBy("id", "field").orderBy(F.desc("score"), F.desc(F.length(b)), "ord")
    top = s.withColumn("r", F.row_number().over(best)).where((F.col("r") == 1) & (F.col("score") >= STREET))
    keep = ~(a.contains(b) & (F.length(a) > F.length(b) + 2)) & ~((a != b) & b.contains(a) & (F.length(b) > F.length(a) + 2))
    return top.where(keep).select("id", "field", F.col("name").alias("match"))


def state_of(places: DataFrame, zips: DataFrame) -> DataFrame:
    """``places`` (id, field, value) with ``state``: by ZIP, else by ``, XX``, else by a city of the region that it names."""
    v = S.strip(F.col("value"))
    said = F.upper(F.regexp_extract(v, r",\s*([A-Za-z]{2})\b", 1))
    known = zips.select("zip", F.col("state").alias("by_zip"))
    p = places.withColumn("zip", S.zip_code(v)).join(known, "zip", "left")
    cities = zips.groupBy(collapse(F.col("city")).alias("key")).agg(F.min(F.struct("zip", "state")).alias("c")).where(F.length("key") >= 5)
    named = places.select("id", "field", collapse(F.col("value")).alias("own")).join(cities, F.contains("own", "key")).groupBy("id", "field").agg(F.min("c")["state"].alias("by_city"))
    p = p.join(named, ["id", "field"], "left")
    return p.select("id", "field", "value", F.upper(F.coalesce("by_zip", F.when(said.isin(seeds.STATES), said), "by_city")).alias("state"))


def destination_evidence(bills: DataFrame, names: DataFrame) -> DataFrame:
    """(id, better): the longest known destination that the bill's other texts name and that isn't copied from its origin."""
    blob = collapse(F.concat_ws(" ", "consignee", "special_instructions", "commodity_description"))
    known = names.where(F.col("field") == "destination").select("ord", "name", collapse(F.col("name")).alias("key")).where(F.length("key") >= 6)
    hit = bills.select("id", "origin", blob.alias("blob")).join(known, F.contains("blob", "key")).where(~S.copied_destination(F.col("origin"), F.col("name")))
    return hit.groupBy("id").agg(F.max_by("name", F.struct(F.length("key"), -F.col("ord"))).alias("better"))


def repair_destination(bills: DataFrame, names: DataFrame) -> DataFrame:
    """``bills`` (id, origin, destination, …): a copied destination becomes what else the bill names, or null."""
    better = destination_evidence(bills, names)
    copied = S.copied_destination(F.col("origin"), F.col("destination"))
    return bills.join(better, "id", "left").withColumn("destination", F.when(copied, F.col("better")).otherwise(F.col("destination"))).drop("better")


def clear_letterhead(bills: DataFrame, names: DataFrame) -> DataFrame:
    """``bills``: consignor and consignee are null where they repeat the bill's carrier or any known one."""
    keys = F.array(*[F.lit(k) for k in sorted({"".join(ch for ch in n.lower() if ch.isascii() and ch.isalnum() or ch == "&") for n in seeds.NAMES["carrier"]})])
    known = names.where(F.col("field") == "carrier").select(collapse(F.col("name")).alias("key")).where("key <> ''").distinct()
    for party in ("consignor", "consignee"):
        own = collapse(F.col(party))
        flag = known.withColumn("is_carrier", F.lit(True))
        bills = bills.join(flag, own == F.col("key"), "left").withColumn(party, F.when(F.col("is_carrier").isNotNull() | F.array_contains(keys, own) & (own != "") | (own == collapse(F.col("carrier"))) & (own != ""), None).otherwise(F.col(party))).drop("key", "is_carrier")
    return bills


def id_glyphs(c: Column) -> Column:
    """``glyph_repair`` on an id that has a digit; a header stays."""
    return F.when(S.is_header(c) | ~c.rlike("[0-9]"), S.strip(c)).otherwise(glyph_repair(S.strip(c)))


def apply_entity_matching(bills: DataFrame, names: DataFrame, aliases: DataFrame, zips: DataFrame, by_zip: DataFrame, by_city: DataFrame) -> DataFrame:
    """All of matching on ``bills`` (id, and fields as columns): ids, aliases, names, ZIPs, streets, destination, letterhead."""
    ids = [c for c in ("bill_number", "invoice_number", "vehicle_number") if c in bills.columns]
    bills = bills.withColumns({c: id_glyphs(F.col(c)) for c in ids})
    fields = [c for c in seeds.NAMES if c in bills.columns]
    long = bills.unpivot("id", fields, "field", "value").where("value IS NOT NULL AND value <> ''")
    step = resolve_aliases(long, aliases)
    match = gazetteer_match(long, names).withColumnRenamed("match", "name").select("id", "field", "name")
    step = step.join(match, ["id", "field"], "left").select("id", "field", F.when(F.col("alias").isNotNull() & (F.col("alias") != F.col("value")), F.col("alias")).otherwise(F.coalesce("name", "value")).alias("value"))
    places = step.where(F.col("field").isin("origin", "destination"))
    places = zip_hint(places, zips).select("id", "field", F.col("hinted").alias("value"))
    places = street_hint(places, zips, by_zip, by_city).select("id", "field", F.col("hinted").alias("value"))
    step = step.where(~F.col("field").isin("origin", "destination")).unionByName(places)
    wide = step.groupBy("id").pivot("field", fields).agg(F.first("value"))
    out = bills.drop(*fields).join(wide, "id", "left")
    for c in ("special_instructions", "commodity_description", "consignor", "consignee", "carrier", "origin", "destination"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    return clear_letterhead(repair_destination(out, names), names)

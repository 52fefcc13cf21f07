"""Personal data in texts, and terms that reveal it, by DataFrame functions alone.

Base spans (e-mail, IP address, card and phone numbers) come from patterns. The
sanitisation is information-theoretic: protected entities are the values found;
a term in a document that holds an entity, wherever it stands there, reveals it
as far as the corpus says so. With p the share of the documents with the term
that hold the entity too, the pointwise mutual information of the two is
IC(entity) + log2 p; a term is disclosing where that is at least ``alpha`` of
IC(entity), the entity's own information. Terms need the support of ``support``
different texts, counted exactly, so that copies of one text don't make its
words disclosing.

Patterns are written so that no text makes them backtrack: possessive runs, and
look-behinds that let a match begin only where the leftmost would.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drayage.llm.store import cut, spare

_LOCAL = "[A-Za-z0-9._%+-]"
#: Kinds in their order. Equal in what they match to the plain forms of the contract, but linear in time.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a term that is not an entity is put in place of, and entities by kind.
GENERAL = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>", "term": "<TERM>"}
KINDS = [*PATTERNS, "term"]
#: Terms: runs of letters or digits of three or more.
TERM = r"[\p{L}\p{N}]{3,}"
SUPPORT, ALPHA = 3, 0.95


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    at = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + F.when(i % 2 == 0, at(i)).otherwise(F.when(at(i) > 4, 2 * at(i) - 9).otherwise(2 * at(i))))
    return total % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        # a part of more than three digits is over 255 unless it begins with zeros
        return F.forall(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    d = _digits(m)
    if kind == "card":
        return F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(d).between(10, 15)
    return F.lit(True)


def _scan(values: Column, op, zero: int = 0) -> Column:
    """What precedes each element, put together by ``op``: in runs of 256, so that no array is copied for each element."""
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) + 255) / 256).cast("int") - 1), lambda c: F.slice(values, c * 256 + 1, F.lit(256)))
    state = F.struct(F.lit(zero).alias("at"), F.array().cast("array<int>").alias("out"))
    before = lambda xs: F.aggregate(xs, state, lambda a, x: F.struct(op(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
    whole = before(F.transform(runs, lambda r: F.aggregate(r, F.lit(zero), op)))
    parts = F.zip_with(runs, whole, lambda r, w: F.transform(before(r), lambda v: op(w, v)))
    return F.when(F.size(values) > 0, F.flatten(parts)).otherwise(F.array().cast("array<int>"))


def _spans(text: Column, kind: str, pattern: str, order: int) -> Column:
    """array of (start, ord, end, value), in code points: what lies between matches gives their places."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.filter(F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("g"), m.alias("m"))), lambda s: s["m"].isNotNull())
    before = _scan(F.transform(steps, lambda s: s["g"] + F.length(s["m"])), lambda a, b: a + b)
    placed = F.zip_with(steps, before, lambda s, at: F.struct((at + s["g"]).alias("start"), F.lit(order).alias("ord"), (at + s["g"] + F.length(s["m"])).alias("end"), s["m"].alias("value")))
    return F.filter(placed, lambda s: _valid(kind, s["value"]))


#: A sign that a kind can't do without, so that most texts are not searched twice.
_SIGNS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}


def base_spans(text: Column) -> Column:
    """All base spans by start, then kind."""
    none = F.array().cast("array<struct<start:int,ord:int,end:int,value:string>>")
    kinds = [F.when(text.rlike(_SIGNS[k]), _spans(text, k, p, i)).otherwise(none) for i, (k, p) in enumerate(PATTERNS.items())]
    return F.array_sort(F.concat(*kinds))


def _listed(spans: Column, kinds: list[str]) -> Column:
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["ord"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _terms(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(TERM), F.lit(0)))


def disclosing(found: DataFrame, docs: DataFrame, support: int = SUPPORT, alpha: float = ALPHA) -> DataFrame:
    """(entity, term) of the terms that disclose an entity; ``found`` (row, text, base), ``docs`` (text)."""
    n = docs.count()
    found = found.where(F.size("base") > 0).withColumn("t", F.xxhash64("text"))
    # documents of each entity, by text: copies are put together before terms are made
    one = found.select("row", "t", F.explode(F.transform("base", lambda s: F.lower(s["value"]))).alias("entity")).distinct()
    holds = one.groupBy("entity", "t").agg(F.count("*").alias("docs"))
    # only entities that occur often enough to support anything
    often = holds.groupBy("entity").agg(F.count("*").alias("texts"), F.sum("docs").alias("df")).where(F.col("texts") >= support).select("entity", "df")
    of_text = holds.join(often, "entity").groupBy("t").agg(F.collect_list(F.struct("entity", "df", "docs")).alias("held"))
    # the terms of a text are those of what lies between its entities
    text, base = F.col("text"), F.col("base")
    done = _scan(F.transform(base, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    between = F.zip_with(base, done, lambda s, at: F.when(s["start"] > at, F.substring(text, at + 1, s["start"] - at)).otherwise(""))
    rest = F.concat_ws("\n", between, F.substring(text, F.array_max(F.transform(base, lambda s: s["end"])) + 1, F.length(text)))
    pairs = found.select("t", "text", "base").dropDuplicates(["t"]).join(of_text, "t").select("held", F.explode(_terms(rest)).alias("term")).select("term", F.explode("held").alias("e"))
    beside = pairs.groupBy(F.col("e.entity").alias("entity"), "term").agg(F.first("e.df").alias("df"), F.sum("e.docs").alias("both"), F.count("*").alias("texts")).where(F.col("texts") >= support)
    beside = cut(beside)
    if beside.isEmpty():
        return beside.select("entity", "term")
    # documents with each term: over the whole corpus, summed by task before the shuffle
    df = docs.select(F.explode(_terms(F.coalesce("text", F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("with_term"))
    ic = F.log2(F.lit(float(n)) / F.col("df"))
    pmi = ic + F.log2(F.col("both") / F.col("with_term"))
    return beside.join(df, "term").where((ic > 0) & (pmi >= alpha * ic)).select("entity", "term")


def find(docs: DataFrame, support: int = SUPPORT, alpha: float = ALPHA) -> tuple[DataFrame, Column, Column, Column]:
    """``docs`` with columns of its own, and these: text, base spans, and those with the terms that disclose them.

    A null text is empty. A disclosing term is a span of kind ``term`` wherever
    it stands, as a whole word, in a document that holds the entity. Spans of a
    term within a base span are left out. Rows may repeat, and lack a doc_id; all
    columns stay, whatever they are called. Only documents with base spans are
    kept aside and joined with the terms; all others go straight through.
    """
    names = docs.columns
    text, base, all_, row, terms = spare(names, "plain", "base", "spans", "row", "terms")
    own = F.coalesce("text", F.lit(""))
    none = F.array().cast("array<struct<start:int,ord:int,end:int,value:string>>")
    key = F.xxhash64("text", F.col("doc_id") if "doc_id" in names else F.lit(0))
    hits = cut(docs.withColumn(base, base_spans(own)).where(F.size(base) > 0).withColumn(row, key))
    plain = docs.where(F.size(base_spans(own)) == 0).select(*names, own.alias(text), none.alias(base), none.alias(all_))
    found = hits.select(F.col(row).alias("row"), "text", F.col(base).alias("base"))
    reveal = disclosing(found, docs.select("text"), support, alpha)
    mine = found.select("row", F.explode(F.transform("base", lambda s: F.lower(s["value"]))).alias("entity")).join(reveal, "entity").groupBy(F.col("row").alias(row)).agg(F.collect_set("term").alias(terms))
    out = hits.join(mine, row, "left")
    # words and what lies between them give the places of the terms
    words = _spans(F.col("text"), "term", r"[\p{L}\p{N}]++", len(PATTERNS))
    t = F.col(terms)
    at = F.filter(words, lambda s: F.array_contains(t, F.lower(s["value"])) & ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    spans = F.when(t.isNull(), F.col(base)).otherwise(F.array_sort(F.concat(base, at)))
    out = out.select(*names, F.col("text").alias(text), base, spans.alias(all_))
    return plain.unionByName(out), F.col(text), F.col(base), F.col(all_)


def report(documents: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and spans for every row."""
    f, _, base, spans = find(documents.select("doc_id", "text"))
    count = lambda i: F.size(F.filter(base, lambda s: s["ord"] == i)).cast("long")
    return f.select(
        F.col("doc_id").cast("long").alias("doc_id"), *[count(i).alias(f"n_{k}") for i, k in enumerate(PATTERNS)],
        F.sha2(_listed(base, KINDS).cast("binary"), 256).alias("base_sha256"), _listed(spans, KINDS).alias("spans"),
    )


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with every span put in general terms; texts without spans, and all other columns, stay; n_chars is made to fit."""
    f, text, _, spans = find(docs)
    names = F.array(*[F.lit(GENERAL[k]) for k in KINDS])
    done = _scan(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    # a span that begins in what is already replaced goes with it
    pieces = F.zip_with(spans, done, lambda s, at: F.when(s["start"] >= at, F.concat(F.substring(text, at + 1, s["start"] - at), F.element_at(names, s["ord"] + 1))).otherwise(""))
    walk = F.concat(F.array_join(pieces, ""), F.substring(text, F.array_max(F.transform(spans, lambda s: s["end"])) + 1, F.length(text)))
    f = f.withColumn("text", F.when(F.size(spans) > 0, walk).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        f = f.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return f.select(*docs.columns)

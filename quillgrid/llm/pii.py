"""Personal data found by pattern, and the terms around it that give it away, in DataFrame operations only.

Patterns find the base kinds (e-mail and IP addresses, card and phone numbers). Every value found is an entity
to protect. The corpus then tells how strongly a term, a run of letters of any length, reveals an entity: with
n(t) occurrences of a term in all texts, n(t, e) of them in texts that hold the entity, n(e) occurrences of the
entity and N terms in all, copies of a text with entities counting once, the pointwise mutual information PMI(t; e) = log(N n(t, e) / (n(t) n(e))) is compared
with the information IC(e) = log(N / n(e)) of the entity itself. A term whose PMI reaches GENERALISE of the
entity's information is generalised to its kind (a name, a code with digits, another term) wherever it stands in a
text that holds the entity, one that reaches REMOVE is removed; a term needs two such texts that
differ. Parts of base values are not terms.

Entities that the same texts hold differ by n(e) alone, and a term that reaches a share for one of them reaches it
for the rarest: they are one group with the least n(e), so that a text with many values of its own, or copies of
it, is met once a term, not once a term and value.

Positions come from two regular passes that stop at the same places: the pieces between matches (split) and the
matches themselves. Patterns start at the front of a run of characters or where the last match ended, and
don't step back, so that a text is read in time in proportion to its length; they match what the plain ones do.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, fresh, written

KINDS = ("email", "ip", "card", "phone", "general", "remove")
PATTERNS = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[ -]?[0-9])++",
    r"\+[0-9][ ().0-9-]+[0-9]",
)
TERM = r"\p{L}[\p{L}\p{M}\p{N}]*+"
#: Pieces that together are a text and don't cut a term; terms are placed piece by piece, in linear time.
_PIECE = r"(?s).{1,400}+[\p{L}\p{M}\p{N}]*+"
GENERALISE, REMOVE = 0.9, 0.99
MASKS = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "", "")

_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def placed(text: Column, pattern: str) -> Column:
    """array<struct<start, value>> of a pattern's matches; starts count code points from 0."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    # element by element, the length of the piece before each match
    pairs = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.struct(F.length(p).alias("gap"), m.alias("m")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,value:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        here = acc["at"] + x["gap"]
        return F.struct((here + F.length(x["m"])).alias("at"), F.concat(acc["out"], F.array(F.struct(here.alias("start"), x["m"].alias("value")))).alias("out"))

    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def _number(digits: Column) -> Column:
    return F.when(digits == "", F.lit(0)).otherwise(digits.cast("int"))


def luhn(digits: Column) -> Column:
    """Whether a string of digits has the right check digit."""
    each = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    doubled = F.transform(each, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _holds(kind: int, value: Column) -> Column:
    if kind == 0:
        return F.lit(True)
    if kind == 1:
        bare = lambda x: F.regexp_replace(x, "^0+", "")
        return F.forall(F.split(value, r"\."), lambda x: F.when(F.length(bare(x)) > 3, False).otherwise(_number(bare(x)) <= 255))
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    return F.when(n.between(14, 19), luhn(digits)).otherwise(False) if kind == 2 else n.between(10, 15)


def base_spans(text: Column) -> Column:
    """All base spans of a text (null: none), by start, then kind: array<struct<start, kind, end, value>>."""
    none = F.array().cast(_SPAN)
    digit = text.rlike("[0-9]")
    guards = (F.contains(text, F.lit("@")), digit, digit, F.contains(text, F.lit("+")))

    def of(kind: int) -> Column:
        span = lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), (x["start"] + F.length(x["value"])).alias("end"), x["value"].alias("value"))
        return F.when(guards[kind], F.filter(F.transform(placed(text, PATTERNS[kind]), span), lambda s: _holds(kind, s["value"]))).otherwise(none)

    return F.array_sort(F.concat(*map(of, range(4))))


def _blanked(text: Column, base: Column) -> Column:
    """text with a space for each character of its base spans."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        blanks = F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(acc["at"], s["start"]), F.lit(0)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap, blanks).alias("out"))

    whole = F.aggregate(base, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(base) > 0, whole).otherwise(text)


def _places(text: Column) -> Column:
    """array<struct<term, start, end>>: all terms of a text, in lower case."""

    def piece(p: Column) -> Column:
        at = lambda x: p["start"] + x["start"]
        return F.transform(placed(p["value"], TERM), lambda x: F.struct(F.lower(x["value"]).alias("term"), at(x).alias("start"), (at(x) + F.length(x["value"])).alias("end")))

    return F.flatten(F.transform(placed(text, _PIECE), piece))


def _groups(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, groups) of the texts with an entity and (group, n_e): entities that the same texts hold are a group."""
    places = rows.select("key", F.explode("base").alias("b")).select(F.xxhash64("b.kind", "b.value").alias("entity"), "key", "b.start").distinct()  # copies once
    held = written(places.groupBy("entity", "key").agg(F.count("*").alias("n")), "entities")
    texts = F.xxhash64(F.bit_xor(F.xxhash64("key")), F.bit_xor(F.xxhash64("key", F.lit(1))), F.count("*"))
    entities = written(held.groupBy("entity").agg(texts.alias("group"), F.sum("n").alias("n_e")), "groups")
    of = held.select("entity", "key").join(entities.select("entity", "group"), "entity").groupBy("key").agg(F.collect_set("group").alias("groups"))
    return of, entities.groupBy("group").agg(F.min("n_e").alias("n_e"))


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """docs with ``base`` and ``more``: arrays of struct<start, kind, end> (kind: a place in KINDS).

    Null texts are empty. Rows are treated by their text alone, whatever their ids, so equal texts have equal
    spans. A place that several entities reveal has the stronger kind; texts of any length are read as they are. keep_text: carry all columns (those named base or more are replaced), otherwise the id alone.
    """
    keep = [c for c in docs.columns if c.lower() not in ("base", "more")] if keep_text else [id_col]
    text, key, blank, of, added = (fresh(docs, x) for x in ("text", "key", "blank", "of", "added"))
    rows = docs.select(*map(col, keep), F.coalesce(col(text_col).cast("string"), F.lit("")).alias(text), F.md5(F.coalesce(col(text_col).cast("string"), F.lit("")).cast("binary")).alias(key))
    rows = rows.withColumn("base", base_spans(col(text)))
    rows = rows.withColumn(blank, F.when(F.size("base") > 0, F.struct(col(text).alias("text"), _blanked(col(text), F.col("base")).alias("blank"))))
    rows = written(rows.drop(text), "spans")

    holding = rows.where(F.size("base") > 0).select(col(key).alias("key"), "base", col(blank).alias("t"))
    of_text, n_e = _groups(holding)
    texts = holding.groupBy("key").agg(F.max("t").alias("t"), F.count("*").alias("times")).join(of_text, "key").select("key", "t.*", "times", "groups")
    texts = written(texts.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key"), "texts")
    # explode_outer: plain explode evaluates its array three times, for a filter too
    each = lambda name: F.explode_outer(F.regexp_extract_all(col(name).cast("string"), F.lit(TERM), F.lit(0))).alias("term")
    said = texts.select("groups", F.xxhash64("key").alias("text"), each("blank"))
    pairs = said.select(F.explode("groups").alias("group"), F.lower("term").alias("term"), "text").groupBy("group", "term")
    pairs = pairs.agg(F.count("*").alias("n_te"), F.min("text").alias("one"), F.max("text").alias("other")).where("one != other").drop("one", "other")
    pairs = written(pairs.join(n_e, "group"), "pairs")
    # all terms of all texts, less those of texts with an entity, and once their terms outside base values
    terms = docs.select(each(text_col), F.lit(1).cast("long").alias("n")).unionAll(texts.select(each("text"), -F.col("times"))).unionAll(texts.select(each("blank"), F.lit(1).cast("long")))
    terms = terms.where("term is not null").groupBy(F.lower("term").alias("term")).agg(F.sum("n").alias("n_t")).where("n_t > 0")
    terms = written(terms, "terms")
    total = terms.agg(F.sum("n_t")).first()[0] or 1
    told = pairs.join(terms, "term").withColumn("told", 1 - F.log(F.greatest(F.col("n_t") / F.col("n_te"), F.lit(1.0))) / F.log(F.greatest(F.lit(float(total)) / F.col("n_e"), F.lit(math.e))))
    told = told.where(F.col("told") >= GENERALISE).select("group", "term", F.when(F.col("told") >= REMOVE, 5).otherwise(4).alias("kind"))
    told = written(told, "told")  # a table, so that the join below may split a term of many texts
    places = texts.select("key", "groups", F.explode_outer(_places(F.col("blank"))).alias("p")).select("key", F.explode("groups").alias("group"), "p.*")
    more = places.join(told, ["group", "term"]).groupBy("key", "start", "end").agg(F.max("kind").alias("kind"))
    more = more.groupBy("key").agg(F.collect_list(F.struct("start", "kind", "end")).alias(added)).withColumnRenamed("key", of)
    more = more.withColumn(added, F.array_sort(added))
    more = written(more, "revealing")
    bare = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end")))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    # only rows with an entity meet their terms: no other text is shuffled
    met = rows.where(F.size("base") > 0).join(more, col(key) == col(of), "left").select(*map(col, keep), bare.alias("base"), F.coalesce(col(added), empty).alias("more"))
    return met.unionByName(rows.where(F.size("base") == 0).select(*map(col, keep), bare.alias("base"), empty.alias("more")))


def joined(spans: Column) -> Column:
    """kind:start:end of spans in their order, comma-joined."""
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """text with every span replaced by its mask; a span that another has covered adds nothing."""
    name = F.array(*map(F.lit, MASKS))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        said = F.substring(text, s["start"] + 1, s["end"] - s["start"])
        general = F.when(said.rlike(r"\p{N}"), "[CODE]").when(said.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[TERM]")
        mask = F.when(s["start"] >= acc["at"], F.when(s["kind"] == 4, general).otherwise(F.element_at(name, s["kind"] + 1))).otherwise("")
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap, mask).alias("out"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with their texts masked and, where there is such a column, their lengths counted anew."""
    own = {c: fresh(docs, c.lower()) for c in docs.columns if c.lower() in ("base", "more")}
    renamed = docs.withColumnsRenamed(own) if own else docs
    rows = found(renamed, id_col, text_col, True)
    spans = F.array_sort(F.concat("base", "more"))
    rows = rows.withColumn(text_col, F.when(F.size(spans) > 0, masked(col(text_col), spans)).otherwise(col(text_col)))
    if length_col in docs.columns:
        rows = rows.withColumn(length_col, F.length(col(text_col)).cast(dict(docs.dtypes)[length_col]))
    return rows.select(*(col(own.get(c, c)).alias(c) for c in docs.columns))

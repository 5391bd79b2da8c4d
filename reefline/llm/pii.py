"""Personal data by patterns and by what terms reveal about it, in DataFrame expressions only.

Patterns find e-mail addresses, IP addresses, card and phone numbers.  Then
corpus co-occurrence, with the document as its unit, estimates how strongly a
term reveals each found value (the protected entity).  The chance of the entity
given the term, smoothed towards the entity's share of all documents, over that
share is their mutual information; over the information content of the entity it
is the share of the entity that the term discloses.  A term that discloses more
than the threshold is marked wherever it stands in the documents of that entity.
``redacted`` replaces marked spans by their kind (values) or removes them (terms).

Patterns are written so that a run of characters is tried once (possessive
repetition; a match starts at the start of a run or where the match before it
ended), which keeps long junk linear and needs no deep recursion.  Matches become
rows, and their places running sums of lengths, so a text with many matches costs
as much as many texts with one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import ROW, keep, numbered, whole_text

# The patterns, in the order in which kinds are listed.
KINDS = ("email", "ip", "card", "phone", "term")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BYTE = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
TERM = r"\p{L}{3,}"
DISCLOSED = 0.9         # share of the entity's information that marks a term
PRIOR = 0.5             # documents of prior weight: a term seen once is no certain sign

MATCH = "struct<kind:string,i:int,before:int,value:string>"


def matches(text: Column, pattern: str, kind: str) -> Column:
    """Non-overlapping matches from the left, as an array of ``MATCH``: number, code points since the match before, and the match."""
    pieces = F.arrays_zip(F.transform(F.split(text, pattern, -1), F.length).alias("before"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("value"))
    return F.transform(F.filter(pieces, lambda z: z["value"].isNotNull()), lambda z, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("i"), z["before"].alias("before"), z["value"].alias("value")))


def placed(rows: DataFrame, column: str = "m") -> DataFrame:
    """``(*ROW, kind, value, start, end)`` of rows that hold one ``MATCH`` each: running sums over the matches of a text and kind."""
    so_far = W.partitionBy(*ROW, "kind").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    each = rows.select(*ROW, f"{column}.*")
    return each.withColumn("end", F.sum(F.col("before") + F.length("value")).over(so_far).cast("int")) \
        .select(*ROW, "kind", "value", (F.col("end") - F.length("value")).alias("start"), "end")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))

    def add(total: Column, i: Column) -> Column:
        d = digits.substr(i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


#: What a match must fulfil, and a cheap test that every text with a match passes.
VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), lambda part: part.rlike(BYTE)),
    "card": lambda v: F.length(_digits(v)).between(14, 19) & F.coalesce(F.when(F.length(_digits(v)).between(14, 19), _luhn(v)), F.lit(False)),
    "phone": lambda v: F.length(_digits(v)).between(10, 15),
}
LIKELY = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"),
    "phone": lambda t: t.contains("+"),
}


def pattern_matches(text: Column, kind: str) -> Column:
    """All matches of one kind, or none if none of them is valid."""
    found = matches(text, PATTERNS[kind], kind)
    return F.when(LIKELY[kind](text), F.when(F.exists(F.regexp_extract_all(text, F.lit(PATTERNS[kind]), 0), lambda v: VALID[kind](v)), found)) \
        .otherwise(F.array().cast(f"array<{MATCH}>"))


def disclosing_terms(entities: DataFrame, terms: DataFrame, docs: DataFrame, text: str, disclosed: float = DISCLOSED) -> DataFrame:
    """``(*ROW, term)``: the terms that reveal an entity of that document, from ``entities(*ROW, kind, value)``,
    ``terms(*ROW, term)`` of the documents with entities, and all texts.

    Entities of the same documents have the same terms, so they are judged as one class.  A term that stands in too
    many documents for any entity of a document to be disclosed is left out before terms meet entities."""
    n = docs.count()
    if n == 0:
        return terms.limit(0)
    of_term = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(whole_text(text)), F.lit(TERM), 0))).alias("_term")) \
        .groupBy("_term").agg(F.count(F.lit(1)).alias("with_term"))
    held = entities.distinct()
    mark = F.xxhash64(*ROW).cast("decimal(38,0)")
    per = held.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("with_entity"), F.sum(mark).alias("where"))
    classes = held.join(per.withColumnsRenamed({"kind": "_kind", "value": "_value"}), (F.col("kind") == F.col("_kind")) & (F.col("value") == F.col("_value"))) \
        .select(*ROW, "with_entity", "where").distinct()
    share = F.col("with_entity") / F.lit(float(n))
    # together <= with_entity bounds how frequent a term may be
    bound = F.col("with_entity") / F.pow(share, F.lit(1 - disclosed))
    classes = keep(classes.where(share < 1).withColumn("bound", bound))
    largest = classes.agg(F.coalesce(F.max("bound"), F.lit(0.0)).alias("b")).scalar()
    rare = terms.distinct().join(of_term.where(F.col("with_term") <= largest), F.col("term") == F.col("_term")).select(*ROW, "term", "with_term")
    pairs = keep(rare.join(classes, list(ROW)).where(F.col("with_term") <= F.col("bound")).select(*ROW, "term", "with_term", "with_entity", "where"))
    of_pair = ["term", "where", "with_entity", "with_term"]
    given = (F.col("together") + F.lit(PRIOR) * share) / (F.col("with_term") + F.lit(PRIOR))
    revealing = pairs.groupBy(*of_pair).agg(F.count(F.lit(1)).alias("together")) \
        .where(F.log2(given / share) >= F.lit(disclosed) * F.log2(1 / share))
    return pairs.join(revealing, of_pair, "left_semi").select(*ROW, "term").distinct()


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, spans)``, one row per row of ``docs``: ``spans`` are ``(start, rank, end, kind)`` by start, then kind.

    Places count code points, end exclusive; ``rank`` is the place of the kind in
    ``KINDS``.  Pattern spans come first in full; terms that overlap one are left
    out.  Null and empty texts have no spans.  A document counts once for a term
    or an entity however often it has it; repeated rows count each.  An entity in
    all documents discloses nothing.  Extra columns are not read; an empty table gives an empty one."""
    rows = numbered(docs)
    texts = rows.select(*ROW, whole_text(text).alias("_text"))
    none = F.array().cast(f"array<{MATCH}>")
    # texts without a valid match go no further than this pass
    held = keep(texts.where(F.col("_text").rlike("[0-9@]")).select("*", F.concat(*[F.coalesce(pattern_matches(F.col("_text"), k), none) for k in KINDS[:-1]])
                                                                    .alias("found")).where(F.size("found") > 0))
    valid = F.lit(False)
    for k in KINDS[:-1]:
        valid = F.when(F.col("kind") == k, VALID[k](F.col("value"))).otherwise(valid)
    base = keep(placed(held.select(*ROW, F.explode("found").alias("m"))).where(valid))
    terms = keep(placed(held.select(*ROW, F.explode(matches(F.col("_text"), TERM, "term")).alias("m"))).withColumn("term", F.lower("value")).drop("value"))
    marked = terms.join(disclosing_terms(base.select(*ROW, "kind", "value"), terms.select(*ROW, "term"), rows, text), [*ROW, "term"])

    def spans(df: DataFrame) -> DataFrame:
        rank = F.lit(None).cast("int")
        for i, k in enumerate(KINDS):
            rank = F.when(F.col("kind") == k, F.lit(i)).otherwise(rank)
        return df.select(*ROW, F.struct("start", rank.alias("rank"), "end", "kind").alias("s"))

    # a term that overlaps a value is left out: the values before it end at or before its start, those after it start at or after its end
    of_row = W.partitionBy(*ROW)
    all_spans = spans(base).unionByName(spans(marked)).withColumn("value", F.col("s.kind") != "term")
    last_end = F.max(F.when(F.col("value"), F.col("s.end"))).over(of_row.orderBy("s").rowsBetween(W.unboundedPreceding, W.currentRow))
    next_start = F.min(F.when(F.col("value"), F.col("s.start"))).over(of_row.orderBy(F.col("s").desc()).rowsBetween(W.unboundedPreceding, W.currentRow))
    free = F.coalesce(last_end <= F.col("s.start"), F.lit(True)) & F.coalesce(next_start >= F.col("s.end"), F.lit(True))
    listed = all_spans.withColumns({"_free": F.col("value") | free}).where("_free").groupBy(*ROW).agg(F.array_sort(F.collect_list("s")).alias("spans"))
    kind = "array<struct<start:int,rank:int,end:int,kind:string>>"
    return rows.select(*ROW, F.col(doc_id).alias("doc_id")).join(listed, list(ROW), "left") \
        .select("doc_id", F.coalesce("spans", F.array().cast(kind)).alias("spans"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets (terms: removed); a span that begins inside the one before is skipped."""
    def step(state: Column, s: Column) -> Column:
        mark = F.when(s["kind"] == "term", F.lit("")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.when(s["start"] >= state["at"], F.struct(s["end"].alias("at"), F.concat(state["out"], text.substr(state["at"] + 1, s["start"] - state["at"]), mark).alias("out"))) \
            .otherwise(state)

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(spans, start, step, lambda state: F.concat(state["out"], text.substr(state["at"] + 1, F.length(text))))

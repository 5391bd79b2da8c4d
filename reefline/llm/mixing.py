"""Mixing sources to target weights by capped water-filling.

Targets: the total is shared by weight; a source whose share is above
``max_epochs`` times its size is clamped there and the excess is reshared among
the others by weight, until none is above.  In order of cap over weight the
clamped sources come first, so one running sum finds them all.

Sampling: a source whose target is e times its size gives floor(e) whole
copies of each document, and one more copy of the documents that come first
in a seeded random order, up to the document where the running size passes the rest
of the target (rounded to the nearer side).  The choice is a threshold on
(hash, size) per source, so it is applied to the texts without a shuffle of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import keep, running_total, whole_text

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)


def seeded(doc_id: str, seed: int) -> Column:
    """A seeded 60-bit number from the id (the first 15 hex digits of an MD5)."""
    text = F.concat_ws(":", F.lit(str(seed)), F.col(doc_id).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17) -> DataFrame:
    """``(doc_id, source, size, u)``: number of words and a seeded hash of the id, one row per row."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
                       F.regexp_count(whole_text(text), F.lit(WORD)).cast("bigint").alias("size"),
                       seeded(doc_id, seed).alias("u"))


def water_fill(totals: DataFrame, max_epochs: float, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Add ``target`` to ``totals(source, source_size)``: sources in code-point order, null last, weigh
    ``weights`` in turn.  The windows run over one row per source.  A source of size 0 has target 0."""
    by_name = W.orderBy(F.col("source").isNull(), F.col("source"))
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(max_epochs))
    before = W.orderBy("_ratio", F.col("source").isNull(), F.col("source")).rowsBetween(W.unboundedPreceding, -1)
    all_rows = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    marked = totals.withColumn("_weight", weight).withColumn("_cap", cap).withColumn("_ratio", F.col("_cap") / F.col("_weight")) \
        .withColumn("_total", F.sum("source_size").over(all_rows)).withColumn("_weights", F.sum("_weight").over(all_rows)) \
        .withColumn("_above", F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) \
        .withColumn("_heavier", F.coalesce(F.sum("_weight").over(before), F.lit(0.0))) \
        .withColumn("_clamped", (F.col("_total") - F.col("_above")) / (F.col("_weights") - F.col("_heavier")) >= F.col("_ratio"))
    level = (F.col("_total") - F.sum(F.when(F.col("_clamped"), F.col("_cap")).otherwise(0.0)).over(all_rows)) \
        / F.sum(F.when(F.col("_clamped"), 0.0).otherwise(F.col("_weight"))).over(all_rows)
    return marked.withColumn("_level", F.when(~F.min("_clamped").over(all_rows), level)) \
        .withColumn("target", F.when(F.col("_clamped"), F.col("_cap")).otherwise(F.col("_level") * F.col("_weight"))) \
        .select(*totals.columns, "target")


def plan_mix(sized: DataFrame, max_epochs: float = 3.0) -> DataFrame:
    """One row per source: ``source, source_size, target, whole`` (copies of every document) and the
    threshold ``top_u, top_size`` up to which documents get one more copy (null: none)."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = keep(water_fill(totals, max_epochs).withColumn("whole", F.floor(epochs + F.lit(1e-12)).cast("bigint"))
                   .withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))))
    ordered = running_total(sized, "source", ["u", "size"], "size", "before", targets.where("rest > 0").select("source", "rest"))
    chosen = ordered.where((F.col("size") > 0) & (F.col("before") + F.col("size") / 2 <= F.col("rest")))
    tops = chosen.groupBy(F.col("source").alias("_source")).agg(F.max(F.struct("u", "size")).alias("top"))
    return targets.join(tops, F.col("source").eqNullSafe(F.col("_source")), "left") \
        .select("source", "source_size", "target", "whole", F.col("top.u").alias("top_u"), F.col("top.size").alias("top_size"))


def repetitions(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """Add the plan of each row's source and ``copies``, the number of times the mix takes the row.

    Rows that tie on the threshold (the same id and size) are taken alike."""
    p = plan.select(F.col("source").alias("_source"), "source_size", "target", "whole", "top_u", "top_size")
    extra = (F.col("top_u").isNotNull()) & ((F.col("u") < F.col("top_u")) | ((F.col("u") == F.col("top_u")) & (F.col("size") <= F.col("top_size"))))
    return sized.join(p, F.col("source").eqNullSafe(F.col("_source"))) \
        .withColumn("copies", F.col("whole") + F.when(extra, 1).otherwise(0)) \
        .drop("_source", "whole", "top_u", "top_size")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", max_epochs: float = 3.0,
        seed: int = 17) -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies)``, one row per row of ``docs``.

    A null text has size 0, and a row of size 0 is taken as its source's whole copies say.
    A null source is a source of its own, the last in order.  The same
    rows and seed give the same mix; an empty table gives an empty one."""
    sized = keep(sizes(docs, doc_id, text, source, seed))
    return repetitions(sized, keep(plan_mix(sized, max_epochs))).select("doc_id", "source", "size", "source_size", "target", "copies")


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
                    max_epochs: float = 3.0, seed: int = 17) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, all columns kept; the texts are not shuffled when
    the per-source plan is small enough for the planner to broadcast."""
    plan = plan_mix(keep(sizes(docs, doc_id, text, source, seed)), max_epochs)
    p = keep(plan).select(*[F.col(c).alias(f"_mix_{c}") for c in ("source", "whole", "top_u", "top_size")])
    u = seeded(doc_id, seed)
    size = F.regexp_count(whole_text(text), F.lit(WORD)).cast("bigint")
    top_u, top_size = F.col("_mix_top_u"), F.col("_mix_top_size")
    extra = top_u.isNotNull() & ((u < top_u) | ((u == top_u) & (size <= top_size)))
    copies = (F.col("_mix_whole") + F.when(extra, 1).otherwise(0)).cast("int")
    joined = docs.join(p, F.col(source).eqNullSafe(F.col("_mix_source")))
    return joined.withColumn("_mix_copy", F.explode(F.array_repeat(F.lit(1), copies))).select(*[docs[c] for c in docs.columns])

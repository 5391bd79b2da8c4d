"""Importance resampling towards a target distribution, over hashed word n-grams.

Texts and targets become counts of hashed features (words and pairs of
neighbouring words).  A bucket's gain is the logarithm of its smoothed share in the
target over that in the texts; a document's weight is the mean gain of its
features, and documents are drawn without replacement by adding Gumbel noise to
the weight (a hash of the document's id) and taking the highest sums.

Tasks work with Arrow kernels: a piece of texts is lower-cased, split, flattened
and dictionary-encoded; neighbouring dictionary indices form the pairs, only
distinct words and pairs are hashed, and gains are taken by bucket and summed
by document.  Only bucket counts and one short row per document are shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textbytes as tb
from .tables import keep

#: What stands between words: ASCII other than digits and small letters (texts are in lower case by then).
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
PIECE_BYTES = 1 << 21


@dataclass
class Features:
    """Buckets of the features of a piece of texts, text by text, and the number of features and words of each text."""
    buckets: np.ndarray
    counts: np.ndarray
    words: np.ndarray


def _piece(texts: pa.Array, buckets: int) -> Features:
    n = len(texts)
    split = pc.split_pattern_regex(pc.ascii_lower(texts), BETWEEN)
    words, owner = pc.list_flatten(split), pc.list_parent_indices(split)
    some = pc.greater(pc.binary_length(words), 0)                       # text that begins or ends between words
    words, owner = pc.filter(words, some), np.asarray(pc.filter(owner, some)).astype(np.int64)
    n_words = np.bincount(owner, minlength=n)
    counts = n_words + np.maximum(n_words - 1, 0)
    if not len(words):
        return Features(np.zeros(0, np.int64), counts, n_words)
    coded = words.dictionary_encode()
    index = np.asarray(coded.indices).astype(np.int64)
    stock = [w.encode() for w in coded.dictionary.to_pylist()]
    crc = np.fromiter(map(zlib.crc32, stock), np.uint32, len(stock))
    pair_at = np.flatnonzero(owner[1:] == owner[:-1])                   # shifted indices within a text
    pairs, place = np.unique(index[pair_at] * len(stock) + index[pair_at + 1], return_inverse=True)
    spaced = [b" " + w for w in stock]
    pair_crc = np.fromiter(map(zlib.crc32, map(spaced.__getitem__, pairs % len(stock)), crc[pairs // len(stock)].tolist()), np.uint32, len(pairs))

    before = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.int64)
    place_in = np.arange(len(owner)) - (np.cumsum(n_words) - n_words)[owner]
    out[before[owner] + place_in] = crc[index] % buckets                # the words of a text, then its pairs
    out[before[owner[pair_at]] + n_words[owner[pair_at]] + place_in[pair_at]] = (pair_crc % buckets)[place]
    return Features(out, counts, n_words)


def features(column: pa.Array | pa.ChunkedArray, buckets: int = BUCKETS) -> Iterator[Features]:
    """Features of a text column in pieces of whole texts; null counts as empty."""
    data, offsets = tb.buffers(column)
    for a, b in tb.pieces(offsets, PIECE_BYTES):
        yield _piece(tb.strings(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]), buckets)


def bucket_counts(table: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Number of features in each bucket over all texts of ``table``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for f in features(batch.column(0), buckets):
                total += np.bincount(f.buckets, minlength=buckets)
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(total[on])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in table.select(F.col(text).alias("_text")).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]                                       # one row per bucket
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of the smoothed share of each bucket in the target over that in the raw texts."""
    s, t, buckets = raw.astype(float), target.astype(float), float(len(raw))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_features, weight)``: the floored mean gain of each document's features, 0 without features."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = list(_weights(batch.column(0), gain))
            words, counts, weight = (np.concatenate([np.zeros(0, np.int64), *[p[i] for p in parts]]) for i in range(3))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(words), pa.array(counts), pa.array(weight)],
                                             names=["doc_id", "n_words", "n_features", "weight"])

    chosen = docs.select(F.col(text).alias("_text"), F.col(doc_id).alias("doc_id"))
    return chosen.mapInArrow(run, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_features bigint, weight bigint")


def _weights(column: pa.Array, gain: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for f in features(column, len(gain)):
        sums = np.zeros(len(f.counts), np.int64)
        some = np.flatnonzero(f.counts)
        if len(some):
            sums[some] = np.add.reduceat(np.take(gain, f.buckets), (np.cumsum(f.counts) - f.counts)[some])
        yield f.words, f.counts, sums // np.maximum(f.counts, 1)


def ranked(scored: DataFrame, eligible: str, order: list, fraction: tuple[int, int]) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3... in ``order`` over the first floor(n * fraction) of the n eligible rows, else null.

    Rows are dealt out by ranges of the order and written once; a window numbers each range, and the
    rows of earlier ranges are added, of which there is one count each."""
    order = [F.col(eligible).desc(), *order]
    dealt = keep(scored.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    per = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"), F.count(F.when(F.col(eligible), 1)).alias("_able"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = per.select(F.col("_part").alias("_of"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    limit = per.agg(F.expr(f"coalesce(sum(_able), 0L) * {fraction[0]}L div {fraction[1]}L").alias("n")).scalar()
    place = F.row_number().over(W.partitionBy("_part").orderBy(*order)) + F.col("_offset")
    numbered = dealt.join(offsets, F.col("_part") == F.col("_of")).withColumn("_place", place)
    return numbered.withColumn("rank", F.when(F.col(eligible) & (F.col("_place") <= limit), F.col("_place").cast("bigint"))) \
        .drop("_part", "_of", "_offset", "_place")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: str = "7", buckets: int = BUCKETS,
             doc_id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score, rank)``, one row per row of ``docs``; drawn rows have a ``rank``.

    Of the rows with at least ``least_words`` words the highest ``percent`` hundredths by
    score are drawn; ties go to the smaller id, null ids last, then to more features.
    Null texts are empty (no features, weight 0), null ids count as the empty text in
    the noise, repeated rows are drawn row by row, and either table may be empty.
    Columns other than those named are not read."""
    gain = gains(bucket_counts(docs, text, buckets), bucket_counts(target, target_text, buckets))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    # written once: dealing out by ranges samples its input first, which would read the texts again
    scored = keep(weighed(docs, gain, doc_id, text).withColumn("score", F.col("weight") + noise)
                  .withColumn("_able", F.col("n_words") >= least_words))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").desc(), F.col("weight").desc()]
    return ranked(scored, "_able", order, (percent, 100)).drop("_able")

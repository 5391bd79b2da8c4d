"""Autocovariance sums of long sequences from pairs of fixed-size blocks (AGG-15).

A sequence is cut into blocks of ``block`` values.  Blocks i and i + d together
hold every product of values whose lag lies within ``block`` of d * block, so
their cross-correlation, added up over i, gives those lags; with the distances
0..d all lags up to d * block are complete.  A task holds some pairs of blocks
and one sum per parameter and distance: nothing in it grows with the length of a
sequence or with the number of lags.

The truncation of the autocorrelation sum is found by Spark: the first pair sum
that is not positive is a minimum, and the running minimum before it is taken in
chunks of lags, joined by the minima of the chunks before.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reefline.operators.joins import join_null_safe
from reefline.session import cut_lineage

FIRST_LAGS = 256        # lags that are looked at first
BLOCK = 4096
CHUNK = 1024            # pairs of lags whose running minimum one window takes
HELD = 64               # sums of (parameter, distance) that a task holds before it passes them on


def in_blocks(x: DataFrame, by: Sequence[str], iteration: str, value: str, block: int = BLOCK) -> DataFrame:
    """``by + [_block, _offset, _len, _sum, _x]``, written: the values of each block in order of ``iteration``,
    which numbers a sequence without gaps.  ``_offset`` is the place of the first value within its block."""
    number = F.floor(F.col(iteration) / block)
    ordered = F.sort_array(F.collect_list(F.struct(F.col(iteration).alias("i"), F.col(value).alias("x"))))
    packed = x.groupBy(*by, number.alias("_block")).agg(
        (F.min(iteration) - F.first(number) * block).cast("int").alias("_offset"), F.count(F.lit(1)).alias("_len"), F.sum(value).alias("_sum"), ordered.alias("_s"))
    return cut_lineage(packed.select(*by, "_block", "_offset", "_len", "_sum", F.col("_s.x").alias("_x")))


def _spectra(values: pa.Array, offsets: np.ndarray, means: np.ndarray, block: int) -> np.ndarray:
    """Transforms of centred blocks, zeros where a block has no value, long enough that lags don't wrap."""
    out = np.zeros((len(values), 2 * block))
    for i, (at, mean) in enumerate(zip(offsets, means, strict=True)):
        x = np.asarray(values[i].values) - mean
        out[i, at:at + len(x)] = x
    return np.fft.rfft(out, axis=1)


def _lag_part(spectrum: np.ndarray, distance: int, block: int, below: int | None) -> tuple[int, np.ndarray]:
    """First lag and sums of consecutive lags that blocks ``distance`` apart contribute to."""
    s = np.fft.irfft(spectrum, 2 * block)
    start = 0 if distance == 0 else (distance - 1) * block + 1
    sums = s[:block] if distance == 0 else np.concatenate([s[block + 1:], s[:block]])
    return start, sums if below is None else sums[:max(below - start, 0)]


def pair_sums(blocks: DataFrame, keys: Sequence[str], chain: str, nearest: int, farthest: int, block: int = BLOCK,
              below: int | None = None) -> DataFrame:
    """``keys + [lag, s]``: products of values ``lag`` apart, from blocks ``nearest`` to ``farthest`` apart, over all chains.

    ``blocks`` are those of ``in_blocks`` with the chain's ``_mean``.  ``below`` leaves out lags from there on."""
    keys = list(keys)
    left = blocks.select(*keys, chain, "_mean", "_offset", "_x", F.explode(F.sequence(F.lit(nearest), F.lit(farthest))).alias("_d"), "_block") \
        .withColumn("_block", F.col("_block") + F.col("_d"))
    right = blocks.select(*keys, chain, "_block", F.col("_offset").alias("_offset2"), F.col("_x").alias("_x2"))
    pairs = join_null_safe(left, right, keys + [chain, "_block"]).select("_mean", "_offset", "_x", "_offset2", "_x2", "_d", *keys)
    schema = T.StructType([T.StructField("_from", T.LongType()), T.StructField("_sums", T.ArrayType(T.DoubleType()))] + [pairs.schema[k] for k in keys])
    types = [pa.int64(), pa.list_(pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def passed_on(kinds: list[pa.DataType]) -> pa.RecordBatch:
            parts = [(*_lag_part(total, of[0], block, below), *of[1:]) for of, total in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*parts), [*types, *kinds], strict=True)],
                                              names=["_from", "_sums", *keys])

        kinds: list[pa.DataType] = []
        for batch in batches:
            kinds = [c.type for c in batch.columns[6:]]
            mean = np.asarray(batch.column(0))
            of = list(zip(*(c.to_pylist() for c in batch.columns[5:]), strict=True))
            for a in range(0, len(batch), 256):
                part = slice(a, a + 256)
                first = _spectra(batch.column(2).slice(a, 256), np.asarray(batch.column(1))[part], mean[part], block)
                second = _spectra(batch.column(4).slice(a, 256), np.asarray(batch.column(3))[part], mean[part], block)
                product = np.conj(first) * second
                for i, which in enumerate(of[part]):
                    held[which] = held[which] + product[i] if which in held else product[i].copy()
                    if len(held) > HELD:
                        yield passed_on(kinds)
        if held:
            yield passed_on(kinds)

    sums = pairs.mapInArrow(run, schema)
    return sums.select(*keys, "_from", F.posexplode("_sums").alias("_at", "_s")).groupBy(*keys, (F.col("_from") + F.col("_at")).alias("lag")) \
        .agg(F.sum("_s").alias("s"))


def truncated_tau(rho: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys + [tau]``: integrated autocorrelation time from ``keys + [n, lag, rho]``, chains of length ``n``.

    Sums of neighbours (even lag, next odd lag) are added up to the first that is not positive, each at
    most the one before; the even autocorrelation at the cut counts once if it or its pair sum is positive.
    The last pairs of a chain (within five lags of its end) are never added.  Parameters that need lags
    which ``rho`` lacks have no row."""
    keys = list(keys)
    k = F.floor(F.col("lag") / 2)
    even = F.max(F.when(F.col("lag") % 2 == 0, F.col("rho")))
    pairs = rho.withColumn("_k", k).withColumn("_chunk", F.floor(F.col("_k") / CHUNK)).repartition(*keys, "_chunk") \
        .groupBy(*keys, "_chunk", "_k").agg(F.sum("rho").alias("_p"), even.alias("_even"), F.max("n").alias("_n"), F.count(F.lit(1)).alias("_c")) \
        .where(F.col("_c") == 2)
    stops = F.isnan("_p") | ~(F.col("_p") > 0)
    inside = Window.partitionBy(*keys, "_chunk").orderBy("_k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pairs = pairs.withColumn("_low", F.min("_p").over(inside))
    chunks = pairs.groupBy(*keys, "_chunk").agg(F.min("_p").alias("_least"), F.min(F.when(stops, F.col("_k"))).alias("_stop"), F.max("_n").alias("_n"))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    limit = F.greatest(F.lit(0), F.ceil((F.col("_n") - 5) / 2))
    chunks = chunks.select(*keys, "_chunk", F.min("_least").over(before).alias("_before"), F.least(limit, F.min("_stop").over(whole)).alias("_cut"))
    low = F.least("_low", "_before")
    last = F.when((F.col("_even") > 0) | (F.col("_p") >= 0), F.col("_even")).otherwise(0.0)
    at_cut = F.col("_k") == F.col("_cut")
    summed = join_null_safe(pairs.drop("_n"), chunks, keys + ["_chunk"]).groupBy(*keys).agg(
        F.sum(F.when(F.col("_k") < F.col("_cut"), low)).alias("_added"), F.max(F.when(at_cut, last)).alias("_last"))
    return summed.where(F.col("_last").isNotNull()).select(*keys, (F.lit(-1.0) + 2 * F.coalesce("_added", F.lit(0.0)) + F.col("_last")).alias("tau"))

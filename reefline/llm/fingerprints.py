"""Document fingerprints by one-permutation MinHash.

Each five-word shingle is hashed once; the high bits of the hash choose one of
``BINS`` bins and each bin keeps its least hash.  Empty bins are filled by
optimal densification: an empty bin draws other bins by a hash of (bin,
attempt), the same for all texts, until it meets one that was not empty.  Of
each bin the ``BITS`` low-order bits (of the minimum mixed with the bin's
number) are stored, packed.  Two bins of different
minima agree in these bits with chance 2^-BITS, which the likeness corrects.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textbytes as tb
from .tables import keep

WORDS = 5
BINS = 256
BITS = 4
PIECE_BYTES = 1 << 20
GROUP_BYTES = 4 << 20
EMPTY = np.uint64(2**64 - 1)


def densified(bins: np.ndarray) -> np.ndarray:
    """Fill the empty bins of each row that has a bin that is not empty."""
    out = bins.copy()
    row, place = np.nonzero((bins == EMPTY) & (bins != EMPTY).any(axis=1)[:, None])
    attempt = 0
    while len(row):
        attempt += 1
        draw = tb.mixed(np.arange(BINS, dtype=np.uint64) * np.uint64(1 << 20) + np.uint64(attempt)) % np.uint64(BINS)
        found = bins[row, draw[place].astype(np.int64)]
        on = found != EMPTY
        out[row[on], place[on]] = found[on]
        row, place = row[~on], place[~on]
    return out


def signatures(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Low-order bits of each bin (one row of ``BINS`` numbers for each text), and whether the text has a shingle."""
    data, offsets = tb.buffers(column)
    n_texts = len(offsets) - 1
    out, some = np.zeros((n_texts, BINS), np.uint8), np.zeros(n_texts, bool)
    place = np.arange(BINS, dtype=np.uint64) << np.uint64(32)
    shift = np.uint64(64 - int(BINS).bit_length() + 1)
    for a, b in tb.pieces(offsets, PIECE_BYTES):
        h, n = tb.shingle_hashes(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], WORDS)
        least = np.full((b - a) * BINS, EMPTY, np.uint64)
        at = np.repeat(np.arange(b - a), n) * BINS + (h >> shift).astype(np.int64)
        np.minimum.at(least, at, h)
        some[a:b] = n > 0
        full = densified(least.reshape(b - a, BINS))
        # mixed with the bin's number: bins that share a filler must not agree or differ together
        out[a:b] = (tb.mixed(full ^ place) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
        out[a:b][n == 0] = 0
    return out, some


def packed(low: np.ndarray, some: np.ndarray) -> list[bytes]:
    """A leading byte (0: no shingle, 1: some) and the bits of all bins, low-order bit first."""
    bits = np.unpackbits(low[:, :, None], axis=2, bitorder="little", count=BITS).reshape(len(low), -1)
    rows = np.concatenate([some[:, None].astype(np.uint8), np.packbits(bits, axis=1, bitorder="little")], axis=1)
    raw, width = rows.tobytes(), rows.shape[1]
    return [raw[i:i + width] for i in range(0, len(raw), width)]


def likeness(a: np.ndarray, a_some: np.ndarray, b: np.ndarray, b_some: np.ndarray) -> np.ndarray:
    """Estimated Jaccard likeness of the shingle sets, from 0 to 1; two texts without shingles are alike, one without is unlike any other."""
    chance = 2.0 ** -BITS
    est = np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0, 1)
    return np.where(a_some & b_some, est, (a_some == b_some).astype(float))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fingerprint)``, one row per row: the packed fingerprint of each whole text as bytes.

    Null counts as empty; a text without words has an all-zero fingerprint, one
    of fewer than five words a single shingle.  Equal texts have equal
    fingerprints.  Extra columns are not read; an empty table gives an empty one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed(*signatures(batch.column(1))), pa.binary())],
                                             names=["doc_id", "fingerprint"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, fingerprint binary")


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many of the start of ``following``."""
    quarter = len(text) // 4
    return text[:len(text) - quarter] + following[:quarter]


def _results(ids: list, texts: list[str], following: list[str], kind: pa.DataType) -> pa.RecordBatch:
    """One row per text; ``following`` has the next text of each."""
    changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    own, own_some = signatures(pa.array([*texts, following[-1]], pa.string()))
    new, new_some = signatures(pa.array(changed, pa.string()))
    return pa.RecordBatch.from_arrays([
        pa.array(ids, kind),
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).digest() for t in changed], pa.binary()),
        pa.array(packed(own[:-1], own_some[:-1]), pa.binary()),
        pa.array(packed(new, new_some), pa.binary()),
        pa.array(likeness(own[:-1], own_some[:-1], new, new_some)),
        pa.array(likeness(own[:-1], own_some[:-1], own[1:], own_some[1:])),
    ], names=["doc_id", "n_chars", "edited_digest", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def edit_probe(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited form, and their likeness to each other and to the next text.

    The next text is that of the next id in ascending order (the first one's
    after the last; null ids come first, ties by text).  Rows are dealt once
    by ranges of the id and read in order; only the first and the last text of each range
    are kept to be matched across ranges, by joins.  Null counts as empty; an
    empty table gives an empty one; a single row follows itself."""
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n_chars bigint, edited_digest binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
    names = ["part", "edge", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def edge(which: str, key, text: str, id_kind: pa.DataType) -> pa.RecordBatch:
            empty = [pa.nulls(1, t) for t in (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array([key], id_kind), *empty, pa.array([part], pa.int32()), pa.array([which]), pa.array([text])],
                                              names=[*inner, *names])

        inner = ["doc_id", "n_chars", "edited_digest", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        ids, texts, size, started, id_kind = [], [], 0, False, None
        for batch in batches:
            id_kind = batch.column(0).type
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                value = value or ""
                if not started:
                    yield edge("first", key, value, id_kind)
                    started = True
                ids.append(key)
                texts.append(value)
                size += len(value)
                if size >= GROUP_BYTES and len(texts) > 1:
                    done = _results(ids[:-1], texts[:-1], texts[1:], id_kind)
                    more = [pa.nulls(len(done), t) for t in (pa.int32(), pa.string(), pa.string())]
                    yield pa.RecordBatch.from_arrays([*done.columns, *more], names=[*inner, *names])
                    ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])
        if len(texts) > 1:
            done = _results(ids[:-1], texts[:-1], texts[1:], id_kind)
            more = [pa.nulls(len(done), t) for t in (pa.int32(), pa.string(), pa.string())]
            yield pa.RecordBatch.from_arrays([*done.columns, *more], names=[*inner, *names])
        if texts:
            yield edge("last", ids[-1], texts[-1], id_kind)

    ordered = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")) \
        .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    found = keep(ordered.mapInArrow(run, f"{schema}, part int, edge string, text string"))

    firsts = found.where("edge = 'first'").select("part", F.col("text").alias("following"))
    over = W.orderBy("part")          # one row per range
    wrap = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    order = firsts.select("part").withColumn("next_part", F.coalesce(F.lead("part").over(over), F.min("part").over(wrap)))
    lasts = found.where("edge = 'last'").select("part", "doc_id", "text")
    met = lasts.join(order, "part").join(firsts.withColumnRenamed("part", "next_part"), "next_part").select("doc_id", "text", "following")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1)
                yield _results(row.column(0).to_pylist(), row.column(1).to_pylist(), row.column(2).to_pylist(), row.column(0).type)

    return found.where("edge is null").drop("part", "edge", "text").union(met.mapInArrow(across, schema))

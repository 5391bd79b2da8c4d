"""Exact deduplication by skew-safe combining.

1. Local: each task reads its rows in chunks of bounded size and merges equal
   texts; of a group only one row per chunk carries the text onward.
2. Salted: chunk winners of a digest are merged in about sqrt(chunks) salted
   groups, so that a text that a third of all rows hold meets in many tasks.
3. Global: salt winners of digests that span salts are merged once more; there
   are at most as many as salts.

Full texts are compared at each stage; a digest only brings candidates
together.  Rows other than winners move as three small columns.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textbytes as tb
from .tables import keep

CHUNK_BYTES = 16 << 20
PIECE_BYTES = 1 << 20
ROW_BYTES = 200            # counted for each row besides its text, so that a chunk has fewer than 2^18 rows
CHUNK_SHIFT = 18           # row numbers: partition, chunk of the partition (20 bits), row of the chunk


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with each run of white space replaced by one space."""
    if not len(data):
        return data, offsets
    space = tb.SPACE[data]
    kept = ~space
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    kept[1:] |= kept[:-1] | edge[1:-1]       # the first of a run; kept[:-1] is read before it changes
    kept[0] = True
    out = data[kept].copy()
    out[tb.SPACE[out]] = 0x20
    return out, np.concatenate([[0], np.cumsum(kept)])[offsets]


def _merge_chunk(chunk: int, rows: list[tuple], kind: pa.DataType, carried: list[tuple[str, pa.Array]]) -> pa.RecordBatch:
    """Rows of one chunk with the chunk's winner of each; texts of losers are left out."""
    seen: dict[bytes, list[int]] = {}
    winner, count, least = [], [], []
    for i, (doc_id, digest, text) in enumerate(rows):
        w = next((j for j in seen.setdefault(digest, []) if rows[j][2] == text), None)
        if w is None:
            seen[digest].append(w := i)
        winner.append(w)
        count.append(0)
        count[w] += 1
        least.append(i)
        best = rows[least[w]][0]
        if doc_id is not None and (best is None or doc_id < best):
            least[w] = i
    n = len(rows)
    base = chunk << CHUNK_SHIFT
    own = np.arange(n) == np.array(winner, np.int64)
    return pa.RecordBatch.from_arrays([
        pa.array([r[0] for r in rows], kind),
        pa.array(np.arange(n) + base),
        pa.array(np.array(winner, np.int64) + base),
        pa.array([r[1] for r in rows], pa.binary()),
        pa.array([r[2] if o else None for r, o in zip(rows, own, strict=True)], pa.binary()),
        pa.array(np.where(own, count, 0).astype(np.int64)),
        pa.array([rows[least[i]][0] if o else None for i, o in enumerate(own)], kind),
        pa.array(np.where(own, np.array(least, np.int64) + base, -1)),
        *[c for _, c in carried],
    ], names=["doc_id", "row", "winner", "digest", "norm", "n", "least_id", "least_row", *[n for n, _ in carried]])


def _local(docs: DataFrame, doc_id: str, text: str, carry: tuple[str, ...]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        rows, parts, size, seq = [], [], 0, 0

        def merged() -> pa.RecordBatch:
            carried = pa.Table.from_batches(parts).combine_chunks()
            columns = [(n, carried.column(n).combine_chunks()) for n in carry]
            return _merge_chunk(part << 20 | seq, rows, carried.schema.field("_id").type, columns)

        for batch in batches:
            data, offsets = tb.buffers(batch.column(0))
            keys, taken = batch.column(1).to_pylist(), 0
            for low, high in tb.pieces(offsets, PIECE_BYTES):
                texts, ends = normalised(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low])
                raw = texts.tobytes()
                for i, a, b in zip(range(low, high), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    t = raw[a:b]
                    rows.append((keys[i], hashlib.sha256(t).digest(), t))
                    size += len(t) + ROW_BYTES
                    if size >= CHUNK_BYTES:
                        parts.append(batch.slice(taken, i + 1 - taken).select(["_id", *carry]))
                        yield merged()
                        rows, parts, size, seq, taken = [], [], 0, seq + 1, i + 1
            parts.append(batch.slice(taken).select(["_id", *carry]))
        if rows:
            yield merged()
        rows, parts = [], []
        tb.give_back()

    chosen = docs.select(F.col(text).alias("_text"), F.col(doc_id).alias("_id"), *carry)
    kind = chosen.schema["_id"].dataType.simpleString()
    more = "".join(f", `{n}` {chosen.schema[n].dataType.simpleString()}" for n in carry)
    return chosen.mapInArrow(run, f"doc_id {kind}, row bigint, winner bigint, digest binary, norm binary, n bigint, "
                                  f"least_id {kind}, least_row bigint{more}")


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, *carry, keep_id, group_size, kept, digest)``, one row per row of ``docs``.

    Texts are equal when identical after each run of white space is replaced by
    one space; null counts as empty.  Of equal texts the row with the least id
    stays; a null id comes after all others, and of rows that share the least
    id the first read stays, so exactly one row of a group is kept.  ``digest`` is
    the SHA-256 of the normalised text.  An empty table gives an empty one.
    Columns other than those named are not read."""
    local = keep(_local(docs, doc_id, text, carry))
    first = F.struct(F.col("least_id").isNull().alias("none"), F.col("least_id").alias("id"), F.col("least_row").alias("row"))
    winners = local.where(F.col("row") == F.col("winner"))
    chunk = F.shiftright("winner", CHUNK_SHIFT)
    chunks = winners.agg(F.count_distinct(chunk)).first()[0]
    salt = F.pmod(F.xxhash64(chunk), F.lit(max(1, math.isqrt(chunks)))).alias("salt")

    spans = winners.select("digest", salt).distinct()
    wide = spans.join(spans.groupBy("digest").agg(F.count(F.lit(1)).alias("salts")).where("salts > 1"), "digest") \
        .select("digest", "salt", F.lit(True).alias("wide"))
    at_salt = W.partitionBy("digest", "salt", "norm")
    salted = winners.select("digest", salt, "norm", "winner", "n", first.alias("first")) \
        .join(wide, ["digest", "salt"], "left") \
        .select("digest", "norm", "winner", "wide", F.min("winner").over(at_salt).alias("salt_winner"),
                F.min("first").over(at_salt).alias("first"), F.sum("n").over(at_salt).alias("n")) \
        .select("digest", "winner", "salt_winner", "wide", "first", "n",
                F.when(F.col("wide") & (F.col("winner") == F.col("salt_winner")), F.col("norm")).alias("norm"))
    salted = keep(salted)

    tops = salted.where(F.col("winner") == F.col("salt_winner"))
    over_all = W.partitionBy("digest", "norm")
    final = tops.where("wide is null").select("salt_winner", "first", "n").union(
        tops.where("wide").select("salt_winner", F.min("first").over(over_all).alias("first"), F.sum("n").over(over_all).alias("n")))
    of_winner = salted.select("winner", "salt_winner").join(final, "salt_winner").select("winner", "first", "n")
    return local.select("doc_id", *carry, "row", "winner", "digest").join(of_winner, "winner").select(
        "doc_id", *carry, F.col("first.id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("row") == F.col("first.row")).alias("kept"), "digest")

"""Training order: fixed-length token sequences in a keyed random order, in shards of fixed stride.

Texts become token ids, one after another with an end id after each, cut into
sequences of ``LENGTH`` ids.  The sequences are numbered 0 to n - 1 and a keyed
Feistel permutation gives each number its slot: the network permutes the
next power of four and cycle-walking (apply it again while the result is not
below n) restricts it to the n slots.  Slots are dealt by ranges, so each
partition writes whole shards of consecutive slots, and the place of any slot
follows by arithmetic: a reader can start or resume anywhere and read on in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbytes as tb
from .blocks import BLOCK_BYTES, blocks, chunks
from .tables import keep, running_total

LENGTH = 1024
SLOTS = 256               # of a shard
ROUNDS = 6
ID = "<u2"
BROADCAST_BLOCKS = 500_000    # offsets of 16 bytes each


def permuted(numbers: np.ndarray, n: int, key: int) -> np.ndarray:
    """Slot of each number, both from 0 to n - 1: a permutation that the key chooses."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = tb.mixed(np.arange(1, ROUNDS + 1, dtype=np.uint64) + (np.uint64(key) << np.uint64(8)))
    out = numbers.astype(np.uint64)
    walk = np.arange(len(out))
    while len(walk):
        left, right = out[walk] >> np.uint64(half), out[walk] & low
        for k in keys:
            left, right = right, left ^ (tb.mixed(right ^ k) & low)
        out[walk] = left << np.uint64(half) | right
        walk = walk[out[walk] >= np.uint64(n)]
    return out.astype(np.int64)


def ranks_of(path: str) -> list[tuple[bytes, int]]:
    """Pieces and ids of a rank file (base64 piece and id on each line)."""
    import base64

    with open(path, "rb") as f:
        return [(base64.b64decode(piece), int(i)) for piece, i in map(bytes.split, f)]


def token_sequences(docs: DataFrame, ranks: list[tuple[bytes, int]], pattern: str, text: str = "text",
                    length: int = LENGTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(block, seq, used, tokens)``: the ids of the texts of each block, an end id (the number of ranks) after each text,
    in sequences of ``length`` 16-bit numbers; the last of a block is filled up with end ids beyond ``used``."""
    end = len(ranks)
    if end >= 1 << 16:
        raise ValueError("ids need more than 16 bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=dict(ranks), special_tokens={})
        for block in blocks(batches, chunks, block_bytes):
            ids = [coder.encode_ordinary(w.decode()) for w in block.words.to_pylist()]
            size = np.array([len(i) for i in ids], np.int64)
            flat = np.array([x for i in ids for x in i], ID)
            begin = np.cumsum(size) - size
            per_word = size[block.places] if len(size) else np.zeros(0, np.int64)
            at = np.arange(int(per_word.sum())) + np.repeat(begin[block.places] - (np.cumsum(per_word) - per_word), per_word) \
                if len(per_word) else np.zeros(0, np.int64)
            word_ends = np.concatenate([[0], np.cumsum(per_word)])
            text_ends = word_ends[np.cumsum(block.counts)]
            stream = np.insert(flat[at], text_ends, end)
            used = len(stream)
            rows = -(-used // length)
            full = np.full(rows * length, end, ID)
            full[:used] = stream
            raw, stride = full.tobytes(), 2 * length
            for a in range(0, rows, 1000):
                some = range(a, min(a + 1000, rows))
                yield pa.RecordBatch.from_arrays([
                    pa.array([block.name] * len(some)), pa.array(some, pa.int64()),
                    pa.array([min(length, used - i * length) for i in some], pa.int32()),
                    pa.array([raw[i * stride:(i + 1) * stride] for i in some], pa.binary())], names=["block", "seq", "used", "tokens"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "block bigint, seq bigint, used int, tokens binary")


def in_slots(sequences: DataFrame, key: int, n: int) -> DataFrame:
    """Add ``slot`` to a written table of ``n`` rows ``(block, seq, ..)``: the permuted place of each row in the order of block and seq.

    There is one offset per block.  Counted to be small they are broadcast, so the sequences do not move;
    beyond that the join is left to the planner."""
    sizes = sequences.groupBy("block").agg(F.count(F.lit(1)).alias("n")).withColumn("all", F.lit(0))
    offsets = keep(running_total(sizes, "all", ["block"], "n", "offset").select("block", "offset"))
    if offsets.count() <= BROADCAST_BLOCKS:
        offsets = F.broadcast(offsets)
    names = [*sequences.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = permuted(np.asarray(batch.column(0)), n, key)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(slots)], names=[*names, "slot"])

    numbered = sequences.join(offsets, "block").select((F.col("offset") + F.col("seq")).alias("number"), *names)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sequences.schema.fields)
    return numbered.mapInArrow(run, f"{kinds}, slot bigint")


def shards(slotted: DataFrame, n: int, slots: int = SLOTS) -> DataFrame:
    """Of ``n`` rows with slots 0 to n - 1: ``(shard, first_slot, n_slots, stride, used, payload, sha256)``: the tokens of consecutive slots one after another.

    Shard s holds the slots from s * slots on, ``stride`` bytes each; only the last may have fewer."""
    partitions = int(slotted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_shards = max(1, -(-n // slots))
    partitions = min(partitions, n_shards)
    dealt = slotted.select("slot", "used", "tokens").repartitionById(
        partitions, F.floor(F.floor(F.col("slot") / slots) * partitions / n_shards).cast("int")).sortWithinPartitions("slot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole(first: int, parts: list[bytes], used: int) -> pa.RecordBatch:
            payload = b"".join(parts)
            return pa.RecordBatch.from_arrays([
                pa.array([first // slots]), pa.array([first]), pa.array([len(parts)]), pa.array([len(parts[0])]), pa.array([used]),
                pa.array([payload], pa.binary()), pa.array([hashlib.sha256(payload).hexdigest()])],
                names=["shard", "first_slot", "n_slots", "stride", "used", "payload", "sha256"])

        first, parts, used = None, [], 0
        for batch in batches:
            for slot, n, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if parts and slot % slots == 0:
                    yield whole(first, parts, used)
                    parts, used = [], 0
                if not parts:
                    first = slot
                if slot != first + len(parts):
                    raise ValueError(f"slot {slot} follows {first + len(parts) - 1}")
                parts.append(tokens)
                used += n
        if parts:
            yield whole(first, parts, used)

    return dealt.mapInArrow(run, "shard bigint, first_slot bigint, n_slots bigint, stride bigint, used bigint, payload binary, sha256 string")


def training_order(docs: DataFrame, ranks: list[tuple[bytes, int]], pattern: str, key: int, text: str = "text",
                   length: int = LENGTH, slots: int = SLOTS) -> DataFrame:
    """Shards (see ``shards``) of the token sequences of all texts in the order that ``key`` chooses.

    Null and empty texts give their end id alone.  The same files, settings and key
    give the same shards; the sequences are written once before they are
    numbered, so a lost executor changes nothing.  Repeated rows are repeated;
    extra columns are not read; an empty table gives no shard."""
    sequences = keep(token_sequences(docs, ranks, pattern, text, length), compression="zstd")
    n = sequences.count()
    return shards(in_slots(sequences, key, n), n, slots)


def read_slots(spark: SparkSession, path: str, first: int, count: int, slots: int = SLOTS) -> DataFrame:
    """``(slot, tokens)`` of ``count`` slots from ``first`` on, in order, from shards written as Parquet; only their shards are read."""
    held = spark.read.parquet(path).where(F.col("shard").between(first // slots, (first + count - 1) // slots))
    each = held.select("first_slot", "stride", "payload", F.explode(F.sequence(F.lit(0), F.col("n_slots") - 1)).alias("i"))
    return each.select((F.col("first_slot") + F.col("i")).alias("slot"),
                       F.substring("payload", (F.col("i") * F.col("stride") + 1).cast("int"), F.col("stride").cast("int")).alias("tokens")) \
        .where(F.col("slot").between(first, first + count - 1)).orderBy("slot")

"""Blocks of texts as a list of distinct words and the positions of each.

A task turns its texts into blocks of bounded size.  A block has its distinct
words, most frequent first, and each text as a sequence of places in that list.
Work on words then runs once per distinct word of the whole table; what it gives goes
back to the blocks, once per distinct word of the block, and is put in place
by position.  Neither the shuffle nor a hot word grows with the repetitions in a block.

A block is named by its partition, its number and a checksum of its contents.
The two readings of one input (words, positions) must give the same blocks,
as files read by Spark do; a reader that finds no words for a block fails.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext

from . import textbytes as tb

BLOCK_BYTES = 16 << 20


@dataclass
class Block:
    """Distinct words, the place of each word of all texts, and the number of words of each text."""

    name: int
    words: pa.Array
    places: np.ndarray
    counts: np.ndarray
    rows: pa.Table


Split = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts cut before each white-space byte that follows a visible character: the bytes, the offsets of the
    chunks, and the number of chunks of each text.

    A byte-level BPE's pre-tokens never reach over such a cut: a run of white space
    starts a new one, and what comes before the cut does not look past it.  Characters
    that some Unicode version may count as white space are never cut after."""
    n = len(data)
    if not n:
        return data, np.zeros(1, np.int64), np.zeros(len(offsets) - 1, np.int64)
    cut = np.zeros(n, bool)
    at = np.flatnonzero(tb.SPACE[data[1:]]) + 1
    before = data[at - 1]
    fine = (before > 0x20) & (before < 0x7F)
    wide = np.flatnonzero(before >= 0x80)
    if len(wide):
        second, third = data[at[wide] - 2], np.where(at[wide] >= 3, data[at[wide] - 3], 0)
        # lead bytes of the blocks that hold white space or format characters: U+0080-00BF, U+1680, U+180E, U+2000-207F, U+3000, U+FEFF
        odd = (second == 0xC2) | ((third == 0xE1) & ((second == 0x9A) | (second == 0xA0))) \
            | ((third == 0xE2) & ((second == 0x80) | (second == 0x81))) | ((third == 0xE3) & (second == 0x80)) | ((third == 0xEF) & (second == 0xBB))
        fine[wide] = ~odd
    cut[at[fine]] = True
    starts = offsets[:-1]
    cut[starts[starts < n]] = True
    begins = np.flatnonzero(cut)
    return data, np.append(begins, n), np.diff(np.searchsorted(begins, offsets))


def lower_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of the texts, A-Z lower-cased: their bytes, their offsets, and the number of words of each text."""
    start, end, counts = tb.word_spans(data, offsets)
    return tb.LOWER[data[~tb.SPACE[data]]], np.concatenate([[0], np.cumsum(end - start)]), counts


def _block(tables: list[pa.RecordBatch], split: Split, seq: int) -> Block:
    rows = pa.Table.from_batches(tables).combine_chunks()
    data, offsets = tb.buffers(rows.column(0))
    raw, word_offsets, counts = split(data, offsets)
    coded = pc.dictionary_encode(tb.strings(raw, word_offsets, pa.binary()))
    places = np.asarray(coded.indices).astype(np.int64)
    often = np.bincount(places, minlength=len(coded.dictionary))
    order = np.argsort(-often, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    name = (part << 42 | (seq & 0x3FF) << 32 | zlib.crc32(offsets.tobytes(), zlib.crc32(data.tobytes()))) & (2**63 - 1)
    return Block(name, coded.dictionary.take(pa.array(order)), rank[places], counts, rows)


def blocks(batches: Iterator[pa.RecordBatch], split: Split, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of batches whose first column is the text."""
    held, held_bytes, seq = [], 0, 0
    for batch in batches:
        _, offsets = tb.buffers(batch.column(0))
        for a, b in tb.pieces(offsets, size):
            part = batch.slice(a, b - a)
            if held and held_bytes + offsets[b] - offsets[a] > size:
                yield _block(held, split, seq)
                held, held_bytes, seq = [], 0, seq + 1
            held.append(part)
            held_bytes += int(offsets[b] - offsets[a])
    if held:
        yield _block(held, split, seq)
        held = []
    tb.give_back()


def pack(places: np.ndarray) -> bytes:
    """Places as compressed byte planes."""
    planes = np.ascontiguousarray(places.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


def pack_words(words: pa.Array) -> bytes:
    """Words as compressed lengths and bytes."""
    data, offsets = tb.buffers(words)
    lengths = pack(np.diff(offsets))
    return len(lengths).to_bytes(4, "little") + lengths + zstandard.ZstdCompressor(level=3).compress(data.tobytes())


def unpack_words(raw: bytes) -> list[bytes]:
    n = int.from_bytes(raw[:4], "little")
    ends = np.concatenate([[0], np.cumsum(unpack(raw[4:4 + n]))]).tolist()
    data = zstandard.ZstdDecompressor().decompress(raw[4 + n:])
    return [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def by_bucket(block: Block, buckets: int) -> Iterator[tuple[int, np.ndarray, pa.Array]]:
    """The distinct words of a block dealt out by a hash of the word: bucket, places in the block's list, words."""
    data, offsets = tb.buffers(block.words)
    bucket = (tb.xxh64(data, offsets[:-1], np.diff(offsets), 7) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(bounds)):
        at = order[bounds[b]:bounds[b + 1]]
        yield int(b), at, block.words.take(pa.array(at))

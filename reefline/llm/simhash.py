"""SimHash near-duplicates by anchor-point covering.

Every text has a 64-bit SimHash.  The anchors are the words of a covering
code: bits 0-22 and bits 23-45 of a fingerprint each lie within 3 bits of
exactly one word of the perfect binary Golay code, so a fingerprint has one
home anchor, a pair of code words (2^24 anchors in all, covering radius 3 in
either block).  If two fingerprints differ in at most ``t`` bits, the second
one reaches the home anchor of the first by at most ``t`` flips; so each
fingerprint is copied to every anchor that so few flips lead to (all of them
within covering radius plus ``t``; about 68 for ``t`` = 2) and compared there with
the fingerprints at home.  No link can be missed and each is found once.

Only distinct fingerprints are compared, so a group of copies of any size is
one fingerprint, and one fingerprint has at most 2,080 others within 2 bits:
links grow with the texts, not with the square of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .components import components
from .tables import keep

# Fixed value: generator polynomial of the (23, 12) Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
BLOCK = 23
PIECE_BYTES = 1 << 20


def fingerprint_batch(column: pa.Array, words: int) -> np.ndarray:
    """SimHash of each text: a bit is 1 if more than half of the shingle hashes have it."""
    data, offsets = tb.buffers(column)
    out = np.zeros(len(offsets) - 1, np.uint64)
    for a, b in tb.pieces(offsets, PIECE_BYTES):
        part, off = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        start, end, counts = tb.word_spans(part, off)
        text, start, end = tb.joined_words(part, start, end)
        first, last, n = tb.shingle_words(counts, words)
        if not len(first):
            continue
        h = tb.xxh64(text, start[first], end[last] - start[first])
        # eight byte-wide counters to a word; a run of 255 hashes can't overflow them
        runs = -(-n // 255)
        some = np.flatnonzero(runs)
        begin = np.repeat(np.cumsum(n) - n, runs) + 255 * (np.arange(int(runs.sum())) - np.repeat(np.cumsum(runs) - runs, runs))
        lanes = np.empty((len(begin), 8), np.uint64)
        for bit in range(8):
            lanes[:, bit] = np.add.reduceat((h >> np.uint64(bit)) & np.uint64(0x0101010101010101), begin)
        per_run = lanes.view(np.uint8).reshape(len(begin), 8, 8)          # [run, bit of the byte, byte]
        at = (np.cumsum(runs) - runs)[some]
        ones = np.add.reduceat(per_run, at, axis=0, dtype=np.int64)
        on = (ones * 2 > n[some][:, None, None]).astype(np.uint64)
        places = (np.arange(8)[:, None] + 8 * np.arange(8)[None, :]).astype(np.uint64)
        out[a + some] = (on << places).sum(axis=(1, 2), dtype=np.uint64)
    return out


def with_fingerprint(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3,
                     carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, *carry, fp)``: the SimHash of each whole text as a signed 64-bit number.

    Null and wordless texts have fingerprint 0; a text of fewer than ``words``
    words has one shingle, its whole word sequence."""
    names = ["doc_id", *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = fingerprint_batch(batch.column(0), words)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fp.view(np.int64))], names=[*names, "fp"])
        tb.give_back()

    chosen = docs.select(F.col(text).alias("_text"), F.col(doc_id).alias("doc_id"), *carry)
    kinds = [f"`{n}` {chosen.schema[n].dataType.simpleString()}" for n in names]
    return chosen.mapInArrow(run, ", ".join([*kinds, "fp bigint"]))


def _syndromes() -> tuple[np.ndarray, np.ndarray]:
    """Syndrome of each single bit, and the error of least weight for each of the 2,048 syndromes."""
    def remainder(v: int) -> int:
        for bit in range(BLOCK - 1, 10, -1):
            if v >> bit & 1:
                v ^= GENERATOR << (bit - 11)
        return v

    single = np.array([remainder(1 << i) for i in range(BLOCK)], np.int64)
    leader = np.zeros(1 << 11, np.int64)
    known = np.zeros(1 << 11, bool)
    known[0] = True
    frontier = [0]
    for _ in range(3):
        following = []
        for error in frontier:
            for i in range(BLOCK):
                e = error | (1 << i)
                s = remainder(e)
                if not known[s]:
                    known[s] = True
                    leader[s] = e
                    following.append(e)
        frontier = following
    return single, leader


def _syndrome(block: np.ndarray, single: np.ndarray) -> np.ndarray:
    out = np.zeros(len(block), np.int64)
    for i in range(BLOCK):
        out ^= np.where(block >> i & 1, single[i], 0)
    return out


def reach_table(threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each syndrome the offsets from a block to every code word that at most ``threshold`` flips lead to.

    Returns the single-bit syndromes, offsets and least flips by (syndrome, place)
    (more flips than ``threshold`` mark an empty place), and the home offsets."""
    from itertools import combinations

    single, leader = _syndromes()
    by: list[dict[int, int]] = [{} for _ in leader]
    for flips in range(threshold + 1):
        for bits in combinations(range(BLOCK), flips):
            e = sum(1 << i for i in bits)
            s = int(np.bitwise_xor.reduce(single[list(bits)])) if bits else 0
            offset = e ^ leader[np.arange(len(leader)) ^ s]
            for syndrome, o in enumerate(offset):
                by[syndrome].setdefault(int(o), flips)
    width = max(map(len, by))
    offsets = np.zeros((len(by), width), np.int64)
    flips_of = np.full((len(by), width), threshold + 1, np.int64)
    for s, found in enumerate(by):
        offsets[s, :len(found)] = list(found)
        flips_of[s, :len(found)] = list(found.values())
    return single, offsets, flips_of, leader


def _blocks(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = (1 << BLOCK) - 1
    return (fp & np.uint64(low)).astype(np.int64), (fp >> np.uint64(BLOCK) & np.uint64(low)).astype(np.int64)


def home_anchors(fp: np.ndarray, table: tuple) -> np.ndarray:
    single, _, _, leader = table
    x, y = _blocks(fp)
    return (x ^ leader[_syndrome(x, single)]) | (y ^ leader[_syndrome(y, single)]) << BLOCK


def reached_anchors(fp: np.ndarray, table: tuple, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Row number and anchor for every anchor that at most ``threshold`` flips of ``fp`` have as home."""
    single, offsets, flips, _ = table
    x, y = _blocks(fp)
    sx, sy = _syndrome(x, single), _syndrome(y, single)
    rows, anchors = [], []
    for i in range(offsets.shape[1]):
        row = np.flatnonzero(flips[sx, i] <= threshold)
        near = flips[sx[row], i][:, None] + flips[sy[row]] <= threshold
        r, j = np.nonzero(near)
        r = row[r]
        rows.append(r)
        anchors.append((x[r] ^ offsets[sx[r], i]) | (y[r] ^ offsets[sy[r], j]) << BLOCK)
    return np.concatenate(rows), np.concatenate(anchors)


def links(fingerprints: DataFrame, threshold: int = 2) -> DataFrame:
    """``(a, b)``: all pairs a < b of the distinct ``fp`` values that differ in at most ``threshold`` bits."""
    table = reach_table(threshold)

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(home_anchors(fp.view(np.uint64), table)), pa.array(fp)], names=["anchor", "a"])

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch.column(0))
            for at in range(0, len(fp), 2000):
                part = fp[at:at + 2000]
                row, anchor = reached_anchors(part.view(np.uint64), table, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[row])], names=["anchor", "b"])

    at_home = fingerprints.select("fp").mapInArrow(homes, "anchor bigint, a bigint")
    around = fingerprints.select("fp").mapInArrow(copies, "anchor bigint, b bigint")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold)
    # the planner takes the copies to be as small as the fingerprints and might broadcast them: always merge
    return at_home.hint("merge").join(around, "anchor").where(near).select("a", "b")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3,
                    threshold: int = 2, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, *carry, fp, component_id, kept)``, one row per row of ``docs``.

    Fingerprints that differ in at most ``threshold`` bits are linked, and
    ``component_id`` is the least doc_id that links reach.  Null and wordless
    texts share fingerprint 0.  Null ids come after all others, so a component
    of null ids alone has a null id.  ``kept`` marks the rows of the least id
    and, among repeated rows of that id, of the least ``carry`` values (pass
    columns that tell rows apart to keep exactly one).  An empty table gives an
    empty one.  Columns other than those named are not read."""
    prints = keep(with_fingerprint(docs, doc_id, text, words, carry))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *carry)
    nodes = keep(prints.groupBy("fp").agg(F.min(order).alias("least")))
    roots = components(links(nodes, threshold))
    linked = nodes.join(roots, F.col("fp") == F.col("node"))
    of_root = linked.groupBy("root").agg(F.min("least").alias("first"))
    moved = linked.join(of_root, "root").select(F.col("fp").alias("_fp"), "first")
    named = nodes.join(moved, F.col("fp") == F.col("_fp"), "left") \
        .select(F.col("fp").alias("_fp"), F.coalesce("first", "least").alias("_first"))
    return prints.join(named, F.col("fp") == F.col("_fp")).select(
        "doc_id", *carry, "fp", F.col("_first.doc_id").alias("component_id"), order.eqNullSafe(F.col("_first")).alias("kept"))

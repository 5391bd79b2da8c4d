"""Quality rules from cross-document line frequency.

Each line is normalised (words in lower case joined by one space, digits as 0)
and hashed once per document.  A line that stands in more distinct documents of
its host than the limits allow is boilerplate of that host and is removed; a
document of which hardly anything is left after that is rejected.  Copies of one
text count as one document: they are the business of exact dedup, and counting
each of them would reject every copy of a text.

Only hashes and counts are shuffled, never a text.  A hot line is counted with
map-side combining, and the join that marks it is salted, so no task gets all
documents of a host or of a line.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .tables import ROW, keep, numbered

PIECE_BYTES = 1 << 20
WINDOW = 8              # words of a repeated passage
SALTS = 32

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
FOLDED = tb.LOWER.copy()
FOLDED[ord("0"):ord("9") + 1] = ord("0")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Limits:
    """When a line is boilerplate, and when a document is depleted.

    A line goes when it stands in more than ``documents`` distinct documents of a
    host and in more than ``share`` of them.  A document is depleted when less than
    ``left`` of its words stand in lines that stay."""
    documents: int = 10
    share: float = 0.001
    left: float = 0.2


@dataclass
class Lines:
    """The lines of a batch that hold a word: owner, words, hash of the raw and of the normalised line."""
    owner: np.ndarray
    words: np.ndarray
    raw: np.ndarray
    normal: np.ndarray


def _repeated(key: np.ndarray, owner: np.ndarray, earlier_only: bool) -> np.ndarray:
    """Which entries share ``key`` with another (with an earlier one) of the same owner."""
    out = np.zeros(len(key), bool)
    if len(key) > 1:
        order = np.lexsort((key, owner))                     # stable: entries of one key keep their order
        same = (key[order][1:] == key[order][:-1]) & (owner[order][1:] == owner[order][:-1])
        out[order[1:]] = same
        if not earlier_only:
            out[order[:-1]] |= same
    return out


def _window_hashes(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = np.zeros(len(first), np.uint64)
        for j in range(WINDOW):
            h = h * np.uint64(0x9E3779B97F4A7C15) + words[first + j]
    return tb.mixed(h)


def lines_of(data: np.ndarray, offsets: np.ndarray, start: np.ndarray, end: np.ndarray, counts: np.ndarray) -> Lines:
    """Lines (parts between ``\\n``) with at least one word."""
    n = len(offsets) - 1
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    newline = data == 0x0A
    line_end = np.flatnonzero(newline | edge[1:]) + 1
    line_start = np.concatenate([[0], line_end[:-1]])
    line_stop = line_end - newline[line_end - 1]
    in_line = np.diff(np.searchsorted(start, np.concatenate([line_start, [len(data)]])))
    some = np.flatnonzero(in_line)
    first = (np.cumsum(in_line) - in_line)[some]
    last = first + in_line[some] - 1
    owner = np.repeat(np.arange(n), counts)[first]
    joined, word_start, word_end = tb.joined_words(data, start, end)
    joined = FOLDED[joined]
    raw = tb.xxh64(data, line_start[some], line_stop[some] - line_start[some])
    normal = tb.xxh64(joined, word_start[first], word_end[last] - word_start[first])
    return Lines(owner, in_line[some], raw, normal)


@dataclass
class Measures:
    """Of a batch: ``COUNTS`` and hash of each text, and hash and words of each distinct line, text by text."""
    counts: np.ndarray
    whole: np.ndarray
    hashes: np.ndarray
    words: np.ndarray
    lines: np.ndarray


def measure(column: pa.Array) -> Measures:
    """Counts and distinct normalised lines of each whole text."""
    data, offsets = tb.buffers(column)
    n_texts = len(offsets) - 1
    out = np.zeros((n_texts, len(COUNTS)), np.int64)
    n_lines = np.zeros(n_texts, np.int64)
    hashes, line_words = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in tb.pieces(offsets, PIECE_BYTES):
        part, off, n = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], b - a
        start, end, counts = tb.word_spans(part, off)
        if not len(part):
            continue

        def per_text(mask: np.ndarray, off: np.ndarray = off) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(mask)])
            return total[off[1:]] - total[off[:-1]]

        out[a:b, 0] = counts
        out[a:b, 1] = per_text(~tb.SPACE[part] & ((part & 0xC0) != 0x80))
        out[a:b, 2] = per_text(SYMBOLS[part])
        if not len(start):
            continue
        lines = lines_of(part, off, start, end, counts)
        out[a:b, 3] = np.bincount(lines.owner, weights=_repeated(lines.raw, lines.owner, True), minlength=n)

        windows = np.maximum(counts - WINDOW + 1, 0)
        first = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows - (np.cumsum(counts) - counts), windows)
        twice = first[_repeated(_window_hashes(tb.xxh64(part, start, end - start), first), np.repeat(np.arange(n), windows), False)]
        steps = np.bincount(twice, minlength=len(start) + 1) - np.bincount(twice + WINDOW, minlength=len(start) + 1)
        out[a:b, 4] = np.bincount(np.repeat(np.arange(n), counts), weights=np.cumsum(steps[:-1]) > 0, minlength=n)

        order = np.lexsort((lines.normal, lines.owner))
        key, owner = lines.normal[order], lines.owner[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(fresh)
        n_lines[a:b] = np.bincount(owner[at], minlength=n)
        hashes.append(key[at].view(np.int64))
        line_words.append(np.add.reduceat(lines.words[order], at))
    return Measures(out, tb.xxh64(data, offsets[:-1], np.diff(offsets)), np.concatenate(hashes), np.concatenate(line_words), n_lines)


def with_measures(docs: DataFrame, doc_id: str, text: str, host: str, carry: tuple[str, ...]) -> DataFrame:
    """``(doc_id, host, *carry, *COUNTS, text_hash, line_hashes, line_words)`` of each whole text; null texts are empty."""
    others = ["doc_id", "host", *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = measure(batch.column(0))
            cuts = pa.array(np.concatenate([[0], np.cumsum(m.lines)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], *[pa.array(c) for c in m.counts.T], pa.array(m.whole.view(np.int64)),
                 pa.ListArray.from_arrays(cuts, pa.array(m.hashes)), pa.ListArray.from_arrays(cuts, pa.array(m.words))],
                names=[*others, *COUNTS, "text_hash", "line_hashes", "line_words"])

    chosen = docs.select(F.col(text).alias("_text"), F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), *carry)
    kinds = [f"`{c}` {chosen.schema[c].dataType.simpleString()}" for c in others] + [f"{c} bigint" for c in COUNTS]
    return chosen.mapInArrow(run, ", ".join([*kinds, "text_hash bigint", "line_hashes array<bigint>", "line_words array<bigint>"]))


def _salts() -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))


def boilerplate(measured: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``(host, line, documents)`` of the lines that stand in more distinct documents of a host than the limits allow.

    A null host is a host of its own.  Copies of a text have the same lines and count once."""
    distinct = measured.groupBy("host", "text_hash").agg(F.first("line_hashes").alias("lines"))
    per_line = distinct.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("documents")) \
        .where(F.col("documents") > limits.documents)
    # a host of few documents has no such line; the salt comes from the line, so the lines of one host meet its total in SALTS places
    totals = distinct.groupBy("host").agg(F.count(F.lit(1)).alias("_all")).where(F.col("_all") > limits.documents) \
        .select(F.col("host").alias("_host"), "_all", _salts().alias("_salt"))
    on = F.col("host").eqNullSafe(F.col("_host")) & (F.pmod(F.xxhash64("line"), F.lit(SALTS)) == F.col("_salt"))
    return per_line.join(totals.hint("merge"), on).where(F.col("documents") > F.col("_all") * F.lit(limits.share)).select("host", "line", "documents")


def _removed(measured: DataFrame, limits: Limits) -> DataFrame:
    """``(*ROW with suffix _hit, removed, lines)``: words and hashes of the lines that a document loses."""
    gone = keep(boilerplate(measured, limits)).select(F.col("host").alias("_host"), F.col("line").alias("_line"), _salts().alias("_salt"))
    # the salt comes from the row, so the documents of one hot line meet its copies in SALTS places
    stands = measured.select("host", *ROW, F.explode(F.arrays_zip("line_hashes", "line_words")).alias("l")) \
        .select("host", *ROW, F.col("l.line_hashes").alias("line"), F.col("l.line_words").alias("words"),
                F.pmod(F.xxhash64(*ROW), F.lit(SALTS)).cast("int").alias("_at"))
    # the planner takes the salted copies to be as small as their file and might broadcast them: always merge
    hit = stands.join(gone.hint("merge"), F.col("host").eqNullSafe(F.col("_host")) & (F.col("line") == F.col("_line")) & (F.col("_at") == F.col("_salt")))
    return hit.groupBy(*[F.col(c).alias(f"{c}_hit") for c in ROW]).agg(F.sum("words").alias("removed"), F.collect_list("line").alias("lines"))


def _at_row() -> list[Column]:
    return [F.col(c) == F.col(f"{c}_hit") for c in ROW]


def _verdicts(measured: DataFrame, removed: DataFrame, limits: Limits) -> DataFrame:
    out = measured.join(removed, _at_row(), "left").withColumn("removed_words", F.coalesce("removed", F.lit(0)))
    base_failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    depleted = F.col("n_words") - F.col("removed_words") < F.col("n_words") * F.lit(limits.left)
    return out.select("doc_id", "host", *ROW, *COUNTS, "removed_words", base_failed.alias("base_failed"), depleted.alias("depleted"),
                      (~base_failed & ~depleted).alias("kept"), "lines")


def judge(docs: DataFrame, limits: Limits = Limits(), doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """``(doc_id, host, *COUNTS, removed_words, base_failed, depleted, kept)``, one row per row of ``docs``.

    ``removed_words`` stand in lines that are boilerplate of the host.  A null text
    counts as empty: no words, so it fails the base rule.  Null ids and repeated rows
    are judged row by row, copies of a text count once for a line, an empty table
    gives an empty one, and columns other than those named are not read."""
    measured = keep(with_measures(numbered(docs), doc_id, text, host, ROW))
    return _verdicts(measured, _removed(measured, limits), limits).drop("lines", *ROW)


def cleaned(docs: DataFrame, limits: Limits = Limits(), doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns, their text without its boilerplate lines.

    A text that loses no line stays byte for byte; the lines that stay are joined by ``\\n`` as before."""
    rows = numbered(docs)
    measured = keep(with_measures(rows, doc_id, text, host, ROW))
    kept = _verdicts(measured, _removed(measured, limits), limits).where("kept") \
        .select(*[F.col(c).alias(f"{c}_hit") for c in ROW], F.col("lines").alias("_lines"))
    others = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [strip_lines(t, lines) if lines else t for t, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(texts, pa.string())], names=[*others, text])

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others]
    joined = rows.join(kept, _at_row()).select(F.col(text), "_lines", *others)
    return joined.mapInArrow(run, ", ".join([*kinds, f"`{text}` string"])).select(*docs.columns)


def strip_lines(text: str, hashes: list[int]) -> str:
    """``text`` without the lines whose normalised hash is in ``hashes``."""
    lines = text.split("\n")
    gone = set(hashes)
    found = measure(pa.array(lines))
    first = np.cumsum(found.lines) - found.lines
    return "\n".join(t for i, t in enumerate(lines) if not (found.lines[i] and int(found.hashes[first[i]]) in gone))

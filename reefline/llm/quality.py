"""Quality classifier: random Fourier features over document statistics.

Each text becomes a vector of statistics (lengths, character classes, word and
line repetition).  A random Fourier map of the standardised statistics
approximates a Gaussian kernel; ridge regression on it is fitted from normal
equations that partitions sum and a tree of sums combines, so nothing larger
than one matrix of fixed size reaches the driver.  Ridge scores become
probabilities by isotonic regression over scores that each half of the
training rows got from a model of the other half.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .tables import keep

PIECE_BYTES = 1 << 20
FEATURES = 320          # random Fourier features
WIDTH = 4.0             # of the Gaussian kernel, in standard deviations of the statistics
RIDGE = 1.0
BINS = 4096             # score bins that isotonic regression sees
THRESHOLD = 0.7

STATISTICS = (
    "log_bytes", "log_words", "log_lines", "word_length", "word_length_sd", "long_words", "upper", "lower", "digit", "space",
    "sentence_marks", "pipes", "shouting", "symbols", "wide_bytes", "capital_words", "symbol_words", "same_as_before",
    "distinct_words", "distinct_pairs", "distinct_lines", "ended_lines", "line_words", "byte_entropy")


def _class(*parts: str) -> np.ndarray:
    out = np.zeros(256, bool)
    for p in parts:
        out[[ord(c) for c in p]] = True
    return out


UPPER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
LOWER = _class("abcdefghijklmnopqrstuvwxyz")
DIGIT = _class("0123456789")
MARKS = _class(".,;:?'\"()-")
PIPES = _class("|\\/_<>[]{}=")
SHOUT = _class("!")
SYMBOL = _class("#*&%$@^~+`")
WIDE = np.arange(256) >= 0x80
CLASSES = np.stack([UPPER, LOWER, DIGIT, tb.SPACE, MARKS, PIPES, SHOUT, SYMBOL, WIDE])
KIND = np.where(CLASSES.any(axis=0), CLASSES.argmax(axis=0), len(CLASSES)).astype(np.int64)


def _distinct(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct hashes (44 bits of them) of each owner."""
    key = np.sort(owner.astype(np.uint64) << np.uint64(44) | hashes >> np.uint64(20))
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    return np.bincount((key[first] >> np.uint64(44)).astype(np.int64), minlength=n)


def statistics(column: pa.Array) -> np.ndarray:
    """One row of ``STATISTICS`` for each text; the empty text has zeros."""
    data, offsets = tb.buffers(column)
    out = np.zeros((len(offsets) - 1, len(STATISTICS)), np.float64)
    for a, b in tb.pieces(offsets, PIECE_BYTES):
        part, off = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        n, size = b - a, np.diff(off)
        if not len(part):
            continue
        owner = np.repeat(np.arange(n), size)
        per_byte = np.maximum(size, 1)[:, None]
        kinds = np.bincount(owner * 16 + KIND[part], minlength=n * 16).reshape(n, 16)[:, :len(CLASSES)] / per_byte
        used = np.bincount(owner * 256 + part, minlength=n * 256).reshape(n, 256) / per_byte
        entropy = -(used * np.log2(np.where(used > 0, used, 1))).sum(axis=1)

        start, end, words = tb.word_spans(part, off)
        length = (end - start).astype(float)
        of = np.repeat(np.arange(n), words)
        per_word = np.maximum(words, 1)

        def mean(values: np.ndarray) -> np.ndarray:
            return np.bincount(of, weights=values, minlength=n) / per_word

        average = mean(length)
        spread = np.sqrt(np.maximum(mean(length * length) - average ** 2, 0))
        counted = np.concatenate([np.zeros((1, 3)), np.cumsum(np.stack([UPPER[part], LOWER[part] | WIDE[part], SYMBOL[part] | SHOUT[part]], axis=1), axis=0)])
        in_word = counted[end] - counted[start]
        capital = (in_word[:, 0] >= 2) & (in_word[:, 1] == 0)
        h = tb.xxh64(part, start, end - start)
        same = np.zeros(len(h))
        same[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
        first, last, pairs = tb.shingle_words(words, 2)
        with np.errstate(over="ignore"):
            pair = tb.mixed(h[first] * np.uint64(3) + h[last]) if len(first) else h[:0]

        edge = np.zeros(len(part) + 1, bool)
        edge[off] = True
        newline = part == 0x0A
        breaks = np.flatnonzero(newline | edge[1:]) + 1                     # the end of each line; every text ends its last
        line_start = np.concatenate([[0], breaks[:-1]])
        line_end = breaks - newline[breaks - 1]
        some = line_end > line_start
        line_start, line_end = line_start[some], line_end[some]
        line_of = owner[line_start]
        lines = np.bincount(line_of, minlength=n)
        per_line = np.maximum(lines, 1)
        line_hash = tb.xxh64(part, line_start, line_end - line_start)
        ended = MARKS[part[line_end - 1]] if len(line_end) else np.zeros(0, bool)
        out[a:b] = np.column_stack([
            np.log1p(size), np.log1p(words), np.log1p(lines), average, spread, mean(length > 12),
            kinds[:, 0], kinds[:, 1], kinds[:, 2], kinds[:, 3], kinds[:, 4], kinds[:, 5], kinds[:, 6], kinds[:, 7], kinds[:, 8],
            mean(capital), mean(in_word[:, 2] >= 2), mean(same),
            _distinct(h, of, n) / per_word, _distinct(pair, np.repeat(np.arange(n), pairs), n) / np.maximum(pairs, 1),
            _distinct(line_hash, line_of, n) / per_line, np.bincount(line_of, weights=ended, minlength=n) / per_line,
            np.log1p(words / per_line), entropy])
    return out


def with_statistics(docs: DataFrame, text: str = "text", out: str = "statistics") -> DataFrame:
    """``docs`` without the text, with the statistics of each whole text (null: empty) as an array."""
    others = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(0))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], lists], names=[*others, out])
        tb.give_back()

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others]
    return docs.select(F.col(text).alias("_text"), *others).mapInArrow(run, ", ".join([*kinds, f"`{out}` array<double>"]))


@dataclass
class Model:
    """What scoring needs: fixed-size arrays."""

    mean: np.ndarray
    spread: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        waves = np.cos(z @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.concatenate([waves, np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return self.features(x) @ (self.weights if weights is None else weights)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.levels)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.values if not column.null_count else column.flatten()).reshape(len(column), -1)


def tree_sum(partial: DataFrame, fan: int = 16) -> np.ndarray | None:
    """Sum of the ``values`` arrays of ``partial(part, values)``, whose ``part`` is at most the number of partitions.

    Groups of ``fan`` rows are summed by tasks until ``fan`` rows are left; all rows have one fixed length."""
    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.asarray(v.values) for v in table.column("values")], axis=0)
        return pa.table({"part": table.column("part").slice(0, 1), "values": pa.array([total], pa.list_(pa.float64()))})

    partial = keep(partial)
    left = partial.count()
    while left > fan:
        partial = keep(partial.withColumn("part", F.floor(F.col("part") / fan)).groupBy("part").applyInArrow(add, "part bigint, values array<double>"))
        left, before = partial.count(), left
        if left >= before:
            break
    rows = [np.asarray(r["values"]) for r in partial.toLocalIterator()]
    return np.sum(rows, axis=0) if rows else None


def _partial(rows: DataFrame, sums) -> DataFrame:
    """One row per partition that has rows: ``sums`` adds up batches of (statistics, label, half)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for batch in batches:
            if len(batch):
                found = sums(_matrix(batch.column(0)), np.asarray(batch.column(1)).astype(float), np.asarray(batch.column(2)))
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total], pa.list_(pa.float64()))],
                                             names=["part", "values"])

    return rows.select("statistics", "label", "half").mapInArrow(run, "part bigint, values array<double>")


def isotonic(scores: np.ndarray, weight: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing fit: pool neighbours whose means are out of order.  Knots and levels of its steps' middles."""
    pools: list[list[float]] = []
    for s, w, m in zip(scores, weight, mean, strict=True):
        pools.append([w, w * m, w * s])
        while len(pools) > 1 and pools[-2][1] / pools[-2][0] >= pools[-1][1] / pools[-1][0]:
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last, strict=True)]
    return np.array([p[2] / p[0] for p in pools]), np.array([p[1] / p[0] for p in pools])


def fit(train: DataFrame, seed: int = 7) -> Model:
    """Fit from ``train(statistics, label, half)``: ``label`` 0 or 1, ``half`` 0 or 1.

    Without rows every text scores 0.5."""
    train = keep(train)
    d = len(STATISTICS)
    moments = tree_sum(_partial(train, lambda x, y, half: np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])))
    rng = np.random.default_rng(seed)
    model = Model(np.zeros(d), np.ones(d), rng.normal(size=(d, FEATURES)) / WIDTH, rng.uniform(0, 2 * np.pi, FEATURES),
                  np.zeros(FEATURES + 1), np.array([0.0]), np.array([0.5]))
    if moments is None:
        return model
    n = moments[0]
    model.mean = moments[1:d + 1] / n
    spread = np.sqrt(np.maximum(moments[d + 1:] / n - model.mean ** 2, 0))
    model.spread = np.where(spread > 1e-9, spread, 1.0)
    width = FEATURES + 1
    upper = np.triu_indices(width)

    def equations(x: np.ndarray, y: np.ndarray, half: np.ndarray) -> np.ndarray:
        parts = []
        for side in (0, 1):
            f, t = model.features(x[half == side]), y[half == side]
            parts += [(f.T @ f)[upper], f.T @ t]
        return np.concatenate(parts)

    sums = tree_sum(_partial(train, equations)).reshape(2, -1)

    def solve(s: np.ndarray) -> np.ndarray:
        gram = np.zeros((width, width))
        gram[upper] = s[:len(upper[0])]
        gram = gram + np.triu(gram, 1).T
        penalty = RIDGE * np.eye(width)
        penalty[-1, -1] = 1e-6
        return np.linalg.solve(gram + penalty, s[len(upper[0]):])

    model.weights = solve(sums.sum(axis=0))
    crossed = [solve(sums[1]), solve(sums[0])]

    def binned(x: np.ndarray, y: np.ndarray, half: np.ndarray) -> np.ndarray:
        raw = np.where(half == 0, model.raw(x, crossed[0]), model.raw(x, crossed[1]))
        at = np.clip(((raw + 1) / 3 * BINS).astype(np.int64), 0, BINS - 1)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, weights=y, minlength=BINS)]).astype(float)

    count, ones = tree_sum(_partial(train, binned)).reshape(2, -1)
    on = np.flatnonzero(count)
    model.knots, model.levels = isotonic((on + 0.5) / BINS * 3 - 1, count[on], ones[on] / count[on])
    return model


def scored(stats: DataFrame, model: Model, column: str = "statistics", out: str = "score") -> DataFrame:
    """``stats`` with ``out`` in place of the statistics."""
    others = [c for c in stats.columns if c != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(_matrix(batch.column(0))) if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(score, pa.float64())], names=[*others, out])

    kinds = [f"`{c}` {stats.schema[c].dataType.simpleString()}" for c in others]
    return stats.select(column, *others).mapInArrow(run, ", ".join([*kinds, f"`{out}` double"]))


def score_documents(docs: DataFrame, labels: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text",
                    label_id: str = "doc_id", label: str = "quality", carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, *carry, held_out, score)``, one row per row of ``docs``: the chance that the text's label is 1.

    Learns from all labelled rows that are not ``held_out`` (a condition on the
    columns of ``docs``).  Null texts count as empty and are scored too; null labels
    and labels of unknown ids are not used; a document with several labels is
    learned from once for each.  Only the text is an input of a score.  Without
    training rows every score is 0.5; an empty table gives an empty one."""
    chosen = docs.select(F.col(text).alias("_text"), F.col(doc_id).alias("doc_id"), held_out.alias("held_out"), *carry)
    stats = keep(with_statistics(chosen, "_text"))
    marked = labels.select(F.col(label_id).alias("_id"), F.col(label).cast("int").alias("label")).where("label in (0, 1)")
    train = stats.where(~F.col("held_out")).join(marked, F.col("doc_id") == F.col("_id")) \
        .select("statistics", "label", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("half"))
    return scored(stats, fit(train)).select("doc_id", *carry, "held_out", "score")

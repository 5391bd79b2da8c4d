"""Language-model scores from a probabilistic suffix tree over the words of texts.

A text is read as a start mark, its symbols and an end mark.  A word that
training has at least ``SYMBOL_LEAST`` times is a symbol of its own, all other
words are one symbol.  A state of the tree is a context: up to ``DEPTH`` own
symbols (or the start and those after it) before the next symbol, which training
has at least ``CONTEXT_LEAST`` times.  Both are plain counts, so symbols
and contexts grow with the corpus.  A context is retained by a divergence test: the bits
by which it foretells its next symbols better than its longest proper suffix
does, each occurrence judged by the counts of all others, must reach
``LEAST_BITS``.  The distribution of a state is smoothed with that of the state it
extends, and scoring uses the longest suffix of what came before that is a state.
A word that is no symbol of its own has its absolutely discounted share among
such words, and what the discount leaves is the share of all words that training
has not seen (one unknown word, as in the unigram score that stands beside the
tree's).

The tree is never in one place.  Texts are written once as blocks (distinct
words and places).  In each round a block asks for the sums of its distinct
keys (words, then runs of symbols, then contexts); keys are dealt into buckets by
hash, packed, and a bucket sends each block the sums of the keys it asked for.
A key is asked for once per block, so frequent ones weigh no more than others, and the
number of buckets grows with the corpus.  A run is counted only if the run
without its last symbol is a context, so a longer one costs little.  Runs are told
apart by 64-bit hashes, words by themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .blocks import blocks, lower_words, pack, pack_words, unpack
from .tables import keep

DEPTH = 3
SYMBOL_LEAST = 8
CONTEXT_LEAST = 8
LEAST_BITS = 8.0           # divergence over all occurrences of a context that retains it
PRIOR = 48.0               # weight of the shorter context's distribution in a state's
ROOT_PRIOR = 0.1
OTHER, END, START, OWN = 0, 1, 2, 3      # symbols; own words have those from OWN on
BLOCK_BYTES = 8 << 20
BUCKET_KEYS = 1 << 20      # tokens of the corpus for each bucket: more than its distinct keys
BITS_UNIT = 1 << 20        # sums of bits travel as whole numbers, which add up alike in any order


def squeeze(values: np.ndarray) -> bytes:
    """Whole numbers of 64 bits as compressed byte planes."""
    planes = np.ascontiguousarray(values.astype("<i8", copy=False).view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def widen(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").reshape(-1)


def packed_words(raw: bytes) -> pa.Array:
    """The words that ``pack_words`` packed, as a column."""
    n = int.from_bytes(raw[:4], "little")
    offsets = np.concatenate([[0], np.cumsum(unpack(raw[4:4 + n]))])
    return tb.strings(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[4 + n:]), np.uint8), offsets, pa.binary())


def bucket_bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins among sorted keys, and the end."""
    at = (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    return np.searchsorted(at, np.arange(buckets + 1, dtype=np.uint64))


def sums_by_key(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The sum over its key for each value."""
    if not len(keys):
        return values
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    out = np.empty(len(keys), np.int64)
    out[order] = np.repeat(np.add.reduceat(values[order], starts), np.diff(np.append(starts, len(keys))))
    return out


@dataclass
class Costs:
    """Counts over the training texts, and what follows from them."""

    tokens: int            # all, ends included
    known: int             # distinct, the end included
    ends: int
    own: int               # words that are symbols
    other_tokens: int      # of words that are not
    other_known: int
    discount: float

    def base(self, c: np.ndarray) -> np.ndarray:
        """log10 of the unigram share of words of count ``c``."""
        return np.log10(c + 0.1) - np.log10(self.tokens + 0.1 * (self.known + 1))

    def among_others(self, c: np.ndarray) -> np.ndarray:
        """log10 share of words among those that are no symbols of their own; all unknown words are one."""
        left = self.discount * self.other_known / self.other_tokens if self.other_tokens else 1.0
        seen = np.maximum(c - self.discount, 1e-9) / max(self.other_tokens, 1)
        return np.log10(np.where(c > 0, seen, max(left, 1e-9)))

    def root(self, n: np.ndarray) -> np.ndarray:
        """Share of symbols that occur ``n`` times."""
        return (n + ROOT_PRIOR) / (self.tokens + ROOT_PRIOR * (self.own + 2))


class Reading:
    """The symbols of a block's texts, read depth by depth as the sums that it asks for arrive.

    ``ask`` has, after ``read``, the sorted keys and values of what is not known yet: counts of the runs of
    one depth under that depth, bits of the contexts of one depth under minus that depth.  With all known,
    ``chance`` is the probability of each symbol and ``states`` has the retained contexts of the block."""

    def __init__(self, symbol: np.ndarray, c: np.ndarray, places: np.ndarray, counts: np.ndarray, learn: np.ndarray, costs: Costs):
        length = counts + 2
        self.offsets = np.concatenate([[0], np.cumsum(length)])
        n = int(self.offsets[-1])
        self.symbol, self.count = np.full(n, START, np.int64), np.full(n, costs.ends, np.int64)
        self.predicted, self.word = np.ones(n, bool), np.ones(n, bool)
        self.predicted[self.offsets[:-1]] = self.word[self.offsets[:-1]] = False
        self.symbol[self.offsets[1:] - 1], self.word[self.offsets[1:] - 1] = END, False
        self.symbol[self.word] = symbol[places]
        self.count[self.word] = np.where(symbol == OTHER, costs.other_tokens, c)[places]
        self.learn = np.repeat(learn, length)
        self.chance = costs.root(self.count)
        self.ask: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.states: dict[int, np.ndarray] = {}

    def read(self, known: dict[int, np.ndarray]) -> Reading:
        codes = tb.mixed(self.symbol.view(np.uint64))
        key, others = codes.copy(), self.chance.copy()       # others: chance by the counts of all other occurrences
        run = (self.symbol >= START) & (self.count >= CONTEXT_LEAST)
        run_key, run_count = key, self.count
        for depth in range(1, DEPTH + 1):
            at = np.flatnonzero(run[:-1] & self.predicted[1:]) + 1
            context, total = run_key[at - 1], run_count[at - 1]
            with np.errstate(over="ignore"):
                gram = tb.mixed(key[at] * np.uint64(0x9E3779B97F4A7C15) + codes[at - depth] + np.uint64(depth))
            grams, which = np.unique(gram, return_inverse=True)
            learn = self.learn[at]
            if depth not in known:
                self.ask[depth] = grams, np.bincount(which[learn], minlength=len(grams))
                return self
            n = known[depth][which]
            shorter = others[at]
            others[at] = (np.maximum(n - 1, 0) + PRIOR * shorter) / (total - 1 + PRIOR)
            contexts, owner = np.unique(context, return_inverse=True)
            if -depth in known:
                retained = known[-depth] >= LEAST_BITS * BITS_UNIT
                self.states[depth] = contexts[retained]
                state = retained[owner]
                self.chance[at] = np.where(state, (n + PRIOR * self.chance[at]) / (total + PRIOR), self.chance[at])
            else:
                bits = np.bincount(owner[learn], weights=np.log2(others[at] / shorter)[learn], minlength=len(contexts))
                self.ask[-depth] = contexts, np.rint(bits * BITS_UNIT).astype(np.int64)
            longer = at[(self.symbol[at] >= OWN) & (n >= CONTEXT_LEAST)]
            run = np.zeros(len(run), bool)
            run[longer] = True
            run_key, run_count = np.zeros(len(run), np.uint64), np.zeros(len(run), np.int64)
            run_key[at], run_count[at] = gram, n
            key = run_key
        return self

    def per_text(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.offsets[:-1]) if len(self.offsets) > 1 else np.zeros(0)


def _list(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def written_blocks(docs: DataFrame, held_out: Column, doc_id: str, text: str, block_bytes: int) -> DataFrame:
    """Blocks of texts: ids, words in order of their hashes with their training counts, and the place of each word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        for i, block in enumerate(blocks(batches, lower_words, block_bytes)):
            held = block.rows.column(2).combine_chunks()
            learn = ~np.asarray(held).astype(bool)
            n = np.bincount(block.places[np.repeat(learn, block.counts)], minlength=len(block.words))
            data, offsets = tb.buffers(block.words)
            order = np.argsort(tb.xxh64(data, offsets[:-1], np.diff(offsets)), kind="stable")
            yield pa.RecordBatch.from_arrays([
                pa.array([first + i]), pa.array([len(block.places) + len(learn)]), pa.array([int(learn.sum())]),
                _list(block.rows.column(1).combine_chunks()), _list(held), _list(pa.array(block.counts.astype(np.int64))),
                pa.array([pack(block.places)], pa.binary()), pa.array([pack(order)], pa.binary()),
                pa.array([pack_words(block.words.take(pa.array(order)))], pa.binary()), pa.array([squeeze(n[order])], pa.binary()),
            ], names=["block", "tokens", "learn", "ids", "held", "counts", "places", "order", "words", "n"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return keep(docs.select(F.col(text).alias("text"), F.col(doc_id).alias("doc_id"), held_out.alias("held_out")).mapInArrow(
        run, f"block bigint, tokens bigint, learn bigint, ids array<{kind}>, held array<boolean>, counts array<bigint>, "
             "places binary, order binary, words binary, n binary"))


ASKED = "kind int, bucket int, block bigint, keys binary, n binary"
SUMS = "block bigint, kind int, bucket int, sums binary, symbols binary"
WORDS = 0                  # the kind of a request for counts of words; others are depths


def _asked(rows: list[tuple]) -> pa.Table:
    schema = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("n", pa.binary())])
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def ask_words(texts: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                words, n = packed_words(batch.column(1)[row].as_py()), widen(batch.column(2)[row].as_py())
                data, offsets = tb.buffers(words)
                bounds = bucket_bounds(tb.xxh64(data, offsets[:-1], np.diff(offsets)), buckets)
                name = batch.column(0)[row].as_py()
                yield from _asked([(WORDS, int(b), name, pack_words(words.slice(bounds[b], bounds[b + 1] - bounds[b])), squeeze(n[bounds[b]:bounds[b + 1]]))
                                   for b in np.flatnonzero(np.diff(bounds))]).to_batches()

    return texts.select("block", "words", "n").mapInArrow(run, ASKED)


def word_counts(asked: DataFrame, spread: int) -> DataFrame:
    """Counts of words and the symbols of the frequent ones; one more row of each bucket has no block, and its statistics."""
    def run(rows: pa.Table) -> pa.Table:
        bucket = rows.column("bucket")[0].as_py()
        lists = [packed_words(r.as_py()) for r in rows.column("keys")]
        values = np.concatenate([widen(r.as_py()) for r in rows.column("n")])
        coded = pc.dictionary_encode(pa.concat_arrays([words.cast(pa.large_binary()) for words in lists]))
        code = np.asarray(coded.indices)
        count = np.bincount(code, weights=values, minlength=len(coded.dictionary)).astype(np.int64)
        own = np.flatnonzero(count >= SYMBOL_LEAST)
        symbol = np.zeros(len(count), np.int64)
        ranked = own[np.asarray(pc.array_sort_indices(coded.dictionary.take(pa.array(own))))]
        symbol[ranked] = OWN + (bucket << 32) + np.arange(len(own))
        other = (count > 0) & (count < SYMBOL_LEAST)
        facts = np.array([count.sum(), (count > 0).sum(), len(own), count[other].sum(), other.sum(), (count == 1).sum(), (count == 2).sum()])
        bounds = np.concatenate([[0], np.cumsum([len(words) for words in lists])])
        spans = list(zip(bounds[:-1], bounds[1:], strict=True))
        return pa.table({
            "block": pa.array([*rows.column("block").to_pylist(), None], pa.int64()),
            "kind": pa.array([WORDS] * (len(lists) + 1), pa.int32()), "bucket": pa.array([bucket] * (len(lists) + 1), pa.int32()),
            "sums": pa.array([*(squeeze(count[code[a:b]]) for a, b in spans), squeeze(facts)], pa.binary()),
            "symbols": pa.array([*(squeeze(symbol[code[a:b]]) for a, b in spans), None], pa.binary())})

    return keep(asked.repartition(spread, "kind", "bucket").groupBy("kind", "bucket").applyInArrow(run, SUMS), free_shuffles=True)


def key_sums(asked: DataFrame, spread: int) -> DataFrame:
    """For each request the sums of its keys over all requests of its kind."""
    def run(rows: pa.Table) -> pa.Table:
        keys = [np.cumsum(widen(r.as_py()).view(np.uint64), dtype=np.uint64) for r in rows.column("keys")]
        sums = sums_by_key(np.concatenate(keys), np.concatenate([widen(r.as_py()) for r in rows.column("n")]))
        bounds = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
        return pa.table({"block": rows.column("block"), "kind": rows.column("kind"), "bucket": rows.column("bucket"),
                         "sums": pa.array([squeeze(sums[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()),
                         "symbols": pa.nulls(len(keys), pa.binary())})

    return keep(asked.repartition(spread, "kind", "bucket").groupBy("kind", "bucket").applyInArrow(run, SUMS), free_shuffles=True)


def _reading(texts: pa.Table, sums: pa.Table, costs: Costs) -> tuple[Reading, np.ndarray, np.ndarray, np.ndarray]:
    """The reading of a block, and the counts and symbols of its words and their places."""
    found: dict[int, list[tuple[int, np.ndarray]]] = {}
    symbol = np.zeros(0, np.int64)
    for kind in np.unique(np.asarray(sums.column("kind").combine_chunks())) if len(sums) else ():
        of = sums.filter(pc.equal(sums.column("kind"), int(kind))).sort_by("bucket")
        found[int(kind)] = np.concatenate([widen(r.as_py()) for r in of.column("sums")])
        if kind == WORDS:
            symbol = np.concatenate([widen(r.as_py()) for r in of.column("symbols")])
    places, order = unpack(texts.column("places")[0].as_py()), unpack(texts.column("order")[0].as_py())
    c, own = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    if len(order):
        c[order], own[order] = found[WORDS], symbol
    counts = np.asarray(texts.column("counts")[0].values)
    learn = ~np.asarray(texts.column("held")[0].values).astype(bool)
    return Reading(own, c, places, counts, learn, costs).read({k: v for k, v in found.items() if k != WORDS}), c, own, places


def _by_block(texts: DataFrame, sums: DataFrame, spread: int):
    right = sums.where("block IS NOT NULL").repartition(spread, "block").groupBy("block")
    return texts.select("block", "ids", "held", "counts", "places", "order").repartition(spread, "block").groupBy("block").cogroup(right)


def ask_more(texts: DataFrame, sums: DataFrame, costs: Costs, buckets: int, spread: int, asked: tuple[int, ...]) -> DataFrame:
    """What blocks do not know yet, of the kinds ``asked``."""
    def run(key, texts: pa.Table, sums: pa.Table) -> pa.Table:
        rows = []
        for kind, (keys, n) in _reading(texts, sums, costs)[0].ask.items():
            if kind not in asked or not len(keys):
                continue
            bounds = bucket_bounds(keys, buckets)
            for b in np.flatnonzero(np.diff(bounds)):
                part = keys[bounds[b]:bounds[b + 1]]
                rows.append((kind, int(b), key[0].as_py(), squeeze(np.diff(part, prepend=np.uint64(0)).view(np.int64)), squeeze(n[bounds[b]:bounds[b + 1]])))
        return _asked(rows)

    return _by_block(texts, sums, spread).applyInArrow(run, ASKED)


def _costs(sums: DataFrame, ends: int) -> Costs:
    """From the statistics of the buckets of words: seven numbers of each bucket, added up in tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(7, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                total += widen(raw.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([int(v)]) for v in total], names=[f"f{i}" for i in range(7)])

    facts = sums.where("block IS NULL").select("sums").mapInArrow(run, ", ".join(f"f{i} bigint" for i in range(7)))
    total, known, own, others, other_known, once, twice = (int(v or 0) for v in facts.agg(*[F.sum(f"f{i}") for i in range(7)]).first())
    discount = min(max(once / (once + 2 * twice), 0.05), 0.95) if once else 0.5
    return Costs(total + ends, known + (1 if ends else 0), ends, own, others, other_known, discount)


def _known_sums(texts: DataFrame) -> tuple[DataFrame, Costs, int]:
    """All sums that the blocks ask for, as written tables, the counts over the corpus, and the number of partitions."""
    n_blocks, tokens, ends = (int(v or 0) for v in texts.agg(F.count(F.lit(1)), F.sum("tokens"), F.sum("learn")).first())
    buckets = -(-tokens // BUCKET_KEYS) or 1
    spread = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_blocks // 4)
    sums = word_counts(ask_words(texts, buckets), spread)
    costs = _costs(sums, ends)
    for depth in range(1, DEPTH + 2):                        # runs of this depth, contexts of the one before
        sums = sums.union(key_sums(ask_more(texts, sums, costs, buckets, spread, (depth, 1 - depth)), spread))
    return sums, costs, spread


def score_documents(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``, one row per row of ``docs``.

    Learns from the rows that are not ``held_out``.  Tokens are the words and one
    end for each text; ``base_score`` is the unigram score of the tokens (counts
    plus 0.1, with one place for all unknown ones) and ``score`` the log10
    probability that the suffix tree gives them.  Null and empty texts are the end
    alone; repeated rows are learned from and scored each.  With nothing to learn
    from all symbols are alike.  Extra columns are not read; an empty table gives an
    empty one.  Texts are read once."""
    kind = docs.schema[doc_id].dataType
    texts = written_blocks(docs, held_out, doc_id, text, block_bytes)
    sums, costs, spread = _known_sums(texts)

    def score(key, texts: pa.Table, sums: pa.Table) -> pa.Table:
        reading, c, own, places = _reading(texts, sums, costs)
        each = np.where(reading.predicted, np.log10(reading.chance), 0.0)
        each[reading.word] += np.where(own == OTHER, costs.among_others(c), 0.0)[places]
        base, seen = np.zeros(len(each)), np.zeros(len(each), np.int64)
        base[reading.word], seen[reading.word] = costs.base(c)[places], (c > 0)[places]
        n = np.asarray(texts.column("counts")[0].values)
        schema = pa.schema([("doc_id", texts.schema.field("ids").type.value_type), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
                            ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
        return pa.table([texts.column("ids")[0].values, texts.column("held")[0].values, pa.array(n + 1),
                         pa.array(reading.per_text(seen) + int(costs.ends > 0)), pa.array(np.full(len(n), costs.tokens)),
                         pa.array(reading.per_text(base) + costs.base(np.array([costs.ends]))[0]), pa.array(reading.per_text(each))], schema=schema)

    return _by_block(texts, sums, spread).applyInArrow(
        score, f"doc_id {kind.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def retained_contexts(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(depth, n)``: how many contexts of each depth the tree of ``docs`` retains."""
    texts = written_blocks(docs, held_out, doc_id, text, block_bytes)
    sums, costs, spread = _known_sums(texts)

    def run(key, texts: pa.Table, sums: pa.Table) -> pa.Table:
        kept = _reading(texts, sums, costs)[0].states
        return pa.table([pa.array([d for d, k in kept.items() for _ in k], pa.int32()),
                         pa.array([int(x) for k in kept.values() for x in k.view(np.int64)], pa.int64())], names=["depth", "context"])

    found = _by_block(texts, sums, spread).applyInArrow(run, "depth int, context bigint")
    return found.distinct().groupBy("depth").agg(F.count(F.lit(1)).alias("n"))

"""BPE encoding by a table of distinct words, and decoding by an id-to-piece join.

Texts are cut at places that no token reaches over (``blocks.chunks``), so the
tokens of a text are those of its words in order.  Each distinct word of the
whole table is encoded once by the tokenizer itself; the ids go back to each
block of texts that has the word and are joined in by position.  Decoding looks
every id up in the tokenizer's table of pieces, which has a fixed size.
"""

from __future__ import annotations

import itertools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .blocks import blocks, by_bucket, chunks, pack, pack_words, unpack, unpack_words

BLOCK_BYTES = 8 << 20      # a task may hold a block in two Python stages at once
GATHER_IDS = 1 << 20       # placed, or decoded, at a time


def tokenizer_json(path: str) -> str:
    """Contents of a tokenizer file of the ``tokenizers`` library; workers get them with the task."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def _words(docs: DataFrame, text: str, buckets: int, block_bytes: int) -> DataFrame:
    """Distinct words of each block, a row per bucket of words: ``(bucket, block, places, words)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, chunks, block_bytes):
            for bucket, places, words in by_bucket(block, buckets):
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([block.name]), pa.array([pack(places)], pa.binary()),
                                                  pa.array([pack_words(words)], pa.binary())], names=["bucket", "block", "places", "words"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "bucket int, block bigint, places binary, words binary")


def _positions(docs: DataFrame, doc_id: str, text: str, block_bytes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, chunks, block_bytes):
            ids = block.rows.column(1).combine_chunks()
            yield pa.RecordBatch.from_arrays([
                pa.array([block.name]),
                pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(block.counts)),
                pa.array([len(block.words)]),
                pa.array([pack(block.places)], pa.binary()),
            ], names=["block", "ids", "counts", "n_words", "places"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(text).alias("text"), F.col(doc_id).alias("doc_id")).mapInArrow(
        run, f"block bigint, ids array<{kind}>, counts array<bigint>, n_words bigint, places binary")


def encode_words(words: DataFrame, tokenizer: str) -> DataFrame:
    """``(block, places, sizes, tokens)``: the ids of the words of each row of ``_words``.

    All rows that have a word are in one bucket, and a task reads bucket after
    bucket, so the table of a bucket's distinct words is all that it holds and
    each distinct word is encoded once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(tokenizer)
        tok.no_truncation()
        tok.no_padding()
        now, table = None, {}
        for batch in batches:
            for bucket, block, places, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now:
                    now, table = bucket, {}
                held = unpack_words(packed)
                new = [w for w in held if w not in table]
                table.update(zip(new, (e.ids for e in tok.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)), strict=True))
                found = [table[w] for w in held]
                sizes = np.fromiter(map(len, found), np.int64, len(found))
                tokens = np.fromiter(itertools.chain.from_iterable(found), np.int64, int(sizes.sum()))
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([places], pa.binary()), pa.array([pack(sizes)], pa.binary()),
                                                  pa.array([pack(tokens)], pa.binary())], names=["block", "places", "sizes", "tokens"])

    return words.mapInArrow(run, "block bigint, places binary, sizes binary, tokens binary")


def _gather(values: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that start at ``begin``, one after another."""
    return values[np.arange(int(length.sum())) + np.repeat(begin - (np.cumsum(length) - length), length)]


def encode(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, tokens)``, one row per row: the ids that the tokenizer gives for each whole text.

    ``tokenizer`` holds the JSON of a byte-level BPE; strings of special tokens in
    a text become those tokens, and none is added.  Null counts as empty and has
    no ids.  ``docs`` must read the same rows in the same order each time, as a
    table in files does.  Extra columns are not read; an empty table gives an empty one."""
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = _words(docs, text, buckets, block_bytes).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    coded = encode_words(words, tokenizer)
    kind = docs.schema[doc_id].dataType

    def place(key, texts: pa.Table, found: pa.Table) -> pa.Table:
        names = pa.schema([("doc_id", texts.schema.field("ids").type.value_type), ("tokens", pa.list_(pa.int32()))])
        empty = [np.zeros(0, np.int64)]
        places, sizes, tokens = (np.concatenate([unpack(x) for x in found.column(c).to_pylist()] or empty) for c in ("places", "sizes", "tokens"))
        size, begin = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
        out = []
        for row in range(len(texts)):
            if texts.column("n_words")[row].as_py() != len(places):
                raise ValueError("the two readings of the input differ; write it to a table first")
            size[places], begin[places] = sizes, np.cumsum(sizes) - sizes
            ids = texts.column("ids")[row].values
            counts = np.asarray(texts.column("counts")[row].values)
            at = unpack(texts.column("places")[row].as_py())
            word_ends = np.concatenate([[0], np.cumsum(size[at])])
            values = np.empty(int(word_ends[-1]), np.int32)
            for a, b in tb.pieces(word_ends, GATHER_IDS):
                values[word_ends[a]:word_ends[b]] = _gather(tokens, begin[at[a:b]], size[at[a:b]])
            ends = word_ends[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32)
            del word_ends, at
            out.append(pa.table([ids, pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], schema=names))
        tb.give_back()
        return pa.concat_tables(out) if out else names.empty_table()

    return _positions(docs, doc_id, text, block_bytes).groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(
        place, f"doc_id {kind.simpleString()}, tokens array<int>")


def pieces_of(tokenizer: str) -> list[bytes]:
    """Bytes of each id.  Printable characters of a byte-level vocabulary stand for themselves as bytes, and the
    characters from U+0100 on for the remaining bytes in order."""
    held = json.loads(tokenizer)
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    byte = {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    out: dict[int, bytes] = {i: bytes(byte[c] for c in piece) for piece, i in held["model"]["vocab"].items()}
    out |= {t["id"]: t["content"].encode() for t in held["added_tokens"]}
    return [out.get(i, b"") for i in range(max(out) + 1)]


def decode(encoded: DataFrame, tokenizer: str, tokens: str = "tokens", out: str = "decoded") -> DataFrame:
    """Add ``out``, the text that the ids stand for, special tokens included; null or no ids give the empty text.

    Bytes that are not UTF-8 (ids that no text gives) become U+FFFD."""
    pieces = pieces_of(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        table = pa.array(pieces, pa.binary())
        for batch in batches:
            lists = pc.fill_null(batch.column(place), pa.scalar([], batch.column(place).type))
            begin = np.asarray(lists.offsets).astype(np.int64)
            values = np.asarray(lists.values)
            texts = []
            for a, b in tb.pieces(begin, GATHER_IDS):
                joined, ends = tb.buffers(table.take(pa.array(values[begin[a]:begin[b]])))
                ends = ends[begin[a:b + 1] - begin[a]]
                raw = joined.tobytes()
                texts += [raw[x:y].decode("utf-8", "replace") for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])
        tb.give_back()

    place = encoded.columns.index(tokens)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{kinds}, `{out}` string")


def digests(tokens: str, decoded: str) -> list[Column]:
    """``ids_sha256`` (of the decimal ids joined by commas) and ``decoded_sha256`` (of the text in UTF-8)."""
    return [F.sha2(F.array_join(F.col(tokens).cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2(decoded, 256).alias("decoded_sha256")]

import hashlib
import itertools

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reefline.llm import bpe

from .cases import frame, odd_frame, texts

PATH = public_tokenizers.path("byte_bpe_50k.json")
HARD = ["a  b", " a", "a ", "\n\n a\n", "it's we'll I'M", "x  y", "x 　 y", "x​ y", "x\u0085 y", "x\x1c y\x1f z", "\t\t.\t", "é ß  n", "12 3.4\r\n5",
        "<|endoftext|>", " <|endoftext|> <|endoftext|>x", "<|endoftext| >", "🙂 🙂﻿ 🙂", "  ᠎ a", "a\x00 b\x7f c", "é ́ x"]


@pytest.mark.parametrize("block_bytes", [200, 16 << 20])
def test_matches_the_tokenizer(spark, tmp_path, block_bytes):
    tok, tokenizer = Tokenizer.from_file(PATH), bpe.tokenizer_json(PATH)
    docs = frame(spark, [(i, t, "a") for i, t in enumerate(HARD + texts(30))], tmp_path / "d")
    want = {r["doc_id"]: tok.encode(r["text"], add_special_tokens=False).ids for r in docs.collect()}
    coded = bpe.encode(docs, tokenizer, block_bytes=block_bytes)
    got = bpe.decode(coded, tokenizer).select("*", *bpe.digests("tokens", "decoded")).collect()
    assert {r["doc_id"]: r["tokens"] for r in got} == want
    for r in got:
        text = tok.decode(want[r["doc_id"]], skip_special_tokens=False)
        assert r["decoded"] == text and r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, want[r["doc_id"]])).encode()).hexdigest()


def test_odd_rows_round_trip(spark, tmp_path):
    tok, tokenizer = Tokenizer.from_file(PATH), bpe.tokenizer_json(PATH)
    docs = odd_frame(spark, tmp_path / "d")
    got = bpe.decode(bpe.encode(docs, tokenizer), tokenizer).collect()
    want = [(str(r["doc_id"]), tok.encode(r["text"] or "", add_special_tokens=False).ids, r["text"] or "") for r in docs.collect()]
    assert sorted((str(r["doc_id"]), r["tokens"], r["decoded"]) for r in got) == sorted(want)


def test_empty_tables_and_null_ids(spark):
    tokenizer = bpe.tokenizer_json(PATH)
    assert bpe.encode(frame(spark, []), tokenizer).count() == 0
    held = spark.createDataFrame([(None,), ([],), ([50256, 64],)], "tokens array<int>")
    assert sorted(r["decoded"] for r in bpe.decode(held, tokenizer).collect()) == ["", "", "<|endoftext|>a"]


def test_every_piece_decodes_as_the_tokenizer_does():
    tok = Tokenizer.from_file(PATH)
    pieces = bpe.pieces_of(bpe.tokenizer_json(PATH))
    for i in [*range(300), *range(300, 50257, 97), 50256]:
        assert pieces[i].decode("utf-8", "replace") == tok.decode([i], skip_special_tokens=False)


def test_readings_that_differ_are_refused(spark, tmp_path, monkeypatch):
    tokenizer = bpe.tokenizer_json(PATH)
    docs = frame(spark, [(i, t, "a") for i, t in enumerate(texts(10))], tmp_path / "d")
    reading = itertools.count()
    place = bpe._positions
    monkeypatch.setattr(bpe, "_positions", lambda d, *a: place(d.withColumn("text", F.concat("text", F.lit(f" {next(reading)}"))), *a))
    with pytest.raises(Exception, match="readings of the input differ"):
        bpe.encode(docs, tokenizer).collect()

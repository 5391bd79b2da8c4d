import base64
import collections

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from reefline.llm import training_order as to

from .cases import frame, odd_frame, texts

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.mark.parametrize("n", [1, 2, 3, 17, 256, 1000])
def test_permutation_is_a_bijection_that_the_key_changes(n):
    one = to.permuted(np.arange(n), n, 5)
    assert sorted(one.tolist()) == list(range(n))
    assert n < 17 or (one != to.permuted(np.arange(n), n, 6)).mean() > 0.8
    assert n < 256 or abs(np.corrcoef(np.arange(n), one)[0, 1]) < 0.2


def _ids(text):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    if not hasattr(_ids, "coder"):
        _ids.coder = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ids.coder.encode_ordinary(text or "") + [50256]


def _order(docs, key=9, length=16, slots=8):
    return to.training_order(docs, to.ranks_of(PATH), public_tokenizers.PATTERN, key, length=length, slots=slots)


def test_shards_hold_every_sequence_once_at_its_slot(spark, tmp_path):
    docs = frame(spark, [(i, t, "a") for i, t in enumerate(texts(60))], tmp_path / "d")
    _order(docs).write.parquet(str(tmp_path / "shards"))
    out = spark.read.parquet(str(tmp_path / "shards")).orderBy("shard").collect()
    assert [r["shard"] for r in out] == list(range(len(out))) and all(r["first_slot"] == 8 * r["shard"] and r["stride"] == 32 for r in out)
    assert all(r["n_slots"] == 8 for r in out[:-1]) and all(len(r["payload"]) == 32 * r["n_slots"] for r in out)
    got = collections.Counter(x for r in out for x in np.frombuffer(r["payload"], "<u2").tolist())
    want = collections.Counter(x for r in docs.collect() for x in _ids(r["text"]))
    got[50256] -= sum(r["n_slots"] for r in out) * 16 - sum(r["used"] for r in out)
    assert got == want

    n = sum(r["n_slots"] for r in out)
    stream = b"".join(r["payload"] for r in out)
    read = to.read_slots(spark, str(tmp_path / "shards"), 5, n - 7, slots=8).collect()
    assert [r["slot"] for r in read] == list(range(5, n - 2)) and b"".join(bytes(r["tokens"]) for r in read) == stream[5 * 32:(n - 2) * 32]

    again = _order(docs).orderBy("shard").collect()
    assert [r["sha256"] for r in again] == [r["sha256"] for r in out]
    assert [r["sha256"] for r in _order(docs, key=10).orderBy("shard").collect()] != [r["sha256"] for r in out]


def test_odd_rows_and_empty_table(spark, tmp_path):
    docs = odd_frame(spark, tmp_path / "d")
    out = _order(docs).collect()
    assert sum(r["used"] for r in out) == sum(len(_ids(r["text"])) for r in docs.collect())
    assert _order(frame(spark, [])).count() == 0

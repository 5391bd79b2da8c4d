import hashlib

import numpy as np
import pyarrow as pa

from reefline.llm import fingerprints as fp

from .cases import frame, odd_frame, shingles, texts


def _jaccard(a, b):
    a, b = set(shingles(a, 5)), set(shingles(b, 5))
    return len(a & b) / len(a | b) if a | b else 1.0


def test_edit_probe_matches_brute_force(spark, tmp_path):
    held = texts(120, words=500)
    held[5], held[6], held[119] = "", " \n", "two words"
    docs = frame(spark, [(i * 3, t, "a") for i, t in enumerate(held)], tmp_path / "d").repartition(4)
    out = sorted(fp.edit_probe(docs).collect(), key=lambda r: r["doc_id"])
    assert [r["doc_id"] for r in out] == [i * 3 for i in range(120)]
    errors = []
    for i, r in enumerate(out):
        t, following = held[i], held[(i + 1) % 120]
        edited = t[:len(t) - len(t) // 4] + following[:len(t) // 4]
        assert r["n_chars"] == len(t) and r["edited_digest"] == hashlib.sha256(edited.encode()).digest()
        errors += [r["near_edited"] - _jaccard(t, edited), r["near_next"] - _jaccard(t, following)]
        assert 0 <= r["near_edited"] <= 1
    assert np.abs(errors).max() < 0.2 and abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_likeness_of_small_sets_is_unbiased():
    held = [f"alone{i}" for i in range(400)]
    low, some = fp.signatures(pa.array(held))
    near = fp.likeness(low[:-1], some[:-1], low[1:], some[1:])
    assert near.max() < 0.2
    assert (fp.likeness(low, some, low, some) == 1).all()


def test_odd_rows(spark, tmp_path):
    docs = odd_frame(spark, tmp_path / "d")
    rows = docs.collect()
    prints = fp.fingerprints(docs).collect()
    by_text = {}
    assert len(prints) == len(rows)
    joined = fp.edit_probe(docs).collect()
    assert len(joined) == len(rows) and sorted(r["n_chars"] for r in joined) == sorted(len(r["text"] or "") for r in rows)
    column = pa.array([r["text"] for r in rows])
    for r, p in zip(rows, fp.packed(*fp.signatures(column)), strict=True):
        assert by_text.setdefault(r["text"] or "", p) == p
    assert by_text[""][0] == 0 and not any(by_text[""])


def test_empty_and_single(spark):
    assert fp.edit_probe(frame(spark, [])).count() == 0 and fp.fingerprints(frame(spark, [])).count() == 0
    only = fp.edit_probe(frame(spark, [(4, "a b c d e f g h", "a")])).collect()
    assert [(r["doc_id"], r["near_next"]) for r in only] == [(4, 1.0)]

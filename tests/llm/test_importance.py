import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from reefline.llm import importance
from reefline.llm.importance import resample

from .cases import frame, lower, odd_frame, odd_texts, texts


def _features(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text or ""))
    return w, [zlib.crc32(f.encode()) % 10000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def _brute(rows, target):
    s = Counter(b for _, t in rows for b in _features(t)[1])
    q = Counter(b for t in target for b in _features(t)[1])
    big_s, big_t = sum(s.values()), sum(q.values())
    out = []
    for i, t in rows:
        w, f = _features(t)
        gains = [math.floor(1000 * math.log((q[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in f]
        weight = sum(gains) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, -r[2], -r[3]))
    rank = Counter()
    drawn = {}
    for k, r in enumerate(able[:25 * len(able) // 100], 1):
        drawn[r, rank[r]] = k
        rank[r] += 1
    seen, ranked = Counter(), []
    for r in out:
        ranked.append((*r, drawn.get((r, seen[r]))))
        seen[r] += 1
    return ranked


def _got(df):
    return Counter(tuple(r[c] for c in ("doc_id", "n_words", "n_features", "weight", "score", "rank")) for r in df.collect())


def test_matches_brute_force(spark, tmp_path):
    prose = texts(200, seed=5, words=80)
    target = texts(30, seed=5, words=80)[::3] + [None, "zz yy"]
    rows = list(enumerate(prose)) + [(None, prose[0]), (3, prose[3]), (3, prose[3]), (3, prose[4]), (900, None)]
    docs = frame(spark, [(i, t, "a") for i, t in rows], tmp_path / "d")
    bench = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(target)], "item_id bigint, text string, weight string")
    assert _got(resample(docs, bench)) == Counter(_brute(rows, target))
    assert sorted(r["rank"] for r in resample(docs, bench).collect() if r["rank"])[:3] == [1, 2, 3]


def test_odd_texts_do_not_depend_on_the_piece(monkeypatch):
    held = odd_texts() + ["A-Z éÉ 09;az", "\x7f\x00", "one"]
    for size in (1 << 21, 10):
        monkeypatch.setattr(importance, "PIECE_BYTES", size)
        parts = list(importance.features(pa.array(held)))
        counts = np.concatenate([p.counts for p in parts])
        got = np.split(np.concatenate([p.buckets for p in parts]), np.cumsum(counts)[:-1])
        assert [g.tolist() for g in got] == [_features(t)[1] for t in held]


def test_odd_rows_and_no_rows(spark, tmp_path):
    docs = odd_frame(spark, tmp_path / "d")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert _got(resample(docs, none)) == Counter(_brute(rows, []))
    bench = spark.createDataFrame([(1, "one two")], "item_id bigint, text string")
    assert resample(frame(spark, []), bench).count() == 0

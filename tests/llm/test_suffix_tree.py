import collections
import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from reefline.llm import suffix_tree as st
from reefline.llm.tables import fold

from .cases import frame, lower, odd_frame, words


def _prose(n, seed):
    """Words with an order: after each frequent word some follow far more often than others."""
    rng = random.Random(seed)
    follow = {f"w{i}": [f"w{(i * 3 + j) % 30}" for j in range(3)] for i in range(30)}
    out = []
    for _ in range(n):
        w, t = "w0", []
        for _ in range(rng.randint(1, 80)):
            w = rng.choice(follow[w]) if rng.random() < 0.9 else rng.choice([*follow, f"rare{rng.randrange(500)}"])
            t.append(w.capitalize() if rng.random() < 0.1 else w)
            w = w if w in follow else "w0"
        out.append(" ".join(t))
    return out


def test_unigram_scores_match_and_the_tree_beats_them(spark, tmp_path):
    held = _prose(600, 2)
    docs = frame(spark, [(i, t, "a") for i, t in enumerate(held)], tmp_path / "d")
    out = {r["doc_id"]: r for r in st.score_documents(docs, fold("doc_id", 10) == 0, block_bytes=20_000).collect()}
    c, n = collections.Counter(), 0
    for i, t in enumerate(held):
        if zlib.crc32(str(i).encode()) % 10:
            c.update([*words(lower(t)), None])
            n += len(words(t)) + 1
    whole = math.log10(n + 0.1 * (len(c) + 1))
    for i, t in enumerate(held):
        w, r = [*words(lower(t)), None], out[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 10 == 0) and r["train_tokens"] == n
        assert r["n_tokens"] == len(w) and r["n_known"] == sum(c[x] > 0 for x in w)
        assert abs(r["base_score"] - sum(math.log10(c[x] + 0.1) - whole for x in w)) < 1e-6
        assert r["score"] <= 0
    unseen = [r for r in out.values() if r["held_out"]]
    gain = (sum(r["score"] for r in unseen) - sum(r["base_score"] for r in unseen)) / sum(r["n_tokens"] for r in unseen)
    assert gain > 0.3


class PlainTree:
    """The same model from dictionaries of tuples, one position at a time."""

    def __init__(self, train):
        self.c = collections.Counter(w for t in train for w in t)
        self.ends = len(train)
        self.own = {w for w, n in self.c.items() if n >= st.SYMBOL_LEAST}
        rest = [n for w, n in self.c.items() if w not in self.own]
        self.other, self.other_known = sum(rest), len(rest)
        self.tokens = sum(self.c.values()) + self.ends
        once, twice = sum(n == 1 for n in self.c.values()), sum(n == 2 for n in self.c.values())
        self.discount = min(max(once / (once + 2 * twice), 0.05), 0.95) if once else 0.5
        self.next = collections.defaultdict(collections.Counter)
        for t in train:
            s = self.symbols(t)
            for i in range(1, len(s)):
                for c in self.runs(s, i):
                    self.next[c][s[i]] += 1
        self.next = {c: n for c, n in self.next.items() if sum(n.values()) >= st.CONTEXT_LEAST}
        self.kept = {c for c, n in self.next.items() if self.bits(c, n) >= st.LEAST_BITS}

    def symbols(self, t):
        return ["<s>", *(w if w in self.own else None for w in t), "</s>"]

    def runs(self, s, i):
        """Contexts before position i, shortest first."""
        for d in range(1, st.DEPTH + 1):
            if i - d < 0 or s[i - d] is None:
                return
            yield tuple(s[i - d:i])

    def root(self, x):
        n = self.other if x is None else self.ends if x == "</s>" else self.c[x]
        return (n + st.ROOT_PRIOR) / (self.tokens + st.ROOT_PRIOR * (len(self.own) + 2))

    def bits(self, context, following):
        total = 0.0
        for x, n in following.items():
            chance = [self.root(x)]
            for d in range(1, len(context) + 1):
                tail = self.next[context[-d:]]
                chance.append((max(tail[x] - 1, 0) + st.PRIOR * chance[-1]) / (sum(tail.values()) - 1 + st.PRIOR))
            total += n * math.log2(chance[-1] / chance[-2])
        return total

    def chance(self, x, contexts):
        p = self.root(x)
        for c in contexts:
            if c in self.kept:
                p = (self.next[c][x] + st.PRIOR * p) / (sum(self.next[c].values()) + st.PRIOR)
        return p

    def score(self, t):
        s, out = self.symbols(t), 0.0
        for i in range(1, len(s)):
            out += math.log10(self.chance(s[i], list(self.runs(s, i))))
            if s[i] is None:
                n = self.c[t[i - 1]]
                left = self.discount * self.other_known / self.other if self.other else 1.0
                out += math.log10((n - self.discount) / self.other if n else left)
        return out


def test_scores_and_states_are_those_of_a_plain_tree(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(st, "BUCKET_KEYS", 3000)            # several buckets
    texts = [*_prose(500, 7), *["w1 w2 w3 unseen w4"] * 30, "", "w0"]
    docs = frame(spark, [(i, t, "a") for i, t in enumerate(texts)], tmp_path / "d")
    held = fold("doc_id", 10) == 0
    split = [words(lower(t)) for t in texts]
    plain = PlainTree([t for i, t in enumerate(split) if zlib.crc32(str(i).encode()) % 10])
    for r in st.score_documents(docs, held, block_bytes=8000).collect():
        assert abs(r["score"] - plain.score(split[r["doc_id"]])) < 1e-6
    found = {r["depth"]: r["n"] for r in st.retained_contexts(docs, held, block_bytes=8000).collect()}
    assert found == collections.Counter(len(c) for c in plain.kept) and set(found) == {1, 2, 3}
    for context in [[], *([c[-d:] for d in range(1, len(c) + 1)] for c in list(plain.kept)[:50])]:
        assert abs(sum(plain.chance(x, context) for x in [None, "</s>", *plain.own]) - 1) < 1e-9


def test_the_tree_grows_with_the_corpus(spark, tmp_path):
    rng = random.Random(9)                                   # 3,000 words, each followed by one of two: 3,000 states to be found
    follow = [rng.sample(range(3000), 2) for _ in range(3000)]
    texts = []
    for _ in range(1600):
        t = [rng.randrange(3000)]
        while len(t) < 40:
            t.append(rng.choice(follow[t[-1]]))
        texts.append(" ".join(f"w{w}" for w in t))
    sizes = []
    for n in (100, 1600):
        docs = frame(spark, [(i, t, "a") for i, t in enumerate(texts[:n])], tmp_path / str(n))
        sizes.append(sum(r["n"] for r in st.retained_contexts(docs, fold("doc_id", 10) == 0).collect()))
    assert sizes[1] > 3 * sizes[0]


def test_contexts_that_foretell_nothing_are_not_retained(spark, tmp_path):
    rng = random.Random(0)
    docs = frame(spark, [(i, " ".join(rng.choice("abcd") for _ in range(40)), "a") for i in range(300)], tmp_path / "d")
    kept = {r["depth"]: r["n"] for r in st.retained_contexts(docs, F.lit(False)).collect()}
    assert sum(kept.values()) <= 6                           # of 4 + 16 + 64 and those at the start, which has no end beside it


def test_sums_by_key_and_packing():
    rng = np.random.default_rng(3)
    keys, values = rng.integers(0, 50, 1000).astype(np.uint64) << np.uint64(58), rng.integers(-9, 9, 1000)
    assert st.sums_by_key(keys, values).tolist() == [int(values[keys == k].sum()) for k in keys]
    wide = np.array([0, -1, 2**62, -2**63, 5])
    assert st.widen(st.squeeze(wide)).tolist() == wide.tolist() and not len(st.widen(st.squeeze(wide[:0])))
    ranked = np.unique(rng.integers(0, 2**63, 500).astype(np.uint64) * np.uint64(2))
    bounds = st.bucket_bounds(ranked, 7)
    assert bounds[0] == 0 and bounds[-1] == len(ranked) and (np.diff(bounds) > 30).all()


def test_odd_rows_and_empty_tables(spark, tmp_path):
    docs = odd_frame(spark, tmp_path / "d")
    out = st.score_documents(docs, fold("doc_id", 10) == 0).collect()
    rows = docs.collect()
    assert sorted(r["n_tokens"] for r in out) == sorted(len(words(r["text"])) + 1 for r in rows)
    assert all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in out)
    assert st.score_documents(frame(spark, []), fold("doc_id", 10) == 0).count() == 0
    nothing = st.score_documents(frame(spark, [(1, "a b", "a")], tmp_path / "e"), F.lit(True)).collect()
    assert [(r["n_known"], r["train_tokens"]) for r in nothing] == [(0, 0)] and math.isfinite(nothing[0]["score"])


def test_rounds_leave_no_shuffle_files(spark):
    """Files of a round's shuffles go when its sums are written, though nothing has collected the driver's garbage."""
    import time

    def files():
        manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return {name for name in manager.getAllFiles().mkString("\n").split("\n") if name.endswith(".data") and "/shuffle_" in name}

    before = files()
    asked = spark.createDataFrame([(1, b % 3, b, st.squeeze(np.array([5, 7])), st.squeeze(np.array([1, 2]))) for b in range(12)], st.ASKED)
    sums = st.key_sums(asked, 3)
    deadline = time.time() + 10
    while files() - before and time.time() < deadline:
        time.sleep(0.2)
    assert not files() - before
    assert sums.count() == 12

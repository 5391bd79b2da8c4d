import random

import numpy as np
import xxhash

from reefline.llm import simhash
from reefline.llm.components import components

from .cases import frame, odd_frame, shingles, texts


def _print(text, k=3):
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text, k)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(prints, threshold=2):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= threshold:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(prints))]


def test_fingerprints_and_components_match_brute_force(spark, tmp_path):
    rng = random.Random(1)
    base = texts(30, words=300)
    rows = [(i, t, "a") for i, t in enumerate(base)]
    for i, t in enumerate(base):
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        rows.append((100 + i, " ".join(w), "a"))
    out = {r["doc_id"]: r for r in simhash.near_duplicates(frame(spark, rows, tmp_path / "d")).collect()}
    ids = [i for i, _, _ in rows]
    prints = [_print(t) for _, t, _ in rows]
    assert [out[i]["fp"] % 2**64 for i in ids] == prints
    assert [out[i]["component_id"] for i in ids] == [ids[c] for c in _components(prints)]


def test_odd_rows(spark, tmp_path):
    docs = odd_frame(spark, tmp_path / "d")
    rows = docs.collect()
    out = simhash.near_duplicates(docs).collect()
    assert len(out) == len(rows)
    empty = [r for r in out if r["fp"] == 0]
    assert {r["component_id"] for r in empty} == {0} and len(empty) >= 4


def test_all_links_of_crowded_fingerprints(spark):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    prints = {centre ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) for _ in range(400)}
    prints |= {rng.getrandbits(64) for _ in range(200)} | {0, 2**64 - 1, 1, 3, 7}
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    found = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp bigint")).collect()
    pairs = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) % 2**64).bit_count() <= 2]
    assert sorted((r["a"], r["b"]) for r in found) == sorted(pairs)


def test_copies_are_never_broadcast(spark):
    plan = simhash.links(spark.range(5).selectExpr("id as fp"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_home_anchor_is_a_code_word_within_the_covering_radius():
    table = simhash.reach_table(2)
    prints = np.random.default_rng(2).integers(0, 2**63, 500).astype(np.uint64)
    homes = simhash.home_anchors(prints, table)
    mask = (1 << 23) - 1
    for fp, home in zip(prints.tolist(), homes.tolist(), strict=True):
        for shift in (0, 23):
            assert ((fp >> shift ^ home >> shift) & mask).bit_count() <= 3
    row, anchor = simhash.reached_anchors(prints, table, 2)
    assert len({*zip(row.tolist(), anchor.tolist(), strict=True)}) == len(row) and set(homes[:1]) <= set(anchor[row == 0])


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 40)] + [(5000, 5000), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(40)}


def test_empty_table(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0

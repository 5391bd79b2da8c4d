import re
from collections import defaultdict

from reefline.llm.exact_dedup import exact_duplicates

from .cases import frame, odd_frame


def _expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")].append(r["doc_id"])
    return groups


def test_groups_match_brute_force(spark, tmp_path):
    docs = odd_frame(spark, tmp_path / "d")
    rows = docs.collect()
    groups = _expected(rows)
    out = exact_duplicates(docs).collect()
    assert len(out) == len(rows)
    assert sorted((str(r["doc_id"]), r["group_size"]) for r in out) == sorted((str(i), len(g)) for g in groups.values() for i in g)
    kept = [r for r in out if r["kept"]]
    assert len(kept) == len(groups) and len({bytes(r["digest"]) for r in kept}) == len(groups)
    least = sorted(str(min((i for i in g if i is not None), default=None)) for g in groups.values())
    assert sorted(str(r["doc_id"]) for r in kept) == least == sorted(str(r["keep_id"]) for r in kept)


def test_a_hot_text_meets_over_many_chunks(spark, monkeypatch):
    from reefline.llm import exact_dedup

    monkeypatch.setattr(exact_dedup, "CHUNK_BYTES", 2000)
    docs = frame(spark, [(i, "same  text" if i % 3 else f"text {i}", "a") for i in range(900)]).repartition(5)
    out = {r["doc_id"]: r for r in exact_duplicates(docs).collect()}
    assert {out[i]["keep_id"] for i in out if i % 3} == {1} and out[1]["group_size"] == 600
    assert sum(r["kept"] for r in out.values()) == 301


def test_empty_table(spark):
    assert exact_duplicates(frame(spark, [])).count() == 0

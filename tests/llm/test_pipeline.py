import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from reefline.llm import quality

from .cases import odd_frame
from .test_simhash import _components, _print

SF = "/root/testdata/sf0.001"


def _stages(spark, docs, sf_dir, tmp_path):
    out = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / f"stage{k}"))
        out.append((docs, docs := spark.read.parquet(str(tmp_path / f"stage{k}"))))
    return out


def test_each_stage_matches_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    (before, scored), (_, exact), (_, near), (_, mixed), (_, coded) = _stages(spark, docs, SF, tmp_path)
    assert scored.columns == exact.columns == near.columns == mixed.columns == docs.columns

    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = {r["doc_id"] for r in scored.collect()}
    known = [(i in left) == bool(q) for i, q in labels.items()]
    assert sum(known) >= 0.95 * len(known) and len(left) < before.count()

    rows = scored.collect()
    least = {}
    for r in rows:
        t = re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")
        least[t] = min(least.get(t, r["doc_id"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in exact.collect()) == sorted(least.values())

    rows = sorted(exact.collect(), key=lambda r: r["doc_id"])
    groups = _components([_print(r["text"]) for r in rows])
    assert sorted(r["doc_id"] for r in near.collect()) == sorted({rows[g]["doc_id"] for g in groups})

    times = {}
    for r in mixed.collect():
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert max(times.values()) <= 3 and set(times) <= {r["doc_id"] for r in near.collect()}

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = {r["doc_id"]: r["text"] for r in near.collect()}
    got = [(r["doc_id"], r["tokens"]) for r in coded.collect()]
    assert len(got) == sum(times.values()) and all(ids == tok.encode(text[i], add_special_tokens=False).ids for i, ids in got)


def test_odd_rows_go_through_all_stages(spark, tmp_path, monkeypatch):
    docs = odd_frame(spark, tmp_path / "documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    (_, scored), (_, exact), (_, near), (_, mixed), (_, coded) = _stages(spark, docs, str(tmp_path), tmp_path)
    assert scored.count() == docs.count() and scored.columns == mixed.columns == docs.columns
    normal = {re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in docs.collect()}
    assert exact.count() == len(normal) and near.count() <= exact.count() and coded.count() == mixed.count()
    assert quality.THRESHOLD == 0.7


def test_empty_documents(spark, tmp_path):
    docs = odd_frame(spark).limit(0)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

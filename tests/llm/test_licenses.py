import random

import numpy as np

from reefline.llm import licenses
from reefline.llm.license_texts import TEMPLATES
from reefline.llm.licenses import scan

from .cases import frame, odd_frame, texts


def test_planted_templates_are_found_with_their_places(spark, tmp_path):
    rng = random.Random(8)
    prose = texts(len(TEMPLATES) * 2, words=200)
    rows, want = [], {}
    for i, (name, template) in enumerate(TEMPLATES):
        before = prose[2 * i] + "\né🙂 "
        shown = template if i % 2 else template.upper().replace(" ", "\n  ")
        rows.append((i, before + shown + "\n" + prose[2 * i + 1], "a"))
        want[i] = (name, len(before), shown)
        rows.append((1000 + i, prose[2 * i], "a"))
    out = {r["doc_id"]: r["matches"] for r in scan(frame(spark, rows, tmp_path / "d"), TEMPLATES).collect()}
    for i, (name, start, shown) in want.items():
        best = [m for m in out[i] if m["start"] == start]
        assert [m["license"] for m in best] == [name], (i, out[i])
        assert best[0]["coverage"] == 1.0 and shown.rstrip(".)\"'").endswith(rows[2 * i][1][:best[0]["end"]][-10:].rstrip(".)\"'"))
        assert out[1000 + i] == []
    del rng


def test_edited_and_partial_templates(spark, tmp_path):
    name, template = TEMPLATES[3]
    w = template.split()
    edited = w[:10] + ["indeed"] + w[10:30] + w[32:60] + ["other"] + w[61:]
    held = [" ".join(edited), " ".join(w[:len(w) // 2]), " ".join(w) + " . " + " ".join(w), "free of charge to any person", " ".join(w[12:])]
    out = {r["doc_id"]: r["matches"] for r in scan(frame(spark, [(i, t, "a") for i, t in enumerate(held)], tmp_path / "d"), TEMPLATES).collect()}
    assert [m["license"] for m in out[0]] == [name] and 0.9 < out[0][0]["coverage"] < 1
    assert out[0][0]["start"] == 0 and out[0][0]["end"] >= len(held[0]) - 2
    assert out[1] == [] and out[3] == [] and len(out[2]) == 2 and len(out[4]) == 1


def test_odd_rows_and_empty_table(spark, tmp_path):
    docs = odd_frame(spark, tmp_path / "d")
    out = scan(docs, TEMPLATES).collect()
    assert len(out) == docs.count() and not any(r["matches"] for r in out)
    assert scan(frame(spark, []), TEMPLATES).count() == 0


def test_short_notices_back_to_back_are_all_reported(spark, tmp_path):
    rows = [(10 * t + n, (" " + between + " ").join([TEMPLATES[k][1]] * copies).strip(), "a")
            for t, k in enumerate((0, 17)) for n, (copies, between) in enumerate(((2, ""), (5, ""), (40, ""), (40, "or")))]
    out = {r["doc_id"]: r["matches"] for r in scan(frame(spark, rows, tmp_path / "d"), TEMPLATES).collect()}
    for i, text, _ in rows:
        name, notice = TEMPLATES[0] if i < 10 else TEMPLATES[17]
        assert [m["license"] for m in out[i]] == [name] * text.count(notice), (i, out[i])
        assert all(m["coverage"] == 1.0 for m in out[i])


def test_versions_and_variants_get_their_own_name_or_none(spark, tmp_path):
    clauses = dict(TEMPLATES)
    cases = [
        ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]),
        ("This work is licensed under the GNU Lesser General Public License, version 2.1.", ["LGPL-2.1"]),
        ("This work is licensed under the GNU Lesser General Public License, version 7.", []),
        ("This work is licensed under the GNU Affero General Public License, version 3.", ["AGPL-3.0"]),
        ("This work is licensed under the GNU Library General Public License, version 3.", []),
        ("Licensed under the Apache License, Version 1.1.", ["Apache-1.1"]),
        ("Licensed under the Apache License, Version 3.7.", []),
        ("Licensed under CC BY 3.0.", ["CC-BY-3.0"]),
        ("Licensed under CC BY-SA 3.0.", ["CC-BY-SA-3.0"]),
        ("Licensed under CC BY-XY 3.0.", []),
        ("Released under an MIT License.", ["MIT"]),
        ("Released beneath the MIT License.", ["MIT"]),
        ("Released under the BEER License.", []),
        (clauses["BSD-2-Clause"], ["BSD-2-Clause"]),
        (clauses["BSD-3-Clause"], ["BSD-3-Clause"]),
        (clauses["BSD-3-Clause"].replace("1.", "*").replace("2.", "*").replace("3.", "*"), ["BSD-3-Clause"]),
        (clauses["Unlicense"], ["Unlicense"]),
    ]
    out = {r["doc_id"]: r["matches"] for r in scan(frame(spark, [(i, f"Some words before. {t} And after it.", "a") for i, (t, _) in enumerate(cases)],
                                                        tmp_path / "d"), TEMPLATES).collect()}
    for i, (text, names) in enumerate(cases):
        assert [m["license"] for m in out[i]] == names, (text, out[i])


def _best_score(template, words, band):
    """Cell by cell: the best score of a local alignment in the band."""
    score = {}
    for i in range(len(template)):
        for c in range(2 * band + 1):
            if i + c < len(words):
                step = score.get((i - 1, c), 0) + (licenses.MATCH if template[i] == words[i + c] else licenses.GAP)
                score[i, c] = max(0, step, score.get((i - 1, c + 1), 0) + licenses.GAP, (score[i, c - 1] if c else 0) + licenses.GAP)
    return max(score.values(), default=0)


def test_alignment_has_the_best_score_of_the_band():
    rng = np.random.default_rng(5)
    for _ in range(300):
        template = rng.integers(1, 6, rng.integers(3, 15)).astype(np.uint64)
        band = int(rng.integers(0, 5))
        words = np.concatenate([rng.integers(1, 6, band), template, rng.integers(1, 6, band)]).astype(np.uint64)
        words = np.delete(words, rng.integers(0, len(words), rng.integers(0, 4)))
        rows, cells = licenses.align(template, words, band)
        assert (template[rows] == words[cells]).all() and (np.diff(rows) > 0).all() and (np.diff(cells) > 0).all()
        assert ((cells - rows >= 0) & (cells - rows <= 2 * band)).all()
        lost = sum(max(a, b) - 1 for a, b in zip(np.diff(rows).tolist(), np.diff(cells).tolist(), strict=True))
        assert licenses.MATCH * len(rows) + licenses.GAP * lost == _best_score(template, words, band)

import re
from collections import Counter, defaultdict

import pyarrow as pa

from reefline.llm import line_rules
from reefline.llm.line_rules import Limits, cleaned, judge

from .cases import frame, lower, odd_frame, odd_texts, texts, words


def _normal(line):
    return re.sub("[0-9]", "0", " ".join(words(lower(line))))


def _base(text):
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    places = defaultdict(list)
    for i in range(len(w) - 7):
        places[tuple(w[i:i + 8])].append(i)
    covered = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(8)}
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), dup, len(covered)


def _gone(rows, limits):
    held, hosts = defaultdict(set), defaultdict(set)
    for _, t, s in rows:
        hosts[s].add(t or "")
        for line in (t or "").split("\n"):
            if words(line):
                held[s, _normal(line)].add(t)
    return {k for k, v in held.items() if len(v) > limits.documents and len(v) > limits.share * len(hosts[k[0]])}


def _judge(rows, limits):
    """Removed words and verdict of each (id, text, source) row."""
    gone = _gone(rows, limits)
    out = []
    for i, t, s in rows:
        n, chars, symbols, dup, repeat = _base(t)
        removed = sum(len(words(line)) for line in (t or "").split("\n") if (s, _normal(line)) in gone)
        failed = n < 20 or 100 * repeat > 30 * n
        out.append((i, s, n, chars, symbols, dup, repeat, removed, failed, n - removed < n * limits.left))
    return out


def _rows(out):
    return [tuple(r[c] for c in ("doc_id", "host", *line_rules.COUNTS, "removed_words", "base_failed", "depleted")) for r in out.collect()]


def _boilerplate_rows():
    prose = texts(60, seed=4, words=70)
    rows = []
    for i, t in enumerate(prose):
        s = ["a", "b", None][i % 3]
        header = f"Page {i} of  60\tTERMS apply " + "of use " * 10
        rows.append((i, f"{header}\n{t}\n\nall rights reserved", s))
        if i % 5 == 0:
            rows.append((100 + i, header + "\n" + "tiny end", s))                    # depleted
        if i % 7 == 0:
            rows.append((200 + i, "\n".join([t] * 3), s))
    return rows + [(300 + i, rows[0][1], "a") for i in range(20)] + [(1, None, "a"), (None, "a " * 50, None)]


def test_matches_brute_force(spark, tmp_path):
    rows = _boilerplate_rows()
    for k, limits in enumerate((Limits(), Limits(documents=3, share=0.2, left=0.5), Limits(documents=1, share=0.0))):
        out = _rows(judge(frame(spark, rows, tmp_path / f"d{k}"), limits))
        assert Counter(out) == Counter(_judge(rows, limits))
    assert any(r[9] for r in out) and any(r[7] and not r[9] for r in out)


def test_copies_of_a_text_count_once(spark):
    text = "\n".join(texts(3, seed=8, words=40))
    out = judge(frame(spark, [(i, text, "a") for i in range(50)])).collect()
    assert len(out) == 50 and {r["removed_words"] for r in out} == {0}


def test_counts_of_odd_texts_do_not_depend_on_the_piece(monkeypatch):
    held = odd_texts() + texts(20, seed=6) + ["a b c d e f g h i a b c d e f g h", "x " * 9, "l\nl\n l\nl", "# * $%&|<> #\n\n\n"]
    whole = line_rules.measure(pa.array(held))
    assert [tuple(c) for c in whole.counts.tolist()] == [_base(t) for t in held]
    monkeypatch.setattr(line_rules, "PIECE_BYTES", 10)
    small = line_rules.measure(pa.array(held))
    assert (small.counts == whole.counts).all() and (small.hashes == whole.hashes).all() and (small.words == whole.words).all()


def test_cleaned_texts(spark, tmp_path):
    rows = _boilerplate_rows()
    docs = frame(spark, rows, tmp_path / "d")
    limits = Limits(documents=3, share=0.2)
    kept = {r[0] for r in _judge(rows, limits) if not r[8] and not r[9]}
    out = cleaned(docs, limits)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert set(got) == kept
    whole = {i: (t, s) for i, t, s in rows if t}
    gone = _gone(rows, limits)
    lost = [r[0] for r in _judge(rows, limits) if r[0] in kept and r[7] and r[0] in range(60)]
    assert len(lost) > 5
    for i in lost:
        text, host = whole[i]
        assert got[i] == "\n".join(line for line in text.split("\n") if (host, _normal(line)) not in gone)


def test_odd_rows_and_no_rows(spark, tmp_path):
    docs = odd_frame(spark, tmp_path / "d")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    assert Counter(_rows(judge(docs))) == Counter(_judge(rows, Limits()))
    assert judge(frame(spark, [])).count() == 0 and cleaned(frame(spark, [])).count() == 0

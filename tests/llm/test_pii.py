import math
import re

from pyspark.sql import functions as F

from reefline.llm import pii

from .cases import frame, odd_frame

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HARD = [
    "a@b c@d.e_f@g.hh..i@j.k, x@y@z.com %+-@a.b -@-.-", "a@b.co_c@d.com.", "1.2.3.4.5.6.7.8 256.1.1.1 0255.0.0.01 1.2.3 12.34.56.78.",
    "4111 1111-1111 1111 4111111111111112 41111111111111 11 4-1-1-1", "+1 (555) 555-1234 +12 +1.2.3.4.5.6.7.8.9.0 +1 + 2 ++49 30 1234567 +1(2)3",
    "🙂 é a@b.cd 🙂 10.0.0.1", "a." * 4000 + "@x", "x@" + "a." * 9000 + "b", "1-" * 9000 + "1", "+1" + " " * 5000, "9" * 4000 + ".1.1.1", "@" * 3000, "a" * 30000 + "@",
    "+1 (555) 555-1234@x.yz", "4111111111111111.1.1.1"]


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.split(".")),
            "card": lambda: 14 <= len(digits) <= 19 and _luhn(digits), "phone": lambda: 10 <= len(digits) <= 15}[kind]()


def _base(text):
    found = sorted((m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if _valid(kind, m[0]))
    return [(a, b, kind) for a, _, b, kind in found]


def test_patterns_match_brute_force(spark, tmp_path):
    docs = frame(spark, [(i, t, "a") for i, t in enumerate(HARD)], tmp_path / "d").union(odd_frame(spark, tmp_path / "e").withColumn("doc_id", F.col("doc_id") + 1000))
    out = pii.personal_data(docs).collect()
    rows = docs.collect()
    got = sorted((str(r["doc_id"]), [(s["start"], s["end"], s["kind"]) for s in r["spans"]]) for r in out)
    assert got == sorted((str(r["doc_id"]), _base(r["text"])) for r in rows)


def _terms(text):
    import regex
    return [(m.start(), m.end(), m[0].lower()) for m in regex.finditer(r"\p{L}{3,}", text or "")]


def _brute(rows):
    """Spans of each (id, text) row: base spans, and terms that disclose an entity of their document."""
    n = len(rows)
    of_term, of_entity = {}, {}
    for d, (_, t) in enumerate(rows):
        for _, _, w in _terms(t):
            of_term.setdefault(w, set()).add(d)
        for a, b, kind in _base(t):
            of_entity.setdefault((kind, t[a:b]), set()).add(d)
    out = []
    for d, (i, t) in enumerate(rows):
        base = _base(t)
        telling = set()
        for w in {w for _, _, w in _terms(t)}:
            for e in {(kind, t[a:b]) for a, b, kind in base}:
                share = len(of_entity[e]) / n
                given = (len(of_term[w] & of_entity[e]) + pii.PRIOR * share) / (len(of_term[w]) + pii.PRIOR)
                if share < 1 and math.log2(given / share) >= pii.DISCLOSED * math.log2(1 / share):
                    telling.add(w)
        terms = [(a, b, "term") for a, b, w in _terms(t) if w in telling and not any(x < b and a < y for x, y, _ in base)]
        out.append((i, sorted(base + terms, key=lambda s: (s[0], pii.KINDS.index(s[2]), s[1]))))
    return out


def test_terms_that_reveal_an_entity_match_brute_force(spark, tmp_path):
    told = "the clinic Zanzibarov wrote to the office jo.doe@example.com about the usual matter"
    rows = [(i, told.replace("usual", f"usual{'x' * i}")) for i in range(4)]
    rows += [(10 + i, f"the clinic wrote about the office matter number {'i' * i}") for i in range(60)]
    rows += [(100, "Dear Hapaxname, the clinic " + "wrote about the office " * 30 + "to x@y.zz or 10.0.0.1, signed hapaxNAME"), (101, None), (102, "no entity but another name"),
             (103, "the clinic 10.0.0.1 10.0.0.2 10.0.0.3 matter Ölmühle"), (104, "the Ölmühle matter 10.0.0.9"), (105, "x@example.zanzibarov the office")]
    rows += [(200 + i, "hot 10.9.9.9 the clinic") for i in range(40)]
    docs = frame(spark, [(i, t, "a") for i, t in rows], tmp_path / "d")
    got = {r["doc_id"]: [(s["start"], s["end"], s["kind"]) for s in r["spans"]] for r in pii.personal_data(docs).collect()}
    assert got == dict(_brute(rows))
    marked = {i: {t[a:b] for a, b, kind in got[i] if kind == "term"} for i, t in rows}
    assert {"Hapaxname", "hapaxNAME"} <= marked[100] and "Zanzibarov" in marked[1] and not {"the", "clinic", "office"} & set().union(*marked.values())
    assert not got[102] and not got[12] and not got[101]
    both = docs.join(pii.personal_data(docs).withColumnRenamed("doc_id", "_id").withColumnRenamed("spans", "_spans"), F.col("doc_id") == F.col("_id"))
    clear = {r["doc_id"]: r["t"] for r in both.select("doc_id", pii.redacted(F.col("text"), F.col("_spans")).alias("t")).collect()}
    assert "Zanzibarov" not in clear[1] and "[EMAIL]" in clear[1] and "jo.doe" not in clear[1] and clear[12] == rows[4 + 2][1]


def test_a_text_with_very_many_matches(spark, tmp_path):
    many = " ".join(f"10.{i // 250}.{i % 250}.7 word" for i in range(50_000))
    docs = frame(spark, [(1, many, "a"), (2, "plain", "a")], tmp_path / "d")
    spans = {r["doc_id"]: r["spans"] for r in pii.personal_data(docs).collect()}
    assert [(s["start"], s["end"]) for s in spans[1] if s["kind"] == "ip"] == [(m.start(), m.end()) for m in re.finditer(BASE["ip"], many)
                                                                             if _valid("ip", m[0])] and spans[2] == []


def test_empty_table(spark):
    assert pii.personal_data(frame(spark, [])).count() == 0


def test_joined(spark):
    df = spark.createDataFrame([([(0, 1, 4, "ip")],), ([],)], "spans array<struct<start:int,rank:int,end:int,kind:string>>")
    assert [r[0] for r in df.select(pii.joined(F.col("spans"))).collect()] == ["ip:0:4", ""]

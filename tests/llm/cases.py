"""Small inputs that hold the odd cases, and plain re-statements of what words and shingles are."""

import random
import re

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # columns whose names the operators use inside
    *[T.StructField(n, T.StringType()) for n in ("fp", "row", "block", "word", "statistics", "label", "score", "size", "copies", "spans",
                                                  "kept", "digest", "tokens", "slot", "matches", "_text", "edge", "part")],
])


def texts(n=40, seed=3, words=60):
    """Prose of invented words with some repetition."""
    rng = random.Random(seed)
    stock = ["".join(rng.choice(["an", "to", "re", "Thi", "él", "ß", "ou", "st"]) for _ in range(rng.randint(1, 4))) for _ in range(200)]
    return [" ".join(rng.choice(stock) for _ in range(rng.randint(1, words))) + rng.choice([".", "\n", "  ", "", "!\n\nAnd\tso"]) for _ in range(n)]


def odd_texts():
    long_word = "x" * 70_000
    prose = texts(6, seed=9, words=400)
    return [None, "", "   ", "\n\t ", "One", "one two", "one two three four", *prose, prose[0], prose[0].replace(" ", "  "), long_word,
            " ".join(prose * 30), "a.b." * 3000, "9" * 5000, "<|endoftext|> and <|endoftext|>", "nbsp  here  x 　y \u0085 z", "🙂 émoji‍ 👩‍🔬 ok",
            "mail a.b@c-d.example.com, +1 (555) 555-1234; 10.0.0.255 4111 1111 1111 1111"]


def frame(spark, rows, path=None):
    """A documents table of (doc_id, text, source) rows; with ``path`` it is written in several files and read."""
    width = len(SCHEMA) - 5
    df = spark.createDataFrame([(i, t, "en", s, len(t) if t else 0, *["clash"] * width) for i, t, s in rows], SCHEMA)
    if path is None:
        return df
    df.repartition(3).write.parquet(str(path))
    return spark.read.parquet(str(path))


def odd_frame(spark, path=None):
    """Every odd text, null ids, repeated rows, ids that repeat with other texts, null and rare sources."""
    rows = [(i, t, ["a", "b", None][i % 3]) for i, t in enumerate(odd_texts())]
    rows += [(None, "no id", "a"), (None, "no id", None), (3, "an id again", "b"), (7, odd_texts()[7], "a"), (7, odd_texts()[7], "a")]
    return frame(spark, rows, path)


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, k):
    w = words(lower(text or ""))
    return [" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))] if w else []

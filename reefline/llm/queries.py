"""The registered query of each operator, over its whole table, and SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


OP5_SQL = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('17:' || doc_id::VARCHAR), 1, 15))::BIGINT AS u
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight,
         source_size * 3.0::DOUBLE AS cap FROM totals),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) /
            (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed
  WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, CASE WHEN level >= cap / weight THEN cap ELSE weight * max(level) FILTER (level < cap / weight) OVER () END AS target
  FROM levels),
rests AS (
  SELECT *, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END + 1e-12)::BIGINT AS whole FROM targets),
placed AS (
  SELECT d.doc_id, d.size, r.source_size, r.target, r.whole, r.target - r.whole * r.source_size AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.u, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized d JOIN rests r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, round(target, 3) AS target,
       (size * (whole + CASE WHEN rest > 0 AND size > 0 AND before + size / 2.0 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed
"""


@query("op5_mix_to_weights", OP5_SQL)
def op5_mix_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", F.round("target", 3).alias("target"), (F.col("size") * F.col("copies")).alias("taken"))


@query("op6_simhash_near_dedup")
def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


OP7_SQL = """
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM n
"""


@query("op7_exact_dedup", OP7_SQL)
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query("op2_document_fingerprints")
def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import edit_probe

    def text(c: str):
        return F.lower(F.hex(c))

    return edit_probe(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_chars", text("edited_digest").alias("edited_sha256"), text("fingerprint").alias("fingerprint"),
        text("edited_fingerprint").alias("edited_fingerprint"), "near_edited", "near_next")


@query("op3_bpe_roundtrip")
def op3_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import decode, encode, tokenizer_json

    tokenizer = tokenizer_json(public_tokenizers.path("byte_bpe_50k.json"))
    both = decode(encode(table(spark, sf_dir, "documents"), tokenizer), tokenizer)
    return both.select("doc_id", F.size("tokens").cast("bigint").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("tokens").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op10_quality_classifier")
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import THRESHOLD, score_documents
    from .tables import fold

    scored = score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold("doc_id", 4) == 2)
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


@query("op4_suffix_tree_scores")
def op4_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_tree import score_documents
    from .tables import fold

    return score_documents(table(spark, sf_dir, "documents"), fold("doc_id", 10) == 0)


@query("op8_pii_sanitise")
def op8_pii_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, joined, personal_data

    found = personal_data(table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "term")
    return found.select("doc_id", *[count(k) for k in KINDS[:-1]], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@query("op1_training_order")
def op1_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .training_order import ranks_of, training_order

    ranks = ranks_of(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return training_order(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, key=2024)


@query("op9_license_scan")
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_texts import TEMPLATES
    from .licenses import scan

    found = scan(table(spark, sf_dir, "documents"), TEMPLATES)
    listed = F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["start"], m["end"], F.round(m["coverage"], 4)))
    return found.select("doc_id", F.size("matches").cast("bigint").alias("n_matches"),
                        F.array_join(F.array_sort(F.array_distinct(F.col("matches.license"))), ",").alias("licenses"), F.array_join(listed, ",").alias("matches"))


# words, lines and windows of each text; a line's documents are counted per source over distinct texts
OP11_SQL = r"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
worded AS MATERIALIZED (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM texts),
lines AS MATERIALIZED (
  SELECT r, source, t, line,
         regexp_replace(translate(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' '),
                                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g') AS normal,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
  FROM (SELECT r, source, t, unnest(string_split(t, chr(10))) AS line FROM worded)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
hosts AS (SELECT source, count(DISTINCT t) AS n FROM texts GROUP BY source),
gone AS (
  SELECT l.source, l.normal FROM lines l JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source
  GROUP BY l.source, l.normal, h.n HAVING count(DISTINCT l.t) > 10 AND count(DISTINCT l.t) > h.n * 0.001::DOUBLE),
per_line AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY r),
removed AS (
  SELECT l.r, sum(l.words) AS n FROM lines l JOIN gone g ON l.source IS NOT DISTINCT FROM g.source AND l.normal = g.normal GROUP BY l.r),
places AS (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM worded WHERE len(w) >= 8),
windows AS (SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(w[i:i + 7], ' ')) AS n FROM places),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM windows, range(8) AS s(k) WHERE n >= 2 GROUP BY r),
counted AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(p.n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         coalesce(x.n, 0)::BIGINT AS removed_words
  FROM worded d LEFT JOIN per_line p ON p.r = d.r LEFT JOIN covered c ON c.r = d.r LEFT JOIN removed x ON x.r = d.r),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted)
SELECT *, NOT base_failed AND NOT (n_words - removed_words < n_words * 0.2::DOUBLE) AS kept FROM judged
"""


@query("op11_line_rules", OP11_SQL)
def op11_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_rules import judge

    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words", "base_failed", "kept")


def _op12_sql(rounds: int = 5) -> str:
    """Lloyd's rounds unrolled: components in long form, one assignment and one update a round."""
    def assign(r: int) -> str:
        return f"""
far{r} AS (
  SELECT v.r, c.cluster, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS distance
  FROM parts v JOIN cent{r} c ON v.d = c.d GROUP BY v.r, c.cluster),
near{r} AS MATERIALIZED (
  SELECT r, min(cluster) AS cluster, any_value(distance) AS distance
  FROM (SELECT *, min(distance) OVER (PARTITION BY r) AS least FROM far{r}) WHERE distance = least GROUP BY r)"""

    def update(r: int) -> str:
        return f""",
mean{r} AS (
  SELECT n.cluster, v.d, sum(v.x) AS s, count(*) AS n FROM near{r} n JOIN parts v ON v.r = n.r GROUP BY n.cluster, v.d),
cent{r + 1} AS MATERIALIZED (
  SELECT c.cluster, c.d, CASE WHEN m.n IS NULL THEN c.x ELSE ((m.s - ((m.s % m.n) + m.n) % m.n) // m.n)::BIGINT END AS x
  FROM cent{r} c LEFT JOIN mean{r} m ON m.cluster = c.cluster AND m.d = c.d),"""

    body = "".join(assign(r) + (update(r) if r < rounds else "") for r in range(rounds + 1))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR)) AS r, vec_id, embedding AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
parts AS MATERIALIZED (
  SELECT r, d, floor(256 * e[d]::DOUBLE)::BIGINT AS x FROM (SELECT r, e, unnest(range(1, 65)) AS d FROM kept)),
cent0 AS MATERIALIZED (SELECT r - 1 AS cluster, d, x FROM parts WHERE r <= 40),{body},
digests AS (
  SELECT cluster, sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM cent{rounds} GROUP BY cluster)
SELECT k.vec_id, n.cluster::INTEGER AS cluster, n.distance, sum(n.distance) OVER (PARTITION BY n.cluster)::BIGINT AS cluster_inertia,
       sum(n.distance) OVER ()::BIGINT AS inertia, g.centroid_sha256
FROM near{rounds} n JOIN kept k ON k.r = n.r JOIN digests g ON g.cluster = n.cluster
"""


@query("op12_centroid_clusters", _op12_sql())
def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroids import report

    return report(table(spark, sf_dir, "embeddings"))


# CRC-32 of each distinct feature: the table of 256 remainders by eight halvings, then one step a byte
OP13_SQL = r"""
WITH RECURSIVE halving AS (
  SELECT i, 0 AS k, i::BIGINT AS c FROM range(256) AS s(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END FROM halving WHERE k < 8),
remainders AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM halving WHERE k = 8),
texts AS (
  SELECT row_number() OVER () AS r, 0 AS side, doc_id, text FROM documents
  UNION ALL SELECT row_number() OVER (), 1, NULL, text FROM benchmark),
worded AS MATERIALIZED (
  SELECT *, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
grams AS MATERIALIZED (
  SELECT side, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM worded),
bytes AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM grams)),
hashed AS MATERIALIZED (
  SELECT f, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
                            lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1])), 4294967295::BIGINT) % 10000 AS bucket
  FROM bytes, remainders),
counts AS (
  SELECT bucket, (count(*) FILTER (side = 0))::DOUBLE AS s, (count(*) FILTER (side = 1))::DOUBLE AS t
  FROM grams JOIN hashed USING (f) GROUP BY bucket),
totals AS (SELECT (count(*) FILTER (side = 0))::DOUBLE AS s, (count(*) FILTER (side = 1))::DOUBLE AS t FROM grams),
gains AS (
  SELECT bucket, floor(1000 * ln((c.t + 1) * (a.s + 10000) / ((c.s + 1) * (a.t + 10000))))::BIGINT AS gain FROM counts c, totals a),
weights AS (
  SELECT r, count(*) AS n, sum(gain)::BIGINT AS total FROM grams JOIN hashed USING (f) JOIN gains USING (bucket) WHERE side = 0 GROUP BY r),
scored AS (
  SELECT d.doc_id, len(d.w) AS n_words, coalesce(n, 0)::BIGINT AS n_features,
         coalesce((total - ((total % n) + n) % n) // n, 0)::BIGINT AS weight,
         floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || d.doc_id::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS noise
  FROM worded d LEFT JOIN weights x ON x.r = d.r WHERE side = 0),
placed AS (
  SELECT *, weight + noise AS score, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY weight + noise DESC, doc_id) AS place,
         count(*) FILTER (n_words >= 20) OVER () AS able FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= able * 25 // 100 THEN place END::BIGINT AS rank FROM placed
"""


@query("op13_importance_resample", OP13_SQL)
def op13_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")

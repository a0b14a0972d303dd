"""The queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, licenses, mixing, negatives, pii, pivots, rlz, secret_scan, sharding, simhash, toxicity, whitening
from .common import table


def op1_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_vectors(table(spark, sf_dir, "embeddings"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoding_digests(bpe.encode_decode(table(spark, sf_dir, "documents")))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op4_rlz(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rlz.drop_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digests(pii.find_pii(table(spark, sf_dir, "documents")), pii.BASE)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fitted(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).select("doc_id", F.coalesce(toxicity.held_out("doc_id"), F.lit(False)).alias("held_out"), "score", "predicted")


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digests(secret_scan.find_secrets(table(spark, sf_dir, "documents")), secret_scan.KINDS)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.interleaved_shards(table(spark, sf_dir, "documents"), shards=40)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "stratum",
    )


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_pivots, op2_bpe, op3_licenses, op4_rlz, op5_pii, op6_simhash, op7_toxicity, op8_decontam, op9_secrets, op10_sharding, op11_negatives, op12_mixing, op13_whitening]
    return {f.__name__: f for f in found}


def _license_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"

    def canonical(text: str) -> str:
        out = f"regexp_replace(lower({text}), {quoted(licenses.NO_NOTICE)}, {quoted(licenses.MARKED.replace('$', chr(92)))}, 'g')"
        out = f"replace(regexp_replace({out}, {quoted(licenses.COPYRIGHT_LINE)}, '', 'g'), 'qqcopyright', 'copyright')"
        out = f"regexp_replace({out}, {quoted(licenses.WORDLESS)}, ' ', 'g')"
        for pattern, to in licenses.SPELLINGS:
            out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(to.replace('$', chr(92)))}, 'g')"
        return f"list_filter(list_transform(string_split({out}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"

    known = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in licenses.KNOWN)
    return f"""
WITH known AS (
  SELECT DISTINCT license, array_to_string({canonical("body")}, ' ') AS body FROM (VALUES {known}) t(license, body)),
parts AS (
  SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), {quoted(licenses.PARAGRAPH)}),
    lambda p: {canonical("p")}), lambda p: len(p) > 0) AS p FROM documents),
units AS (
  SELECT doc_id, 'line' AS unit, unnest(flatten(p)) AS body FROM parts
  UNION ALL SELECT doc_id, 'paragraph', unnest(list_transform(list_filter(p, lambda x: len(x) > 1), lambda x: array_to_string(x, ' '))) FROM parts
  UNION ALL SELECT doc_id, 'document', array_to_string(flatten(p), ' ') FROM parts WHERE len(p) > 1)
SELECT doc_id, license, unit, count(*) AS n FROM units JOIN known USING (body) GROUP BY ALL"""


LINKS_SQL = """
WITH RECURSIVE pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
  AND list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a)
SELECT e.vec_id, (SELECT count(*) FROM pairs p WHERE p.a = e.vec_id) AS n_links, min(r.b) AS component_id, min(r.b) = e.vec_id AS kept
FROM embeddings e JOIN reach r ON r.a = e.vec_id GROUP BY e.vec_id"""

REPEATS_SQL = r"""
WITH docs AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM docs) q),
later AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1),
gone AS (SELECT doc_id, list(DISTINCT j) AS g FROM (SELECT doc_id, unnest(range(i, i + 20)) AS j FROM later) q GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(len(g), 0) AS n_removed,
  sha256(array_to_string(CASE WHEN g IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(g, i)) END, ' ')) AS kept_sha256
FROM docs d LEFT JOIN gone USING (doc_id)"""


#: Rows that repeat an id are told apart by a number; vectors of one length are assumed.
NEGATIVES_SQL = """
WITH taking AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.rid, a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS mate, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM taking a JOIN taking r ON a.rid <> r.rid WHERE a.vec_id % 100 = 0),
mates AS (SELECT * FROM scores WHERE mate QUALIFY row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.rid, p.vec_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
  n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM mates p JOIN scores n ON n.rid = p.rid AND NOT n.mate AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
QUALIFY rank <= 5"""


#: A slot of rank r takes words r * 1024 to r * 1024 + 1023 of its source's stream, up to the target, so all slots take the stream up to there.
MIXING_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS k, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
sources AS (
  SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source) q),
shared(round, source, source_size, w, target, excess) AS (
  SELECT 0, source, source_size, w, 0.0::DOUBLE, 1.5::DOUBLE * (SELECT CAST(sum(source_size) AS DOUBLE) FROM sources) FROM sources
  UNION ALL SELECT round + 1, source, source_size, w, least(t, 2.0::DOUBLE * source_size), sum(greatest(t - 2.0::DOUBLE * source_size, 0)) OVER ()
  FROM (SELECT *, target + CASE WHEN target < 2.0::DOUBLE * source_size THEN excess * w / sum(CASE WHEN target < 2.0::DOUBLE * source_size THEN w END) OVER () ELSE 0 END AS t
    FROM shared WHERE excess > 1e-9) q),
targets AS (SELECT source, source_size, target, CAST(round(target) AS BIGINT) AS quota FROM shared QUALIFY row_number() OVER (PARTITION BY source ORDER BY round DESC) = 1),
passes AS (
  SELECT d.k, d.size, t.quota, sum(d.size) OVER (PARTITION BY d.source ORDER BY part, md5('12:' || part || ':' || coalesce(CAST(d.doc_id AS VARCHAR), '') || ':' || d.size), d.doc_id, d.size
    ROWS UNBOUNDED PRECEDING) - d.size AS start
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source, (VALUES (0), (1)) p(part) WHERE d.size > 0),
taken AS (SELECT k, sum(greatest(least(start + size, quota) - start, 0)) AS n FROM passes GROUP BY k)
SELECT d.doc_id, d.size, t.source_size, t.target, CAST(coalesce(n, 0) AS BIGINT) AS taken
FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN taken USING (k)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_pivots": LINKS_SQL, "op3_licenses": _license_sql(), "op4_rlz": REPEATS_SQL, "op11_negatives": NEGATIVES_SQL, "op12_mixing": MIXING_SQL}

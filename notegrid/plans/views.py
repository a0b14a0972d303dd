"""Inputs of the registered queries, derived from the given tables by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NL = "chr(10)"
NOTES = f"""
SELECT doc_id,
  'area' || cast(doc_id % 7 AS STRING) || '/nota-' || cast(doc_id AS STRING) || '.md' AS path,
  '---' || {NL} || 'titulo: Nota ' || cast(doc_id AS STRING) || {NL}
  || CASE doc_id % 4 WHEN 0 THEN 'estado: Vigente' || {NL} WHEN 1 THEN 'status:  Borrador ' || {NL} WHEN 2 THEN 'estado: archivado' || {NL} ELSE '' END
  || 'tags: [' || lang || ', ' || source || ']' || {NL}
  || CASE doc_id % 5 WHEN 0 THEN 'fecha_vigencia: 2024-01-15' || {NL} WHEN 1 THEN 'fecha_derogacion: 2023/06/30' || {NL}
       WHEN 2 THEN 'vigente_desde: 01-02-2030' || {NL} WHEN 3 THEN 'fecha_revision: 2020' || {NL} ELSE '' END
  || '---' || {NL} || '# Nota ' || cast(doc_id AS STRING) || {NL} || '## Uno' || {NL} || coalesce(text, '') || {NL}
  || '[[Nota ' || cast((7 * doc_id + 3) % (SELECT count(*) FROM {{documents}}) AS STRING) || '|ver]]' || {NL}
  || CASE WHEN doc_id % 5 = 0 THEN 'Ver [[Nota 0]] y otra vez [[Nota 0]].' || {NL} ELSE '' END
  || CASE WHEN doc_id % 9 = 0 THEN '![[Inexistente#Parte dos]]' || {NL} ELSE '' END
  || CASE WHEN doc_id % 6 = 0 THEN '```' || {NL} || '[[Nota 1]] #nada' || {NL} || '```' || {NL} ELSE '' END
  || CASE WHEN doc_id % 11 = 0 THEN '> [!danger] Ojo' || {NL} || '> ya no rige' || {NL} ELSE '' END
  || 'Final con #' || lang || ' ^fin' || cast(doc_id AS STRING) || {NL} AS raw
FROM {{documents}}"""

CHUNK_VECTORS = """
SELECT cast(vec_id AS BIGINT) AS chunk_id, cast(floor(vec_id / 5) AS BIGINT) AS doc_id,
  CASE WHEN floor(vec_id / 5) % 7 = 0 THEN NULL ELSE cast(floor(vec_id / 5) * 3 + floor((vec_id % 5) / 2) AS BIGINT) END AS parent_index,
  embedding, label, CASE WHEN vec_id % 3 = 0 THEN 'vigente' ELSE 'borrador' END AS status
FROM {embeddings}"""
QUERIES_V = "SELECT cast(vec_id AS BIGINT) AS query_id, embedding, label FROM {embeddings} WHERE vec_id % 20 = 0"
CONTEXT_V = "SELECT cast(vec_id - 1 AS BIGINT) AS query_id, embedding FROM {embeddings} WHERE vec_id % 20 = 1"
EDGES = """
SELECT doc_id AS source, (7 * doc_id + 3) % (SELECT count(*) FROM {documents}) AS target FROM {documents}
UNION ALL SELECT doc_id, cast(0 AS BIGINT) FROM {documents} WHERE doc_id % 5 = 0"""
TURNS = """
SELECT conv_id AS conversation_id, conv_id % 5 AS project_id, cast(conv_id AS BIGINT) * 100000 + turn AS turn_id, text AS question, answer
FROM (SELECT conv_id, turn, role, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer,
        lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM {conversations}) t
WHERE role = 'user' AND next_role = 'assistant'"""
SCORES = """
SELECT d.doc_id, (coalesce(d.n_chars, 0) % 997) / cast(997 AS DOUBLE) AS score, l.quality = 1 AS answerable
FROM {documents} d JOIN (SELECT doc_id, max(quality) AS quality FROM {labels} GROUP BY doc_id) l ON d.doc_id = l.doc_id"""
TABLES = ("documents", "embeddings", "benchmark", "conversations", "labels", "events")


def frames(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A view over the tables that its SQL names."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def duck(sql: str) -> str:
    """The same SQL over tables of that name."""
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql

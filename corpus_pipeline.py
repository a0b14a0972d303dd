"""Training-data pipeline over documents: five stages, each calling one operator of notegrid.llm.

1. toxicity: documents that score as toxic go.
2. simhash: of each group of near duplicates (op6's links, and five-word shingles of a similarity of
   0.8 or more) the document with the smallest id stays.
3. decontamination: documents that hold a benchmark item go.
4. secrets: every secret is masked in its text and n_chars follows; no document goes.
5. bpe: the texts become token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegrid.llm import bpe, decontam, secret_scan, simhash, toxicity
from notegrid.llm.common import saved, table

#: Jaccard similarity of five-word shingles from which documents are near duplicates.
NEAR_SIMILARITY = 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs, min_similarity=NEAR_SIMILARITY)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secret_scan.mask_secrets(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token_ids and the digests of op2."""
    encoded = bpe.encode_decode(docs)
    return bpe.encoding_digests(encoded, keep=("ids",)).withColumnRenamed("ids", "token_ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", mask_secrets),
    ("bpe", encode),
]

#: Trained models, fingerprints and exact BPE merging have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

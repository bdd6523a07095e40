"""The corpus pipeline: stages that each take (spark, docs, sf_dir) and return the documents they keep.

language ID drops texts without a language (score under 0.4 or no letter); MinHash near-dedup keeps the smallest doc_id of
each group (five-word shingles, similarity 0.8); PII puts surrogates into the texts; mixing repeats or drops documents by
their source's target; SentencePiece gives each text its piece ids. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.llm import language_id, minhash, mixing, pii, sentencepiece_fst
from voxlake.llm.common import stored


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.accepted(docs, language_id.fit(language_id.sample(docs)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.first_of_groups(docs)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.surrogated(docs, pii.key_of(spark))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = sentencepiece_fst.encoded(docs, keep=("lang", "source"))
    return pieces.withColumn("n_pieces", F.array_size("piece_ids").cast("long"))


STAGES = [("language_id", by_language), ("minhash_dedup", near_dedup), ("pii_surrogates", surrogates), ("mix_sources", mix_sources), ("sentencepiece", to_pieces)]
#: A random field, keyed surrogates and a piece lattice have no SQL form; tests compare each stage with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

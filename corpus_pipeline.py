"""From raw documents to token ids: quality, near duplicates, benchmark passages, personal
data, encoding. Each stage takes all that the one before has kept.

Defined results: a null, empty or wordless text fails the base quality rules and goes; very
long texts pass through whole; of repeated rows one stays, whether they have an id or not
(of a group of near duplicates, the row with the least id); without benchmark items nothing
is contaminated; extra columns, whatever their names, are kept by all stages but the last,
which returns ids and token ids; an empty table gives an empty one.

The key of the pseudonyms is the setting ``spark.kvstrata.pii.secret``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kvstrata.llm import decontaminate, neardup, pii, quality, sentencepiece_bpe
from kvstrata.llm.common import release, remove_path, shared_path, table
from kvstrata.llm.queries import pii_key, tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their group's thresholds reject go."""
    return quality.filter_quality(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 of five-word shingles, one stays."""
    return neardup.drop_near_duplicates(docs, shingle=5, similarity=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold eight words in a row of any benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), min_items=1)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes pseudonyms of the same format."""
    return pii.pseudonymize(docs, pii_key(spark))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with begin and end ids."""
    return sentencepiece_bpe.encode_documents(docs, tokenizer_path("piece_bpe_32k.model"), with_text=False)


STAGES = [("quality rules", quality_stage), ("near-duplicate removal", dedup_stage), ("benchmark decontamination", decontamination_stage), ("pseudonyms", pii_stage), ("SentencePiece encoding", encoding_stage)]

#: Encoding can't be said in SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is a Parquet table in the shared
    folder, which the next one reads. A stage's own tables and the table before it go once
    its result is written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for number, (_, stage) in enumerate(STAGES):
        path = shared_path(spark, f"stage-{number}")
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        release(out)
        if last:
            remove_path(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs

"""From documents to training tokens: each stage is written as Parquet and read again as the next one's documents."""

import public_tokenizers
from pyspark.sql import functions as F

from issueloom.llm import bpe, decontam, neardup, pii, quality
from issueloom.session import materialize

RANKS = "byte_bpe_multi_50k.tiktoken"


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def good_quality(spark, docs, sf_dir):
    """Documents that the quality classifier, trained on the labels of those here, does not reject."""
    return quality.good_documents(docs, _table(spark, sf_dir, "labels"))


def one_of_each_group(spark, docs, sf_dir):
    """The document of the smallest doc_id of each group of near copies."""
    return neardup.first_of_each(docs)


def no_benchmark_items(spark, docs, sf_dir):
    """Documents that contain no benchmark item."""
    return decontam.without_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def no_personal_data(spark, docs, sf_dir):
    """All documents, personal data replaced by its kind, n_chars brought up to date."""
    return pii.redact(docs, length="n_chars")


def tokens(spark, docs, sf_dir):
    """All documents with the ids of their tokens and how many there are; columns of these names are replaced."""
    coded = bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return coded.withColumn("n_tokens", F.size("token_ids").cast("bigint"))


STAGES = [("quality", good_quality), ("near_duplicates", one_of_each_group), ("decontamination", no_benchmark_items),
          ("personal_data", no_personal_data), ("tokens", tokens)]

#: Training, deobfuscation and BPE are beyond SQL: tests hold run() against a brute-force version instead.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage, applied to `documents`."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

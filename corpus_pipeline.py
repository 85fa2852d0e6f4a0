"""A corpus pipeline of five stages over `documents`.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. Between stages the result
is written as Parquet and read again. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm._shared import table
from corpusloom.llm.decontaminate import decontaminate
from corpusloom.llm.mixing import mixed_documents
from corpusloom.llm.quality import keep_good
from corpusloom.llm.records import encode_and_read_back
from corpusloom.llm.simhash import keep_representatives


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score below 0.7) go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.7)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (SimHash, or 0.8 of the five-word shingles) the document with the smallest doc_id stays."""
    return keep_representatives(docs, words=3, seed=42, radius=2, near=True)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), threshold=0.6, overlap=0.8)
    return found.filter(F.size(found.columns[-1]) == 0).drop(found.columns[-1])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a row per copy."""
    return mixed_documents(docs, max_copies=3, weights=(1, 2, 3))


def records_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token records, written and read back: doc_id, start, n_tokens, ids_crc32."""
    return encode_and_read_back(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


STAGES = [("quality classifier", quality_stage), ("SimHash near-dedup", near_dedup_stage), ("benchmark decontamination", decontamination_stage), ("mixing sources to target weights", mixing_stage), ("token-ID binary output", records_stage)]

#: The classifier, SimHash and the tokenizer can't be expressed in SQL; tests/llm hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = table(docs, f"pipeline-{k}")
    return docs

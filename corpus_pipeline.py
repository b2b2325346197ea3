"""A training-data pipeline over ``documents``: language, toxicity, near duplicates, benchmark leaks, packing.

Each stage takes the documents that its predecessor kept; all but the last return the columns of documents.
"""

import os

from pyspark.sql import functions as F

from asofloom.llm import decontam, langid, packing, simhash, token_counts, toxicity
from asofloom.sources.scratch import written

TOKENIZERS = os.environ.get("ASOFLOOM_TOKENIZERS", "/opt/tokenizers")


def language(spark, docs, sf_dir):
    """Drops what has no language: null, empty or wordless texts, unknown scripts, ties between languages."""
    verdict = langid.identifier(spark, langid.fit_on(docs))(F.col("text"))
    return docs.where(verdict["lang"] != langid.UNDETERMINED)


def toxic(spark, docs, sf_dir):
    """Drops what the classifier, fitted on the labelled documents of the stage's input, marks as toxic."""
    model = toxicity.fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(~toxicity.marker(spark, model)(F.col("text"), F.col("lang"))["toxic"])


def near_duplicates(spark, docs, sf_dir):
    """Keeps the document of the smallest id of each group."""
    return simhash.deduplicate(docs)


def benchmark_leaks(spark, docs, sf_dir):
    """Drops what holds a run of words of a benchmark item."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark, docs, sf_dir):
    """Assigns every piece of a document to a window: (doc_id, start, length, pack_id, slot)."""
    return packing.pack(docs, length=token_counts.token_counter(f"{TOKENIZERS}/byte_bpe_50k.tiktoken")(F.col("text")))


STAGES = [
    ("language_id", language),
    ("toxicity", toxic),
    ("near_dedup", near_duplicates),
    ("decontamination", benchmark_leaks),
    ("packing", packed),
]

#: The classifiers, signatures and least squares of the stages can't be expressed in SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Applies the stages to the documents of ``sf_dir``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs

"""The queries and DuckDB SQL of the corpus operators, with production parameters."""

import os

from pyspark.sql import functions as F

from . import decontam, html_extract, langid, packing, quality, sharding, simhash, token_counts, topk, toxicity

TOKENIZERS = os.environ.get("ASOFLOOM_TOKENIZERS", "/opt/tokenizers")
RANKS = "byte_bpe_50k.tiktoken"


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark, sf_dir):
    return token_counts.token_counts(read(spark, sf_dir, "documents"), f"{TOKENIZERS}/{RANKS}")


def op2_sharding(spark, sf_dir):
    return sharding.shards(read(spark, sf_dir, "documents"))


def op3_language_id(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit_on(docs))


def op4_packing(spark, sf_dir):
    tokens = token_counts.token_counter(f"{TOKENIZERS}/{RANKS}")(F.col("text"))
    return packing.pack(read(spark, sf_dir, "documents"), length=tokens)


def op5_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.fit_on(docs, read(spark, sf_dir, "labels")))


def op6_top_k(spark, sf_dir):
    return topk.top_k(read(spark, sf_dir, "embeddings"))


def op7_decontamination(spark, sf_dir):
    return decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_quality(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return quality.quality(docs, quality.fit_on(docs, read(spark, sf_dir, "labels")))


def op9_simhash(spark, sf_dir):
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op10_html_extraction(spark, sf_dir):
    return html_extract.extract(read(spark, sf_dir, "pages"))


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("op")}
SQL = {"op2_sharding": sharding.shards_sql(), "op6_top_k": topk.top_k_sql(), "op7_decontamination": decontam.contamination_sql()}

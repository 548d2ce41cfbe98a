"""A training corpus from the documents table, in five stages.

Each stage takes what its predecessor kept and calls one operator of the
training-data subpackage.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm import mixing, packing, simhash, substring_dedup, toxicity
from logweave.llm.cluster import checkpoint
from logweave.llm.queries import MIX, source_domain, table, tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
REJECT_AT = 0.3
SIMILARITY = 0.8
SHINGLE = 5
RUN_WORDS = 20
MIX_SHARE = 0.9
SEQUENCE_TOKENS = 1024

#: No stage but the mixture's arithmetic has a SQL form.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the toxicity network rejects; it learns from the input's labelled rows that are not held out."""
    net = toxicity.fit_on(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, net, "__toxic").where(F.col("__toxic") < REJECT_AT).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates."""
    return simhash.keep_one(docs, SHINGLE, SIMILARITY).select(*COLUMNS)


def drop_repeated_runs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove word runs that started earlier in the corpus; documents of which nothing is left go."""
    done = substring_dedup.dedup_substrings(docs, RUN_WORDS)
    cut = F.col("n_removed") > 0
    text = F.when(cut, F.col("kept")).otherwise(F.col("text"))
    left = done.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    return left.withColumn("text", text).withColumn("n_chars", F.when(cut, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Choose documents so that domains, languages and sources get the tokens of their weights, each at most once."""
    mixed = mixing.mix(docs, MIX, source_domain(), share=MIX_SHARE, max_epochs=1)
    cut = F.col("take_tokens") < F.col("n_tokens")
    text = F.when(cut, mixing.first_tokens(F.col("text"), F.col("take_tokens"))).otherwise(F.col("text"))
    return mixed.withColumn("text", text).withColumn("n_chars", F.when(cut, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' tokens into training sequences."""
    return packing.pack(docs, tokenizer_path(), SEQUENCE_TOKENS)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_runs),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; each stage's rows are written out before the next one reads them."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = checkpoint(docs)
    return docs

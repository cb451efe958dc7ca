"""A corpus pipeline over `documents`: each stage's result is written as Parquet and is the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import line_dups, mixing, ngram_join, queries, spm_codec, toxicity
from tidewater.llm.common import settle, without_keys

# No stage but the last could be said in SQL alone: the classifiers are trained here.  Every stage is tested
# against brute force in tests/llm/test_pipeline_stages.py.
ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go.  Learns from the labels that op2 learns from.

    Rows with a null id, a repeated id or an empty text are scored like all others; a null text counts as empty; very long
    texts are scored whole.  A score of just 0.7 rejects.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.reject(docs, toxicity.fit(docs, labels, toxicity.crc_rest("doc_id", 3) != 1), 0.7)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines that are equal or close, the first one of the corpus stays; documents left without a line go.

    Rows with a null id or text stay as they are; n_chars, where there is such a column, follows the text.
    """
    cut = line_dups.dedup_lines(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more over five-word shingles stays: the smallest id.

    Rows without an id, and texts without a word, stay as they are; rows of one id stay or go together.  Texts are compared
    whole, however long.
    """
    return ngram_join.keep_first(docs, width=5, num=80, den=100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Thins the low and toxic domains to their target weights; documents that are likeliest clean all stay.

    A document stays if a hash of its id, as a number in [0, 1), is below its rate; rates end at 1, since no document is
    doubled, so a domain with less than its target stays whole.  Rows without an id stay; repeated ids share one fate.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", mixing.domain_of().alias("domain"))
    rates = mixing.mix(docs, labels, queries.MIX_WEIGHTS, reference="clean", high=1.0, keep="clean")
    draw = F.pmod(F.xxhash64(F.lit("mix"), F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    gone = settle(rates.where(draw >= F.col("rate")).where("doc_id IS NOT NULL").select(F.col("doc_id").alias("gone")).distinct())
    return without_keys(docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id")), "id", gone).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text that is left, with their digests; null texts count as empty, repeated and null ids come back row for row."""
    return spm_codec.digests(spm_codec.encode_decode(docs, queries.model_path()))


STAGES = [("toxicity", reject_toxic), ("line_dedup", dedup_lines), ("ngram_join", dedup_documents), ("mixing", mix_sources), ("sentencepiece", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs)
    return docs

"""A training-corpus pipeline of five stages, each one operator of `tidewright.llm`.

A stage takes the documents that its predecessor kept and returns those that it keeps, with the columns of documents; the
last returns pieces of packed sequences. Stage outputs are Parquet between stages, so a lost executor costs the stage it
was busy with. Scratch tables of a stage are deleted when the next stage begins, since its output is written by then.

quality_classifier   drops documents that score under 0.3; trained on labelled rows outside the held-out fold
exact_dedup          keeps one document of each group of texts that are equal but for white space
simhash_near_dedup   SimHash links of five-word shingles and MinHash bands name pairs; those of a Jaccard similarity of 0.8 or more link;
                     the smallest doc_id of each component stays
substring_dedup      50-word windows that also start in a document of smaller doc_id go; documents stay
packing              sequences of 2,048 tokens; doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset

The third stage takes its first pairs from the SimHash operator's links (fingerprints within four bits) and checks them by whole shingle
sets. 64 bits can't tell pairs of 0.8 from pairs of 0.6 (see the README), so bands of minima name what lies further apart.

Every stage: null text counts as empty; rows of null id take part and go last among ties; of rows repeated with equal id and text
one stays from exact_dedup on; texts of any length are read whole; extra columns stay, whatever their names (`packing` returns
its own); an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import common, exact_dedup, jaccard, packing, quality, substring_dedup
from tidewright.llm.wordcodes import Vocabulary
from tidewright.session import table

_before: list[str] = []


def _stage(run: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """Frees the scratch tables of the stage before, and notes those of this one."""

    @functools.wraps(run)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.release(spark, _before)
        with common.recording(_before):
            return run(spark, docs, sf_dir)

    return stage


@_stage
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")), threshold=0.3)


@_stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_one(docs)


@_stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs, shingle=5, threshold=0.8)


@_stage
def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    stripped = substring_dedup.strip_repeated(docs, window=50)
    return stripped.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else stripped


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    words = Vocabulary("words", public_tokenizers.path("word_bpe_49k.json"), added=True)
    return packing.pack_documents(docs, words, end_id=1, capacity=2048).placed()


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("substring_dedup", substrings),
    ("packing", packed),
]

#: SQL can express neither the classifier nor the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = f"{common.shared_dir(spark)}/tidewright-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    common.release(spark, _before)
    common.release(spark, [f"{base}/{name}/part" for name, _ in STAGES[:-1]])  # what the last stage came from
    return docs

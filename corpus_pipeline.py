"""A corpus from documents to packed training sequences.

Stages run in order; what each returns is written as Parquet to the shared folder and read again as the next one's documents. Once
a stage is written, what it read is deleted.

Edge cases, the same for every stage: columns of any name pass through to the packing, which names its own; empty tables give empty results.

* Quality classifier: a null or empty text is scored like any other, a repeated row as often as it is there; without labels nothing
  is known and all scores are 0.5, below the threshold.
* Line dedup: null texts, empty texts and texts without words stay as they are; a null source is a site of its own.
* N-gram Jaccard join: texts without words link with nothing and stay; of repeated rows one stays; a null id is the first of its group.
* Mixing: texts without words add nothing to what is taken and come as often as their block; a null source is the last source; rows that
  repeat are taken by themselves.
* Packing: every row is packed, repeated rows too; a very long text is cut into pieces.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import compression_classifier, line_dedup, mixing, ngram_join, packing
from veilframe.llm.common import WORD, ensure_checkpoint_dir, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go."""
    return compression_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that spread over sites go from all texts but the first; a document that loses its last word goes too."""
    cleaned = line_dedup.dedup_lines(docs, removed="#removed")
    return cleaned.where((F.col("#removed") == 0) | F.col("text").rlike(WORD)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates, by shingles of five words and a similarity of 0.8, the first document stays."""
    return ngram_join.keep_first(docs, ngram_join.JoinSettings(words=5, percent=80))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come to their target weights: a document is there as often as the mix takes it, in its shards, which are shuffled."""
    return mixing.mix_in_order(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences by best-fit decreasing."""
    return packing.pack(docs)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("mixing sources to target weights", mix), ("best-fit packing", pack)]

#: The classifier and the tokenizer can't be expressed in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                remove(spark, f"{folder}/{k - 1}")
    return docs


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

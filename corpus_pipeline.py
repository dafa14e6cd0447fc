"""A training corpus in five stages, each over all that the stage before kept.

Every stage gets ``documents`` rows and, but for the last, returns such rows;
``run`` writes each stage's result as Parquet into the shared folder and reads
it back for the next one, so a lost executor costs a task and not the stages
before. What a stage wrote is removed once the next one is written; the last
result stays. Other columns than those of ``documents`` are left out.

* toxicity: learns from all rows of ``labels`` that have a text here; documents
  that score 0.5 or more go.
* line_dedup: lines of 10 characters or more that several documents hold stay
  only in the one with the smallest id; ``n_chars`` follows the text. A document
  of which nothing but blanks is left goes: all it said stands in others.
* ngram_join: one document of each group of near duplicates stays.
* decontaminate: documents that hold a passage of ``benchmark`` go.
* mix: what the mix takes of each document that is left.

As lines go before near duplicates are looked for, exact copies are gone or cut to
their own lines by then; the join meets what differs in a few words of each line.

Defined results
* null or empty texts: they stay (score of the empty texts, no lines to drop, no
  copies of each other, no passage) with size 0 and nothing taken;
* rows without an id: they keep their lines, and go as copies of a row with one;
* repeated rows: they score alike and lose the same lines, then one of them stays;
* ties: the smallest id, then the smallest hash of the text, stays;
* empty tables: no labels, nothing is toxic; no benchmark, nothing leaks; no
  documents, an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemill.llm import decontaminate, line_dedup, mixing, ngram_join, toxicity
from tastemill.llm.common import shared_folder, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = documents(docs)
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def stage_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = line_dedup.drop_repeated_lines(documents(docs)).withColumn("n_chars", F.length("text").cast("long"))
    return documents(cut.where((F.col("n_dropped") == 0) | (F.btrim("text", F.lit(line_dedup.SPACE)) != "")))


def stage_ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(documents(docs))


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(documents(docs), table(spark, sf_dir, "benchmark"))


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(docs))


STAGES = [
    ("toxicity", stage_toxicity),
    ("line_dedup", stage_line_dedup),
    ("ngram_join", stage_ngram_join),
    ("decontaminate", stage_decontaminate),
    ("mix", stage_mix),
]

#: Nearest neighbours and fingerprints are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before is not None:
            remove(spark, f"{folder}/{before}")
        before = name
    return docs

"""A training-data pipeline of five operators, over the columns of ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the next one reads it back from
Parquet. All but the last keep the columns of ``docs``.

* ``language_id`` trains on its documents and drops those without a letter and those in which no
  language reaches half of the words. The language column is left as it is.
* ``toxicity`` trains on its documents and ``labels`` and drops those scored 0.5 or more.
* ``near_duplicates`` keeps one document of each component of 5-word shingle sets with Jaccard
  similarity 0.8 or more: the row with the smallest id (of rows that repeat it, one). Documents
  without words link with nothing; a null id takes no part; both stay.
* ``mixture`` takes documents to the target weights of their sources: a document that the mixture
  takes twice becomes two rows, one that it does not take goes.
* ``packed`` cuts the documents into power-of-two pieces and gives them sequences. Rows that the
  mixture repeated are documents of their own.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provlake.llm import language, mixing, ngram_join, packing, toxicity
from provlake.llm.common import fresh, table
from provlake.session import scratch_path

#: A document stays if its language has this share of its words or more.
LEAST_SHARE = 0.5
WIDTH, PERCENT = 5, 80
#: Rows of an Arrow batch of whole texts, at most.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 500


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = fresh("_language", docs.columns)
    found = language.score(docs, language.train(docs), as_name=name)
    return found.filter((F.col(f"{name}.lang") != language.UNKNOWN)
                        & (F.col(f"{name}.score") >= LEAST_SHARE)).select(*docs.columns)


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = fresh("_toxicity", docs.columns)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, as_name=name).filter(
        F.col(f"{name}.score") < toxicity.THRESHOLD).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.representatives(docs, WIDTH, PERCENT)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, mixing.plan(docs)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


def lean(stage):
    """A stage whose tasks move few whole texts to Python at once, whatever the session says.

    Default batches hold up to 64 MB of text, several of them at a time in an executor, and what
    stages leave behind adds up where they share executors.
    """
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        rows = int(spark.conf.get(BATCH))
        if not 0 < rows <= BATCH_ROWS:
            spark.conf.set(BATCH, str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)
    return run


STAGES = [(name, lean(stage)) for name, stage in (
    ("language_id", language_id), ("toxicity", toxic_out), ("near_duplicates", near_duplicates),
    ("mixture", mixture), ("packed", packed))]
#: Learned stages have no SQL; the tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what a stage returns is written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

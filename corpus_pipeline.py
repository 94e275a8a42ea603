"""The corpus pipeline: five stages, each over all that the one before it kept, and their run over the documents.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. In all
stages an empty table gives an empty one, a null text is an empty one, a long text is read whole, a row with a null id
is judged by its own text where that decides and kept where an id is needed, and columns beside those of documents
pass through whatever their names. What repeated rows and ties do is said at each stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from notewright.llm import decontamination, mixing, pii, simhash, toxicity
from notewright.llm.common import ensure_checkpoint_dir, forget


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject: each row by its own text, equal ones alike; an empty text is
    scored as one window without words. Without usable labels all rows get one score, below the threshold unless most
    labels are toxic."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the one with the smallest doc_id, of several texts with that id the one of
    least hash, of equal rows any one. Empty texts are one component; rows without an id are all kept."""
    return simhash.keep_one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Rows that share an id go if any of them holds one; an empty benchmark takes
    nothing away; rows without an id are kept."""
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, spans of personal data replaced by their kind, equal rows alike; a null text stays null and an empty
    one empty."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their block, slot and position in the mix, laid out in that order. A null source is one of its
    own; equal rows take neighbouring places of their source in any order; columns named like the added ones are
    replaced."""
    return mixing.in_mixed_order(mixing.mix_sources(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("pii", redact_personal_data),
    ("mixing sources", mix_sources),
]

#: SQL cannot express the network's scores or the components; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents; what each returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        path = f"{base}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if i:
            forget(spark, f"{base}/{i - 1}")
    return docs

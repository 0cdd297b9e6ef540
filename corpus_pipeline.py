"""A training corpus in five stages: toxicity, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of ``documents``;
the last one adds ``domain``, ``n_tokens`` and ``copies``.  Between stages the documents are
written as Parquet and read again, so a stage's decisions are what the next one sees, and a lost
executor costs at most the stage it was in.  ``run`` deletes a stage's tables once the next stage's
documents are written.

Defined cases: rows without a doc_id are judged by their text, lose no lines and stay unless toxic,
contaminated or without a token; null, empty and blank texts pass every stage but the last, which never
selects a document without a token; rows that repeat a doc_id with the same text are decided alike, and
near-dedup keeps or drops all rows of an id; very long texts are judged whole; an empty table gives an
empty result; extra columns are kept as they are (in the last stage ``domain``, ``n_tokens`` and
``copies`` are replaced).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hydroframe.llm import decontaminate, linededup, mixing, neardup, toxicity
from hydroframe.llm.store import Store, sweep

TOXIC_FROM = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the toxicity grammar scores TOXIC_FROM or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out())
    grammar = toxicity.learn(docs, labels)
    return toxicity.score(docs, grammar, "__hf_score").where(F.col("__hf_score") < TOXIC_FROM).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes later copies and near copies of lines, and documents that lose all their words."""
    return linededup.dedup_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each near-duplicate class."""
    return neardup.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Selects documents by the domain-language-source budget."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: The grammar, the line join and the signatures have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, store, made = spark.read.parquet(f"{sf_dir}/documents.parquet"), Store(spark), []
    since = sweep(spark, 1 << 62, store)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = store.write(docs)
            store.drop(*made)
            since, made = sweep(spark, since, store), [docs]
    return docs

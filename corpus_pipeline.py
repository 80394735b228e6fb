"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on every row of ``docs``, and returns a DataFrame; all but the last return
the columns of ``documents``.  Between stages the rows are written as Parquet and read again, so that no stage computes
the ones before it anew and a lost executor costs a reread.  A stage's result must be written before the next one begins:
it discards the tables that the one before stored on its way.
"""
from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from precinct.llm import decontaminate, knn, packing, pii, simhash
from precinct.llm.queries import table, tokenizer_path
from precinct.session import discard, scope, store

LEAST_QUALITY = 0.5
_LEFT: list[str] = []  # tables that the stage before has stored for itself


def tidy(stage):
    """A stage that first discards what the one before stored on its way: by now its result is written.

    The first stage discards nothing, as the result of another run may not be read yet.
    """
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if stage.__name__ != STAGES[0][0]:
            discard(spark, *_LEFT)
        _LEFT.clear()
        with scope() as made:
            out = stage(spark, docs, sf_dir)
        _LEFT.extend(made)
        return out
    return run_stage


@tidy
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose nearest labelled neighbours vote for good quality (operator 10)."""
    labels = knn.training_labels(table(spark, sf_dir, "labels"), 3, 1)
    return knn.accepted(docs, knn.fit(docs, labels, "quality"), LEAST_QUALITY)


@tidy
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more (operator 1)."""
    return simhash.one_of_each(docs, shingle=5, similarity=0.8)


@tidy
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark (operator 9)."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


@tidy
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked (operator 3)."""
    return pii.mask(docs, pii.fit(docs))


@tidy
def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces packed into sequences of at most 1024 tokens (operator 2)."""
    return packing.pack(docs, tokenizer_path(), capacity=1024, end_id=2)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("personal_data", personal_data), ("packing", sequences)]

# No stage can be written in SQL as a whole: fitted models, hashing and tokenizers; tests/llm compares with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            made = store(made)
            if name != STAGES[0][0]:
                discard(spark, docs)
        docs = made
    return docs

"""The corpus pipeline: from documents to packed training sequences.

Each stage applies one operator to all rows that the stage before it kept, is
written as Parquet and read again. The first four return documents, in their
columns; the last the token pieces with their places in sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarnflow.llm import common, decontaminate, jaccard_join, packing, pii, quality

#: SQL can express neither the classifiers nor the tokenizer: the tests compare
#: each stage with a brute-force version.
ORACLE_SQL = None

#: Documents that are worth a file, and a task, of their own.
TASK_DOCS = 5_000
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _few_files(out: DataFrame, docs: DataFrame) -> DataFrame:
    """A stage's result, in no more files than its documents are worth: the next
    stage has a task for each."""
    return common.compact(out, docs.count() * common.FILE_ROWS // TASK_DOCS)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects. Every row is
    judged, repeated or not; null and empty texts have the features of no words;
    without labels of both classes all rows stay. Long texts count whole, extra
    columns stay as they are, an empty table stays empty."""
    return _few_files(quality.select(docs, common.read_table(spark, sf_dir, "labels")), docs)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates, the one with the least doc_id,
    nulls last. Rows without words (null, empty texts) have no class and stay.
    Long texts count whole, extra columns stay, an empty table stays empty."""
    return _few_files(jaccard_join.deduplicate(docs), docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold benchmark text, each row by itself. Null
    and empty texts, and all with an empty benchmark, stay. Long texts count
    whole, extra columns stay, an empty table stays empty."""
    return _few_files(decontaminate.decontaminate(docs, common.read_table(spark, sf_dir, "benchmark")), docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts replaced by the names of its kinds. All rows
    stay, repeated or not, null texts null; long texts are searched whole, extra
    columns stay but for n_chars, the new length; an empty table stays empty."""
    return _few_files(pii.redact(docs), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 2048. Null and empty texts
    are the end id alone, repeated rows are packed each, long texts are cut into
    pieces; other columns are not read; an empty table packs into no rows."""
    return _few_files(packing.pack(docs), docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", classify_quality),
    ("ngram_jaccard_join", join_near_duplicates),
    ("benchmark_decontamination", remove_benchmark),
    ("pii", redact_pii),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder
    and read again. What a stage stored for itself, and the table it read, are
    deleted once its own result is written."""
    docs, read = common.read_table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        before = common.scratch_tables()
        docs = common.materialise(stage(spark, docs, sf_dir), name)
        *own, result = [p for p in common.scratch_tables() if p not in before]
        common.release(spark, own + read)
        read = [result]
    return STAGES[-1][1](spark, docs, sf_dir)

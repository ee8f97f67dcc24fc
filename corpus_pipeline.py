"""The corpus pipeline: quality, near-duplicates, repeated passages, benchmark leaks, mixing.

Each stage takes the documents that its predecessor kept, written and read again, and all but the last return the
columns of documents.

Defined results: an empty table goes through as such; a null or empty text is scored as one empty line, is near nothing, holds no passage and no
benchmark words, and is placed like any other; equal rows of one doc_id are copies of each other, and different texts of one doc_id documents of
their own; further columns of documents stay as they are, whatever their names, but for block, slot, place and position, which the last
stage sets. A text is never cut: the longest one must fit an executor's memory some 100 times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.llm import op1_decontamination as op1
from foliograph.llm import op2_minhash_dedup as op2
from foliograph.llm import op3_mixing as op3
from foliograph.llm import op4_quality_crf as op4
from foliograph.llm import op7_substring_dedup as op7
from foliograph.llm.shared import dropped, free, sized, table, tables_made, with_given_ids, with_own_ids, written

#: A document of less than this score of quality goes.
GOOD = 0.3


#: Near copies are alike by at least this many per cent of their shingles of five words.
ALIKE = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = op4.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
    score = free(docs.columns, "score")
    return op4.quality(docs, model, score).where(F.col(score) >= GOOD).select(*named(docs))


def named(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs but for the rows whose doc_id is gone."""
    return docs.join(sized(written(gone.select("doc_id"), "gone"), 32), "doc_id", "left_anti").select(*named(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group stays."""
    own, ids = with_own_ids(docs)
    out = without(own, op2.near_duplicates(own.select("doc_id", "text"), ALIKE).where("not kept"))
    if ids is not None:  # of equal rows one stays, and those without doc_id
        out = out.where("doc_id is not null").dropDuplicates(["doc_id"]).union(out.where("doc_id is null"))
    return with_given_ids(out, ids)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of passages that occurred before; a document of which nothing stays goes.

    A text of which nothing is removed stays as it is; of another, the kept words are joined by spaces.
    """
    n_words, n_removed, kept = into = tuple(free(docs.columns, c) for c in ("n_words", "n_removed", "kept"))
    out = op7.dedup(docs, into=into)
    changed = F.col(n_removed) > 0
    out = out.where(~changed | (F.col(n_removed) < F.col(n_words)))
    out = out.withColumn("text", F.when(changed, F.col(kept)).otherwise(F.col("text")))
    return out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*named(docs))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words in a row of a benchmark item go."""
    own, ids = with_own_ids(docs)
    found = op1.contamination(own.select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return with_given_ids(without(own, found.where("contaminated").distinct()), ids)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its place in the mixture."""
    return op3.mixed(docs)


STAGES = [
    ("quality classifier", quality),
    ("near-duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("decontamination", decontaminated),
    ("mixing", mixing),
]

#: The quality classifier is trained, and mixing is a schedule: SQL expresses neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with tables_made() as made:
            docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        dropped(spark, [*before, *made[:-1]])  # what the stage has written on its way, and what it has read
        before = made[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)

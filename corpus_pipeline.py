"""The corpus pipeline: quality rules, line dedup, near-duplicates, mixing, BPE. Each stage works on what the last kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. run()
writes each result as Parquet in the shared folder and rereads it for the next stage.

Every stage takes nulls in any column, texts of any length (read whole), repeated rows and further columns of any
name, which it hands on unchanged; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import bpe, line_dedup, mixing, near_dup, quality_rules
from palimpsest.llm.common import table
from palimpsest.llm.queries import vocabulary_path
from palimpsest.sources import files

#: The mix fills its targets from up to two epochs; the budget is as many words as come in.
MIX = mixing.Mix(percent=100, max_epochs=2)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive quality rules keep.

    A null or empty text fails the base rules and goes; null languages and sources are groups of their own; repeated
    rows are judged alike; a value equal to a bound stays.
    """
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without multi-line chunks and passages that an earlier place has.

    A null text stays null; of equal places the least doc_id, null first, then the least line counts as first; repeated
    rows are one place and lose the same lines.
    """
    return line_dedup.drop_repeats(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: five-word shingles, similarity 0.8 or more.

    The least doc_id stays, and of its repeated rows the one with the least text; rows without a doc_id, and texts that
    are null or without words, are groups of their own.
    """
    return near_dup.keep_one(docs, width=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the numbers of epochs that the target weights call for, a row for each epoch.

    Null languages and sources are leaves of their own; texts that are null or without words cost nothing; ties of the
    seeded order go by doc_id, then words; repeated rows count one by one.
    """
    return mixing.remix(docs, MIX)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids: the byte-level BPE of each text, a row for each row.

    A null or empty text has no ids.
    """
    return bpe.encode(docs, vocabulary_path(), keep=("doc_id", "lang", "source"))


STAGES = [("quality rules", rules), ("line dedup", lines), ("near-duplicates", near), ("mixing", mix), ("tokens", tokens)]

#: The adaptive rules, near-duplicate links and BPE have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents. When a stage's result, or a failure, is there, all tables before it go."""
    docs, since, kept = table(spark, sf_dir, "documents"), files.mark(), ()
    for k, (_, stage) in enumerate(STAGES[:-1]):
        try:
            out, path = stage(spark, docs, sf_dir), files.scratch(spark, f"stage{k}")
            out.write.parquet(path)
            docs, kept = spark.read.schema(out.schema).parquet(path), (path,)
        except BaseException:
            kept = ()
            raise
        finally:
            files.release(spark, since, but=kept)
    return STAGES[-1][1](spark, docs, sf_dir)

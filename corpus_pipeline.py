"""The corpus pipeline: toxicity, near duplicates, repeated passages, benchmark leaks, packing.

Every stage takes (spark, docs, sf_dir), works on all rows the stage before kept, and all but the last return the columns of
``documents``.  Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import _common as c
from gridloom.llm.decontaminate import decontaminate
from gridloom.llm.jaccard_join import keep_one
from gridloom.llm.packing import pack_documents, public_byte_bpe
from gridloom.llm.substring_dedup import substring_dedup
from gridloom.llm.toxicity import REJECT, labelled, score, train


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model does not reject; a document without text stays."""
    model = train(docs, labelled(c.table(spark, sf_dir, "labels")))
    kept = score(docs.withColumn("__gl_row", F.struct(*docs.columns)), model).filter(F.col("p_toxic") < REJECT)
    return kept.select("__gl_row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word Jaccard links of 0.8 or more: that of the least id."""
    return keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the runs of 13 words that a document of a smaller id has; documents left without a word go.

    A text that loses nothing stays as it is; else its kept words are joined by one space, and n_chars follows.
    """
    out = substring_dedup(docs, keep_columns=True, spans=False).filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept_text"))
    chars = F.when(F.col("n_removed") == 0, F.col("rest.n_chars")).otherwise(F.length("kept_text").cast("long"))
    made = {"doc_id": F.col("doc_id"), "text": text, "n_chars": chars}
    return out.select(*[made.get(x, F.col("rest")[x]).alias(x) for x in docs.columns])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate(docs, c.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    return pack_documents(docs.select("doc_id", "text"), *public_byte_bpe())


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard_join", drop_near_duplicates), ("substring_dedup", cut_repeats), ("benchmark_decontamination", drop_leaks), ("best_fit_packing", pack)]
#: SQL has neither the ordinal model nor the tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage.  What a stage has read and left in the shared folder is deleted when its rows are written."""
    docs, before = c.table(spark, sf_dir, "documents"), c.folders()
    for _, stage in STAGES[:-1]:
        docs = c.materialize(stage(spark, docs, sf_dir))
        c.discard(spark, keep=1, least=before)
    return STAGES[-1][1](spark, docs, sf_dir)

"""A corpus pipeline over ``documents``: language, repeated lines, near copies, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir), where docs is what its predecessor kept, as written and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terradelta.llm import decontaminate, langid, line_dedup, minhash, packing
from terradelta.llm.common import long_rows, saved, table
from terradelta.llm.tokens import tokenizer_path

#: A document whose best language has less of the codes' probability goes.
LEAST_SCORE = 0.5


def rows_and_text(docs: DataFrame) -> DataFrame:
    """A row's other columns as one value beside its text: an operator that takes it for the id hands the row through."""
    return docs.select(F.struct(*(F.col(f"`{c}`").alias(c) for c in docs.columns if c != "text")).alias("row"), "text")


def whole_rows(judged: DataFrame, columns: list[str]) -> DataFrame:
    return judged.select(*(F.col("text") if c == "text" else F.col("doc_id").getField(c).alias(c) for c in columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones have; texts without letters or of no clear language go."""
    long_rows(spark)
    judged = langid.predict(rows_and_text(docs), langid.train(docs), id_col="row", with_text=True)
    return whole_rows(judged.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)), docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that nearly equal an earlier line."""
    long_rows(spark)
    return line_dedup.without_lines(docs, line_dedup.near_lines(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more. Rows without id stay."""
    long_rows(spark)
    return minhash.one_of_each(docs, 5, 80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no ten words in a row with a benchmark item."""
    hits = decontaminate.find_hits(rows_and_text(docs), table(spark, sf_dir, "benchmark"), id_col="row", with_text=True)
    return whole_rows(hits.filter("n_hit = 0"), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' pieces in sequences of 2048 tokens."""
    long_rows(spark)
    return packing.op7_packing(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("lines", lines),
    ("near copies", near_copies),
    ("decontamination", decontaminated),
    ("packing", packed),
]

#: SQL has neither the language model nor the tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, f"stage-{k}")
    return docs

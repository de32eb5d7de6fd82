"""A training-data pipeline over ``documents``: each stage reads what its predecessor wrote.

Toxic documents go; of fuzzy copies of a line the first stays; of near-duplicate
documents one stays; passages of 13 words that an earlier document holds go; the
rest is packed into sequences. Documents that a stage empties go with it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.llm import catalog, line_dedup, ngram_join, packing, substring_dedup, toxicity
from kerbline.session import Written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5.

    A null text scores as an empty one, however long a text is it counts whole,
    and equal texts have one score. Rows without id stay or go by their text;
    repeated rows do so together. Without labelled documents all stay; with
    labels of one kind every score is their share. Further columns stay, whatever
    their names.
    """
    labels = catalog.table(spark, sf_dir, "labels").where(catalog.remainder(5) != 0)
    model = toxicity.train(docs, labels.select("doc_id", F.col("toxic").alias("label")))
    score = _free("score", docs)
    return toxicity.score(docs, model, score).where(F.col(score) < 0.5).select(docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of which a fuzzy copy stands earlier.

    Rows without id and null or empty texts stay as they are, short lines too;
    repeated rows keep the same lines, and of equally placed copies the first in
    (doc_id, line) order counts. Texts of any length are read whole; without
    documents there are none. Further columns stay, whatever their names.
    """
    name = _free("lines", docs)
    return _with_text(line_dedup.without_fuzzy_lines(docs, result=name), name, docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate component; documents without id or words stay.

    Rows that repeat id and text are one; rows that share an id but not the text
    stay together. Texts of any length are compared whole; without documents there
    are none. Further columns stay, whatever their names.
    """
    found = ngram_join.near_duplicates(docs)
    first = found.where("doc_id = component_id").select("doc_id").distinct()
    version = _free("version", docs)
    named = docs.join(first, "doc_id", "left_semi").withColumn(version, F.xxhash64("text"))
    return named.dropDuplicates(["doc_id", version]).select(docs.columns).unionByName(docs.where("doc_id IS NULL"))


def dedup_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that an earlier document holds.

    Rows without id and null or empty texts stay as they are; rows that share an
    id take nothing from each other, so repeated rows keep the same words. Texts
    of any length are read whole; without documents there are none. Further
    columns stay, whatever their names.
    """
    name = _free("repeats", docs)
    return _with_text(substring_dedup.without_repeats(docs, result=name), name, docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of the documents and their places in sequences.

    A null or empty text is the end id alone, and so are rows without id; repeated
    rows are packed as often as they come, long texts in several pieces. Without
    documents there are no pieces; further columns go.
    """
    return packing.pack(packing.token_pieces(docs, catalog.tokenizer_path("word_bpe_49k.json")))


def _free(name: str, docs: DataFrame) -> str:
    """A column name that ``docs`` does not have."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    return name


def _with_text(done: DataFrame, result: str, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` with the text a stage has kept; an untouched text stays byte for byte."""
    changed, kept = F.col(f"{result}.n_removed") > 0, F.col(f"{result}.kept")
    rows = done.where(~(changed & (kept == "")))
    rows = rows.withColumn("text", F.when(F.col(f"{result}.n_removed") > 0, kept).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col(f"{result}.n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(docs.columns)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", dedup_documents),
    ("substring dedup", dedup_passages),
    ("best-fit packing", pack_sequences),
]
ORACLE_SQL: str | None = None  # no stage but the third and fourth can be said in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; every stage's rows are written and read again."""
    written = Written(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written.keep(stage(spark, docs, sf_dir))
    return docs

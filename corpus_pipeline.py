"""A training-data pipeline over the given documents, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns a DataFrame that is
written as Parquet and read again for the next stage. All but the last return the columns of documents. Rows are raw
transaction lines to the operators: doc_id is the line number and text the line.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.bpe import encode_transaction_lines
from tidemark.llm.hyper_minhash import link_lines
from tidemark.llm.quality_forest import judge_lines
from tidemark.llm.queries import mixed_documents
from tidemark.llm.settings import prepare_text
from tidemark.llm.suffix_array import remove_repeated_bytes
from tidemark.session import checkpoint_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

# Near duplicates share four fifths of their shingles of five words.
SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80
REPEATED_BYTES = 50
# The mix reads each document at most once, and 95 % of the tokens: nodes that hold more than their weight give way.
MIX_WEIGHTS = [("lang", "en", 5), ("lang", "de", 2), ("lang", "fr", 2), ("source", "src0", 2)]
MIX_PERCENT, MIX_EPOCHS = 95, 1


def lines_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("line_number"), F.col("text").alias("line"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the rules or the isolation forest reject."""
    prepare_text(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(
        F.col("doc_id").alias("line_number"), F.col("quality").alias("good")
    )
    # Each row gets its own verdict beside its columns, so that no join has to move the texts.
    lines = docs.select(F.col("doc_id").alias("line_number"), F.col("text").alias("line"), "doc_id", "lang", "source", "n_chars")
    judged = judge_lines(lines, labels, carry=("doc_id", "line", "lang", "source", "n_chars"))
    return judged.where("kept").withColumnRenamed("line", "text").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id of each group of near duplicates."""
    prepare_text(spark)
    linked = link_lines(lines_of(docs), shingle_words=SHINGLE_WORDS, similarity_percent=SIMILARITY_PERCENT)
    dropped = linked.where(~F.col("kept")).select(F.col("line_number").alias("doc_id")).distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut byte strings that an earlier document holds; characters that a cut leaves in part go too."""
    prepare_text(spark)
    # The other columns travel beside the lines, in the same blocks, so that no join has to move the texts.
    other = docs.select("doc_id", "lang", "source", F.col("text").isNull().alias("missing"))
    beside = F.to_json(F.struct("doc_id", "lang", "source", F.col("text").isNull().alias("missing")))
    lines = docs.select(F.col("doc_id").alias("line_number"), F.col("text").alias("line"), beside.alias("beside"))
    kept = remove_repeated_bytes(lines, window=REPEATED_BYTES, carry="beside")
    cut = whole_characters(F.when(F.col("n_removed") > 0, F.col("kept")))
    text = F.when(F.col("other.missing"), F.lit(None)).otherwise(F.coalesce(cut, F.col("kept").cast("string")))
    rows = kept.withColumn("other", F.from_json("beside", other.schema)).select("other.*", text.alias("text"))
    return rows.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


@F.pandas_udf(T.StringType())
def whole_characters(data: pd.Series) -> pd.Series:
    """UTF-8 bytes as text without the parts of characters that were cut."""
    return data.map(lambda x: bytes(x).decode("utf-8", "ignore"), na_action="ignore")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mix domains, languages and sources to their weights."""
    prepare_text(spark)
    return mixed_documents(spark, docs, MIX_WEIGHTS, MIX_PERCENT, MIX_EPOCHS).select(*COLUMNS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text."""
    prepare_text(spark)
    encoded = encode_transaction_lines(lines_of(docs), public_tokenizers.path("byte_bpe_50k.json"))
    return encoded.select(
        F.col("line_number").alias("doc_id"),
        F.size("token_ids").cast("long").alias("n_tokens"),
        "token_ids",
        F.col("decoded").alias("text"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("byte_bpe", byte_bpe),
]

# The forest, the near-duplicate groups and the token ids can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written to the checkpoint folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for place, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{place}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

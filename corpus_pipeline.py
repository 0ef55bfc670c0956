"""The corpus pipeline: toxicity, quality, exact copies, near copies, packing.

Each stage works on all documents its predecessor kept, and the next one reads what it wrote. Every stage but the last
returns the columns of ``documents``; the last returns the pieces of sequences with their token ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherfolio.llm import bag_minhash, cotraining, exact_dedup, packing, toxicity
from cipherfolio.llm.queries import vocabulary
from cipherfolio.operators.durable import checkpoint_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def labels_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is one half or more go. The model learns from the whole table's labelled rows."""
    model = toxicity.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels_of(spark, sf_dir))
    return toxicity.score_documents(docs, model, keep=("text", "lang", "source", "n_chars")).filter("score < 0.5").select(*COLUMNS)


def with_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that both views together call poor go."""
    views = cotraining.train(docs, labels_of(spark, sf_dir))
    return cotraining.score_documents(docs, views, keep=("text", "n_chars", "lang", "source")).filter("score >= 0.5").select(*COLUMNS)


def keyed(docs: DataFrame) -> DataFrame:
    """The documents with ``row_key``, 17 bytes in the order of the id (nulls last) and a hash of the whole row.

    Only rows that are equal in all columns share a key, and of those at most one can stay.
    """
    high = F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).bitwiseXOR(F.lit(-(1 << 63)))
    flag = F.when(F.col("doc_id").isNull(), "01").otherwise("00")
    # Null columns do not change a hash, so their places are hashed too.
    whole = F.xxhash64(*COLUMNS, *(F.col(c).isNull() for c in COLUMNS))
    digits = [F.lpad(F.hex(x), 16, "0") for x in (high, whole)]
    return docs.select(*COLUMNS, F.unhex(F.concat(flag, *digits)).alias("row_key"))


def kept_rows(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows whose key stays, one of each key."""
    stay = decisions.filter("kept").select("row_key")
    return rows.dropDuplicates(["row_key"]).join(stay, "row_key", "left_semi").select(*COLUMNS)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row of the smallest id stays, also where ids repeat or are null."""
    rows = keyed(docs)
    return kept_rows(rows, exact_dedup.exact_dedup(rows, id_col="row_key"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the row of the smallest id stays, also where ids repeat or are null."""
    rows = keyed(docs)
    return kept_rows(rows, bag_minhash.near_duplicates(rows, id_col="row_key"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of binary lengths; a piece is a sequence. Its number is its place in its document and its document's id."""
    pieces = packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))
    return pieces.withColumn("bucket", F.round(F.log2("length")).cast("int"))


STAGES = [
    ("toxicity", without_toxic),
    ("quality", with_quality),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("packing", packed),
]
#: SQL cannot express the classifiers, the signatures or the tokenizer; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again."""
    folder = f"{checkpoint_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs

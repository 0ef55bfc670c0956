"""Cutting lineage so that a lost executor never changes an answer."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names; a scratch one, removed at exit, only in local mode where none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="cipherfolio-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one; it belongs to one run."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def durable(rows: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``rows``: replicated storage, lineage cut."""
    spark = rows.sparkSession
    folder = checkpoint_folder(spark)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return rows.checkpoint(eager=True)


def stored(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` as files of columns under the shared folder, lineage cut: a reader takes the columns it needs, not whole rows."""
    folder = scratch(rows.sparkSession, name)
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)

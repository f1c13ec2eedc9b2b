"""Helpers shared by the corpus operators."""

import importlib
import sys
import tempfile
from pathlib import Path
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
ROOT = str(Path(__file__).resolve().parents[2])


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Only a local session without one (tests) gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='stoplens-shared-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: later steps survive lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_tasks(module: str, function: str, *args):
    """A function for mapInArrow and its like that imports ``module`` on the executor, so that what the module
    caches (vocabularies, words seen) lives as long as the Python worker."""
    root = ROOT

    def run(batches):
        if root not in sys.path:
            sys.path.append(root)
        return getattr(importlib.import_module(module), function)(batches, *args)

    return run


def bind(value: Column, use) -> Column:
    """Evaluate ``value`` once per row and hand it to ``use`` as a bound variable."""
    return F.element_at(F.transform(F.array(value), use), 1)


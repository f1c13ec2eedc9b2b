"""Session settings the operators assume, and the folder used to cut long lineages."""

import os
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_session(app: str = "stoplens", cores: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if cores:
        builder = builder.master(f"local[{cores}]").config("spark.driver.memory", "12g")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without one (tests, laptops) takes a fresh temporary folder, and names it for later calls.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="stoplens-shared-", dir=os.environ.get("TMPDIR"))
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Spark 4.1 and later can drop a query's shuffle files when it has ended; else they stay until the driver collects its garbage.
SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back: later uses prune its columns, compute nothing
    again and survive lost executors. The shuffle files that the write needed go with its end."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid4().hex}"
    untyped = {c for c, kind in df.dtypes if kind == "void"}  # Parquet has no such columns
    if untyped:
        return staged(df.drop(*untyped), name, compression).select(*[F.lit(None).alias(c) if c in untyped else F.col(c) for c in df.columns])
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLES_END, "false")
    conf.set(SHUFFLES_END, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        conf.set(SHUFFLES_END, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only where no folder is configured (tests, laptops) a fresh temporary folder is used.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def shuffle_partitions(df: DataFrame) -> int:
    """The session's shuffle width, for steps whose work per byte is too high for coalesced partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

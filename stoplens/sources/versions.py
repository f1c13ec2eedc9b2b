"""Tables of one folder whose rows become visible together, when the commit that wrote them is entered.

``<folder>/<table>/version=<v>`` holds the rows of a write, ``<folder>/commits/version=<v>`` one row in one file, put in
place by one rename after all tables are written. Readers take rows of entered commits alone, so that a job that dies
before its commit leaves the old state, and one that is repeated under the same version writes over what it left. A
write may replace keys: it lists them in a table of their own, the latest commit that lists a key owns it, and a key listed
without new rows has none. Nothing is changed in place.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stoplens.operators.skew import lookup_join

COMMITS = "version string, seq bigint"


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at ``path``, or None where nothing was written yet."""
    try:
        return spark.read.option("mergeSchema", True).parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def commits(spark: SparkSession, folder: str) -> DataFrame:
    """(version, seq) of the entered commits."""
    found = stored(spark, f"{folder}/commits")
    return spark.createDataFrame([], COMMITS) if found is None else found.select(F.col("version").cast("string").alias("version"), "seq")


def _partition(version: str) -> str:
    if not version or not version.replace("-", "").replace("_", "").isalnum() or version.isdigit():
        raise ValueError("a version is a word of letters, digits, - and _, not a number")
    return f"version={version}"


def stage(rows: DataFrame, folder: str, table: str, version: str) -> None:
    """Write the rows of one table under a version; nobody sees them yet."""
    rows.drop("version").write.mode("overwrite").parquet(f"{folder}/{table}/{_partition(version)}")


def enter(spark: SparkSession, folder: str, version: str) -> None:
    """Make all that was staged under ``version`` visible; entering it again changes nothing."""
    done = commits(spark, folder)
    if done.where(F.col("version") == version).limit(1).count():
        return
    seq = done.agg(F.coalesce(F.max("seq"), F.lit(0)) + 1).first()[0]
    spark.createDataFrame([(seq,)], "seq bigint").coalesce(1).write.mode("overwrite").parquet(f"{folder}/commits/{_partition(version)}")


def entered(spark: SparkSession, folder: str, version: str) -> bool:
    return commits(spark, folder).where(F.col("version") == version).limit(1).count() > 0


def live(spark: SparkSession, folder: str, table: str, key: list[str] | None = None, before: str | None = None) -> DataFrame | None:
    """The visible rows of a table, with their ``version``; with ``key``, those of the commit that owns their key.

    ``before``: leave out that version, whose files an earlier attempt may have left and the caller is about to write
    over. None where the table was never written.
    """
    rows = stored(spark, f"{folder}/{table}")
    if rows is None:
        return None
    done = commits(spark, folder)
    if before is not None:
        done, rows = done.where(F.col("version") != before), rows.where(F.col("version") != before)
    if key is None:
        return lookup_join(rows, done.select("version"), ["version"], "inner")
    keys = lookup_join(stored(spark, f"{folder}/{table}_keys"), done, ["version"], "inner")
    owners = keys.groupBy(*key).agg(F.max_by("version", F.struct("seq", "version")).alias("version"))
    return lookup_join(rows, owners, [*key, "version"], "inner")


def replace(rows: DataFrame, keys: DataFrame, folder: str, table: str, key: list[str], version: str) -> None:
    """From now on ``rows`` are all there is of the ``keys``; keys without rows disappear, other keys stay."""
    stage(rows.join(keys.select(*key).distinct(), key, "left_semi"), folder, table, version)
    stage(keys.select(*key).distinct(), folder, f"{table}_keys", version)
    enter(rows.sparkSession, folder, version)


def add_first(rows: DataFrame, folder: str, table: str, key: list[str], version: str, order: list[str] | None = None) -> None:
    """Append the rows whose key the table does not hold yet; of rows with one key in ``rows`` the first by ``order``
    (by default by all their columns). What is stored never changes; repeating a version adds nothing."""
    spark = rows.sparkSession
    if entered(spark, folder, version):
        return
    rest = [c for c in rows.columns if c not in key]
    first = F.min_by(F.struct(*rest), F.struct(*(order or rest)))
    fresh = rows.groupBy(*key).agg(first.alias("_row")).select(*key, "_row.*").select(*rows.columns)
    held = live(spark, folder, table, before=version)
    stage(fresh if held is None else fresh.join(held.select(*key), key, "left_anti"), folder, table, version)
    enter(spark, folder, version)

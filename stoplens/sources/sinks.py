"""Writes: guarded append, upsert, keyed update, per-analysis replacement, output datasets."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stoplens import fixed_values as fv
from stoplens.operators.log_tables import latest
from stoplens.operators.skew import lookup_join
from stoplens.sources import versions


def not_loaded(batches: DataFrame, loaded: DataFrame, hashes: list[str]) -> DataFrame:
    """Batches none of whose hashes was loaded before (a null hash matches nothing)."""
    for name in hashes:
        batches = batches.join(loaded.select(name).distinct(), name, "left_anti")
    return batches


def append_batches(batches: DataFrame, stops: DataFrame, folder: str, version: str, force: bool = False) -> None:
    """Append batches (id, file_hash, content_hash, ..) and their stops (upload_batch_id, ..) unless file or content
    was loaded; ``force`` appends anyway. Of new batches that share a content hash the one with the least id is taken.

    Stops and batches become visible with one commit: an attempt that dies in between leaves the old state, and is
    repeated whole under its ``version``.
    """
    spark = batches.sparkSession
    if versions.entered(spark, folder, version):
        return
    loaded = versions.live(spark, folder, "batches", before=version)
    fresh = batches
    if not force:
        first = batches.groupBy("content_hash").agg(F.min("id").alias("id")).select("id", F.lit(True).alias("_first"))
        fresh = batches.join(first, "id", "left").where(F.col("_first") | F.col("content_hash").isNull()).drop("_first")
        if loaded is not None:
            fresh = not_loaded(fresh, loaded, ["file_hash", "content_hash"]).select(*batches.columns)
    versions.stage(fresh, folder, "batches", version)
    ids = fresh.select(F.col("id").alias("upload_batch_id"))
    versions.stage(lookup_join(stops, ids, ["upload_batch_id"], "inner"), folder, "stops", version)
    versions.enter(spark, folder, version)


def insert_analyses(analyses: DataFrame, folder: str, version: str) -> None:
    """Insert analyses whose content hash is not there yet."""
    versions.add_first(analyses, folder, "analyses", ["content_hash"], version)


def replace_summaries(summaries: DataFrame, analyses: DataFrame, folder: str, version: str) -> None:
    """The summary rows of ``analyses`` (analysis_id) replace what was stored for them; an analysis whose new summary
    is empty disappears. Read them with :func:`summaries`."""
    versions.replace(summaries, analyses, folder, "summaries", ["analysis_id"], version)


def summaries(spark: SparkSession, folder: str) -> DataFrame | None:
    return versions.live(spark, folder, "summaries", ["analysis_id"])


def upserted(current: DataFrame, changes: DataFrame, key: list[str], order: str) -> DataFrame:
    """Last write per key wins."""
    return latest(current.unionByName(changes), key, order)


def updated_items(items: DataFrame, updates: DataFrame, fields: list[str]) -> DataFrame:
    """A10: keyed update; an update to null clears the field."""
    mark = updates.select("analysis_id", "key", *[F.col(f).alias(f"_new_{f}") for f in fields], F.lit(True).alias("_hit"))
    joined = items.join(mark, ["analysis_id", "key"], "left")
    return joined.withColumns({f: F.when(F.col("_hit"), F.col(f"_new_{f}")).otherwise(F.col(f)) for f in fields})\
        .drop("_hit", *[f"_new_{f}" for f in fields])


def replace_by_analysis(rows: DataFrame, path: str) -> None:
    """Rows of the analyses present replace what was stored for them in a plain partitioned table; others stay. Where a new
    summary may be empty, use :func:`replace_summaries`."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("analysis_id").parquet(path)


def write_dataset(rows: DataFrame, path: str, form: str = "parquet") -> None:
    """Land an output dataset as parquet, CSV or JSON."""
    writer = rows.write.mode("overwrite")
    writer.option("header", True).csv(path) if form == "csv" else writer.format(form).save(path)


def classified_output(stops: DataFrame, card_members: DataFrame, cards: DataFrame) -> DataFrame:
    """Every original row with its class and tone; stops in no card keep a null class."""
    tone = F.when(F.col("class").isin(fv.UNCLASSIFIED), "baixa").when(F.col("validated"), "validada")\
        .otherwise(F.coalesce(F.nullif("confidence", F.lit("")), F.lit("media")))
    slim = cards.select("analysis_id", "card_id", "class", F.when(F.col("class").isNotNull(), tone).alias("tone"))
    placed = lookup_join(card_members, slim, ["analysis_id", "card_id"])
    return stops.join(placed.select("analysis_id", F.col("record_id").alias("id"), F.col("class").alias("Classificação"),
                                    "tone"), ["analysis_id", "id"], "left")


def predicted_output(stops: DataFrame, predictions: DataFrame, label: str = "label", rejected: DataFrame | None = None) -> DataFrame:
    """Prediction columns on every row.

    Rows already labelled keep their label ('Preenchida antes'), notes without content are marked, rejected rows
    carry their reason.
    """
    slim = predictions.select("ml_key", F.col("classe").alias("_class"), F.col("detalhe").alias("_detail"),
                              F.col("confianca").alias("_confidence"), F.col("faixa").alias("_band"))
    joined = lookup_join(stops, slim, ["ml_key"])
    filled = F.coalesce(F.col(label), F.lit("")) != ""
    silent = F.col("ml_key") == ""
    open_ = ~filled & ~silent
    out = joined.withColumns({
        label: F.when(open_, F.col("_class")).otherwise(F.col(label)),
        "detail": F.when(open_, F.col("_detail")), "confidence": F.when(open_, F.col("_confidence")),
        "band": F.when(filled, "Preenchida antes").when(silent, "Sem relato para classificar").otherwise(F.col("_band")),
    }).drop("_class", "_detail", "_confidence", "_band")
    if rejected is not None:
        ignored = rejected.withColumn("band", F.concat(F.lit("Linha ignorada: "), F.col("reject_reason")))
        out = out.unionByName(ignored.drop("reject_reason"), allowMissingColumns=True)
    return out

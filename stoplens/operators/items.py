"""Single flow: one item per unique note, its review, and the failure summary of an analysis."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stoplens import fixed_values as fv
from stoplens.functions import calc, text
from stoplens.operators.skew import lookup_join, places_within
from stoplens.session import staged

PENDING, CORRECT, WRONG = "pendente", "correta", "corrigida"


def with_item_key(stops: DataFrame) -> DataFrame:
    """Model text of the note, '' when it says nothing."""
    return stops.withColumn("ml_key", text.model_text("observacao_raw"))\
        .withColumn("ml_key", F.when(text.has_content("ml_key"), F.col("ml_key")).otherwise(F.lit("")))


def with_item_key_of_notes(stops: DataFrame) -> DataFrame:
    """``with_item_key`` of staged stops: the key of each distinct note, long numbers aside, is worked out once."""
    stops = staged(stops.withColumn("_note", text.without_long_numbers("observacao_raw")), "item-notes")
    notes = with_item_key(stops.select(F.col("_note").alias("observacao_raw")).distinct()).withColumnRenamed("observacao_raw", "_note")
    return lookup_join(stops, staged(notes, "item-keys"), ["_note"]).drop("_note")


def items(stops: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row per (analysis, unique note) with its lines, minutes, first text and prediction.

    Notes an analyst already reviewed arrive validated.
    """
    grouped = stops.filter("ml_key <> ''").groupBy("analysis_id", "ml_key").agg(
        F.count(F.lit(1)).alias("n_linhas"), F.sum("minutos_parada").cast("decimal(30,2)").alias("minutos"),
        F.min_by("observacao_raw", "id").alias("relato"))
    known = F.col("faixa") == fv.ANALYST
    return lookup_join(grouped, predictions, ["ml_key"], "inner").withColumns({
        "id": calc.item_key("analysis_id", "ml_key"),
        "status": F.when(known, CORRECT).otherwise(PENDING),
        "classe_final": F.when(known, F.col("classe")), "detalhe_final": F.when(known, F.col("detalhe"))})


def search_items(rows: DataFrame, band: str = "", status: str = "", words: str = "") -> DataFrame:
    """Band, status, and a case-folded substring of note, class or final class."""
    if band:
        rows = rows.filter(F.col("faixa") == band)
    if status:
        rows = rows.filter(F.col("status") == status)
    if words:
        rows = rows.filter(text.contains_folded("relato", words) | text.contains_folded("classe", words)
                           | text.contains_folded("classe_final", words))
    return rows


def review_order() -> list[Column]:
    """Pending, least certain band, lowest confidence, most lines, key."""
    band = F.when(F.col("faixa") == "Baixa", 0).when(F.col("faixa") == "Média", 1).when(F.col("faixa") == "Alta", 2).otherwise(3)
    return [F.when(F.col("status") == PENDING, 0).otherwise(1), band, F.coalesce("confianca", F.lit(100.0)),
            F.desc("n_linhas"), F.col("ml_key"), F.col("analysis_id")]


def progress(rows: DataFrame) -> DataFrame:
    """Review progress per analysis."""
    open_ = F.col("status") == PENDING
    out = rows.groupBy("analysis_id").agg(
        F.count(F.lit(1)).alias("relatos"), F.sum("n_linhas").alias("linhas"), F.count_if(~open_).alias("validados"),
        F.coalesce(F.sum(F.when(~open_, F.col("n_linhas"))), F.lit(0)).alias("linhas_validadas"),
        F.count_if(F.col("status") == WRONG).alias("corrigidos"),
        F.count_if(open_ & (F.col("faixa") == "Alta")).alias("alta_pendente"))
    return out.withColumn("percent_linhas", calc.percent_1("linhas_validadas", "linhas"))


def high_sample(rows: DataFrame, n: int = 8) -> DataFrame:
    """Every k-th pending high-confidence item by lines, per analysis, n at most."""
    high = rows.filter((F.col("status") == PENDING) & (F.col("faixa") == "Alta"))
    placed = places_within(high, ["analysis_id"], [F.desc("n_linhas"), F.col("ml_key")])
    step = F.greatest(F.lit(1), F.floor(F.col("_size") / n))
    return placed.filter((F.col("_place") % step == 0) & (F.col("_place") / step < n)).drop("_place", "_size")


def even_sample(rows: DataFrame, order: list[Column], n: int, partition: list[str]) -> DataFrame:
    """N rows spread evenly over an ordering, per partition key; all rows when there are no more than n."""
    slots = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * F.col("_size") / n))
    return places_within(rows, partition, order).filter(
        (F.col("_size") <= n) | F.array_contains(slots, F.col("_place"))).drop("_place", "_size")


def reviewed_items(rows: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items after review, new training examples).

    decisions(analysis_id, ml_key, resultado, classe, detalhe): 'correta' keeps the prediction, 'errada' needs a
    class, 'pendente' clears the review. A decision about an unknown item is ignored.
    """
    label = text.class_label("_classe")
    detail = F.substring(F.trim(F.regexp_replace(F.coalesce("_detalhe", F.lit("")), r"\s+", " ")), 1, 300)
    said = decisions.select("analysis_id", "ml_key", F.col("resultado"), F.col("classe").alias("_classe"),
                            F.col("detalhe").alias("_detalhe"))
    joined = rows.join(said, ["analysis_id", "ml_key"], "left")
    result = F.col("resultado")
    unclear = (result == "errada") & (label == "")
    after = joined.withColumns({
        "status": F.when(F.coalesce(unclear, F.lit(False)), F.raise_error("a note marked wrong needs its class"))
        .when(result == "correta", CORRECT).when(result == "errada", WRONG).when(result == "pendente", PENDING)
        .otherwise(F.col("status")),
        "classe_final": F.when(result == "correta", F.col("classe")).when(result == "errada", label)
        .when(result.isNull(), F.col("classe_final")),
        "detalhe_final": F.when(result == "correta", F.coalesce("detalhe", F.lit(""))).when(result == "errada", detail)
        .when(result.isNull(), F.col("detalhe_final"))})
    examples = after.filter(result.isin("correta", "errada")).select(
        "relato", F.col("ml_key").alias("relato_norm"), F.col("classe_final").alias("classe"),
        F.col("detalhe_final").alias("detalhe"))
    return after.drop("resultado", "_classe", "_detalhe"), examples


def accept_high(rows: DataFrame) -> DataFrame:
    """Decisions that accept every pending high-confidence item."""
    return rows.filter((F.col("status") == PENDING) & (F.col("faixa") == "Alta")).select(
        "analysis_id", "ml_key", F.lit("correta").alias("resultado"), F.lit(None).cast("string").alias("classe"),
        F.lit(None).cast("string").alias("detalhe"))


def with_item_class(stops: DataFrame, rows: DataFrame) -> DataFrame:
    """The class that counts for every stop: reviewed, else predicted, else no description."""
    slim = rows.select("analysis_id", "ml_key", F.coalesce(F.nullif("classe_final", F.lit("")), "classe").alias("_class"),
                       (F.col("status") != PENDING).alias("_checked"))
    joined = lookup_join(stops, slim, ["analysis_id", "ml_key"])
    return joined.withColumns({
        "failure_class": F.coalesce("_class", F.lit(fv.NO_NOTE)), "checked": F.coalesce("_checked", F.lit(False)),
        "group_id": F.when(F.col("ml_key") != "", F.col("ml_key")).otherwise(F.concat(F.lit("__"), F.col("id").cast("string"))),
    }).withColumn("failure_mode", F.col("failure_class")).drop("_class", "_checked")


def failure_summary(stops: DataFrame) -> DataFrame:
    """F8: per analysis and class, lines, real failures, minutes, MTTR, shares and validated lines."""
    table = stops.groupBy("analysis_id", F.col("failure_class").alias("classe")).agg(
        F.count(F.lit(1)).alias("linhas"), F.countDistinct("event_id").alias("falhas_reais"),
        F.sum("minutos_parada").cast("decimal(30,2)").alias("_t"), F.count_if("checked").alias("linhas_validadas"))
    whole = Window.partitionBy("analysis_id")
    upto = whole.orderBy(F.desc("_t"), "classe").rowsBetween(Window.unboundedPreceding, 0)
    total = F.when(F.sum("_t").over(whole) == 0, F.lit(1)).otherwise(F.sum("_t").over(whole))
    return table.withColumns({
        "mttr": calc.ratio("_t", "falhas_reais"), "percentual": calc.percent_2(F.col("_t"), total),
        "acumulado": F.least(F.lit(100.0), calc.percent_2(F.sum("_t").over(upto), total)),
        "minutos": calc.as_double("_t")}).drop("_t")


def top_occurrences(summary: DataFrame, n: int = 15) -> DataFrame:
    """the chart's classes with most lines, per analysis."""
    rank = F.row_number().over(Window.partitionBy("analysis_id").orderBy(F.desc("linhas"), "classe"))
    return summary.withColumn("rank", rank.cast("bigint")).filter(F.col("rank") <= n)


def expected_accuracy(rows: DataFrame, bands: DataFrame) -> DataFrame:
    """Accuracy expected of every analysis from the measured accuracy of its bands (analyst = 100)."""
    measured = bands.select(F.col("band").alias("faixa"), F.coalesce("accuracy", F.lit(0.0)).alias("_accuracy"))
    scored = rows.join(F.broadcast(measured), "faixa", "left").withColumn(
        "_accuracy", F.when(F.col("faixa") == fv.ANALYST, 100.0).otherwise(F.coalesce("_accuracy", F.lit(0.0))))
    return scored.groupBy("analysis_id").agg(
        F.round(F.sum(F.col("n_linhas") * F.col("_accuracy")) / F.sum("n_linhas"), 1).alias("expected_accuracy"))

"""Board views and consolidated rows: E16-E19, E22, G5, G6, A14."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stoplens import fixed_values as fv
from stoplens.functions import calc
from stoplens.operators.skew import lookup_join


def card_rollup(stops: DataFrame, members: DataFrame) -> DataFrame:
    """Per card count, minutes, distinct events, up to 20 order numbers, kinds, days and the first note.

    Order numbers and days are reduced to distinct values before they are listed, so a hot card lists few values.
    """
    key = ["analysis_id", "card_id"]
    linked = stops.select("analysis_id", "id", "event_id", "order_number", "minutos_parada", "tipo_parada", "data_inicio", "observacao_raw").join(
        members.select("analysis_id", "card_id", F.col("record_id").alias("id")), ["analysis_id", "id"])
    totals = linked.groupBy(*key).agg(
        F.count(F.lit(1)).alias("count"), calc.as_double(F.sum("minutos_parada")).alias("minutes"), F.countDistinct("event_id").alias("events"),
        F.min_by("observacao_raw", "id").alias("sample"))
    values = linked.select(*key, F.explode(F.array(
        F.struct(F.lit("orders").alias("f"), F.col("order_number").alias("v")), F.struct(F.lit("types").alias("f"), F.col("tipo_parada").alias("v")),
        F.struct(F.lit("dates").alias("f"), F.col("data_inicio").cast("string").alias("v")))).alias("p")).select(*key, "p.f", "p.v")
    distinct = values.filter("v <> ''").distinct()
    listed = distinct.groupBy(*key).agg(*[F.array_sort(F.collect_list(F.when(F.col("f") == f, F.col("v")))).alias(f) for f in ("orders", "types", "dates")])
    return totals.join(listed, key, "left").withColumn("orders", F.slice("orders", 1, 20))


def machine_buckets(cards: DataFrame) -> DataFrame:
    """Machines inside a class column: cards, minutes, events, pending and the worst pending confidence.

    ``order_pending`` and minutes give the view's order: pending first, then the longest downtime.
    """
    rank = F.when(F.col("confidence") == "baixa", 2).when(F.col("confidence") == "media", 1).otherwise(0)
    pending = ~F.col("validated")
    return cards.groupBy("analysis_id", "class", "column_id").agg(
        F.count(F.lit(1)).alias("cards"), F.sum("minutes").alias("minutes"), F.sum("events").alias("events"), F.count_if(pending).alias("pending"),
        F.coalesce(F.max_by("confidence", F.when(pending, rank)), F.lit("")).alias("worst")).withColumn("order_pending", F.when(F.col("pending") == 0, 1).otherwise(0))


def class_columns(cards: DataFrame) -> DataFrame:
    """Class columns with the stable order key: unidentified first, then minutes of the automatic class."""
    shown = cards.groupBy("analysis_id", "class").agg(F.sum("minutes").alias("minutes"), F.bool_and("validated").alias("validated"),
                                                      F.countDistinct("column_id").alias("machines"))
    auto = cards.groupBy("analysis_id", F.col("auto_class").alias("class")).agg(F.sum("minutes").alias("auto_minutes"))
    ranked = shown.join(auto, ["analysis_id", "class"], "left").withColumns({
        "auto_minutes": F.coalesce("auto_minutes", F.lit(-1.0)), "unidentified": F.col("class") == fv.NO_MODE})
    return ranked.orderBy("analysis_id", F.desc("unidentified"), F.desc("auto_minutes"), "class")


def automation(cards: DataFrame, stops: DataFrame) -> DataFrame:
    """What was classified automatically, per analysis."""
    is_ = lambda c: F.col("confidence") == c
    cols = [F.count_if(is_(c)).alias(f"cards_{c}") for c in ("alta", "media", "baixa", "manual")]
    cols += [F.coalesce(F.sum(F.when(is_(c), F.col("count"))), F.lit(0)).alias(f"records_{c}") for c in ("alta", "media", "baixa", "manual")]
    board = cards.groupBy("analysis_id").agg(*cols, F.count_if(F.col("confidence").isin("alta", "manual") & ~F.col("validated") & ~F.col("held")).alias("pending_high"))
    log = stops.groupBy("analysis_id").agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("event_id").alias("failures"),
                                           F.count_if(F.col("order_number") != "").alias("with_order"))
    return board.join(log, "analysis_id").withColumns({
        "auto_rate": calc.percent_1(F.col("records_alta") + F.col("records_media"), "lines"), "high_rate": calc.percent_1("records_alta", "lines")})


def safe_batch(cards: DataFrame) -> DataFrame:
    """Cards of high confidence or an analyst's class, neither validated nor held, longest downtime first."""
    return cards.filter(F.col("confidence").isin("alta", "manual") & ~F.col("validated") & ~F.col("held")).orderBy(F.desc("minutes"), "card_id")


def held_cards(cards: DataFrame) -> DataFrame:
    """G6."""
    return cards.filter("held").orderBy(F.coalesce("held_at", F.lit("")), "card_id")


def _joined(distinct: Column) -> Column:
    """First four of the distinct values in order of appearance, ' …' when there are more."""
    shown = F.array_join(F.slice(distinct, 1, 4), " / ")
    return F.when(F.size(distinct) > 4, F.concat(shown, F.lit(" …"))).otherwise(shown)


def consolidated_rows(stops: DataFrame, joined: list[str] | None = None) -> DataFrame:
    """One row per (group, day): summed and largest measures, first-to-last interval, commonest note, shift, orders.

    Text columns show their first four distinct values. Every column is reduced to distinct (group, day, value) rows
    with a count and first appearance before it is listed.
    """
    joined = joined or ["tipo_parada", "material", "ordem", "subchave_parada", "sistema", "turno", "intervalo"]
    key = ["group_id", "data_inicio"]
    sums = [c for c in ("pts_efic_perdidos", "caixas_produzidas", "total_minutos", "minutos_parada") if c in stops.columns]
    times = r"^\s*(\d{1,2}):(\d{2})\s*-\s*(\d{1,2}):(\d{2})\s*$"
    part = [F.regexp_extract("intervalo", times, i) for i in range(1, 5)]
    minutes = lambda h, m: F.when(h != "", h.cast("int") * 60 + m.cast("int"))
    clock = lambda m: F.concat_ws(":", F.lpad(F.floor(m / 60).cast("string"), 2, "0"), F.lpad((m % 60).cast("string"), 2, "0"))
    spoken = F.trim(F.coalesce("intervalo", F.lit(""))) != ""
    base = stops.groupBy(*key).agg(
        F.min_by(F.struct(*fv.MACHINE_FIELDS, "failure_mode"), "id").alias("_f"), *[calc.as_double(F.sum(c)).alias(c) for c in sums],
        calc.as_double(F.max("pts_acumulados")).alias("pts_acumulados"), F.count(F.lit(1)).alias("count"), F.countDistinct("event_id").alias("events"),
        F.min(minutes(part[0], part[1])).alias("_from"), F.max(minutes(part[2], part[3])).alias("_to"), F.bool_and(~spoken | (part[0] != "")).alias("_clean"))
    fields = [*joined, "observacao_raw", "failure_class", "order_number"]
    values = stops.select(*key, "id", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))).alias("v"))
                                                          for f in fields])).alias("p")).select(*key, "id", "p.f", "p.v")
    seen = values.filter("v <> ''").groupBy(*key, "f", "v").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    texts = lambda f, by: F.transform(F.array_sort(F.collect_list(F.when(F.col("f") == f, F.struct(F.col(by).alias("k"), F.col("v").alias("x"))))), lambda e: e["x"])
    top = lambda f: F.max_by("v", F.when(F.col("f") == f, F.struct("n", -F.col("first"))))
    listed = seen.groupBy(*key).agg(
        *[_joined(texts(f, "first")).alias(f) for f in joined if f not in ("intervalo", "turno")], _joined(texts("intervalo", "first")).alias("_intervals"),
        calc.shift_value(_joined(texts("turno", "first"))).alias("turno"), top("observacao_raw").alias("_note"), top("failure_class").alias("failure_class"),
        F.array_join(F.slice(texts("order_number", "v"), 1, 4), ", ").alias("orders"))
    rows = base.join(listed, key, "left")
    interval = F.when(F.col("_clean") & F.col("_from").isNotNull(), F.concat_ws("-", clock(F.col("_from")), clock(F.col("_to")))).otherwise(F.col("_intervals"))
    return rows.select(*key, "_f.*", *sums, "pts_acumulados", "count", "events", interval.alias("intervalo"), F.coalesce("_note", F.col("_f.failure_mode")).alias("observacao_raw"),
                       *[f for f in joined if f not in ("intervalo",)], "failure_class", "orders")


def convert_legacy(cards: DataFrame, members: DataFrame, records: DataFrame, canonical: DataFrame) -> dict[str, DataFrame]:
    """New cards from confirmed records: validated when all members are, named after their only canonical failure.

    Mixed names are not validated; a questioned member holds the card. A column is validated when it has cards and all
    of them are validated and off the bell.
    """
    names = canonical.select(F.col("id").alias("canonical_failure_id"), F.nullif("nome_canonico", F.lit("")).alias("_name"))
    facts = lookup_join(records.select("id", "status", "question_flag", "canonical_failure_id"), names, ["canonical_failure_id"])
    votes = members.select("card_id", F.col("record_id").alias("id")).join(facts, "id").groupBy("card_id").agg(
        F.bool_and(F.col("status") == "confirmed").alias("_all"), F.bool_or("question_flag").alias("held"), F.min("_name").alias("_low"), F.max("_name").alias("_high"))
    mixed = F.col("_low") != F.col("_high")
    out = cards.drop("validated", "held").join(votes, "card_id").withColumns({
        "validated": F.col("_all") & ~F.coalesce(mixed, F.lit(False)), "held": F.coalesce("held", F.lit(False)),
        "name": F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(F.col("name"))}).drop("_all", "_low", "_high")
    columns = out.groupBy("column_id").agg(F.bool_and(F.col("validated") & ~F.col("held")).alias("validated"))
    return {"cards": out, "columns": columns}

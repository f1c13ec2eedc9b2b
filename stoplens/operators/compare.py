"""Analytic filter and period comparison."""

from datetime import date, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stoplens.functions import calc
from stoplens.operators.reliability import in_categories, machine_table
from stoplens.operators.skew import lookup_join

FIELDS = {"unit": "centro", "line": "linha", "failure": "tipo_parada", "machine": "equipamento", "fclass": "failure_class"}


def select_stops(stops: DataFrame, start: str | None = None, end: str | None = None, analyses: list[str] | None = None,
                 **equals: str | None) -> DataFrame:
    """Analyses by id, inclusive date range, equality on unit, line, stop kind, machine and class."""
    if bool(start) != bool(end):
        raise ValueError("give both ends of the period")
    if start:
        date.fromisoformat(start), date.fromisoformat(end)
        if start > end:
            raise ValueError("the period starts after its end")
        stops = stops.filter(F.col("data_inicio").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    if analyses:
        stops = stops.filter(F.col("analysis_id").isin(analyses))
    for name, value in equals.items():
        if value:
            stops = stops.filter(F.col(FIELDS[name]) == value)
    return stops


def previous_period(start: str, end: str) -> tuple[str, str]:
    """The window of equal length just before [start, end]."""
    first, days = date.fromisoformat(start), (date.fromisoformat(end) - date.fromisoformat(start)).days + 1
    return (first - timedelta(days=days)).isoformat(), (first - timedelta(days=1)).isoformat()


def compare_periods(stops: DataFrame, start: str, end: str, a_start: str | None = None, a_end: str | None = None,
                    mode: str = "events", categories: list[str] | None = None, **equals: str | None) -> DataFrame:
    """machines before (A) and after (B) with difference, percent and direction; machines of either period."""
    if not start or not end:
        raise ValueError("choose period B")
    before = previous_period(start, end)
    a_rows = select_stops(stops, a_start or before[0], a_end or before[1], **equals)
    b_rows = select_stops(stops, start, end, **equals)
    table = (lambda rows: in_categories(rows, categories, mode)) if categories else (lambda rows: machine_table(rows, mode))
    slim = lambda rows, name: table(rows).select("key", "unit", "line", "name", F.col("count").alias(name))
    both = slim(a_rows, "before").join(slim(b_rows, "after"), ["key", "unit", "line", "name"], "full_outer")
    both = both.withColumns({"before": F.coalesce("before", F.lit(0)), "after": F.coalesce("after", F.lit(0))})
    delta = F.col("after") - F.col("before")
    direction = F.when(F.col("before") == 0, "new").when(delta < 0, "down").when(delta > 0, "up").otherwise("same")
    magnitude = calc.hundredths(F.abs(delta).cast("decimal(38,0)") * 10000, F.col("before").cast("decimal(38,0)"))
    return both.withColumns({
        "delta": delta, "direction": direction,
        "percentage": F.when(F.col("before") != 0, F.when(delta < 0, -magnitude).otherwise(magnitude)),
    }).orderBy(F.desc(F.abs("delta")), "key")


def direction_counts(changes: DataFrame) -> DataFrame:
    """machines per direction, and all of them."""
    is_ = lambda d: F.count_if(F.col("direction") == d).alias(f"n_{d}")
    return changes.agg(F.count(F.lit(1)).alias("n_all"), is_("up"), is_("down"), is_("new"), is_("same"))


def largest_changes(changes: DataFrame, n: int = 10) -> DataFrame:
    """the chart's ten largest changes other than zero."""
    return changes.filter("delta <> 0").orderBy(F.desc(F.abs("delta")), "key").limit(n)


# ---- E9, G7, C8: summary and folders of analyses -------------------------------------------------------------

def daily_summary(stops: DataFrame, top: int = 9) -> DataFrame:
    """Stops and minutes per analysis and day with its ``top`` largest machine totals, largest first."""
    cells = stops.groupBy("analysis_id", "data_inicio", "equipamento").agg(
        F.count(F.lit(1)).alias("n"), F.sum("minutos_parada").alias("t"))
    rank = F.row_number().over(Window.partitionBy("analysis_id", "data_inicio").orderBy(F.desc("t"), "equipamento"))
    return cells.withColumn("r", rank).groupBy("analysis_id", "data_inicio").agg(
        F.sum("n").alias("count"), calc.as_double(F.sum("t")).alias("minutes"),
        F.array_sort(F.collect_list(F.when(F.col("r") <= top, F.struct("r", calc.as_double("t").alias("t"))))).alias("_s"),
    ).select("analysis_id", "data_inicio", "count", "minutes", F.transform("_s", lambda x: x["t"]).alias("series"))


def daily_folders(daily: DataFrame, analyses: DataFrame, start: str | None = None, end: str | None = None,
                  search: str = "", newest_first: bool = True) -> DataFrame:
    """The days of ready analyses in a range whose file, name or date holds the searched text."""
    ready = analyses.filter("ready").select("analysis_id", "filename", "name")
    rows = lookup_join(daily, ready, ["analysis_id"], "inner")
    if start:
        rows = rows.filter(F.col("data_inicio") >= F.lit(start).cast("date"))
    if end:
        rows = rows.filter(F.col("data_inicio") <= F.lit(end).cast("date"))
    haystack = F.lower(F.concat_ws(" ", "filename", "name", calc.br_date("data_inicio"), F.col("data_inicio").cast("string")))
    rows = rows.filter(F.contains(haystack, F.lit(search.lower())))
    return rows.orderBy(F.desc("data_inicio") if newest_first else F.asc("data_inicio"), "analysis_id")


def board_readiness(cards: DataFrame) -> DataFrame:
    """An analysis is ready when it has cards off the bell and all of them are validated."""
    active = ~F.col("held")
    return cards.groupBy("analysis_id").agg(
        (F.count_if(active) > 0).alias("_any"), F.bool_and(~active | F.col("validated")).alias("_all"),
        F.count(F.lit(1)).alias("groups_count"), F.count_if(F.col("validated") & active).alias("validated_count"),
        F.count_if("held").alias("held_count")).withColumn("ready", F.col("_any") & F.col("_all")).drop("_any", "_all")


def finished_analyses(analyses: DataFrame, readiness: DataFrame) -> DataFrame:
    """finished = marked so; boards from before the mark existed count when fully validated; single flow never."""
    ready = readiness.select("analysis_id", "ready")
    return analyses.join(ready, "analysis_id", "left").withColumn("finished", F.when(F.col("mode") == "ml", F.lit(False)).when(
        F.col("tracks_finish"), F.col("finished_at").isNotNull()).otherwise(F.coalesce("ready", F.lit(False))))

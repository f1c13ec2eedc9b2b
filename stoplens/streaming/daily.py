"""Running daily minutes and stops by machine, equal to the batch summary once a day is complete."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stoplens.functions import calc


def daily_by_machine(stops: DataFrame, time: str = "start_ts", lateness: str = "1 day") -> DataFrame:
    """Day windows per machine over a stream (or a table) of stops; late stops up to ``lateness`` still count."""
    return (stops.withWatermark(time, lateness)
            .groupBy(F.window(time, "1 day"), "centro", "linha", "equipamento")
            .agg(F.count(F.lit(1)).alias("count"), F.sum("minutos_parada").alias("_t"))
            .select(F.to_date("window.start").alias("day"), "centro", "linha", "equipamento", "count",
                    calc.as_double("_t").alias("minutes")))

"""Failure events: hourly log slices collapsed into real failures."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stoplens.functions import calc, text
from stoplens.operators.skew import lookup_join
from stoplens.session import staged


def with_events(stops: DataFrame, note: str = "observacao_normalizada") -> DataFrame:
    """Add ``event_id`` and ``order_number`` to every stop.

    With an order number, one event per (unit, line, machine, number), across files. Without one, stops of the
    same file, machine, day and note join while each starts where the previous one ended (midnight wraps); a stop
    with no interval or an empty note is always its own event. An event is named after its first stop.

    A hot (machine, day, note) never sits in one task: stops are first reduced to one row per distinct interval
    (partial aggregation), the chain is followed over those few rows, and only the stops that join an earlier one
    are looked up again by their unique id.
    """
    start, end = calc.interval_bounds("intervalo")
    group = ["analysis_id", "_unit", "_line", "_machine", "data_inicio", "_note"]
    order = text.order_number("observacao_raw")
    keyed = staged(stops.withColumns({
        "order_number": order, "_start": start, "_end": end,
        "_unit": text.key_text("centro"), "_line": text.key_text("linha"), "_machine": text.key_text("equipamento"),
        "_note": F.coalesce(F.col(note), F.lit("")),
    }), "event-stops")  # read three times below
    loose = keyed.filter((F.col("order_number") == "") & F.col("_start").isNotNull() & (F.col("_note") != "")
                         & ~F.col("_note").startswith("__"))
    follows_itself = F.col("_start") == F.col("_end") % 1440

    slices = loose.groupBy(*group, "_start", "_end").agg(
        F.min("id").alias("_first"), F.max("id").alias("_last"), F.count(F.lit(1)).alias("_rows"))
    ordered = Window.partitionBy(*group).orderBy("_start", "_end")
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    joins_previous = F.coalesce(F.col("_start") == F.lag("_end").over(ordered) % 1440, F.lit(False))
    chained = (slices
               .withColumn("_own", F.when(~joins_previous, F.col("_first")))
               .withColumn("_tail", F.when((F.col("_rows") > 1) & ~follows_itself, F.col("_last")))
               .withColumn("_previous", F.last(F.coalesce("_tail", "_own"), ignorenulls=True).over(earlier))
               .withColumn("_head", F.coalesce("_own", "_previous")))

    # Stops absorbed by an earlier one: the first stop of a joined slice, and all stops of a full-day slice.
    firsts = chained.filter((F.col("_head") != F.col("_first")) & ~follows_itself)\
        .select("analysis_id", F.col("_first").alias("id"), "_head")
    full_days = lookup_join(
        loose.filter(follows_itself).select(*group, "_start", "_end", "id"),
        chained.filter(follows_itself).select(*group, "_start", "_end", "_head"), [*group, "_start", "_end"], "inner",
    ).select("analysis_id", "id", "_head")
    absorbed = firsts.unionByName(full_days)

    by_order = F.concat_ws("|", F.lit("os:"), "_unit", "_line", "_machine", "order_number")
    by_stop = F.concat_ws(":", "analysis_id", F.coalesce("_head", "id").cast("string"))
    return (keyed.join(absorbed, ["analysis_id", "id"], "left")
            .withColumn("event_id", F.when(F.col("order_number") != "", by_order).otherwise(by_stop))
            .drop("_start", "_end", "_unit", "_line", "_machine", "_note", "_head"))

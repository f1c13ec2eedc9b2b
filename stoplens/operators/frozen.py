"""What stays as it was: classes frozen at validation (K9) and suggestions kept from arrival."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stoplens.operators.classify import final_class
from stoplens.operators.skew import lookup_join, ordered_parts
from stoplens.sources import versions

CARD = ["analysis_id", "card_id"]


def last_before(asked: DataFrame, history: DataFrame, key: list[str], at: str, values: list[str], parts: int | None = None) -> DataFrame:
    """As-of join: every row of ``asked`` with the ``values`` of the last ``history`` row of its key at or before ``at``.

    Both tables are put in one order and cut into ranges; inside a range the last value is carried along, and each range
    takes over what the earlier ones end with, one row per key and range. So a key with a third of all rows is spread
    over many tasks. History rows with the same key and ``at``: the one with the greatest values counts. Rows of
    ``asked`` before any history get nulls; so do rows whose key or ``at`` is null.
    """
    carried = [c for c in asked.columns if c not in (*key, at)]
    place = lambda df, of: df.select(*key, at, *of)
    past = place(history, [F.lit(0).alias("_asked"), F.struct(*values).alias("_value"), F.lit(None).cast(asked.select(F.struct(*carried)).schema[0].dataType).alias("_row")]) if carried else \
        place(history, [F.lit(0).alias("_asked"), F.struct(*values).alias("_value")])
    now = place(asked, [F.lit(1).alias("_asked"), F.lit(None).cast(history.select(F.struct(*values)).schema[0].dataType).alias("_value")]
                + ([F.struct(*carried).alias("_row")] if carried else []))
    usable = F.lit(True)
    for c in (*key, at):
        usable = usable & F.col(c).isNotNull()
    order = [*[F.col(c) for c in key], F.col(at), F.col("_asked"), F.col("_value")]
    both = ordered_parts(past.where(usable).unionByName(now), order, parts)
    known = F.col("_value").isNotNull()
    inside = Window.partitionBy("_part", *key).orderBy(at, "_asked", "_value").rowsBetween(Window.unboundedPreceding, 0)
    local = both.withColumn("_last", F.last("_value", True).over(inside)).where("_asked = 1")
    ends = both.where(known).groupBy("_part", *key).agg(F.max_by("_value", F.struct(at, "_value")).alias("_end"))
    present = both.where("_asked = 1").select("_part", *key).distinct()
    earlier = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = present.join(ends, ["_part", *key], "full").withColumn("_before", F.last("_end", True).over(earlier)).drop("_end")
    found = local.join(before, ["_part", *key], "left")
    value = F.when(usable, F.coalesce("_last", "_before"))
    return found.withColumn("_found", value).select(*key, at, *([F.col(f"_row.{c}").alias(c) for c in carried]), *[F.col(f"_found.{v}").alias(v) for v in values])


def freeze_points(clicks: DataFrame) -> DataFrame:
    """(card, seq): when each card that is validated now was validated: its first click since it last was not.

    clicks(analysis_id, card_id, seq, validated); a later click that validates again freezes nothing anew.
    """
    undone = clicks.groupBy(*CARD).agg(F.max(F.when(~F.col("validated"), F.col("seq"))).alias("_undone"))
    since = lookup_join(clicks.where("validated"), undone, CARD, "inner").where(F.col("_undone").isNull() | (F.col("seq") > F.col("_undone")))
    return since.groupBy(*CARD).agg(F.min("seq").alias("seq"))


def frozen_classes(clicks: DataFrame, suggestions: DataFrame) -> DataFrame:
    """K9: (card, frozen_at, frozen): the class that each validated card showed when it was validated.

    suggestions(analysis_id, card_id, seq, label) is the history of automatic classes; later ones do not count.
    """
    return last_before(freeze_points(clicks), suggestions, CARD, "seq", ["label"]).withColumnsRenamed({"seq": "frozen_at", "label": "frozen"})


def final_classes(cards: DataFrame, frozen: DataFrame) -> DataFrame:
    """K9: cards with their ``class``: the analyst's, the frozen one of validated cards, else the automatic one.

    cards(analysis_id, card_id, manual, automatic, validated, ..). The frozen class goes when the analyst sets one.
    """
    joined = lookup_join(cards, frozen.select(*CARD, "frozen"), CARD)
    return joined.withColumn("class", final_class(F.col("manual"), F.col("frozen"), F.col("validated"), F.col("automatic"))).drop("frozen")


def snapshot_suggestions(votes: DataFrame, folder: str, version: str) -> None:
    """Keep what was suggested for each card when it arrived. votes(analysis_id, card_id, label, source).

    Cards that have a snapshot keep it, whatever a later catalog says; writing a version twice changes nothing.
    """
    versions.add_first(votes.select(*CARD, F.col("label").alias("suggested"), F.col("source").alias("suggested_source")), folder, "suggestions", CARD, version)


def with_snapshot(spark: SparkSession, cards: DataFrame, folder: str) -> DataFrame:
    """L18's input: cards(analysis_id, card_id, automatic, source, ..) with ``suggested`` and ``source`` from the snapshot, else
    from what the catalog says now; ``estimated`` marks cards of the latter kind."""
    kept = versions.live(spark, folder, "suggestions")
    if kept is None:
        return cards.withColumns({"suggested": F.col("automatic"), "estimated": F.lit(True)})
    joined = cards.join(kept.select(*CARD, F.coalesce("suggested", F.lit("")).alias("_suggested"), "suggested_source"), CARD, "left")
    return joined.withColumns({"suggested": F.coalesce(F.nullif("_suggested", F.lit("")), "automatic"), "estimated": F.col("_suggested").isNull(),
                               "source": F.when(F.col("_suggested").isNull(), F.col("source")).otherwise(F.col("suggested_source"))}).drop("_suggested", "suggested_source")

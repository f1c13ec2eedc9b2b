"""Registered queries: classes frozen at validation, and suggestions kept from arrival."""

from uuid import uuid4

from pyspark.sql import functions as F

from stoplens.operators import classify as cl
from stoplens.operators import frozen as fr
from stoplens.operators import models as ml
from stoplens.operators import review as rv
from stoplens.plans import fixtures as fx
from stoplens.plans.queries_notes import VOTES, card_of_cluster
from stoplens.plans.registry import query
from stoplens.session import shared_folder, staged

#: Every stop is something that happened to the card of its cluster: most are new suggestions, some are clicks.
HAPPENED = """happened AS (SELECT analysis_id, CAST(cluster_id % 23 AS STRING) AS card_id, id AS seq, CASE WHEN id % 13 = 4 THEN NULL ELSE 'FALHA ' || CAST(id % 11 AS STRING) END AS label,
 CASE WHEN id % 9 = 2 THEN id % 4 <> 1 END AS validated FROM stops)"""
FROZEN = HAPPENED + """, undone AS (SELECT analysis_id, card_id, max(seq) FILTER (NOT validated) AS u FROM happened WHERE validated IS NOT NULL GROUP BY ALL),
 points AS (SELECT h.analysis_id, h.card_id, min(seq) AS seq FROM happened h JOIN undone USING (analysis_id, card_id) WHERE validated AND (u IS NULL OR seq > u) GROUP BY ALL),
 froze AS (SELECT p.analysis_id, p.card_id, p.seq AS frozen_at, s.label AS frozen FROM points p
  ASOF LEFT JOIN (SELECT analysis_id, card_id, seq, label FROM happened WHERE validated IS NULL) s ON s.analysis_id = p.analysis_id AND s.card_id = p.card_id AND p.seq >= s.seq)"""


def happened(spark, folder):
    return fx.stops(spark, folder).selectExpr("analysis_id", "CAST(cluster_id % 23 AS STRING) AS card_id", "id AS seq",
                                              "CASE WHEN id % 13 = 4 THEN NULL ELSE 'FALHA ' || CAST(id % 11 AS STRING) END AS label",
                                              "CASE WHEN id % 9 = 2 THEN id % 4 <> 1 END AS validated")


def frozen(spark, folder):
    events = happened(spark, folder)
    return fr.frozen_classes(events.where("validated IS NOT NULL").select("analysis_id", "card_id", "seq", "validated"),
                             events.where("validated IS NULL").select("analysis_id", "card_id", "seq", "label"))


@query("k09_frozen_classes", "WITH " + fx.CTE["stops"] + ", " + FROZEN + " SELECT * FROM froze")
def k09_frozen_classes(spark, folder):
    return frozen(spark, folder)


@query("k09_last_suggestion_of_clicks", "WITH " + fx.CTE["stops"] + ", " + HAPPENED + """ SELECT c.analysis_id, c.card_id, c.seq, c.validated, s.label FROM (SELECT * FROM happened WHERE validated IS NOT NULL) c
 ASOF LEFT JOIN (SELECT analysis_id, card_id, seq, label FROM happened WHERE validated IS NULL) s ON s.analysis_id = c.analysis_id AND s.card_id = c.card_id AND c.seq >= s.seq""")
def k09_last_suggestion_of_clicks(spark, folder):
    """The as-of join itself, for every click."""
    events = happened(spark, folder)
    return fr.last_before(events.where("validated IS NOT NULL").select("analysis_id", "card_id", "seq", "validated"),
                          events.where("validated IS NULL"), fr.CARD, "seq", ["label"]).select("analysis_id", "card_id", "seq", "validated", "label")


BOARD = """board AS (SELECT analysis_id, card_id, arg_max(label, seq) FILTER (validated IS NULL AND label IS NOT NULL) AS automatic, arg_max(validated, seq) FILTER (validated IS NOT NULL) AS validated,
 CASE WHEN CAST(card_id AS INT) % 5 = 0 THEN 'MANUAL' END AS manual FROM happened GROUP BY ALL)"""


def board(spark, folder):
    cards = happened(spark, folder).groupBy("analysis_id", "card_id").agg(
        F.max_by("label", F.when(F.col("validated").isNull() & F.col("label").isNotNull(), F.col("seq"))).alias("automatic"),
        F.max_by("validated", F.when(F.col("validated").isNotNull(), F.col("seq"))).alias("validated"))
    cards = cards.withColumns({"validated": F.coalesce("validated", F.lit(False)), "manual": F.when(F.col("card_id").cast("int") % 5 == 0, "MANUAL")})
    return fr.final_classes(cards, frozen(spark, folder))


@query("d10_frozen_stops", "WITH " + fx.CTE["stops"] + ", " + FROZEN + ", " + BOARD + """ SELECT s.id, 'Maquina ' || CAST(CAST(b.card_id AS INT) % 3 AS VARCHAR) AS equipamento,
 coalesce(manual, CASE WHEN validated THEN frozen END, automatic) AS failure_class FROM stops s JOIN board b ON b.analysis_id = s.analysis_id AND b.card_id = CAST(s.cluster_id % 23 AS VARCHAR)
 LEFT JOIN froze f ON f.analysis_id = b.analysis_id AND f.card_id = b.card_id WHERE validated AND CAST(b.card_id AS INT) % 7 <> 0""")
def d10_frozen_stops(spark, folder):
    cards = board(spark, folder).withColumns({"held": F.col("card_id").cast("int") % 7 == 0, "column_id": (F.col("card_id").cast("int") % 3).cast("string"),
                                              "name": F.concat(F.lit("card "), "card_id")})
    columns = cards.select("analysis_id", "column_id").distinct().select("analysis_id", "column_id", F.lit("U").alias("unit"), F.lit("L1").alias("line"),
                                                                         F.concat(F.lit("Maquina "), "column_id").alias("name"))
    stops = fx.stops(spark, folder)
    members = stops.select("analysis_id", (F.col("cluster_id") % 23).cast("string").alias("card_id"), F.col("id").alias("record_id"))
    return rv.validated_stops(stops, members, cards, columns).select("id", "equipamento", "failure_class")


@query("l17_snapshot_report", VOTES.replace("SELECT s.cluster_id, c.label, count(*)", "SELECT s.cluster_id, c.label, min(c.source) AS source, count(*)", 1) + """, winner AS (SELECT cluster_id, label, total, source FROM w WHERE r = 1),
 cards AS (SELECT cluster_id, total AS count, CASE WHEN cluster_id % 6 = 5 THEN 'OUTRA' ELSE label END AS class, CASE WHEN cluster_id % 4 = 3 THEN 'NOVA CLASSE' ELSE label END AS suggested,
   cluster_id % 4 = 3 AS estimated FROM winner),
 k AS (SELECT *, NOT (class = 'SEM DESCRIÇÃO' AND suggested = 'SEM DESCRIÇÃO') AS live FROM cards)
 SELECT 'all' AS analysis_id, CAST(sum(count) AS BIGINT) AS records, count(*) AS cards, count_if(live AND class <> suggested) AS corrections,
  CAST((2000 * sum(count) FILTER (live AND class = suggested AND suggested NOT IN ('SEM DESCRIÇÃO', 'SEM MODO DE FALHA IDENTIFICADO')) + sum(count) FILTER (live)) // (2 * sum(count) FILTER (live)) AS DOUBLE) / 10 AS hit_rate,
  bool_or(estimated) AS estimated FROM k""")
def l17_snapshot_report(spark, folder):
    """Three of four cards have a snapshot; a later catalog that names all of them anew changes none of those."""
    stops = fx.stops(spark, folder).withColumn("analysis_id", F.lit("all"))
    votes = staged(cl.card_votes(cl.classify(stops), card_of_cluster(stops)), "votes")
    home = f"{shared_folder(spark)}/snapshot-{uuid4().hex}"
    number = F.col("card_id").cast("bigint")
    fr.snapshot_suggestions(votes.where(number % 4 != 3), home, "arrival")
    later = votes.withColumns({"automatic": F.lit("NOVA CLASSE"), "class": F.when(number % 6 == 5, "OUTRA").otherwise(F.col("label"))})
    fr.snapshot_suggestions(later.where(number % 4 != 3).withColumn("label", F.col("automatic")), home, "later-catalog")
    counts = stops.groupBy("analysis_id", F.col("cluster_id").cast("string").alias("card_id")).agg(F.count(F.lit(1)).alias("count"))
    cards = later.select("analysis_id", "card_id", "class", "automatic", "source").join(counts, ["analysis_id", "card_id"])
    return ml.sheet_report(fr.with_snapshot(spark, cards, home)).select("analysis_id", "records", "cards", "corrections", "hit_rate", "estimated")

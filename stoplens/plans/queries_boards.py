"""Registered queries: board views, consolidated rows, review state."""

from pyspark.sql import functions as F

from stoplens.functions import calc
from stoplens.operators import boards as bd
from stoplens.operators import compare as cp
from stoplens.operators import log_tables as lt
from stoplens.operators import review as rv
from stoplens.plans import fixtures as fx
from stoplens.plans.fixtures import with_tables
from stoplens.plans.queries_reliability import EVENTS, reviewed_events
from stoplens.plans.registry import query
from stoplens.sources import sinks

EV = "WITH " + fx.CTE["reviewed"] + ", " + EVENTS
CARD = """cards AS (SELECT analysis_id, CAST(cluster_id AS VARCHAR) AS card_id, 'm' || CAST(cluster_id % 5 AS VARCHAR) AS column_id, count(*) AS count, CAST(sum(minutos_parada) AS DOUBLE) AS minutes,
 count(DISTINCT event_id) AS events, min(failure_class) AS class, max(failure_class) AS auto_class, CASE cluster_id % 4 WHEN 0 THEN 'alta' WHEN 1 THEN 'media' WHEN 2 THEN 'baixa' ELSE 'manual' END AS confidence,
 cluster_id % 3 = 0 AS validated, cluster_id % 7 = 0 AS held FROM ev GROUP BY analysis_id, cluster_id)"""


def cards(events):
    """Stand-in board: the stops of a file that share a cluster are one card."""
    made = events.groupBy("analysis_id", "cluster_id").agg(
        F.count(F.lit(1)).alias("count"), calc.as_double(F.sum("minutos_parada")).alias("minutes"), F.countDistinct("event_id").alias("events"),
        F.min("failure_class").alias("class"), F.max("failure_class").alias("auto_class"))
    return made.selectExpr("analysis_id", "CAST(cluster_id AS STRING) AS card_id", "'m' || CAST(cluster_id % 5 AS STRING) AS column_id", "count", "minutes", "events", "class", "auto_class",
                           "CASE cluster_id % 4 WHEN 0 THEN 'alta' WHEN 1 THEN 'media' WHEN 2 THEN 'baixa' ELSE 'manual' END AS confidence",
                           "cluster_id % 3 = 0 AS validated", "cluster_id % 7 = 0 AS held")


def card_members(stops):
    return stops.select("analysis_id", F.col("cluster_id").cast("string").alias("card_id"), F.col("id").alias("record_id"))


@query("e16_card_rollup", EV + """ SELECT analysis_id, CAST(cluster_id AS VARCHAR) AS card_id, count(*) AS count, CAST(sum(minutos_parada) AS DOUBLE) AS minutes, count(DISTINCT event_id) AS events,
 arg_min(observacao_raw, id) AS sample, coalesce(array_to_string(list_sort(list(DISTINCT order_number) FILTER (WHERE order_number <> ''))[1:20], ','), '') AS orders,
 array_to_string(list_sort(list(DISTINCT tipo_parada)), ',') AS types, array_to_string(list_sort(list(DISTINCT CAST(data_inicio AS VARCHAR))), ',') AS dates
 FROM ev GROUP BY analysis_id, cluster_id""")
def e16_card_rollup(spark, folder):
    events = reviewed_events(spark, folder)
    return bd.card_rollup(events, card_members(events)).withColumns({c: F.array_join(c, ",") for c in ("orders", "types", "dates")})


@query("e17_machine_buckets", EV + ", " + CARD + """, r AS (SELECT *, CASE confidence WHEN 'baixa' THEN 2 WHEN 'media' THEN 1 ELSE 0 END AS k FROM cards)
 SELECT analysis_id, class, column_id, count(*) AS cards, round(sum(minutes), 2) AS minutes, CAST(sum(events) AS BIGINT) AS events, count_if(NOT validated) AS pending,
 coalesce(max(k) FILTER (WHERE NOT validated), -1) AS worst_rank FROM r GROUP BY 1, 2, 3""")
def e17_machine_buckets(spark, folder):
    rank = F.when(F.col("worst") == "", -1).when(F.col("worst") == "baixa", 2).when(F.col("worst") == "media", 1).otherwise(0)
    return bd.machine_buckets(cards(reviewed_events(spark, folder))).select("analysis_id", "class", "column_id", "cards", F.round("minutes", 2).alias("minutes"),
                                                                            "events", "pending", rank.alias("worst_rank"))


@query("e18_class_columns", EV + ", " + CARD + """, a AS (SELECT analysis_id, auto_class, sum(minutes) AS m FROM cards GROUP BY 1, 2)
 SELECT c.analysis_id, c.class, round(sum(c.minutes), 2) AS minutes, bool_and(c.validated) AS validated, count(DISTINCT c.column_id) AS machines, round(coalesce(any_value(a.m), -1), 2) AS auto_minutes
 FROM cards c LEFT JOIN a ON a.analysis_id = c.analysis_id AND a.auto_class = c.class GROUP BY 1, 2""")
def e18_class_columns(spark, folder):
    return bd.class_columns(cards(reviewed_events(spark, folder))).select("analysis_id", "class", F.round("minutes", 2).alias("minutes"), "validated", "machines",
                                                                          F.round("auto_minutes", 2).alias("auto_minutes"))


@query("e19_automation", EV + ", " + CARD + """, b AS (SELECT analysis_id, count_if(confidence = 'alta') AS cards_alta, CAST(sum(count) FILTER (WHERE confidence = 'alta') AS BIGINT) AS ra,
  CAST(sum(count) FILTER (WHERE confidence = 'media') AS BIGINT) AS rm, count_if(confidence IN ('alta', 'manual') AND NOT validated AND NOT held) AS pending_high FROM cards GROUP BY 1),
 l AS (SELECT analysis_id, count(*) AS lines, count(DISTINCT event_id) AS failures, count_if(order_number <> '') AS with_order FROM ev GROUP BY 1)
 SELECT b.analysis_id, cards_alta, ra AS records_alta, rm AS records_media, pending_high, lines, failures, with_order,
 CAST((2000 * (ra + rm) + lines) // (2 * lines) AS DOUBLE) / 10 AS auto_rate, CAST((2000 * ra + lines) // (2 * lines) AS DOUBLE) / 10 AS high_rate FROM b JOIN l ON l.analysis_id = b.analysis_id""")
def e19_automation(spark, folder):
    events = reviewed_events(spark, folder)
    return bd.automation(cards(events), events).select("analysis_id", "cards_alta", "records_alta", "records_media", "pending_high", "lines", "failures", "with_order", "auto_rate", "high_rate")


@query("g05_safe_batch", EV + ", " + CARD + " SELECT analysis_id, card_id, minutes FROM cards WHERE confidence IN ('alta', 'manual') AND NOT validated AND NOT held")
def g05_safe_batch(spark, folder):
    return bd.safe_batch(cards(reviewed_events(spark, folder))).select("analysis_id", "card_id", "minutes")


@query("g06_held_cards", EV + ", " + CARD + " SELECT analysis_id, card_id FROM cards WHERE held")
def g06_held_cards(spark, folder):
    return bd.held_cards(cards(reviewed_events(spark, folder)).withColumn("held_at", F.col("card_id"))).select("analysis_id", "card_id")


@query("c08_board_readiness", EV + ", " + CARD + """ SELECT analysis_id, count(*) AS groups_count, count_if(validated AND NOT held) AS validated_count, count_if(held) AS held_count,
 count_if(NOT held) > 0 AND count_if(NOT held AND NOT validated) = 0 AS ready FROM cards GROUP BY 1""")
def c08_board_readiness(spark, folder):
    return cp.board_readiness(cards(reviewed_events(spark, folder)))


@query("e22_consolidated_rows", EV + """, g AS (SELECT group_id, data_inicio, arg_min(centro, id) AS centro, arg_min(linha, id) AS linha, arg_min(equipamento, id) AS equipamento,
  CAST(sum(minutos_parada) AS DOUBLE) AS minutos_parada, CAST(max(pts_acumulados) AS DOUBLE) AS pts_acumulados, count(*) AS count, count(DISTINCT event_id) AS events,
  strftime(TIMESTAMP '2000-01-01' + to_minutes(min(iv_a)), '%H:%M') || '-' || strftime(TIMESTAMP '2000-01-01' + to_minutes(max(iv_b)), '%H:%M') AS intervalo,
  coalesce(array_to_string(list_sort(list(DISTINCT order_number) FILTER (WHERE order_number <> ''))[1:4], ', '), '') AS orders FROM ev GROUP BY 1, 2),
 t AS (SELECT group_id, data_inicio, turno, min(id) AS f FROM ev GROUP BY 1, 2, 3),
 j AS (SELECT group_id, data_inicio, string_agg(turno, ' / ' ORDER BY f) AS turno FROM t GROUP BY 1, 2)
 SELECT g.*, j.turno FROM g JOIN j ON j.group_id = g.group_id AND j.data_inicio = g.data_inicio""")
def e22_consolidated_rows(spark, folder):
    rows = bd.consolidated_rows(reviewed_events(spark, folder))
    return rows.select("group_id", "data_inicio", "centro", "linha", "equipamento", "minutos_parada", "pts_acumulados", "count", "events", "intervalo", "orders", "turno")


@query("a11_classified_output", EV + ", " + CARD + """ SELECT e.id, c.class AS "Classificação", CASE WHEN c.class IN ('SEM DESCRIÇÃO', 'SEM MODO DE FALHA IDENTIFICADO') THEN 'baixa'
 WHEN validated THEN 'validada' ELSE confidence END AS tone FROM ev e JOIN cards c ON c.analysis_id = e.analysis_id AND c.card_id = CAST(e.cluster_id AS VARCHAR)""")
def a11_classified_output(spark, folder):
    events = reviewed_events(spark, folder)
    return sinks.classified_output(events, card_members(events), cards(events)).select("id", "Classificação", "tone")


@query("a14_converted_cards", with_tables("stops clusters canonical records", """, k AS (SELECT r.*, CAST(r.id // 60 AS VARCHAR) AS card_id, cf.nome_canonico AS nm FROM records r
 LEFT JOIN canonical cf ON cf.id = r.canonical_failure_id)
 SELECT card_id, bool_and(status = 'confirmed') AND count(DISTINCT nm) <= 1 AS validated, bool_or(question_flag) AS held,
 CASE WHEN count(DISTINCT nm) = 1 THEN min(nm) ELSE 'antigo' END AS name FROM k GROUP BY 1"""))
def a14_converted_cards(spark, folder):
    records = fx.records(spark, folder)
    members = records.select(F.floor(F.col("id") / 60).cast("string").alias("card_id"), F.col("id").alias("record_id"))
    base = members.select("card_id").distinct().withColumns({"column_id": F.lit("m"), "name": F.lit("antigo")})
    return bd.convert_legacy(base, members, records, fx.canonical(spark, folder))["cards"].select("card_id", "validated", "held", "name")


# ---- review log over the board: one click per card, derived from the card number ---------------------------------

def review_log(board):
    n = F.col("card_id").cast("bigint")
    action = F.when(n % 6 == 0, "validate_card").when(n % 6 == 1, "hold").when(n % 6 == 2, "set_class").when(n % 6 == 3, "undo").otherwise("rename_card")
    empty = F.lit(None).cast("string")
    return board.select("analysis_id", n.alias("seq"), action.alias("action"), "card_id", empty.alias("target_id"), "column_id",
                        F.when(n % 6 == 2, F.lit("nova classe")).when(n % 6 > 3, F.lit("nome novo")).alias("value"), F.lit("ver").alias("note"),
                        F.lit(None).cast("array<string>").alias("ids"))


LOG = EV + ", " + CARD + """, clicks AS (SELECT analysis_id, CAST(card_id AS BIGINT) AS n FROM cards),
 live AS (SELECT analysis_id, n FROM clicks WHERE n % 6 NOT IN (2, 3))"""


@query("m12_live_actions", LOG + " SELECT analysis_id, n AS seq FROM live")
def m12_live_actions(spark, folder):
    return rv.live_actions(review_log(cards(reviewed_events(spark, folder))))


@query("m01_board_after_review", LOG + """ SELECT c.analysis_id, card_id, CAST(card_id AS BIGINT) % 6 = 0 AS validated, CAST(card_id AS BIGINT) % 6 = 1 AS held,
 CASE WHEN CAST(card_id AS BIGINT) % 6 > 3 THEN 'nome novo' ELSE 'card ' || card_id END AS name FROM cards c""")
def m01_board_after_review(spark, folder):
    board = cards(reviewed_events(spark, folder))
    base = board.select("analysis_id", "card_id", "column_id", F.concat(F.lit("card "), "card_id").alias("name"), F.col("class").alias("suggested"), F.col("count").alias("size"))
    folded = rv.fold_actions(review_log(board), base, board.select("analysis_id", "column_id").distinct())
    return rv.board_cards(base, folded).select("analysis_id", "card_id", "validated", "held", "name")


@query("d10_validated_stops", EV + ", " + CARD + """ SELECT e.id, 'Maquina ' || column_id AS equipamento, 'L1' AS linha, c.class AS failure_class FROM ev e
 JOIN cards c ON c.analysis_id = e.analysis_id AND c.card_id = CAST(e.cluster_id AS VARCHAR) WHERE validated AND NOT held""")
def d10_validated_stops(spark, folder):
    events = reviewed_events(spark, folder)
    board = cards(events).withColumn("name", F.concat(F.lit("card "), "card_id"))
    columns = board.select("analysis_id", "column_id").distinct().select("analysis_id", "column_id", F.lit("U").alias("unit"), F.lit("L1").alias("line"),
                                                                         F.concat(F.lit("Maquina "), "column_id").alias("name"))
    return rv.validated_stops(events, card_members(events), board, columns).select("id", "equipamento", "linha", "failure_class")

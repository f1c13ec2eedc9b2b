"""Registered queries: training examples, models, evaluation and reports (L)."""

from pyspark.sql import functions as F

from stoplens.operators import items as it
from stoplens.operators import log_tables as lt
from stoplens.operators import models as ml
from stoplens.operators import sheet_model as sm
from stoplens.operators import training as tr
from stoplens.functions import calc, text
from stoplens.plans import fixtures as fx
from stoplens.plans.fixtures import with_tables
from stoplens.plans.queries_flow import B13, B14, FLOW, decisions, flow_items, noted, O
from stoplens.plans.queries_log_tables import LANES
from stoplens.plans.queries_reliability import reviewed_events
from stoplens.plans.registry import query
from stoplens.session import staged

LABEL = """CASE WHEN id % 97 = 0 THEN 'Sem detalhes' WHEN id % 12 IN (0, 2) THEN CASE WHEN id % 11 = 0 THEN 'Rolamentos quebrados' ELSE 'Rolamento quebrado' END
 WHEN id % 12 = 3 THEN 'Mancal' WHEN id % 12 = 1 THEN CASE WHEN id % 31 = 0 THEN 'Correia rompida' ELSE 'Sensor danificado' END
 WHEN id % 12 = 7 THEN 'Correia rompida' WHEN id % 12 = 8 THEN 'Carrossel travado' ELSE 'Ajuste geral' END"""


def labelled(spark, folder):
    """Notes with the label an analyst would type; some are plural, some uninformative, some contradict."""
    return noted(fx.stops(spark, folder)).select(F.col(O).alias("note"), F.expr(LABEL).alias("label"), F.col("id").alias("seq"))


LAB = "WITH " + fx.CTE["reviewed"] + f""", noted AS (SELECT * REPLACE (CASE WHEN observacao_raw <> '' THEN observacao_raw || ' posicao ' || CAST(id % 41 AS VARCHAR) ELSE '' END AS observacao_raw) FROM reviewed),
 lab AS (SELECT id, {B13.format(x=O)} AS norm, {LABEL} AS label FROM noted),
 kept AS (SELECT *, CASE label WHEN 'Rolamentos quebrados' THEN 'rolamento quebrado' ELSE lower(label) END AS g FROM lab
  WHERE ({B14.format(x='norm')}) AND label <> 'Sem detalhes'),
 pairs AS (SELECT norm, g, count(*) AS n FROM kept GROUP BY 1, 2),
 pick AS (SELECT norm, g, row_number() OVER (PARTITION BY norm ORDER BY n DESC, o DESC, g DESC) AS r, sum(n) OVER (PARTITION BY norm) AS weight
  FROM (SELECT *, sum(n) OVER (PARTITION BY g) AS o FROM pairs) p)"""


@query("l01_cleaning_counts", LAB + f""" SELECT (SELECT count_if(NOT ({B14.format(x='norm')})) FROM lab) AS sem_conteudo,
 (SELECT count_if(({B14.format(x='norm')}) AND label = 'Sem detalhes') FROM lab) AS rotulo_sem_informacao,
 (SELECT count(DISTINCT label) FROM kept) AS rotulos_antes, (SELECT count(DISTINCT g) FROM kept) AS rotulos_depois,
 (SELECT CAST(sum(n - 1) AS BIGINT) FROM pairs) AS duplicadas, (SELECT count(*) FROM (SELECT norm FROM pairs GROUP BY 1 HAVING count(*) > 1) x) AS conflitos,
 (SELECT count(DISTINCT norm) FROM kept) AS exemplos""")
def l01_cleaning_counts(spark, folder):
    return tr.prepare(labelled(spark, folder))["counts"].select(
        "sem_conteudo", "rotulo_sem_informacao", "rotulos_antes", "rotulos_depois", "duplicadas", "conflitos", "exemplos")


@query("l04_examples", LAB + """ SELECT norm AS text, upper(substr(g, 1, 1)) || substr(g, 2) AS detail, CAST(weight AS DOUBLE) AS weight FROM pick WHERE r = 1""")
def l04_examples(spark, folder):
    return tr.prepare(labelled(spark, folder))["examples"].select("text", "detail", "weight")


@query("l02_merged_labels", LAB + " SELECT DISTINCT lower(label) AS label_key, g AS merged FROM kept")
def l02_merged_labels(spark, folder):
    kept = tr.clean_labelled(labelled(spark, folder)).filter("dropped IS NULL")
    return tr.merge_labels(kept)


@query("l05_example_classes")
def l05_example_classes(spark, folder):
    """Classes of all examples (a label that names no class leaves it to the note: checked in the tests)."""
    return tr.prepare(labelled(spark, folder))["examples"].groupBy("cls").agg(F.count(F.lit(1)).alias("n"))


@query("l10_softmax", with_tables("stops", """, e AS (SELECT id, exp((CAST(minutos_parada AS DOUBLE) / 60 - 1) / 0.15) AS a, exp((id % 7 / 7.0 - 1) / 0.15) AS b, 1.0 AS c FROM stops)
 SELECT id, round(a / (a + b + exp((0.5 - 1) / 0.15)), 6) AS p1, round(b / (a + b + exp((0.5 - 1) / 0.15)), 6) AS p2 FROM e"""))
def l10_softmax(spark, folder):
    scores = F.array(F.col("minutos_parada").cast("double") / 60, (F.col("id") % 7) / 7, F.lit(0.5))
    p = ml.softmax(scores)
    return fx.stops(spark, folder).select("id", F.round(p[0], 6).alias("p1"), F.round(p[1], 6).alias("p2"))


@query("l11_split_sizes", FLOW + " SELECT CAST(round(count(*) * 0.8) AS BIGINT) AS train, count(*) - CAST(round(count(*) * 0.8) AS BIGINT) AS test FROM items")
def l11_split_sizes(spark, folder):
    rows = flow_items(spark, folder).select(F.concat_ws("|", "analysis_id", "ml_key").alias("text"))
    return ml.split_examples(rows, 42).agg(F.count_if("in_train").alias("train"), F.count_if(~F.col("in_train")).alias("test"))


SCORED = FLOW + """, sc AS (SELECT ml_key AS text, CASE WHEN n_linhas % 3 = 0 THEN 'CLASSE 1' ELSE classe END AS cls, classe, coalesce(confianca, 0) / 100 AS c FROM items)"""


def scored_items(spark, folder):
    rows = flow_items(spark, folder)
    return rows.select(F.col("ml_key").alias("text"), F.when(F.col("n_linhas") % 3 == 0, "CLASSE 1").otherwise(F.col("classe")).alias("cls"), "classe",
                       F.array("classe", F.lit("CLASSE 1")).alias("top3_classes"), F.lit("d").alias("detail"),
                       F.when(F.col("n_linhas") % 2 == 0, "D").otherwise("x").alias("suggested"),
                       calc.band(F.coalesce("confianca", F.lit(0.0)) / 100).alias("faixa"))


@query("l12_evaluation", SCORED + """, k AS (SELECT count(*) AS n, count_if(cls = classe) AS h FROM sc)
 SELECT n, CAST((2000 * h + n) // (2 * n) AS DOUBLE) / 10 AS accuracy, CAST((2000 * (n - h) + n) // (2 * n) AS DOUBLE) / 10 AS error_rate, CAST(100 AS DOUBLE) AS top3,
 (SELECT CAST((2000 * count_if(n_linhas % 2 = 0) + count(*)) // (2 * count(*)) AS DOUBLE) / 10 FROM items) AS detail_accuracy FROM k""")
def l12_evaluation(spark, folder):
    return ml.evaluate(scored_items(spark, folder)).select("n", "accuracy", "error_rate", "top3", "detail_accuracy")


@query("l12_band_report", SCORED + """ SELECT CASE WHEN c >= 0.5 THEN 'Alta' WHEN c >= 0.2 THEN 'Média' ELSE 'Baixa' END AS band, count(*) AS count,
 CAST((2000 * count(*) + sum(count(*)) OVER ()) // (2 * sum(count(*)) OVER ()) AS DOUBLE) / 10 AS share,
 CAST((2000 * count_if(cls = classe) + count(*)) // (2 * count(*)) AS DOUBLE) / 10 AS accuracy FROM sc GROUP BY 1""")
def l12_band_report(spark, folder):
    return ml.band_report(scored_items(spark, folder))


CARDS_SQL = """, cards AS (SELECT analysis_id, cluster_id, count(*) AS count, CASE cluster_id % 5 WHEN 0 THEN 'SEM DESCRIÇÃO' WHEN 1 THEN 'A' WHEN 2 THEN 'B' ELSE 'C' END AS class,
 CASE cluster_id % 7 WHEN 0 THEN 'SEM DESCRIÇÃO' WHEN 1 THEN 'A' WHEN 2 THEN 'B' ELSE 'C' END AS suggested,
 CASE cluster_id % 3 WHEN 0 THEN 'memoria' WHEN 1 THEN 'aprendizado' ELSE 'regra' END AS source FROM stops GROUP BY 1, 2),
 k AS (SELECT *, NOT (class = 'SEM DESCRIÇÃO' AND suggested = 'SEM DESCRIÇÃO') AS live FROM cards),
 t AS (SELECT analysis_id, CAST(sum(count) AS BIGINT) AS records, count(*) AS cards, sum(count) FILTER (WHERE live) AS total,
  coalesce(sum(count) FILTER (WHERE live AND class = suggested AND suggested <> 'SEM DESCRIÇÃO'), 0) AS hits, count_if(live AND class <> suggested) AS corrections,
  coalesce(sum(count) FILTER (WHERE live AND source <> 'regra'), 0) AS past, count_if(class = 'SEM DESCRIÇÃO') AS unclassified FROM k GROUP BY 1),
 rep AS (SELECT analysis_id, records, cards, corrections, unclassified, CAST((2000 * hits + total) // (2 * total) AS DOUBLE) / 10 AS hit_rate,
  CAST((2000 * past + total) // (2 * total) AS DOUBLE) / 10 AS from_past FROM t)"""


def sheet_cards(spark, folder, by="analysis_id"):
    pick = lambda n: F.expr(f"CASE cluster_id % {n} WHEN 0 THEN 'SEM DESCRIÇÃO' WHEN 1 THEN 'A' WHEN 2 THEN 'B' ELSE 'C' END")
    return fx.stops(spark, folder).groupBy(F.col(by).alias("analysis_id"), "cluster_id").agg(F.count(F.lit(1)).alias("count")).select(
        "analysis_id", "count", pick(5).alias("class"), pick(7).alias("suggested"),
        F.expr("CASE cluster_id % 3 WHEN 0 THEN 'memoria' WHEN 1 THEN 'aprendizado' ELSE 'regra' END").alias("source"))


@query("l18_sheet_report", with_tables("stops", CARDS_SQL + " SELECT * FROM rep"))
def l18_sheet_report(spark, folder):
    return ml.sheet_report(sheet_cards(spark, folder))


@query("f20_previous_sheet_delta", with_tables("stops", CARDS_SQL + """ SELECT analysis_id AS id, hit_rate, lag(hit_rate) OVER (ORDER BY analysis_id) AS previous_hit_rate,
 round(hit_rate - lag(hit_rate) OVER (ORDER BY analysis_id), 1) AS delta FROM rep"""))
def f20_previous_sheet_delta(spark, folder):
    sheets = ml.sheet_report(sheet_cards(spark, folder)).select(F.col("analysis_id").alias("id"), F.col("analysis_id").alias("finished_at"), "hit_rate")
    return lt.previous_delta(sheets).drop("finished_at")


@query("l19_accuracy_history", with_tables("stops", """ SELECT 'v' || CAST(cluster_id % 60 AS VARCHAR) AS version, max(id) AS trained_at, arg_max(CAST(minutos_parada AS DOUBLE), id) AS accuracy
 FROM stops GROUP BY 1 ORDER BY trained_at DESC LIMIT 40"""))
def l19_accuracy_history(spark, folder):
    points = fx.stops(spark, folder).selectExpr("'v' || CAST(cluster_id % 60 AS STRING) AS version", "id AS trained_at", "CAST(minutos_parada AS DOUBLE) AS accuracy")
    return ml.accuracy_history(points)


@query("l15_note_predictions")
def l15_note_predictions(spark, folder):
    """Linear SVM on 80 % of the classified notes, classes with bands for the others."""
    notes = noted(fx.reviewed(spark, folder)).select(text.model_text(O).alias("text"), F.col("failure_class").alias("cls"), F.col("id"))
    examples = notes.filter("text <> ''").groupBy("text").agg(F.min_by("cls", "id").alias("cls"), F.count(F.lit(1)).cast("double").alias("weight"))
    parts = ml.cut_lineage(ml.split_examples(examples, 42))
    model = ml.train_sheet_model(parts.filter("in_train"))
    held = parts.filter("NOT in_train").select("text", "cls")
    predicted = model.predict(held, 0.15).select("text", "classe", F.round("confianca", 6).alias("confianca"), "faixa")
    return held.join(predicted, "text")


@query("l08_board_model_predictions")
def l08_board_model_predictions(spark, folder):
    """Logistic model on validated notes and machines; the likeliest class of every distinct note."""
    stops = fx.reviewed(spark, folder)
    validated = stops.select(O, F.col("equipamento").alias("machine"), F.col("failure_class").alias("label"),
                             (F.col("id") % 5 == 0).alias("manual"), F.col("id").alias("seq"))
    none = spark.createDataFrame([], "text string, label string, note_key string, seq bigint")
    model = ml.train_board_model(tr.board_examples(validated, none, none))
    texts = staged(stops.select(text.context_document(O, "equipamento").alias("text")).distinct(), "board-notes")
    return model.predict(texts).select("text", "classe", F.round("confianca", 4).alias("confianca"), "faixa")


@query("l06_board_examples", with_tables("reviewed", """, v AS (SELECT observacao_raw, equipamento, id, failure_class, CASE WHEN id % 5 = 0 THEN 3 ELSE 1 END AS w FROM reviewed
  WHERE failure_class NOT IN ('SEM DESCRIÇÃO', 'SEM MODO DE FALHA IDENTIFICADO'))
 SELECT equipamento AS machine, failure_class AS label, max(w) AS weight FROM v GROUP BY 1, 2, CASE id % 12 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 0 END"""))
def l06_board_examples(spark, folder):
    validated = fx.reviewed(spark, folder).select(O, F.col("equipamento").alias("machine"), F.col("failure_class").alias("label"),
                                                  (F.col("id") % 5 == 0).alias("manual"), F.col("id").alias("seq"))
    none = spark.createDataFrame([], "text string, label string, note_key string, seq bigint")
    return tr.board_examples(validated, none, none).select("machine", "label", "weight")


@query("l14_nearest_details")
def l14_nearest_details(spark, folder):
    """For every held-out note, the detail of the most similar training note of its class (exact; see the tests)."""
    notes = flow_items(spark, folder).select(F.col("ml_key").alias("text"), F.col("classe").alias("cls"), F.col("detalhe").alias("detail")).distinct()
    parts = ml.cut_lineage(ml.split_examples(notes, 42))
    train, held = parts.filter("in_train"), parts.filter("NOT in_train")
    model = ml.TextModel(ml.fit_idf(ml.feature_counts(train, 2)), None, [], 2, 0)
    return ml.nearest_details(model, held.select("text", "cls"), train)


# ---- the sheet model as one operator ------------------------------------------------------------------------------------

SAID = f"""said AS (SELECT DISTINCT norm AS relato_norm, 'falha de  mancal' AS classe, CASE WHEN length(norm) % 2 = 0 THEN 'folga' ELSE '' END AS detalhe
 FROM (SELECT {B13.format(x=O)} AS norm FROM noted) x WHERE length(norm) % 5 = 0 AND norm <> '')"""


def said(spark, folder):
    """What an analyst answered about some of the notes."""
    notes = staged(noted(fx.stops(spark, folder)).select(text.without_long_numbers(O).alias("note")).distinct(), "said-notes")  # else the filter asks for the text of every row
    norm = notes.select(text.model_text("note").alias("relato_norm")).distinct().filter("length(relato_norm) % 5 = 0 AND relato_norm <> ''")
    return norm.select(F.col("relato_norm").alias("relato"), "relato_norm", F.lit("falha de  mancal").alias("classe"),
                       F.when(F.length("relato_norm") % 2 == 0, "folga").otherwise("").alias("detalhe"))


@query("l20_training_fingerprint", LAB + ", " + SAID + """, h1 AS (SELECT sha256(concat_ws(chr(31), '=' || trim(observacao_raw), '=' || trim(label))) AS h FROM noted JOIN lab USING (id)),
 h2 AS (SELECT sha256(concat_ws(chr(31), '=' || trim(relato_norm), '=' || trim(classe), '=' || trim(detalhe))) AS h FROM said)
 SELECT sha256((SELECT sha256(concat_ws('|', CAST(count(*) AS VARCHAR), """ + LANES + """)) FROM h1) || '|' || (SELECT sha256(concat_ws('|', CAST(count(*) AS VARCHAR), """ + LANES + """)) FROM h2)) AS fingerprint""")
def l20_training_fingerprint(spark, folder):
    return spark.range(1).select(F.lit(sm.training_fingerprint(labelled(spark, folder), said(spark, folder))).alias("fingerprint"))


@query("l15_analyst_answers", LAB + ", " + SAID + " SELECT relato_norm AS text, 'FALHA DE MANCAL' AS classe, detalhe FROM said")
def l15_analyst_answers(spark, folder):
    return sm.analyst_answers(said(spark, folder))


@query("l15_sheet_flow")
def l15_sheet_flow(spark, folder):
    """Training, items with predictions, review and failure summary of the single flow, one after the other: notes keep
    the analyst's answers, the others take the model's class with its detail and percent (model output: tests)."""
    trained = sm.train(labelled(spark, folder), said(spark, folder), other_seeds=())
    events = noted(reviewed_events(spark, folder, "minutos_parada")).select("analysis_id", "id", "event_id", "minutos_parada", O)
    stops = it.with_item_key_of_notes(events)
    keys = stops.select(F.col("ml_key").alias("text")).distinct()
    predictions = staged(sm.predict(trained, keys).withColumnRenamed("text", "ml_key").drop("top3"), "flow-predictions")
    rows = staged(it.items(stops, predictions), "flow-items")
    reviewed = staged(it.reviewed_items(rows, decisions(rows))[0], "flow-reviewed")
    return it.failure_summary(it.with_item_class(stops, reviewed))

"""Registered queries: text and number functions, filters, comparison, daily summaries, the single flow's items."""

from pyspark.sql import functions as F

from stoplens.functions import calc, text
from stoplens.operators import compare as cp
from stoplens.operators import items as it
from stoplens.operators import reliability as rel
from stoplens.operators.events import with_events
from stoplens.plans import fixtures as fx
from stoplens.plans.fixtures import with_tables
from stoplens.plans.queries_reliability import EVENTS, LINES, MACHINES, reviewed_events
from stoplens.plans.registry import query
from stoplens.session import staged
from stoplens.sources import sinks

# ---- text functions over every note -------------------------------------------------------------------------

ASCII = "strip_accents(replace(replace({x}, 'º', 'o'), '°', ''))"
B10 = ("trim(regexp_replace(regexp_replace(regexp_replace(" + ASCII.format(x="upper({x})")
       + ", '\\b\\d{{5,}}\\b', ' ', 'g'), '[^A-Z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))")
B13 = ("trim(regexp_replace(regexp_replace(trim(regexp_replace(lower(" + ASCII.format(x="{x}")
       + "), '[^a-z0-9]+', ' ', 'g')), '\\b\\d{{5,}}\\b', ' ', 'g'), ' +', ' ', 'g'))")
FILLER = "\\b(ORDEM|OS|O S|NOTA|N|NO|NUMERO DA ORDEM|AGUARDANDO|MIN)\\b"
B11 = ("length(trim(regexp_replace(regexp_replace(regexp_replace({x}, '\\b\\d+\\b', ' ', 'g'), '" + FILLER
       + "', ' ', 'g'), '\\s+', ' ', 'g'))) >= 3")
B14 = ("length(array_to_string(list_filter(string_split({x}, ' '), lambda w: w <> '' AND NOT regexp_full_match(w, '[0-9]+') AND w NOT IN "
       "('xxxxxx','xxx','xx','x','nota','os','falha','ajuste','teste','obs','sem','nada')), ' ')) >= 4")
O = "observacao_raw"
SHORT_LINE = "'L' || lpad(CAST(CAST(substr(linha, 6) AS INT) AS VARCHAR), 2, '0')"

FUNCTIONS = {
    "b01_header_key": (lambda: text.header_key(O), f"regexp_replace(trim(strip_accents(replace(upper({O}), 'º', 'o'))), '\\s+', ' ', 'g')"),
    "b05_strip_order_numbers": (lambda: text.strip_order_numbers(O),
                                f"regexp_replace(regexp_replace({O}, '\\([^)]*\\b\\d{{5,}}\\b[^)]*\\)', '', 'g'), '\\b\\d{{5,}}\\b', '', 'g')"),
    "b08_fold_synonyms": (lambda: text.fold_synonyms(F.upper(text.strip_accents(O))), None),
    "b10_catalog_text": (lambda: text.catalog_text(O), B10.format(x=O)),
    "b11_is_meaningful": (lambda: text.is_meaningful(text.catalog_text(O)), B11.format(x="(" + B10.format(x=O) + ")")),
    "b12_memory_key": (lambda: text.memory_key(O), f"CASE WHEN {B11.format(x='(' + B10.format(x=O) + ')')} THEN {B10.format(x=O)} ELSE '' END"),
    "b13_model_text": (lambda: text.model_text(O), B13.format(x=O)),
    "b14_has_content": (lambda: text.has_content(text.model_text(O)), B14.format(x="(" + B13.format(x=O) + ")")),
    "b15_class_label": (lambda: text.class_label(O), f"substr(upper(trim(regexp_replace({O}, '\\s+', ' ', 'g'))), 1, 120)"),
    "b16_no_info_label": (lambda: text.is_no_info_label(text.plain_text(F.when(F.col("id") % 6 == 0, "Sem mais detalhes").otherwise(F.col(O)))),
                          "id % 6 = 0"),
    "b17_label_canon": (lambda: text.label_canon(text.plain_text(O)), "array_to_string(list_sort(list_transform(list_filter(string_split("
                        f"trim(regexp_replace(lower({ASCII.format(x=O)}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '' AND w NOT IN "
                        "('de','da','do','das','dos','na','no','nas','nos','e','a','o','em','com')), lambda w: regexp_replace(w, '(oes|aes|ns|s)$', ''))), ' ')"),
    "b18_order_number": (lambda: text.order_number(O), f"regexp_extract({O}, '(?:^|[^0-9])([0-9]{{9,12}})(?:[^0-9]|$)', 1)"),
    "b20_short_line": (lambda: text.short_line("linha"), SHORT_LINE),
    "b21_display_label": (lambda: text.display_label(O), f"upper(substr(lower(trim({O})), 1, 1)) || substr(lower(trim({O})), 2)"),
    "b22_key_text": (lambda: text.key_text(O), f"upper(trim(regexp_replace({O}, '\\s+', ' ', 'g')))"),
    "b23_signal_words": (lambda: F.array_join(text.signal_words(O), " "),
                         f"array_to_string(list_filter(string_split({B10.format(x=O)}, ' '), lambda w: length(w) > 2 AND NOT regexp_full_match(w, '[0-9]+') AND w NOT IN "
                         "('ORDEM','MANUTENCAO','REALIZADO','REALIZADA','AJUSTE','AJUSTES','FALHA','PROBLEMA','MAQUINA','PARADA','AGUARDANDO','ELETRICA','MECANICA',"
                         "'NA','NO','DE','DA','DO','EM','COM','E','N')), ' ')"),
    "b23_context_document": (lambda: text.context_document(O, "equipamento"), f"trim({B10.format(x=O)} || ' MAQ_' || equipamento)"),
    "b02_iso_text": (lambda: calc.iso_text(F.col("data_inicio").cast("timestamp")), "strftime(data_inicio, '%Y-%m-%d %H:%M:%S')"),
    "b03_pt_number": (lambda: calc.pt_number(F.expr("CASE id % 4 WHEN 0 THEN '1.' || lpad(CAST(id % 1000 AS STRING),3,'0') || ',5' WHEN 1 THEN CAST(id AS STRING) || '.25' WHEN 2 THEN ' ' || CAST(id AS STRING) || ' ' ELSE 'n/a' END")),
                      "CASE id % 4 WHEN 0 THEN 1000.5 + id % 1000 WHEN 1 THEN id + 0.25 WHEN 2 THEN CAST(id AS DOUBLE) END"),
    "b04_multi_date": (lambda: calc.multi_date(F.expr("CASE id % 7 WHEN 0 THEN CAST(data_inicio AS STRING) WHEN 1 THEN date_format(data_inicio, 'dd/MM/yyyy') WHEN 2 THEN date_format(data_inicio, 'd/M/yy') WHEN 3 THEN date_format(data_inicio, 'dd-MM-yyyy') WHEN 4 THEN date_format(data_inicio, 'yyyy/MM/dd') || ' 10:00' WHEN 5 THEN CAST(datediff(data_inicio, DATE '1899-12-30') AS STRING) ELSE '30/02/2026' END")),
                       "CASE WHEN id % 7 < 6 THEN data_inicio END"),
    "b19_interval_start": (lambda: calc.interval_bounds("intervalo")[0].cast("bigint"), "60 * CAST(substr(intervalo, 1, 2) AS BIGINT)"),
    "b19_interval_end": (lambda: calc.interval_bounds("intervalo")[1].cast("bigint"), "CASE WHEN substr(intervalo, 7, 2) = '00' THEN 1440 ELSE 60 * CAST(substr(intervalo, 7, 2) AS BIGINT) END"),
    "b24_shift_value": (lambda: calc.shift_value(F.expr("CASE WHEN id % 2 = 0 THEN turno || '.0' ELSE turno || ' / 9' END")), "CASE WHEN id % 2 = 0 THEN turno ELSE turno || ' / 9' END"),
    "b24_loose_number": (lambda: calc.loose_number(F.expr("CASE id % 3 WHEN 0 THEN '' WHEN 1 THEN CAST(id AS STRING) || ',5' ELSE 'x' END")), "CASE WHEN id % 3 = 1 THEN CAST(id AS DOUBLE) + 0.5 END"),
    "b25_source_value": (lambda: calc.source_value("minutos_parada", F.concat(F.col("id").cast("string"), F.lit(".125"))), "CAST(id AS VARCHAR) || '.13'"),
    "b27_item_key": (lambda: calc.item_key("analysis_id", O), f"sha1(analysis_id || '|' || {O})"),
    "b29_period_label": (lambda: calc.period_label(F.when(F.col("id") % 3 > 0, F.col("data_inicio")), F.date_add("data_inicio", (F.col("id") % 2).cast("int"))),
                         "CASE WHEN id % 3 = 0 THEN 'todo o período' WHEN id % 2 = 0 THEN strftime(data_inicio, '%d/%m/%Y') ELSE strftime(data_inicio, '%d/%m/%Y') || ' - ' || strftime(data_inicio + 1, '%d/%m/%Y') END"),
    "b29_period_title": (lambda: calc.period_title(F.trunc("data_inicio", "month"), F.when(F.col("id") % 2 == 0, F.last_day("data_inicio")).otherwise(F.date_add(F.last_day("data_inicio"), 3))),
                         "CASE WHEN id % 2 = 0 THEN 'Janeiro de 2024' ELSE '01/01/2024 – 03/02/2024' END"),
    "b31_band": (lambda: calc.band(F.col("minutos_parada").cast("double") / 30), "CASE WHEN CAST(minutos_parada AS DOUBLE) / 30 >= 0.5 THEN 'Alta' WHEN CAST(minutos_parada AS DOUBLE) / 30 >= 0.2 THEN 'Média' ELSE 'Baixa' END"),
    "b32_quadrant": (lambda: calc.quadrant(F.col("id") % 10, F.col("minutos_parada"), F.lit(5), F.lit(8)),
                     "CASE WHEN id % 10 >= 5 AND minutos_parada >= 8 THEN 'Crítico-crônico' WHEN minutos_parada >= 8 THEN 'Crítico' WHEN id % 10 >= 5 THEN 'Crônico' ELSE 'Conforto' END"),
    "b33_day_group": (lambda: calc.day_group("data_inicio", F.lit("2024-01-20").cast("date")),
                      "CASE WHEN data_inicio = DATE '2024-01-20' THEN 'Hoje' WHEN data_inicio = DATE '2024-01-19' THEN 'Ontem' WHEN data_inicio > DATE '2024-01-20' THEN 'Próximos dias' WHEN data_inicio > DATE '2024-01-13' THEN 'Últimos 7 dias' ELSE 'Janeiro de 2024' END"),
    "b34_score_tone": (lambda: calc.score_tone(F.col("id") % 101), "CASE WHEN id % 101 >= 85 THEN 'ok' WHEN id % 101 >= 70 THEN 'warn' ELSE 'bad' END"),
}
for _name, (_column, _sql) in FUNCTIONS.items():
    @query(_name, None if _sql is None else with_tables("stops", f"SELECT id, {_sql} AS value FROM stops"))
    def _function(spark, folder, column=_column):
        return fx.stops(spark, folder).select("id", column().alias("value"))


@query("b09_context_keys", with_tables("stops", """SELECT upper(centro) AS centro, upper(linha) AS linha, upper(equipamento) AS equipamento,
 upper(tipo_parada) AS tipo_parada, upper(subchave_parada) AS subchave_parada, upper(sistema) AS sistema, count(*) AS n FROM stops GROUP BY ALL"""))
def b09_context_keys(spark, folder):
    keyed = fx.stops(spark, folder).select(text.context_key().alias("k")).filter("k IS NOT NULL")
    return keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n")).select("k.*", "n")


@query("b30_wilson_by_line", with_tables("stops", """, g AS (SELECT linha, CAST(count_if(question_flag) AS DOUBLE) AS h, CAST(count(*) AS DOUBLE) AS n FROM stops GROUP BY 1),
 p AS (SELECT *, h / n AS p FROM g)
 SELECT linha, round(greatest(0, (p + 1.96*1.96/(2*n)) / (1 + 1.96*1.96/n) - 1.96 * sqrt(p*(1-p)/n + 1.96*1.96/(4*n*n)) / (1 + 1.96*1.96/n)), 6) AS low,
 round(least(1, (p + 1.96*1.96/(2*n)) / (1 + 1.96*1.96/n) + 1.96 * sqrt(p*(1-p)/n + 1.96*1.96/(4*n*n)) / (1 + 1.96*1.96/n)), 6) AS high FROM p"""))
def b30_wilson_by_line(spark, folder):
    g = fx.stops(spark, folder).groupBy("linha").agg(F.count_if("question_flag").alias("h"), F.count(F.lit(1)).alias("n"))
    low, high = calc.wilson("h", "n")
    return g.select("linha", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("c09_period_ranges", with_tables("stops", """SELECT DISTINCT data_inicio, CAST(date_trunc('week', data_inicio) AS DATE) AS week_from,
 CAST(date_trunc('week', data_inicio) + INTERVAL 6 DAY AS DATE) AS week_to, CAST(date_trunc('month', data_inicio) AS DATE) AS month_from,
 last_day(data_inicio) AS month_to, make_date(year(data_inicio), 1, 1) AS year_from, make_date(year(data_inicio), 12, 31) AS year_to FROM stops"""))
def c09_period_ranges(spark, folder):
    days = fx.stops(spark, folder).select("data_inicio").distinct()
    ends = {f"{m}_{e}": c for m in ("week", "month", "year") for e, c in zip(("from", "to"), calc.period_range(m, "data_inicio"))}
    return days.select("data_inicio", *[c.alias(n) for n, c in ends.items()])


@query("c10_comparison_presets", with_tables("stops", """, d AS (SELECT DISTINCT data_inicio AS d FROM stops)
 SELECT d AS anchor, '7d' AS preset, d - 13 AS a_from, d - 7 AS a_to, d - 6 AS b_from, d AS b_to FROM d
 UNION ALL SELECT d, '30d', d - 59, d - 30, d - 29, d FROM d
 UNION ALL SELECT d, 'week', CAST(date_trunc('week', d) AS DATE) - 7, CAST(date_trunc('week', d) AS DATE) - 1, CAST(date_trunc('week', d) AS DATE), CAST(date_trunc('week', d) AS DATE) + 6 FROM d
 UNION ALL SELECT d, 'month', CAST(date_trunc('month', d) - INTERVAL 1 MONTH AS DATE), CAST(date_trunc('month', d) AS DATE) - 1, CAST(date_trunc('month', d) AS DATE), last_day(d) FROM d"""))
def c10_comparison_presets(spark, folder):
    days = fx.stops(spark, folder).select(F.col("data_inicio").alias("anchor")).distinct()
    names = ("a_from", "a_to", "b_from", "b_to")
    presets = [F.struct(F.lit(p).alias("preset"), *[c.alias(n) for n, c in zip(names, calc.comparison_ranges(p, "anchor"))])
               for p in ("7d", "30d", "week", "month")]
    return days.select("anchor", F.explode(F.array(*presets)).alias("p")).select("anchor", "p.*")


# ---- C1, F11, F21 --------------------------------------------------------------------------------------------------

@query("c01_selected_metrics", "WITH " + fx.CTE["reviewed"] + ", " + EVENTS + """ SELECT count(DISTINCT event_id) AS count, count(*) AS lines,
 CAST(sum(minutos_parada) AS DOUBLE) AS minutes FROM ev WHERE data_inicio BETWEEN DATE '2024-01-08' AND DATE '2024-01-21'
 AND analysis_id IN ('1', '2') AND centro = 'B0AC' AND tipo_parada = 'P.EQ.LINHA' AND failure_class = 'FALHA DE ROLAMENTO'""")
def c01_selected_metrics(spark, folder):
    chosen = cp.select_stops(reviewed_events(spark, folder), "2024-01-08", "2024-01-21", ["1", "2"], unit="B0AC",
                             failure="P.EQ.LINHA", fclass="FALHA DE ROLAMENTO")
    return rel.metric_strip(chosen).select("count", "lines", "minutes")


CHANGES = """a AS (SELECT centro AS unit, linha AS line, equipamento AS name, count(DISTINCT event_id) AS q FROM ev
  WHERE data_inicio BETWEEN DATE '2024-01-01' AND DATE '2024-01-15' GROUP BY 1, 2, 3),
b AS (SELECT centro AS unit, linha AS line, equipamento AS name, count(DISTINCT event_id) AS q FROM ev
  WHERE data_inicio BETWEEN DATE '2024-01-16' AND DATE '2024-01-30' GROUP BY 1, 2, 3),
ch AS (SELECT coalesce(a.unit, b.unit) AS unit, coalesce(a.line, b.line) AS line, coalesce(a.name, b.name) AS name,
  coalesce(a.q, 0) AS before, coalesce(b.q, 0) AS after FROM a FULL JOIN b ON a.unit = b.unit AND a.line = b.line AND a.name = b.name),
changes AS (SELECT *, after - before AS delta, CASE WHEN before = 0 THEN 'new' WHEN after < before THEN 'down' WHEN after > before THEN 'up' ELSE 'same' END AS direction,
  CASE WHEN before <> 0 THEN sign(after - before) * CAST((20000 * abs(after - before) + before) // (2 * before) AS DOUBLE) / 100 END AS percentage FROM ch)"""


def _changes(spark, folder):
    return cp.compare_periods(reviewed_events(spark, folder), "2024-01-16", "2024-01-30")


@query("f11_period_comparison", "WITH " + fx.CTE["reviewed"] + ", " + EVENTS + ", " + CHANGES + " SELECT * FROM changes")
def f11_period_comparison(spark, folder):
    return _changes(spark, folder).drop("key")


@query("f11_direction_counts", "WITH " + fx.CTE["reviewed"] + ", " + EVENTS + ", " + CHANGES + """ SELECT count(*) AS n_all, count_if(direction = 'up') AS n_up,
 count_if(direction = 'down') AS n_down, count_if(direction = 'new') AS n_new, count_if(direction = 'same') AS n_same FROM changes""")
def f11_direction_counts(spark, folder):
    return cp.direction_counts(_changes(spark, folder))


@query("f21_largest_changes", "WITH " + fx.CTE["reviewed"] + ", " + EVENTS + ", " + CHANGES + """ SELECT unit, line, name, delta FROM changes WHERE delta <> 0
 ORDER BY abs(delta) DESC, unit || chr(31) || line || chr(31) || name LIMIT 10""")
def f21_largest_changes(spark, folder):
    return cp.largest_changes(_changes(spark, folder)).select("unit", "line", "name", "delta")


@query("h01_machine_keys_of_both_periods", "WITH " + fx.CTE["reviewed"] + ", " + EVENTS + ", " + CHANGES + " SELECT unit, line, name FROM changes")
def h01_machine_keys_of_both_periods(spark, folder):
    return _changes(spark, folder).select("unit", "line", "name")


@query("h02_union_of_analyses", with_tables("reviewed", "SELECT analysis_id, count(*) AS n FROM reviewed WHERE analysis_id IN ('0', '3') GROUP BY 1"))
def h02_union_of_analyses(spark, folder):
    stops = fx.reviewed(spark, folder)
    both = cp.select_stops(stops, analyses=["0"]).unionByName(cp.select_stops(stops, analyses=["3"]))
    return both.groupBy("analysis_id").agg(F.count(F.lit(1)).alias("n"))


# ---- E9, G7 -----------------------------------------------------------------------------------------------------------

DAILY = """, x AS (SELECT analysis_id, data_inicio, equipamento, count(*) AS n, sum(minutos_parada) AS t FROM stops GROUP BY 1, 2, 3),
 daily AS (SELECT analysis_id, data_inicio, CAST(sum(n) AS BIGINT) AS count, CAST(sum(t) AS DOUBLE) AS minutes,
  array_to_string(list_transform(list(t ORDER BY t DESC)[1:9], lambda v: CAST(v AS VARCHAR)), ';') AS series FROM x GROUP BY 1, 2)"""


def _daily(spark, folder):
    series = F.array_join(F.transform("series", lambda v: v.cast("decimal(12,2)").cast("string")), ";")
    return cp.daily_summary(fx.stops(spark, folder)).withColumn("series", series)


@query("e09_daily_summary", with_tables("stops", DAILY + " SELECT * FROM daily"))
def e09_daily_summary(spark, folder):
    return _daily(spark, folder)


@query("g07_daily_folders", with_tables("stops batches", DAILY + """ SELECT d.analysis_id, d.data_inicio, d.count, b.filename FROM daily d
 JOIN batches b ON CAST(b.id AS VARCHAR) = d.analysis_id WHERE b.id <> 2 AND d.data_inicio BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'
 AND (b.filename LIKE '%/01%' OR strftime(d.data_inicio, '%d/%m/%Y') LIKE '1%/01%')"""))
def g07_daily_folders(spark, folder):
    analyses = fx.batches(spark, folder).selectExpr("CAST(id AS STRING) AS analysis_id", "filename", "'1' || filename AS name", "id <> 2 AS ready")
    rows = cp.daily_folders(_daily(spark, folder), analyses.withColumn("name", F.lit("-")), "2024-01-05", "2024-01-25", "- 1")
    return rows.select("analysis_id", "data_inicio", "count", "filename")


# ---- the single flow ------------------------------------------------------------------------------------------------------

KEYED = f"""noted AS (SELECT * REPLACE (CASE WHEN observacao_raw <> '' THEN observacao_raw || ' posicao ' || CAST(id % 41 AS VARCHAR) ELSE '' END AS observacao_raw) FROM reviewed),
keyed AS (SELECT *, CASE WHEN {B14.format(x='k')} THEN k ELSE '' END AS ml_key FROM (SELECT *, {B13.format(x=O)} AS k FROM noted) n),
preds AS (SELECT DISTINCT ml_key, 'CLASSE ' || CAST(length(ml_key) % 7 AS VARCHAR) AS classe, 'det ' || substr(ml_key, 1, 5) AS detalhe,
  CASE WHEN length(ml_key) % 11 = 0 THEN NULL ELSE (length(ml_key) * 37) % 100 / 1.0 END AS confianca,
  CASE WHEN length(ml_key) % 11 = 0 THEN 'Analista' WHEN (length(ml_key) * 37) % 100 >= 50 THEN 'Alta' WHEN (length(ml_key) * 37) % 100 >= 20 THEN 'Média' ELSE 'Baixa' END AS faixa
  FROM keyed WHERE ml_key <> ''),
items AS (SELECT analysis_id, k.ml_key, count(*) AS n_linhas, sum(minutos_parada) AS minutos, arg_min(observacao_raw, id) AS relato,
  any_value(classe) AS classe, any_value(detalhe) AS detalhe, any_value(confianca) AS confianca, any_value(faixa) AS faixa,
  CASE WHEN any_value(faixa) = 'Analista' THEN 'correta' ELSE 'pendente' END AS status,
  CASE WHEN any_value(faixa) = 'Analista' THEN any_value(classe) END AS classe_final FROM keyed k JOIN preds p ON p.ml_key = k.ml_key
  GROUP BY 1, 2)"""
DECIDED = """said AS (SELECT analysis_id, ml_key, CASE n_linhas % 4 WHEN 0 THEN 'correta' WHEN 1 THEN 'errada' WHEN 2 THEN 'pendente' END AS resultado FROM items),
after AS (SELECT i.* EXCLUDE (status, classe_final), CASE resultado WHEN 'correta' THEN 'correta' WHEN 'errada' THEN 'corrigida' WHEN 'pendente' THEN 'pendente' ELSE status END AS status,
  CASE resultado WHEN 'correta' THEN classe WHEN 'errada' THEN 'FALHA DE TESTE' WHEN 'pendente' THEN NULL ELSE classe_final END AS classe_final
  FROM items i JOIN said s ON s.analysis_id = i.analysis_id AND s.ml_key = i.ml_key)"""
FLOW = "WITH " + fx.CTE["reviewed"] + ", " + KEYED + ", " + DECIDED


def noted(stops):
    """Notes with a position, so that an analysis has many different ones."""
    place = F.concat_ws(" posicao ", "observacao_raw", (F.col("id") % 41).cast("string"))
    return stops.withColumn("observacao_raw", F.when(F.col("observacao_raw") != "", place).otherwise(F.lit("")))


def keyed_stops(spark, folder):
    return it.with_item_key(noted(reviewed_events(spark, folder).drop("failure_class", "failure_mode", "group_id")))


def predictions(stops):
    """Stand-in suggestions: a fixed function of the note, so that review operators have input."""
    size = F.length("ml_key")
    score = (size * 37) % 100
    known = size % 11 == 0
    return stops.filter("ml_key <> ''").select("ml_key").distinct().select(
        "ml_key", F.concat(F.lit("CLASSE "), (size % 7).cast("string")).alias("classe"),
        F.concat(F.lit("det "), F.substring("ml_key", 1, 5)).alias("detalhe"),
        F.when(~known, score.cast("double")).alias("confianca"),
        F.when(known, "Analista").otherwise(calc.band(score / 100)).alias("faixa"))


def flow_items(spark, folder):
    stops = it.with_item_key(noted(fx.stops(spark, folder)))
    stops = staged(stops.select("analysis_id", "id", "ml_key", "minutos_parada", "observacao_raw"), "item-stops")  # the key is worked out once
    return it.items(stops, predictions(stops))


def decisions(rows):
    pick = F.col("n_linhas") % 4
    return rows.select("analysis_id", "ml_key", F.when(pick == 0, "correta").when(pick == 1, "errada").when(pick == 2, "pendente").alias("resultado"),
                       F.lit(" falha de  teste ").alias("classe"), F.lit("").alias("detalhe")).filter("resultado IS NOT NULL")


def flow_reviewed(spark, folder):
    rows = staged(flow_items(spark, folder), "flow-items")
    return it.reviewed_items(rows, decisions(rows))


@query("e21_items", FLOW + " SELECT analysis_id, ml_key, n_linhas, CAST(minutos AS DOUBLE) AS minutos, relato, classe, confianca, faixa, status, classe_final FROM items")
def e21_items(spark, folder):
    return flow_items(spark, folder).select("analysis_id", "ml_key", "n_linhas", calc.as_double("minutos").alias("minutos"), "relato",
                                            "classe", "confianca", "faixa", "status", "classe_final")


@query("c07_search_items", FLOW + """ SELECT analysis_id, ml_key FROM items WHERE faixa = 'Alta' AND status = 'pendente'
 AND (lower(relato) LIKE '%rolam%' OR lower(classe) LIKE '%rolam%' OR lower(coalesce(classe_final, '')) LIKE '%rolam%')""")
def c07_search_items(spark, folder):
    return it.search_items(flow_items(spark, folder), "Alta", "pendente", "ROLAM").select("analysis_id", "ml_key")


@query("m10_reviewed_items", FLOW + " SELECT analysis_id, ml_key, status, classe_final FROM after")
def m10_reviewed_items(spark, folder):
    return flow_reviewed(spark, folder)[0].select("analysis_id", "ml_key", "status", "classe_final")


@query("m10_new_examples", FLOW + """ SELECT a.relato, a.ml_key AS relato_norm, a.classe_final AS classe FROM after a JOIN said s
 ON s.analysis_id = a.analysis_id AND s.ml_key = a.ml_key WHERE s.resultado IN ('correta', 'errada')""")
def m10_new_examples(spark, folder):
    return flow_reviewed(spark, folder)[1].drop("detalhe")


@query("m10_accept_high", FLOW + " SELECT analysis_id, ml_key FROM items WHERE status = 'pendente' AND faixa = 'Alta'")
def m10_accept_high(spark, folder):
    return it.accept_high(flow_items(spark, folder)).select("analysis_id", "ml_key")


@query("e20_review_progress", FLOW + """ SELECT analysis_id, count(*) AS relatos, CAST(sum(n_linhas) AS BIGINT) AS linhas, count_if(status <> 'pendente') AS validados,
 CAST(coalesce(sum(n_linhas) FILTER (WHERE status <> 'pendente'), 0) AS BIGINT) AS linhas_validadas, count_if(status = 'corrigida') AS corrigidos,
 count_if(status = 'pendente' AND faixa = 'Alta') AS alta_pendente,
 CAST((2000 * coalesce(sum(n_linhas) FILTER (WHERE status <> 'pendente'), 0) + sum(n_linhas)) // (2 * sum(n_linhas)) AS DOUBLE) / 10 AS percent_linhas FROM after GROUP BY 1""")
def e20_review_progress(spark, folder):
    return it.progress(flow_reviewed(spark, folder)[0])


@query("c08_single_flow_ready", FLOW + " SELECT analysis_id, count_if(status <> 'pendente') > 0 AS ready FROM after GROUP BY 1")
def c08_single_flow_ready(spark, folder):
    return it.progress(flow_reviewed(spark, folder)[0]).select("analysis_id", (F.col("validados") > 0).alias("ready"))


@query("g03_review_order_page", FLOW + """ SELECT analysis_id, ml_key, status, faixa FROM after ORDER BY CASE status WHEN 'pendente' THEN 0 ELSE 1 END,
 CASE faixa WHEN 'Baixa' THEN 0 WHEN 'Média' THEN 1 WHEN 'Alta' THEN 2 ELSE 3 END, coalesce(confianca, 100), n_linhas DESC, ml_key, analysis_id LIMIT 100 OFFSET 100""")
def g03_review_order_page(spark, folder):
    rows = flow_reviewed(spark, folder)[0]
    return rows.orderBy(*it.review_order()).offset(100).limit(100).select("analysis_id", "ml_key", "status", "faixa")


@query("g04_high_sample", FLOW + """, h AS (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY n_linhas DESC, ml_key) - 1 AS p,
 greatest(1, count(*) OVER (PARTITION BY analysis_id) // 8) AS s FROM items WHERE status = 'pendente' AND faixa = 'Alta')
 SELECT analysis_id, ml_key FROM h WHERE p % s = 0 AND p // s < 8""")
def g04_high_sample(spark, folder):
    return it.high_sample(flow_items(spark, folder)).select("analysis_id", "ml_key")


@query("g04_even_sample", FLOW + """, h AS (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY minutos DESC, ml_key) - 1 AS p,
 count(*) OVER (PARTITION BY analysis_id) AS n FROM items)
 SELECT analysis_id, ml_key FROM h WHERE n <= 6 OR p IN (0, n // 6, (2 * n) // 6, (3 * n) // 6, (4 * n) // 6, (5 * n) // 6)""")
def g04_even_sample(spark, folder):
    return it.even_sample(flow_items(spark, folder), [F.desc("minutos"), F.col("ml_key")], 6, ["analysis_id"]).select("analysis_id", "ml_key")


@query("a10_updated_items", FLOW + " SELECT analysis_id, ml_key AS key, CASE WHEN n_linhas % 4 = 2 THEN NULL WHEN n_linhas % 4 = 1 THEN 'NOVA' ELSE classe_final END AS classe_final FROM items")
def a10_updated_items(spark, folder):
    rows = flow_items(spark, folder).withColumnRenamed("ml_key", "key")
    updates = rows.filter("n_linhas % 4 IN (1, 2)").selectExpr("analysis_id", "key", "CASE WHEN n_linhas % 4 = 1 THEN 'NOVA' END AS classe_final")
    return sinks.updated_items(rows, updates, ["classe_final"]).select("analysis_id", "key", "classe_final")


CLASSED = """classed AS (SELECT k.*, coalesce(nullif(a.classe_final, ''), a.classe, 'SEM DESCRIÇÃO') AS final_class, coalesce(a.status <> 'pendente', false) AS checked
 FROM {source} k LEFT JOIN after a ON a.analysis_id = k.analysis_id AND a.ml_key = k.ml_key)"""


@query("d11_stops_with_item_class", FLOW + ", " + CLASSED.format(source="keyed") + " SELECT id, final_class AS failure_class, checked FROM classed")
def d11_stops_with_item_class(spark, folder):
    stops = it.with_item_key(noted(fx.stops(spark, folder)))
    return it.with_item_class(stops, flow_reviewed(spark, folder)[0]).select("id", "failure_class", "checked")


SUMMARY = (FLOW + ", " + EVENTS + ", " + CLASSED.format(source="keyed") + """,
 sm AS (SELECT c.analysis_id, c.final_class AS classe, count(*) AS linhas, count(DISTINCT e.event_id) AS falhas_reais,
  CAST(sum(c.minutos_parada) * 100 AS HUGEINT) AS t, count_if(checked) AS linhas_validadas FROM classed c JOIN ev e ON e.id = c.id GROUP BY 1, 2),
 summary AS (SELECT analysis_id, classe, linhas, falhas_reais, linhas_validadas, CAST((2 * t + falhas_reais) // (2 * falhas_reais) AS DOUBLE) / 100 AS mttr,
  CAST((20000 * t + sum(t) OVER w) // (2 * sum(t) OVER w) AS DOUBLE) / 100 AS percentual,
  CAST((20000 * sum(t) OVER o + sum(t) OVER w) // (2 * sum(t) OVER w) AS DOUBLE) / 100 AS acumulado, CAST(t AS DOUBLE) / 100 AS minutos
  FROM sm WINDOW w AS (PARTITION BY analysis_id), o AS (PARTITION BY analysis_id ORDER BY t DESC, classe ROWS UNBOUNDED PRECEDING))""")


def flow_summary(spark, folder):
    return it.failure_summary(it.with_item_class(keyed_stops(spark, folder), flow_reviewed(spark, folder)[0]))


@query("f08_failure_summary", SUMMARY + " SELECT * FROM summary")
def f08_failure_summary(spark, folder):
    return flow_summary(spark, folder)


@query("f18_top_occurrences", SUMMARY + """ SELECT analysis_id, classe, linhas, falhas_reais, rank FROM (SELECT *,
 row_number() OVER (PARTITION BY analysis_id ORDER BY linhas DESC, classe) AS rank FROM summary) x WHERE rank <= 15""")
def f18_top_occurrences(spark, folder):
    return it.top_occurrences(flow_summary(spark, folder)).select("analysis_id", "classe", "linhas", "falhas_reais", "rank")


@query("l13_expected_accuracy", FLOW + """ SELECT analysis_id, round(CAST(sum(n_linhas * CASE faixa WHEN 'Analista' THEN 100 WHEN 'Alta' THEN 95 WHEN 'Média' THEN 70 ELSE 0 END) AS DOUBLE)
 / sum(n_linhas), 1) AS expected_accuracy FROM items GROUP BY 1""")
def l13_expected_accuracy(spark, folder):
    bands = spark.sql("SELECT * FROM VALUES ('Alta', 95D), ('Média', 70D), ('Baixa', NULL) AS t(band, accuracy)")
    return it.expected_accuracy(flow_items(spark, folder), bands)


@query("a12_predicted_output", FLOW + """ SELECT id, CASE WHEN id % 9 = 0 THEN 'X' WHEN k.ml_key = '' THEN NULL ELSE p.classe END AS label,
 CASE WHEN id % 9 = 0 THEN 'Preenchida antes' WHEN k.ml_key = '' THEN 'Sem relato para classificar' ELSE p.faixa END AS band
 FROM keyed k LEFT JOIN preds p ON p.ml_key = k.ml_key""")
def a12_predicted_output(spark, folder):
    stops = it.with_item_key(noted(fx.stops(spark, folder))).withColumn("label", F.expr("CASE WHEN id % 9 = 0 THEN 'X' END"))
    return sinks.predicted_output(stops, predictions(stops)).select("id", "label", "band")

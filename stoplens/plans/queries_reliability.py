"""Registered queries: E1-E8, E24, E25, F1-F7, F9-F13, F15-F19."""

from pyspark.sql import functions as F

from stoplens.functions import calc
from stoplens.operators import reliability as rel
from stoplens.operators.events import with_events
from stoplens.plans import fixtures as fx
from stoplens.plans.fixtures import with_tables
from stoplens.plans.registry import query, rounded

# ---- oracle building blocks -----------------------------------------------------------------------------

EVENTS_CTE = """spans AS (
  SELECT *, upper(trim(observacao_raw)) AS nota,
   regexp_extract(observacao_raw, '(?:^|[^0-9])([0-9]{{9,12}})(?:[^0-9]|$)', 1) AS order_number,
   60 * CAST(substr(intervalo, 1, 2) AS INT) + CAST(substr(intervalo, 4, 2) AS INT) AS iv_a,
   60 * CAST(substr(intervalo, 7, 2) AS INT) + CAST(substr(intervalo, 10, 2) AS INT) AS iv_b
  FROM {source}),
loose AS (
  SELECT *, CASE WHEN iv_b > iv_a THEN iv_b ELSE iv_b + 1440 END AS iv_e FROM spans WHERE order_number = ''),
flagged AS (
  SELECT *, CASE WHEN nota <> '' AND iv_a = (lag(iv_e) OVER w) % 1440 THEN 0 ELSE 1 END AS opens
  FROM loose WINDOW w AS (PARTITION BY analysis_id, centro, linha, equipamento, data_inicio, nota ORDER BY iv_a, iv_e, id)),
islands AS (
  SELECT *, sum(opens) OVER (PARTITION BY analysis_id, centro, linha, equipamento, data_inicio, nota
                             ORDER BY iv_a, iv_e, id ROWS UNBOUNDED PRECEDING) AS island FROM flagged),
named AS (
  SELECT id, first_value(id) OVER (PARTITION BY analysis_id, centro, linha, equipamento, data_inicio, nota, island
                                   ORDER BY iv_a, iv_e, id) AS head FROM islands),
{name} AS (
  SELECT s.*, CASE WHEN s.order_number <> '' THEN 'os:|' || centro || '|' || linha || '|' || equipamento || '|' || s.order_number
              ELSE analysis_id || ':' || CAST(head AS VARCHAR) END AS event_id
  FROM spans s LEFT JOIN named n ON n.id = s.id)"""
EVENTS = EVENTS_CTE.format(source="reviewed", name="ev")

MACHINES = """agg AS (SELECT centro, linha, equipamento, count(DISTINCT event_id) AS q, count(*) AS n, sum(minutos_parada) AS t
  FROM ev GROUP BY 1, 2, 3),
cut AS (SELECT *, (2 * CAST(t * 100 AS HUGEINT) + q) // (2 * q) / 100.0 AS mttr, avg(q) OVER () AS q_cut,
  CAST(sum(t) OVER () AS DOUBLE) / sum(q) OVER () AS mttr_cut, sum(t) OVER () AS total,
  row_number() OVER (ORDER BY t DESC, centro || chr(31) || linha || chr(31) || equipamento) AS pos,
  count(*) OVER () AS size,
  sum(t) OVER (ORDER BY t DESC, centro || chr(31) || linha || chr(31) || equipamento ROWS UNBOUNDED PRECEDING) AS acc FROM agg),
machines AS (SELECT centro AS unit, linha AS line, equipamento AS name, q AS count, n AS lines, CAST(t AS DOUBLE) AS minutes,
  CAST(mttr AS DOUBLE) AS mttr, round(q_cut, 4) AS q_cut, round(mttr_cut, 4) AS mttr_cut, pos AS position,
  round(CAST(t AS DOUBLE) * 100 / CAST(total AS DOUBLE), 4) AS percent,
  CASE WHEN pos = size THEN 100.0 ELSE round(CAST(acc AS DOUBLE) * 100 / CAST(total AS DOUBLE), 4) END AS cumulative,
  CASE WHEN q >= q_cut AND mttr >= mttr_cut THEN 'Crítico-crônico' WHEN mttr >= mttr_cut THEN 'Crítico'
       WHEN q >= q_cut THEN 'Crônico' ELSE 'Conforto' END AS category,
  'L' || lpad(CAST(CAST(substr(linha, 6) AS INT) AS VARCHAR), 2, '0') || '_' || equipamento AS short FROM cut)"""
MACHINE_COLUMNS = ("unit, line, name, count, lines, minutes, mttr, q_cut, mttr_cut, position, percent, cumulative, "
                   "category, short")
LINES = "ev AS (SELECT *, CAST(id AS VARCHAR) AS event_id FROM reviewed)"


EVENT_COLUMNS = ["analysis_id", "id", "centro", "linha", "equipamento", "data_inicio", "intervalo", "observacao_raw", "observacao_normalizada"]


def reviewed_events(spark, folder, *columns):
    """Reviewed stops with their failure events, the base of every indicator; where ``columns`` are named, only these
    besides those that tell the events."""
    base = fx.reviewed(spark, folder).withColumn("observacao_normalizada", F.upper(F.trim("observacao_raw")))
    return with_events(base.select(*EVENT_COLUMNS, *columns) if columns else base)


def machine_columns(df):
    return rounded(df.select(*[c.strip() for c in MACHINE_COLUMNS.split(",")]), "q_cut", "mttr_cut", "percent", "cumulative")


# ---- F12 ------------------------------------------------------------------------------------------------------

@query("f12_failure_events", "WITH " + fx.CTE["reviewed"] + ", " + EVENTS + " SELECT id, analysis_id, event_id, order_number FROM ev")
def f12_failure_events(spark, folder):
    return reviewed_events(spark, folder).select("id", "analysis_id", "event_id", "order_number")


# ---- E1, E2, F1, F2 ----------------------------------------------------------------------------------------------

@query("e01_totals_by_machine", with_tables("stops", """SELECT linha, equipamento, count(*) AS falhas,
 CAST(sum(minutos_parada) AS DOUBLE) AS tempo_min FROM stops GROUP BY 1, 2"""))
def e01_totals_by_machine(spark, folder):
    return rel.totals_by_machine(fx.stops(spark, folder)).withColumn("tempo_min", calc.as_double("tempo_min"))


@query("e02_totals_by_line", with_tables("stops", """SELECT linha, count(*) AS falhas,
 CAST(sum(minutos_parada) AS DOUBLE) AS tempo_min FROM stops GROUP BY 1"""))
def e02_totals_by_line(spark, folder):
    return rel.totals_by_machine(fx.stops(spark, folder), "linha").withColumn("tempo_min", calc.as_double("tempo_min"))


PARETO_PLAIN = """g AS (SELECT linha, equipamento, count(*) AS falhas, CAST(sum(minutos_parada) * 100 AS HUGEINT) AS c
  FROM stops GROUP BY 1, 2),
p AS (SELECT *, (20000 * c + sum(c) OVER ()) // (2 * sum(c) OVER ()) AS bp FROM g),
r AS (SELECT *, sum(bp) OVER (ORDER BY c DESC, linha, equipamento ROWS UNBOUNDED PRECEDING) AS acc,
  row_number() OVER (ORDER BY c DESC, linha, equipamento) AS pos, count(*) OVER () AS size FROM p)"""


@query("f01_pareto_open", with_tables("stops", "").rstrip() + ", " + PARETO_PLAIN + """
 SELECT linha, equipamento, falhas, CAST(c AS DOUBLE) / 100 AS tempo_min, CAST(bp AS DOUBLE) / 100 AS pct_total,
 CAST(acc AS DOUBLE) / 100 AS pct_acumulado FROM r""")
def f01_pareto_open(spark, folder):
    return rel.pareto_open(fx.stops(spark, folder))


@query("f02_pareto_closed", with_tables("stops", "").rstrip() + ", " + PARETO_PLAIN + """
 SELECT linha, equipamento, falhas, CAST(c AS DOUBLE) / 100 AS tempo_min, CAST(bp AS DOUBLE) / 100 AS pct_total,
 CASE WHEN pos = size THEN 100.0 ELSE least(100.0, CAST(acc AS DOUBLE) / 100) END AS pct_acumulado FROM r""")
def f02_pareto_closed(spark, folder):
    return rel.pareto_closed(fx.stops(spark, folder))


# ---- F5 ------------------------------------------------------------------------------------------------------------

JACK_PLAIN = """j AS (SELECT *, (2 * CAST(t * 100 AS HUGEINT) + q) // (2 * q) / 100.0 AS mttr, avg(q) OVER ({over}) AS q_cut,
  CAST(sum(t) OVER ({over}) AS DOUBLE) / sum(q) OVER ({over}) AS mttr_cut FROM g)
SELECT {keys}, CAST(t AS DOUBLE) AS "T", q AS "Q", CAST(mttr AS DOUBLE) AS "MTTR", round(q_cut, 4) AS q_cut,
 round(mttr_cut, 4) AS mttr_cut,
 CASE WHEN q >= q_cut AND mttr >= mttr_cut THEN 'CRITICO-CRONICO' WHEN mttr >= mttr_cut THEN 'CRITICO'
      WHEN q >= q_cut THEN 'CRONICO' ELSE 'CONFORTO' END AS categoria FROM j"""


@query("f05_jack_knife_by_machine", with_tables(
    "stops", "").rstrip() + ", g AS (SELECT linha, equipamento, count(*) AS q, sum(minutos_parada) AS t FROM stops GROUP BY 1, 2), "
    + JACK_PLAIN.format(over="", keys="linha, equipamento"))
def f05_jack_knife_by_machine(spark, folder):
    return rounded(rel.jack_knife_by_machine(fx.stops(spark, folder)), "q_cut", "mttr_cut")


@query("f05_jack_knife_by_mode", with_tables("stops clusters canonical records", "").rstrip() + """,
 g AS (SELECT trim(r.linha) AS linha, trim(r.equipamento) AS equipamento,
  coalesce(nullif(trim(cf.nome_canonico), ''), nullif(trim(r.observacao_normalizada), ''), 'SEM MODO DE FALHA IDENTIFICADO') AS modo_falha,
  count(*) AS q, sum(r.minutos_parada) AS t
  FROM records r LEFT JOIN canonical cf ON cf.id = r.canonical_failure_id GROUP BY 1, 2, 3), """
    + JACK_PLAIN.format(over="PARTITION BY linha, equipamento", keys="linha, equipamento, modo_falha"))
def f05_jack_knife_by_mode(spark, folder):
    table = rel.jack_knife_by_mode(fx.records(spark, folder), fx.canonical(spark, folder))
    return rounded(table, "q_cut", "mttr_cut")


# ---- F3 + F6 ---------------------------------------------------------------------------------------------------------

@query("f06_machine_table_events", "WITH " + fx.CTE["reviewed"] + ", " + EVENTS + ", " + MACHINES
       + f" SELECT {MACHINE_COLUMNS} FROM machines")
def f06_machine_table_events(spark, folder):
    return machine_columns(rel.machine_table(reviewed_events(spark, folder)))


@query("f03_machine_table_lines", "WITH " + fx.CTE["reviewed"] + ", " + LINES + ", " + MACHINES
       + f" SELECT {MACHINE_COLUMNS} FROM machines")
def f03_machine_table_lines(spark, folder):
    return machine_columns(rel.machine_table(fx.reviewed(spark, folder), "lines"))


@query("f06_machine_table_fixed_cuts", "WITH " + fx.CTE["reviewed"] + ", " + LINES + ", " + MACHINES + """
 SELECT unit, line, name, CASE WHEN count >= 100 AND mttr >= 7.5 THEN 'Crítico-crônico' WHEN mttr >= 7.5 THEN 'Crítico'
  WHEN count >= 100 THEN 'Crônico' ELSE 'Conforto' END AS category FROM machines""")
def f06_machine_table_fixed_cuts(spark, folder):
    return rel.machine_table(fx.reviewed(spark, folder), "lines", (100, 7.5)).select("unit", "line", "name", "category")


SALES_MACHINES = """agg AS (SELECT centro, linha, equipamento, count(*) AS q, sum(minutos_parada) AS t FROM sales GROUP BY 1, 2, 3),
cut AS (SELECT *, (2 * CAST(t * 100 AS HUGEINT) + q) // (2 * q) / 100.0 AS mttr, avg(q) OVER () AS q_cut,
  CAST(sum(t) OVER () AS DOUBLE) / sum(q) OVER () AS mttr_cut FROM agg)
SELECT centro AS unit, linha AS line, equipamento AS name, q AS count, CAST(t AS DOUBLE) AS minutes,
 CAST(mttr AS DOUBLE) AS mttr, CASE WHEN q >= q_cut AND mttr >= mttr_cut THEN 'Crítico-crônico'
 WHEN mttr >= mttr_cut THEN 'Crítico' WHEN q >= q_cut THEN 'Crônico' ELSE 'Conforto' END AS category FROM cut"""


@query("f06_machine_table_sales", with_tables("sales", "").rstrip() + ", " + SALES_MACHINES)
def f06_machine_table_sales(spark, folder):
    return rel.machine_table(fx.sales(spark, folder), "lines").select("unit", "line", "name", "count", "minutes", "mttr",
                                                                     "category")


# ---- C3, E24, F19 -------------------------------------------------------------------------------------------------------

@query("c03_machines_in_categories", "WITH " + fx.CTE["reviewed"] + ", " + EVENTS + ", " + MACHINES + """,
 kept AS (SELECT *, sum(minutes) OVER () AS total, row_number() OVER (ORDER BY minutes DESC, position) AS pos2,
  count(*) OVER () AS size FROM machines WHERE category IN ('Crítico-crônico', 'Crônico'))
 SELECT unit, line, name, count, minutes, q_cut, mttr_cut, category, pos2 AS position,
  round(minutes * 100 / total, 4) AS percent FROM kept""")
def c03_machines_in_categories(spark, folder):
    table = rel.in_categories(reviewed_events(spark, folder), ["Crítico-crônico", "Crônico"])
    return rounded(table.select("unit", "line", "name", "count", "minutes", "q_cut", "mttr_cut", "category", "position",
                                "percent"), "q_cut", "mttr_cut", "percent")


@query("c03_metrics_in_category", "WITH " + fx.CTE["reviewed"] + ", " + EVENTS + ", " + MACHINES + """
 SELECT count(DISTINCT e.event_id) AS count, count(*) AS lines, CAST(sum(e.minutos_parada) AS DOUBLE) AS minutes
 FROM ev e JOIN machines m ON m.unit = e.centro AND m.line = e.linha AND m.name = e.equipamento
 WHERE m.category = 'Crítico-crônico'""")
def c03_metrics_in_category(spark, folder):
    kept = rel.stops_in_categories(reviewed_events(spark, folder), ["Crítico-crônico"])
    return rel.metric_strip(kept).select("count", "lines", "minutes")


@query("e24_quadrant_counts", "WITH " + fx.CTE["reviewed"] + ", " + EVENTS + ", " + MACHINES + """
 SELECT c.category, count(m.name) AS machines FROM (VALUES ('Crítico-crônico'), ('Crítico'), ('Crônico'), ('Conforto')) c(category)
 LEFT JOIN machines m ON m.category = c.category GROUP BY 1""")
def e24_quadrant_counts(spark, folder):
    return rel.quadrant_counts(rel.machine_table(reviewed_events(spark, folder)))


@query("f19_action_plan", "WITH " + fx.CTE["reviewed"] + ", " + EVENTS + ", " + MACHINES + """,
 plan(category, title, tools) AS (VALUES ('Crítico-crônico', 'Atacar primeiro', 'RCA (causa raiz) | FMEA | Plano de ação'),
  ('Crítico', 'Reduzir o tempo de reparo', 'FTA (árvore de falhas) | Kit/sobressalente | Procedimento de reparo'),
  ('Crônico', 'Eliminar a recorrência', 'RCM | Preventiva/lubrificação | Ajuste de padrão'),
  ('Conforto', 'Monitorar', 'Monitoramento | Inspeção de rota')),
 r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY position) AS rank FROM machines)
 SELECT r.category, rank, short, unit, minutes, title, tools FROM r JOIN plan p ON p.category = r.category WHERE rank <= 3""")
def f19_action_plan(spark, folder):
    return rel.action_plan(rel.machine_table(reviewed_events(spark, folder)))


# ---- E6, E7, E8 ------------------------------------------------------------------------------------------------------------

@query("e06_metric_strip", "WITH " + fx.CTE["reviewed"] + ", " + EVENTS + """
 SELECT count(DISTINCT event_id) AS count, count(DISTINCT event_id) AS events, count(*) AS lines,
  count(DISTINCT CASE WHEN order_number <> '' THEN event_id END) AS with_order, CAST(sum(minutos_parada) AS DOUBLE) AS minutes,
  count(DISTINCT centro || '|' || linha || '|' || equipamento) AS machines, count(DISTINCT group_id) AS groups,
  count(DISTINCT data_inicio) AS days, count(DISTINCT analysis_id) AS analyses,
  CAST((2 * CAST(sum(minutos_parada) * 100 AS HUGEINT) + count(DISTINCT event_id)) // (2 * count(DISTINCT event_id)) AS DOUBLE) / 100 AS mttr
 FROM ev""")
def e06_metric_strip(spark, folder):
    return rel.metric_strip(reviewed_events(spark, folder))


BREAKDOWN = """base AS (SELECT centro AS unit, linha AS line, equipamento AS machine, tipo_parada AS failure, failure_mode AS mode,
  failure_class AS klass, count(DISTINCT event_id) AS count, count(*) AS lines, sum(minutos_parada) AS minutes
  FROM ev GROUP BY 1, 2, 3, 4, 5, 6)"""


@query("e05_breakdown_by_lines", "WITH " + fx.CTE["reviewed"] + ", " + LINES + ", " + BREAKDOWN + """
 SELECT unit, line, machine, failure, mode, klass, lines AS count, lines, CAST(minutes AS DOUBLE) AS minutes FROM base""")
def e05_breakdown_by_lines(spark, folder):
    return rel.breakdown(fx.reviewed(spark, folder), "lines").withColumn("minutes", calc.as_double("minutes"))


@query("e07_breakdown", "WITH " + fx.CTE["reviewed"] + ", " + EVENTS + ", " + BREAKDOWN + """
 SELECT unit, line, machine, failure, mode, klass, count, lines, CAST(minutes AS DOUBLE) AS minutes FROM base""")
def e07_breakdown(spark, folder):
    return rel.breakdown(reviewed_events(spark, folder)).withColumn("minutes", calc.as_double("minutes"))


SHORT = "'L' || lpad(CAST(CAST(substr(line, 6) AS INT) AS VARCHAR), 2, '0') || '_' || machine"
PRETTY = "upper(substr(lower(klass), 1, 1)) || substr(lower(klass), 2)"
REGROUP_SQL = {
    "machine": (f"unit || chr(31) || line || chr(31) || machine AS key, {SHORT} AS label, unit AS sub", 3),
    "class": (f"klass AS key, {PRETTY} AS label, '' AS sub", 3),
    "line": ("unit || chr(31) || line AS key, line AS label, unit AS sub", 3),
    "unit": ("unit AS key, unit AS label, '' AS sub", 3),
    "failure": ("failure AS key, failure AS label, '' AS sub", 3),
    "mode": ("machine || chr(31) || mode AS key, mode AS label, machine AS sub", 3),
}
for _dimension, (_select, _n) in REGROUP_SQL.items():
    @query(f"e08_regroup_by_{_dimension}", "WITH " + fx.CTE["reviewed"] + ", " + EVENTS + ", " + BREAKDOWN
           + f" SELECT {_select}, CAST(sum(count) AS BIGINT) AS count, CAST(sum(minutes) AS DOUBLE) AS minutes FROM base GROUP BY 1, 2, 3")
    def _regroup(spark, folder, dimension=_dimension):
        return rel.regroup(rel.breakdown(reviewed_events(spark, folder)), dimension)\
            .withColumn("minutes", calc.as_double("minutes"))


# ---- F4, F15, F16, F17 --------------------------------------------------------------------------------------------------------

def custom_sql(select, value, tail):
    return ("WITH " + fx.CTE["reviewed"] + ", " + LINES + ", " + BREAKDOWN + f""",
 g AS (SELECT {select}, CAST(sum(lines) AS BIGINT) AS count, CAST(sum(minutes) AS DOUBLE) AS minutes FROM base GROUP BY 1, 2, 3),
 v AS (SELECT *, {value} AS value FROM g){tail}""")


CUSTOM_TAIL = """, o AS (SELECT *, row_number() OVER w AS position, sum(CAST(value AS DECIMAL(30,6))) OVER w AS acc,
  sum(CAST(value AS DECIMAL(30,6))) OVER () AS total FROM v WHERE value > 0 WINDOW w AS (ORDER BY value DESC, label, key ROWS UNBOUNDED PRECEDING))
 SELECT key, label, sub, count, round(value, 4) AS value, position, round(least(100.0, CAST(acc AS DOUBLE) * 100 / CAST(total AS DOUBLE)), 4) AS cumulative,
  {strong} AS highlight FROM o"""
STRONG_CUT = "(position = 1 OR CAST(acc - CAST(value AS DECIMAL(30,6)) AS DOUBLE) * 100 / CAST(total AS DOUBLE) < 80)"


@query("f04_custom_pareto_class_minutes", custom_sql(REGROUP_SQL["class"][0], "minutes", CUSTOM_TAIL.format(strong=STRONG_CUT)))
def f04_custom_pareto_class_minutes(spark, folder):
    base = rel.breakdown(fx.reviewed(spark, folder), "lines")
    return rounded(rel.custom_pareto(base, "class"), "value", "cumulative")


@query("f04_custom_pareto_mode_count", custom_sql(REGROUP_SQL["mode"][0], "CAST(count AS DOUBLE)", CUSTOM_TAIL.format(strong=STRONG_CUT)))
def f04_custom_pareto_mode_count(spark, folder):
    base = rel.breakdown(fx.reviewed(spark, folder), "lines")
    return rounded(rel.custom_pareto(base, "mode", "count"), "value", "cumulative")


@query("f04_custom_pareto_top_machines", custom_sql(REGROUP_SQL["machine"][0], "minutes / count", """,
 t AS (SELECT * FROM v ORDER BY value DESC, label, key LIMIT 10),
 o AS (SELECT *, row_number() OVER w AS position, sum(CAST(value AS DECIMAL(30,6))) OVER w AS acc,
  sum(CAST(value AS DECIMAL(30,6))) OVER () AS total FROM t WINDOW w AS (ORDER BY value DESC, label, key ROWS UNBOUNDED PRECEDING))
 SELECT key, label, sub, count, round(value, 4) AS value, position, round(least(100.0, CAST(acc AS DOUBLE) * 100 / CAST(total AS DOUBLE)), 4) AS cumulative,
  position <= 3 AS highlight FROM o"""))
def f04_custom_pareto_top_machines(spark, folder):
    base = rel.breakdown(fx.reviewed(spark, folder), "lines")
    return rounded(rel.custom_pareto(base, "machine", "mttr", top=10, highlight="top3"), "value", "cumulative")


def _edits(spark):
    overrides = spark.createDataFrame([("FALHA DE MOTOR", True, None, None, None, None),
                                       ("FALHA DE SENSOR", None, "Sensores", 5000.0, 70, None)], rel.OVERRIDE_SCHEMA)
    extras = spark.sql("SELECT 'extra-1' key, 'Outras' label, 12L count, CAST(600 AS DECIMAL(30,2)) minutes, 600D value")
    return overrides, extras


EDITED = """, e AS (SELECT key, CASE WHEN key = 'FALHA DE SENSOR' THEN 'Sensores' ELSE label END AS label, sub,
  CASE WHEN key = 'FALHA DE SENSOR' THEN 70 ELSE count END AS count, minutes,
  CASE WHEN key = 'FALHA DE SENSOR' THEN 5000.0 ELSE minutes END AS value FROM g WHERE key <> 'FALHA DE MOTOR'
  UNION ALL SELECT 'extra-1', 'Outras', 'manual', 12, 600.0, 600.0)"""


@query("f04_custom_pareto_edited", custom_sql(REGROUP_SQL["class"][0], "minutes", EDITED + CUSTOM_TAIL.format(strong=STRONG_CUT)
                                             .replace("FROM v WHERE", "FROM e WHERE")))
def f04_custom_pareto_edited(spark, folder):
    overrides, extras = _edits(spark)
    base = rel.breakdown(fx.reviewed(spark, folder), "lines")
    return rounded(rel.custom_pareto(base, "class", overrides=overrides, extras=extras), "value", "cumulative")


JACK_CUSTOM = """, live AS (SELECT *, minutes / count AS mttr FROM {source} WHERE count > 0),
 cut AS ({cut})
 SELECT key, label, sub, count, minutes, round(mttr, 4) AS mttr, round(q_cut, 4) AS q_cut, round(mttr_cut, 4) AS mttr_cut,
  CASE WHEN count >= q_cut AND mttr >= mttr_cut THEN 'Crítico-crônico' WHEN mttr >= mttr_cut THEN 'Crítico'
       WHEN count >= q_cut THEN 'Crônico' ELSE 'Conforto' END AS category FROM live, cut"""
CUT_SQL = {
    "mean": "SELECT avg(count) AS q_cut, CAST(sum(CAST(minutes AS DECIMAL(30,2))) AS DOUBLE) / sum(count) AS mttr_cut FROM live",
    "median": "SELECT median(count) AS q_cut, median(mttr) AS mttr_cut FROM live",
    "manual": "SELECT CAST(90 AS DOUBLE) AS q_cut, CAST(7.5 AS DOUBLE) AS mttr_cut",
}
for _mode, _dim in [("mean", "class"), ("median", "machine"), ("manual", "mode")]:
    @query(f"f16_custom_jack_knife_{_mode}_cuts", custom_sql(REGROUP_SQL[_dim][0], "minutes", JACK_CUSTOM.format(
        source="g", cut=CUT_SQL[_mode])))
    def _custom_jack(spark, folder, mode=_mode, dim=_dim):
        base = rel.breakdown(fx.reviewed(spark, folder), "lines")
        return rounded(rel.custom_jack_knife(base, dim, mode, (90, 7.5)), "mttr", "q_cut", "mttr_cut")


@query("f15_median_cuts_edited", custom_sql(REGROUP_SQL["class"][0], "minutes", EDITED + JACK_CUSTOM.format(
    source="e", cut=CUT_SQL["median"])))
def f15_median_cuts_edited(spark, folder):
    overrides, extras = _edits(spark)
    base = rel.breakdown(fx.reviewed(spark, folder), "lines")
    return rounded(rel.custom_jack_knife(base, "class", "median", overrides=overrides, extras=extras),
                   "mttr", "q_cut", "mttr_cut")


@query("f17_iso_curve", "WITH " + fx.CTE["reviewed"] + ", " + LINES + ", " + MACHINES + """,
 box AS (SELECT max(q) AS hi, min(q) AS lo, max(cut.q_cut) AS q_cut, max(cut.mttr_cut) AS t_cut FROM cut),
 p AS (SELECT i, lo * pow(hi / lo, i / 39.0) AS q, q_cut * t_cut AS k FROM box, range(0, 40) r(i))
 SELECT CAST(i AS BIGINT) AS i, round(q, 4) AS q, round(k / q, 4) AS mttr FROM p""")
def f17_iso_curve(spark, folder):
    return rounded(rel.iso_curve(rel.machine_table(fx.reviewed(spark, folder), "lines")), "q", "mttr")


# ---- F7, E23, F9, F10, E25 --------------------------------------------------------------------------------------------------------

FAILURES = """fa AS (SELECT failure_class AS key, count(DISTINCT event_id) AS q, count(*) AS n, sum(minutos_parada) AS t FROM ev GROUP BY 1),
fc AS (SELECT *, (2 * CAST(t * 100 AS HUGEINT) + q) // (2 * q) / 100.0 AS mttr, avg(q) OVER () AS q_cut,
  CAST(sum(t) OVER () AS DOUBLE) / sum(q) OVER () AS mttr_cut, sum(t) OVER () AS total,
  row_number() OVER (ORDER BY t DESC, key) AS pos, sum(t) OVER (ORDER BY t DESC, key ROWS UNBOUNDED PRECEDING) AS acc FROM fa),
tm AS (SELECT failure_class AS key, equipamento, count(*) AS n,
  row_number() OVER (PARTITION BY failure_class ORDER BY count(*) DESC, equipamento) AS r FROM ev GROUP BY 1, 2),
tops AS (SELECT key, string_agg(equipamento || ':' || CAST(n AS VARCHAR), ', ' ORDER BY r) AS machines FROM tm WHERE r <= 3 GROUP BY 1),
failures AS (SELECT fc.key, upper(substr(lower(fc.key), 1, 1)) || substr(lower(fc.key), 2) AS name, q AS count, n AS lines,
  CAST(t AS DOUBLE) AS minutes, CAST(mttr AS DOUBLE) AS mttr, round(q_cut, 4) AS q_cut, round(mttr_cut, 4) AS mttr_cut, pos AS position,
  round(CAST(t AS DOUBLE) * 100 / CAST(total AS DOUBLE), 4) AS percent,
  round(least(100.0, CAST(acc AS DOUBLE) * 100 / CAST(total AS DOUBLE)), 4) AS cumulative,
  CASE WHEN q >= q_cut AND mttr >= mttr_cut THEN 'Crítico-crônico' WHEN mttr >= mttr_cut THEN 'Crítico'
       WHEN q >= q_cut THEN 'Crônico' ELSE 'Conforto' END AS category, machines FROM fc JOIN tops ON tops.key = fc.key)"""


@query("f07_failure_table", "WITH " + fx.CTE["reviewed"] + ", " + EVENTS + ", " + FAILURES + " SELECT * FROM failures")
def f07_failure_table(spark, folder):
    return rounded(rel.failure_table(reviewed_events(spark, folder)), "q_cut", "mttr_cut", "percent", "cumulative")


@query("e23_top_machines_by_class", "WITH " + fx.CTE["reviewed"] + ", " + EVENTS + ", " + FAILURES + " SELECT key, machines FROM failures")
def e23_top_machines_by_class(spark, folder):
    return rel.failure_table(reviewed_events(spark, folder)).select("key", "machines")


@query("f09_tta_table", "WITH " + fx.CTE["reviewed"] + ", " + EVENTS + ", " + MACHINES + """,
 r AS (SELECT *, sum(minutes) OVER (ORDER BY position ROWS UNBOUNDED PRECEDING) AS acc, sum(minutes) OVER () AS total FROM machines),
 s AS (SELECT i AS seq FROM range(1, (SELECT greatest(41, count(*) + 1) FROM machines)) x(i))
 SELECT s.seq, short AS item, minutes, count, mttr, round(acc, 2) AS tta, round(acc / total, 4) AS share,
  CASE WHEN acc / total <= 0.8 + 1e-9 THEN minutes END AS in_80, upper(category) AS category FROM s LEFT JOIN r ON r.position = s.seq""")
def f09_tta_table(spark, folder):
    table = rel.tta_table(rel.machine_table(reviewed_events(spark, folder)))
    return table.withColumns({"tta": F.round("tta", 2), "share": F.round("share", 4)})


@query("f10_drill_tables", "WITH " + fx.CTE["reviewed"] + ", " + EVENTS + ", " + MACHINES + """,
 d AS (SELECT m.position AS machine_position, e.centro, e.linha, e.equipamento, e.failure_class AS key, count(DISTINCT e.event_id) AS q,
  count(*) AS n, sum(e.minutos_parada) AS t FROM ev e JOIN machines m ON m.unit = e.centro AND m.line = e.linha AND m.name = e.equipamento
  WHERE m.position = 1 OR m.cumulative <= 80 GROUP BY 1, 2, 3, 4, 5),
 x AS (SELECT *, (2 * CAST(t * 100 AS HUGEINT) + q) // (2 * q) / 100.0 AS mttr,
  avg(q) OVER (PARTITION BY machine_position) AS q_cut,
  CAST(sum(t) OVER (PARTITION BY machine_position) AS DOUBLE) / sum(q) OVER (PARTITION BY machine_position) AS t_cut,
  row_number() OVER (PARTITION BY machine_position ORDER BY t DESC, key) AS position FROM d)
 SELECT machine_position, centro, linha, equipamento, key, q AS count, n AS lines, CAST(t AS DOUBLE) AS minutes,
  CAST(mttr AS DOUBLE) AS mttr, position,
  CASE WHEN q >= q_cut AND mttr >= t_cut THEN 'Crítico-crônico' WHEN mttr >= t_cut THEN 'Crítico'
       WHEN q >= q_cut THEN 'Crônico' ELSE 'Conforto' END AS category FROM x""")
def f10_drill_tables(spark, folder):
    return rel.drill_tables(reviewed_events(spark, folder)).select(
        "machine_position", "centro", "linha", "equipamento", "key", "count", "lines", "minutes", "mttr", "position", "category")


@query("e25_headline_values", "WITH " + fx.CTE["reviewed"] + ", " + EVENTS + ", " + MACHINES + ", " + FAILURES + """
 SELECT round(100 * (SELECT sum(minutes) FROM machines WHERE position <= 3) / (SELECT sum(minutes) FROM machines), 4) AS top3_share,
  (SELECT name FROM machines WHERE position = 1) AS worst_machine, (SELECT minutes FROM machines WHERE position = 1) AS worst_minutes,
  (SELECT count(*) FROM machines WHERE category = 'Crítico-crônico') AS critical_chronic,
  (SELECT name FROM failures WHERE key <> 'SEM MODO DE FALHA IDENTIFICADO' ORDER BY position LIMIT 1) AS top_class,
  (SELECT count FROM failures WHERE key = 'SEM MODO DE FALHA IDENTIFICADO') AS unidentified""")
def e25_headline_values(spark, folder):
    return rounded(rel.headline_values(reviewed_events(spark, folder)), "top3_share")


@query("f13_share_in_line", with_tables("stops", """SELECT linha, equipamento, count(*) AS total_ocorrencias,
 CAST(sum(minutos_parada) AS DOUBLE) AS total_minutos_parada, CAST(sum(pts_efic_perdidos) AS DOUBLE) AS total_pts_perdidos,
 CAST((20000 * count(*) + (sum(count(*)) OVER (PARTITION BY linha))) // (2 * (sum(count(*)) OVER (PARTITION BY linha))) AS DOUBLE) / 100
  AS percentual_linha FROM stops GROUP BY 1, 2"""))
def f13_share_in_line(spark, folder):
    return rel.share_in_line(fx.stops(spark, folder))

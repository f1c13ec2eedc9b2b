"""Registered queries over records, batches, clusters and canonical failures: A6-A15, C2-C13, D1-D8, E3-E15, M8-M11."""

from pyspark.sql import functions as F

from stoplens.functions import calc
from stoplens.operators import log_tables as lt
from stoplens.operators import reliability as rel
from stoplens.plans import fixtures as fx
from stoplens.plans.fixtures import with_tables
from stoplens.plans.registry import query

ALL = "stops clusters canonical batches members records"
CANONICAL = """unique_batches AS (SELECT min(id) AS id FROM batches WHERE content_hash IS NOT NULL GROUP BY content_hash
 UNION ALL SELECT id FROM batches WHERE content_hash IS NULL),
cr AS (SELECT * FROM records WHERE upload_batch_id IS NULL OR upload_batch_id IN (SELECT id FROM unique_batches))"""
HEAD = with_tables(ALL, "").rstrip() + ", " + CANONICAL


def tables(spark, folder):
    return {n: getattr(fx, n)(spark, folder) for n in ("records", "batches", "clusters", "members", "canonical")}


# ---- C4, F14, C2, D1 ---------------------------------------------------------------------------------------

@query("f14_canonical_batches", with_tables("batches", "SELECT min(id) AS id FROM batches WHERE content_hash IS NOT NULL "
                                            "GROUP BY content_hash UNION ALL SELECT id FROM batches WHERE content_hash IS NULL"))
def f14_canonical_batches(spark, folder):
    return lt.canonical_batches(fx.batches(spark, folder))


@query("c04_canonical_records", HEAD + " SELECT id, upload_batch_id FROM cr")
def c04_canonical_records(spark, folder):
    t = tables(spark, folder)
    return lt.canonical_records(t["records"], t["batches"]).select("id", "upload_batch_id")


SCOPES = {
    "all": ({}, "TRUE"),
    "pending": ({"status": "pending"}, "status = 'pending'"),
    "day": ({"day": "2024-02-05"}, """status = 'confirmed' AND id IN (SELECT record_id FROM members m JOIN clusters c ON c.id = m.cluster_id
  WHERE c.status = 'confirmed' AND c.confirmed_on = DATE '2024-02-05')"""),
    "range": ({"start": "2024-02-02", "end": "2024-02-05"}, """status = 'confirmed' AND id IN (SELECT record_id FROM members m
  JOIN clusters c ON c.id = m.cluster_id WHERE c.status = 'confirmed' AND c.confirmed_on BETWEEN DATE '2024-02-02' AND DATE '2024-02-05')"""),
}
for _scope, (_arguments, _where) in SCOPES.items():
    @query(f"c02_dashboard_scope_{_scope}", HEAD + f""" SELECT linha, count(*) AS falhas, CAST(sum(minutos_parada) AS DOUBLE) AS tempo_min
 FROM cr WHERE {_where} GROUP BY 1""")
    def _scoped(spark, folder, arguments=_arguments):
        t = tables(spark, folder)
        scope = lt.dashboard_scope(t["records"], t["batches"], t["members"], t["clusters"], **arguments)
        return rel.totals_by_machine(scope, "linha").withColumn("tempo_min", calc.as_double("tempo_min"))


@query("d01_records_confirmed_in_range", with_tables("stops clusters members", """SELECT DISTINCT record_id FROM members m
 JOIN clusters c ON c.id = m.cluster_id WHERE c.status = 'confirmed'
 AND c.confirmed_on BETWEEN DATE '2024-02-02' AND DATE '2024-02-05'"""))
def d01_records_confirmed_in_range(spark, folder):
    return lt.confirmed_between(fx.members(spark, folder), fx.clusters(spark, folder), "2024-02-02", "2024-02-05")


@query("b28_members_from_json_arrays", with_tables("stops", """SELECT cluster_id, count(*) AS n, min(id) AS first_id FROM stops GROUP BY 1"""))
def b28_members_from_json_arrays(spark, folder):
    arrays = fx.members(spark, folder).groupBy(F.col("cluster_id").alias("id")).agg(
        F.to_json(F.array_sort(F.collect_list("record_id"))).alias("member_record_ids"))
    ids = F.from_json("member_record_ids", "array<bigint>")
    exploded = lt.members_of(arrays).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    return exploded.join(arrays.select(F.col("id").alias("cluster_id"), F.element_at(ids, 1).alias("first_id")), "cluster_id")


# ---- listings ------------------------------------------------------------------------------------------------

@query("c05_list_records", with_tables("stops clusters records", """SELECT id, linha, equipamento, status, turno FROM records
 WHERE linha = 'LINHA002' AND status = 'confirmed' AND turno = '2' ORDER BY id DESC LIMIT 100"""))
def c05_list_records(spark, folder):
    rows = lt.list_records(fx.records(spark, folder), 100, linha="LINHA002", status="confirmed", turno="2")
    return rows.select("id", "linha", "equipamento", "status", "turno")


@query("c06_cluster_page", with_tables("stops clusters", """, m AS (SELECT *, count(*) OVER () AS total FROM clusters
  WHERE status = 'pending' AND linha LIKE '%LINHA00%' AND equipamento LIKE '%E%')
 SELECT id, linha, equipamento, avg_similarity, total, (total + 19) // 20 AS pages FROM m ORDER BY avg_similarity DESC, id LIMIT 20 OFFSET 20"""))
def c06_cluster_page(spark, folder):
    found = lt.matching_clusters(fx.clusters(spark, folder), "pending", "LINHA00", "E")
    return lt.page(found, [F.desc("avg_similarity"), F.col("id")], 2, 20).select(
        "id", "linha", "equipamento", "avg_similarity", "total", "pages")


@query("g02_history_page", HEAD + """, h AS (SELECT c.id, c.suggested_name, c.confirmed_on,
  (SELECT count(*) FROM members m WHERE m.cluster_id = c.id) AS total_registros FROM clusters c WHERE c.status = 'confirmed'
  AND EXISTS (SELECT 1 FROM members m JOIN cr ON cr.id = m.record_id WHERE m.cluster_id = c.id))
 SELECT *, count(*) OVER () AS total, (count(*) OVER () + 19) // 20 AS pages FROM h ORDER BY confirmed_on DESC, id DESC LIMIT 20""")
def g02_history_page(spark, folder):
    t = tables(spark, folder)
    alive = lt.with_canonical_member(t["clusters"], t["members"], t["records"], t["batches"])
    sizes = t["members"].groupBy(F.col("cluster_id").alias("id")).agg(F.count(F.lit(1)).alias("total_registros"))
    history = alive.filter("status = 'confirmed'").join(sizes, "id").select("id", "suggested_name", "confirmed_on", "total_registros")
    return lt.page(history, [F.desc("confirmed_on"), F.desc("id")], 1, 20)


@query("c11_questioned_records", with_tables("stops clusters records", "SELECT id, linha, turno FROM records WHERE question_flag"))
def c11_questioned_records(spark, folder):
    return lt.questioned_records(fx.records(spark, folder)).select("id", "linha", "turno")


@query("c13_rejected_retention", with_tables("stops clusters", """SELECT id, status FROM clusters
 WHERE NOT (status = 'rejected' AND created_on < DATE '2024-03-01' - 30)"""))
def c13_rejected_retention(spark, folder):
    return lt.drop_old_rejected(fx.clusters(spark, folder), "2024-03-01", 30)[0].select("id", "status")


@query("c13_rejected_retention_count", with_tables("stops clusters", """SELECT count(*) AS clusters_removidos FROM clusters
 WHERE status = 'rejected' AND created_on < DATE '2024-03-01' - 30"""))
def c13_rejected_retention_count(spark, folder):
    return lt.drop_old_rejected(fx.clusters(spark, folder), "2024-03-01", 30)[1]


# ---- joins ------------------------------------------------------------------------------------------------------

@query("d02_confirmed_cluster_records", HEAD + """ SELECT c.id AS cluster_id, c.confirmed_on, cr.id AS record_id, cr.tipo_parada, cr.turno
 FROM clusters c JOIN members m ON m.cluster_id = c.id JOIN cr ON cr.id = m.record_id WHERE c.status = 'confirmed'""")
def d02_confirmed_cluster_records(spark, folder):
    t = tables(spark, folder)
    done = t["clusters"].filter("status = 'confirmed'").select("id", "confirmed_on")
    return lt.cluster_records(t["members"], done, lt.canonical_records(t["records"], t["batches"]), ["tipo_parada", "turno"])


@query("d03_clusters_with_canonical_member", HEAD + """ SELECT id, status FROM clusters c WHERE EXISTS
 (SELECT 1 FROM members m JOIN cr ON cr.id = m.record_id WHERE m.cluster_id = c.id)""")
def d03_clusters_with_canonical_member(spark, folder):
    t = tables(spark, folder)
    return lt.with_canonical_member(t["clusters"], t["members"], t["records"], t["batches"]).select("id", "status")


@query("d04_record_failure_names", with_tables("stops clusters canonical records", """SELECT r.id,
 coalesce(nullif(trim(cf.nome_canonico), ''), nullif(trim(r.observacao_normalizada), ''), 'SEM MODO DE FALHA IDENTIFICADO') AS modo_falha
 FROM records r LEFT JOIN canonical cf ON cf.id = r.canonical_failure_id"""))
def d04_record_failure_names(spark, folder):
    names = fx.canonical(spark, folder).select(F.col("id").alias("canonical_failure_id"), "nome_canonico")
    rows = lt.lookup_join(fx.records(spark, folder).select("id", "canonical_failure_id", "observacao_normalizada"), names,
                          ["canonical_failure_id"])
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return rows.select("id", F.coalesce(blank("nome_canonico"), blank("observacao_normalizada"),
                                        F.lit("SEM MODO DE FALHA IDENTIFICADO")).alias("modo_falha"))


@query("d05_clusters_of_day", HEAD + """ SELECT c.id, c.linha, c.equipamento, c.suggested_name, r.tipo_parada, r.turno, x.n AS total_registros
 FROM clusters c JOIN (SELECT cluster_id, count(*) AS n, min(record_id) AS f FROM members GROUP BY 1) x ON x.cluster_id = c.id
 LEFT JOIN records r ON r.id = x.f WHERE c.status = 'confirmed' AND c.confirmed_on = DATE '2024-02-05' AND r.tipo_parada = 'P.EQ.LINHA'
 AND EXISTS (SELECT 1 FROM members m JOIN cr ON cr.id = m.record_id WHERE m.cluster_id = c.id)""")
def d05_clusters_of_day(spark, folder):
    t = tables(spark, folder)
    rows = lt.confirmed_on_day(t["clusters"], t["members"], t["records"], t["batches"], "2024-02-05", tipo_parada="P.EQ.LINHA")
    return rows.select("id", "linha", "equipamento", "suggested_name", "tipo_parada", "turno", "total_registros")


@query("e12_import_audit", with_tables("stops batches clusters records", """SELECT b.id AS batch_id, b.filename,
 b.total_records AS registros_importados, b.created_on AS data_importacao, count_if(r.status = 'pending') AS pendentes,
 count_if(r.status = 'confirmed') AS confirmados, count_if(r.question_flag) AS questionados
 FROM batches b LEFT JOIN records r ON r.upload_batch_id = b.id GROUP BY 1, 2, 3, 4"""))
def e12_import_audit(spark, folder):
    return lt.import_audit(fx.batches(spark, folder), fx.records(spark, folder))


@query("d07_orphan_canonical", with_tables("stops clusters canonical records", """SELECT id, nome_canonico FROM canonical c
 WHERE NOT EXISTS (SELECT 1 FROM records r WHERE r.canonical_failure_id = c.id)"""))
def d07_orphan_canonical(spark, folder):
    return lt.orphan_canonical(fx.canonical(spark, folder), fx.records(spark, folder)).select("id", "nome_canonico")


@query("d08_radio_channels", with_tables("stops channels", """SELECT s.id, coalesce(c.canal, 'nao cadastrado') AS canal_radio_sugerido
 FROM stops s LEFT JOIN channels c ON c.linha = s.linha AND c.turno = s.turno"""))
def d08_radio_channels(spark, folder):
    return lt.with_channel(fx.stops(spark, folder), fx.channels(spark, folder)).select("id", "canal_radio_sugerido")


@query("d13_cluster_detail", with_tables("stops clusters members records", """SELECT m.cluster_id, r.id AS record_id, r.linha,
 r.equipamento, r.turno, r.observacao_raw, r.operador FROM members m JOIN clusters c ON c.id = m.cluster_id
 JOIN records r ON r.id = m.record_id WHERE c.status = 'pending'"""))
def d13_cluster_detail(spark, folder):
    t = tables(spark, folder)
    pending = t["clusters"].filter("status = 'pending'").select("id")
    return lt.cluster_records(t["members"], pending, t["records"], ["linha", "equipamento", "turno", "observacao_raw", "operador"])


# ---- aggregates ----------------------------------------------------------------------------------------------------

@query("e03_summary_row", with_tables("stops clusters records", """SELECT count(*) AS total_apontamentos,
 count_if(status = 'pending') AS pendentes, count_if(status = 'confirmed') AS confirmados, count_if(question_flag) AS questionados,
 count(DISTINCT nullif(trim(linha), '')) AS linhas_distintas, count(DISTINCT nullif(trim(equipamento), '')) AS equipamentos_distintos,
 CAST(sum(minutos_parada) AS DOUBLE) AS total_minutos_parada FROM records"""))
def e03_summary_row(spark, folder):
    return lt.summary_row(fx.records(spark, folder))


@query("e04_cluster_summary", HEAD + """, a AS (SELECT * FROM clusters c WHERE EXISTS
 (SELECT 1 FROM members m JOIN cr ON cr.id = m.record_id WHERE m.cluster_id = c.id))
 SELECT count_if(status = 'confirmed') AS clusters_confirmados, count_if(status = 'pending') AS clusters_pendentes,
 count(DISTINCT confirmed_on) AS dias_analisados FROM a""")
def e04_cluster_summary(spark, folder):
    t = tables(spark, folder)
    return lt.cluster_summary(t["clusters"], t["members"], t["records"], t["batches"])


@query("e04_cluster_summary_range", HEAD + """, a AS (SELECT * FROM clusters c WHERE status = 'confirmed'
 AND confirmed_on BETWEEN DATE '2024-02-02' AND DATE '2024-02-05' AND EXISTS
 (SELECT 1 FROM members m JOIN cr ON cr.id = m.record_id WHERE m.cluster_id = c.id))
 SELECT count(*) AS clusters_confirmados, count_if(status = 'pending') AS clusters_pendentes,
 count(DISTINCT confirmed_on) AS dias_analisados FROM a""")
def e04_cluster_summary_range(spark, folder):
    t = tables(spark, folder)
    return lt.cluster_summary(t["clusters"], t["members"], t["records"], t["batches"], "2024-02-02", "2024-02-05")


@query("e10_history_days", HEAD + """ SELECT c.confirmed_on AS data_analise, count(DISTINCT c.id) AS total_clusters FROM clusters c
 JOIN members m ON m.cluster_id = c.id JOIN cr ON cr.id = m.record_id
 WHERE c.status = 'confirmed' AND cr.centro = 'B0AC' AND cr.turno = '1' GROUP BY 1""")
def e10_history_days(spark, folder):
    t = tables(spark, folder)
    return lt.history_days(t["clusters"], t["members"], t["records"], t["batches"], centro="B0AC", turno="1")


@query("e11_daily_drive", with_tables("stops clusters members", """SELECT c.confirmed_on AS data_analise, count(DISTINCT c.id) AS total_clusters,
 count(m.record_id) AS total_apontamentos FROM clusters c LEFT JOIN members m ON m.cluster_id = c.id WHERE c.status = 'confirmed' GROUP BY 1"""))
def e11_daily_drive(spark, folder):
    return lt.daily_drive(fx.clusters(spark, folder), fx.members(spark, folder))


@query("e13_global_counters", with_tables("stops clusters canonical batches records", """SELECT (SELECT count(*) FROM batches) AS total_importacoes,
 (SELECT count(*) FROM records) AS total_apontamentos, (SELECT count(*) FROM records WHERE status = 'pending') AS apontamentos_pendentes,
 (SELECT count(*) FROM records WHERE status = 'confirmed') AS apontamentos_confirmados,
 (SELECT count(*) FROM records WHERE question_flag) AS apontamentos_questionados,
 (SELECT count(*) FROM clusters WHERE status = 'pending') AS clusters_pendentes,
 (SELECT count(*) FROM clusters WHERE status = 'confirmed') AS clusters_confirmados,
 (SELECT count(*) FROM clusters WHERE status = 'rejected') AS clusters_rejeitados,
 (SELECT count(*) FROM canonical) AS modos_falha_catalogados"""))
def e13_global_counters(spark, folder):
    t = tables(spark, folder)
    return lt.global_counters(t["batches"], t["records"], t["clusters"], t["canonical"])


@query("e14_canonical_usage", with_tables("stops clusters canonical records", """SELECT c.id, c.nome_canonico, count(r.id) AS total_registros
 FROM canonical c LEFT JOIN records r ON r.canonical_failure_id = c.id GROUP BY 1, 2"""))
def e14_canonical_usage(spark, folder):
    return lt.canonical_usage(fx.canonical(spark, folder), fx.records(spark, folder)).select("id", "nome_canonico", "total_registros")


FACETS = {"units": "centro", "lines": "linha", "failures": "tipo_parada", "shifts": "turno", "days": "data_inicio",
          "machines": "equipamento", "classes": "failure_class"}


@query("e15_facet_values", with_tables("reviewed", " UNION ALL ".join(
    f"SELECT DISTINCT '{f}' AS facet, CAST({c} AS VARCHAR) AS value FROM reviewed" for f, c in FACETS.items())))
def e15_facet_values(spark, folder):
    return lt.facet_values(fx.reviewed(spark, folder), FACETS)


@query("e15_main_unit", with_tables("stops", """SELECT centro AS main_unit FROM stops GROUP BY 1 ORDER BY count(*) DESC, centro LIMIT 1"""))
def e15_main_unit(spark, folder):
    return lt.main_unit(fx.stops(spark, folder))


@query("c12_maintenance_default", with_tables("stops", """SELECT id, centro, tipo_parada FROM stops WHERE tipo_parada = 'P.EQ.LINHA'
 AND centro = (SELECT centro FROM stops GROUP BY 1 ORDER BY count(*) DESC, centro LIMIT 1)"""))
def c12_maintenance_default(spark, folder):
    return lt.maintenance_default(fx.stops(spark, folder)).select("id", "centro", "tipo_parada")


# ---- hashes -----------------------------------------------------------------------------------------------------------

HASHED = ["centro", "linha", "equipamento", "observacao_raw", "operador", "minutos_parada", "data_inicio"]
ROW_SQL = "sha256(concat_ws(chr(31), " + ", ".join(
    f"coalesce('=' || {'trim(CAST(' + c + ' AS VARCHAR))'}, '-')" for c in HASHED) + "))"
LANES = ", ".join(f"CAST(sum(CAST('0x' || substr(h, {1 + 15 * i}, 15) AS BIGINT)) AS VARCHAR)" for i in range(4))


@query("b26_content_hash_by_batch", with_tables("stops", f""", h AS (SELECT upload_batch_id, {ROW_SQL} AS h FROM stops)
 SELECT upload_batch_id, count(*) AS n, sha256(concat_ws('|', CAST(count(*) AS VARCHAR), {LANES})) AS content_hash FROM h GROUP BY 1"""))
def b26_content_hash_by_batch(spark, folder):
    rows = fx.stops(spark, folder).select("upload_batch_id", calc.row_hash(HASHED).alias("h"))
    return rows.groupBy("upload_batch_id").agg(F.count(F.lit(1)).alias("n"), calc.content_hash("h").alias("content_hash"))


@query("a13_backfill_hashes", with_tables("stops batches clusters records", """SELECT b.id,
 (b.content_hash IS NULL AND EXISTS (SELECT 1 FROM records r WHERE r.upload_batch_id = b.id)) AS filled,
 b.content_hash AS old_hash FROM batches b"""))
def a13_backfill_hashes(spark, folder):
    before = fx.batches(spark, folder)
    after = lt.backfill_hashes(before, fx.records(spark, folder)).select("id", F.col("content_hash").alias("new_hash"))
    return before.join(after, "id").select("id", (F.col("content_hash").isNull() & F.col("new_hash").isNotNull()).alias("filled"),
                                           F.col("content_hash").alias("old_hash"))


@query("a15_list_batches", with_tables("batches", "SELECT id, filename, created_on FROM batches"))
def a15_list_batches(spark, folder):
    return fx.batches(spark, folder).select("id", "filename", "created_on").orderBy(F.desc("created_on"), F.desc("id"))


# ---- decisions -----------------------------------------------------------------------------------------------------------

OVERLAP = "om AS (SELECT cluster_id, record_id FROM members UNION ALL SELECT cluster_id + 3, record_id FROM members WHERE record_id % 40 < 2)"
PICKS = "picks AS (SELECT cluster_id, record_id FROM members WHERE cluster_id % 6 = 0 AND (cluster_id % 12 = 0 OR record_id % 2 = 0))"
CONFIRM = HEAD + f""", {OVERLAP}, {PICKS},
 pend AS (SELECT id FROM clusters WHERE status = 'pending'),
 taken AS (SELECT p.record_id, min(p.cluster_id) AS taken_by FROM picks p JOIN pend ON pend.id = p.cluster_id
  JOIN om ON om.cluster_id = p.cluster_id AND om.record_id = p.record_id GROUP BY 1),
 opened AS (SELECT om.*, taken_by FROM om JOIN pend ON pend.id = om.cluster_id LEFT JOIN taken t ON t.record_id = om.record_id),
 fate AS (SELECT cluster_id, CASE WHEN count_if(taken_by = cluster_id) > 0 AND count_if(taken_by IS NULL) = 0 THEN 'confirmed'
  WHEN count_if(taken_by = cluster_id) = 0 AND count_if(taken_by IS NOT NULL) > 0 AND count_if(taken_by IS NULL) < 2 THEN 'deleted'
  ELSE 'pending' END AS fate FROM opened GROUP BY 1)"""


def _confirmed(spark, folder):
    members = fx.members(spark, folder)
    shared = members.filter("record_id % 40 < 2").select((F.col("cluster_id") + 3).alias("cluster_id"), "record_id")
    picks = members.filter("cluster_id % 6 = 0 AND (cluster_id % 12 = 0 OR record_id % 2 = 0)")
    return lt.confirm_clusters(fx.clusters(spark, folder), members.unionByName(shared), picks)


@query("m08_confirm_clusters_status", CONFIRM + """ SELECT c.id, coalesce(f.fate, c.status) AS status FROM clusters c
 LEFT JOIN fate f ON f.cluster_id = c.id WHERE coalesce(f.fate, c.status) <> 'deleted'""")
def m08_confirm_clusters_status(spark, folder):
    return _confirmed(spark, folder)["clusters"].select("id", "status")


@query("m08_confirm_clusters_members", CONFIRM + """ SELECT o.cluster_id, o.record_id FROM opened o JOIN fate f ON f.cluster_id = o.cluster_id
 WHERE f.fate = 'confirmed' OR (f.fate = 'pending' AND o.taken_by IS NULL)
 UNION ALL SELECT om.cluster_id, om.record_id FROM om JOIN clusters c ON c.id = om.cluster_id WHERE c.status <> 'pending'""")
def m08_confirm_clusters_members(spark, folder):
    return _confirmed(spark, folder)["members"]


@query("m09_confirm_all", with_tables("stops clusters members", """SELECT c.id, CASE WHEN c.status = 'pending' AND m.cluster_id IS NOT NULL
 THEN 'confirmed' ELSE c.status END AS status, CASE WHEN c.status = 'pending' AND m.cluster_id IS NOT NULL THEN DATE '2024-03-01'
 ELSE c.confirmed_on END AS confirmed_on FROM clusters c LEFT JOIN (SELECT DISTINCT cluster_id FROM members) m ON m.cluster_id = c.id"""))
def m09_confirm_all(spark, folder):
    return lt.confirm_all(fx.clusters(spark, folder), fx.members(spark, folder), 7, "2024-03-01").select("id", "status", "confirmed_on")


REVERT = HEAD + """, back AS (SELECT id FROM clusters WHERE status = 'confirmed' AND bulk_job_id = 1),
 freed AS (SELECT DISTINCT record_id FROM members WHERE cluster_id IN (SELECT id FROM back)),
 r2 AS (SELECT id, CASE WHEN id IN (SELECT record_id FROM freed) THEN 'pending' ELSE status END AS status,
  CASE WHEN id NOT IN (SELECT record_id FROM freed) THEN canonical_failure_id END AS canonical_failure_id FROM records)"""


def _reverted(spark, folder):
    t = tables(spark, folder)
    return lt.revert_clusters(t["clusters"], t["members"], t["records"], t["canonical"], F.col("bulk_job_id") == 1)


@query("m09_revert_batch_records", REVERT + " SELECT * FROM r2")
def m09_revert_batch_records(spark, folder):
    return _reverted(spark, folder)["records"].select("id", "status", "canonical_failure_id")


@query("m09_revert_batch_orphans", REVERT + """ SELECT id FROM canonical c WHERE NOT EXISTS
 (SELECT 1 FROM r2 WHERE r2.canonical_failure_id = c.id)""")
def m09_revert_batch_orphans(spark, folder):
    return _reverted(spark, folder)["orphans"].select("id")


@query("m09_reject_clusters", with_tables("stops clusters", """SELECT id, CASE WHEN id % 10 = 0 THEN 'rejected' ELSE status END AS status FROM clusters"""))
def m09_reject_clusters(spark, folder):
    return lt.reject_clusters(fx.clusters(spark, folder), F.col("id") % 10 == 0).select("id", "status")


@query("m09_remove_members", with_tables("stops clusters members", """, gone AS (SELECT m.* FROM members m JOIN clusters c ON c.id = m.cluster_id
  WHERE c.status = 'pending' AND (m.record_id % 40 > 0 OR m.cluster_id % 2 = 0) AND m.cluster_id % 9 = 0),
 left_over AS (SELECT * FROM members EXCEPT SELECT * FROM gone),
 dead AS (SELECT cluster_id FROM (SELECT DISTINCT cluster_id FROM gone) g WHERE (SELECT count(*) FROM left_over l WHERE l.cluster_id = g.cluster_id) < 2)
 SELECT * FROM left_over WHERE cluster_id NOT IN (SELECT cluster_id FROM dead)"""))
def m09_remove_members(spark, folder):
    members = fx.members(spark, folder)
    removed = members.filter("(record_id % 40 > 0 OR cluster_id % 2 = 0) AND cluster_id % 9 = 0")
    return lt.remove_members(fx.clusters(spark, folder), members, removed)["members"]


@query("m11_question_records", with_tables("stops clusters records", """SELECT id, question_flag OR id % 33 = 0 AS question_flag,
 CASE WHEN id % 33 = 0 THEN 'duvida ' || CAST(CASE WHEN id % 2 = 0 THEN 2 ELSE 1 END AS VARCHAR) END AS question_note FROM records"""))
def m11_question_records(spark, folder):
    records = fx.records(spark, folder)
    asked = records.filter("id % 33 = 0").selectExpr("id", "explode(sequence(1, if(id % 2 = 0, 2, 1))) AS seq")\
        .selectExpr("id", "seq", "'duvida ' || CAST(seq AS STRING) AS question_note")
    return lt.question_records(records, asked).select("id", "question_flag", "question_note")


# ---- sets ------------------------------------------------------------------------------------------------------------------

ARRAYS = """, g AS (SELECT cluster_id, list_sort(list(id)) AS ids, list_sort(list(id) FILTER (WHERE question_flag OR id % 3 = 0)) AS done
 FROM stops GROUP BY 1)"""


def _arrays(spark, folder):
    return fx.stops(spark, folder).groupBy("cluster_id").agg(
        F.array_sort(F.collect_list("id")).alias("ids"),
        F.array_sort(F.collect_list(F.when(F.col("question_flag") | (F.col("id") % 3 == 0), F.col("id")))).alias("done"))


@query("h05_members_minus_confirmed", with_tables("stops", ARRAYS + """ SELECT cluster_id,
 array_to_string(list_filter(ids, lambda x: NOT list_contains(done, x)), ',') AS left_over FROM g"""))
def h05_members_minus_confirmed(spark, folder):
    rest = lt.array_difference(F.col("ids"), F.col("done"))
    return _arrays(spark, folder).select("cluster_id", F.array_join(rest.cast("array<string>"), ",").alias("left_over"))


@query("h06_merged_members", with_tables("stops", ARRAYS + """ SELECT cluster_id, array_to_string(list_concat(done,
 list_filter(ids, lambda x: NOT list_contains(done, x))), ',') AS merged FROM g"""))
def h06_merged_members(spark, folder):
    merged = lt.array_merge(F.col("done"), F.col("ids"))
    return _arrays(spark, folder).select("cluster_id", F.array_join(merged.cast("array<string>"), ",").alias("merged"))


@query("h07_state_changes", with_tables("stops clusters", """, b AS (SELECT id, CASE WHEN id % 4 = 0 THEN 'X' END AS v FROM clusters WHERE id % 5 <> 0),
 a AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'Y' WHEN id % 4 = 0 THEN 'X' END AS v FROM clusters WHERE id % 7 <> 0)
 SELECT coalesce(b.id, a.id) AS id, b.v AS before, a.v AS after FROM b FULL JOIN a ON a.id = b.id WHERE b.v IS DISTINCT FROM a.v"""))
def h07_state_changes(spark, folder):
    clusters = fx.clusters(spark, folder)
    before = clusters.filter("id % 5 <> 0").selectExpr("id", "CASE WHEN id % 4 = 0 THEN 'X' END AS v")
    after = clusters.filter("id % 7 <> 0").selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'Y' WHEN id % 4 = 0 THEN 'X' END AS v")
    return lt.state_changes(before, after, "id", "v")


# ---- writes as queries: A6, A7, A9 ---------------------------------------------------------------------------------------------

@query("a06_batches_not_loaded", with_tables("stops", f""", h AS (SELECT upload_batch_id, linha, {ROW_SQL} AS h FROM stops),
 c AS (SELECT linha, count(*) AS n, sha256(concat_ws('|', CAST(count(*) AS VARCHAR), {LANES})) AS content_hash FROM h GROUP BY 1)
 SELECT linha, n FROM c WHERE linha NOT IN ('LINHA001', 'LINHA003')"""))
def a06_batches_not_loaded(spark, folder):
    from stoplens.sources.sinks import not_loaded
    hashed = fx.stops(spark, folder).select("linha", calc.row_hash(HASHED).alias("h")).groupBy("linha").agg(
        F.count(F.lit(1)).alias("n"), calc.content_hash("h").alias("content_hash"))
    loaded = hashed.filter("linha IN ('LINHA001', 'LINHA003')")
    return not_loaded(hashed, loaded, ["content_hash"]).select("linha", "n")


@query("a09_latest_examples", with_tables("stops", """SELECT upper(trim(observacao_raw)) AS relato_norm,
 arg_max(equipamento, id) AS classe, max(id) AS seq FROM stops GROUP BY 1"""))
def a09_latest_examples(spark, folder):
    from stoplens.sources.sinks import upserted
    rows = fx.stops(spark, folder).select(F.upper(F.trim("observacao_raw")).alias("relato_norm"),
                                          F.col("equipamento").alias("classe"), F.col("id").alias("seq"))
    return upserted(rows.filter("seq % 2 = 0"), rows.filter("seq % 2 = 1"), ["relato_norm"], "seq")

"""Registered queries: landed files, written from the stops to the shared folder and read back; staged writes."""

from uuid import uuid4

from pyspark.sql import functions as F

from stoplens.operators import log_tables as lt
from stoplens.plans import fixtures as fx
from stoplens.plans.fixtures import with_tables
from stoplens.plans.registry import query
from stoplens.session import shared_folder
from stoplens.sources import landed, sinks, versions

TITLES = {"Unidade": "centro", "Data": "data", "Linha": "linha", "Equipamento": "equipamento", "Tipo de falha": "tipo_parada", "Ordem": "numero",
          "Observações": "nota", "Minutos de parada": "minutos"}
#: What an operator might type: line breaks, separators and quotes in every third note, and some rows that can't be right.
SHEET = [
    ("id", "id"), ("centro", "centro"), ("linha", "linha"), ("equipamento", "equipamento"), ("tipo_parada", "tipo_parada"), ("CAST(id AS STRING)", "numero"),
    ("CAST(data_inicio AS STRING)", "data"),
    ("CASE WHEN id % 3 = 0 THEN observacao_raw || chr(10) || '2a linha; \"entre aspas\"' || chr(10) || chr(10) || 'fim' ELSE observacao_raw END", "nota"),
    ("CASE WHEN id % 97 = 5 THEN 'abc' WHEN id % 101 = 7 THEN '-1' ELSE CAST(minutos_parada AS STRING) END", "minutos"),
]
SHEET_SQL = f"sheet AS (SELECT {fx.select_list(SHEET)}, minutos_parada FROM stops)"


def landed_sheet(spark, folder):
    """The stops as delimited files, written by several tasks to the shared folder; their path."""
    sheet = fx.stops(spark, folder).selectExpr(*[f"{e} AS {n}" for e, n in SHEET]).select(*[F.col(n).alias(t) for t, n in TITLES.items()])
    path = f"{shared_folder(spark)}/sheet-{uuid4().hex}"
    sheet.write.options(header=True, sep=";", quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="").csv(path)
    return path


@query("a01_landed_stops", "WITH " + fx.CTE["stops"] + ", " + SHEET_SQL + """ SELECT id, centro, linha, equipamento, tipo_parada, trim(nota, ' ' || chr(10)) AS observacao_raw, CAST(data AS DATE) AS data_inicio,
 CAST(minutos AS DOUBLE) AS minutos_parada, 8 AS cells FROM sheet WHERE id % 97 <> 5 AND id % 101 <> 7""")
def a01_landed_stops(spark, folder):
    good, _ = landed.read_landed(spark, [landed_sheet(spark, folder)], strict=False)
    return good.select(F.col("ordem").cast("bigint").alias("id"), "centro", "linha", "equipamento", "tipo_parada", "observacao_raw", "data_inicio",
                       F.col("minutos_parada").cast("double").alias("minutos_parada"), F.size("original").alias("cells"))


@query("a03_quarantined_rows", with_tables("stops", f"""SELECT CASE WHEN id % 97 = 5 OR id % 101 = 7 THEN '{landed.BAD_MINUTES}' END AS reject_reason, count(*) AS n
 FROM stops WHERE id % 97 = 5 OR id % 101 = 7 GROUP BY 1"""))
def a03_quarantined_rows(spark, folder):
    _, bad = landed.read_landed(spark, [landed_sheet(spark, folder)], strict=False)
    return bad.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))


@query("a05_labelled_notes", with_tables("stops", """SELECT trim(nota, ' ' || chr(10)) AS note, tipo_parada AS label, count(*) AS n FROM
 (SELECT tipo_parada, CASE WHEN id % 3 = 0 THEN observacao_raw || chr(10) || '2a linha; "entre aspas"' || chr(10) || chr(10) || 'fim' ELSE observacao_raw END AS nota FROM stops) s
 WHERE trim(nota, ' ' || chr(10)) <> '' GROUP BY 1, 2"""))
def a05_labelled_notes(spark, folder):
    sheet = fx.stops(spark, folder).selectExpr(*[f"{e} AS {n}" for e, n in SHEET])
    path = f"{shared_folder(spark)}/labelled-{uuid4().hex}"
    sheet.select(F.col("nota").alias("Observações Operação"), F.col("tipo_parada").alias("Classificação Manual Analista")).write.options(
        header=True, sep=",", quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="").csv(path)
    rows, _ = landed.read_labelled(spark, [path])
    return rows.groupBy(F.trim("note", F.lit(" \n")).alias("note"), "label").agg(F.count(F.lit(1)).alias("n"))


# ---- writes that become visible with their commit ------------------------------------------------------------------------

def home(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid4().hex}"


@query("a06_appended_batches", with_tables("stops batches", """SELECT b.id, b.content_hash, CAST(count(s.id) AS BIGINT) AS stops FROM batches b JOIN stops s ON s.upload_batch_id = b.id
 WHERE b.content_hash IS NULL OR b.id = (SELECT min(id) FROM batches f WHERE f.content_hash = b.content_hash) GROUP BY 1, 2"""))
def a06_appended_batches(spark, folder):
    """Batches in two loads, the second with all of them again: copies of a content load once, stops appear with their batch."""
    place = home(spark, "batches")
    batches = fx.batches(spark, folder).withColumn("file_hash", F.col("filename"))
    stops = fx.stops(spark, folder).select("id", "upload_batch_id")
    sinks.append_batches(batches.where("id < 2"), stops, place, "first-load")
    sinks.append_batches(batches, stops, place, "second-load")
    held = versions.live(spark, place, "stops").groupBy(F.col("upload_batch_id").alias("id")).agg(F.count(F.lit(1)).alias("stops"))
    return versions.live(spark, place, "batches").join(held, "id").select("id", "content_hash", "stops")


SUMMARY = "SELECT analysis_id, tipo_parada AS classe, count(*) AS linhas FROM {stops} GROUP BY analysis_id, tipo_parada"


@query("a08_replaced_summaries", with_tables("stops", f"SELECT analysis_id, classe, CASE analysis_id WHEN '2' THEN linhas * 10 ELSE linhas END AS linhas FROM ({SUMMARY.format(stops='stops')}) s WHERE analysis_id <> '1'"))
def a08_replaced_summaries(spark, folder):
    """All summaries written; then that of one analysis replaced by other rows and that of another by nothing."""
    place = home(spark, "summaries")
    first = spark.sql(SUMMARY, stops=fx.stops(spark, folder))
    sinks.replace_summaries(first, first.select("analysis_id"), place, "all")
    again = first.where("analysis_id = '2'").withColumn("linhas", F.col("linhas") * 10)
    sinks.replace_summaries(again, spark.createDataFrame([("1",), ("2",)], "analysis_id string"), place, "again")
    return sinks.summaries(spark, place).select("analysis_id", "classe", "linhas")


@query("g08_newest_stops", with_tables("stops", "SELECT id, data_inicio FROM stops ORDER BY data_inicio DESC, id DESC LIMIT 100"))
def g08_newest_stops(spark, folder):
    """The newest 100 points of a history: the limit is the operator."""
    return lt.last_n(fx.stops(spark, folder).select("id", "data_inicio"), [F.desc("data_inicio"), F.desc("id")], 100)

"""Stop-log tables derived from the given tables.

Each table is a list of (expression, name) whose text both Spark SQL and DuckDB accept, so the same rows feed
the Spark operators and the independent oracle queries. Nothing is filtered: every row of the source is used.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOTE = """CASE event_id % 12 WHEN 0 THEN 'ROLAMENTO QUEBRADO' WHEN 1 THEN 'Falha no sensor de saída'
 WHEN 2 THEN 'ROLAMNETO ESTOURADO' WHEN 3 THEN 'SEM ROLAMENTO QUEBRADO'
 WHEN 4 THEN 'VÁLVULA Nº41 com nível baixo' WHEN 5 THEN 'motor queimado' WHEN 6 THEN ''
 WHEN 7 THEN 'CORREIA rompida' WHEN 8 THEN 'MAQUINA PAROU SOZINHA' WHEN 9 THEN 'vazando óleo na mangueira'
 WHEN 10 THEN 'QUEDA DE GARRAFAS' ELSE 'xxxxxx' END
 || CASE WHEN event_id % 5 < 2 AND event_id % 12 <> 6
    THEN ' ( 30008' || lpad(CAST((user_id*31 + dayofyear(ts)) AS STRING),6,'0') || ' )' ELSE '' END"""

STOPS = [
    ("CAST(event_id % 4 AS STRING)", "analysis_id"),
    ("event_id", "id"),
    ("CAST(event_id % 4 AS BIGINT)", "upload_batch_id"),
    ("event_id + 2", "source_row"),
    ("CASE user_id % 3 WHEN 0 THEN 'B0AC' WHEN 1 THEN 'B0BD' ELSE 'B0CE' END", "centro"),
    ("CAST(ts AS DATE)", "data_inicio"),
    ("'LINHA00' || CAST(1 + user_id % 5 AS STRING)", "linha"),
    ("CASE WHEN event_id % 7 = 0 THEN 'P.OPERACIONAL' ELSE 'P.EQ.LINHA' END", "tipo_parada"),
    ("CAST(90000 + user_id % 9 AS STRING)", "material"),
    ("CAST(1100 + event_id % 6 AS STRING)", "ordem"),
    ("CAST(1 + CAST(floor(hour(ts) / 8.0) AS INT) AS STRING)", "turno"),
    ("lpad(CAST(hour(ts) AS STRING),2,'0') || ':00-' || lpad(CAST((hour(ts)+1)%24 AS STRING),2,'0') || ':00'",
     "intervalo"),
    ("""CASE event_type WHEN 'error' THEN 'ENCHEDORA' WHEN 'click' THEN 'ROTULADORA' WHEN 'view' THEN 'PALETIZADOR'
 WHEN 'signup' THEN 'ENVOLVEDORA' ELSE 'INSPETOR' END""", "equipamento"),
    ("CASE WHEN user_id % 2 = 0 THEN 'SUB A' ELSE '' END", "subchave_parada"),
    ("'SISTEMA ' || CAST(user_id % 2 AS STRING)", "sistema"),
    (NOTE, "observacao_raw"),
    ("CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'OP' || CAST(user_id AS STRING) END", "operador"),
    ("CAST(event_id % 37 AS DECIMAL(12,2))", "pts_efic_perdidos"),
    ("CAST(event_id % 40 AS DECIMAL(12,2))", "pts_acumulados"),
    ("CAST(event_id % 11 AS DECIMAL(12,2))", "caixas_produzidas"),
    ("CAST(60 AS DECIMAL(12,2))", "total_minutos"),
    ("CAST(value AS DECIMAL(12,2))", "minutos_parada"),
    ("CAST(floor(event_id / 40) AS BIGINT)", "cluster_id"),
    ("event_id % 50 = 0", "question_flag"),
]

FAILURE_CLASS = """CASE event_id % 12 WHEN 0 THEN 'FALHA DE ROLAMENTO' WHEN 1 THEN 'FALHA DE SENSOR'
 WHEN 2 THEN 'FALHA DE ROLAMENTO' WHEN 3 THEN 'FALHA DE ROLAMENTO' WHEN 4 THEN 'FALHA DE VÁLVULA'
 WHEN 5 THEN 'FALHA DE MOTOR' WHEN 6 THEN 'SEM DESCRIÇÃO' WHEN 7 THEN 'FALHA DE CORREIA'
 WHEN 9 THEN 'FALHA DE MANGUEIRA' WHEN 10 THEN 'QUEDA DE GARRAFAS' ELSE 'SEM MODO DE FALHA IDENTIFICADO' END"""

# A board whose cards were all reviewed: the class, the mode and the group of every stop are known.
REVIEWED = STOPS + [
    (FAILURE_CLASS, "failure_class"),
    ("""CASE event_id % 12 WHEN 2 THEN 'Rolamento Quebrado' WHEN 6 THEN 'Descrição não informada'
 ELSE 'Modo ' || CAST(event_id % 12 AS STRING) END""", "failure_mode"),
    ("""CAST(event_id % 4 AS STRING) || '/' || CAST(user_id % 15 AS STRING) || '/' || event_type || '/'
 || CAST(event_id % 12 AS STRING)""", "group_id"),
]

# A model's suggestion for every note, as the single flow stores it.
ITEM_BAND = "CASE event_id % 12 WHEN 8 THEN 'Baixa' WHEN 11 THEN 'Baixa' WHEN 4 THEN 'Média' WHEN 9 THEN 'Média' ELSE 'Alta' END"

# Same shape over the sales tables: region / nation / brand stand for unit / line / machine.
SALES = [
    ("r_name", "centro"), ("n_name", "linha"), ("p_brand", "equipamento"), ("l_returnflag", "tipo_parada"),
    ("p_type", "failure_class"), ("p_type", "failure_mode"),
    ("CAST(l_quantity AS DECIMAL(12,2))", "minutos_parada"), ("CAST(l_shipdate AS DATE)", "data_inicio"),
    ("CAST(l_orderkey AS STRING)", "analysis_id"), ("CAST(l_linenumber AS BIGINT)", "id"),
]
SALES_FROM = """lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
 JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey"""

BATCHES = """SELECT CAST(k AS BIGINT) AS id, CASE k WHEN 3 THEN NULL WHEN 2 THEN 'h2' ELSE 'h0' END AS content_hash,
 'f' || CAST(k AS STRING) || '.csv' AS filename, n AS total_records,
 CAST(DATE '2024-02-01' + CAST(k AS INT) AS DATE) AS created_on
 FROM (SELECT event_id % 4 AS k, count(*) AS n FROM {events} GROUP BY event_id % 4) x"""

CLUSTERS = """SELECT cluster_id AS id, linha, equipamento, suggested_name, status, avg_similarity,
 CASE WHEN status = 'confirmed' THEN DATE '2024-02-01' + CAST(cluster_id % 9 AS INT) END AS confirmed_on,
 DATE '2024-01-01' + CAST(cluster_id % 60 AS INT) AS created_on, cluster_id % 2 AS bulk_job_id
 FROM (SELECT cluster_id, min(linha) AS linha, min(equipamento) AS equipamento,
  'Grupo ' || CAST(cluster_id % 17 AS STRING) AS suggested_name,
  CASE cluster_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'confirmed' ELSE 'rejected' END AS status,
  CAST(0.80 + (cluster_id % 20) / 100.0 AS DOUBLE) AS avg_similarity FROM {stops} GROUP BY cluster_id) c"""

CANONICAL = """SELECT id, suggested_name AS nome_canonico, linha, equipamento FROM {clusters} WHERE status <> 'rejected'"""


def select_list(columns: list[tuple[str, str]]) -> str:
    return ", ".join(f"{expression} AS {name}" for expression, name in columns)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stops(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(*[f"{e} AS {n}" for e, n in STOPS])


def reviewed(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(*[f"{e} AS {n}" for e, n in REVIEWED])


def sales(spark: SparkSession, folder: str) -> DataFrame:
    names = ["lineitem", "supplier", "nation", "region", "part"]
    line, supp, nation, region, part = [table(spark, folder, n) for n in names]
    joined = (line.join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
              .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
              .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
              .join(part, F.col("l_partkey") == F.col("p_partkey")))
    return joined.selectExpr(*[f"{e} AS {n}" for e, n in SALES])


def batches(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(BATCHES, events=table(spark, folder, "events"))


def clusters(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(CLUSTERS, stops=stops(spark, folder))


def members(spark: SparkSession, folder: str) -> DataFrame:
    return stops(spark, folder).select("cluster_id", F.col("id").alias("record_id"))


def canonical(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(CANONICAL, clusters=clusters(spark, folder))


def records(spark: SparkSession, folder: str) -> DataFrame:
    """Stops with the status their cluster gives them and the canonical failure of confirmed ones."""
    return stops(spark, folder).withColumns({
        "status": F.when(F.col("cluster_id") % 3 == 1, "confirmed").otherwise("pending"),
        "canonical_failure_id": F.when(F.col("cluster_id") % 3 == 1, F.col("cluster_id")),
        "observacao_normalizada": F.upper(F.trim("observacao_raw")),
    })


def channels(spark: SparkSession, folder: str) -> DataFrame:
    """One radio channel per (line, shift) seen, but for the pair (LINHA001, 1)."""
    pairs = stops(spark, folder).select("linha", "turno").distinct()
    return pairs.filter("NOT (linha = 'LINHA001' AND turno = '1')")\
        .selectExpr("linha", "turno", "substr(linha, 8, 1) || turno AS canal")


# ---- the same tables as common table expressions for the oracle -------------------------------------------

CTE = {
    "stops": f"stops AS (SELECT {select_list(STOPS)} FROM events)",
    "reviewed": f"reviewed AS (SELECT {select_list(REVIEWED)} FROM events)",
    "sales": f"sales AS (SELECT {select_list(SALES)} FROM {SALES_FROM})",
    "batches": f"batches AS ({BATCHES.format(events='events')})",
    "clusters": f"clusters AS ({CLUSTERS.format(stops='stops')})",
    "members": "members AS (SELECT cluster_id, id AS record_id FROM stops)",
    "canonical": f"canonical AS ({CANONICAL.format(clusters='clusters')})",
    "records": """records AS (SELECT *, CASE WHEN cluster_id % 3 = 1 THEN 'confirmed' ELSE 'pending' END AS status,
 CASE WHEN cluster_id % 3 = 1 THEN cluster_id END AS canonical_failure_id,
 upper(trim(observacao_raw)) AS observacao_normalizada FROM stops)""",
    "channels": """channels AS (SELECT linha, turno, substr(linha, 8, 1) || turno AS canal
 FROM (SELECT DISTINCT linha, turno FROM stops) p WHERE NOT (linha = 'LINHA001' AND turno = '1'))""",
}


def with_tables(names: str, query: str) -> str:
    """An oracle query over the named derived tables (space separated, in dependency order)."""
    return "WITH " + ",\n".join(CTE.get(n, n) for n in names.split()) + "\n" + query

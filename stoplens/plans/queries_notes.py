"""Registered queries: note normalisation, rule classification (K), card votes, near-duplicate grouping (J)."""

from pyspark.sql import functions as F

from stoplens.functions import text
from stoplens.operators import classify as cl
from stoplens.operators import grouping as gr
from stoplens.operators import words
from stoplens.operators.catalog import Catalog
from stoplens.operators.skew import lookup_join
from stoplens.plans import fixtures as fx
from stoplens.plans.fixtures import with_tables
from stoplens.plans.queries_flow import B10, B11, O
from stoplens.plans.registry import query, rounded

# Normal form of the twelve base notes, worked out by hand from the rules (order numbers already gone).
NORMAL = """CASE id % 12 WHEN 0 THEN 'ROLAMENTO QUEBRADO' WHEN 1 THEN 'FALHA SENSOR SAIDA' WHEN 2 THEN 'ROLAMENTO QUEBRADO'
 WHEN 3 THEN 'SEM ROLAMENTO QUEBRADO' WHEN 4 THEN 'VALVULA NO41 NIVEL BAIXO' WHEN 5 THEN 'MOTOR FALHA_ELETRICA' WHEN 6 THEN ''
 WHEN 7 THEN 'ESTEIRA ROMPIDA' WHEN 8 THEN 'MAQUINA PAROU SOZINHA' WHEN 9 THEN 'VAZAMENTO OLEO MANGUEIRA'
 WHEN 10 THEN 'QUEDA GARRAFAS' ELSE 'XXXXXX' END"""
PLACE = "CASE WHEN id % 12 = 6 THEN '' WHEN floor(id / 12) % 4 = 0 THEN '' WHEN floor(id / 12) % 4 = 1 THEN ' LADO DIREITO' WHEN id % 5 = 0 THEN ' LADO ESQUERDO EQUIPAMENTO' ELSE ' LADO DIREITO EQUIPAMENTO' END"


@query("b06_normal_note", with_tables("stops", f"SELECT id, {NORMAL} AS value FROM stops"))
def b06_normal_note(spark, folder):
    return words.with_normal_notes(fx.stops(spark, folder).select("id", O), text.header_key(O), "value").select("id", "value")


@query("b07_repaired_tokens")
def b07_repaired_tokens(spark, folder):
    """Every note; SQL has no Ratcliff-Obershelp ratio, so the tests compare with difflib."""
    notes = fx.stops(spark, folder).select("id", F.array_join(text.note_tokens(text.header_key(O)), " ").alias("note"))
    fixed = words.repaired_texts(notes.select("note").distinct(), "note", words.note_repair())
    return lookup_join(notes, fixed, ["note"], "inner").select("id", F.array_join("repaired", " ").alias("value"))


# ---- K -----------------------------------------------------------------------------------------------------

def _literal(value):
    return "'" + str(value).replace("'", "''") + "'"


def _terms_sql():
    from stoplens.operators.catalog import plain_term
    rows = [f"({c['ord']}, {_literal(c['kind'])}, {_literal(c['label'])}, {_literal(role)}, {_literal(plain_term(t))})"
            for c in Catalog().classes for role, key in (("term", "terms"), ("with", "with"), ("machine", "machine")) for t in c[key]]
    return "terms(ord, kind, label, role, term) AS (VALUES " + ", ".join(rows) + ")"


CLASSES = ("WITH " + fx.CTE["stops"] + ", " + _terms_sql() + f""",
 n AS (SELECT id, {B10.format(x=O)} AS norm, equipamento AS mach FROM stops),
 d AS (SELECT DISTINCT norm, mach, ' ' || replace(norm, 'ROLAMNETO', 'ROLAMENT') AS t, ' ' || mach AS m FROM n),
 pos AS (SELECT d.norm, d.mach, ord, kind, label, min(instr(t, ' ' || term)) FILTER (WHERE role = 'term' AND instr(t, ' ' || term) > 0) AS p,
  count_if(role <> 'term') AS gates, count_if(role = 'with' AND instr(t, ' ' || term) > 0) + count_if(role = 'machine' AND instr(m, ' ' || term) > 0) AS opened,
  count_if(role = 'term' AND instr(' ' || d.norm, ' ' || term) > 0) AS direct
  FROM d, terms GROUP BY 1, 2, 3, 4, 5),
 hit AS (SELECT *, CASE kind WHEN 'regra' THEN 0 WHEN 'componente' THEN 1 ELSE 2 END AS rank FROM pos WHERE p IS NOT NULL AND (gates = 0 OR opened > 0)),
 best AS (SELECT *, row_number() OVER (PARTITION BY norm, mach ORDER BY (rank > 0), p, rank, ord) AS r, count(*) OVER (PARTITION BY norm, mach) AS many FROM hit),
 ans AS (SELECT d.norm, d.mach, CASE WHEN NOT ({B11.format(x='d.norm')}) THEN 'SEM DESCRIÇÃO' WHEN b.label IS NULL THEN 'SEM MODO DE FALHA IDENTIFICADO'
   WHEN kind = 'componente' THEN 'FALHA DE ' || label ELSE label END AS label,
  CASE WHEN NOT ({B11.format(x='d.norm')}) OR b.label IS NULL THEN 'baixa' WHEN direct = 0 OR (rank > 0 AND many > 1) THEN 'media' ELSE 'alta' END AS confidence,
  CASE WHEN NOT ({B11.format(x='d.norm')}) OR b.label IS NULL THEN 'nenhum' ELSE kind END AS source
  FROM d LEFT JOIN best b ON b.norm = d.norm AND b.mach = d.mach AND b.r = 1),
 classed AS (SELECT n.id, a.* EXCLUDE (norm, mach) FROM n JOIN ans a ON a.norm = n.norm AND a.mach = n.mach)""")


@query("k10_classified_stops", CLASSES + " SELECT id, label, confidence, source FROM classed")
def k10_classified_stops(spark, folder):
    return cl.classify(fx.stops(spark, folder)).select("id", "label", "confidence", "source")


@query("k01_catalog_terms", "WITH " + _terms_sql() + """, s AS (SELECT equipamento, count(*) AS stops FROM
 (SELECT CASE event_type WHEN 'error' THEN 'ENCHEDORA' WHEN 'click' THEN 'ROTULADORA' WHEN 'view' THEN 'PALETIZADOR' WHEN 'signup' THEN 'ENVOLVEDORA' ELSE 'INSPETOR' END AS equipamento FROM events) e GROUP BY 1)
 SELECT equipamento, label, role, term, stops FROM s JOIN terms ON instr(' ' || equipamento, ' ' || term) > 0""")
def k01_catalog_terms(spark, folder):
    machines = fx.stops(spark, folder).groupBy("equipamento").agg(F.count(F.lit(1)).alias("stops"))
    terms = F.broadcast(Catalog().terms(spark))
    named = F.contains(F.concat(F.lit(" "), "equipamento"), F.concat(F.lit(" "), "term"))
    return machines.join(terms, named).select("equipamento", "label", "role", "term", "stops")


@query("k06_reasons_and_details", with_tables("stops", """SELECT id, CASE id % 12 WHEN 0 THEN 'quebra' WHEN 2 THEN 'quebra' WHEN 3 THEN 'quebra'
  WHEN 7 THEN 'quebra' WHEN 9 THEN 'vazamento' ELSE '' END AS detail,
 CASE id % 12 WHEN 0 THEN 'Componente citado: rolamento.' WHEN 1 THEN 'Componente citado: sensor.' WHEN 2 THEN 'Componente citado: rolamneto (com correção de digitação).'
  WHEN 3 THEN 'Componente citado: rolamento.' WHEN 4 THEN 'Regra específica do catálogo: valvula.' WHEN 5 THEN 'Componente citado: motor; também cita falha elétrica.'
  WHEN 6 THEN 'Relato vazio ou só com o número da ordem.' WHEN 7 THEN 'Componente citado: correia.' WHEN 9 THEN 'Componente citado: mangueira.'
  WHEN 10 THEN 'Processo citado: queda.' ELSE 'Nenhum termo do catálogo no relato.' END AS reason FROM stops"""))
def k06_reasons_and_details(spark, folder):
    return cl.classify(fx.stops(spark, folder)).select("id", "detail", "reason")


@query("k12_catalog_test", CLASSES.replace("equipamento AS mach FROM stops", "'ENCHEDORA' AS mach FROM stops", 1) + """ SELECT DISTINCT observacao_raw, label, confidence FROM stops JOIN classed USING (id)""")
def k12_catalog_test(spark, folder):
    """Every different note as a trial text for one machine."""
    tried = cl.test_catalog(fx.stops(spark, folder).select(O).distinct(), "ENCHEDORA", Catalog())
    return tried.select(O, "label", "confidence")


def corrections(stops):
    said = F.when(F.col("id") % 10 != 9, F.concat(F.lit("FALHA "), (F.floor(F.col("id") / 40) % 3).cast("string")))
    return stops.select(text.memory_key(O).alias("note_key"), F.col("id").alias("seq"), said.alias("label"))


@query("k11_correction_memory")
def k11_correction_memory(spark, folder):
    """Corrections of every note; the tests replay them one by one."""
    return cl.fold_memory(corrections(fx.stops(spark, folder)))


@query("d12_memory_beats_catalog")
def d12_memory_beats_catalog(spark, folder):
    stops = fx.stops(spark, folder)
    return cl.classify(stops, memory=cl.fold_memory(corrections(stops))).select("id", "label", "source")


# Trial cards: the members of a cluster stand for one card.
VOTES = CLASSES + """, v AS (SELECT s.cluster_id, c.label, count(*) AS n, bool_and(c.confidence = 'alta') AS sure FROM stops s JOIN classed c ON c.id = s.id GROUP BY 1, 2),
 w AS (SELECT *, sum(n) OVER (PARTITION BY cluster_id) AS total, row_number() OVER (PARTITION BY cluster_id
  ORDER BY n DESC, label IN ('SEM DESCRIÇÃO', 'SEM MODO DE FALHA IDENTIFICADO'), label DESC) AS r FROM v)"""


def card_of_cluster(stops):
    return stops.select("analysis_id", F.col("cluster_id").cast("string").alias("card_id"), F.col("id").alias("record_id"))


@query("k08_card_votes", VOTES + """ SELECT CAST(cluster_id AS VARCHAR) AS card_id, label, round(n / total, 3) AS agreement,
 CASE WHEN label IN ('SEM DESCRIÇÃO', 'SEM MODO DE FALHA IDENTIFICADO') THEN 'baixa' WHEN n / total < 0.75 OR NOT sure THEN 'media' ELSE 'alta' END AS confidence
 FROM w WHERE r = 1""")
def k08_card_votes(spark, folder):
    stops = fx.stops(spark, folder).withColumn("analysis_id", F.lit("all"))
    votes = cl.card_votes(cl.classify(stops), card_of_cluster(stops))
    return votes.select("card_id", "label", "agreement", "confidence")


@query("k09_final_class", VOTES + """ SELECT CAST(cluster_id AS VARCHAR) AS card_id, CASE WHEN cluster_id % 5 = 0 THEN 'MANUAL' WHEN cluster_id % 5 = 1 THEN 'CONGELADA'
 ELSE label END AS final_class FROM w WHERE r = 1""")
def k09_final_class(spark, folder):
    stops = fx.stops(spark, folder).withColumn("analysis_id", F.lit("all"))
    votes = cl.card_votes(cl.classify(stops), card_of_cluster(stops))
    number = F.col("card_id").cast("bigint") % 5
    return votes.select("card_id", cl.final_class(F.when(number == 0, "MANUAL"), F.lit("CONGELADA"), number <= 1, F.col("label")).alias("final_class"))


@query("h04_class_list", CLASSES + """ SELECT DISTINCT label FROM (SELECT label FROM classed UNION ALL SELECT CASE kind WHEN 'componente' THEN 'FALHA DE ' || label ELSE label END FROM terms
 UNION ALL VALUES ('SEM DESCRIÇÃO'), ('SEM MODO DE FALHA IDENTIFICADO'))""")
def h04_class_list(spark, folder):
    return cl.class_list(Catalog(), cl.classify(fx.stops(spark, folder)))


@query("c14_unclassified_stops", CLASSES + " SELECT id FROM classed WHERE label IN ('SEM DESCRIÇÃO', 'SEM MODO DE FALHA IDENTIFICADO')")
def c14_unclassified_stops(spark, folder):
    from stoplens import fixed_values as fv
    return cl.classify(fx.stops(spark, folder)).filter(F.col("label").isin(fv.UNCLASSIFIED)).select("id")


# A stand-in model: a label and a probability that depend on the note only.
MODEL = """, scored AS (SELECT c.*, n.norm, CASE WHEN length(n.norm) % 3 = 0 THEN 'FALHA DE MOTOR' WHEN length(n.norm) % 3 = 1 THEN c.label ELSE 'FALHA DE BOMBA' END AS model_label,
 ((length(n.norm) * 29) % 100) / 100.0 AS p FROM classed c JOIN n ON n.id = c.id)"""
for _name, _examples in (("young", 50), ("mature", 500)):
    @query(f"l16_refined_by_{_name}_model", CLASSES + MODEL + f""", z AS (SELECT *, label <> 'SEM DESCRIÇÃO' AND label = 'SEM MODO DE FALHA IDENTIFICADO' AND p >= 0.6
  AND model_label IS NOT NULL AND norm <> 'MAQUINA' AS learned, label NOT IN ('SEM DESCRIÇÃO', 'SEM MODO DE FALHA IDENTIFICADO') AS known FROM scored)
 SELECT id, CASE WHEN learned THEN model_label WHEN known AND model_label <> label AND p >= 0.6 AND {_examples} >= 200 THEN model_label ELSE label END AS label,
 CASE WHEN learned THEN CASE WHEN p >= 0.92 THEN 'alta' ELSE 'media' END WHEN known AND model_label = label AND confidence = 'media' AND p >= 0.7 THEN 'alta'
  WHEN known AND model_label <> label AND p >= 0.6 AND {_examples} >= 200 THEN CASE WHEN p >= 0.9 THEN 'alta' ELSE 'media' END
  WHEN known AND model_label <> label AND p >= 0.75 THEN 'media' ELSE confidence END AS confidence FROM z""")
    def _refined(spark, folder, examples=_examples):
        size = F.length(text.catalog_text(O))
        scored = cl.classify(fx.stops(spark, folder)).withColumns({
            "model_label": F.when(size % 3 == 0, "FALHA DE MOTOR").when(size % 3 == 1, F.col("label")).otherwise("FALHA DE BOMBA"),
            "probability": (size * 29) % 100 / 100})
        return cl.refine(scored, examples).select("id", "label", "confidence")


# ---- J -----------------------------------------------------------------------------------------------------------

PLACED = f"""placed AS (SELECT id, centro, linha, equipamento, tipo_parada, CASE WHEN {NORMAL} = '' THEN '__empty_' || CAST(id AS VARCHAR) ELSE {NORMAL} || {PLACE} END AS text FROM stops),
 tx AS (SELECT centro, linha, equipamento, tipo_parada, text, count(*) AS n FROM placed GROUP BY ALL)"""
TFIDF = """tok AS (SELECT b, text, list_filter(string_split_regex(text, '[^A-Z0-9_a-z]+'), lambda w: w <> '') AS w FROM src),
 grams AS (SELECT b, text, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM tok),
 tf AS (SELECT b, text, term, count(*) AS tf FROM grams GROUP BY ALL),
 size AS (SELECT b, count(*) AS n FROM src GROUP BY 1),
 dfs AS (SELECT b, term, count(*) AS df FROM tf GROUP BY ALL),
 raw AS (SELECT tf.b, text, tf.term, tf * (ln((1.0 + n) / (1.0 + df)) + 1) AS w FROM tf JOIN dfs ON dfs.b = tf.b AND dfs.term = tf.term JOIN size ON size.b = tf.b WHERE n > 1),
 wt AS (SELECT b, text, term, w / sqrt(sum(w * w) OVER (PARTITION BY b, text)) AS w FROM raw)"""
BUCKET = "src AS (SELECT centro || linha || equipamento || tipo_parada AS b, text, n FROM tx)"
JOINED = "WITH " + fx.CTE["stops"] + ", " + PLACED + ", " + BUCKET + ", " + TFIDF


def placed(spark, folder):
    """Stops with normal notes that vary by place, in contexts shared by all files."""
    stops = words.with_normal_notes(fx.stops(spark, folder), text.header_key(O), "note")
    return stops.withColumns({"observacao_normalizada": F.concat("note", F.expr(PLACE)), "analysis_id": F.lit("all"),
                              "subchave_parada": F.lit(""), "sistema": F.lit("")}).drop("note")


def placed_texts(spark, folder):
    return gr.distinct_texts(gr.with_context(placed(spark, folder)))


@query("j01_context_sizes", "WITH " + fx.CTE["stops"] + ", " + PLACED + " SELECT centro, linha, equipamento, tipo_parada, count(*) AS n FROM placed GROUP BY ALL")
def j01_context_sizes(spark, folder):
    keyed = gr.with_context(placed(spark, folder))
    first = F.min_by(F.struct("centro", "linha", "equipamento", "tipo_parada"), "id")
    return keyed.groupBy("bucket").agg(first.alias("f"), F.count(F.lit(1)).alias("n")).select("f.*", "n")


@query("j01_machine_columns", "WITH " + fx.CTE["stops"] + " SELECT DISTINCT centro AS unit, linha AS line, equipamento AS name FROM stops")
def j01_machine_columns(spark, folder):
    return gr.machine_columns(gr.with_context(placed(spark, folder))).select("unit", "line", "name")


@query("j02_distinct_texts", "WITH " + fx.CTE["stops"] + ", " + PLACED + " SELECT text, n FROM tx")
def j02_distinct_texts(spark, folder):
    return placed_texts(spark, folder).select("text", "n")


@query("j03_term_weights", JOINED + " SELECT text, term, round(w, 6) AS w, count(*) AS times FROM wt GROUP BY ALL")
def j03_term_weights(spark, folder):
    texts = placed_texts(spark, folder)
    weights = gr.text_terms(texts).select("vid", "term", F.round("w", 6).alias("w")).join(texts.select("vid", "text"), "vid")
    return weights.groupBy("text", "term", "w").agg(F.count(F.lit(1)).alias("times"))


NEG = "array_to_string(list_sort(list_filter(string_split({x}, ' '), lambda t: t IN ('NAO', 'SEM', 'NUNCA'))), ' ')"
PAIRS_SQL = ("""pr AS (SELECT a.b, a.text AS lo, c.text AS hi, sum(a.w * c.w) AS s FROM wt a JOIN wt c ON c.b = a.b AND c.term = a.term AND a.text < c.text
  WHERE """ + NEG.format(x="a.text") + " = " + NEG.format(x="c.text") + """ GROUP BY ALL HAVING sum(a.w * c.w) >= 0.8 - 1e-12)""")


@query("j04_similar_pairs", JOINED + ", " + PAIRS_SQL + " SELECT lo, hi, round(s, 6) AS similarity, count(*) AS times FROM pr GROUP BY ALL")
def j04_similar_pairs(spark, folder):
    texts = placed_texts(spark, folder)
    pairs = gr.similar_pairs(gr.text_vectors(texts, only_linkable=True))
    name = lambda end: texts.select(F.col("vid").alias(f"{end}_vid"), F.col("text").alias(end))
    named = pairs.withColumnsRenamed({"lo": "lo_vid", "hi": "hi_vid"}).join(name("lo"), "lo_vid").join(name("hi"), "hi_vid")
    return named.groupBy("lo", "hi", F.round("similarity", 6).alias("similarity")).agg(F.count(F.lit(1)).alias("times"))


@query("j05_negation_words", "WITH " + fx.CTE["stops"] + ", " + PLACED + " SELECT DISTINCT text, " + NEG.format(x="text") + " AS negated FROM tx")
def j05_negation_words(spark, folder):
    return placed_texts(spark, folder).select("text", gr.negation("text").alias("negated")).distinct()


# The grouping rules text by text: st holds the groups of a context after its first k texts, as lists of text numbers.
GREEDY = (PAIRS_SQL + """, numbered AS (SELECT b, text, n, row_number() OVER (PARTITION BY b ORDER BY text) AS i FROM src),
 near AS (SELECT x.b, y.i, list(x.i) AS l FROM pr JOIN numbered x ON x.b = pr.b AND x.text = pr.lo JOIN numbered y ON y.b = pr.b AND y.text = pr.hi GROUP BY x.b, y.i),
 st AS (SELECT b, 1 AS k, [[CAST(1 AS BIGINT)]] AS groups FROM numbered WHERE i = 1
  UNION ALL SELECT b, k + 1, CASE WHEN p IS NULL OR p = 0 THEN list_append(groups, [CAST(k + 1 AS BIGINT)])
    ELSE list_transform(groups, lambda g, i: CASE WHEN i = p THEN list_append(g, CAST(k + 1 AS BIGINT)) ELSE g END) END
   FROM (SELECT st.b, k, groups, list_position(list_transform(groups, lambda g: len(list_filter(g, lambda m: NOT list_contains(coalesce(l, []), m))) = 0), true) AS p
    FROM st JOIN numbered z ON z.b = st.b AND z.i = st.k + 1 LEFT JOIN near ON near.b = st.b AND near.i = st.k + 1) q),
 last AS (SELECT b, arg_max(groups, k) AS groups FROM st GROUP BY b),
 put AS (SELECT b, g, unnest(members) AS i FROM (SELECT b, unnest(groups) AS members, unnest(range(1, len(groups) + 1)) AS g FROM last) u),
 grp AS (SELECT put.b, g, text, n FROM put JOIN numbered USING (b, i)),
 vec AS (SELECT grp.b, g, wt.term, sum(n * w) AS s FROM grp JOIN wt ON wt.b = grp.b AND wt.text = grp.text GROUP BY ALL),
 len2 AS (SELECT b, g, sum(s * s) AS q FROM vec GROUP BY ALL),
 card AS (SELECT grp.b, grp.g, sum(n) AS size, count(*) AS texts, arg_min(text, (-n, length(text), text)) AS label FROM grp GROUP BY ALL),
 out AS (SELECT card.b, CASE WHEN label LIKE '\\_\\_empty\\_%' ESCAPE '\\' THEN upper('Descrição não informada') ELSE label END AS name, CAST(size AS BIGINT) AS size, texts,
  CASE WHEN texts = 1 THEN 1.0 ELSE round((q - size) / (size * (size - 1)), 4) END AS avg_similarity FROM card LEFT JOIN len2 ON len2.b = card.b AND len2.g = card.g)""")


@query("j10_cards")
def j10_cards(spark, folder):
    """Cards of the grouping under the hashes of their columns; j10_card_table compares all but the hash with SQL."""
    return gr.group_notes(placed(spark, folder))["cards"].select("column_id", "name", "size", "texts", "avg_similarity")


@query("j10_card_table", JOINED.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + GREEDY + """ SELECT centro, linha, equipamento, name, size, texts, avg_similarity, count(*) AS times
 FROM out JOIN (SELECT DISTINCT centro, linha, equipamento, centro || linha || equipamento || tipo_parada AS b FROM tx) c USING (b) GROUP BY ALL""")
def j10_card_table(spark, folder):
    grouped = gr.group_notes(placed(spark, folder))
    places = grouped["machines"].select("column_id", F.col("unit").alias("centro"), F.col("line").alias("linha"), F.col("name").alias("equipamento"))
    cards = grouped["cards"].select("column_id", F.upper("name").alias("name"), "size", "texts", "avg_similarity").join(places, "column_id")
    return cards.groupBy("centro", "linha", "equipamento", "name", "size", "texts", "avg_similarity").agg(F.count(F.lit(1)).alias("times"))


def proposed(spark, folder):
    records = placed(spark, folder).withColumns({"status": F.when(F.col("cluster_id") % 3 == 1, "confirmed").otherwise("pending"),
                                                 "canonical_failure_id": F.lit(None).cast("bigint")})
    return gr.propose_clusters(records)


@query("j09_cluster_proposals")
def j09_cluster_proposals(spark, folder):
    return proposed(spark, folder)["proposals"]


@query("j09_cluster_members", JOINED.replace("WITH ", "WITH RECURSIVE ", 1).replace("tipo_parada, CASE WHEN", "tipo_parada, cluster_id, CASE WHEN", 1).replace(
    "FROM placed GROUP BY ALL", "FROM placed WHERE cluster_id % 3 <> 1 GROUP BY ALL", 1) + ", " + GREEDY + """, of AS (SELECT p.id, grp.b, grp.g FROM placed p
  JOIN grp ON grp.b = p.centro || p.linha || p.equipamento || p.tipo_parada AND grp.text = p.text WHERE p.cluster_id % 3 <> 1)
 SELECT id AS record_id, min(id) OVER (PARTITION BY b, g) AS first_record, count(*) OVER (PARTITION BY b, g) AS size FROM of QUALIFY size >= 2""")
def j09_cluster_members(spark, folder):
    members = proposed(spark, folder)["members"]
    named = members.groupBy("cluster_id").agg(F.min("record_id").alias("first_record"), F.count(F.lit(1)).alias("size"))
    return members.join(named, "cluster_id").select("record_id", "first_record", "size")


DOCS = """src AS (SELECT lang || '/' || source AS b, upper(trim(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g'))) AS text, 1 AS n FROM documents
  GROUP BY ALL)"""


def documents(spark, folder):
    """Documents as notes: the context is language and source, the whole text is compared."""
    plain = F.upper(F.array_join(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), 0), " "))  # what is between takes Java's regex ten times as long to find
    return fx.table(spark, folder, "documents").select(
        F.lit("docs").alias("analysis_id"), F.col("doc_id").alias("id"), F.col("lang").alias("centro"), F.col("source").alias("linha"),
        F.lit("text").alias("equipamento"), F.lit("").alias("tipo_parada"), F.lit("").alias("subchave_parada"), F.lit("").alias("sistema"),
        plain.alias("observacao_normalizada"))


@query("j04_similar_documents", "WITH " + DOCS + ", " + TFIDF + ", " + PAIRS_SQL + """ SELECT md5(lo) AS lo, md5(hi) AS hi, round(s, 6) AS similarity, count(*) AS times
 FROM pr WHERE lo <> '' AND hi <> '' GROUP BY ALL""")
def j04_similar_documents(spark, folder):
    texts = gr.distinct_texts(gr.with_context(documents(spark, folder)))
    pairs = gr.similar_pairs(gr.text_vectors(texts, only_linkable=True))
    name = lambda end: texts.select(F.col("vid").alias(f"{end}_vid"), F.md5("text").alias(end))
    named = pairs.withColumnsRenamed({"lo": "lo_vid", "hi": "hi_vid"}).join(name("lo"), "lo_vid").join(name("hi"), "hi_vid")
    return named.groupBy("lo", "hi", F.round("similarity", 6).alias("similarity")).agg(F.count(F.lit(1)).alias("times"))


@query("j06_document_groups")
def j06_document_groups(spark, folder):
    """Near-copies grouped per (language, source) over whole texts."""
    return gr.group_notes(documents(spark, folder))["cards"].select("card_id", "size", "texts", "avg_similarity")

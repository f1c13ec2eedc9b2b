"""Rule classification of notes with reasons (K2-K12), card votes (K8, K9) and the model's second opinion."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stoplens import fixed_values as fv
from stoplens.functions import text
from stoplens.operators import words
from stoplens.operators.catalog import Catalog
from stoplens.operators.skew import lookup_join
from stoplens.session import cut_lineage, staged


def _position(padded: Column, terms: Column) -> Column:
    """Earliest 0-based position of any word-prefix term, null when none occurs."""
    found = F.filter(F.transform(terms, lambda t: F.call_function("instr", padded, F.concat(F.lit(" "), t))), lambda p: p > 0)
    return F.array_min(found) - 1


def _occurs(padded: Column, terms: Column) -> Column:
    return F.exists(terms, lambda t: F.contains(padded, F.concat(F.lit(" "), t)))


def explain(pairs: DataFrame, catalog: Catalog | None = None) -> DataFrame:
    """K2-K7 for a table of (observacao_raw, equipamento): label, confidence, source, reason, detail, candidates.

    Notes match by word prefix after word repair, which distinct notes and words go through once. A rule wins first
    (earliest position); otherwise the earliest component or process, components before processes, catalog order last.
    The rest is one native projection: the catalog is a bounded constant.
    """
    catalog = catalog or Catalog()
    normal = text.catalog_text("observacao_raw")
    df = pairs.withColumn("_norm", normal)
    notes = staged(df.select("_norm").distinct(), "catalog-notes")
    fixed = words.repaired_texts(notes.where("_norm IS NOT NULL"), "_norm", words.catalog_repair(catalog.vocabulary())).withColumnRenamed("repaired", "_fixed_words")
    df = lookup_join(df, staged(fixed, "catalog-repairs"), ["_norm"])
    df = df.withColumn("_words", F.split("_norm", " "))
    df = df.withColumns({"_fixed": F.array_join("_fixed_words", " "), "_machine": F.concat(F.lit(" "), text.catalog_text("equipamento"))})
    df = df.withColumns({"_text": F.concat(F.lit(" "), "_fixed"), "_plain": F.concat(F.lit(" "), "_norm")})

    def hit(c: Column) -> Column:
        free = (F.size(c["co_terms"]) == 0) & (F.size(c["machine_terms"]) == 0)
        allowed = free | _occurs(F.col("_text"), c["co_terms"]) | _occurs(F.col("_machine"), c["machine_terms"])
        rank = F.when(c["kind"] == "regra", 0).when(c["kind"] == "componente", 1).otherwise(2)
        return F.struct(_position(F.col("_text"), c["terms"]).alias("pos"), rank.alias("rank"), c["ord"].alias("ord"),
                        c["kind"].alias("kind"), c["label"].alias("label"), c["terms"].alias("terms"), allowed.alias("ok"))

    hits = F.filter(F.transform(catalog.column(), hit), lambda h: h["pos"].isNotNull() & h["ok"])
    df = df.withColumn("_hits", hits)
    rules = F.filter("_hits", lambda h: h["rank"] == 0)
    df = df.withColumn("_win", F.when(F.size(rules) > 0, F.array_min(rules)).otherwise(F.array_min("_hits")))
    df = df.withColumn("candidates", F.when(F.col("_win.rank") == 0, F.array().cast("array<string>")).otherwise(
        F.array_sort(F.array_distinct(F.transform(F.filter("_hits", lambda h: h["ord"] != F.col("_win.ord")), lambda h: h["label"])))))

    # The words of the winning term as the operator wrote them.
    first_term = F.element_at(F.filter("_win.terms", lambda t: F.contains(F.col("_text"), F.concat(F.lit(" "), t))), 1)
    start = F.size(F.split(F.expr("substr(_text, 1, instr(_text, concat(' ', _term)))"), " ")) - 1
    df = df.withColumn("_term", first_term)
    df = df.withColumn("_term_words", F.lower(F.array_join(F.slice("_words", F.greatest(start, F.lit(1)), F.size(F.split("_term", " "))), " ")))
    repaired = (F.col("_fixed") != F.col("_norm")) & ~_occurs(F.col("_plain"), F.col("_win.terms"))
    df = df.withColumn("_repaired", F.coalesce(repaired, F.lit(False)))

    others = F.slice(F.transform("candidates", lambda c: F.lower(c)), 1, 3)
    also = F.when(F.size("candidates") > 0, F.concat(F.lit("; também cita "), F.array_join(others, ", "))).otherwise(F.lit(""))
    typo = F.when(F.col("_repaired"), F.lit(" (com correção de digitação)")).otherwise(F.lit(""))
    silent = (F.col("_norm") == "") | ~text.is_meaningful("_norm")
    none = F.col("_win").isNull()
    is_rule, is_component = F.col("_win.rank") == 0, F.col("_win.rank") == 1
    label = F.when(silent, fv.NO_NOTE).when(none, fv.NO_MODE).when(
        is_component, F.concat(F.lit("FALHA DE "), F.col("_win.label"))).otherwise(F.col("_win.label"))
    unsure = F.col("_repaired") | (~is_rule & (F.size("candidates") > 0))
    opening = F.when(is_rule, F.lit("Regra específica do catálogo: ")).when(is_component, F.lit("Componente citado: "))\
        .otherwise(F.lit("Processo citado: "))
    reason = F.when(silent, "Relato vazio ou só com o número da ordem.").when(none, "Nenhum termo do catálogo no relato.")\
        .otherwise(F.concat(opening, "_term_words", F.when(is_rule, F.lit("")).otherwise(also), typo, F.lit(".")))
    return df.select(
        *pairs.columns, label.alias("label"),
        F.when(silent | none, "baixa").when(unsure, "media").otherwise("alta").alias("confidence"),
        F.when(silent | none, "nenhum").otherwise(F.col("_win.kind")).alias("source"), reason.alias("reason"),
        F.when(~silent & ~none & is_component, _manifestation(catalog)).otherwise(F.lit("")).alias("detail"),
        F.when(silent | none, F.array().cast("array<string>")).otherwise(F.col("candidates")).alias("candidates"))


def _manifestation(catalog: Catalog) -> Column:
    """K7: a manifestation belongs to the component nearest to it, within 22 characters; '' when none does.

    Of two components equally near, the one that follows is taken.
    """
    components = F.transform(F.filter("_hits", lambda h: h["rank"] == 1), lambda h: h["pos"])
    own = F.col("_win.pos")
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("_text"))),
                      lambda i: F.substring(F.col("_text"), i, F.lit(1)) == " ")

    def belongs(i: Column) -> Column:
        at = i - 1
        nearer = F.exists(components, lambda c: (F.abs(c - at) < F.abs(own - at))
                          | ((F.abs(c - at) == F.abs(own - at)) & (c >= at) & (own < at)))
        return (F.abs(own - at) <= fv.MANIFESTATION_REACH) & ~nearer

    out = None
    for name, terms in catalog.manifestations.items():
        shown = F.exists(starts, lambda i: F.exists(
            F.array(*[F.lit(t) for t in terms]), lambda t: F.substring(F.col("_text"), i + 1, F.length(t)) == t) & belongs(i))
        out = F.when(shown, F.lit(name.lower())) if out is None else out.when(shown, F.lit(name.lower()))
    return F.lit("") if out is None else out.otherwise(F.lit(""))


def classify(stops: DataFrame, catalog: Catalog | None = None, memory: DataFrame | None = None) -> DataFrame:
    """K10 + D12: classify every distinct (note, machine) once; the analyst's memory beats the catalog.

    Notes are keyed by their catalog text, so order numbers do not multiply them. Distinct pairs come from a partial aggregation, and their answers return through a join that spreads hot notes.
    """
    keyed = staged(stops.withColumns({"_note": text.catalog_text("observacao_raw"), "_machine": text.catalog_text("equipamento")}), "classified-stops")
    pairs = keyed.select(F.col("_note").alias("observacao_raw"), F.col("_machine").alias("equipamento")).distinct()
    answers = explain(pairs, catalog).withColumn("memory_key", text.memory_key("observacao_raw"))
    if memory is not None:
        known = memory.select(F.col("note_key").alias("memory_key"), F.col("label").alias("_label"), F.col("count").alias("_times"))
        hit = F.col("_label").isNotNull()
        said = F.concat(F.lit("Mesmo relato já corrigido pelo analista ("), F.col("_times").cast("string"), F.lit("x)."))
        answers = lookup_join(answers, known, ["memory_key"]).withColumns({
            "label": F.coalesce("_label", "label"), "confidence": F.when(hit, "alta").otherwise(F.col("confidence")),
            "source": F.when(hit, "memoria").otherwise(F.col("source")), "reason": F.when(hit, said).otherwise(F.col("reason")),
            "detail": F.when(hit, "").otherwise(F.col("detail"))}).drop("_label", "_times")
    # One aggregate over the already partitioned pairs keeps later filters on the answer from being rewritten into
    # copies of the whole classification expression.
    answers = answers.drop("memory_key", "candidates").withColumnsRenamed({"observacao_raw": "_note", "equipamento": "_machine"})
    value = [c for c in answers.columns if c not in ("_note", "_machine")]
    answers = answers.groupBy("_note", "_machine").agg(F.first(F.struct(*value)).alias("_answer")).select("_note", "_machine", "_answer.*")
    return lookup_join(keyed, answers, ["_note", "_machine"]).drop("_note", "_machine")


def test_catalog(texts: DataFrame, machine: str, catalog: Catalog) -> DataFrame:
    """Class, confidence and reason of trial notes (observacao_raw)."""
    return explain(texts.withColumn("equipamento", F.lit(machine)), catalog).select("observacao_raw", "label", "confidence", "reason")


def refine(answers: DataFrame, examples: int) -> DataFrame:
    """Combine the catalog's answer with the model's (columns ``model_label`` and ``probability``).

    Unknown notes take the model's class from 0.6 (alta from 0.92) when they carry a signal word. The same class at
    0.7 raises media to alta. Another class wins from 0.6 once the model has 200 examples (alta from 0.9); below
    that, from 0.75, it only marks doubt. Memory hits and empty notes are never changed.
    """
    p, model, label = F.col("probability"), F.col("model_label"), F.col("label")
    percent = F.concat(F.format_number(p * 100, 0), F.lit("%"))
    immune = model.isNull() | (F.col("source") == "memoria") | (label == fv.NO_NOTE)
    learned = ~immune & (label == fv.NO_MODE) & (p >= 0.6) & (F.size(text.signal_words("observacao_raw")) >= 1)
    known = ~immune & (label != fv.NO_MODE)
    confirmed = known & (model == label) & (F.col("confidence") == "media") & (p >= 0.7)
    won = known & (model != label) & (p >= fv.MODEL_WINS) & F.lit(examples >= fv.MATURE_EXAMPLES)
    doubted = known & (model != label) & ~won & (p >= 0.75)
    lower = lambda c: F.lower(text.display_label(c))
    return answers.withColumns({
        "suggestion": F.when(won, label).when(doubted, model).otherwise(F.lit("")),
        "reason": F.when(learned, F.concat(F.lit("O catálogo não reconheceu; o aprendizado reconheceu pelo contexto de "
                                                 "relatos já validados ("), percent, F.lit(" de certeza).")))
        .when(confirmed, F.concat("reason", F.lit(" O aprendizado confirma ("), percent, F.lit(").")))
        .when(won, F.concat(F.lit("O aprendizado reconheceu pelo histórico validado ("), percent,
                            F.lit(" de certeza); o catálogo sugeria "), lower(label), F.lit(".")))
        .when(doubted, F.concat("reason", F.lit(" Pelo histórico validado, parece "), lower(model), F.lit(" ("), percent, F.lit(").")))
        .otherwise(F.col("reason")),
        "confidence": F.when(learned, F.when(p >= 0.92, "alta").otherwise("media")).when(confirmed, "alta")
        .when(won, F.when(p >= 0.9, "alta").otherwise("media")).when(doubted, "media").otherwise(F.col("confidence")),
        "source": F.when(learned | won, "aprendizado").otherwise(F.col("source")),
        "label": F.when(learned | won, model).otherwise(label),
    })


# ---- K8, K9: cards ------------------------------------------------------------------------------------------------

def _most_common(profile: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Most frequent non-empty value per key, the one seen first among equals."""
    counted = profile.filter(F.col(value) != "").groupBy(*keys, value).agg(F.sum("n").alias("_n"), F.min("seen").alias("_seen"))
    return counted.groupBy(*keys).agg(F.max_by(value, F.struct("_n", -F.col("_seen"))).alias(value))


def card_votes(classified: DataFrame, card_members: DataFrame) -> DataFrame:
    """K8: majority class of every card with confidence, reason, agreement, source, detail and suggestion.

    Ties go to an identified class, then to the larger label. The stops are first counted by (card, answer), with
    partial sums before the shuffle, so a card holding a third of all stops is counted in parallel; all votes are
    read from that small table.
    """
    key, answer = ["analysis_id", "card_id"], ["label", "confidence", "reason", "source", "detail", "suggestion"]
    if "suggestion" not in classified.columns:
        classified = classified.withColumn("suggestion", F.lit(""))
    placed = classified.select("analysis_id", "id", *answer).join(
        card_members.select("analysis_id", F.col("record_id").alias("id"), "card_id"), ["analysis_id", "id"])
    profile = cut_lineage(placed.groupBy(*key, *answer).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("seen")))
    by_label = profile.groupBy(*key, "label").agg(F.sum("n").alias("n"), F.bool_and(F.col("confidence") == "alta").alias("sure"))
    identified = F.when(F.col("label").isin(fv.UNCLASSIFIED), 0).otherwise(1)
    best = by_label.groupBy(*key).agg(
        F.max_by(F.struct("label", "n", "sure"), F.struct("n", identified, "label")).alias("w"), F.sum("n").alias("total"))
    out = best.select(*key, F.col("w.label").alias("label"), F.col("w.n").alias("votes"), F.col("w.sure").alias("sure"), "total")
    chosen = profile.join(out.select(*key, "label"), [*key, "label"], "left_semi")
    for value in ("reason", "source", "detail", "suggestion"):
        out = out.join(_most_common(chosen, key, value), key, "left")
    agreement = F.col("votes") / F.col("total")
    tail = F.concat(F.lit(" "), F.col("votes").cast("string"), F.lit(" de "), F.col("total").cast("string"),
                    F.lit(" apontamentos apontam para esta classe."))
    return out.select(
        *key, "label", F.when(F.col("label").isin(fv.UNCLASSIFIED), "baixa").when((agreement < 0.75) | ~F.col("sure"), "media")
        .otherwise("alta").alias("confidence"),
        F.when(agreement < 1, F.concat("reason", tail)).otherwise(F.col("reason")).alias("reason"),
        F.round(agreement, 3).alias("agreement"), "source", F.coalesce("detail", F.lit("")).alias("detail"),
        F.coalesce("suggestion", F.lit("")).alias("suggestion"))


def final_class(manual: Column, frozen: Column, validated: Column, automatic: Column) -> Column:
    """K9: the analyst's class, the class frozen at validation, else the automatic one."""
    blank = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(blank(manual), F.when(validated, blank(frozen)), automatic)


def class_list(catalog: Catalog, *tables: DataFrame) -> DataFrame:
    """H4: catalog classes and every label in use (each table has a ``label``), unclassified ones last."""
    spark = tables[0].sparkSession
    names = spark.createDataFrame([(c,) for c in catalog.labels()], "label string")
    for table in tables:
        names = names.unionByName(table.select("label").distinct())
    last = F.when(F.col("label") == fv.NO_NOTE, 1).when(F.col("label") == fv.NO_MODE, 2).otherwise(0)
    return names.filter("label <> ''").distinct().orderBy(last, "label")


# ---- K11: correction memory -------------------------------------------------------------------------------------------

def fold_memory(corrections: DataFrame) -> DataFrame:
    """Memory after a log of corrections (note_key, seq, label; null label forgets the note).

    The last correction decides; its count is how many corrections in a row gave that label. Computed with
    aggregations only: the last differing correction bounds the final run.
    """
    corrections = staged(corrections.select("note_key", "seq", "label").filter("note_key <> ''"), "corrections")  # read three times below
    last = corrections.groupBy("note_key").agg(F.max_by(F.struct("label", "seq"), "seq").alias("_last"))
    last = last.select("note_key", F.col("_last.label").alias("label"), F.col("_last.seq").alias("last_seq"))
    joined = lookup_join(corrections.select("note_key", "seq", F.col("label").alias("_said")), last, ["note_key"], "inner")
    broken = joined.filter(~F.col("_said").eqNullSafe(F.col("label"))).groupBy("note_key").agg(F.max("seq").alias("_broken"))
    runs = lookup_join(joined, broken, ["note_key"]).filter(F.col("_broken").isNull() | (F.col("seq") > F.col("_broken")))
    return runs.groupBy("note_key", "label", "last_seq").agg(F.count(F.lit(1)).alias("count")).filter(F.col("label").isNotNull())\
        .select("note_key", "label", "count", "last_seq")

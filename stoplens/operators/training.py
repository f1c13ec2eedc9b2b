"""Training examples: cleaning of labelled notes, label merging, class mapping, weights."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stoplens import fixed_values as fv
from stoplens.functions import text, tokens
from stoplens.operators.catalog import Catalog
from stoplens.operators.classify import explain
from stoplens.operators.skew import lookup_join
from stoplens.session import cut_lineage, staged


def merge_labels(keys: DataFrame) -> DataFrame:
    """L2: (label_key, merged) where labels almost equal share the most frequent one. A key may stand for ``n`` rows.

    Labels are taken by (frequency desc, key). One whose canonical words equal an earlier label's joins that label's
    group; otherwise it joins the earliest group representative with ratio >= 0.88, else it represents a new group.
    Candidate pairs come from an exact prefix filter over characters (a ratio of 0.88 needs that share of common
    characters); the sequential choice is the fixed point of a set-based update.
    """
    size = F.sum("n") if "n" in keys.columns else F.count(F.lit(1))
    counted = keys.groupBy("label_key").agg(size.alias("n")).withColumn("canon", text.label_canon("label_key"))
    nodes = counted.groupBy("canon").agg(F.min_by(F.struct("label_key", "n"), F.struct(-F.col("n"), F.col("label_key"))).alias("f"))
    nodes = cut_lineage(nodes.select("canon", F.col("f.label_key").alias("first"), F.col("f.n").alias("n")))

    least = fv.LABEL_SIMILARITY / (2 - fv.LABEL_SIMILARITY)
    letters = nodes.filter("canon <> ''").select("canon", F.explode(F.split("canon", "")).alias("c")).filter("c <> ''")
    nth = Window.partitionBy("canon", "c").orderBy("c")
    marks = letters.withColumn("mark", F.concat("c", F.row_number().over(nth).cast("string"))).select("canon", "mark")
    rare = marks.groupBy("mark").agg(F.count(F.lit(1)).alias("df"))
    ranked = marks.join(rare, "mark").withColumn("r", F.row_number().over(Window.partitionBy("canon").orderBy("df", "mark")))
    keep = F.length("canon") - F.ceil(F.length("canon") * least) + 1
    prefix = ranked.filter(F.col("r") <= keep).select("mark", "canon")
    side = lambda s: prefix.select("mark", F.col("canon").alias(f"{s}_canon"))
    shorter, longer = F.least(F.length("a_canon"), F.length("b_canon")), F.length("a_canon") + F.length("b_canon")
    pairs = side("a").join(side("b").hint("merge"), "mark").filter(
        (F.col("a_canon") != F.col("b_canon")) & (2 * shorter >= fv.LABEL_SIMILARITY * longer)).select("a_canon", "b_canon").distinct()
    rank = lambda s: nodes.select(F.col("canon").alias(f"{s}_canon"), F.struct(-F.col("n"), F.col("first")).alias(f"{s}_rank"))
    later = lookup_join(lookup_join(pairs, rank("a"), ["a_canon"], "inner"), rank("b"), ["b_canon"], "inner").filter("b_rank < a_rank")
    edges = cut_lineage(later.withColumn("ratio", tokens.string_ratio(F.col("a_canon"), F.col("b_canon")))
                        .filter(F.col("ratio") >= fv.LABEL_SIMILARITY).select("a_canon", "b_canon", "b_rank"))

    state = cut_lineage(nodes.select("canon", F.col("canon").alias("target")))
    while True:
        heads = state.filter("canon = target").select(F.col("canon").alias("b_canon"))
        best = edges.join(heads, "b_canon", "left_semi").groupBy(F.col("a_canon").alias("canon")).agg(F.min_by("b_canon", "b_rank").alias("best"))
        step = cut_lineage(state.join(best, "canon", "left").select("canon", F.coalesce("best", "canon").alias("target"),
                                                                    F.col("target").alias("old")))
        state = step.select("canon", "target")
        if step.filter("target <> old").isEmpty():
            break
    named = lookup_join(state, nodes.select(F.col("canon").alias("target"), "first"), ["target"], "inner").select(
        "canon", F.col("first").alias("merged"))
    return lookup_join(counted.select("label_key", "canon"), named, ["canon"], "inner").select("label_key", "merged")


def clean_labelled(labelled: DataFrame) -> DataFrame:
    """L1: labelled notes (note, label, seq) with their model text, label key and why they are dropped."""
    rows = labelled.withColumns({"norm": text.model_text("note"), "label_key": text.plain_text("label")})
    return rows.withColumn("dropped", F.when(~text.has_content("norm"), "sem_conteudo").when(
        (F.col("label_key") == "") | text.is_no_info_label("label_key"), "rotulo_sem_informacao"))


def prepare(labelled: DataFrame, analyst: DataFrame | None = None, catalog: Catalog | None = None) -> dict[str, DataFrame]:
    """One example per note and the counts of every cleaning step.

    ``analyst`` (relato, relato_norm, classe, detalhe) replaces what the labelled files say about the same note. Rows of
    one label whose notes differ in long numbers only are counted first, so each such note is cleaned once.
    """
    alike = labelled.groupBy(text.without_long_numbers("note").alias("_note"), "label").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("seq", "note")).alias("first"))
    cleaned = staged(clean_labelled(alike.withColumnRenamed("_note", "note")), "cleaned-notes")
    kept = cleaned.filter("dropped IS NULL").select("label", "n", "first", "norm", "label_key")
    kept = cut_lineage(lookup_join(kept, cut_lineage(merge_labels(kept)), ["label_key"], "inner").withColumnRenamed("merged", "group"))
    spelled = kept.groupBy("group", "label").agg(F.sum("n").alias("n"))
    display = spelled.groupBy("group").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("detail"))
    pairs = kept.groupBy("norm", "group").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    overall = pairs.groupBy("group").agg(F.sum("n").alias("overall"))
    per_note = lookup_join(pairs, overall, ["group"], "inner").groupBy("norm").agg(
        F.max_by("group", F.struct("n", "overall", "group")).alias("group"), F.sum("n").alias("weight"),
        F.count(F.lit(1)).alias("options"), F.min("first").alias("first"))
    said = analyst if analyst is not None else kept.sparkSession.createDataFrame([], "relato string, relato_norm string, classe string, detalhe string")
    said = said.filter("relato_norm <> ''")
    marked = cut_lineage(per_note.join(said.select(F.col("relato_norm").alias("norm"), F.lit(True).alias("replaced")), "norm", "left"))
    chosen = marked.filter("replaced IS NULL")
    groups = lookup_join(chosen.groupBy("group").agg(F.sum("weight").alias("group_size")), display, ["group"], "inner")
    by_label = explain(groups.select(F.col("detail").alias("observacao_raw"), F.lit("").alias("equipamento"), "group", "group_size"), catalog)
    by_label = cut_lineage(by_label.select("group", "group_size", F.col("observacao_raw").alias("shown"), F.col("label").alias("label_class")))
    notes = chosen.select("norm", "group", "weight", F.col("first.note").alias("raw"))
    joined = lookup_join(notes, by_label, ["group"], "inner")
    by_note = cut_lineage(explain(joined.select(F.col("raw").alias("observacao_raw"), F.lit("").alias("equipamento"), *[
        c for c in joined.columns if c != "raw"]), catalog))
    own = F.col("group_size") >= fv.MIN_OWN_CLASS
    unknown = lambda c: F.col(c).isin(fv.UNCLASSIFIED)
    how = F.when(~unknown("label_class"), "rotulo").when(~unknown("label"), "relato").when(own, "classe_propria").otherwise("so_detalhe")
    folder = by_note.withColumn("how", how).select(
        F.col("norm").alias("text"), F.col("observacao_raw").alias("raw"),
        F.when(F.col("how") == "rotulo", F.col("label_class")).when(F.col("how") == "relato", F.col("label"))
        .when(F.col("how") == "classe_propria", text.class_label("shown")).alias("cls"),
        F.col("shown").alias("detail"), F.col("weight").cast("double").alias("weight"), F.lit("pasta").alias("source"), "how")
    reviewed = said.select(F.col("relato_norm").alias("text"), F.coalesce("relato", "relato_norm").alias("raw"), text.class_label("classe").alias("cls"),
                           F.coalesce("detalhe", F.lit("")).alias("detail"), F.lit(float(fv.ANALYST_WEIGHT)).alias("weight"),
                           F.lit("analista").alias("source"), F.lit("analista").alias("how"))
    examples = folder.unionByName(reviewed)
    one = lambda df: F.broadcast(df)
    lost = lambda why: F.coalesce(F.sum(F.when(F.col("dropped") == why, F.col("n"))), F.lit(0)).alias(why)
    counts = cleaned.agg(lost("sem_conteudo"), lost("rotulo_sem_informacao"))
    counts = counts.join(one(kept.agg(F.countDistinct("label_key").alias("rotulos_antes"), F.countDistinct("group").alias("rotulos_depois"))))
    counts = counts.join(one(pairs.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicadas"))))
    counts = counts.join(one(marked.agg(F.count_if(F.col("options") > 1).alias("conflitos"), F.count_if("replaced").alias("substituidos_pelo_analista"))))
    is_ = lambda h, n: F.count_if(F.col("how") == h).alias(n)
    counts = counts.join(one(examples.agg(is_("rotulo", "classe_pelo_rotulo"), is_("relato", "classe_pelo_relato"), is_("classe_propria", "classe_propria"),
                                          is_("so_detalhe", "so_detalhe"), is_("analista", "do_analista"), F.count(F.lit(1)).alias("exemplos"),
                                          F.count("cls").alias("exemplos_com_classe"))))
    return {"examples": examples, "counts": counts}


def board_examples(validated: DataFrame, memory: DataFrame, sheets: DataFrame) -> DataFrame:
    """(text, machine, label, weight) for the board model.

    ``validated`` stops (observacao_raw, machine, label, manual, seq) weigh 3 when a person chose the class, else 1,
    the largest weight per note and machine with its latest label; sheets weigh 2, memory 3. Unclassified labels and
    notes without meaning are left out.
    """
    good = lambda df: df.filter((F.col("key") != "") & (F.coalesce("label", F.lit("")) != "") & ~F.col("label").isin(fv.UNCLASSIFIED))
    v = good(validated.withColumns({"key": text.memory_key("observacao_raw"), "place": text.catalog_text("machine")}))
    v = v.groupBy("key", "place").agg(F.max_by(F.struct(F.col("observacao_raw").alias("text"), "machine", "label"), "seq").alias("e"),
                                      F.max(F.when(F.col("manual"), 3).otherwise(1)).alias("weight")).select("e.*", "weight")
    s = good(sheets.withColumn("key", text.memory_key("text")))
    s = s.groupBy("key").agg(F.max_by(F.struct("text", "label"), "seq").alias("e")).select(
        "e.text", F.lit("").alias("machine"), "e.label", F.lit(2).alias("weight"))
    m = good(memory.withColumn("key", F.col("note_key"))).select(F.col("key").alias("text"), F.lit("").alias("machine"), "label", F.lit(3).alias("weight"))
    return v.unionByName(s).unionByName(m)

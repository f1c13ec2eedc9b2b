"""Text models on Spark ML (L7-L15, L18-L20): hashed n-gram features, training, scoring, evaluation, nearest detail.

Nothing whole passes the driver: features are hashed (2^17 slots, so the idf table has a fixed bound), the solvers
aggregate gradients on the executors over the slots that occur, and only class names and coefficients come back.
"""

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stoplens import fixed_values as fv
from stoplens.functions import calc, text
from stoplens.operators import linear
from stoplens.operators.grouping import dot
from stoplens.operators.skew import lookup_join, running_total
from stoplens.session import cut_lineage, shuffle_partitions, staged

BLOCK = 1 << 16
POOL_CHUNK = 2000


def _words(value: Column, shortest: int) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(value), F.lit(r"(?U)\w+"), 0), lambda w: F.length(w) >= shortest)


def _pairs(words: Column) -> Column:
    """Neighbouring words of a word column (a column, not an expression: it is looked up once per word)."""
    return F.transform(F.slice(words, 1, F.greatest(F.lit(0), F.size(words) - 1)), lambda w, i: F.concat(w, F.lit(" "), F.get(words, i + 1)))


def _char_grams(value: Column) -> Column:
    """3-5 letter pieces of each word padded with one space; a piece length beyond the word is used once."""
    words = F.filter(F.split(F.lower(value), r"\s+"), lambda w: w != "")

    def pieces(w: Column) -> Column:
        padded = F.concat(F.lit(" "), w, F.lit(" "))
        of = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(padded) - n + 1)), lambda i: F.substring(padded, i, F.lit(n)))
        none = F.array().cast("array<string>")
        return F.concat(of(3), F.when(F.length(padded) > 3, of(4)).otherwise(none), F.when(F.length(padded) > 4, of(5)).otherwise(none))
    return F.flatten(F.transform(words, pieces))


def digest(value: Column | str = "text") -> Column:
    """Key of a text inside the feature tables, so that whole texts are not repeated per feature."""
    return F.md5(F.col(value) if isinstance(value, str) else value)


def feature_counts(rows: DataFrame, shortest: int = 1) -> DataFrame:
    """Sublinear counts (digest, slot, tf) of word 1-2-grams and character pieces; MAQ_ words make no pieces."""
    slot = lambda offset: lambda g: (F.pmod(F.xxhash64(g), F.lit(BLOCK)) + offset).cast("int")
    worded = rows.select("text", digest().alias("digest")).dropDuplicates(["digest"])\
        .repartition(shuffle_partitions(rows), "digest").select("text", "digest", _words(F.col("text"), shortest).alias("_words"))
    grams = F.concat(F.transform(F.concat("_words", _pairs(F.col("_words"))), slot(0)),
                     F.transform(_char_grams(text.text_only("text")), slot(BLOCK)))
    slotted = worded.select("digest", grams.alias("_slots"))
    exploded = slotted.select("digest", F.explode("_slots").alias("slot"))
    return exploded.groupBy("digest", "slot").agg((F.log(F.count(F.lit(1)).cast("double")) + 1).alias("tf"))


def fit_idf(counts: DataFrame) -> DataFrame:
    """idf = ln((1 + n) / (1 + df)) + 1 per slot, and the slot's ``place`` among those that occur: at most 2^17 rows,
    written once."""
    total = counts.agg(F.countDistinct("digest").alias("n"))
    df = counts.groupBy("slot").agg(F.count(F.lit(1)).alias("df"))
    place = F.row_number().over(Window.orderBy("slot")) - 1
    return cut_lineage(df.join(F.broadcast(total)).select("slot", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"), place.alias("place")))


def weights(counts: DataFrame, idf: DataFrame) -> DataFrame:
    """tf * idf, each block of a text scaled to length one; slots unseen in training are dropped."""
    raw = counts.join(F.broadcast(idf.select("slot", "idf")), "slot").withColumn("raw", F.col("tf") * F.col("idf"))
    block = Window.partitionBy("digest", F.col("slot") >= BLOCK)
    return raw.select("digest", "slot", (F.col("raw") / F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(block))).alias("w"))


def entries(weighed: DataFrame, idf: DataFrame) -> DataFrame:
    """(digest, entries): the weights of a text by the place of their slots in the idf table."""
    placed = weighed.join(F.broadcast(idf.select("slot", "place")), "slot")
    return placed.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("place", "w"))).alias("entries"))


def vectors(weighed: DataFrame, idf: DataFrame, size: int) -> DataFrame:
    """Sparse vectors over the ``size`` slots of the idf table, so that solvers hold no coefficient that no text has."""
    build = F.udf(lambda held: Vectors.sparse(size, [(e[0], e[1]) for e in held]), VectorUDT())
    return entries(weighed, idf).select("digest", build("entries").alias("features"))


class TextModel:
    """A fitted text classifier: idf table, linear model and class names."""

    def __init__(self, idf: DataFrame, model, labels: list[str], shortest: int, examples: int):
        self.idf, self.model, self.labels, self.shortest, self.examples = idf, model, labels, shortest, examples

    def features(self, texts: DataFrame, counts: DataFrame | None = None) -> DataFrame:
        """Vectors of the texts; ``counts`` holds their feature counts already, maybe among others'."""
        own = feature_counts(texts, self.shortest) if counts is None else counts.join(texts.select(digest().alias("digest")).distinct(), "digest", "left_semi")
        return vectors(weights(own, self.idf), self.idf, self.model.numFeatures)

    def score(self, texts: DataFrame, temperature: float | None = None, counts: DataFrame | None = None) -> DataFrame:
        """(digest, probabilities): the model's own, or the softmax of margins / temperature."""
        scored = self.model.transform(self.features(texts, counts))
        if temperature is None:
            return scored.select("digest", vector_to_array("probability").alias("p"))
        return scored.select("digest", softmax(vector_to_array("rawPrediction"), temperature).alias("p"))

    def predict(self, texts: DataFrame, temperature: float | None = None, counts: DataFrame | None = None) -> DataFrame:
        """Class, confidence, band and the three likeliest classes of every distinct text."""
        names = F.array(*[F.lit(n) for n in self.labels])
        scored = self.score(texts, temperature, counts)
        ranked = F.slice(F.reverse(F.array_sort(F.transform("p", lambda p, i: F.struct(p.alias("p"), (-i).alias("i"))))), 1, 3)
        top = scored.select("digest", F.transform(ranked, lambda e: F.struct(F.get(names, -e["i"]).alias("classe"), e["p"].alias("confianca"))).alias("top3"))
        best = F.element_at("top3", 1)
        named = texts.select("text", digest().alias("digest")).dropDuplicates(["digest"])
        return named.join(top, "digest").select("text", best["classe"].alias("classe"), best["confianca"].alias("confianca"), calc.band(best["confianca"]).alias("faixa"), "top3")


class SheetTextModel(TextModel):
    """One-vs-rest linear SVM; ``model`` holds the weights (classes, slots + 1)."""

    def score(self, texts: DataFrame, temperature: float | None = None, counts: DataFrame | None = None) -> DataFrame:
        own = feature_counts(texts, self.shortest) if counts is None else counts.join(texts.select(digest().alias("digest")).distinct(), "digest", "left_semi")
        rows = entries(weights(own, self.idf), self.idf)
        rows = texts.select(digest().alias("digest")).distinct().join(rows, "digest", "left")  # a text without known slots has the constant terms
        rows = rows.withColumn("entries", F.coalesce("entries", F.array().cast("array<struct<place:int,w:double>>")))
        return linear.score_svm(rows, self.model).select("digest", softmax(F.col("margins"), temperature or fv.SOFTMAX_TEMPERATURE).alias("p"))


def softmax(scores: Column, temperature: float = fv.SOFTMAX_TEMPERATURE) -> Column:
    """L10."""
    raised = F.transform(scores, lambda s: F.exp((s - F.array_max(scores)) / temperature))
    total = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raised, lambda x: x / total)


def _fit(examples: DataFrame, solver, shortest: int, count: int, counts: DataFrame | None = None) -> TextModel:
    """examples(text, label, weight); repeated texts share one vector. ``counts``: feature counts that hold theirs."""
    if counts is None:
        counts = cut_lineage(feature_counts(examples, shortest))
    else:
        counts = cut_lineage(counts.join(examples.select(digest().alias("digest")).distinct(), "digest", "left_semi"))
    idf = fit_idf(counts)
    indexer = StringIndexer(inputCol="label", outputCol="index", stringOrderType="alphabetAsc").fit(examples)
    data = cut_lineage(indexer.transform(examples.withColumn("digest", digest())).join(vectors(weights(counts, idf), idf, idf.count()), "digest").select("features", "index", "weight"))
    return TextModel(idf, solver.fit(data), list(indexer.labels), shortest, count)


def train_board_model(examples: DataFrame) -> TextModel | None:
    """Weighted multiclass logistic model over note + machine; None below 20 examples or 2 classes.

    From 200 examples on, classes with a single example are left out.
    """
    rows = examples.select(text.context_document("text", "machine").alias("text"), "label", F.col("weight").cast("double").alias("weight"))
    rows = staged(rows, "board-examples")  # counted, indexed and turned into features below
    size = rows.count()
    if size >= fv.MATURE_EXAMPLES:
        common = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("label")
        rows = lookup_join(rows, common, ["label"], "inner")
        size = rows.count()
    if size < fv.MIN_EXAMPLES or rows.select("label").distinct().limit(2).count() < 2:
        return None
    solver = LogisticRegression(featuresCol="features", labelCol="index", weightCol="weight", family="multinomial", regParam=1e-4, maxIter=40)
    return _fit(rows, solver, 1, size)


def train_sheet_model(examples: DataFrame, c: float = 1.0, counts: DataFrame | None = None) -> TextModel:
    """One-vs-rest linear SVM over words of 2+ letters; ``c`` weighs the losses against the length of the weights,
    ``counts``: feature counts that hold the examples'."""
    rows = examples.select("text", F.col("cls").alias("label"), F.col("weight").cast("double").alias("weight"), digest().alias("digest"))
    own = feature_counts(examples, 2) if counts is None else counts.join(rows.select("digest").distinct(), "digest", "left_semi")
    own = cut_lineage(own)
    idf = fit_idf(own)
    labels = sorted(r["label"] for r in rows.select("label").distinct().collect())
    index = F.array_position(F.array(*[F.lit(n) for n in labels]), F.col("label")) - 1
    data = rows.join(entries(weights(own, idf), idf), "digest").select("entries", index.cast("int").alias("index"), "weight")
    data = cut_lineage(data)
    return SheetTextModel(idf, linear.fit_svm(data, len(labels), idf.count(), c), labels, 2, data.count())


def split_examples(examples: DataFrame, seed: int, share: float = 0.8, key: str = "text") -> DataFrame:
    """``in_train`` for exactly round(share * n) rows, by the order of a seeded hash of the text."""
    ranked = running_total(examples, [F.xxhash64(F.lit(seed), F.col(key)), F.col(key)], {})
    total = ranked.agg(F.round(F.count(F.lit(1)) * share).alias("_cut"))
    return ranked.join(F.broadcast(total)).withColumn("in_train", F.col("_position") <= F.col("_cut")).drop("_position", "_cut")


def accuracy(model: TextModel, examples: DataFrame, temperature: float | None = fv.SOFTMAX_TEMPERATURE, counts: DataFrame | None = None) -> float:
    scored = examples.join(model.predict(examples.select("text"), temperature, counts).select("text", "classe"), "text")
    return float(scored.agg(F.avg((F.col("classe") == F.col("cls")).cast("double"))).first()[0] or 0.0)


def choose_c(train: DataFrame, seed: int = 43, grid: tuple[float, ...] = (0.5, 1.0, 2.0), counts: DataFrame | None = None) -> float:
    """The C of best accuracy on an inner split; ties go to the one nearest 1, the first of equally near ones."""
    inner = cut_lineage(split_examples(train, seed))
    fit_rows, held = inner.filter("in_train"), inner.filter("NOT in_train")
    scores = {c: accuracy(train_sheet_model(fit_rows, c, counts), held, counts=counts) for c in grid}
    return max(grid, key=lambda c: (scores[c], -abs(c - 1)))


def stability(examples: DataFrame, reviewed: DataFrame, c: float, seeds: tuple[int, ...] = (42, 7, 1, 3, 11), counts: DataFrame | None = None,
              known: tuple[float, ...] = ()) -> tuple[float, float]:
    """Mean and deviation of the accuracy over several seeded splits; reviewed examples always train. ``known``:
    accuracies of splits that were measured already."""
    runs = list(known)
    for seed in seeds:
        parts = cut_lineage(split_examples(examples, seed))
        model = train_sheet_model(parts.filter("in_train").drop("in_train").unionByName(reviewed), c, counts)
        runs.append(accuracy(model, parts.filter("NOT in_train"), counts=counts))
    mean = sum(runs) / len(runs)
    return mean, (sum((r - mean) ** 2 for r in runs) / len(runs)) ** 0.5


def evaluate(scored: DataFrame) -> DataFrame:
    """Accuracy, error, Wilson bounds, top-3 and detail hits of a scored test set (cls, classe, top3_classes, detail, suggested)."""
    hit = F.col("classe") == F.col("cls")
    detail = (F.coalesce("detail", F.lit("")) != "") & (text.plain_text("suggested") == text.plain_text("detail"))
    base = scored.agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits"),
                      F.count_if(F.array_contains("top3_classes", F.col("cls"))).alias("top3_hits"), F.count_if(detail).alias("detail_hits"))
    low, high = calc.wilson("hits", "n")
    share = lambda c: calc.percent_1(c, "n")
    return base.select("n", share("hits").alias("accuracy"), calc.percent_1(F.col("n") - F.col("hits"), "n").alias("error_rate"),
                       F.round(low * 100, 1).alias("ci_low"), F.round(high * 100, 1).alias("ci_high"),
                       F.round((high - low) * 50, 1).alias("margin"), share("top3_hits").alias("top3"), share("detail_hits").alias("detail_accuracy"))


def band_report(scored: DataFrame) -> DataFrame:
    """Share and accuracy of every confidence band; a band without rows has the count 0 and no accuracy."""
    names = scored.sparkSession.createDataFrame([("Alta",), ("Média",), ("Baixa",)], "band string")
    bands = scored.groupBy(F.col("faixa").alias("band")).agg(F.count(F.lit(1)).alias("count"), F.count_if(F.col("classe") == F.col("cls")).alias("hits"))
    bands = bands.join(names, "band", "full").fillna(0, ["count", "hits"])
    total = F.sum("count").over(Window.partitionBy())
    return bands.select("band", "count", calc.percent_1(F.col("count"), total).alias("share"), F.when(F.col("count") > 0, calc.percent_1("hits", "count")).alias("accuracy"))


def first_errors(scored: DataFrame, n: int = 12) -> DataFrame:
    """The report's first wrong answers by text."""
    return scored.filter(F.col("classe") != F.col("cls")).orderBy("text").limit(n)


# ---- L14: detail of the nearest example inside the class ----------------------------------------------------------

def nearest_details(model: TextModel, texts: DataFrame, pool: DataFrame) -> DataFrame:
    """For (text, cls), the detail of the most similar example of that class; exact.

    A first look at one example per rare slot gives each text a score it can reach. Only slots from which that score
    can still be beaten are then joined (prefix filter), and long posting lists are spread over chunks.
    """
    weigh = lambda rows: weights(feature_counts(rows, model.shortest), model.idf)
    wanted = texts.select("text", "cls", digest().alias("digest")).dropDuplicates(["digest", "cls"])
    named = pool.filter("detail <> '' AND cls IS NOT NULL")
    examples = named.groupBy(digest().alias("digest"), "cls").agg(F.min("detail").alias("detail"))
    p = cut_lineage(weigh(named).join(examples, "digest").select(F.col("digest").alias("example"), "cls", "detail", "slot", "w"))
    q = cut_lineage(weigh(wanted).join(wanted.select("digest", "cls"), "digest"))
    postings = p.groupBy("cls", "slot").agg(F.count(F.lit(1)).alias("df"), F.min("example").alias("seed"))
    ranked = q.join(postings.hint("merge"), ["cls", "slot"])
    onward = Window.partitionBy("cls", "digest").orderBy(F.desc("df"), F.desc("slot")).rowsBetween(Window.unboundedPreceding, 0)
    first = Window.partitionBy("cls", "digest").orderBy("df", "slot")
    ranked = cut_lineage(ranked.withColumns({"tail": F.sqrt(F.sum(F.col("w") * F.col("w")).over(onward)), "r": F.row_number().over(first)}))
    entries = lambda rows, keys: rows.groupBy(*keys).agg(F.collect_list(F.struct(F.col("slot").cast("string").alias("term"), "w")).alias("v"))
    q_vec = cut_lineage(entries(q, ["digest", "cls"]).withColumnRenamed("v", "qv"))
    p_vec = cut_lineage(entries(p, ["example", "cls", "detail"]).withColumnRenamed("v", "pv"))

    def scored(pairs: DataFrame) -> DataFrame:
        both = pairs.join(q_vec.hint("merge"), ["digest", "cls"]).join(p_vec.hint("merge"), ["example", "cls"])
        return both.select("digest", "cls", "example", "detail", dot(F.col("qv"), F.col("pv")).alias("s"))

    seeds = scored(ranked.filter("r <= 3").select("digest", "cls", F.col("seed").alias("example")).distinct())
    reach = seeds.groupBy("digest", "cls").agg(F.max("s").alias("reach"))
    open_ = ranked.join(reach, ["digest", "cls"]).filter(F.col("tail") * 1.4142135623731 >= F.col("reach") - 1e-9)
    chunks = F.ceil(F.col("df") / POOL_CHUNK).cast("int")
    asked = open_.select("cls", "slot", "digest", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"))
    listed = p.join(postings.select("cls", "slot", "df").hint("merge"), ["cls", "slot"]).select(
        "cls", "slot", "example", F.pmod(F.xxhash64("example"), chunks).cast("int").alias("chunk"))
    pairs = asked.join(listed.hint("merge"), ["cls", "slot", "chunk"]).select("digest", "cls", "example").distinct()
    best = scored(pairs).groupBy("digest", "cls").agg(F.min_by("detail", F.struct(F.round(-F.col("s"), 12), F.col("example"))).alias("detail"))
    return wanted.join(best, ["digest", "cls"], "left").select("text", "cls", F.coalesce("detail", F.lit("")).alias("detail"))


def detail_options(pool: DataFrame, limit: int = 40) -> DataFrame:
    """The most used details of every class."""
    counted = pool.filter("detail <> '' AND cls IS NOT NULL").groupBy("cls", "detail").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("n"), "detail"))
    return counted.withColumn("rank", rank).filter(F.col("rank") <= limit)


# ---- L18, L19: reports ---------------------------------------------------------------------------------------------

def sheet_report(cards: DataFrame) -> DataFrame:
    """Hit rate and provenance per analysis, weighted by stops.

    cards(analysis_id, count, class, suggested, source). Blank cards (no description before and after) do not count.
    Where cards tell with ``estimated`` which suggestions are no snapshots, an analysis with any is estimated.
    """
    blank = (F.col("class") == fv.NO_NOTE) & (F.col("suggested") == fv.NO_NOTE)
    same = F.col("class") == F.col("suggested")
    n = F.col("count")
    out = cards.groupBy("analysis_id").agg(
        F.sum("count").alias("records"), F.count(F.lit(1)).alias("cards"),
        F.coalesce(F.sum(F.when(~blank, n)), F.lit(0)).alias("_total"),
        F.coalesce(F.sum(F.when(~blank & same & ~F.col("suggested").isin(fv.UNCLASSIFIED), n)), F.lit(0)).alias("_hits"),
        F.count_if(~blank & ~same).alias("corrections"),
        F.coalesce(F.sum(F.when(~blank & F.col("source").isin("memoria", "aprendizado"), n)), F.lit(0)).alias("_past"),
        F.count_if(F.col("class").isin(fv.UNCLASSIFIED)).alias("unclassified"),
        *([F.bool_or("estimated").alias("estimated")] if "estimated" in cards.columns else []))
    return out.withColumns({"hit_rate": calc.percent_1("_hits", "_total"), "from_past": calc.percent_1("_past", "_total")})\
        .drop("_total", "_hits", "_past")


def accuracy_history(points: DataFrame, keep: int = 40) -> DataFrame:
    """One point per model version (the latest), the newest ``keep`` of them."""
    fields = [c for c in points.columns if c != "version"]
    one = points.filter("accuracy IS NOT NULL").groupBy("version").agg(F.max_by(F.struct(*fields), "trained_at").alias("p")).select("version", "p.*")
    return one.orderBy(F.desc("trained_at"), "version").limit(keep)

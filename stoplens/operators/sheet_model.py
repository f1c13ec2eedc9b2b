"""The sheet model as one operator (L9, L11, L12, L15, L20): train unless nothing changed, report, answer notes.

Feature counts of all examples are made once and shared by every fit: three values of C on an inner split, the model of
the 80 % and four more splits. Test notes are in no fit but the stability runs of other splits.
"""

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stoplens import fixed_values as fv
from stoplens.functions import calc, text
from stoplens.operators import models as ml
from stoplens.operators import training
from stoplens.operators.catalog import Catalog
from stoplens.operators.skew import lookup_join
from stoplens.session import staged

LEAST_EXAMPLES = 50
SEED, OTHER_SEEDS = 42, (7, 1, 3, 11)
TOO_FEW = "Exemplos insuficientes para treinar (mínimo 50 relatos com classe)."
LABELLED, SAID = ["note", "label"], ["relato_norm", "classe", "detalhe"]


@dataclass
class SheetModel:
    fingerprint: str
    c: float
    model: ml.TextModel
    pool: DataFrame = field(repr=False)  # text, cls, detail of the examples that details come from
    answers: DataFrame = field(repr=False)  # what the analyst said: text, classe, detalhe
    report: dict = field(repr=False)
    bands: DataFrame = field(repr=False)
    errors: DataFrame = field(repr=False)


def training_fingerprint(labelled: DataFrame, analyst: DataFrame) -> str:
    """One hash of the labelled notes and the analyst's answers, whatever their order: sums of row hashes, which
    combine before the shuffle; one row comes to the driver."""
    parts = [rows.agg(calc.content_hash(calc.row_hash(fields)).alias("h")) for rows, fields in ((labelled, LABELLED), (analyst, SAID))]
    hashes = [p.first()["h"] for p in parts]
    return labelled.sparkSession.range(1).select(F.sha2(F.lit("|".join(hashes)), 256)).first()[0]


def enough(examples: DataFrame) -> bool:
    """At least 50 examples with a class, of at least two classes."""
    known = examples.filter("cls IS NOT NULL")
    return known.limit(LEAST_EXAMPLES).count() == LEAST_EXAMPLES and known.select("cls").distinct().limit(2).count() == 2


def analyst_answers(analyst: DataFrame) -> DataFrame:
    """(text, classe, detalhe): what the analyst said about a note beats the model; of several answers the greatest."""
    said = analyst.filter("relato_norm <> ''").groupBy(F.col("relato_norm").alias("text"))
    return said.agg(F.max(F.struct(text.class_label("classe").alias("classe"), F.coalesce("detalhe", F.lit("")).alias("detalhe"))).alias("a")).select("text", "a.*")


def train(labelled: DataFrame, analyst: DataFrame, catalog: Catalog | None = None, previous: SheetModel | None = None, force: bool = False,
          other_seeds: tuple[int, ...] = OTHER_SEEDS) -> SheetModel:
    """labelled(note, label, seq); analyst(relato, relato_norm, classe, detalhe). ``previous`` comes back as it is when
    its training set was the same, unless forced. Raises below 50 examples with a class or two classes."""
    labelled, analyst = staged(labelled.select(*LABELLED, "seq"), "sheet-labelled"), staged(analyst.select("relato", *SAID), "sheet-analyst")
    fingerprint = training_fingerprint(labelled, analyst)
    if previous is not None and previous.fingerprint == fingerprint and not force:
        return previous
    prepared = training.prepare(labelled, analyst, catalog)
    examples = staged(prepared["examples"].select("text", "raw", "cls", "detail", "weight", "source"), "sheet-examples")
    if not enough(examples):
        raise ValueError(TOO_FEW)
    counts = staged(ml.feature_counts(examples, 2), "sheet-features")
    known = examples.filter("cls IS NOT NULL")
    folder, reviewed = known.filter("source = 'pasta'"), known.filter("source = 'analista'")
    parts = staged(ml.split_examples(folder, SEED), "sheet-split")
    test = parts.filter("NOT in_train").drop("in_train")
    fit_rows = parts.filter("in_train").drop("in_train").unionByName(reviewed)
    c = ml.choose_c(fit_rows, SEED + 1, counts=counts)
    model = ml.train_sheet_model(fit_rows, c, counts)
    pool = staged(fit_rows.unionByName(examples.filter("cls IS NULL")).select("text", "cls", "detail"), "sheet-pool")
    predicted = model.predict(test.select("text"), fv.SOFTMAX_TEMPERATURE, counts)
    details = ml.nearest_details(model, predicted.select("text", F.col("classe").alias("cls")), pool).select("text", F.col("detail").alias("suggested"))
    scored = test.join(predicted, "text").join(details, "text", "left").withColumns({
        "suggested": F.coalesce("suggested", F.lit("")), "top3_classes": F.transform("top3", lambda e: e["classe"])})
    scored = staged(scored.drop("top3"), "sheet-scored")
    found = ml.evaluate(scored).first().asDict()
    hits = scored.agg(F.avg((F.col("classe") == F.col("cls")).cast("double"))).first()[0] or 0.0
    mean, deviation = ml.stability(folder, reviewed, c, other_seeds, counts, (hits,))
    report = {**found, "c": c, "train_size": fit_rows.count(), "test_size": found["n"], "examples": known.count(), "classes": len(model.labels),
              "stability_mean": round(mean * 100, 1), "stability_sd": round(deviation * 100, 1), "stability_runs": 1 + len(other_seeds),
              "previous_accuracy": previous.report["accuracy"] if previous else None, **prepared["counts"].first().asDict()}
    errors = ml.first_errors(scored).select("raw", "cls", "classe", percent("confianca").alias("confianca"))
    return SheetModel(fingerprint, c, model, pool, staged(analyst_answers(analyst), "sheet-answers"), report, ml.band_report(scored), errors)


def percent(column: str):
    return F.round(F.col(column) * 100, 1)


def predict(trained: SheetModel, notes: DataFrame) -> DataFrame:
    """(text, classe, detalhe, confianca, faixa, top3) of every distinct non-empty note (``text``, as the model reads
    it): the analyst's answer where there is one (no confidence, band of its own), else the model's, the detail of the
    nearest example of that class, and percents."""
    asked = notes.select("text").filter("text <> ''").distinct()
    marked = lookup_join(asked, trained.answers.withColumn("_said", F.lit(True)), ["text"])
    struct = "array<struct<classe:string,confianca:double>>"
    said = marked.filter("_said").select("text", "classe", "detalhe", F.lit(None).cast("double").alias("confianca"), F.lit(fv.ANALYST).alias("faixa"),
                                         F.array().cast(struct).alias("top3"))
    rest = staged(trained.model.predict(marked.filter("_said IS NULL").select("text"), fv.SOFTMAX_TEMPERATURE), "sheet-predictions")
    details = ml.nearest_details(trained.model, rest.select("text", F.col("classe").alias("cls")), trained.pool).select("text", F.col("detail").alias("detalhe"))
    answered = rest.join(details, "text", "left").select(
        "text", "classe", F.coalesce("detalhe", F.lit("")).alias("detalhe"), percent("confianca").alias("confianca"), "faixa",
        F.transform("top3", lambda e: F.struct(e["classe"].alias("classe"), F.round(e["confianca"] * 100, 1).alias("confianca"))).alias("top3"))
    return said.unionByName(answered)

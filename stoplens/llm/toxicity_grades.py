"""Toxicity as severity grades, by cumulative-link ordinal regression over sparse features: words and word starts.

P(grade <= k) = logistic(threshold_k - score); one weight per word, shared by the ordered thresholds, so the score
moves a document along all grades at once. Output: the chance of each grade, the expected severity, and whether grade 1
or worse is at least as likely as not.

The model is fitted on a bounded sample of labelled rows: at most ``PER_GRADE`` documents of each grade, those with the
smallest hash of their id, weighted back to the grades' shares among all labels. Scoring covers all documents and whole
texts. A feature counts once per document.

Null and empty texts have no words and the score 0; labels that repeat count with their highest grade; null labels are
skipped; documents without label are scored like others; where the labelled documents have fewer than two grades there
is nothing to learn: a warning says so and every document gets score 0 and grade 0; empty tables of documents give empty
tables; extra columns pass through unless they carry the name of an output column, which then wins.
"""

import re
import warnings
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stoplens.llm.common import in_tasks, written

PER_GRADE = 4000
WORDS = 2000  # vocabulary: the features whose shares among grades differ most
LEAST_DOCS = 5  # documents of the sample that must hold a feature
LASSO = 5e-4  # a weight stays zero while it moves the mean log-likelihood by less per unit
ROUNDS = 400
NEVER = 50.0  # threshold that leaves no chance above it at score 0
WORD_PATTERN = r"[^\W\d_]+"
STEMS = (4, 5, 6)  # letters of the word starts that are features too, so that inflected forms share a weight
words_in = re.compile(WORD_PATTERN).findall


def features(text: str) -> set[str]:
    """Sparse features of a text: its words in lower case, ``stem-`` for each start of a longer word, and ``stem--`` for
    a start that two different words share."""
    words = set(words_in(text.lower()))
    out, seen = set(words), set()
    for n in STEMS:
        for w in words:
            if len(w) > n:
                stem = w[:n] + "-"
                if stem in seen:
                    out.add(stem + "-")
                seen.add(stem)
    return out | seen


def feature_batches(batches):
    for batch in batches:
        grade, text = batch.columns
        yield pa.RecordBatch.from_arrays([grade, pa.array([sorted(features(t.as_py())) for t in text], pa.list_(pa.string()))], ["grade", "words"])


def severity_grade(quality: Column, toxic: Column) -> Column:
    """0: not toxic, 1: toxic, 2: toxic in a text that is of low quality too; null if toxic is null."""
    return F.when(toxic == 0, 0).when(toxic > 0, F.when(quality == 0, 2).otherwise(1))


@dataclass
class OrdinalModel:
    weights: dict[str, float]
    thresholds: list[float]
    sample: dict[int, int] = field(default_factory=dict)  # documents that each grade was learned from

    def below(self, score: np.ndarray) -> np.ndarray:
        """P(grade <= k) for each threshold k, one row per score."""
        return 1 / (1 + np.exp(np.clip(score[:, None] - np.array(self.thresholds)[None, :], -50, 50)))


def fit_ordinal(rows: list[list[int]], grades: np.ndarray, weight: np.ndarray, n_words: int, n_grades: int, lasso: float = LASSO,
                rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by Adam steps on the weighted mean log-likelihood; thresholds stay ordered, as the first
    one and the logarithms of the gaps are what moves."""
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    word = np.array([w for r in rows for w in r], np.int64)
    weight = weight / weight.sum()
    share = np.array([weight[grades <= k].sum() for k in range(n_grades - 1)]).clip(1e-6, 1 - 1e-6)
    start = np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(start), 1e-3))
    values = np.concatenate([np.zeros(n_words), start[:1], gaps])
    m, v = np.zeros_like(values), np.zeros_like(values)
    for step in range(1, rounds + 1):
        w, cuts = values[:n_words], values[n_words] + np.concatenate([[0.0], np.cumsum(np.exp(values[n_words + 1:]))])
        score = np.bincount(doc, w[word], minlength=len(rows))
        upper = np.where(grades < n_grades - 1, cuts[np.minimum(grades, n_grades - 2)] - score, 40.0)
        lower = np.where(grades > 0, cuts[np.maximum(grades - 1, 0)] - score, -40.0)
        fu, fl = 1 / (1 + np.exp(-upper)), 1 / (1 + np.exp(-lower))
        chance = np.maximum(fu - fl, 1e-12)
        du, dl = fu * (1 - fu) / chance * weight, fl * (1 - fl) / chance * weight
        slope = np.zeros_like(values)
        slope[:n_words] = np.bincount(word, (du - dl)[doc], minlength=n_words) + lasso * np.sign(w)
        at_cut = np.zeros(n_grades - 1)
        np.add.at(at_cut, np.minimum(grades, n_grades - 2), np.where(grades < n_grades - 1, -du, 0))
        np.add.at(at_cut, np.maximum(grades - 1, 0), np.where(grades > 0, dl, 0))
        slope[n_words] = at_cut.sum()
        slope[n_words + 1:] = np.exp(values[n_words + 1:]) * at_cut[::-1].cumsum()[::-1][1:]
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope * slope
        values -= 0.1 * (1 - step / rounds) * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-12)
    w = np.where(np.abs(values[:n_words]) < 0.05, 0.0, values[:n_words])
    return w, values[n_words] + np.concatenate([[0.0], np.cumsum(np.exp(values[n_words + 1:]))])


def labelled_sample(docs: DataFrame, grades: DataFrame, n_grades: int, id: str, text: str, per_grade: int) -> DataFrame:
    """(grade, words): the features of at most ``per_grade`` documents of each grade. Texts of one grade that are the same
    words in the same order, whatever their case and signs, count once; texts of different grades never stand for each other."""
    order = F.xxhash64(F.col("_id"))
    chosen = None
    for grade in range(n_grades):
        part = grades.where(F.col("grade") == grade).orderBy(order, "_id").limit(per_grade)
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most n_grades * per_grade ids
    found = docs.select(F.col(id).alias("_id"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text")).join(F.broadcast(chosen), "_id")
    words = F.array_join(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0)), " ")
    key = F.struct("grade", F.sha2(words, 256))
    one = found.groupBy(key.alias("key")).agg(F.min(F.struct(F.xxhash64("text").alias("h"), "grade", "text")).alias("one")).select("one.grade", "one.text")
    return one.mapInArrow(in_tasks(__name__, "feature_batches"), "grade int, words array<string>")


def fit_toxicity(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", grade: Column | None = None, n_grades: int = 3,
                 per_grade: int = PER_GRADE, n_words: int = WORDS) -> OrdinalModel:
    """Fit on ``labels`` (id and what ``grade`` reads; by default quality and toxic). The driver gets n_grades counts,
    ``n_words`` words, and the word numbers of at most ``n_grades * per_grade`` documents."""
    value = severity_grade(F.col("quality"), F.col("toxic")) if grade is None else grade
    grades = labels.select(F.col(id).alias("_id"), value.cast("int").alias("grade")).where("_id is not null and grade is not null")\
        .groupBy("_id").agg(F.max("grade").alias("grade"))
    totals = {r["grade"]: r["n"] for r in grades.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}
    sample = written(labelled_sample(docs, grades, n_grades, id, text, per_grade), "labelled-sample")
    sizes = {r["grade"]: r["n"] for r in sample.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        warnings.warn("labels of at least two grades are needed: every document gets grade 0", stacklevel=2)
        return OrdinalModel({}, [NEVER] * (n_grades - 1), sizes)
    bad, good = sum(n for g, n in sizes.items() if g), sizes.get(0, 0)
    counts = sample.select("grade", F.explode("words").alias("word")).groupBy("word").agg(
        F.sum(F.when(F.col("grade") > 0, 1).otherwise(0)).alias("bad"), F.sum(F.when(F.col("grade") == 0, 1).otherwise(0)).alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (bad - F.col("bad") + 0.5)) - F.log((F.col("good") + 0.5) / (good - F.col("good") + 0.5))
    strength = F.abs(odds) / F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    vocabulary = [r["word"] for r in counts.where(F.col("bad") + F.col("good") >= LEAST_DOCS).orderBy(strength.desc(), "word").limit(n_words).collect()]
    place = {w: i for i, w in enumerate(vocabulary)}
    numbered = sample.select("grade", F.array_intersect("words", F.array(*[F.lit(w) for w in vocabulary]).cast("array<string>")).alias("words")).collect()
    rows, own = [[place[w] for w in r["words"]] for r in numbered], np.array([r["grade"] for r in numbered], np.int64)
    weight = np.array([totals[g] / sizes[g] for g in own.tolist()])
    weights, cuts = fit_ordinal(rows, own, weight, len(vocabulary), n_grades)
    return OrdinalModel({w: float(weights[i]) for w, i in place.items() if weights[i]}, [float(c) for c in cuts], sizes)


def score_batches(batches, weights: dict[str, float]):
    known = weights.keys()
    for batch in batches:
        texts = batch.column(1)
        score = [sum(sorted(weights[w] for w in known & features(texts[i].as_py() or ""))) for i in range(len(texts))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], ["row", "score"])


def with_chances(scored: DataFrame, model: OrdinalModel, score: str = "score") -> DataFrame:
    """Add the chance of each grade (array), the expected severity and ``toxic``."""
    below = [1 / (1 + F.exp(F.col(score) - F.lit(t))) for t in model.thresholds]
    chances = [b - a for a, b in zip([F.lit(0.0), *below], [*below, F.lit(1.0)], strict=True)]
    return scored.withColumns({"grade_chances": F.array(*chances), "severity": sum((c * k for k, c in enumerate(chances)), F.lit(0.0)), "toxic": below[0] <= 0.5})


def score_toxicity(docs: DataFrame, model: OrdinalModel, text: str = "text") -> DataFrame:
    """``docs`` with score, grade_chances, severity and toxic. The model goes along with the tasks: at most WORDS words."""
    columns = [c for c in docs.columns if c not in ("score", "grade_chances", "severity", "toxic") or c == text]
    row = F.struct(*columns)
    scored = docs.select(row.alias("row"), F.col(text).cast("string").alias("text")).mapInArrow(
        in_tasks(__name__, "score_batches", model.weights), f"row {docs.select(row.alias('row')).schema['row'].dataType.simpleString()}, score double")
    return with_chances(scored.select("row.*", "score"), model)

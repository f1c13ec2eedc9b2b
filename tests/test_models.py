"""Nearest details against all pairs, seeded split sizes, the board model."""

import random

from pyspark.sql import functions as F

from stoplens.operators import models as ml


def test_nearest_detail_matches_all_pairs(spark):
    rng = random.Random(3)
    words = "sensor motor correia entrada saida travado sujo quebrado lado direito mola".split()
    note = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(2, 5)))
    pool = spark.createDataFrame([(note(), rng.choice("XY"), f"d{i}") for i in range(60)], "text string, cls string, detail string")
    asked = spark.createDataFrame([(note() + f" n{i % 3}", rng.choice("XY")) for i in range(40)], "text string, cls string").distinct()
    idf = ml.fit_idf(ml.feature_counts(pool))
    model = ml.TextModel(idf, None, [], 1, 60)
    got = {(r["text"], r["cls"]): r["detail"] for r in ml.nearest_details(model, asked, pool).collect()}

    def table(df):
        out = {}
        for r in ml.weights(ml.feature_counts(df), idf).join(df.select("text", ml.digest().alias("digest")).distinct(), "digest").collect():
            out.setdefault(r["text"], {})[r["slot"]] = r["w"]
        return out
    p, q = table(pool), table(asked)
    sims = lambda a, b: sum(w * b.get(s, 0.0) for s, w in a.items())
    details = {}
    for r in pool.collect():
        details.setdefault((r["text"], r["cls"]), []).append(r["detail"])
    for (t, cls), detail in got.items():
        scores = {d: sims(q[t], p[pt]) for (pt, pc), ds in details.items() if pc == cls for d in ds}
        assert abs(scores[detail] - max(scores.values())) < 1e-9


def test_split_is_exact_and_repeatable(spark):
    rows = spark.range(77).select(F.col("id").cast("string").alias("text"))
    first = ml.split_examples(rows, 42)
    train = {r["text"] for r in first.filter("in_train").collect()}
    assert len(train) == 62 and train == {r["text"] for r in ml.split_examples(rows, 42).filter("in_train").collect()}


def test_board_model_learns_a_class_the_catalog_does_not_know(spark):
    known = {"FALHA DE SENSOR": "SENSOR COM DEFEITO; FALHA NO SENSOR; SENSOR SUJO; TROCA DO SENSOR", "FALHA DE MOTOR": "MOTOR AQUECENDO; MOTOR DESARMOU; TROCA DO MOTOR; MOTOR COM RUIDO",
             "FALHA DE CARROSSEL": "TRAVAMENTO DO CARROSSEL; CARROSSEL TRAVADO; CARROSSEL PRESO; AJUSTE DO CARROSSEL; CARROSSEL DESALINHADO; CARROSSEL TRAVOU; CARROSSEL BATENDO; LIMPEZA DO CARROSSEL"}
    rows = [(n.strip(), m, label, 1) for label, notes in known.items() for n in notes.split(";") for m in ("ENCHEDORA", "ROTULADORA")]
    examples = spark.createDataFrame(rows, "text string, machine string, label string, weight int")
    assert ml.train_board_model(examples.limit(10)) is None
    model = ml.train_board_model(examples)
    best = model.predict(spark.createDataFrame([("CARROSSEL TRAVANDO DE NOVO MAQ_ENCHEDORA",)], "text string")).first()
    assert best["classe"] == "FALHA DE CARROSSEL" and len(best["top3"]) == 3 and best["confianca"] > 0.4

"""The sheet model: skip, least examples, chosen C, report, answers."""

import pytest
from pyspark.sql import functions as F

from stoplens.operators import models as ml
from stoplens.operators import sheet_model as sm

PARTS = {"Sensor danificado": ("sensor", "FALHA DE SENSOR"), "Rolamento quebrado": ("rolamento", "FALHA DE ROLAMENTO"), "Correia rompida": ("correia", "FALHA DE CORREIA")}
SAID = "relato string, relato_norm string, classe string, detalhe string"


def labelled(spark, n=25):
    rows = [(f"{w} com defeito na posicao {i} da maquina", label) for label, (w, _) in PARTS.items() for i in range(n)]
    return spark.createDataFrame([(note, label, i) for i, (note, label) in enumerate(rows)], "note string, label string, seq bigint")


def test_too_few_examples(spark):
    assert sm.enough(spark.createDataFrame([(f"t{i}", "A" if i else "B") for i in range(50)], "text string, cls string"))
    for rows in ([(f"t{i}", "A" if i else "B") for i in range(49)], [(f"t{i}", "A") for i in range(60)], [(f"t{i}", None if i > 48 else f"C{i % 3}") for i in range(90)]):
        assert not sm.enough(spark.createDataFrame(rows, "text string, cls string"))
    with pytest.raises(ValueError, match="mínimo 50"):
        sm.train(labelled(spark, 16), spark.createDataFrame([], SAID), other_seeds=())


def test_fingerprint_follows_content_not_order(spark):
    one, none = labelled(spark), spark.createDataFrame([], SAID)
    said = spark.createDataFrame([("a", "a", "x", "")], SAID)
    base = sm.training_fingerprint(one, none)
    assert base == sm.training_fingerprint(one.orderBy(F.desc("seq")).withColumn("seq", F.col("seq") * 2), none)
    others = [sm.training_fingerprint(one.union(one.limit(1)), none), sm.training_fingerprint(one, said), sm.training_fingerprint(one.filter("seq > 0"), none),
              sm.training_fingerprint(one, said.withColumn("detalhe", F.lit(None).cast("string")))]
    assert len({base, *others}) == 5


def test_train_predict_and_skip(spark, monkeypatch):
    note = "sensor com defeito na posicao 3 da maquina"
    said = spark.createDataFrame([(note, note, " falha  de eixo", "folga"), ("", "", "x", "y")], SAID)
    fits = []
    real = ml.train_sheet_model
    monkeypatch.setattr(ml, "train_sheet_model", lambda examples, c=1.0, counts=None: fits.append((c, counts is not None)) or real(examples, c, counts))
    trained = sm.train(labelled(spark), said, other_seeds=(7,))
    assert [c for c, _ in fits[:3]] == [0.5, 1.0, 2.0] and all(shared for _, shared in fits) and len(fits) == 5
    assert trained.c == max([0.5, 1.0, 2.0], key=lambda c: (trained.c == c)) and fits[3][0] == fits[4][0] == trained.c
    report = trained.report
    assert report["train_size"] + report["test_size"] == report["examples"] == 75 and report["test_size"] == 15 and report["do_analista"] == 1
    assert report["accuracy"] >= 80 and report["stability_runs"] == 2 and report["previous_accuracy"] is None and report["ci_low"] <= report["accuracy"] <= report["ci_high"]
    assert {r["band"]: r["count"] > 0 or r["accuracy"] is None for r in trained.bands.collect()} == {"Alta": True, "Média": True, "Baixa": True}
    assert sum(r["count"] for r in trained.bands.collect()) == 15
    before = len(fits)
    assert sm.train(labelled(spark), said, previous=trained) is trained and len(fits) == before

    asked = spark.createDataFrame([(note,), (note,), ("correia com defeito na posicao 99",), ("",), (None,)], "text string")
    got = {r["text"]: r for r in sm.predict(trained, asked).collect()}
    assert set(got) == {note, "correia com defeito na posicao 99"}
    analyst, other = got[note], got["correia com defeito na posicao 99"]
    assert (analyst["classe"], analyst["detalhe"], analyst["confianca"], analyst["faixa"], analyst["top3"]) == ("FALHA DE EIXO", "folga", None, "Analista", [])
    assert other["classe"] == "FALHA DE CORREIA" and other["detalhe"] == "Correia rompida" and 1 < other["confianca"] <= 100
    assert other["confianca"] == other["top3"][0]["confianca"] and other["faixa"] in ("Alta", "Média", "Baixa")

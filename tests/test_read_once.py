"""Keys of notes are worked out once a row, however often the operator reads them."""

from pyspark.sql import functions as F

import pytest

from stoplens.functions import text
from stoplens.operators import classify as cl
from stoplens.operators import items as it
from stoplens.operators import models as ml
from stoplens.operators import sheet_model as sm
from stoplens.operators import training as tr
from stoplens.operators.events import with_events


def counted(spark, value):
    """``value`` by a function that counts its calls."""
    calls = spark.sparkContext.accumulator(0)

    def once(x):
        calls.add(1)
        return x
    return calls, F.udf(once, "string").asNondeterministic()(value)


def test_corrections(spark):
    rows = [(f"n{i % 4}", i, "A" if i % 3 else "B") for i in range(40)]
    df = spark.createDataFrame(rows, "note_key string, seq long, label string")
    want = sorted(map(tuple, cl.fold_memory(df).collect()))
    calls, key = counted(spark, F.col("note_key"))
    assert sorted(map(tuple, cl.fold_memory(df.withColumn("note_key", key)).collect())) == want
    assert calls.value == 40


def test_classified_stops(spark):
    df = spark.createDataFrame([(i, "ROLAMENTO QUEBRADO", "ENCHEDORA") for i in range(30)], "id long, observacao_raw string, equipamento string")
    calls, note = counted(spark, F.col("observacao_raw"))
    assert {r["label"] for r in cl.classify(df.withColumn("observacao_raw", note)).collect()} == {"FALHA DE ROLAMENTO"}
    assert calls.value == 30


def test_failure_events(spark):
    rows = [("f", i, "U", "L", "M", "2024-01-01", f"{i % 24:02}:00-{(i + 1) % 24:02}:00", f"NOTE {i % 3}") for i in range(30)]
    df = spark.createDataFrame(rows, "analysis_id string, id long, centro string, linha string, equipamento string, data_inicio string, intervalo string, observacao_raw string")
    calls, machine = counted(spark, F.col("equipamento"))
    assert with_events(df.withColumn("equipamento", machine), "observacao_raw").count() == 30
    assert calls.value == 30


def test_board_examples(spark):
    rows = [(f"{w} com defeito {i}", "M", w, 1) for w in ("sensor", "motor") for i in range(20)]
    df = spark.createDataFrame(rows, "text string, machine string, label string, weight int")
    calls, note = counted(spark, F.col("text"))
    model = ml.train_board_model(df.withColumn("text", note))
    assert sorted(model.labels) == ["motor", "sensor"] and calls.value == 40


def test_analyst_notes_of_the_sheet_model(spark, monkeypatch):
    labelled = spark.createDataFrame([(f"sensor {i}", "Sensor danificado", i) for i in range(5)], "note string, label string, seq bigint")
    said = spark.createDataFrame([(f"mancal {i}", f"mancal {i}", "falha de mancal", "") for i in range(6)], "relato string, relato_norm string, classe string, detalhe string")
    calls, note = counted(spark, F.col("relato_norm"))
    monkeypatch.setattr(sm, "enough", lambda examples: examples.count() < 0)
    with pytest.raises(ValueError):
        sm.train(labelled, said.withColumn("relato_norm", note), other_seeds=())
    assert calls.value == 6


MODEL_TEXTS = text.model_text


def counted_keys(spark, monkeypatch):
    """model_text counts the notes it is worked out for."""
    calls = spark.sparkContext.accumulator(0)

    def model_text(value):
        return counted_once(MODEL_TEXTS(F.col(value) if isinstance(value, str) else value))

    def once(x):
        calls.add(1)
        return x
    counted_once = F.udf(once, "string").asNondeterministic()
    monkeypatch.setattr(text, "model_text", model_text)
    return calls


def test_labelled_notes_alike_are_cleaned_once(spark, monkeypatch):
    rows = [(f"sensor {i % 2} sujo ( 3000812{i:04} )", "Sensor sujo" if i % 4 else "Sensores sujos", i) for i in range(40)]
    labelled = spark.createDataFrame(rows + [(None, "Sensor sujo", 40)], "note string, label string, seq bigint")
    calls = counted_keys(spark, monkeypatch)
    out = tr.prepare(labelled)
    got = sorted((r["text"], r["raw"], r["detail"], r["weight"]) for r in out["examples"].collect())
    assert got == [("sensor 0 sujo", rows[0][0], "Sensor sujo", 20.0), ("sensor 1 sujo", rows[1][0], "Sensor sujo", 20.0)]
    assert out["counts"].select("sem_conteudo", "duplicadas", "conflitos").first() == (1, 38, 0) and calls.value == 4


def test_item_keys_of_notes_alike(spark, monkeypatch):
    notes = [f"Motor nº {i % 3} queimado 30008{i:06}" for i in range(30)] + [None, "", "xx", "a12345 válvula", "12345²6 motor"]
    stops = spark.createDataFrame(list(enumerate(notes)), "id long, observacao_raw string")
    want = sorted(map(tuple, it.with_item_key(stops).collect()))
    calls = counted_keys(spark, monkeypatch)
    got = it.with_item_key_of_notes(stops)
    assert got.columns == ["id", "observacao_raw", "ml_key"] and sorted(map(tuple, got.collect())) == want
    assert calls.value == 7


def test_notes_without_long_numbers_have_the_same_model_text(spark):
    ends, cores = ["", " ", "(", ") ", "-", "_", "a", "é", "7", "\u00b2", "\u00bd", "\u4e2d", "\n", "."], ["1234", "12345", "123456789 98765", "00012-54321", "12\u066112345"]
    notes = [f"x{a}{n}{b}y" for a in ends for n in cores for b in ends] + [a + n + b for a in ends for n in cores for b in ends]
    rows = spark.createDataFrame([(n,) for n in notes] + [(None,)], "note string")
    different = rows.filter(text.model_text("note") != text.model_text(text.without_long_numbers("note")))
    assert different.count() == 0 and rows.filter(text.without_long_numbers("note") == " ").count() > 0

import pytest
from pyspark.sql import functions as F

from stoplens.sources import landed, sinks
from stoplens.streaming import daily, ingest

HEAD = "Unidade;Data;Linha;Equipamento;Tipo de falha;Observações;Minutos de parada"


def write(folder, name, *lines):
    path = folder / name
    path.write_text("\n".join(lines), encoding="utf-8")
    return str(path)


def test_header_below_notes_quotes_and_formats(spark, tmp_path):
    path = write(tmp_path, "a.csv", "Relatório de paradas", "", HEAD,
                 'U1;30/09/2026;L1;Bomba;Mecânica;"Vazamento; no ""selo""";1.234,50', ";;;;;;", ";1/10/26;L1;Motor;;;5")
    good, bad = landed.read_landed(spark, [path])
    rows = {r["equipamento"]: r for r in good.collect()}
    assert bad.count() == 0 and set(rows) == {"Bomba", "Motor"}
    assert rows["Bomba"]["observacao_raw"] == 'Vazamento; no "selo"' and float(rows["Bomba"]["minutos_parada"]) == 1234.5
    assert rows["Bomba"]["source_row"] == 4 and str(rows["Bomba"]["data_inicio"]) == "2026-09-30"
    assert rows["Motor"]["centro"] == "Não informada" and rows["Motor"]["tipo_parada"] == "Não informado"
    assert str(rows["Motor"]["data_inicio"]) == "2026-10-01"
    layout = good.filter("equipamento = 'Bomba'").select(landed.layout_of(F.col("original")).alias("l")).first()["l"]
    assert [c["field"] for c in layout] == ["centro", "data_inicio", "linha", "equipamento", "tipo_parada", "observacao_raw", "minutos_parada"]


def test_invalid_rows_cite_their_line_or_go_to_quarantine(spark, tmp_path):
    path = write(tmp_path, "b.csv", HEAD, "U1;30/02/2026;L1;Bomba;M;x;4", "U1;2026-09-30;L1;Bomba;M;x;-1", "U1;2026-09-30;L1;Bomba;M;x;abc",
                 "U1;2026-09-30;L1;;M;x;4", "U1;2026-09-30;L1;Bomba;M;x;nan", "U1;2026-09-30;L1;Bomba;M;x;4")
    with pytest.raises(ValueError, match="Linha 2: data inválida"):
        landed.read_landed(spark, [path])
    good, bad = landed.read_landed(spark, [path], strict=False)
    assert good.count() == 1
    assert {r["source_row"]: r["reject_reason"] for r in bad.collect()} == {
        2: landed.BAD_DATE, 3: landed.BAD_MINUTES, 4: landed.BAD_MINUTES, 5: landed.NO_MACHINE, 6: landed.BAD_MINUTES}


def test_missing_and_duplicate_headers(spark, tmp_path):
    with pytest.raises(ValueError, match="Faltam: .*Linha"):
        landed.read_landed(spark, [write(tmp_path, "c.csv", "Data;Equipamento;Observações;Minutos", "2026-01-01;M;x;1")])
    with pytest.raises(ValueError, match="mesmo significado"):
        landed.read_landed(spark, [write(tmp_path, "d.csv", HEAD + ";Minutos", "U1;2026-09-30;L1;B;M;x;4;5")])


def test_legacy_scan_warns(spark, tmp_path):
    rows, warnings = landed.read_legacy(spark, [write(tmp_path, "e.csv", "Centro,Linha,chave do parada,Observações", "C, L1 ,M1,ROLAMENTOS GASTO")])
    assert warnings == ["Coluna esperada não encontrada no arquivo: 'minutos_parada'"]
    row = rows.first()
    assert row["linha"] == "L1" and row["minutos_parada"] is None and row["observacao_normalizada"] == "ROLAMENTO DESGASTADO"


def test_labelled_notes(spark, tmp_path):
    a = write(tmp_path, "f.csv", "Observações Operação;Classificação Manual Analista", "sensor sujo;Sensor  danificado", ";Sensor", "correia;", "mola;Mola")
    b = write(tmp_path, "g.csv", "outra;coisa", "1;2")
    rows, counts = landed.read_labelled(spark, [a, b])
    assert {(r["note"], r["label"]) for r in rows.collect()} == {("sensor sujo", "Sensor danificado"), ("mola", "Mola")}
    assert [(r["lidas"], r["faltantes"], r["rows"]) for r in counts.collect()] == [(4, 2, 2)]


def test_folder_ingest_is_idempotent(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    out = [str(tmp_path / n) for n in ("stops", "batches", "bad")]
    write(folder, "a.csv", HEAD, "U1;2026-09-30;L1;Bomba;M;x;4", "U1;2026-09-30;L1;Bomba;M;y;6")
    write(folder, "copy.csv", HEAD, "U1;2026-09-30;L1;Bomba;M;y;6,00", "U1;2026-09-30;L1;Bomba;M;x;4")
    run = lambda: ingest.start_ingest(spark, str(folder), *out, str(tmp_path / "cp")).awaitTermination()
    run()
    assert spark.read.parquet(out[1]).count() == 1 and spark.read.parquet(out[0]).count() == 2
    write(folder, "again.csv", HEAD, "U1;2026-09-30;L1;Bomba;M;x;4", "U1;2026-09-30;L1;Bomba;M;y;6")
    write(folder, "new.csv", HEAD, "U1;2026-10-01;L1;Bomba;M;x;4", "U1;2026-13-01;L1;Bomba;M;x;4")
    run()
    assert spark.read.parquet(out[1]).count() == 2 and spark.read.parquet(out[0]).count() == 3
    assert spark.read.parquet(out[2]).count() == 1


def test_running_days_equal_the_batch(spark, tmp_path):
    rows = spark.sql("""SELECT timestamp'2026-01-01 10:00:00' + make_interval(0, 0, 0, 0, cast(id * 5 as int)) AS start_ts, 'U' AS centro, 'L' AS linha,
      'M' || (id % 3) AS equipamento, CAST(id AS DECIMAL(12,2)) AS minutos_parada FROM range(40)""")
    rows.write.parquet(str(tmp_path / "s"))
    stream = daily.daily_by_machine(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "s")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("days").option(
        "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    batch = daily.daily_by_machine(rows)
    assert sorted(map(tuple, spark.table("days").collect())) == sorted(map(tuple, batch.collect()))


def test_replace_and_outputs(spark, tmp_path):
    path = str(tmp_path / "summary")
    sinks.replace_by_analysis(spark.sql("SELECT * FROM VALUES ('a', 'X', 1), ('b', 'Y', 2) AS t(analysis_id, classe, linhas)"), path)
    sinks.replace_by_analysis(spark.sql("SELECT * FROM VALUES ('a', 'Z', 5) AS t(analysis_id, classe, linhas)"), path)
    assert {(r["analysis_id"], r["classe"]) for r in spark.read.parquet(path).collect()} == {("a", "Z"), ("b", "Y")}
    stops = spark.sql("SELECT 'a' analysis_id, id FROM range(3)")
    members = spark.sql("SELECT 'a' analysis_id, 'c' || id card_id, id record_id FROM range(2)")
    cards = spark.sql("""SELECT * FROM VALUES ('a', 'c0', 'FALHA DE SENSOR', true, 'media'), ('a', 'c1', 'SEM DESCRIÇÃO', true, 'baixa')
      AS t(analysis_id, card_id, class, validated, confidence)""")
    out = {r["id"]: (r["Classificação"], r["tone"]) for r in sinks.classified_output(stops, members, cards).collect()}
    assert out == {0: ("FALHA DE SENSOR", "validada"), 1: ("SEM DESCRIÇÃO", "baixa"), 2: (None, None)}


def test_long_quoted_cells_take_no_stack(spark):
    from pyspark.sql import functions as F

    from stoplens.sources.landed import split_cells
    note = 'x""y;' * 20_000
    cells = spark.createDataFrame([(f'a;"{note}";b',)], "line string").select(split_cells(F.col("line"), F.lit(";")).alias("c")).first()["c"]
    assert cells == ["a", note.replace('""', '"'), "b"]


def test_minutes_beyond_the_decimal_are_quarantined(spark, tmp_path):
    from stoplens.sources.landed import BAD_MINUTES, read_landed
    (tmp_path / "a.csv").write_text("Data;Linha;Equipamento;Observações;Minutos de parada\n01/02/2026;L1;M1;x;99999999999\n01/02/2026;L1;M1;y;5\n", encoding="utf-8")
    good, bad = read_landed(spark, [str(tmp_path / "a.csv")], strict=False)
    assert [r["observacao_raw"] for r in good.collect()] == ["y"] and [r["reject_reason"] for r in bad.collect()] == [BAD_MINUTES]

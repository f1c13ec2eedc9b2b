"""Quoted records read by byte range against Python's csv."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from stoplens.sources import landed
from stoplens.sources import records as R

HEAD = "Unidade;Data;Linha;Equipamento;Tipo de falha;Observações;Minutos de parada"


@pytest.fixture
def ranges(spark):
    """Sets how many bytes a range has."""
    def cut(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield cut
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def random_cell(rng):
    kind = rng.randrange(8)
    if kind == 0:
        return ""
    if kind < 4:
        return "".join(rng.choice("ab ç;,") for _ in range(rng.randrange(1, 6)))
    if kind == 4:
        return 'x"' * rng.randrange(1, 4)
    if kind == 5:
        return "\n" * rng.randrange(1, 4) + "y"
    if kind == 6:
        return '"\r\n;"'
    return "linha\n" * rng.randrange(1, 9)


def random_file(rng, separator):
    out = io.StringIO(newline="")
    writer = csv.writer(out, delimiter=separator, lineterminator=rng.choice(["\n", "\r\n"]), quoting=rng.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL]))
    for _ in range(rng.randrange(1, 60)):
        writer.writerow([random_cell(rng) for _ in range(rng.randrange(1, 5))])
        if rng.random() < 0.1:
            out.write(rng.choice(["\n", 'stray "quote" here' + separator + 'b"\n', '"closed"tail' + separator + "z\n"]))
    return out.getvalue()


def test_records_equal_python_csv(spark, tmp_path, ranges):
    rng = random.Random(7)
    want, place = {}, {}
    for i in range(12):
        place[i] = i % 3
        content = ("﻿" if i % 4 == 0 else "") + random_file(rng, R.SEPARATORS[place[i]])
        (tmp_path / f"f{i:02}.csv").write_bytes(content.encode())
        rows = csv.reader(io.StringIO(content.removeprefix("﻿"), newline=""), delimiter=R.SEPARATORS[place[i]])
        want |= {(i, n): row for n, row in enumerate(rows, 1) if row}
    ranges(150)
    lines = R.read_lines(spark, [str(tmp_path)])
    starts = R.range_starts(lines)
    assert starts.count() > 20
    number = F.regexp_extract("file", r"f(\d+)\.csv", 1).cast("int")
    found = R.records(lines, starts.withColumn("separator", number % 3)).withColumn("cells", R.split_cells(F.col("text"), R.separator_text(F.col("separator"))))
    got = {(r["f"], r["number"]): r["cells"] for r in found.select(number.alias("f"), "number", "cells").collect()}
    assert {k: v for k, v in got.items() if v != [""] or k in want} == want


def test_long_cells_in_three_ranges(spark, tmp_path, ranges):
    """A cell of 100,000 characters with line breaks and doubled quotes that spans ranges; source rows go on behind it."""
    note = ('texto "entre aspas"; e\n' * 5000)[:100_000]
    rows = [["U1", "2026-09-30", "L1", f"M{i}", "M", note if i == 3 else f"nota\n{i}" if i % 5 == 0 else "x", "4"] for i in range(400)]
    out = io.StringIO(newline="")
    csv.writer(out, delimiter=";").writerows([HEAD.split(";"), *rows])
    (tmp_path / "a.csv").write_bytes(out.getvalue().encode())
    ranges(45_000)
    assert R.range_starts(R.read_lines(spark, [str(tmp_path / "a.csv")])).count() >= 3
    good, bad = landed.read_landed(spark, [str(tmp_path / "a.csv")])
    assert bad.count() == 0
    got = {r["equipamento"]: (r["observacao_raw"], r["source_row"]) for r in good.collect()}
    assert got == {r[3]: (r[5].strip(), i + 2) for i, r in enumerate(rows)}


def test_header_with_line_breaks_and_headers_of_many_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('relatório\n\n"Unidade","Data","Linha","Equipamento","Tipo\nde falha","Observações","Minutos\nde parada"\nU,2026-01-02,L1,M1,T,"a\nb",5\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text(HEAD.replace(";", "\t") + "\nU\t2026-01-02\tL2\tM2\tT\tcom; ponto, e vírgula\t6\n", encoding="utf-8")
    (tmp_path / "c.csv").write_text("Minutos;Linha;Equipamento;Data;Observações\n7;L3;M3;2026-01-02;só \"aspas\" soltas\n", encoding="utf-8")
    good, bad = landed.read_landed(spark, [str(tmp_path)])
    assert bad.count() == 0
    assert {(r["linha"], r["observacao_raw"], int(r["minutos_parada"]), r["source_row"]) for r in good.collect()} == {
        ("L1", "a\nb", 5, 4), ("L2", "com; ponto, e vírgula", 6, 2), ("L3", 'só "aspas" soltas', 7, 2)}


def test_endless_quote_goes_to_quarantine(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEAD + "\nU;2026-01-02;L1;M1;T;x;5\nU;2026-01-02;L1;M1;T;\"" + "y\n" * 3000, encoding="utf-8")
    lines = R.read_lines(spark, [str(tmp_path)])
    starts = R.range_starts(lines).withColumn("separator", F.lit(0))
    found = R.records(lines, starts, longest=1000).orderBy("number").collect()
    assert [(r["number"], r["first_line"], r["text"] is None) for r in found] == [(1, 1, False), (2, 2, False), (3, 3, True)]
    assert R.records(lines, starts).where("number = 3").first()["text"].count("\n") == 2999
    quarantined = landed.validated(landed._rows(lines, starts.drop("separator"), landed.find_headers(lines, starts.drop("separator")))).collect()
    assert [r["reject_reason"] for r in sorted(quarantined, key=lambda r: r["source_row"])] == [None, landed.BAD_MINUTES]


def test_labelled_notes_with_line_breaks(spark, tmp_path):
    (tmp_path / "f.csv").write_text('Observações;Classificação\n"sensor\nsujo";"Sensor  \ndanificado"\nx;\n', encoding="utf-8")
    rows, counts = landed.read_labelled(spark, [str(tmp_path)])
    assert [(r["note"], r["label"], r["number"]) for r in rows.collect()] == [("sensor\nsujo", "Sensor danificado", 2)]
    assert [tuple(r)[1:] for r in counts.collect()] == [(2, 1, 1)]

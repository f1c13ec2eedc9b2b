"""Hand-computed tables: Pareto, Jack-Knife, events, comparison, quadrant filter, consolidated rows."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from stoplens.operators import boards, compare, reliability as rel
from stoplens.operators.events import with_events

STOP = ("analysis_id string, id bigint, centro string, data_inicio date, linha string, equipamento string, tipo_parada string, intervalo string, "
        "observacao_raw string, observacao_normalizada string, minutos_parada decimal(12,2), failure_class string, failure_mode string, group_id string")


def stops(spark, rows):
    """rows: dicts with machine, minutes and optional day, unit, line, note, interval, file, klass."""
    import datetime
    from decimal import Decimal
    full = []
    for i, r in enumerate(rows, 1):
        day = datetime.date.fromisoformat(r.get("day", "2026-09-13"))
        note = r.get("note", f"NOTA {i}")
        full.append((r.get("file", "a"), i, r.get("unit", "U1"), day, r.get("line", "LINHA001"), r["machine"], r.get("kind", "P.EQ.LINHA"), r.get("interval"),
                     note, note, Decimal(str(r["minutes"])), r.get("klass", "FALHA DE ROLAMENTO"), note, r["machine"]))
    return spark.createDataFrame(full, STOP)


def test_pareto_and_jack_knife_by_hand(spark):
    plan = {"M1": [25] * 4, "M2": [90], "M3": [3] * 10, "M4": [5] * 2, "M5": [20] * 3}
    table = rel.machine_table(stops(spark, [{"machine": m, "minutes": x} for m, xs in plan.items() for x in xs]), "lines").orderBy("position").collect()
    assert [(r["name"], r["minutes"], r["count"], round(r["percent"], 2), round(r["cumulative"], 2)) for r in table] == [
        ("M1", 100, 4, 34.48, 34.48), ("M2", 90, 1, 31.03, 65.52), ("M5", 60, 3, 20.69, 86.21), ("M3", 30, 10, 10.34, 96.55), ("M4", 10, 2, 3.45, 100)]
    assert {(r["q_cut"], r["mttr_cut"]) for r in table} == {(4.0, 14.5)}
    assert {r["name"]: (r["mttr"], r["category"]) for r in table} == {
        "M1": (25, "Crítico-crônico"), "M2": (90, "Crítico"), "M5": (20, "Crítico"), "M3": (3, "Crônico"), "M4": (5, "Conforto")}
    assert table[0]["short"] == "L01_M1"


def test_quadrant_filter_keeps_the_cuts_of_the_full_set(spark):
    rows = stops(spark, [{"machine": "Bomba", "minutes": 50}] * 3 + [{"machine": "Motor", "minutes": 5}, {"machine": "Esteira", "minutes": 90}])
    full = rel.machine_table(rows, "lines")
    assert {r["category"]: r["machines"] for r in rel.quadrant_counts(full).collect()} == {"Crítico-crônico": 1, "Crítico": 1, "Crônico": 0, "Conforto": 1}
    only = rel.in_categories(rows, ["Crítico-crônico"], "lines").collect()
    assert [(r["name"], round(r["q_cut"], 2), r["mttr_cut"], r["cumulative"]) for r in only] == [("Bomba", 1.67, 49.0, 100.0)]
    with pytest.raises(ValueError):
        rel.in_categories(rows, ["Inventada"])
    with pytest.raises(ValueError):
        rel.machine_table(rows, "xx")


def test_order_numbers_and_touching_intervals_are_one_failure(spark):
    rows = [{"machine": "P", "minutes": 60, "note": "ROLAMENTO 30008216826", "interval": f"{h:02d}:00-{h + 1:02d}:00"} for h in (8, 9, 10)]
    rows += [{"machine": "P", "minutes": 30, "note": "ROLAMENTO ESTOURADO", "interval": iv} for iv in ("13:00-14:00", "14:00-15:00", "18:00-19:00")]
    table = rel.machine_table(with_events(stops(spark, rows))).collect()
    assert [(r["count"], r["lines"], r["mttr"]) for r in table] == [(3, 6, 90.0)]


def islands(log):
    """Event of each stop by gaps and islands: a stop opens an island unless it starts where its neighbour ended."""
    stops = log.toPandas()
    at = stops["intervalo"].str.extract(r"(\d+):(\d+)-(\d+):(\d+)").astype(float)
    stops["start"], stops["end"] = at[0] * 60 + at[1], at[2] * 60 + at[3]
    stops.loc[stops["end"] <= stops["start"], "end"] += 1440
    named = stops["analysis_id"] + ":" + stops["id"].astype(str)
    key = ["analysis_id", "centro", "linha", "equipamento", "data_inicio", "observacao_normalizada"]
    chained = stops[stops["start"].notna() & (stops["observacao_normalizada"].fillna("") != "")].sort_values([*key, "start", "end", "id"])
    opens = chained["start"] != chained.groupby(key)["end"].shift() % 1440
    heads = named[chained.index].where(opens).ffill()
    return dict(zip(stops["id"], named.mask(named.index.isin(heads.index), heads.reindex(named.index)), strict=True))


def test_events_are_islands_of_touching_stops_on_random_logs(spark):
    rng = random.Random(5)
    choices = ["08:00-09:00", "09:00-10:00", "10:00-11:00", "23:00-00:00", "00:00-01:00", "06:00-06:00", "09:00-09:00", None, "x"]
    rows = [{"machine": rng.choice("AB"), "minutes": 1, "note": rng.choice(["N1", "N2", ""]), "interval": rng.choice(choices), "file": rng.choice("xy")} for _ in range(400)]
    log = stops(spark, rows)
    assert {r["id"]: r["event_id"] for r in with_events(log).collect()} == islands(log)


def test_period_comparison(spark):
    rows = [("2026-09-01", "U1", "Bomba", 10), ("2026-09-01", "U1", "Bomba", 30), ("2026-09-01", "U1", "Motor", 50), ("2026-09-02", "U1", "Bomba", 20),
            ("2026-09-02", "U1", "Esteira", 80), ("2026-09-02", "U2", "Bomba", 10)]
    log = stops(spark, [{"day": d, "unit": u, "machine": m, "minutes": x} for d, u, m, x in rows])
    out = {r["name"]: r for r in compare.compare_periods(log, "2026-09-02", "2026-09-02", mode="lines", unit="U1").collect()}
    assert {n: (r["percentage"], r["direction"]) for n, r in out.items()} == {"Motor": (-100, "down"), "Bomba": (-50, "down"), "Esteira": (None, "new")}
    with pytest.raises(ValueError):
        compare.select_stops(log, "2026-10-01", "2026-09-01")
    with pytest.raises(ValueError):
        compare.select_stops(log, "2026-10-01")


def test_hourly_rows_become_one(spark):
    rows = [{"machine": "PALETIZADOR", "minutes": 60, "note": "FALHA NO EMPURRADOR 30008216826", "interval": f"{h:02d}:00-{h + 1:02d}:00"} for h in (8, 9, 10)]
    log = with_events(stops(spark, rows)).withColumns({c: F.lit("x") for c in ("material", "ordem", "subchave_parada", "sistema")})
    log = log.withColumns({"turno": F.lit("2.0"), "pts_acumulados": F.col("id").cast("decimal(12,2)")})
    row = boards.consolidated_rows(log).collect()
    assert len(row) == 1 and (row[0]["intervalo"], row[0]["minutos_parada"], row[0]["count"], row[0]["events"], row[0]["turno"], row[0]["pts_acumulados"]) == (
        "08:00-11:00", 180, 3, 1, "2", 3)
    assert row[0]["orders"] == "30008216826" and row[0]["observacao_raw"] == "FALHA NO EMPURRADOR 30008216826"


def test_running_totals_and_places_match_a_plain_window(spark):
    from stoplens.operators.skew import places_within, running_total
    rows = spark.range(500).selectExpr("id", "id % 3 AS g", "CAST(id * 7 % 11 AS BIGINT) AS v")
    got = {r["id"]: (r["_position"], r["s"]) for r in running_total(rows, [F.desc("v"), F.col("id")], {"s": F.col("v")}, 7).collect()}
    order = sorted(((-(i * 7 % 11), i) for i in range(500)))
    sums = list(itertools.accumulate(-v for v, _ in order))
    assert got == {i: (k + 1, sums[k]) for k, (_, i) in enumerate(order)}
    placed = {r["id"]: (r["_place"], r["_size"]) for r in places_within(rows, ["g"], [F.col("id")], 5).collect()}
    assert placed == {i: (i // 3, 167 if i % 3 < 2 else 166) for i in range(500)}

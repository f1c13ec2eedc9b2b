"""Commits of staged tables, and what is left when a step between dies."""

import pytest
from pyspark.sql import functions as F

from stoplens.sources import sinks, versions
from stoplens.streaming import ingest

HEAD = "Unidade;Data;Linha;Equipamento;Tipo de falha;Observações;Minutos de parada"


class Died(Exception):
    pass


def dying(monkeypatch, module, name, at):
    """Let the call number ``at`` of a function fail before it does anything."""
    real, calls = getattr(module, name), []

    def call(*args, **kwargs):
        calls.append(1)
        if len(calls) == at:
            raise Died
        return real(*args, **kwargs)
    monkeypatch.setattr(module, name, call)


def summary(spark, rows):
    return spark.createDataFrame(rows, "analysis_id string, classe string, linhas long")


def ids(spark, names):
    return spark.createDataFrame([(n,) for n in names], "analysis_id string")


def held(spark, folder):
    return sorted((r["analysis_id"], r["classe"], r["linhas"]) for r in sinks.summaries(spark, folder).collect())


def test_an_analysis_replaced_by_nothing_disappears(spark, tmp_path):
    folder = str(tmp_path)
    assert sinks.summaries(spark, folder) is None
    sinks.replace_summaries(summary(spark, [("a", "X", 1), ("a", "Y", 2), ("b", "Z", 3)]), ids(spark, "ab"), folder, "v1")
    sinks.replace_summaries(summary(spark, [("b", "W", 9)]), ids(spark, "abb"), folder, "v2")
    assert held(spark, folder) == [("b", "W", 9)]
    sinks.replace_summaries(summary(spark, [("b", "W", 9)]), ids(spark, "abb"), folder, "v2")
    assert held(spark, folder) == [("b", "W", 9)]
    sinks.replace_summaries(summary(spark, []), ids(spark, "b"), folder, "v3")
    assert held(spark, folder) == []
    sinks.replace_summaries(summary(spark, [("a", "X", 4), ("c", "stray", 1)]), ids(spark, "a"), folder, "v4")
    assert held(spark, folder) == [("a", "X", 4)]


@pytest.mark.parametrize("step", [1, 2])
def test_replacing_dies_between(spark, tmp_path, monkeypatch, step):
    folder = str(tmp_path)
    sinks.replace_summaries(summary(spark, [("a", "X", 1)]), ids(spark, "a"), folder, "v1")
    with monkeypatch.context() as patch, pytest.raises(Died):
        dying(patch, versions, "stage" if step == 1 else "enter", 2 if step == 1 else 1)
        sinks.replace_summaries(summary(spark, [("a", "Y", 2)]), ids(spark, "a"), folder, "v2")
    assert held(spark, folder) == [("a", "X", 1)]
    sinks.replace_summaries(summary(spark, [("a", "Y", 2)]), ids(spark, "a"), folder, "v2")
    assert held(spark, folder) == [("a", "Y", 2)]


def loads(spark, batches, stops):
    return (spark.createDataFrame(batches, "id long, file_hash string, content_hash string"), spark.createDataFrame(stops, "upload_batch_id long, note string"))


def visible(spark, folder):
    tables = [versions.live(spark, folder, name) for name in ("batches", "stops")]
    return tuple(sorted(r[c] for r in t.collect()) if t is not None else [] for t, c in zip(tables, ("id", "note"), strict=True))


def test_batches_and_stops_appear_together(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    first = loads(spark, [(1, "f1", "c1"), (2, "f2", None), (3, "f3", "c1")], [(1, "a"), (1, "b"), (2, "c"), (3, "copy")])
    for name, at in (("stage", 1), ("stage", 2), ("enter", 1)):
        with monkeypatch.context() as patch, pytest.raises(Died):
            dying(patch, versions, name, at)
            sinks.append_batches(*first, folder, "load-1")
        assert visible(spark, folder) == ([], [])
    sinks.append_batches(*first, folder, "load-1")
    assert visible(spark, folder) == ([1, 2], ["a", "b", "c"])
    sinks.append_batches(*first, folder, "load-1")
    sinks.append_batches(*first, folder, "load-2")
    assert visible(spark, folder) == ([1, 2], ["a", "b", "c"])
    more = loads(spark, [(4, "f1", "other"), (5, "f5", "c5")], [(4, "x"), (5, "d")])
    sinks.append_batches(*more, folder, "load-3")
    assert visible(spark, folder) == ([1, 2, 5], ["a", "b", "c", "d"])
    sinks.append_batches(*loads(spark, [(6, "f1", "c1")], [(6, "again")]), folder, "load-4", force=True)
    assert visible(spark, folder) == ([1, 2, 5, 6], ["a", "again", "b", "c", "d"])


def test_analyses_are_inserted_once(spark, tmp_path):
    folder, kind = str(tmp_path), "id string, content_hash string"
    sinks.insert_analyses(spark.createDataFrame([("b", "h"), ("a", "h"), ("c", "k")], kind), folder, "v1")
    sinks.insert_analyses(spark.createDataFrame([("0", "h"), ("d", "m")], kind), folder, "v2")
    assert sorted((r["id"], r["content_hash"]) for r in versions.live(spark, folder, "analyses").collect()) == [("a", "h"), ("c", "k"), ("d", "m")]


@pytest.mark.parametrize("step", [1, 2, 3, 4])
def test_ingest_dies_after_each_write(spark, tmp_path, monkeypatch, step):
    """A retry of the same epoch neither doubles nor loses rows; readers never see half a batch."""
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text(HEAD + "\nU;2026-01-02;L1;M1;T;\"x\ny\";5\nU;2026-01-02;L1;M1;T;z;-5\n", encoding="utf-8")
    (folder / "b.csv").write_text(HEAD + "\nU;2026-01-03;L2;M2;T;x;6\n", encoding="utf-8")
    out = [str(tmp_path / n) for n in ("stops", "batches", "bad")]
    run = lambda epoch: ingest.ingest_files(spark, [str(folder)], *out, epoch)
    if step < 4:
        from pyspark.sql.readwriter import DataFrameWriter
        real, done = DataFrameWriter.parquet, []

        def parquet(self, path, *args, **kwargs):
            if path in out and len(done) == step - 1:
                raise Died
            real(self, path, *args, **kwargs)
            done.extend([1] * (path in out))
        with monkeypatch.context() as patch, pytest.raises(Died):
            patch.setattr(DataFrameWriter, "parquet", parquet)
            run(7)
        if step == 3:
            assert versions.stored(spark, out[1]) is None
    else:
        run(7)
    run(7)
    assert ingest.ingested(spark, out[0], out[1]).count() == 2 and spark.read.parquet(out[1]).count() == 2
    assert spark.read.parquet(out[2]).count() == 1
    run(8)
    assert ingest.ingested(spark, out[0], out[1]).count() == 2 and spark.read.parquet(out[1]).count() == 2
    (folder / "c.csv").write_text(HEAD + "\nU;2026-01-04;L2;M2;T;x;6\n", encoding="utf-8")
    run(9)
    assert ingest.ingested(spark, out[0], out[1]).agg(F.sum("minutos_parada")).first()[0] == 17

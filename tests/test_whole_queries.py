"""Queries without an oracle that read every note, against brute force."""

from collections import Counter, defaultdict
from difflib import get_close_matches

from pyspark.sql import functions as F

from stoplens import fixed_values as fv
from stoplens.functions import text, tokens
from stoplens.operators import classify as cl
from stoplens.operators import training as tr
from stoplens.plans import fixtures as fx
from stoplens.plans import queries_learning as L
from stoplens.plans import queries_notes as N

O = "observacao_raw"


def test_all_notes_are_repaired(spark, small):
    vocabulary = tokens.note_vocabulary()

    def repaired(word):
        return word if len(word) < 5 or word in vocabulary else next(iter(get_close_matches(word, vocabulary, n=1, cutoff=0.88)), word)

    notes = fx.stops(spark, small).select("id", text.note_tokens(text.header_key(O)).alias("words")).collect()
    got = {r.id: r.value for r in N.b07_repaired_tokens(spark, small).collect()}
    assert got == {r.id: " ".join(map(repaired, r.words)) for r in notes} and {i % 12 for i in got} == set(range(12))


def replayed(spark, small):
    said = fx.stops(spark, small).select("id", text.memory_key(O).alias("key")).orderBy("id").collect()
    memory = {}
    for id, key in said:
        label = None if id % 10 == 9 else f"FALHA {id // 40 % 3}"
        if key:
            before = memory.get(key, (None, 0))
            memory[key] = (label, before[1] + 1 if before[0] == label else 1, id)
    return dict(said), {k: v for k, v in memory.items() if v[0] is not None}


def test_corrections_of_all_notes_are_remembered(spark, small):
    keys, memory = replayed(spark, small)
    assert {r.note_key: (r.label, r["count"], r.last_seq) for r in N.k11_correction_memory(spark, small).collect()} == memory
    assert {i % 12 for i, k in keys.items() if k in memory} - {5, 8}
    plain = {r.id: (r.label, r.source) for r in N.cl.classify(fx.stops(spark, small)).select("id", "label", "source").collect()}
    got = {r.id: (r.label, r.source) for r in N.d12_memory_beats_catalog(spark, small).collect()}
    assert got == {i: (memory[keys[i]][0], "memoria") if keys[i] in memory else plain[i] for i in plain}


def test_all_examples_have_their_class_counted(spark, small):
    examples = tr.prepare(L.labelled(spark, small))["examples"].select("raw", "detail", "weight", text.class_label("detail").alias("own")).collect()
    texts = sorted({t for e in examples for t in (e.raw, e.detail)})
    rows = spark.createDataFrame([(t,) for t in texts], "observacao_raw string").withColumn("equipamento", F.lit(""))
    named = {r.observacao_raw: None if r.label in fv.UNCLASSIFIED else r.label for r in cl.explain(rows).collect()}
    size = defaultdict(float)
    for e in examples:
        size[e.detail] += e.weight
    want = Counter(named[e.detail] or named[e.raw] or (e.own if size[e.detail] >= fv.MIN_OWN_CLASS else None) for e in examples)
    assert any(e.detail == "Ajuste geral" for e in examples)
    assert {r.cls: r.n for r in L.l05_example_classes(spark, small).collect()} == want

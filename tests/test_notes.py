"""Note rules, classification cases and grouping against a sequential brute force."""

import math
import random
import re
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stoplens.functions import text, tokens
from stoplens.operators import classify as cl
from stoplens.operators import grouping as gr
from stoplens.operators import training as tr
from stoplens.operators.catalog import Catalog
from stoplens.session import SHUFFLES_END, staged

CONTEXT = "analysis_id string, id bigint, centro string, linha string, equipamento string, tipo_parada string, subchave_parada string, sistema string, observacao_normalizada string"


def explained(spark, *pairs, catalog=None):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, observacao_raw string, equipamento string")
    return [r.asDict() for r in cl.explain(df, catalog).orderBy("i").collect()]


def test_catalog_cases(spark):
    sensor = ["ATUADOR DO SENSOR TRAVADO ORDEM: 30008223804", "FALHA NO SENSOR DE SAIDA DE PALETES ( 30008224349 )"]
    valve = ["VALVULA Nº41 EM VELOCIDADE NOMINAL COM EXCESSO DE NIVEL BAIXO", "IDENTIFICADO VÁLVULA 41 TENDO MAIOR IMPACTO"]
    bearing = ["ROLAMENTO QUEBRADO", "rolamento estourado", "ROLAMNETO ESTOURADO 30008216805", "troca de rolamentos do motor"]
    rest = ["ERRO DRIVE ALIMENTADOR ( QUEBRA DA CORREIA E ROLAMENTOS)", "ORDEM: 30008457970", "", "FALHA NA PALETIZADORA", "PARAFUSO ESPANADO NA ESTRELA"]
    out = explained(spark, *[(t, "PALETIZADOR 2") for t in sensor], *[(t, "ENCHEDORA BRH LI01") for t in valve], *[(t, "") for t in bearing + rest])
    labels = [r["label"] for r in out]
    assert labels[:2] == ["FALHA DE SENSOR"] * 2 and labels[2:4] == ["FALHA DE VÁLVULA DE ENCHIMENTO"] * 2 and labels[4:8] == ["FALHA DE ROLAMENTO"] * 4
    assert labels[8:] == ["FALHA DE DRIVE", "SEM DESCRIÇÃO", "SEM DESCRIÇÃO", "SEM MODO DE FALHA IDENTIFICADO", "FALHA DE PARAFUSO"]
    assert out[6]["reason"] == "Componente citado: rolamneto (com correção de digitação)." and out[6]["confidence"] == "media"
    assert out[12]["detail"] == "espanamento" and out[4]["detail"] == "quebra" and out[8]["detail"] == ""


def test_edited_catalog_and_memory(spark):
    catalog = Catalog([{"label": "parada geral", "kind": "regra", "terms": ["PARADA GERAL"]}])
    assert explained(spark, ("PARADA GERAL DA MAQUINA", ""), catalog=catalog)[0]["label"] == "PARADA GERAL"
    with pytest.raises(ValueError):
        Catalog([{"label": "x", "terms": []}])
    log = spark.sql("SELECT * FROM VALUES ('K', 1L, 'A'), ('K', 2L, 'B'), ('K', 3L, 'B'), ('Z', 1L, 'A'), ('Z', 2L, NULL) AS t(note_key, seq, label)")
    assert [(r["note_key"], r["label"], r["count"]) for r in cl.fold_memory(log).collect()] == [("K", "B", 2)]
    stops = spark.sql("SELECT 1L id, 'Máquina parou sozinha 30008216826' observacao_raw, 'ENCHEDORA' equipamento")
    memory = spark.sql("SELECT 'MAQUINA PAROU SOZINHA' note_key, 'FALHA DE MOTOR' label, 2 count")
    row = cl.classify(stops, memory=memory).first()
    assert (row["label"], row["confidence"], row["source"]) == ("FALHA DE MOTOR", "alta", "memoria")


def test_refine_rules(spark):
    base = cl.explain(spark.sql("SELECT 'FALHA NO SENSOR DA ESTEIRA' observacao_raw, '' equipamento"))
    with_model = lambda p: base.withColumns({"model_label": F.lit("FALHA DE ESTEIRA"), "probability": F.lit(p)})
    young, mature = cl.refine(with_model(0.95), 50).first(), cl.refine(with_model(0.95), 500).first()
    assert (young["label"], young["confidence"]) == ("FALHA DE SENSOR", "media")
    assert (mature["label"], mature["source"], mature["suggestion"]) == ("FALHA DE ESTEIRA", "aprendizado", "FALHA DE SENSOR")
    assert cl.refine(with_model(0.5), 500).first()["label"] == "FALHA DE SENSOR"
    assert cl.refine(with_model(0.99).withColumn("source", F.lit("memoria")), 500).first()["label"] == "FALHA DE SENSOR"


def test_normal_notes(spark):
    cases = {"ROLAMNETO ESTOURADO": "ROLAMENTO QUEBRADO", "Vazando óleo (OS 30008216805)": "VAZAMENTO ÓLEO", "curto circuito no mancal": "FALHA_ELETRICA ROLAMENTO", "": "", None: ""}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "x string, want string").withColumn("got", tokens.normal_note("x"))
    assert [(r["x"], r["got"]) for r in df.collect()] == list(cases.items())
    titled = spark.createDataFrame([("FALHA_ELETRICA 2AB ÓLEO",)], "x string").select(text.title_case("x").alias("t")).first()["t"]
    assert titled == "FALHA_ELETRICA 2AB ÓLEO".title()


def sequential_groups(texts, threshold=0.8):
    """The grouping rules applied one text at a time."""
    texts = sorted(texts)
    grams = lambda t: (w := re.findall(r"\w+", t)) + [f"{a} {b}" for a, b in zip(w, w[1:])]
    docs = [grams(t) for t in texts]
    df = {}
    for d in docs:
        for g in set(d):
            df[g] = df.get(g, 0) + 1
    vectors = []
    for d in docs:
        v = {g: d.count(g) * (math.log((1 + len(texts)) / (1 + df[g])) + 1) for g in set(d)}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1
        vectors.append({g: x / norm for g, x in v.items()})
    cosine = lambda i, j: sum(x * vectors[j].get(g, 0) for g, x in vectors[i].items())
    negated = lambda t: frozenset(set(t.split()) & {"NAO", "SEM", "NUNCA"})
    groups = []
    for i, t in enumerate(texts):
        for g in groups:
            if all(negated(texts[j]) == negated(t) and cosine(i, j) >= threshold - 1e-12 for j in g):
                g.append(i)
                break
        else:
            groups.append([i])
    return {frozenset(texts[i] for i in g) for g in groups}


@pytest.mark.parametrize("entries", [1_000_000, 400, 1])
def test_grouping_matches_brute_force(spark, monkeypatch, entries):
    """Whole contexts in one part; parts by shared prefix terms, some of them too large; all parts too large."""
    monkeypatch.setattr(gr, "PART_ENTRIES", entries)
    monkeypatch.setattr(gr, "POSTING_CHUNK", 3)
    monkeypatch.setattr(gr, "RANK_CHUNK_BITS", 2)
    rng = random.Random(11)
    words = "SENSOR MOTOR FALHA SAIDA ENTRADA SEM LADO A B C".split()
    texts = sorted({" ".join(rng.choice(words) for _ in range(rng.randint(3, 7))) for _ in range(160)})
    rows = [("f", i, "U", "L", "M", "T", "", "", t) for i, t in enumerate(texts)]
    got = gr.group_notes(spark.createDataFrame(rows, CONTEXT), 0.6)
    by_card = {}
    for r in got["card_members"].collect():
        by_card.setdefault(r["card_id"], set()).add(texts[r["record_id"]])
    want = sequential_groups(texts, 0.6)
    assert {frozenset(g) for g in by_card.values()} == want and max(map(len, want)) > 2


def test_vectors_keep_shared_terms_only(spark, monkeypatch):
    """Texts of one context, some with copies and most words of their own, against text_terms; pieces, ranges and blocks of a few texts."""
    monkeypatch.setattr(gr, "RANGE_CHARS", 200)
    monkeypatch.setattr(gr, "PIECE_WORDS", 40)
    monkeypatch.setattr(gr, "PIECE_BITS", 3)
    monkeypatch.setattr(gr, "BLOCK_BITS", 2)
    rng = random.Random(4)
    texts = [" ".join([f"W{n}X{k}" for k in range(12)] + rng.choices("A B C D É".split(), k=4)) for n in range(30)]
    texts += [t + rng.choice([" SEM", " Z", " A A"]) for t in texts[:15]] + ["", "!!", "A A A A", "A A A"]
    rows = [("f", i, "U", "L", "M", "T", "", "", t) for i, t in enumerate(texts)]
    found = gr.distinct_texts(gr.with_context(spark.createDataFrame(rows, CONTEXT)))
    whole, vectors = {}, {}
    for r in gr.text_terms(found).collect():
        whole.setdefault(r["vid"], {})[r["term"]] = (r["w"], r["df"])
    for r in gr.text_vectors(found).collect():
        vectors[r["vid"]] = dict(zip(r["terms"], [x / r["norm"] for x in r["raw"]], strict=True))
        own = whole[r["vid"]].values()
        assert sorted(vectors[r["vid"]].values()) == pytest.approx(sorted(w for w, df in own if df > 1))
        assert r["lone"] == pytest.approx(sum(w * w for w, df in own if df == 1), abs=1e-12)
    assert set(vectors) == {v for v, own in whole.items() if any(df > 1 for _, df in own.values())}
    sign = {r["vid"]: "SEM" in r["text"].split() for r in found.collect()}
    cosine = lambda a, b: sum(w * whole[b].get(t, (0, 0))[0] for t, (w, _) in whole[a].items())
    want = {(a, b): cosine(a, b) for a in whole for b in whole if a < b and sign[a] == sign[b] and cosine(a, b) >= 0.8 - 1e-12}
    got = {(r["lo"], r["hi"]): r["similarity"] for r in gr.similar_pairs(gr.text_vectors(found)).collect()}
    assert got == pytest.approx(want) and len(want) > 5
    assert gr.similar_pairs(gr.text_vectors(found.limit(0))).count() == 0


def test_words_that_only_one_text_repeats_weigh_in(spark, monkeypatch):
    """Vectors, all of them and those of linkable texts, against text_terms, where texts repeat words of their own."""
    monkeypatch.setattr(gr, "PIECE_BITS", 2)
    monkeypatch.setattr(gr, "RANGE_CHARS", 100)
    rng = random.Random(8)
    texts = [" ".join([f"W{n}"] * rng.randint(2, 5) + [f"V{n}X{k}" for k in range(4)] + rng.choices("A B C D".split(), k=3)) for n in range(24)]
    texts += [t + " E" for t in texts[:8]]
    found = gr.distinct_texts(gr.with_context(spark.createDataFrame([("f", i, "U", "L", "M", "T", "", "", t) for i, t in enumerate(texts)], CONTEXT)))
    whole = {}
    for r in gr.text_terms(found).collect():
        whole.setdefault(r["vid"], {})[r["term"]] = (r["w"], r["df"])
    every, few = ({r["vid"]: r for r in gr.text_vectors(found, only_linkable=o).collect()} for o in (False, True))
    cosine = lambda a, b: sum(w * whole[b].get(t, (0, 0))[0] for t, (w, _) in whole[a].items())
    want = {(a, b): cosine(a, b) for a in whole for b in whole if a < b and cosine(a, b) >= 0.8 - 1e-12}
    assert set(every) == set(whole) and len(want) >= 8 and {v for pair in want for v in pair} <= set(few) and len(few) < len(every) - 8
    for vectors in (every, few):
        for vid, r in vectors.items():
            assert sorted(x / r["norm"] for x in r["raw"]) == pytest.approx(sorted(w for w, df in whole[vid].values() if df > 1))
            assert r["lone"] == pytest.approx(sum(w * w for w, df in whole[vid].values() if df == 1), abs=1e-12)
    got = {(r["lo"], r["hi"]): r["similarity"] for r in gr.similar_pairs(gr.text_vectors(found, only_linkable=True)).collect()}
    assert got == pytest.approx(want)


def test_prefixes_leave_few_pairs_to_compare(spark, monkeypatch):
    """Texts that share one rare word each with some others, and near copies: vectors are sent for the near copies only."""
    kept, real = {}, gr.staged
    monkeypatch.setattr(gr, "staged", lambda df, name, *more: kept.setdefault(name, real(df, name, *more)))
    rng = random.Random(9)
    common = [f"C{k}" for k in range(30)]
    texts = [" ".join([f"W{n}X{k}" for k in range(3)] + [f"R{n // 2}"] + rng.sample(common, 24)) for n in range(40)]
    texts += [t.replace("C1 ", "C2 ", 1) + " Z" for t in texts[:6]]
    found = gr.distinct_texts(gr.with_context(spark.createDataFrame([("f", i, "U", "L", "M", "T", "", "", t) for i, t in enumerate(texts)], CONTEXT)))
    whole = {}
    for r in gr.text_terms(found).collect():
        whole.setdefault(r["vid"], {})[r["term"]] = r["w"]
    cosine = lambda a, b: sum(w * whole[b].get(t, 0) for t, w in whole[a].items())
    want = {(a, b): cosine(a, b) for a in whole for b in whole if a < b and cosine(a, b) >= 0.5 - 1e-12}
    got = {(r["lo"], r["hi"]): r["similarity"] for r in gr.similar_pairs(gr.text_vectors(found, 0.5, only_linkable=True), 0.5).collect()}
    assert got == pytest.approx(want) and len(want) >= 6
    assert len(want) <= kept["hopeful-pairs"].count() < kept["likely-pairs"].count()


def test_a_piece_asks_once_for_each_term():
    """Fifty copies of forty words: each term is sent once, with its number of texts."""
    words = pa.array([list(range(40))] * 50, pa.list_(pa.int64()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(50), pa.int64()), words], ["vid", "words"])
    dealt = pa.Table.from_batches(gr.dealt_terms(3, 6)([batch]))
    assert sum(map(len, dealt.column("term").to_pylist())) == 79 and {n for row in dealt.column("texts").to_pylist() for n in row} == {50}


def test_staging_leaves_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = disk.getAllFiles()
        return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}

    before, setting = shuffled(), spark.conf.get(SHUFFLES_END, "false")
    found = staged(spark.range(20_000).groupBy((F.col("id") % 5_000).alias("k")).agg(F.sum("id").alias("s")), "sums")
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.2)
    assert not shuffled() - before and found.count() == 5_000 and spark.conf.get(SHUFFLES_END, "false") == setting


def test_grouping_stages_texts_twice_only(spark, monkeypatch):
    """Texts are staged as keyed notes and as distinct texts; vectors once, and of linkable texts only."""
    monkeypatch.setattr(gr, "PART_ENTRIES", 10)
    kept, real = {}, gr.staged
    monkeypatch.setattr(gr, "staged", lambda df, name, *more: kept.setdefault(name, []).append(held := real(df, name, *more)) or held)
    rng = random.Random(2)
    texts = [" ".join(rng.sample([f"W{k}" for k in range(200)], 12)) for _ in range(60)]
    texts += [f"{t} Z{i}" for i, t in enumerate(texts[:10])]
    out = gr.group_notes(spark.createDataFrame([("f", i, "U", "L", "M", "T", "", "", t) for i, t in enumerate(texts)], CONTEXT))
    names = {r["name"]: r["texts"] for r in out["cards"].collect()}
    assert len(names) == 60 and sum(n == 2 for n in names.values()) == 10 and {n.upper() for n in names} == set(texts[:60])
    vectors = [name for name, frames in kept.items() if any("raw" in f.columns for f in frames)]
    assert sorted(name for name, frames in kept.items() if any("text" in f.columns for f in frames)) == ["distinct-texts", "keyed-notes"]
    assert vectors == ["text-vectors"] and kept["text-vectors"][0].count() < 40
    assert {r["record_id"] for r in out["card_members"].collect()} == set(range(70))


def part(vectors):
    rows = [(f"t{k}" for k in v) for v in vectors]
    return pa.table({"vid": list(range(len(vectors))), "terms": [list(r) for r in rows], "weights": [list(v.values()) for v in vectors],
                     "prefix": [[True] * len(v) for v in vectors]})


def unit(vector):
    norm = math.sqrt(sum(w * w for w in vector.values()))
    return {k: w / norm for k, w in vector.items()}


def test_near_copies_and_chains_take_few_comparisons(monkeypatch):
    calls = []
    real = gr.product
    monkeypatch.setattr(gr, "product", lambda a, b: calls.append(1) or real(a, b))
    rng = random.Random(3)
    base = {k: 1.0 for k in range(60)}
    copies = [unit({**{k: w for k, w in base.items() if k not in lost}, 100 + i: 1.2}) for i in range(20_000) for lost in [rng.sample(range(60), 2)]]
    got = gr.settle(part(copies), 0.8)
    assert set(got.column("g").to_pylist()) == {0} and len(calls) < 40_000
    chain = [unit({i: 1.0, i + 1: 1.0}) for i in range(20_000)]
    calls.clear()
    got = gr.settle(part(chain), 0.45)
    assert got.column("g").to_pylist() == [i - i % 2 for i in range(20_000)] and len(calls) < 60_000


def test_settling_bounds_are_safe():
    """Random vectors around the threshold, against all comparisons."""
    rng = random.Random(5)
    for _ in range(60):
        centre = [{k: rng.random() + 0.2 for k in rng.sample(range(14), 6)} for _ in range(3)]
        vectors = [unit({**(c := rng.choice(centre)), **{rng.randrange(14): rng.random() * 1.5 for _ in range(2)}}) for _ in range(40)]
        groups = []
        for i, v in enumerate(vectors):
            home = next((g for g in groups if all(gr.product(v, vectors[j]) >= 0.8 - 1e-12 for j in g)), None)
            if home is None:
                groups.append(home := [])
            home.append(i)
        want = [g[0] for i in range(40) for g in groups if i in g]
        assert gr.settle(part(vectors), 0.8).column("g").to_pylist() == want


def test_parts_of_a_long_chain_take_few_rounds(spark, monkeypatch):
    calls = []
    real = gr.cut_lineage
    monkeypatch.setattr(gr, "cut_lineage", lambda df: calls.append(1) or real(df))
    ids = random.Random(1).sample(range(600), 600)
    rows = [("b", ids[i], f"t{t:03}", 2, 0.7, 1.0) for i in range(600) for t in (i, i + 1) if i != 300 or t == 301]
    terms = spark.createDataFrame(rows, "bucket string, vid long, term string, df long, w double, tail double")
    signs = spark.createDataFrame([(i, "") for i in ids], "vid long, negated string")
    got = {r["vid"]: r["part"] for r in gr.linked_parts(terms, signs, 0.8).collect()}
    assert got == {ids[i]: min(ids[:300] if i < 300 else ids[300:]) for i in range(600)}
    assert len(calls) < 60


def test_copies_contexts_and_negation(spark):
    rows = [("f", i, "U1", "L1", "Enchedora", "M", "", "", "ROLAMENTO QUEBRADO") for i in range(1307)]
    rows += [("f", 2000, "U2", "L1", "Enchedora", "M", "", "", "ROLAMENTO QUEBRADO"), ("f", 2001, "U1", "L1", "Enchedora", "M", "", "", "SEM ROLAMENTO QUEBRADO"),
             ("f", 2002, "U1", "L1", "Enchedora", "M", "", "", ""), ("f", 2003, "U1", "L1", "Enchedora", "M", "", "", "")]
    out = gr.group_notes(spark.createDataFrame(rows, CONTEXT))
    assert sorted(r["size"] for r in out["cards"].collect()) == [1, 1, 1, 1, 1307] and out["machines"].count() == 2
    assert {r["name"] for r in out["cards"].collect()} == {"Rolamento Quebrado", "Sem Rolamento Quebrado", "Descrição não informada"}


def test_training_set_cleaning(spark):
    parts = {"Sensor danificado": "sensor", "Rolamento quebrado": "rolamento", "Correia rompida": "correia"}
    rows = [(f"{w} com defeito na posicao {i} da maquina", label) for label, w in parts.items() for i in range(25)]
    rows += [("sensor com defeito na posicao 0 da maquina", "Sensor danificado"), ("sensor com defeito na posicao 1 da maquina", "Sensores danificados"),
             ("sensor com defeito na posicao 2 da maquina", "Rolamento quebrado"), ("xxxxxx", "Correia rompida"), ("motor parou", "Sem detalhes")]
    df = spark.createDataFrame([(n, l, i) for i, (n, l) in enumerate(rows)], "note string, label string, seq bigint")
    out = tr.prepare(df)
    c = out["counts"].first()
    assert (c["sem_conteudo"], c["rotulo_sem_informacao"], c["duplicadas"], c["conflitos"], c["exemplos"]) == (1, 1, 2, 1, 75)
    assert c["rotulos_antes"] - c["rotulos_depois"] == 1
    assert {r["cls"] for r in out["examples"].collect()} == {"FALHA DE SENSOR", "FALHA DE ROLAMENTO", "FALHA DE CORREIA"}

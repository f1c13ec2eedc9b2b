"""Components, SimHash, vectors, URL filter and the pipeline against brute force."""

import random
import re
import shutil

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from stoplens.llm import simhash_blocks as H
from stoplens.llm import simhash_wide as W
from stoplens.llm import subspace_join as V
from stoplens.llm import url_filter as U
from stoplens.llm.components import connected_components

DOCS = "doc_id long, text string, fp int, component_id string"


def parts(nodes, links):
    least = {n: n for n in nodes}

    def top(n):
        while least[n] != n:
            n = least[n]
        return n
    for a, b in links:
        a, b = sorted((top(a), top(b)))
        least[b] = a
    return {n: top(n) for n in nodes}


def test_components_of_chains_and_hubs(frame):
    random.seed(1)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(random.randint(200, 260), random.randint(200, 260)) for _ in range(40)]
    got = {r.node: r.component for r in connected_components(frame([*links, (None, 3), (7, 7)], "u long, v long")).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert got == parts(nodes, [x for x in links if x[0] != x[1]])
    assert connected_components(frame([], "u long, v long")).count() == 0


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def test_near_copies_match_brute_force(frame):
    random.seed(4)
    words = ["".join(random.choice("abcdefg") for _ in range(6)) for _ in range(200)]
    texts = ["", " ", None, "One", "ÉA b", "x " * 5000]
    for _ in range(30):
        own = [random.choice(words) for _ in range(300)]
        for _ in range(random.randint(1, 5)):
            copy = list(own)
            copy[random.randrange(300)] = random.choice(words)
            texts.append(" ".join(copy))
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)] + [(3, "One", 1, "x"), (None, "", 1, "x")]
    prints = {i: fingerprint(t or "") for i, t, *_ in rows if i is not None}
    want = parts(list(prints), [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2])
    got = H.near_copies(frame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == (0 if r.id is None else want[r.id]) and r.fp & (1 << 64) - 1 == prints.get(r.id, 0)
    kept = H.drop_near_copies(frame(rows, DOCS))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values())) and kept.columns == ["doc_id", "text", "fp", "component_id"]


@pytest.mark.parametrize("crowd", [32, 2])
def test_links_reach_the_same_components_in_crowded_buckets(frame, monkeypatch, crowd):
    monkeypatch.setattr(H, "CROWD", crowd)
    rng = np.random.default_rng(9)
    seeds = rng.integers(-2 ** 63, 2 ** 63 - 1, 4).tolist()
    fps = {int(np.int64(np.uint64(s & (1 << 64) - 1) ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False))))) for s in seeds for _ in range(60)}
    close = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2
    links = [(r.u, r.v) for r in H.fingerprint_links(frame([(f,) for f in fps], "fp long")).collect()]
    assert all(close(a, b) for a, b in links)
    assert parts(fps, links) == parts(fps, [(a, b) for a in fps for b in fps if a < b and close(a, b)])


@pytest.mark.parametrize("crowd", [32, 2])
def test_links_of_other_distances_match_brute_force(frame, monkeypatch, crowd):
    monkeypatch.setattr(H, "CROWD", crowd)
    monkeypatch.setattr(H, "CHUNK", 5)
    random.seed(8)
    seeds = [random.getrandbits(64) for _ in range(5)]
    fps = {f - (f >> 63 << 64) for s in seeds for _ in range(30) for f in [s ^ sum(1 << b for b in random.sample(range(64), random.randint(0, 5)))]}
    close = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 3
    links = [(r.u, r.v) for r in H.fingerprint_links(frame([(f,) for f in fps], "fp long"), 3, 6).collect()]
    assert parts(fps, links) == parts(fps, [(a, b) for a in fps for b in fps if a < b and close(a, b)])


def edited_texts(families, copies, words):
    """Texts of 240 words; the k-th copy of a family has k words replaced."""
    random.seed(8)
    words = ["".join(random.choice("abcdefghij") for _ in range(5)) for _ in range(words)]
    texts = ["", None, " ", "one", "one two"]
    for _ in range(families):
        own = [random.choice(words) for _ in range(240)]
        for k in range(copies):
            copy = list(own)
            for at in random.sample(range(240), k):
                copy[at] = random.choice(words)
            texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("crowd", [32, 2])
def test_wide_fingerprints_match_brute_force(frame, monkeypatch, crowd):
    monkeypatch.setattr(W, "CROWD", crowd)
    monkeypatch.setattr(W, "CHUNK", 5)
    texts = edited_texts(10, 9, 400)
    words = W.n_words(W.BLOCKS, W.BITS)

    def bits_of(text):
        own = (text or "").lower().split()
        shingles = {" ".join(own[i:i + 5]) for i in range(len(own) - 4)} or ({" ".join(own)} if own else set())
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        votes = [0] * 64 * words
        for h in hashes:
            for w in range(words):
                mix = (h + (w + 1) * 0x9E3779B97F4A7C15) % 2 ** 64
                for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                    mix = (mix ^ mix >> shift) * factor % 2 ** 64
                mix ^= mix >> 31
                for b in range(64):
                    votes[64 * w + b] += mix >> b & 1
        return sum((2 * n > len(hashes)) << b for b, n in enumerate(votes))

    fps = [bits_of(t) for t in texts]
    rough, most = W.most_bits(0.8, 64, W.ROUGH), W.most_bits(0.8, 64 * words, W.MARGIN)
    block = (1 << W.BITS) - 1

    def linked(a, b):
        x = a ^ b
        return x == 0 or x.bit_count() <= most and (x & (1 << 64) - 1).bit_count() <= rough and any(x >> W.BITS * k & block == 0 for k in range(W.BLOCKS))

    n = len(texts)
    want = parts(range(n), [(i, j) for i in range(n) for j in range(i) if linked(fps[i], fps[j])])
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)] + [(7, texts[7], 1, "x"), (None, "", 1, "x")]
    got = W.similar_copies(frame(rows, DOCS)).collect()
    assert len(got) == len(rows) and all(r.component_id == (0 if r.id is None else want[r.id]) for r in got)
    kept = W.drop_similar(frame(rows, DOCS))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values())) and kept.columns == ["doc_id", "text", "fp", "component_id"]
    assert W.similar_copies(frame([], DOCS)).count() == 0


def test_wide_fingerprints_find_similar_texts_and_no_others(frame):
    texts = edited_texts(40, 8, 3000)
    sets = [{tuple(t.split()[i:i + 5]) for i in range(len(t.split()) - 4)} if t else set() for t in texts]
    fps = [(i, W.wide_fingerprint(W.shingle_hashes(t or "", 5, 42), W.n_words(W.BLOCKS, W.BITS)).tolist()) for i, t in enumerate(texts) if t and len(t) > 20]
    found = {tuple(sorted((r.u, r.v))) for r in W.wide_links(frame(fps, "node long, fp array<long>")).collect()}
    jaccard = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for (a, _) in fps for (b, _) in fps if a < b}
    assert min(jaccard[p] for p in found) > 0.7
    for least, recall in ((0.8, 0.9), (0.85, 0.97)):  # of all pairs at least so similar
        close = [p for p, s in jaccard.items() if s >= least]
        assert len(close) > 100 and sum(p in found for p in close) >= recall * len(close)


def test_blocks_must_outnumber_the_differing_bits():
    with pytest.raises(ValueError):
        H.block_masks(4, 4)


def test_vector_links_match_brute_force(frame, monkeypatch):
    monkeypatch.setattr(V, "CHUNK", 16)
    rng = np.random.default_rng(2)
    rows = []
    for k in range(12):
        centre = rng.standard_normal(20)
        for _ in range(20):
            rows.append([len(rows), (centre + rng.standard_normal(20) * rng.choice([0.05, 0.25, 0.4])).astype(np.float32).tolist(), k % 3])
    rows += [[len(rows) + i, list(rows[5][1]), rows[5][2]] for i in range(40)]
    n = len(rows)
    rows += [[n, None, 1], [n + 1, [0.0] * 20, 1], [n + 2, [float("nan")] * 20, 1], [n + 3, [1.0] * 19, 1], [n + 4, [1.0, None], 1], [n + 5, list(rows[0][1]), None], [n + 6, [], 1]]
    ok = [(i, np.array(v, float), label) for i, v, label in rows[:n]]
    cos = lambda x, y: float(x @ y) / (np.sqrt(x @ x) * np.sqrt(y @ y))
    links = [(a, b) for i, (a, x, p) in enumerate(ok) for b, y, q in ok[i + 1:] if p == q and cos(x, y) >= 0.93]
    want, count = parts([r[0] for r in rows], links), np.bincount([x for ab in links for x in ab], minlength=len(rows))
    got = V.vector_links(frame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, n_links int, kept string")).collect()
    assert {r.id: (r.n_links, r.component_id, r.kept) for r in got} == {i: (count[i], want[i], want[i] == i) for i in want} and len(got) == len(rows)
    assert V.vector_links(frame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_vectors_are_dealt_out_by_chunks_only(frame, monkeypatch):
    """Near copies in one direction (whole tiles of links) among others, in chunks of two sizes: right, and no vector staged or dealt out by blocks or cells."""
    rng = np.random.default_rng(6)
    centre = rng.standard_normal(24)
    close, far = centre + rng.standard_normal((260, 24)) * 0.12, rng.standard_normal((200, 24))
    rows = [[i, x.astype(np.float32).tolist(), 0] for i, x in enumerate(np.concatenate([close, far])[rng.permutation(460)])]
    zero = [0.0, -0.0]
    rows += [[460, [zero[0], *rows[3][1][1:]], 0], [461, [zero[1], *rows[3][1][1:]], 0], [462, rows[7][1], 1], [463, rows[7][1], 0]]
    x = np.array([r[1] for r in rows if r[2] == 0], float)
    ids = [r[0] for r in rows if r[2] == 0]
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    links = [(ids[a], ids[b]) for a, b in np.argwhere(np.triu(unit @ unit.T >= 0.93, 1))]
    want, count = parts([r[0] for r in rows], links), np.bincount([x for ab in links for x in ab], minlength=len(rows))
    assert len(links) > 20_000
    table, dealt, written = frame(rows, "vec_id long, embedding array<float>, label int"), [], V.written

    def counted(df, name):
        held = written(df, name)
        dealt.append((name, held.count(), bool({"v", "vector"} & set(held.columns))))
        return held

    monkeypatch.setattr(V, "written", counted)
    monkeypatch.setattr(V, "PAIRS", 500)
    for chunk, values in ((100, 1 << 22), (4096, 24 * 120)):
        monkeypatch.setattr(V, "CHUNK", chunk)
        monkeypatch.setattr(V, "CHUNK_VALUES", values)
        got = V.vector_links(table.selectExpr("vec_id", "cast(embedding as array<double>) embedding", "label") if values < 1 << 22 else table).collect()
        assert {r.id: (r.n_links, r.component_id, r.kept) for r in got} == {i: (count[i], want[i], want[i] == i) for i in want} and len(got) == len(rows)
    assert sum(n for _, n, whole in dealt if whole) <= 2 * len(rows)  # once a call
    alike = table.selectExpr("label", "vec_id node", "1 n", "size(embedding) dims", "embedding v").where("label = 0")
    monkeypatch.setattr(V, "CHUNK_VALUES", 1 << 22)
    assert V.chunk_pairs(alike).count() <= V.PARTS * len(rows)


def test_url_rules_and_aliases(frame):
    link = lambda u: f'<LINK href="{u}" rel="canonical">'
    pages = [(1, "http://a.example.com/en/x", link("/fr/y"), "x"), (2, "http://a.example.com/fr/y?q#f", None, "x"), (3, "https://b.org/1", link("//a.example.com/en/x"), "x"),
             (4, "http://c.org/", '<meta http-equiv="refresh" content="0; url=http://d.org/p">', "x"), (5, "http://D.org/p", link("http://e.net/es/"), "x"), (6, None, None, "x"), (7, "nothing", link("http://e.net/es/"), "x"),
             (8, "http://WWW.example.com/en/", "", "x"), (9, "http://example.com", "", "x"), (10, "http://notexample.com/en/", "", "x"), (4, "http://c.org/", "", "x")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge_urls(frame(pages, "page_id int, url string, html string, rule string")).collect()}
    assert got == {1: ("a.example.com", "/en/x", "example.com/en/", "block"), 2: ("a.example.com", "/fr/y", "com/", "allow"), 3: ("b.org", "/1", None, "allow"),
                   4: ("c.org", "/", None, "block"), 5: ("d.org", "/p", None, "block"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"),
                   8: ("www.example.com", "/en/", "www.example.com/en/", "allow"), 9: ("example.com", "", None, "allow"), 10: ("notexample.com", "/en/", "com/", "allow")}
    assert U.judge_urls(frame([], "page_id int, url string, html string")).count() == 0


def test_pipeline_keeps_its_promises(spark, small):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["toxicity", "line_dedup", "near_dedup", "secrets", "packing"]
    now = spark.read.parquet(f"{small}/documents.parquet")
    for name in list(stage)[:-1]:
        now = stage[name](spark, now, small)
        assert now.columns == corpus_pipeline.COLUMNS
    left = {r.doc_id: r.text for r in now.collect()}
    assert set(left) <= set(docs) and len(left) > len(docs) // 2 and not any(re.search("AKIA[A-Z0-9]{14}", t or "") for t in left.values())
    packed = __spark_entry__.queries()["pipeline"](spark, small)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(left)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_entry_point_without_the_corpus_operators(tmp_path):
    """The rest imports where both folders and the pipeline are missing."""
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__spark_entry__.__file__).parent
    shutil.copytree(root / "stoplens", tmp_path / "stoplens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert out.stdout.split()[1] == "False"

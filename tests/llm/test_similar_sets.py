"""Near-duplicates by exact shingle similarity against brute force."""

import random

import pytest

import corpus_pipeline
from stoplens.llm import similar_sets as S

DOCS = "doc_id long, text string"


def sets_of(texts):
    words = [(t or "").lower().split() for t in texts]
    return [{" ".join(w[i:i + 5]) for i in range(len(w) - 4)} or ({" ".join(w)} if w else set()) for w in words]


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def components(texts):
    sets, least = sets_of(texts), list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])) and least[i] != least[j]:
                low, high = sorted((least[i], least[j]))
                least = [low if c == high else c for c in least]
    return least


def copies_at(edits, count, words=300):
    """Pairs of a text and a copy in which so many words, far from each other, are replaced."""
    texts = []
    for n in range(count):
        own = [f"w{n}x{random.randrange(9999)}" for _ in range(words)]
        copy = list(own)
        for k in range(edits):
            copy[5 + k * 9] = f"new{n}x{k}"
        texts += [" ".join(own), " ".join(copy)]
    return texts


def kept_by(stage, frame, texts):
    rows = [(i, t, "en", "web", len(t or "")) for i, t in enumerate(texts)]
    return sorted(r.doc_id for r in stage(None, frame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "").collect())


def test_the_stage_links_no_pair_below_the_similarity(frame):
    random.seed(3)
    texts = copies_at(7, 40)
    similar = [jaccard(*sets_of(texts[i:i + 2])) for i in range(0, 80, 2)]
    assert 0.77 < min(similar) and max(similar) < 0.8
    assert kept_by(corpus_pipeline.near_dedup, frame, texts) == list(range(80))


def test_the_stage_finds_every_pair_just_above_the_similarity(frame):
    random.seed(4)
    texts = copies_at(6, 60) + copies_at(5, 20)
    similar = [jaccard(*sets_of(texts[i:i + 2])) for i in range(0, 160, 2)]
    assert 0.8 <= min(similar) and max(similar) < 0.85
    short = [t for n in range(40) for t in (" ".join(f"s{n}w{k}" for k in range(8)), " ".join(f"s{n}w{k}" for k in range(9)))]
    assert {jaccard(*sets_of(short[i:i + 2])) for i in range(0, 80, 2)} == {0.8}
    assert kept_by(corpus_pipeline.near_dedup, frame, texts + short) == list(range(0, 240, 2))


@pytest.mark.parametrize(("sample", "chunk"), [(16, 1024), (1, 3)])
def test_components_match_brute_force(frame, monkeypatch, sample, chunk):
    monkeypatch.setattr(S, "SAMPLE", sample)
    monkeypatch.setattr(S, "CHUNK", chunk)
    random.seed(5)
    words = ["".join(random.choice("abcdefghij") for _ in range(4)) for _ in range(300)]
    line, texts = " ".join(random.choice(words) for _ in range(30)), ["", None, " ", "One", "one", "one two"]
    for _ in range(12):
        own = [random.choice(words) for _ in range(random.choice([8, 20, 60, 240]))]
        for k in range(12):
            copy = list(own)
            for at in random.sample(range(len(own)), min(k, len(own) // 5)):
                copy[at] = random.choice(words)
            texts.append(" ".join(copy[:len(copy) - random.randrange(1 + len(copy) // 8)]) + random.choice(["", " " + line]))
    want = components(texts)
    assert 12 < len(set(want)) < len(texts) - 12
    rows = [*enumerate(texts), (7, texts[7]), (None, "")]
    got = S.similar_sets(frame(rows, DOCS)).collect()
    assert len(got) == len(rows) and all(r.component_id == (0 if r.id is None else want[r.id]) for r in got)
    assert sorted(r.doc_id for r in S.drop_similar_sets(frame(rows, DOCS)).collect()) == sorted(set(want))
    assert S.similar_sets(frame([], DOCS)).count() == 0


def test_simhash_comes_first(frame, monkeypatch):
    """Fingerprint pairs are asked for and confirmed: strangers that share a fingerprint stay apart."""
    random.seed(6)
    texts = copies_at(1, 12)
    asked = []
    real = S.simhash_pairs
    monkeypatch.setattr(S, "simhash_pairs", lambda heads: asked.append(real(heads)) or asked[0])
    assert kept_by(corpus_pipeline.near_dedup, frame, texts) == list(range(0, 24, 2))
    assert len(asked) == 1 and asked[0].count() >= 1
    monkeypatch.setattr(S, "majority", lambda hashes: 7)
    rows = [(i, i + 1, 7, 5, [i]) for i in range(4)]
    heads = frame(rows, "row long, node long, fp long, size int, head array<long>")
    assert sorted(map(tuple, real(heads).collect())) == [(2, 1), (3, 1), (4, 1)]
    assert real(heads.limit(0)).count() == 0

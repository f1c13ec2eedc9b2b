"""Whitening, filter audit and passage attention against plain versions."""

import re
import zlib
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stoplens.llm import bit_whitening as W
from stoplens.llm import filter_audit as A
from stoplens.llm import passage_attention as P

NAN, INF = float("nan"), float("inf")
VECTORS = "vec_id long, embedding array<double>, whitened string, n int"


def test_cross_products_are_exact():
    rng = np.random.default_rng(1)
    for low, high, n, d in ((0, 2, 1, 1), (-5, 6, 63, 3), (99_000, 101_000, 200, 5), (-2 ** 61, 2 ** 61, 70, 4), (7, 8, 65, 2)):
        x = rng.integers(low, high, (n, d))
        one = np.column_stack([x, np.ones(n, np.int64)]).astype(object)
        assert (W.cross_products(x) == one.T @ one).all()


def test_whitening_against_numpy(frame):
    rng = np.random.default_rng(2)
    vectors = (rng.normal(size=(400, 6)) @ rng.normal(size=(6, 6))).tolist()
    rows = [(i, v, "clash", 3) for i, v in enumerate([*vectors, vectors[0]])] + [
        (None, vectors[1], None, None), (900, None, "", 1), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0], "", 1), (902, [NAN] * 6, "", 1), (903, [INF] * 6, "", 1), (904, [1.0] * 5, "", 1), (905, [], "", 1)]
    got = W.whiten(frame(rows, VECTORS), components=4).toPandas()
    kept = [*vectors, vectors[0], vectors[1]]
    x = np.floor(np.array(kept) * 1024).astype(np.int64) + 100_000
    assert len(got) == 4 * len(x) and set(got["n"]) == {len(x)}
    assert got.groupby("id", dropna=False).size().eq(4).all()
    values, vectors_ = np.linalg.eigh(np.cov(x.T.astype(float), bias=True))
    exact = ((len(x) * x.astype(object) - x.astype(object).sum(axis=0)) ** 2).sum(axis=1)
    for k in range(4):
        part = got[got.component == k + 1].sort_values("id").reset_index(drop=True)
        want = (x - x.mean(axis=0)) @ vectors_[:, -1 - k] / np.sqrt(values[-1 - k])
        sign = np.sign(want[0] * part.whitened[0])
        assert np.abs(part.whitened - sign * want).max() < 1e-9
        assert [int(v) for v in part.deviation] == exact.tolist()
        assert part.explained.iloc[0] == pytest.approx(values[-1 - k] / values.sum(), rel=1e-9)
    assert got.identity_error.max() < 1e-9


def test_whitening_of_odd_tables(frame):
    assert W.whiten(frame([], VECTORS)).count() == 0
    assert W.whiten(frame([(1, None, "", 1), (2, [], "", 1)], VECTORS)).count() == 0
    same = W.whiten(frame([(1, [2.0, 3.0], "", 1)] * 3, VECTORS)).collect()
    assert len(same) == 6 and all(r.whitened is None and r.deviation == 0 and r.identity_error is None and r.explained == 0 for r in same)
    flat = W.whiten(frame([(i, [float(i), 1.0], "", 1) for i in range(4)], VECTORS)).orderBy("id", "component").collect()
    assert [r.whitened is None for r in flat] == [False, True] * 4
    far = W.whiten(frame([(1, [1e30, 1.0], "", 1), (2, [-1e30, 5.0], "", 1), (3, [1e-300, 2.0], "", 1)], VECTORS)).collect()
    assert len(far) == 6 and all(r.identity_error < 1e-4 for r in far)


def test_long_sums_do_not_overflow(spark):
    """Limbs of many tasks: far entries in 40 partitions."""
    rows = [(i, [float(2 ** 50 + i * 977), float(-(2 ** 49) + i)], "", 1) for i in range(200)]
    df = spark.createDataFrame(rows, VECTORS).repartition(40)
    kept, width = W.usable(df)
    model = W.fit_whitener(kept, width)
    x = [[int(v * 1024) + 100_000 for v in r[1]] for r in rows]
    assert model.sums == [sum(c) for c in zip(*x, strict=True)]
    mean = [sum(c) / 200 for c in zip(*x, strict=True)]
    assert model.trace == pytest.approx(sum((v - m) ** 2 for r in x for v, m in zip(r, mean, strict=True)) / 200, rel=1e-6)


DOCS = "doc_id long, text string, lang string, part string, mask int"
LABELS = "doc_id long, quality int, toxic int, good boolean, lang string"


def masks_by_hand(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    out = []
    for i, text, lang in docs:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        fails = ""
        fails += "A" * (len(words) < 100) + "B" * (100 * len(set(words)) < 80 * len(words))
        fails += "C" * (100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text)) + "D" * any(c in "#$%&*|" for c in text)
        fails += "E" * (i is not None and i > first[text])
        out.append((lang or "", fails, i in good, i in toxic))
    return out


def audit_by_hand(masks):
    rows = {}
    for part in {m[0] for m in masks}:
        own = [m for m in masks if m[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [m for m in left if letter in m[1]]
                left = [m for m in left if letter not in m[1]]
                failing = [m for m in own if letter in m[1]]
                rows[part, order, step] = [len(left), len(gone), len(failing) - len(gone), sum(m[1] == letter for m in own), sum(m[2] for m in gone), sum(m[3] for m in gone)]
        for letter in "ABCDE":
            total = sum(r[1] for (p, o, s), r in rows.items() if p == part and o[s - 1] == letter)
            for (p, o, s), r in rows.items():
                if p == part and o[s - 1] == letter:
                    r.append(total)
    return rows


def test_audit_against_plain_python(frame):
    rng = np.random.default_rng(4)
    texts = [None, "", " \t", "A" * 50, "é" * 30, "#", "\x0b\x0c a", "    b", "word " * 150, " ".join(f"w{i}" for i in range(120)), " ".join(f"w{i}" for i in range(99)),
             " ".join(f"W{i}" for i in range(100)), "x | y " * 60, "🏽 Ab" * 40, "long " + "Zz9 " * 300_000]
    docs = [(i, texts[rng.integers(len(texts))], [None, "", "en", "fr"][rng.integers(4)]) for i in range(120)]
    docs += [docs[3], docs[3], (None, "", "en"), (None, "", "en"), (None, "#", None), (500, None, "zz")]
    labels = [(i, int(rng.integers(2)), int(rng.integers(2))) for i in range(0, 120, 2)] + [(0, 1, 1), (0, 0, None), (None, 1, 1), (7, None, None), (9999, 1, 1)]
    got = A.audit(A.document_masks(frame([(*d, "clash", 1) for d in docs], DOCS), frame([(*r, True, "clash") for r in labels], LABELS))).collect()
    assert {(r.part, r.filter_order, r.step): list(r)[3:] for r in got} == audit_by_hand(masks_by_hand(docs, labels))
    assert len(got) == 600 * len({r.part for r in got})


def test_audit_of_empty_tables_and_large_counts(frame):
    assert A.audit(A.document_masks(frame([], DOCS), frame([], LABELS))).count() == 0
    alone = A.audit(A.document_masks(frame([(1, "x", "en", "", 1)], DOCS), frame([], LABELS))).where("filter_order = 'ABCDE'").orderBy("step").collect()
    assert [r.removed for r in alone] == [1, 0, 0, 0, 0] and [r.kept for r in alone] == [0] * 5
    huge = frame([("", m, True, False, 2 ** 57) for m in range(32)], "part string, mask int, good boolean, toxic boolean, documents long")
    rows = A.audit(huge).where("filter_order = 'EDCBA'").orderBy("step").collect()
    assert [r.removed for r in rows] == [2 ** 61, 2 ** 60, 2 ** 59, 2 ** 58, 2 ** 57] and [r.redundant for r in rows] == [2 ** 61 - r.removed for r in rows]
    assert [r.good_lost for r in rows] == [r.removed for r in rows] and {r.toxic_lost for r in rows} == {0} and {r.unique_fails for r in rows} == {2 ** 57}


def passages_by_hand(text):
    """(words, distinct share, repeated share, characters by kind) of each passage of 64 words."""
    found = list(re.finditer(rb"[^\x20\x09-\x0d]+", text))
    out = []
    for k in range(0, len(found), P.PASSAGE):
        words = [m[0] for m in found[k:k + P.PASSAGE]]
        end = found[k + P.PASSAGE].start() if k + P.PASSAGE < len(found) else len(text)
        body = text[found[k].start():end]
        kinds = np.bincount(P.KIND_OF[list(body)], minlength=len(P.KINDS) + 1)
        pairs = np.zeros(P.BUCKETS)
        low = body.translate(bytes(P.LOWER.tolist()))
        for a, b in zip(low, low[1:], strict=False):
            pairs[P.PAIR[a * 256 + b]] += 1
        out.append((pairs, kinds, len(words), len(set(words)) / len(words), sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words), np.mean([len(w) for w in words])))
    return out


def test_passages_against_plain_python():
    rng = np.random.default_rng(6)
    texts = [b"", b" \n", b"one", b"  lead and trail \n", "é #x| \n\n TWO two two".encode(), (b"ab ab cd\n" * 90), " ".join("".join(rng.choice(list("abcdEF"), 3)) for _ in range(200)).encode(), b"\x0bq\x0c" * 70]
    features, owner = P.encode(texts)
    for i, text in enumerate(texts):
        want, got = passages_by_hand(text), features[owner == i]
        assert len(got) == max(len(want), 1)
        if not want:
            assert not got.any()
        for row, (pairs, kinds, n, distinct, again, mean) in zip(got, want, strict=False):
            assert np.allclose(row[:P.BUCKETS] ** 2, pairs / max(pairs.sum(), 1), atol=1e-5)
            assert np.allclose(row[P.BUCKETS:-P.STATS] ** 2, kinds / max(kinds.sum(), 1), atol=1e-5)
            assert np.allclose(row[-P.STATS:][:4], [np.log1p(n), distinct, again, np.log1p(mean)], atol=1e-5)


def small_model(rng):
    f = P.FEATURES
    return P.Attention(np.zeros(f), np.ones(f), rng.normal(size=(f, 5)), rng.normal(size=5), rng.normal(size=(5, 4)), rng.normal(size=(5, 4)), rng.normal(size=4), rng.normal(size=5), rng.normal(size=1))


def test_slopes_match_differences():
    rng = np.random.default_rng(8)
    model = small_model(rng)
    counts, label, weight = np.array([1, 4, 2, 3]), np.array([1.0, 0, 1, 0]), np.array([1.0, 2, 1, 3])
    x = rng.normal(size=(10, P.FEATURES)) / 8
    _, slope = P.slopes(model, x, counts, label, weight)
    for name in P.LEARNED:
        value = getattr(model, name)
        for at in [tuple(rng.integers(0, n) for n in value.shape) for _ in range(4)]:
            kept = value[at]
            value[at] = kept + 1e-5
            up = P.slopes(model, x, counts, label, weight)[0]
            value[at] = kept - 1e-5
            down = P.slopes(model, x, counts, label, weight)[0]
            value[at] = kept
            assert slope[name][at] == pytest.approx((up - down) / 2e-5, rel=1e-4, abs=1e-7)


def score_by_hand(model, text):
    features, _ = P.encode([text])
    h = np.tanh(features @ model.E + model.e)
    s = (np.tanh(h @ model.V) / (1 + np.exp(-(h @ model.U)))) @ model.w
    a = np.exp(s) / np.exp(s).sum()
    return 1 / (1 + np.exp(-((a[:, None] * h).sum(axis=0) @ model.c + model.b[0])))


QUALITY = "doc_id long, text string, lang string, score string, focus int"


def test_scores_against_plain_python(frame):
    model = small_model(np.random.default_rng(9))
    texts = [None, "", " ", "one", "é è | # 1", "word " * 500, "Long1 tail, " * 20_000, "word " * 500]
    got = P.score_quality(frame([(i if i else None, t, "en", "clash", 1) for i, t in enumerate(texts)], QUALITY), model).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.score == pytest.approx(score_by_hand(model, (r.text or "").encode()), rel=1e-9)
        assert r.predicted == (r.score >= 0.5) and r.lang == "en" and 0 <= r.focus < r.n_passages
    assert P.score_quality(frame([], QUALITY), model).count() == 0


def test_very_long_text_in_segments(frame):
    """A text of several segments scores as its passages, which end at segments too; no word is lost."""
    text = " ".join(f"w{i % 977}" for i in range(700_000))
    pieces = P.segments(text.encode())
    assert len(pieces) > 2 and b"".join(pieces) == text.encode() and all(p[:1] == b" " for p in pieces[1:])
    model = small_model(np.random.default_rng(9))
    one = P.score_quality(frame([(1, text, "en", "", 1), (2, "x " * 9, "en", "", 1)], QUALITY), model).orderBy("doc_id").collect()
    assert one[0].n_passages == sum(-(-len(p.split()) // P.PASSAGE) for p in pieces) and one[1].n_passages == 1


def quality_rows(rng, n):
    good, bad = ["the", "house", "of", "green", "river", "stands", "by", "old", "town", "wall", "and"], ["x|", "ZZ#", "9|9"]
    rows, labels = [], []
    for i in range(n):
        q = int(rng.random() < 0.6)
        rows.append((i, " ".join(rng.choice(good if q else good + bad * 4, int(rng.integers(5, 200)))), "en", "", 1))
        labels.append((i, q, 0, None, "en"))
    return rows, labels


def test_learns_from_labels_that_are_not_held_out(frame):
    rng = np.random.default_rng(11)
    rows, labels = quality_rows(rng, 400)
    held = {i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1}
    odd = [(None, 1, 0, None, ""), (3, None, 0, None, ""), (12345, 1, 0, None, "")]
    docs = frame(rows, QUALITY)
    model = P.fit_quality(docs, frame([*labels, *odd], LABELS))
    got = {r.doc_id: r for r in P.score_quality(docs.withColumn("out", P.held_out(F.col("doc_id"))), model).collect()}
    assert {i for i, r in got.items() if r.out} == held
    right = [got[i].predicted == q for i, q, *_ in labels if i in held]
    assert np.mean(right) >= 0.95
    flipped = P.fit_quality(docs, frame([*[(i, 1 - q if i in held else q, t, g, x) for i, q, t, g, x in labels], *odd], LABELS))
    assert all(np.array_equal(getattr(model, k), getattr(flipped, k)) for k in P.LEARNED)


def test_nothing_to_learn(frame):
    docs = frame([(1, "a", "en", "", 1), (2, None, "en", "", 1)], QUALITY)
    assert P.fit_quality(docs, frame([], LABELS)) == 0.5
    a, b = [i for i in range(5, 50) if zlib.crc32(str(i).encode()) % 3 != 1][:2]
    assert P.fit_quality(docs, frame([(a, 1, 0, None, ""), (b, None, 0, None, "")], LABELS)) == 1.0
    assert P.fit_quality(docs, frame([(a, 1, 0, None, ""), (b, 0, 0, None, "")], LABELS)) == 0.5  # neither has a text
    got = P.score_quality(docs, 0.5).collect()
    assert [(r.score, r.predicted, r.focus) for r in got] == [(0.5, 1, None)] * 2

"""Line windows, piece encoding, packing, token attribution and toxicity against plain Python and the libraries."""

import random
import struct

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from stoplens.llm import line_windows as L
from stoplens.llm import token_attribution as A
from stoplens.llm import toxicity_grades as T
from stoplens.llm.best_fit import OpenBins, cut, pack_documents
from stoplens.llm.byte_bpe import encoder
from stoplens.llm.sentencepiece_bpe import encode_documents, model

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, ids int, removed string"
ODD = ["", " ", "  a  b ", "a\n\nb\tc.", "▁x ▁", "<s></s><|endoftext|> x", "é🏽中文 　a b", "x" * 3000, "\0\x1c", "it's, we'll!! ...", "\n\n\n", "hello, world. " * 50]


def strings(n, seed):
    random.seed(seed)
    alphabet = list("aabcdet  \n.,'’S12é中▁ 😀")
    return ["".join(random.choice(alphabet) for _ in range(random.randint(0, 60))) for _ in range(n)]


def without_repeats(docs):
    """Lines left of [(id, text)], by the definition."""
    seen, gone = set(), {}
    for i, text in sorted(docs):
        lines = [(k, x.strip(" \t\r")) for k, x in enumerate(text.split("\n")) if x.strip(" \t\r\x0b\x0c")]
        for w in zip(lines, lines[1:], lines[2:], strict=False):
            key = tuple(x for _, x in w)
            if key in seen:
                gone.setdefault(i, set()).update(k for k, _ in w)
            seen.add(key)
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ())) for i, t in docs}


def test_line_windows_match_the_definition(frame):
    random.seed(2)
    docs = [(i, "\n".join(random.choice(["a", "b", "c", " a", "", "d e"]) for _ in range(random.randint(0, 14)))) for i in range(60)]
    got = {r.doc_id: r.text for r in L.drop_repeated_lines(frame([(i, t, 1, "clash") for i, t in docs], DOCS)).collect()}
    assert got == without_repeats(docs)


def test_line_windows_of_nulls_and_repeated_rows(frame):
    rows = [(None, "a\nb\nc", 1, "x"), (1, "a\nb\nc\nd", 1, "x"), (1, "a\nb\nc\nd", 1, "x"), (2, None, None, None), (3, "a\nb", 1, "x")]
    got = sorted((r.doc_id or 0, r.text, r.n_removed, r.n_lines) for r in L.drop_repeated_lines(frame(rows, DOCS)).collect() if r.text is not None)
    assert got == [(0, "a\nb\nc", 0, 3), (1, "d", 3, 4), (1, "d", 3, 4), (3, "a\nb", 0, 2)]
    assert L.drop_repeated_lines(frame([], DOCS)).count() == 0


def test_pieces_are_the_librarys(frame):
    sp = model(PIECES).library
    texts = ODD + strings(300, 4)
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)] + [(-1, None, None, None)] * 2
    got = encode_documents(frame(rows, DOCS), PIECES).collect()
    assert len(got) == len(rows)
    for r in got:
        want = sp.encode(texts[r.id]) if r.id >= 0 else []
        assert list(r.ids) == want and r.decoded == sp.decode(want)


def test_byte_ids_and_spans_are_the_librarys():
    own = encoder(BYTES)
    texts = ODD + strings(2000, 5)
    for at in range(0, len(texts), 100):
        for t, ids in zip(texts[at:at + 100], own.encode(texts[at:at + 100]), strict=True):
            e = own.library.encode(t, add_special_tokens=False)
            assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == e.ids
            starts, ends = own.spans(t, ids)
            for (a, b), s, z in zip(e.offsets, starts, ends, strict=True):
                assert s <= a and z == b  # the library leaves the blank before a word out


def test_packing_is_whole_and_gapless(frame):
    texts = ODD + strings(200, 6)
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)] + [(-1, None, 1, "x")]
    got = pack_documents(frame(rows, DOCS), BYTES, length=64, most_open=8).collect()
    for i, t in [*enumerate(texts), (-1, "")]:
        want = encoder(BYTES).encode([t])[0] + struct.pack("<I", 2)
        own = sorted((r for r in got if r.id == i), key=lambda r: r.piece)
        assert b"".join(bytes(r.tokens) for r in own) == want and [r.start for r in own] == [a for a, _ in cut(len(want) // 4, 64)]
    for s in {r.sequence_id for r in got}:
        at = 0
        for r in sorted((r for r in got if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert cut(5, 4) == [(0, 1), (1, 4)] and cut(4, 4) == [(0, 4)] and cut(0, 4) == []


def test_best_fit_takes_the_tightest_bin_and_closes_the_fullest():
    bins = OpenBins(10, 2)
    assert [bins.place(n) for n in (4, 7, 3, 5)] == [(0, 0), (1, 0), (1, 7), (0, 4)]
    assert bins.place(6) == (2, 0) and bins.place(8) == (3, 0) and bins.place(4) == (2, 6) and bins.n_open == 1


def test_attribution_rules(frame):
    starts, ends, low, high = np.array([0, 2, 3]), np.array([2, 5, 9]), np.array([0, 4, 4, 8]), np.array([4, 4, 8, 8])
    of = lambda rule: A.allocate(starts, ends, low, high, rule)[0].tolist()
    assert of("first") == [3, 0, 0, 0] and of("last") == [1, 0, 1, 0] and of("largest") == [2, 0, 1, 0]
    assert of("shared") == pytest.approx([1 + 2 / 3 + 1 / 6, 0, 1 / 3 + 4 / 6, 0])


def test_attribution_covers_all_tokens(frame):
    texts = ODD + strings(50, 7)
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)] + [(-1, None, 1, "x")]
    got = A.attribute_tokens(frame(rows, DOCS), BYTES).collect()
    for i, t in [*enumerate(texts), (-1, "")]:
        own = sorted((r for r in got if r.id == i), key=lambda r: r.section)
        assert [t[r.start:r.end] for r in own] == t.splitlines(True) + [""] * (t.endswith("\n") or not t) if "\x1c" not in t else True
        assert sum(r.tokens for r in own) == own[0].document_tokens == len(encoder(BYTES).encode([t])[0]) // 4
    given = frame([(1, "ab cd", [(0, 2)]), (2, "ab", None)], "doc_id long, text string, parts array<struct<start:int,end:int>>")
    assert [(r.id, r.tokens) for r in A.attribute_tokens(given, BYTES, sections="parts").collect()] == [(1, 1.0)]


def test_toxicity_learns_words_and_starts(frame):
    random.seed(8)
    word = lambda: "".join(random.choice("abcdefghij") for _ in range(random.randint(3, 9)))
    rows, labels = [], []
    for i in range(900):
        toxic = i % 9 == 0
        bad = ["vile"] * (i % 2) + [random.choice(["zork", "zorkan", "zorkest", "zorki"]) + word() for _ in range(2)] if toxic else []
        rows.append((i, " ".join(random.sample(bad + [word() for _ in range(40)], len(bad) + 40)), 1, "x"))
        if i < 600:
            labels.append((i, int(not (toxic and i % 2)), int(toxic)))
    docs, known = frame([*rows, (None, None, None, None)], DOCS), frame([*labels, labels[0], (1, 1, None)], "doc_id long, quality int, toxic int")
    scored = T.score_toxicity(docs, T.fit_toxicity(docs, known)).collect()
    assert len(scored) == 901
    held = [r for r in scored if r.doc_id is not None and r.doc_id >= 600]
    assert np.mean([r.toxic == (r.doc_id % 9 == 0) for r in held]) > 0.97
    assert all(abs(sum(r.grade_chances) - 1) < 1e-9 and 0 <= r.severity <= 2 for r in scored)


def test_toxicity_without_two_grades_leaves_every_document_clean(frame):
    docs = frame([(1, "a vile word", 1, "x"), (1, "a vile word", 1, "x"), (2, "", 1, "x"), (None, None, None, None)], DOCS)
    for labels in ([], [(1, 1, 1)], [(1, 1, 0), (2, 0, 0)], [(1, 1, 0), (77, 0, 1)], [(None, 1, 1), (1, None, None)]):
        with pytest.warns(UserWarning, match="two grades"):
            fitted = T.fit_toxicity(docs, frame(labels, "doc_id long, quality int, toxic int"))
        scored = T.score_toxicity(docs, fitted).collect()
        assert len(scored) == 4 and all((r.score, r.severity, r.toxic, r.grade_chances[0]) == (0.0, 0.0, False, 1.0) for r in scored)


def test_toxicity_sample_drops_copies_within_a_grade_only(frame):
    long = "incomprehensibilities"
    texts = [(f"{long} a{'b' * i}", i % 2) for i in range(20)] + [(f"{long.upper()} AB!", 1), (f"{long}, ab", 1), (f"{long} ab", 0)]
    docs = frame([(i, t, 1, "x") for i, (t, _) in enumerate(texts)], DOCS)
    grades = frame([(i, g) for i, (_, g) in enumerate(texts)], "_id long, grade int")
    sizes = {r.grade: r["count"] for r in T.labelled_sample(docs, grades, 2, "doc_id", "text", 100).groupBy("grade").count().collect()}
    assert sizes == {0: 11, 1: 10}
    few = T.labelled_sample(docs, grades, 2, "doc_id", "text", 3).groupBy("grade").count().collect()
    assert all(r["count"] <= 3 for r in few)


def likelihood(values, rows, grades, weight, n_words, n_grades):
    """Weighted mean log-likelihood by the definition, a document at a time."""
    cuts = [-np.inf, *(values[n_words] + np.concatenate([[0.0], np.cumsum(np.exp(values[n_words + 1:]))])), np.inf]
    below = lambda c, s: 1 / (1 + np.exp(-(c - s)))
    return sum(w * np.log(below(cuts[g + 1], s) - below(cuts[g], s)) for r, g, w in zip(rows, grades, weight / weight.sum(), strict=True)
               for s in [sum(values[i] for i in r)])


def test_ordinal_fit_reaches_the_maximum_of_the_likelihood():
    rng = np.random.default_rng(4)
    rows = [sorted(rng.choice(5, rng.integers(0, 4), replace=False).tolist()) for _ in range(400)]
    push = np.array([1.5, -1.0, 0.7, 0.0, 2.0])
    grades = np.digitize([push[r].sum() + rng.logistic() for r in rows], [0.5, 2.0])
    weight = rng.uniform(0.5, 2, 400)
    weights, cuts = T.fit_ordinal(rows, grades, weight, 5, 3, lasso=0.0, rounds=3000)
    best = np.concatenate([weights, cuts[:1], np.log(np.diff(cuts))])
    at = likelihood(best, rows, grades, weight, 5, 3)
    for i in range(len(best)):
        step = np.zeros(len(best))
        step[i] = 1e-4
        slope = (likelihood(best + step, rows, grades, weight, 5, 3) - likelihood(best - step, rows, grades, weight, 5, 3)) / 2e-4
        assert abs(slope) < 3e-3 or weights[i:i + 1].tolist() == [0.0]
    assert all(likelihood(best + rng.normal(0, 0.3, len(best)), rows, grades, weight, 5, 3) < at for _ in range(30))
    assert np.abs(weights - push).max() < 0.6

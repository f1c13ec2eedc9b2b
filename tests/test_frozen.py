"""As-of joins, freezing and snapshots against replays."""

import random

from stoplens.operators import frozen as fr
from stoplens.operators import models as ml

CARD = "analysis_id string, card_id string, seq long"


def test_last_before_against_a_replay(spark):
    """One card holds most of the history; ties, nulls and cards without history included."""
    rng = random.Random(4)
    card = lambda: rng.choice(["hot"] * 8 + ["b", "c", None])
    history = [("a", card(), rng.randrange(300) if rng.random() > 0.03 else None, rng.choice(["x", "y", None]), rng.randrange(3)) for _ in range(900)]
    asked = [("a", card(), rng.randrange(-5, 320), i) for i in range(400)] + [("a", "alone", 9, 1000), ("a", "hot", None, 1001), (None, "hot", 5, 1002)]
    got = fr.last_before(spark.createDataFrame(asked, CARD + ", n int").repartition(3), spark.createDataFrame(history, CARD + ", label string, weight int"),
                         fr.CARD, "seq", ["label", "weight"], parts=7).collect()
    assert len(got) == len(asked)
    order = lambda h: (h[2], h[3] is not None, h[3] or "", h[4])
    for r in got:
        before = [h for h in history if h[1] is not None and h[2] is not None and r["seq"] is not None and (h[0], h[1]) == (r["analysis_id"], r["card_id"]) and h[2] <= r["seq"]]
        want = max(before, key=order)[3:] if before else (None, None)
        assert (r["label"], r["weight"]) == want, r


def test_empty_tables(spark):
    none = spark.createDataFrame([], CARD + ", label string")
    some = spark.createDataFrame([("a", "c", 1, "x")], CARD + ", label string")
    assert fr.last_before(none.drop("label"), some, fr.CARD, "seq", ["label"]).count() == 0
    assert [r["label"] for r in fr.last_before(some.drop("label"), none, fr.CARD, "seq", ["label"]).collect()] == [None]


def replay(clicks, suggestions):
    """Frozen class of each card, event by event."""
    frozen = {}
    for key in {c[:2] for c in clicks}:
        state = None
        for _, _, seq, valid in sorted(c for c in clicks if c[:2] == key):
            if not valid:
                state = None
            elif state is None:
                seen = [s for s in suggestions if s[:2] == key and s[2] <= seq]
                state = (seq, max(seen, key=lambda s: s[2])[3] if seen else None)
        if state:
            frozen[key] = state
    return frozen


def test_freezing_against_a_replay(spark):
    rng = random.Random(9)
    times = rng.sample(range(5000), 1200)
    rows = [("a", f"c{rng.randrange(12)}", t) for t in times]
    clicks = [(*r, rng.random() < 0.6) for r in rows[:300]]
    suggestions = [(*r, f"FALHA {rng.randrange(4)}") for r in rows[300:]]
    got = fr.frozen_classes(spark.createDataFrame(clicks, CARD + ", validated boolean"), spark.createDataFrame(suggestions, CARD + ", label string")).collect()
    assert {(r["analysis_id"], r["card_id"]): (r["frozen_at"], r["frozen"]) for r in got} == replay(clicks, suggestions)
    cards = spark.createDataFrame([("a", "c0", None, "now", True), ("a", "c1", "manual", "now", True), ("a", "c2", "", "now", False), ("a", "zz", None, "now", True)],
                                  "analysis_id string, card_id string, manual string, automatic string, validated boolean")
    known = spark.createDataFrame([("a", "c0", "then"), ("a", "c1", "then"), ("a", "c2", "then")], "analysis_id string, card_id string, frozen string")
    assert {r["card_id"]: r["class"] for r in fr.final_classes(cards, known).collect()} == {"c0": "then", "c1": "manual", "c2": "now", "zz": "now"}


VOTES = "analysis_id string, card_id string, label string, source string"


def test_snapshots_are_kept(spark, tmp_path):
    folder = str(tmp_path)
    votes = lambda *rows: spark.createDataFrame(rows, VOTES)
    cards = spark.createDataFrame([("a", "1", "late", "regra", "A", 5), ("a", "2", "late", "regra", "late", 1), ("b", "1", "late", "regra", "B", 2)],
                                  "analysis_id string, card_id string, automatic string, source string, class string, count long")
    assert {r["estimated"] for r in fr.with_snapshot(spark, cards, folder).collect()} == {True}
    fr.snapshot_suggestions(votes(("a", "1", "A", "memoria")), folder, "v1")
    fr.snapshot_suggestions(votes(("a", "1", "other", "x"), ("b", "1", "B", "aprendizado"), ("b", "1", "B", "aprendizado")), folder, "v2")
    fr.snapshot_suggestions(votes(("a", "2", "never", "x")), folder, "v2")  # a version that was entered takes nothing more
    got = {(r["analysis_id"], r["card_id"]): (r["suggested"], r["source"], r["estimated"]) for r in fr.with_snapshot(spark, cards, folder).collect()}
    assert got == {("a", "1"): ("A", "memoria", False), ("a", "2"): ("late", "regra", True), ("b", "1"): ("B", "aprendizado", False)}
    report = {r["analysis_id"]: r for r in ml.sheet_report(fr.with_snapshot(spark, cards, folder)).collect()}
    assert (report["a"]["hit_rate"], report["a"]["from_past"], report["a"]["estimated"]) == (100.0, 83.3, True)
    assert (report["b"]["hit_rate"], report["b"]["estimated"]) == (100.0, False)

from stoplens.operators import review as rv

CARDS = "analysis_id string, card_id string, column_id string, name string, suggested string, size bigint"


def run(spark, clicks, cards=None, columns=("m1", "m2")):
    cards = cards or [("a", "c1", "m1", "C1", "X", 3), ("a", "c2", "m1", "C2", "Y", 2), ("a", "c3", "m2", "C3", "Z", 1)]
    full = [("a", i, *[dict(c).get(k) for k in ("action", "card_id", "target_id", "column_id", "value", "note", "ids")]) for i, c in enumerate(clicks)]
    actions = spark.createDataFrame(full, rv.ACTION_SCHEMA)
    base = spark.createDataFrame(cards, CARDS)
    folded = rv.fold_actions(actions, base, spark.createDataFrame([("a", c) for c in columns], "analysis_id string, column_id string"))
    board = {r["card_id"]: r for r in rv.board_cards(base, folded).collect()}
    cols = {r["column_id"]: r["validated"] for r in folded["columns"].collect()}
    return board, cols, folded


def test_toggle_hold_release_and_column(spark):
    act = lambda action, **k: {"action": action, **k}
    board, cols, _ = run(spark, [
        act("validate_card", card_id="c1"), act("validate_card", card_id="c1"), act("validate_card", card_id="c1"),
        act("hold", card_id="c2", note=" ver "), act("validate_column", column_id="m1")])
    assert board["c1"]["validated"] and board["c2"]["held"] and not board["c2"]["validated"] and board["c2"]["held_note"] == "ver"
    assert cols == {"m1": True, "m2": False} and not board["c3"]["validated"]
    board, cols, _ = run(spark, [act("hold", card_id="c2"), act("validate_all"), act("release", card_id="c2", target_id="FALHA DE EIXO", value="validate")])
    assert board["c2"]["manual"] == "FALHA DE EIXO" and board["c2"]["validated"] and board["c3"]["validated"] and all(cols.values())


def test_move_inherits_and_class_returns_to_original(spark):
    act = lambda action, **k: {"action": action, **k}
    board, cols, _ = run(spark, [act("validate_column", column_id="m2"), act("move", card_id="c1", column_id="m2"),
                                 act("set_class", card_id="c2", value="falha de  motor"), act("set_class", card_id="c3", value="FALHA"),
                                 act("set_class", card_id="c3", value="Z")])
    assert board["c1"]["column_id"] == "m2" and board["c1"]["validated"] and cols["m2"]
    assert board["c2"]["manual"] == "FALHA DE MOTOR" and board["c3"]["manual"] is None


def test_merge_split_undo_redo(spark):
    act = lambda action, **k: {"action": action, **k}
    board, _, folded = run(spark, [act("merge_cards", card_id="c1", target_id="c3"), act("merge_cards", card_id="c1", target_id="c2")])
    assert set(board) == {"c2", "c3"} and board["c2"]["pinned"]
    members = spark.createDataFrame([("a", "c1", 1), ("a", "c2", 2)], "analysis_id string, card_id string, record_id bigint")
    assert {r["card_id"] for r in rv.current_members(members, folded).collect()} == {"c2"}
    board, _, _ = run(spark, [act("merge_cards", card_id="c1", target_id="c2"), act("undo")])
    assert len(board) == 3
    board, _, _ = run(spark, [act("merge_cards", card_id="c1", target_id="c2"), act("undo"), act("redo")])
    assert len(board) == 2
    board, _, folded = run(spark, [act("split_card", card_id="c1"), act("hold", card_id="c1#1")])
    assert "c1" not in board
    assert {r["card_id"] for r in rv.current_members(members, folded).collect()} == {"c1#1", "c2"}
    board, _, _ = run(spark, [act("set_class", card_id="c1", value="A"), act("undo"), act("validate_card", card_id="c1"), act("redo")])
    assert board["c1"]["manual"] is None and board["c1"]["validated"]


def test_undo_depth(spark):
    rows = [("a", i, "validate_card") for i in range(20)] + [("a", 20 + i, "undo") for i in range(20)]
    live = rv.live_actions(spark.createDataFrame(rows, "analysis_id string, seq bigint, action string"))
    assert sorted(r["seq"] for r in live.collect()) == [0, 1, 2, 3, 4]

"""Review state from an append-only action log.

review_actions(analysis_id, seq, action, card_id, target_id, column_id, value, note, ids): what people clicked. Its size
is human work, not data: a fold over one analysis reads its clicks, the cards those clicks name and one counter per
machine column. All other cards, and every stop, are handled by joins.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stoplens import fixed_values as fv
from stoplens.functions import text
from stoplens.operators.skew import lookup_join

ACTION_SCHEMA = ("analysis_id string, seq bigint, action string, card_id string, target_id string, column_id string, "
                 "value string, note string, ids array<string>")
STATE_SCHEMA = ("analysis_id string, kind string, card_id string, column_id string, merged_into string, split boolean, "
                "held boolean, held_note string, validated boolean, name string, manual string, pinned boolean")


def live_actions(actions: DataFrame, depth: int = fv.UNDO_DEPTH) -> DataFrame:
    """The actions in force after undo and redo, as (analysis_id, seq).

    An undo cancels the latest live action, a redo restores it, a new action clears the redo list; both lists keep
    ``depth`` entries. The log is streamed in order in Arrow batches; only the two short lists are held, and an action
    that falls off the undo list is emitted at once.
    """
    def resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner, undo, redo = None, [], []

        def flush():
            return [(owner, s) for s in undo]
        for batch in batches:
            out = []
            for analysis, seq, action in zip(batch["analysis_id"], batch["seq"], batch["action"]):
                if analysis != owner:
                    out += flush()
                    owner, undo, redo = analysis, [], []
                if action == "undo":
                    if undo:
                        redo = redo[-(depth - 1):] + [undo.pop()]
                elif action == "redo":
                    if redo:
                        undo.append(redo.pop())
                else:
                    undo.append(seq)
                    redo = []
                while len(undo) > depth:
                    out.append((owner, undo.pop(0)))
            yield pd.DataFrame(out, columns=["analysis_id", "seq"])
        yield pd.DataFrame(flush(), columns=["analysis_id", "seq"])

    ordered = actions.select("analysis_id", "seq", "action").repartition("analysis_id").sortWithinPartitions("analysis_id", "seq")
    return ordered.mapInPandas(resolve, "analysis_id string, seq bigint")


def _fold(frame: pd.DataFrame) -> pd.DataFrame:
    """Replay the live clicks of one analysis over its touched cards and its column counters."""
    analysis = frame["analysis_id"].iloc[0]
    rows = frame.astype(object).where(frame.notna(), None)
    cards, columns, out = {}, {}, []
    for r in rows[rows["kind"] == "column"].itertuples():
        columns[r.column_id] = {"members": r.n, "valid": 0, "validated": False, "all": 0}
    for r in rows[rows["kind"] == "card"].itertuples():
        cards[r.card_id] = {"column_id": r.column_id, "held": False, "note": None, "valid": 0, "name": r.value, "manual": None,
                            "original": r.note, "n": r.n, "merged": None, "split": False, "pinned": False, "stamp": 0, "born": r.column_id}
    clock, everywhere = 0, 0

    def is_valid(c):
        """A card's own mark, unless its column (or all columns) was validated later while it stood there off the bell."""
        if c["held"]:
            return False
        swept = max(everywhere, columns.get(c["column_id"], {}).get("all", 0))
        return True if swept > c["stamp"] else bool(c["valid"])

    def mark(c, value):
        c["valid"], c["stamp"] = int(value), clock

    def count(column_id, members, valid):
        col = columns.setdefault(column_id, {"members": 0, "valid": 0, "validated": False, "all": 0})
        col["members"] += members
        col["valid"] += valid

    def leave(c):
        if not c["held"]:
            count(c["column_id"], -1, -int(is_valid(c)))

    def enter(c):
        if not c["held"]:
            count(c["column_id"], 1, int(is_valid(c)))

    def child(card_id):
        parent, _, record = card_id.rpartition("#")
        base = cards.get(parent)
        if base is None or not base["split"]:
            return None
        cards[card_id] = {**base, "split": False, "name": None, "n": 1, "valid": 0, "stamp": base["split_at"], "pinned": base["pinned"]}
        return cards[card_id]

    def card_of(card_id):
        c = cards.get(card_id) or (child(card_id) if card_id else None)
        return c if c and not c["split"] and not c["merged"] else None

    def set_label(c, label):
        c["manual"] = label if label and label != c["original"] else None
        c["pinned"] = False

    for r in rows[rows["kind"] == "action"].sort_values("seq").itertuples():
        clock = int(r.seq) + 1
        c = card_of(r.card_id)
        if r.action == "validate_card" and c and not c["held"]:
            now = not is_valid(c)
            count(c["column_id"], 0, 1 if now else -1)
            mark(c, now)
        elif r.action == "validate_column" and r.column_id in columns:
            columns[r.column_id].update(all=clock, valid=columns[r.column_id]["members"], validated=True)
        elif r.action == "validate_all":
            everywhere = clock
            for col in columns.values():
                col.update(valid=col["members"], validated=True)
        elif r.action in ("validate_cards", "validate_confident"):
            for card_id in (r.ids if r.ids is not None else []):
                one = card_of(card_id)
                if one and not one["held"] and not is_valid(one):
                    count(one["column_id"], 0, 1)
                    mark(one, True)
        elif r.action == "hold" and c:
            leave(c)
            c["held"], c["note"] = True, (r.note or "").strip()[:300] or None
            mark(c, False)
        elif r.action == "hold_note" and c and c["held"]:
            c["note"] = (r.note or "").strip()[:300] or None
        elif r.action == "release" and c and c["held"]:
            if r.target_id is not None:  # a class was chosen ('' returns to automatic)
                set_label(c, r.target_id)
            c["held"], c["note"] = False, None
            mark(c, r.value == "validate")
            enter(c)
        elif r.action == "set_class" and c:
            set_label(c, r.value)
        elif r.action == "set_classes":
            for card_id in (r.ids if r.ids is not None else []):
                one = card_of(card_id)
                if one and r.value:
                    set_label(one, r.value)
                    count(one["column_id"], 0, -int(is_valid(one)))
                    mark(one, False)
        elif r.action == "move" and c and r.column_id in columns:
            inherited = columns[r.column_id]["validated"]
            leave(c)
            c["column_id"], c["held"] = r.column_id, False
            mark(c, inherited)
            enter(c)
        elif r.action == "merge_cards" and c:
            target = card_of(r.target_id)
            if target and target is not c and target["column_id"] == c["column_id"] and not target["held"] and not c["held"]:
                leave(c)
                count(target["column_id"], 0, -int(is_valid(target)))
                mark(target, False)
                target["pinned"] = target["pinned"] or not target["manual"]
                target["n"] += c["n"]
                c["merged"] = r.target_id
        elif r.action == "rename_card" and c and (r.value or "").strip():
            count(c["column_id"], 0, -int(is_valid(c)))
            mark(c, False)
            c["name"] = r.value.strip()[:500]
        elif r.action == "split_card" and c and c["n"] > 1:
            leave(c)
            mark(c, False)
            c["split"], c["split_at"] = True, clock
            if not c["held"]:
                count(c["column_id"], int(c["n"]), 0)
        elif r.action == "add_column" and r.column_id and r.column_id not in columns:
            columns[r.column_id] = {"members": 0, "valid": 0, "validated": False, "all": 0}
        elif r.action == "delete_column" and r.column_id in columns and columns[r.column_id]["members"] == 0:
            del columns[r.column_id]
            out.append((analysis, "gone", None, r.column_id, None, None, None, None, None, None, None, None))
        for col in columns.values():
            if col["members"] > 0:
                col["validated"] = col["valid"] == col["members"]
    for card_id, c in cards.items():
        root = card_id
        while cards[root]["merged"]:
            root = cards[root]["merged"]
        out.append((analysis, "card", card_id, c["column_id"], root if root != card_id else None, bool(c["split"]), c["held"], c["note"],
                    is_valid(c), c["name"], c["manual"], c["pinned"]))
    for column_id, col in columns.items():
        out.append((analysis, "column", None, column_id, None, None, None, None, bool(col["all"] or everywhere), None, None, None))
        out.append((analysis, "column_state", None, column_id, None, None, None, None, bool(col["validated"]), None, None, None))
    names = [f.strip().split(" ")[0] for f in STATE_SCHEMA.split(",")]
    return pd.DataFrame(out, columns=names)


def fold_actions(actions: DataFrame, cards: DataFrame, columns: DataFrame) -> dict[str, DataFrame]:
    """M1-M7: board state after the live actions.

    cards(analysis_id, card_id, column_id, name, suggested, size); columns(analysis_id, column_id). Returns the cards
    that were acted on with their final state, the remap of merged cards, the split cards and the columns.
    """
    live = actions.join(live_actions(actions), ["analysis_id", "seq"], "left_semi")
    named = live.select("analysis_id", F.explode(F.array_compact(F.concat(F.array("card_id", "target_id"), F.coalesce(
        "ids", F.array().cast("array<string>"))))).alias("card_id"))
    named = named.withColumn("card_id", F.regexp_replace("card_id", "#.*$", "")).distinct()
    none = lambda kind: F.lit(None).cast(kind)
    layout = ["analysis_id", "kind", "seq", "action", "card_id", "target_id", "column_id", "value", "note", "ids", "n"]
    touched = cards.join(named, ["analysis_id", "card_id"], "left_semi").select(
        "analysis_id", F.lit("card").alias("kind"), none("bigint").alias("seq"), none("string").alias("action"), "card_id", none("string").alias("target_id"),
        "column_id", F.col("name").alias("value"), F.col("suggested").alias("note"), none("array<string>").alias("ids"), F.col("size").alias("n"))
    busy = live.select("analysis_id").distinct()
    counted = cards.groupBy("analysis_id", "column_id").agg(F.count(F.lit(1)).alias("n"))
    sized = columns.join(busy, "analysis_id", "left_semi").join(counted, ["analysis_id", "column_id"], "left").select(
        "analysis_id", F.lit("column").alias("kind"), none("bigint").alias("seq"), none("string").alias("action"), none("string").alias("card_id"),
        none("string").alias("target_id"), "column_id", none("string").alias("value"), none("string").alias("note"), none("array<string>").alias("ids"),
        F.coalesce("n", F.lit(0)).alias("n"))
    clicks = live.withColumns({"kind": F.lit("action"), "n": none("bigint"), "value": F.when(
        F.col("action").isin("set_class", "set_classes"), text.class_label("value")).otherwise(F.col("value"))}).select(*layout)
    state = clicks.unionByName(touched).unionByName(sized).groupBy("analysis_id").applyInPandas(_fold_by_value(), STATE_SCHEMA)
    return {"touched": state.filter("kind = 'card'").drop("kind"), "swept": state.filter("kind = 'column'").select("analysis_id", "column_id", F.col("validated").alias("swept")),
            "columns": state.filter("kind = 'column_state'").select("analysis_id", "column_id", "validated"),
            "gone": state.filter("kind = 'gone'").select("analysis_id", "column_id")}


def _fold_by_value():
    """The fold as a closure, so executors need not have this package installed."""
    schema, fold = STATE_SCHEMA, _fold
    namespace = {"pd": pd, "STATE_SCHEMA": schema}
    function = type(fold)(fold.__code__, namespace, fold.__name__)
    function.__module__ = "__main__"
    return function


def board_cards(cards: DataFrame, folded: dict[str, DataFrame]) -> DataFrame:
    """Current cards: untouched ones take their column's sweep, touched ones their own state; merged and split ones go."""
    state = folded["touched"].select("analysis_id", "card_id", F.col("column_id").alias("_column"), "merged_into", "split", "held", "held_note",
                                     F.col("validated").alias("_valid"), F.col("name").alias("_name"), "manual", "pinned", F.lit(True).alias("_touched"))
    base = cards.select("analysis_id", "card_id", "column_id", "name", "suggested", "size")
    joined = lookup_join(base.join(state, ["analysis_id", "card_id"], "left"), folded["swept"], ["analysis_id", "column_id"])
    kept = joined.filter("merged_into IS NULL AND NOT coalesce(split, false)")
    return kept.select("analysis_id", "card_id", F.coalesce("_column", "column_id").alias("column_id"), F.coalesce("_name", "name").alias("name"), "suggested",
                       "size", F.coalesce("held", F.lit(False)).alias("held"), "held_note",
                       F.when(F.col("_touched"), F.col("_valid")).otherwise(F.coalesce("swept", F.lit(False))).alias("validated"), "manual",
                       F.coalesce("pinned", F.lit(False)).alias("pinned"))


def current_members(members: DataFrame, folded: dict[str, DataFrame]) -> DataFrame:
    """M5 + M6: card members after merges (to the final target) and splits (one card 'card#record' per stop)."""
    remap = folded["touched"].filter("merged_into IS NOT NULL OR split").select("analysis_id", "card_id", "merged_into")
    split = folded["touched"].filter("split").select("analysis_id", F.col("card_id").alias("target"), F.lit(True).alias("_split"))
    moved = lookup_join(members, remap, ["analysis_id", "card_id"]).withColumn("target", F.coalesce("merged_into", "card_id"))
    placed = lookup_join(moved, split, ["analysis_id", "target"])
    alone = F.concat_ws("#", "target", F.col("record_id").cast("string"))
    return placed.select("analysis_id", F.when(F.col("_split"), alone).otherwise(F.col("target")).alias("card_id"), "record_id")


def split_children(members: DataFrame, folded: dict[str, DataFrame], stops: DataFrame) -> DataFrame:
    """M6: the single-stop cards of split cards; each takes its own clicks, else what its parent had at the split."""
    parts = members.filter("card_id LIKE '%#%'").withColumn("parent", F.regexp_replace("card_id", "#[^#]*$", ""))
    state = folded["touched"]
    parent = state.filter("split").select("analysis_id", F.col("card_id").alias("parent"), F.col("column_id").alias("p_column"), F.col("held").alias("p_held"),
                                          F.col("held_note").alias("p_note"), F.col("validated").alias("p_valid"), F.col("manual").alias("p_manual"))
    own = state.filter("card_id LIKE '%#%'").select("analysis_id", "card_id", "column_id", "held", "held_note", "validated", "name", "manual",
                                                   F.lit(True).alias("_own"))
    rows = lookup_join(parts, parent, ["analysis_id", "parent"], "inner").join(own, ["analysis_id", "card_id"], "left")
    notes = stops.select("analysis_id", F.col("id").alias("record_id"), F.col("observacao_raw").alias("_note"))
    rows = rows.join(notes, ["analysis_id", "record_id"], "left")
    either = lambda mine, theirs: F.when(F.col("_own"), F.col(mine)).otherwise(F.col(theirs)).alias(mine)
    return rows.select("analysis_id", "card_id", either("column_id", "p_column"), F.coalesce("name", F.nullif("_note", F.lit("")), F.lit(fv.UNNAMED_CARD)).alias("name"),
                       either("held", "p_held"), either("held_note", "p_note"), either("validated", "p_valid"), either("manual", "p_manual"))


def validated_stops(stops: DataFrame, members: DataFrame, cards: DataFrame, columns: DataFrame) -> DataFrame:
    """Stops of validated cards off the bell; unit, line and machine come from the card's column, the class and
    mode from the card. cards(analysis_id, card_id, column_id, name, class, validated, held)."""
    ready = cards.filter("validated AND NOT held").select("analysis_id", "card_id", "column_id", F.col("name").alias("failure_mode"),
                                                          F.col("class").alias("failure_class"))
    placed = columns.select("analysis_id", "column_id", F.col("unit").alias("centro"), F.col("line").alias("linha"), F.col("name").alias("equipamento"))
    ready = lookup_join(ready, placed, ["analysis_id", "column_id"], "inner").drop("column_id")
    linked = lookup_join(members, ready, ["analysis_id", "card_id"], "inner").withColumnsRenamed({"record_id": "id", "card_id": "group_id"})
    return stops.drop("centro", "linha", "equipamento", "failure_mode", "failure_class", "group_id").join(linked, ["analysis_id", "id"])

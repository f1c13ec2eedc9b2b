"""Rows that share an id, or have none, where one row of each component stays."""

import pytest

from stoplens.llm import simhash_blocks as H
from stoplens.llm import simhash_wide as W

DOCS = "doc_id long, text string"


@pytest.mark.parametrize("drop", [W.drop_similar, H.drop_near_copies])
def test_rows_of_one_id_or_none_stay_apart(frame, drop):
    text = lambda n: " ".join(f"t{n}w{k}" for k in range(60))
    rows = [(None, text(1)), (None, text(2)), (None, text(2)), (5, text(3)), (5, text(4)), (6, text(4)), (6, text(5)), (None, text(5))]
    got = [tuple(r) for r in drop(frame(rows, DOCS)).collect()]
    assert sorted(got, key=str) == sorted([(None, text(1)), (None, text(2)), (5, text(3)), (5, text(4)), (6, text(5))], key=str)

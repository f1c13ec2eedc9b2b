"""Imports every query module so that the registry is complete."""

from stoplens.plans import queries_boards, queries_flow, queries_frozen, queries_landed, queries_learning, queries_log_tables, queries_notes, queries_reliability  # noqa: F401
from stoplens.plans.registry import ORACLES, QUERIES  # noqa: F401

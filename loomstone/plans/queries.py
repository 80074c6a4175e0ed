"""Imports every module that registers queries."""

from . import queries_admin, queries_parts, queries_rewrite, queries_state  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401

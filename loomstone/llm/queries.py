"""Imports every module that registers queries."""

from . import html, matroska, mixing, pieces, quality, simhash, substring, tokenfile, tokens, topk  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401

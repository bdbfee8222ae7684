"""All registered queries of the library with their SQL."""

from __future__ import annotations

from . import composed, fusion, governing, gridding, kernelled, neighbours, options, protocols, revising, scoring, searching, shaping, storing, campaigns  # noqa: F401
from .registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)

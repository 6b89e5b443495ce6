"""Core queries and their SQL, collected from the modules of this folder."""

from __future__ import annotations

from . import panel, places, profiles, propensity, texts, units

_PARTS = [panel, profiles, propensity, texts, places, units]
FLAGSHIP = "did_att_2x2"


def queries() -> dict:
    return {k: f for p in _PARTS for k, f in p.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for p in _PARTS for k, s in p.ORACLES.items()}

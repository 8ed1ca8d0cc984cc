"""Registered queries, by wave, with the SQL each is compared with."""

from __future__ import annotations

import importlib

WAVES = ("wave1", "wave2", "wave3", "wave4", "wave5", "wave6")


def _all(what: str) -> dict:
    out = {}
    for wave in WAVES:
        out |= getattr(importlib.import_module(f"{__name__}.{wave}"), what)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("SQL")

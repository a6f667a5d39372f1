"""Registry of named queries over the driver tables and their DuckDB oracles.

Each family module exports ``QUERIES`` (name → ``fn(spark, sf_dir)``) and
``ORACLE`` (name → SQL text for DuckDB over the same tables).  Queries
without an oracle (seeded models) are checked by row count and by the
property tests in ``tests/``.
"""

from __future__ import annotations

import importlib

_FAMILIES = ["profile_q", "quality_q", "eda_q", "clean_q", "split_q", "features_q", "metrics_q", "models_q", "sources_q"]


def _modules():
    mods = []
    for name in _FAMILIES:
        try:
            mods.append(importlib.import_module(f"{__name__}.{name}"))
        except ModuleNotFoundError as e:
            if e.name != f"{__name__}.{name}":
                raise
    return mods


def all_queries() -> dict:
    out = {}
    for m in _modules():
        out.update(m.QUERIES)
    return out


def all_oracles() -> dict:
    out = {}
    for m in _modules():
        out.update(m.ORACLE)
    return out

"""The registered queries of the interval library and their SQL oracles."""

from __future__ import annotations

from tidespan.plans import annotated, basics, effects, files, genomics, more, phased, rebuilt, rules, views

MODULES = [annotated, basics, effects, files, genomics, more, phased, rebuilt, rules, views]
QUERIES: dict = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES: dict = {k: s for m in MODULES for k, s in m.ORACLES.items()}

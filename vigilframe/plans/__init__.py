"""Named queries over the test tables, one module per area."""

from __future__ import annotations

import importlib
import pkgutil

from vigilframe.plans.registry import ORACLES, QUERIES


def load_all():
    for module in pkgutil.iter_modules(__path__):
        if module.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{module.name}")
    return QUERIES, ORACLES

"""All registered queries."""

from __future__ import annotations

import importlib
import pkgutil

from voxtable.catalog.registry import ORACLES, QUERIES


def load_all():
    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
    return QUERIES, ORACLES

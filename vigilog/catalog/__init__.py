"""All registered queries, by section."""

from __future__ import annotations

import importlib

SECTIONS = [
    "scans", "projections", "filters", "cleaning", "joins", "aggregations", "windows", "paging",
    "sets", "scalars", "features", "rules", "risk", "detectors", "reports", "streams",
]


def _load():
    from . import registry

    for section in SECTIONS:
        try:
            importlib.import_module(f"{__name__}.{section}")
        except ModuleNotFoundError as exc:
            if exc.name != f"{__name__}.{section}":
                raise
    return registry


def queries():
    return dict(_load().QUERIES)


def twins():
    return dict(_load().TWINS)

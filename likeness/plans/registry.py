"""All registered queries and the SQL that checks them."""

from __future__ import annotations

import importlib

FAMILIES = ["tables", "columns", "records", "generation", "series", "synthesis", "links", "documents"]


def _merged(attr: str) -> dict:
    out: dict = {}
    for name in FAMILIES:
        try:
            module = importlib.import_module(f"{__package__}.{name}")
        except ModuleNotFoundError as e:
            if e.name != f"{__package__}.{name}":
                raise
            continue
        out.update(getattr(module, attr))
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracles() -> dict:
    return _merged("ORACLES")

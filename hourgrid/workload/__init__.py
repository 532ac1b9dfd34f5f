"""Registered queries over the driver tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from importlib import import_module

from hourgrid.workload.base import REGISTRY

_FAMILIES = ("filters", "temporal", "gridding", "statistics", "joins", "scoring", "samples", "streams", "sources", "composites")

for _name in _FAMILIES:
    import_module(f"hourgrid.workload.{_name}")

__all__ = ["REGISTRY"]

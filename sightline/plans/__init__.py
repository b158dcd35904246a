"""Registered queries."""

from importlib import import_module

from sightline.plans.registry import ORACLE, QUERIES

MODULES = (
    "flow", "clouds", "segmentation", "detection", "tracking", "truthset", "scalars", "reports", "streams", "images", "rasters", "composed", "checks",
)

for _m in MODULES:
    import_module(f"sightline.plans.{_m}")

__all__ = ["ORACLE", "QUERIES"]

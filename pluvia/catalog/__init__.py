"""Registered queries on the shared tables, each with its SQL twin where SQL can say it."""

from importlib import import_module

MODULES = ("series", "joins", "scoring", "rules", "sources", "quality", "spatial", "raster", "models")


def load_all() -> None:
    for name in MODULES:
        import_module(f"pluvia.catalog.{name}")

"""Registered queries with their oracles."""

from importlib import import_module

MODULES = ("evaluation", "segments", "scoring", "provenance", "sampling")


def load_all():
    from . import registry

    for m in MODULES:
        import_module(f"{__name__}.{m}")
    return registry.QUERIES, registry.ORACLES

"""Registered queries over the given tables, each with its SQL check where one exists."""

from importlib import import_module

MODULES = ["intake", "ledger", "settings", "captioning", "timelines", "rasters", "signals", "flows"]


def load_all() -> None:
    """Import every query module, which registers its queries."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")

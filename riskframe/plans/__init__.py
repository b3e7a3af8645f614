"""Named queries over the test tables, each with its SQL twin where one exists."""

from __future__ import annotations

from importlib import import_module

from riskframe.plans import registry

MODULES = ("relational", "texts", "judging", "models", "linear", "extras")


def _load() -> None:
    for name in MODULES:
        import_module(f"riskframe.plans.{name}")


def all_queries() -> dict[str, registry.Run]:
    _load()
    return dict(registry.QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(registry.ORACLES)

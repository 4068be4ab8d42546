"""Registry of checks that add columns: a plugin is a function of a DataFrame, or a Column factory with a name."""

from __future__ import annotations

import logging
from collections.abc import Callable
from importlib.metadata import entry_points

from pyspark.sql import Column, DataFrame

GROUP = "tarnlight.plugins"
_registry: dict[str, tuple[Callable[[], Column], float]] = {}


def register(name: str, column: Callable[[], Column], max_score: float) -> None:
    """Registers a check: column() gives its score over the page row."""
    _registry[name] = (column, max_score)


def clear() -> None:
    _registry.clear()


def names() -> list[str]:
    return sorted(_registry)


def load_entry_points() -> list[str]:
    """Calls every installed entry point of the group with register; a failing one is logged and skipped."""
    loaded = []
    for point in entry_points(group=GROUP):
        try:
            point.load()(register)
            loaded.append(point.name)
        except Exception:
            logging.getLogger(__name__).warning("plugin %s can't be loaded", point.name, exc_info=True)
    return loaded


def apply(df: DataFrame) -> DataFrame:
    """df with plugin_<name> of every registered check, in one projection."""
    return df.withColumns({f"plugin_{n}": _registry[n][0]() for n in names()}) if _registry else df

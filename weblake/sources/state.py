"""Harvest state kept as tables: frontier, visited pages, visited images."""

from __future__ import annotations

from pyspark.sql import DataFrame

from weblake.config import HarvestConfig

# What each start level drops.
DROPPED = {0: (), 1: ("frontier",), 2: ("frontier", "visited"), 3: ("frontier", "visited", "images")}


def load_state(tables: dict[str, DataFrame], config: HarvestConfig) -> dict[str, DataFrame]:
    """State tables at the start of a run; those that ``config.init_level`` drops come back empty. An unknown level keeps all."""
    dropped = DROPPED.get(config.init_level, ())
    return {name: df.limit(0) if name in dropped else df for name, df in tables.items()}

"""Collects the registered queries of all catalog modules."""

from __future__ import annotations

import importlib
import pkgutil

from pyspark.sql import DataFrame, SparkSession

import loomgraph.plans as plans
from loomgraph.core.catalog import ORACLES, QUERIES


def _load() -> None:
    for mod in sorted(m.name for m in pkgutil.iter_modules(plans.__path__)):
        if mod.startswith("queries_"):
            importlib.import_module(f"loomgraph.plans.{mod}")


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    from loomgraph.plans.queries_pairs import ranked_components

    return ranked_components(spark, folder, 2, 1, 2)

"""All core queries: importing this module registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkloom.plans import q_blocking, q_decide, q_features, q_files, q_learn, q_monitor, q_relational, q_text  # noqa: F401
from linkloom.plans.registry import ORACLE, QUERIES  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored pairs to decided sets to macro F0.5 per country."""
    return QUERIES["met_by_country"](spark, sf_dir)

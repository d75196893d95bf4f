"""The registered queries of the measurement operators, and the flagship query."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierstats.operators import stats, windows
from tierstats.sources import fixtures

from . import q_aggregate, q_classify, q_joins, q_layers, q_matrix, q_stats, q_windows  # noqa: F401  (they register their queries)
from .registry import ORACLES, QUERIES


def state_comparison(spark: SparkSession, sf_dir: str, unit: str = "unit") -> DataFrame:
    """In which (unit, segment) do entries of state APO differ from those of state HOLO? With q within unit and over all.

    Values are rounded before they are ranked, so that ties are the same in any engine."""
    tests = stats.mann_whitney(fixtures.feat(spark, sf_dir).withColumn("v", F.round("v", 6)), [unit, "segment"], "state", "v")
    return windows.bh_fdr(windows.bh_fdr(tests, "p", [unit], ["segment"], "q"), "p", [], [unit, "segment"], "q_global")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comparison with regions as units (a nation has too few entries in the smallest tables)."""
    return state_comparison(spark, sf_dir, "grp").select("grp", "segment", "n1", "n2", "u", "delta", "median_delta", "p", "q", "q_global", "tier", (F.col("q") < 0.05).alias("significant"))


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict:
    return ORACLES

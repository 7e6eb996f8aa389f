"""Queries of boosted trees over all folds. Importing this module registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewater.operators import trees
from tidewater.plans.fixtures import view
from tidewater.plans.lines import SEASONS
from tidewater.plans.queries import MNAMES, QUERIES, model_rows
from tidewater.plans.shared import folder


def _budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model_rows(lambda n: view(spark, sf_dir, n))
    return trees.boosted_folds(rows, MNAMES, SEASONS, folder(spark))


def _market(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model_rows(lambda n: view(spark, sf_dir, n))
    return trees.market_trees(rows, MNAMES, "b", SEASONS[1:], 1996, folder(spark))


QUERIES["m6_tree_budgets"] = _budgets
QUERIES["m9_market_trees"] = _market

"""Registered queries, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import reads, writes

_ALL = {**reads.PLANS, **writes.PLANS}
QUERIES = {name: fn for name, (fn, _) in _ALL.items()}
ORACLES = {name: sql for name, (_, sql) in _ALL.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders joined with customers, filtered, grouped by segment, with having and top-k."""
    return reads.flagship(spark, sf_dir)

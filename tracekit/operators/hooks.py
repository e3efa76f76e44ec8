"""User-defined surface (K2, K3): transforms are plain DataFrame functions. A user's validator (K1) goes to ``quota.clipped_quota``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def generate(df: DataFrame, generator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """K2: a user generation step over a batch DataFrame (``DataFrame.transform``)."""
    return df.transform(generator)


def format_rows(df: DataFrame, formatter: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """K3: a per-module training format (``DataFrame.transform``)."""
    return df.transform(formatter)

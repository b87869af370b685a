"""Row filters used by the cleaning and scenario plans."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_enum, is_missing, to_dec


def require_key(df: DataFrame, col: str) -> DataFrame:
    return df.filter(~is_missing(col))


def require_in(df: DataFrame, col: Column | str, values: Iterable[str]) -> DataFrame:
    return df.filter(clean_enum(col).isin(*values))


def require_positive(df: DataFrame, *cols: str) -> DataFrame:
    """Keep rows whose text columns all read as numbers above zero."""
    for name in cols:
        df = df.filter(to_dec(name) > 0)
    return df


def exclude_status(df: DataFrame, col: str, status: str) -> DataFrame:
    """Drop one status; rows without a status stay."""
    return df.filter(F.coalesce(clean_enum(col), F.lit("")) != status)


def equality_filter(df: DataFrame, **wanted: str | None) -> DataFrame:
    """Apply only the filters that carry a value; None means no restriction."""
    for name, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df

"""Aggregate expressions that count rule breaks; an unknown value never counts unless asked for."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_missing, is_numeric, is_signed_int, normalize_sku, to_date, to_dec


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def count_missing(c: Column | str) -> Column:
    return F.count_if(is_missing(c))


def count_present(c: Column | str) -> Column:
    return F.count_if(~is_missing(c))


def count_nonstandard(c: Column | str) -> Column:
    """Keys that differ from their normal form."""
    return F.count_if(_col(c) != normalize_sku(c))


def count_not_in(c: Column | str, values: Iterable[str]) -> Column:
    return F.count_if(~_col(c).isin(*values))


def count_like(c: Column | str, pattern: str) -> Column:
    return F.count_if(_col(c).like(pattern))


def count_over(c: Column | str, threshold: float) -> Column:
    """Plain unsigned numbers above a threshold."""
    return F.count_if(is_numeric(c) & (to_dec(c) > F.lit(threshold)))


def count_not_positive(c: Column | str) -> Column:
    return F.count_if(to_dec(c) <= 0)


def count_negative(c: Column | str) -> Column:
    """Whole signed numbers below zero."""
    return F.count_if(is_signed_int(c) & (to_dec(c) < 0))


def count_date_inversion(end: Column | str, start: Column | str) -> Column:
    return F.count_if(to_date(end) < to_date(start))

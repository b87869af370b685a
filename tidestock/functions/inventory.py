"""Stock-policy and what-if formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import half_even, ratio

# Normal quantile per service level in percent.
Z_BY_SERVICE_LEVEL = {
    85: 1.04, 86: 1.08, 87: 1.13, 88: 1.17, 89: 1.23,
    90: 1.28, 91: 1.34, 92: 1.41, 93: 1.48, 94: 1.55,
    95: 1.65, 96: 1.75, 97: 1.88, 98: 2.05, 99: 2.33,
}
Z_DEFAULT = 1.65
RECOMMEND_INCREASE = "Increase buffer"
RECOMMEND_REDUCE = "Reduce buffer"
RECOMMEND_KEEP = "Keep current policy"
DAYS_PER_YEAR = 365


def _buffer(z: Column, sd: Column, lead: Column) -> Column:
    return z.cast("double") * F.coalesce(sd, F.lit(0.0)) * F.sqrt(lead.cast("double"))


def safety_stock(z: Column, sd: Column, lead: Column) -> Column:
    """Buffer for demand noise over the lead time, in whole units."""
    return half_even(_buffer(z, sd, lead))


def reorder_point(mean: Column, z: Column, sd: Column, lead: Column) -> Column:
    """Expected lead-time demand plus the buffer, rounded once."""
    return half_even(F.coalesce(mean, F.lit(0.0)) * lead + _buffer(z, sd, lead))


def annual_demand(total: Column, days: Column) -> Column:
    """Mean daily demand scaled to a year, from the exact total and day count."""
    return F.coalesce(ratio(total * DAYS_PER_YEAR, days, 0), F.lit(0)).cast("double")


def coefficient_of_variation(mean: Column, sd: Column) -> Column:
    return F.when(mean > 0, F.coalesce(sd, F.lit(0.0)) / mean)


def inventory_position(on_hand: Column, on_order: Column, backorder: Column) -> Column:
    return on_hand + on_order - backorder


def days_of_supply(on_hand: Column, mean: Column) -> Column:
    return F.when(mean > 0, F.round(on_hand / mean))


def inventory_value(on_hand: Column, unit_cost: Column) -> Column:
    return F.round(on_hand * unit_cost, 2)


def stock_status(
    position: Column, on_hand: Column, best_ss: Column, own_ss: Column, best_rop: Column, own_rop: Column
) -> Column:
    """Compare stock with the recommended policy, else the current one, else 0."""
    floor = F.coalesce(best_ss, own_ss, F.lit(0))
    ceiling = F.coalesce(best_rop, own_rop, F.lit(0)) * 2
    return (
        F.when(position < floor, "UNDERSTOCKED")
        .when(on_hand > ceiling, "OVERSTOCKED")
        .otherwise("NORMAL")
    )


def service_level_status(position: Column, reorder: Column) -> Column:
    """An unknown reorder point counts as a risk."""
    return F.when(position >= reorder, "SAFE").otherwise("RISK")


def safety_stock_gap(best_ss: Column, own_ss: Column) -> Column:
    return F.coalesce(best_ss, F.lit(0)) - F.coalesce(own_ss, F.lit(0))


def floor_std(sd: Column, mean: Column, share: float = 0.3) -> Column:
    """Keep demand noise at no less than a share of the mean."""
    return F.greatest(sd, mean * share)


def z_for_service_level(level: Column | int) -> Column:
    """Quantile for a whole service level in percent; unlisted levels get the default."""
    if isinstance(level, int):
        return F.lit(Z_BY_SERVICE_LEVEL.get(level, Z_DEFAULT))
    pairs = [F.lit(v) for item in Z_BY_SERVICE_LEVEL.items() for v in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), level), F.lit(Z_DEFAULT))


def recommend(simulated: Column, current: Column) -> Column:
    return (
        F.when(simulated > current, RECOMMEND_INCREASE)
        .when(simulated < current, RECOMMEND_REDUCE)
        .otherwise(RECOMMEND_KEEP)
    )

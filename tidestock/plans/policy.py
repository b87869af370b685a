"""Monte-Carlo reorder points as one distributed plan.

Each (product, location) draws `sims` lead-time demands. A draw is a pure function
of the keys, the simulation, the day and a seed, so a retried or re-planned task
reproduces it. One digest yields four 32-bit numbers, hence two Box-Muller pairs,
hence the normal draws of four days.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.inventory import floor_std
from ..functions.numeric import half_even, transit_days

# Fixed values of the policy job.
SIMULATIONS = 2000
SERVICE_TARGET = 0.95
STD_FLOOR = 0.3
LEAD_TIME_LOW = 3
LEAD_TIME_HIGH = 9

DAYS_PER_DRAW = 4
WORD = 4294967296.0


def _word(digest: Column, i: int) -> Column:
    """The i-th 32-bit word of a hex digest as a double."""
    return F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("double")


def assign_lead_time(
    flow: DataFrame,
    mode: str = "hash",
    low: int = LEAD_TIME_LOW,
    high: int = LEAD_TIME_HIGH,
    seed: int = 42,
    shipments: DataFrame | None = None,
) -> DataFrame:
    """A lead time per product and receiving location: (sku_id, location_id, avg_lead_time).

    "hash" draws a repeatable whole number of days in [low, high]. "lane" takes the mean
    of the measured transit times of `shipments` (clean), and the drawn number where none
    was measured. The flow mart cannot give that mean: it repeats a flow per contract
    price, and its own means cover only the shipments that were timed.
    """
    receiving = F.col("to_location").alias("location_id")
    digest = F.md5(F.concat_ws("|", "sku_id", "location_id", F.lit(str(seed))).cast("binary"))
    drawn = (F.lit(low) + F.pmod(_word(digest, 0).cast("long"), F.lit(high - low + 1))).cast("double")
    if mode == "hash":
        pairs = flow.select("sku_id", receiving).distinct()
        return pairs.select("sku_id", "location_id", drawn.alias("avg_lead_time"))
    if shipments is None:
        raise ValueError("measured lead times need the shipments")
    timed = shipments.withColumn("_days", transit_days("delivery_date", "ship_date"))
    measured = timed.groupBy("sku_id", receiving).agg(F.avg(F.col("_days").cast("double")).alias("_mean"))
    pairs = flow.select("sku_id", receiving).distinct()
    return pairs.join(measured, ["sku_id", "location_id"], "left").select(
        "sku_id", "location_id", F.coalesce("_mean", drawn).alias("avg_lead_time")
    )


def _four_days(digest: Column) -> list[Column]:
    """Four standard normal draws from the four words of a digest."""
    draws = []
    for pair in (0, 2):
        u1 = (_word(digest, pair) + 1.0) / (WORD + 1.0)
        u2 = _word(digest, pair + 1) / WORD
        radius, angle = F.sqrt(F.log(u1) * -2.0), u2 * (2.0 * math.pi)
        draws += [radius * F.cos(angle), radius * F.sin(angle)]
    return draws


def simulate_policy(
    demand: DataFrame,
    lead: DataFrame,
    sims: int = SIMULATIONS,
    service: float = SERVICE_TARGET,
    std_floor: float = STD_FLOOR,
    seed: int = 42,
    tasks: int | None = None,
) -> DataFrame:
    """Simulated reorder point and safety stock per demand row with a lead time.

    The few input rows are spread over `tasks` by a hash of the key before they fan
    out to sims x draws rows. The hash stays a grouping column, so the sum per
    simulation and the percentile per key need no further shuffle. Spreading by the
    keys themselves would be dropped as already done by the demand aggregation, and
    its few kilobytes merged into one task. A key's percentile sees `sims` values.
    """
    spark = demand.sparkSession
    tasks = tasks or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    keys = ["sku_id", "location_id"]
    keys += [k for k in ("customer_segment",) if k in demand.columns]
    mean, sd = F.col("avg_demand"), F.col("std_demand")
    base = (
        demand.select(
            *keys, F.col("avg_demand_per_day").cast("double").alias("avg_demand"),
            F.coalesce(F.col("std_demand_per_day").cast("double"), F.lit(0.0)).alias("std_demand"),
        )
        .filter(mean > 0)
        .join(lead, ["sku_id", "location_id"])
        .withColumn("std_demand", floor_std(sd, mean, std_floor))
        .withColumn("_cell", F.xxhash64(*keys))
        .repartition(tasks, "_cell")
    )
    group = ["_cell", *keys, "avg_demand", "std_demand", "avg_lead_time"]
    days = F.ceil("avg_lead_time").cast("int")
    blocks = F.sequence(F.lit(0), F.floor((days - 1) / DAYS_PER_DRAW).cast("int"))

    def digest(block: Column) -> Column:
        parts = [*keys, F.col("_sim").cast("string"), block.cast("string"), F.lit(str(seed))]
        return F.md5(F.concat_ws("|", *parts).cast("binary"))

    # The digest is produced by the explode, so its four words share one evaluation.
    drawn = base.select(*group, F.explode(F.sequence(F.lit(1), F.lit(sims))).alias("_sim")).select(
        *group, "_sim", F.posexplode(F.transform(blocks, digest)).alias("_block", "_digest")
    )
    in_block = F.lit(0.0)
    for i, z in enumerate(_four_days(F.col("_digest"))):
        day = F.col("_block") * DAYS_PER_DRAW + i
        in_block = in_block + F.when(day < days, F.greatest(mean + sd * z, F.lit(0.0))).otherwise(0.0)
    totals = drawn.groupBy(*group, "_sim").agg(F.sum(in_block).alias("_demand"))
    rop = totals.groupBy(*group).agg(F.percentile("_demand", service).alias("_rop"))
    return rop.select(
        *keys,
        half_even("avg_demand", 2).alias("avg_demand"),
        half_even("std_demand", 2).alias("std_demand"),
        F.col("avg_lead_time").alias("lead_time"),
        half_even("_rop", 2).alias("reorder_point"),
        half_even(F.col("_rop") - mean * F.col("avg_lead_time"), 2).alias("safety_stock"),
    )

import math
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidestock.functions import counts, inventory as inv, numeric as num, text as tx


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def lit(value, kind="string"):
    return F.lit(value).cast(kind)


def test_text(spark):
    r = one(
        spark,
        dash=tx.normalize_sku(lit(" sku-001 ")), under=tx.normalize_sku(lit("Sku_0 01")),
        blank=tx.blank_to_null(lit("  ")), enum=tx.clean_enum(lit(" dc ")),
        flag=tx.to_flag(lit(" t ")), strict=tx.to_flag(lit("T"), tx.FLAG_TRUTHY), none=tx.to_flag(lit(None)),
        mode=tx.remap(lit("parcel"), tx.MODE_BY_CARRIER), nomode=tx.remap(lit("air"), tx.MODE_BY_CARRIER),
    )
    assert r.asDict() == {
        "dash": "SKU001", "under": "SKU001", "blank": None, "enum": "DC", "flag": True, "strict": False,
        "none": False, "mode": "TRUCK", "nomode": None,
    }


def test_guarded_parsing(spark):
    r = one(
        spark,
        up=tx.to_int(lit("33.5")), down=tx.to_int(lit("-33.5")), even=tx.to_int(lit("2.5")), bad=tx.to_int(lit("x1")),
        blank=tx.to_int(lit("")), dec=tx.to_dec(lit(" 1.005 "), 10, 2), day=tx.to_date(lit("2024-02-30")),
        number=tx.to_number(lit("n/a")), newline=tx.is_numeric(lit("12\n")), plain=tx.is_numeric(lit("12.50")),
        signed=tx.is_numeric(lit("-1")), integer=tx.is_signed_int(lit("-7")), dot=tx.is_signed_int(lit("7.0")),
    )
    assert r.asDict() == {
        "up": 34, "down": -34, "even": 3, "bad": None, "blank": None, "dec": Decimal("1.01"), "day": None,
        "number": 0.0, "newline": False, "plain": True, "signed": False, "integer": True, "dot": False,
    }


@pytest.mark.parametrize("raw, label", [
    ("SKU-001", "Format: SKU-001"), ("SKU001", "Format: SKU001"), ("sku_001", "Format: sku_001"),
    ("ABC9", "Format: ABC001"), ("Sku-001", "Other format"), ("SKU 001", "Other format"),
])
def test_sku_format(spark, raw, label):
    assert one(spark, f=tx.sku_format(lit(raw))).f == label


def test_score_band(spark):
    got = [one(spark, b=tx.score_band(F.lit(v))).b for v in (90.0, 89.9, 75.0, 74.9)]
    assert [g.split(" ", 1)[1] for g in got] == ["GOOD", "NEEDS CLEANING", "NEEDS CLEANING", "POOR"]


def test_rounding_families(spark):
    r = one(
        spark,
        even=num.half_even(F.lit(2.5)), odd=num.half_even(F.lit(3.5)),
        away=num.ratio(F.lit(5), F.lit(2), 0), minus=num.ratio(F.lit(-5), F.lit(2), 0),
        rate=num.ratio(F.lit(500), F.lit(1100), 4), nothing=num.ratio(F.lit(1), F.lit(0), 2),
        floor=num.floor_zero(F.lit(-3)), null=num.floor_zero(lit(None, "int")),
    )
    assert (r.even, r.odd) == (2.0, 4.0)
    assert (r.away, r.minus, r.rate) == (Decimal(3), Decimal(-3), Decimal("0.4545"))
    assert (r.nothing, r.floor, r.null) == (None, 0, 0)


def test_half_even_is_numpy_round(spark):
    values = [1.005, 1.015, 12.135, 2.675, 0.125, -0.125, 1234.565]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", num.half_even("v", 2).alias("r"))
    for row in df.collect():
        assert row.r == np.round(row.v, 2)


def test_dates(spark):
    day = lambda s: F.lit(s).cast("date")
    r = one(
        spark, bad=num.null_if_before(day("2024-01-01"), day("2024-01-02")),
        same=num.null_if_before(day("2024-01-02"), day("2024-01-02")), days=num.transit_days(day("2024-03-01"), day("2024-02-28")),
    )
    assert (r.bad, str(r.same), r.days) == (None, "2024-01-02", 2)


def test_sd_from_sums_matches_sample_sd(spark):
    values = [3, 4, 4, 9, 12]
    n, s, q = len(values), sum(values), sum(v * v for v in values)
    got = one(spark, sd=num.sd_from_sums(F.lit(n), F.lit(s), F.lit(q)), single=num.sd_from_sums(F.lit(1), F.lit(3), F.lit(9)))
    assert got.sd == pytest.approx(np.std(values, ddof=1), rel=1e-12)
    assert got.single is None


def test_policy_formulas(spark):
    z, sd, lead, mean = F.lit(1.65), F.lit(4.0), F.lit(9), F.lit(10.0)
    r = one(
        spark,
        ss=inv.safety_stock(z, sd, lead), rop=inv.reorder_point(mean, z, sd, lead), none=inv.safety_stock(z, lit(None, "double"), lead),
        cv=inv.coefficient_of_variation(mean, sd), nocv=inv.coefficient_of_variation(F.lit(0.0), sd),
        year=inv.annual_demand(F.lit(5), F.lit(2)), cover=inv.days_of_supply(F.lit(25), mean),
        status=inv.service_level_status(F.lit(5), lit(None, "double")),
        zc=inv.z_for_service_level(F.lit(99)), zd=inv.z_for_service_level(F.lit(50)), zi=inv.z_for_service_level(90),
    )
    assert (r.ss, r.rop, r.none) == (20.0, 110.0, 0.0)
    assert (r.cv, r.nocv, r.year, r.cover, r.status) == (0.4, None, 913.0, 3.0, "RISK")
    assert (r.zc, r.zd, r.zi) == (2.33, 1.65, 1.28)


@pytest.mark.parametrize("position, on_hand, best, own, expected", [
    (4, 4, 5, None, "UNDERSTOCKED"), (50, 50, 5, None, "OVERSTOCKED"), (12, 12, 5, None, "NORMAL"),
    (3, 3, None, 4, "UNDERSTOCKED"), (0, 0, None, None, "NORMAL"), (1, 1, None, None, "OVERSTOCKED"),
])
def test_stock_status(spark, position, on_hand, best, own, expected):
    i = lambda v: F.lit(v).cast("int")
    rop = None if best is None else 10
    own_rop = None if own is None else 8
    got = one(spark, s=inv.stock_status(i(position), i(on_hand), i(best), i(own), i(rop), i(own_rop))).s
    assert got == expected


def test_rule_counts(rows):
    df = rows("k string, n string, a string, b string",
              ("SKU-1", "10001", "2024-01-02", "2024-01-01"), ("SKU1", "10000", "2024-01-01", "2024-01-02"),
              (None, "x", None, "2024-01-02"), ("DC-1", "-4", "bad", "2024-01-02"), ("DC-2", " ", "2024-01-01", "2024-01-01"))
    r = df.agg(
        counts.count_nonstandard("k").alias("odd"), counts.count_over("n", 10000).alias("over"),
        counts.count_negative("n").alias("neg"), counts.count_missing("n").alias("missing"),
        counts.count_not_in("k", ["SKU1"]).alias("foreign"), counts.count_like("k", "DC-%").alias("like"),
        counts.count_date_inversion("a", "b").alias("inverted"), counts.count_not_positive("n").alias("nonpos"),
    ).first()
    assert r.asDict() == {"odd": 3, "over": 1, "neg": 1, "missing": 1, "foreign": 3, "like": 2, "inverted": 1, "nonpos": 1}
    assert math.isfinite(r.odd)

"""Text normalisation, guarded parsing and text classification."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Vocabularies and patterns that decide results.
ACTIVE_TRUTHY = ("Y", "YES", "1", "TRUE", "T")
FLAG_TRUTHY = ("Y", "YES", "1", "TRUE")
SEGMENTS = ("PREMIUM", "STANDARD", "BUDGET")
LOCATION_TYPES = ("DC", "RDC", "STORE")
TRANSPORT_MODES = ("TRUCK", "AIR", "RAIL")
ECHELON_BY_TYPE = {"DC": 1, "RDC": 2, "STORE": 3}
RANK_BY_SEGMENT = {"PREMIUM": 1, "STANDARD": 2, "BUDGET": 3}
MODE_BY_CARRIER = {"TL": "TRUCK", "LTL": "TRUCK", "PARCEL": "TRUCK", "INTERMODAL": "RAIL"}
UNSIGNED_DECIMAL = r"^[0-9]+(\.[0-9]+)?\z"
SIGNED_INTEGER = r"^-?[0-9]+\z"
SKU_FORMATS = (
    ("^SKU-[0-9]+", "Format: SKU-001"),
    ("^SKU[0-9]+", "Format: SKU001"),
    ("^sku_[0-9]+", "Format: sku_001"),
    ("^[A-Z]{3}[0-9]+", "Format: ABC001"),
)
SKU_FORMAT_OTHER = "Other format"
SCORE_BANDS = ((90, "🟢 GOOD"), (75, "🟡 NEEDS CLEANING"))
SCORE_BAND_LOWEST = "🔴 POOR"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c: Column | str) -> Column:
    return F.trim(_col(c))


def clean_enum(c: Column | str) -> Column:
    return F.upper(F.trim(_col(c)))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(F.trim(_col(c)), F.lit(""))


def is_missing(c: Column | str) -> Column:
    """True for NULL and for text that is empty after trimming."""
    return blank_to_null(c).isNull()


def normalize_sku(c: Column | str) -> Column:
    """One spelling per product key: no separators, upper case."""
    return F.upper(F.translate(F.trim(_col(c)), "-_ ", ""))


def to_flag(c: Column | str, truthy: Sequence[str] = ACTIVE_TRUTHY) -> Column:
    """Two-valued flag; anything outside the vocabulary, NULL too, is False."""
    return F.coalesce(clean_enum(c).isin(*truthy), F.lit(False))


def remap(c: Column | str, mapping: Mapping[str, object]) -> Column:
    """Translate an enum; values without an entry become NULL."""
    value, chain = clean_enum(c), None
    for key, target in mapping.items():
        step = (value == key, F.lit(target))
        chain = F.when(*step) if chain is None else chain.when(*step)
    return chain


def is_numeric(c: Column | str) -> Column:
    return _col(c).rlike(UNSIGNED_DECIMAL)


def is_signed_int(c: Column | str) -> Column:
    return _col(c).rlike(SIGNED_INTEGER)


def to_dec(c: Column | str, precision: int = 38, scale: int = 10) -> Column:
    """Text to decimal, rounding half away from zero; unreadable text is NULL."""
    return blank_to_null(c).try_cast(T.DecimalType(precision, scale))


def to_int(c: Column | str) -> Column:
    """Text to integer by way of a rounded decimal, so '33.5' is 34."""
    return to_dec(c, 38, 0).try_cast("int")


def to_date(c: Column | str) -> Column:
    return blank_to_null(c).try_cast("date")


def to_number(c: Column | str) -> Column:
    """Lenient numeric coercion: unreadable or missing becomes 0."""
    return F.coalesce(_col(c).try_cast("double"), F.lit(0.0))


def sku_format(c: Column | str) -> Column:
    """Name the spelling a raw product key uses; the first matching pattern wins."""
    value, chain = _col(c), None
    for pattern, label in SKU_FORMATS:
        step = (value.rlike(pattern), F.lit(label))
        chain = F.when(*step) if chain is None else chain.when(*step)
    return chain.otherwise(F.lit(SKU_FORMAT_OTHER))


def score_band(c: Column | str) -> Column:
    value, chain = _col(c), None
    for floor, label in SCORE_BANDS:
        step = (value >= floor, F.lit(label))
        chain = F.when(*step) if chain is None else chain.when(*step)
    return chain.otherwise(F.lit(SCORE_BAND_LOWEST))


def read_once(value: Column) -> Column:
    """The value, marked to be computed where it stands.

    Spark copies the expressions of a filter to below a projection, so a filter on parsed text parses every
    row twice, with all other text rules that joins infer filters from. What depends on a row's position stays.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)

"""Column expressions. All are built-in functions, so they stay in generated code."""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelwise.constants import HIGH_RISK, MEDIUM_RISK

# fixed values: date formats accepted in order files
ORDER_TS_FORMATS = [
    "M/d/yyyy H:mm",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd",
    "M/d/yyyy",
]


def to_number(col: Column) -> Column:
    """Double, or NULL for text that is no number and for NaN."""
    number = col.try_cast("double")
    return F.when(~F.isnan(number), number)


def number_or(col: Column, default: float) -> Column:
    return F.coalesce(to_number(col), F.lit(float(default)))


def safe_divide(num: Column, den: Column) -> Column:
    """Quotient as double, 0 where the denominator is 0 or missing."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def ratio(num: Column, den: Column, places: int = 4, empty: float | None = 0.0) -> Column:
    """``num/den`` rounded half up without passing through binary fractions."""
    exact = F.try_divide(num.cast("decimal(24,4)"), den.cast("decimal(20,0)"))
    rounded = F.round(exact, places).cast("double")
    return rounded if empty is None else F.coalesce(rounded, F.lit(float(empty)))


def clip_unit(col: Column) -> Column:
    return F.greatest(F.lit(0).cast("double"), F.least(F.lit(1).cast("double"), col))


def parse_order_ts(col: Column) -> Column:
    """First format that fits; NULL when none does."""
    return F.coalesce(*[F.try_to_timestamp(col, F.lit(fmt)) for fmt in ORDER_TS_FORMATS])


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def date_parts(ts: Column, missing: int, calendar: bool = False) -> dict[str, Column]:
    """Date features, Monday = 0. ``calendar`` adds year and day."""
    def part(c: Column) -> Column:
        return F.coalesce(c.cast("int"), F.lit(missing))

    parts = {
        "order_dayofweek": part(F.weekday(ts)),
        "order_month": part(F.month(ts)),
        "order_hour": part(F.hour(ts)),
        "order_is_weekend": F.coalesce((F.weekday(ts) >= 5).cast("int"), F.lit(0)),
    }
    if calendar:
        parts["order_year"] = part(F.year(ts))
        parts["order_day"] = part(F.dayofmonth(ts))
    return parts


def hash_id(col: Column, salt: str = "", separator: str = ":", length: int = 64) -> Column:
    """Hex SHA-256 of salt + separator + id, cut to ``length`` digits."""
    text = col.cast("string")
    payload = F.concat(F.lit(salt + separator), text) if salt else text
    digest = F.sha2(payload, 256)
    return digest if length >= 64 else F.substring(digest, 1, length)


def upload_id(col: Column) -> Column:
    """Short ids are hashed to 32 digits; ids of 24 characters or more are kept."""
    text = F.coalesce(col.cast("string"), F.lit("nan"))
    return F.when(F.length(text) < 24, hash_id(text, length=32)).otherwise(text)


def mask_name(col: Column) -> Column:
    name = F.trim(col)
    n = F.length(name)
    short = F.concat(F.substring(name, 1, 1), F.when(n == 2, F.lit("*")).otherwise(F.lit("")))
    long = F.concat(
        F.substring(name, 1, 1), F.repeat(F.lit("*"), (n - 2).cast("int")), F.right(name, F.lit(1))
    )
    return F.when(name.isNull() | (n == 0), F.lit("***")).when(n <= 2, short).otherwise(long)


def display_id(col: Column, prefix: str = "ORD-") -> Column:
    """Readable short id: prefix and the first eight letters or digits."""
    compact = F.regexp_replace(F.upper(F.coalesce(col.cast("string"), F.lit(""))), "[^A-Z0-9]", "")
    return F.when(F.length(compact) > 0, F.concat(F.lit(prefix), F.substring(compact, 1, 8))).otherwise(
        F.lit(prefix + "UNKNOWN")
    )


def search_token(text: str) -> str:
    """Normal form of a typed order id: no ``ORD-`` prefix, lower-case letters and digits."""
    without_prefix = re.sub(r"(?i)^ord[-_]?", "", text.strip())
    return "".join(ch for ch in without_prefix.lower() if ch.isascii() and ch.isalnum())


def risk_bucket(p: Column) -> Column:
    """High / Medium / Low; missing and NaN count as Low (Spark orders NaN above all)."""
    high = p >= F.lit(HIGH_RISK)
    medium = p >= F.lit(MEDIUM_RISK)
    unusable = p.isNull() | F.isnan(p.cast("double"))
    return (
        F.when(unusable, F.lit("Low"))
        .when(high, F.lit("High"))
        .when(medium, F.lit("Medium"))
        .otherwise(F.lit("Low"))
    )


def lookup(values: dict[str, Decimal], key: Column, default: Decimal) -> Column:
    """Constant-table lookup as an expression: no join, no shuffle."""
    pairs = [F.lit(item) for pair in values.items() for item in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.trim(key)), F.lit(default))


def one_hot_decode(columns: list[str], prefix: str) -> Column:
    """Label of the first column holding the row maximum."""
    values = F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in columns])
    names = F.array(*[F.lit(c[len(prefix):]) for c in columns])
    return F.element_at(names, F.array_position(values, F.array_max(values)).cast("int"))

"""De-identification and the columns that may leave the system."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.constants import DELAY_LEAKAGE, DELAY_SALT, LABEL, ORDER_DATE, ORDER_ID, PII_COLUMNS
from parcelwise.functions.scalars import display_id, hash_id

# fixed values: columns of the egress view
EGRESS_COLUMNS = [
    "order_id_hash", "risk_bucket", "p_late", "recommended_action",
    "expected_penalty", "upgrade_cost", "net_benefit",
]


def drop_pii(df: DataFrame, columns: Sequence[str] = PII_COLUMNS) -> DataFrame:
    return df.drop(*columns)


def hash_ids(df: DataFrame, salt: str = DELAY_SALT, columns: Sequence[str] = (ORDER_ID,)) -> DataFrame:
    """Replace id columns by ``<name>_hash``."""
    for c in columns:
        if c in df.columns:
            df = df.withColumn(c, hash_id(F.col(f"`{c}`"), salt)).withColumnRenamed(c, f"{c}_hash")
    return df


def de_identify(df: DataFrame, salt: str = DELAY_SALT) -> DataFrame:
    return df.transform(drop_pii).transform(hash_ids, salt)


def drop_leakage(df: DataFrame, label: str = LABEL, columns: Sequence[str] = DELAY_LEAKAGE) -> DataFrame:
    """Keep the label, drop what is only known after delivery."""
    if label not in df.columns:
        raise ValueError(f"label column {label!r} is missing")
    return df.drop(*[c for c in columns if c != label])


def metadata(df: DataFrame) -> DataFrame:
    """Descriptive columns for reports, renamed; absent ones are left out."""
    renames = {
        f"{ORDER_ID}_hash": "order_id_hash", "Shipping Mode": "shipping_mode",
        "Order Region": "order_region", ORDER_DATE: "order_date",
    }
    return df.select(*[F.col(f"`{a}`").alias(b) for a, b in renames.items() if a in df.columns])


def egress_view(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Only allow-listed columns, with the display id."""
    wanted = [c for c in [*EGRESS_COLUMNS, *extra] if c in df.columns]
    return df.select(*wanted, display_id(F.col("order_id_hash")).alias("display_order_id"))

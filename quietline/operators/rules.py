"""Attribution rules: device states, shares, ordered first-match decisions with reason codes. UNKNOWN is a value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def device_state(age_s: Column, down_s: int = 600) -> Column:
    """DOWN from `down_s` seconds without a success on, UP below, UNKNOWN if missing or in the future."""
    return F.when(age_s.isNull() | (age_s < 0), "UNKNOWN").when(age_s >= down_s, "DOWN").otherwise("UP")


def shares(devices: DataFrame, keys: list[str], state: str = "state") -> DataFrame:
    """(keys, down, up, unknown, eligible, down_share): unknown devices stay in the denominator; shares have four decimals."""
    x = devices.groupBy(*keys).agg(*(F.count_if(F.col(state) == s.upper()).alias(s) for s in ("down", "up", "unknown")), F.count("*").alias("eligible"))
    return x.withColumn("down_share", F.round(F.col("down") / F.col("eligible"), 4))


def cell_states(devices: DataFrame, provider: str, cell: str, affected: str, share: float = 0.7) -> DataFrame:
    """(provider, cell, n, down, state): a cell of a provider is DOWN from `share` of its devices on, compared in whole numbers."""
    x = devices.groupBy(provider, cell).agg(F.count("*").alias("n"), F.count_if(affected).alias("down"))
    return x.withColumn("state", F.when(F.col("down") * 1000 >= F.col("n") * int(share * 1000), "DOWN").otherwise("UP"))


def decide(rules: list[tuple[str, Column]], otherwise: str) -> Column:
    """The name of the first rule that holds; a null condition doesn't."""
    out = F.lit(otherwise)
    for name, holds in reversed(rules):
        out = F.when(F.coalesce(holds, F.lit(False)), name).otherwise(out)
    return out

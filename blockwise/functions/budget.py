"""Token budget arithmetic as Columns; a reserve that is left out counts as 0 and is never written back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SAFE_INTEGER

RESERVES = ("reservedOutputTokens", "reservedSystemTokens", "reservedToolTokens", "reservedProtocolTokens")


def reserved(prefix: str = "") -> Column:
    """Sum of the reserves; decimal, so that no sum overflows."""
    total = F.lit(0).cast("decimal(38,0)")
    for name in RESERVES:
        total = total + F.coalesce(F.col(prefix + name), F.lit(0)).cast("decimal(20,0)")
    return total


def available(prefix: str = "") -> Column:
    return (F.col(prefix + "totalTokens").cast("decimal(38,0)") - reserved(prefix)).cast("long")


def is_safe_count(column: str) -> Column:
    return F.col(column).between(0, SAFE_INTEGER)


def fits(prefix: str = "") -> Column:
    """Whether the reserves leave the total at 0 or more."""
    return reserved(prefix) <= F.col(prefix + "totalTokens").cast("decimal(38,0)")

"""Reproducible row hashes for splits, folds and sampling.

``rand`` depends on partitioning; these depend on a key column only, use md5, which
any SQL engine has, and need no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabspark.functions.columns import col

# Coarse and fine hashes lie in ``0 … SLOTS-1``.
SLOTS = 10_000


def key_text(key: str | list[str]) -> Column:
    """The key as text: parts joined by ``|``, a NULL part as ``~``, so every row has one."""
    keys = [key] if isinstance(key, str) else list(key)
    return F.concat_ws("|", *[F.coalesce(col(k).cast("string"), F.lit("~")) for k in keys])


def _digits(text: Column, seed: int, start: int) -> Column:
    digest = F.md5(F.concat(F.lit(f"{seed}|"), text))
    return F.pmod(F.conv(F.substring(digest, start, 8), 16, 10).cast("bigint"), F.lit(SLOTS))


def slot(text: Column, seed: int = 42) -> Column:
    """Coarse hash in ``0 … SLOTS-1``: the first 8 hex digits of md5 of seed and key."""
    return _digits(text, seed, 1)


def fine_slot(text: Column, seed: int = 42) -> Column:
    """Second hash in ``0 … SLOTS-1`` from the next 8 digits, to order rows inside one slot."""
    return _digits(text, seed, 9)


def with_fold(df: DataFrame, key: str | list[str], folds: int = 5, seed: int = 42,
              name: str = "fold") -> DataFrame:
    """Add a fold number ``0 … folds-1``; rows with equal keys share a fold."""
    return df.withColumn(name, F.pmod(slot(key_text(key), seed), F.lit(folds)).cast("int"))

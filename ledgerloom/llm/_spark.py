"""Size-checked joins and small helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.scratch import discard, materialize  # noqa: F401  for the operators

#: Keys (8 bytes each) up to which one side of a semi join is broadcast; beyond it the join shuffles.
BROADCAST_KEYS = 1_000_000


def semi_join(df: DataFrame, keys: DataFrame, on: str, how: str = "left_semi") -> DataFrame:
    """Rows of df whose key is among the distinct ``keys`` of a written table; these are broadcast only when counted to be few."""
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return df.join(F.broadcast(keys) if few else keys, on, how)


def anti_join(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows of df whose key isn't among the distinct ``keys``, joined as in semi_join."""
    return semi_join(df, keys, on, "left_anti")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def clean_text(df: DataFrame, text: str = "text") -> Column:
    """The text as UTF-8 bytes for Arrow, null as empty."""
    return F.coalesce(F.col(text).cast("binary"), F.lit(b"").cast("binary"))


def bound_for(sample: int, n: int) -> int | None:
    """Below which a 63-bit hash is chosen, so that about ``sample`` of n rows are; None for all."""
    return None if n <= sample else max(1, (sample << 63) // n)


def chosen(hash: Column, sample: int, n: int) -> Column:
    """Whether a row with this 64-bit hash is among about ``sample`` of n rows, for any n."""
    bound = bound_for(sample, n)
    return F.lit(True) if bound is None else hash.bitwiseAND(F.lit((1 << 63) - 1)) < F.lit(bound)

"""Sampling: capped, stratified and greedy picks over fixed shuffle ranks."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_rank(*columns: str, seed: int = 20260721) -> Column:
    """A reproducible pseudo-random order for sets of any size: md5 of the seed and the columns."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns)))


def capped(df: DataFrame, key: str, rank: str, cap: int, n: int) -> DataFrame:
    """In order of rank, at most ``cap`` rows a key and ``n`` rows in all."""
    w = Window.partitionBy(key).orderBy(rank)
    return df.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= cap).orderBy(rank).limit(n).drop("_i")


def rising_cap(df: DataFrame, key: str, rank: str, least: int = 5, n: int = 20) -> DataFrame:
    """n rows with a cap per key that rises from ``least`` only as far as needed.

    A key's i-th row is taken at cap max(i, least), so one order by (that cap, rank) gives the same picks.
    """
    w = Window.partitionBy(key).orderBy(rank)
    cap = F.greatest(F.row_number().over(w), F.lit(least))
    return df.withColumn("_cap", cap).orderBy("_cap", rank).limit(n).drop("_cap")


def stratified(df: DataFrame, stratum: str, rank: str, sizes: dict[str, int]) -> DataFrame:
    """The first rows of each stratum, by rank."""
    w = Window.partitionBy(stratum).orderBy(rank)
    want = F.create_map(*(F.lit(x) for kv in sizes.items() for x in kv))
    return df.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= F.coalesce(want[F.col(stratum)], F.lit(0))).drop("_i")


def balanced_tiers(df: DataFrame, tier: str, rank: str, upper: Sequence[str], least_upper: int, n: int) -> DataFrame:
    """n rows of which at least ``least_upper`` are of the upper tiers, where there are so many."""
    w = Window.partitionBy(F.col(tier).isin(*upper)).orderBy(rank)
    i = F.row_number().over(w)
    first = F.col(tier).isin(*upper) & (i <= least_upper)
    return df.withColumn("_first", first).orderBy(F.desc("_first"), rank).limit(n).drop("_first")


def greedy_unique(rows: list[dict], target: str, unit: str, cap: int, n: int) -> list[dict]:
    """In order: at most ``cap`` rows a target, each unit once. Two constraints at once need a sequence; for a few hundred candidate rows on the driver."""
    used: Counter = Counter()
    seen, out = set(), []
    for r in rows:
        if used[r[target]] < cap and r[unit] not in seen:
            used[r[target]] += 1
            seen.add(r[unit])
            out.append(r)
            if len(out) == n:
                break
    return out

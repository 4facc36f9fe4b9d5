"""Corpus tables: manifest, unions, keep-first dedup, unique keys, gaps, carry-forward."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as X


def manifest(units: DataFrame, doc: str, tier: str, chars: Column) -> DataFrame:
    """Per document its tier, units and characters; then tier subtotals and the grand total (level tells which)."""
    per_doc = units.groupBy(doc).agg(F.min(tier).alias("tier"), F.count("*").alias("n_units"), F.sum(chars).alias("n_chars"))
    rolled = per_doc.rollup("tier").agg(F.grouping("tier").alias("all_tiers"), F.count("*").alias("n_docs"), F.sum("n_units").alias("n_units"), F.sum("n_chars").alias("n_chars"))
    tiers = rolled.select(F.when(F.col("all_tiers") == 1, "total").otherwise("tier").alias("level"), F.coalesce("tier", F.lit("")).alias("name"), "n_docs", "n_units", "n_chars")
    docs = per_doc.select(F.lit("doc").alias("level"), F.col(doc).alias("name"), F.lit(1).cast("long").alias("n_docs"), "n_units", "n_chars")
    return docs.unionByName(tiers)


def with_share(counts: DataFrame, value: str, share: str = "share") -> DataFrame:
    """Adds the value's share of the total, in percent. The total is one aggregate row, not a window over all rows."""
    total = counts.agg(F.sum(value).alias("_total"))
    return counts.withColumn("_k", F.lit(1)).join(F.broadcast(total.withColumn("_k", F.lit(1))), "_k").withColumn(share, F.round(100 * F.col(value) / F.col("_total"), 4)).drop("_k", "_total")


def union_tagged(parts: dict[str, DataFrame], tag: str = "_source") -> DataFrame:
    """Union by name; columns that a part lacks are null; each row says where it came from."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row of each key by an order. As an aggregate it combines before the shuffle, so a hot key costs a row a task."""
    rest = [c for c in df.columns if c not in keys]
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    best = F.min_by(F.struct(*rest), F.struct(*(o.alias(f"_o{i}") for i, o in enumerate(order))))
    return df.groupBy(*keys).agg(best.alias("_first")).select(*keys, "_first.*").select(df.columns)


def unique_keys(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Adds unit_key: the key, with ~2, ~3, ... for its further rows in order; and n_collisions: how many rows came before with the same key."""
    w = Window.partitionBy(key).orderBy(*order)
    n = F.row_number().over(w)
    named = F.when(n > 1, F.concat(F.col(key), F.lit("~"), n.cast("string"))).otherwise(F.col(key))
    return df.withColumn("unit_key", named).withColumn("n_collisions", n - 1)


def number_gaps(df: DataFrame, group: str, number: str) -> DataFrame:
    """Numbers missing between a group's least and greatest."""
    g = df.where(F.col(number).isNotNull()).groupBy(group).agg(F.min(number).alias("lo"), F.max(number).alias("hi"), F.collect_set(number).alias("seen"))
    gaps = F.array_sort(F.array_except(F.sequence("lo", "hi"), "seen"))
    return g.select(group, "lo", "hi", gaps.alias("missing")).where(F.size("missing") > 0)


def carry_forward(df: DataFrame, group: str, order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Last non-null value at or before each row of its group."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def top_counts(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n most frequent keys, ties by key."""
    return df.groupBy(key).count().orderBy(F.desc("count"), key).limit(n)


def representatives(names: DataFrame, name: str, aliases: DataFrame | None = None) -> DataFrame:
    """(name, canonical): spellings of equal key get the most frequent one, ties to more blanks, then to the smaller.

    ``aliases`` (alias_key, full) is applied first.
    """
    counts = names.groupBy(F.col(name).alias("name")).count()
    counts = counts.withColumn("full", X.collapse(F.col("name")))
    if aliases is not None:
        named = aliases.select("alias_key", F.col("full").alias("_full"))
        counts = counts.join(named, X.name_key(F.col("name")) == F.col("alias_key"), "left").withColumn("full", F.coalesce("_full", "full")).drop("_full", "alias_key")
    counts = counts.withColumn("key", X.name_key(F.col("full")))
    spellings = counts.groupBy("key", "full").agg(F.sum("count").alias("n"))
    blanks = F.length("full") - F.length(F.replace("full", F.lit(" "), F.lit("")))
    best = spellings.groupBy("key").agg(F.min_by("full", F.struct(-F.col("n"), -blanks, F.col("full"))).alias("canonical"))
    return counts.join(best, "key").select("name", "canonical", "count")


def complete_groups(df: DataFrame, item: str, member: str) -> DataFrame:
    """Items that occur with every member (relational division)."""
    pairs = df.select(item, member).distinct()
    total = pairs.select(member).distinct().agg(F.count("*").alias("n_all")).withColumn("_k", F.lit(1))
    per = pairs.groupBy(item).agg(F.count("*").alias("n")).withColumn("_k", F.lit(1))
    return per.join(F.broadcast(total), "_k").where("n = n_all").select(item, "n")


def pending(done: DataFrame, keys: Sequence[str], wanted: Sequence[DataFrame]) -> DataFrame:
    """Combinations of small dimension tables that are not yet done."""
    grid = reduce(lambda a, b: a.withColumn("_k", F.lit(1)).join(F.broadcast(b.withColumn("_k", F.lit(1))), "_k").drop("_k"), wanted)
    return grid.join(done.select(*keys).distinct(), list(keys), "left_anti")

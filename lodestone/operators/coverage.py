"""Coverage and volume conditions: which part of a corpus is taken away, and what that does to the questions.

Conditions are rows, never copies of the corpus.  Both removal loops have closed
forms over a fixed order, so levels nest by construction.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.functions import text as X

_WORD = re.compile(r"\w+")  # as functions.text.word_list: letters, numbers and underscores of all scripts

#: The levels of both kinds of condition.
COVERAGE_LEVELS = (100, 85, 70, 55, 40, 25, 10, 0)
VOLUME_LEVELS = (100, 85, 70, 55, 40, 30)


#: Shingles of items that travel to the documents as they are; beyond that they are joined by value.
SENT_SHINGLES = 1_000_000


def shared_shingles(items: DataFrame, docs: DataFrame, n: int = 5, item_id: str = "item_id", doc_id: str = "doc_id", keep: Sequence[str] = ()) -> DataFrame:
    """(item_id, doc_id, n_shared) and the documents' columns ``keep``: items and documents that share a run of n words.

    The items' shingles are sent to the documents, whose own leave their task only where they are shared; too many of
    them are joined by value.
    """
    gram = lambda df, *keys: df.select(*keys, F.explode(X.word_shingles(X.word_list(F.col("text")), n)).alias("gram"))
    left = gram(items, item_id).distinct()
    if n < 2 or left.count() > SENT_SHINGLES:
        return gram(docs, doc_id, *keep).join(left, "gram").distinct().groupBy(item_id, doc_id, *keep).agg(F.count("*").alias("n_shared"))
    names = [item_id, doc_id, *keep]
    own: dict[tuple, list] = {}
    for item, text in zip(*left.toArrow().select([item_id, "gram"]).to_pydict().values(), strict=True):
        own.setdefault(tuple(text.split(" ")), []).append(item)
    sent = docs.sparkSession.sparkContext.broadcast(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value
        for batch in batches:
            rows, found, numbers = [], [], []
            for i, text in enumerate(batch.column(0)):
                words = _WORD.findall(text.as_py() or "")
                shared = {g for g in zip(*(words[j:] for j in range(n)), strict=False) if g in wanted}
                for item, k in Counter(item for g in shared for item in wanted[g]).items():
                    rows.append(i), found.append(item), numbers.append(k)
            if rows:
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(found, item_type), *(batch.column(1 + j).take(at) for j in range(len(names) - 1)), pa.array(numbers, pa.int64())], names=[*names, "n"])

    item_type = to_arrow_type(items.schema[item_id].dataType)
    kinds = [items.schema[item_id].dataType, *(docs.schema[c].dataType for c in names[1:])]
    pairs = docs.select("text", *names[1:]).mapInArrow(run, ", ".join(f"`{c}` {k.simpleString()}" for c, k in zip(names, kinds, strict=True)) + ", n long")
    return pairs.groupBy(*names).agg(F.sum("n").alias("n_shared"))


def shuffle_ranks(spark: SparkSession, ids: Sequence[str], seed: int) -> DataFrame:
    """(unit, shuffle_rank): the seeded shuffle of sorted ids, made on the driver, so that runs agree.

    For sets of ids that a driver can hold (sources, questions); larger ones take a hash of the id.
    """
    order = sorted(ids)
    random.Random(seed).shuffle(order)
    return spark.createDataFrame([(u, i) for i, u in enumerate(order)], "unit string, shuffle_rank int")


def running(df: DataFrame, buckets: list[Column], order: list, value: Column, name: str, within: Sequence[str] = ()) -> DataFrame:
    """Adds the sum of ``value`` over all rows before each one (of the same ``within``), in an order that no single task has to sort.

    ``buckets`` are the order's leading keys, coarse enough to be few and fine enough to be even: sums run over the
    bucket table, and within each bucket over its own rows.
    """
    keys = [f"_b{i}" for i in range(len(buckets))]
    rows = df.withColumns(dict(zip(keys, buckets, strict=True))).withColumn("_v", value)
    sums = rows.groupBy(*within, *keys).agg(F.sum("_v").alias("_s"))
    offset = F.coalesce(F.sum("_s").over(Window.partitionBy(*within).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    local = F.coalesce(F.sum("_v").over(Window.partitionBy(*within, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(sums.select(*within, *keys, offset.alias("_o")), [*within, *keys]).withColumn(name, F.col("_o") + local).drop(*keys, "_v", "_o")


def removal_order(units: DataFrame, *strategies: str) -> DataFrame:
    """(strategy, unit, rank from 1) of units (unit, in_degree, tier, shuffle_rank): by each strategy, ties by shuffle rank, then unit.

    core: most cited first; periph: least cited first; tier_up: upper tiers first; random: by shuffle rank alone.
    """
    key = {"core": -F.col("in_degree"), "periph": F.col("in_degree"), "tier_up": F.dense_rank().over(Window.orderBy("tier")), "random": F.lit(0)}
    if "tier_up" in strategies:  # a tier's number: of the distinct tiers, which are few
        number = units.select("tier").distinct().select("tier", key["tier_up"].alias("_tier"))
        units = units.join(F.broadcast(number), "tier")
        key["tier_up"] = F.col("_tier")
    each = units.withColumn("_s", F.explode(F.array(*(F.struct(F.lit(s).alias("strategy"), key[s].cast("long").alias("k")) for s in strategies)))).select("unit", "shuffle_rank", "_s.*")
    shuffled = F.substring("shuffle_rank", 1, 3) if dict(units.dtypes)["shuffle_rank"] == "string" else F.floor(F.col("shuffle_rank") / 65536)
    return running(each, [F.col("k"), shuffled], ["shuffle_rank", "unit"], F.lit(1), "before", ["strategy"]).select("strategy", "unit", (F.col("before") + 1).alias("rank"))


def coverage_levels(required: DataFrame, order: DataFrame, levels: Sequence[int] = COVERAGE_LEVELS) -> DataFrame:
    """(strategy, level, stop_rank): how far each order is removed so that at most the level's share of questions stays full.

    ``required`` is (qid, unit).  A question breaks at the smallest rank among its units; the stop is the
    rank at which as many have broken as the level asks for.  The share is rounded half to even.
    """
    broken = required.join(order, "unit").groupBy("strategy", "qid").agg(F.min("rank").alias("fb"))
    by_rank = broken.groupBy("strategy", "fb").count()
    upto = F.sum("count").over(Window.partitionBy("strategy").orderBy("fb").rowsBetween(Window.unboundedPreceding, 0))
    steps = by_rank.select("strategy", "fb", upto.alias("upto"), F.sum("count").over(Window.partitionBy("strategy")).alias("n"))
    each = steps.withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    need = (F.col("n") - F.bround(F.col("n") * F.col("level") / 100)).cast("long")
    return each.groupBy("strategy", "level").agg(F.coalesce(F.min(F.when((need > 0) & (F.col("upto") >= need), F.col("fb"))), F.lit(0)).alias("stop_rank"))


def removed_units(order: DataFrame, stops: DataFrame) -> DataFrame:
    """(strategy, level, unit): units up to each level's stop; stops, a row a level, travel to the units."""
    return order.join(F.broadcast(stops), "strategy").where("rank <= stop_rank").select("strategy", "level", "unit")


def volume_removed(pool: DataFrame, total: float, levels: Sequence[int] = VOLUME_LEVELS) -> DataFrame:
    """(level, unit) removed from a pool (unit, rank, chars): units go in order while the kept share exceeds the level."""
    rows = running(pool, [F.floor(F.col("rank") / 65536)], ["rank"], F.col("chars"), "before")
    kept = rows.select("unit", (100 * (1 - F.col("before") / F.lit(total))).alias("kept_pct"))
    return kept.select("unit", "kept_pct", F.explode(F.array(*map(F.lit, levels))).alias("level")).where("kept_pct > level").select("level", "unit")


def question_status(required: DataFrame, order: DataFrame, stops: DataFrame) -> DataFrame:
    """(strategy, level, qid, status): full, partial or none, by how many of a question's units rank up to the level's stop."""
    ranked = required.join(order, "unit").join(F.broadcast(stops), "strategy")
    g = ranked.groupBy("strategy", "level", "qid").agg(F.count("*").alias("n"), F.count(F.when(F.col("rank") <= F.col("stop_rank"), 1)).alias("g"))
    return g.select("strategy", "level", "qid", F.when(F.col("g") == 0, "full").when(F.col("g") == F.col("n"), "none").otherwise("partial").alias("status"))


def summarise(status: DataFrame, kept_chars: DataFrame, total: float) -> DataFrame:
    """Per strategy and level: full, partial, none, actual coverage and character ratio."""
    k = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    s = status.groupBy("strategy", "level").agg(k("full"), k("partial"), k("none"), F.count("*").alias("n"))
    s = s.withColumn("actual_cov", F.round(100 * F.col("full") / F.col("n"), 4))
    return s.join(kept_chars, ["strategy", "level"]).select("strategy", "level", "full", "partial", "none", "actual_cov", F.round(F.col("kept_chars") / F.lit(total), 6).alias("char_ratio"))


def fingerprints(removed: DataFrame, conditions: DataFrame) -> DataFrame:
    """(condition, fingerprint, canonical): conditions that remove the same units form one class, named after its first."""
    marks = removed.groupBy("condition").agg(F.md5(F.array_join(F.array_sort(F.collect_set("unit")), "\n")).alias("fingerprint"))
    marks = conditions.select("condition").join(marks, "condition", "left").withColumn("fingerprint", F.coalesce("fingerprint", F.md5(F.lit(""))))
    first = marks.groupBy("fingerprint").agg(F.min("condition").alias("canonical"))
    return marks.join(first, "fingerprint").select("condition", "fingerprint", "canonical")


def nesting_faults(removed: DataFrame) -> DataFrame:
    """(strategy, level, unit) removed at a level but not at the next lower one: empty if the levels nest."""
    levels = removed.select("strategy", "level").distinct().withColumn("lower", F.lead("level").over(Window.partitionBy("strategy").orderBy(F.desc("level"))))
    must = removed.join(F.broadcast(levels), ["strategy", "level"]).where("lower is not null").select("strategy", "level", "lower", "unit")
    has = removed.select("strategy", F.col("level").alias("lower"), "unit")
    return must.join(has, ["strategy", "lower", "unit"], "left_anti").select("strategy", "level", "unit")


def regeneration_checks(required: DataFrame, removed: DataFrame, volume: DataFrame, surrogates: DataFrame) -> DataFrame:
    """(check, n, ok) after conditions are made anew: some questions matched; strategies distinct at each level that removes
    anything; levels nested; volume levels take no required unit; and how many questions have no surrogate (the instrument's strength).
    """
    matched = required.select("qid").distinct().agg(F.count("*").alias("n")).select(F.lit("matched").alias("check"), "n", (F.col("n") > 0).alias("ok"))
    marks = removed.groupBy("strategy", "level").agg(F.md5(F.array_join(F.array_sort(F.collect_set(F.col("unit").cast("string"))), "\n")).alias("mark"), F.count("*").alias("size"))
    same = marks.groupBy("level", "mark").agg(F.count("*").alias("k")).where("k > 1").agg(F.count("*").alias("n")).select(F.lit("strategies_alike").alias("check"), "n", (F.col("n") == 0).alias("ok"))
    nested = nesting_faults(removed).agg(F.count("*").alias("n")).select(F.lit("not_nested").alias("check"), "n", (F.col("n") == 0).alias("ok"))
    lost = volume.select("unit").distinct().join(required.select("unit").distinct(), "unit", "left_semi").agg(F.count("*").alias("n")).select(F.lit("required_lost_by_volume").alias("check"), "n", (F.col("n") == 0).alias("ok"))
    weak = required.select("qid").distinct().join(surrogates.select("qid").distinct(), "qid", "left_anti").agg(F.count("*").alias("n")).select(F.lit("without_surrogate").alias("check"), "n", F.lit(True).alias("ok"))
    return matched.unionAll(same).unionAll(nested).unionAll(lost).unionAll(weak)


def content_status(required: DataFrame, alive: DataFrame, surrogates: DataFrame) -> DataFrame:
    """(qid, status) with surrogates: full, partial or none of the gold is alive; none becomes surrogate if a covering duplicate of a gold unit is.

    ``surrogates`` is (qid, unit).
    """
    live = alive.select("unit", F.lit(1).alias("live"))
    g = required.join(live, "unit", "left").groupBy("qid").agg(F.count("*").alias("n"), F.count("live").alias("k"))
    s = surrogates.join(live, "unit").groupBy("qid").agg(F.count("*").alias("n_surrogates"))
    return g.join(s, "qid", "left").select("qid", F.when(F.col("k") == F.col("n"), "full").when(F.col("k") > 0, "partial").when(F.col("n_surrogates") > 0, "surrogate").otherwise("none").alias("status"))



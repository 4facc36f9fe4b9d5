"""Which units a question may be drawn from: filters, scope, tier spans, pools and samples per level."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import sampling

#: Levels that may cite, signs of a fact that a short answer can give, lengths of its article.
CITING_LEVELS = ("jo", "hang", "ho", "mok")
FACT = r"\d+\s*(?:일|개월|년|퍼센트|%|명|회|억원|만원|원)|[가-힣]{2,10}(?:장|관|위원회|부서)"
FACT_LENGTH = (60, 500)
LOWEST_TIER, UNKNOWN_TIER = "T4_행정규칙", "UNK"


def _alive() -> Column:
    return ~F.coalesce(F.col("deleted"), F.lit(False))


def live_articles(units: DataFrame) -> DataFrame:
    return units.where((F.col("level") == "jo") & _alive())


def citing_units(units: DataFrame) -> DataFrame:
    """Units that a citation scan reads: articles and below, not deleted."""
    return units.where(F.col("level").isin(*CITING_LEVELS) & _alive())


def in_scope(units: DataFrame, scopes: DataFrame, name: str = "doc_name") -> tuple[DataFrame, DataFrame]:
    """(units kept, (name, scope, n_units) of those dropped): kept are documents in scope, and those that no decision names.

    ``scopes`` is (name, scope), compared by name key; it must have a row a key.
    """
    known = scopes.select(X.name_key(F.col("name")).alias("_k"), F.col("scope").alias("_scope"))
    rows = units.withColumn("_k", X.name_key(F.col(name))).join(known, "_k", "left")
    keep = F.col("_scope").isNull() | F.col("_scope").startswith("in_scope")
    dropped = rows.where(~keep).groupBy(F.col(name).alias("name"), F.col("_scope").alias("scope")).agg(F.count("*").alias("n_units"))
    return rows.where(keep).drop("_k", "_scope"), dropped


def tier_spans(refs: DataFrame, scopes: DataFrame, gaps: DataFrame | None = None, key: str = "unit_id") -> DataFrame:
    """Per unit, after scope decisions: valid_ext_tier_span (distinct outside tiers of targets in scope), n_in, n_out, n_gap, kind.

    kind: l3 with at least two tiers, l3_mixed if a target is out of scope too; oos_source with fewer, if a target is out of
    scope or a gap (abolished, unobtainable); else none.  ``refs`` is (key, target_name, target_tier), ``scopes`` and ``gaps``
    (name, ...) by name key.
    """
    known = scopes.select(X.name_key(F.col("name")).alias("_k"), "scope")
    rows = refs.withColumn("_k", X.name_key(F.col("target_name"))).join(known, "_k", "left")
    gap = F.lit(False)
    if gaps is not None:
        rows = rows.join(gaps.select(X.name_key(F.col("name")).alias("_k"), F.lit(True).alias("_gap")).distinct(), "_k", "left")
        gap = F.coalesce(F.col("_gap"), F.lit(False))
    ok, out = F.coalesce(F.col("scope").startswith("in_scope"), F.lit(False)), F.coalesce(F.col("scope") == "out_of_scope", F.lit(False))
    outside = ok & ~F.col("target_tier").isin(LOWEST_TIER, UNKNOWN_TIER)
    target = lambda c, name: F.countDistinct(F.when(c, F.col("_k"))).alias(name)
    g = rows.groupBy(key).agg(F.countDistinct(F.when(outside, F.col("target_tier"))).alias("valid_ext_tier_span"), target(ok, "n_in"), target(out, "n_out"), target(gap, "n_gap"))
    span = F.col("valid_ext_tier_span")
    kind = F.when((span >= 2) & (F.col("n_out") > 0), "l3_mixed").when(span >= 2, "l3").when((F.col("n_out") > 0) | (F.col("n_gap") > 0), "oos_source").otherwise("none")
    return g.withColumn("kind", kind)


def prefer_full(rows: DataFrame, status: str = "verdict", full: str = "pass") -> DataFrame:
    """Rows that passed in full, or all of them where none did."""
    best = rows.where(F.col(status) == full)
    return rows if best.isEmpty() else best


def pool_l1(articles: DataFrame) -> DataFrame:
    """Titled live articles of a fitting length that state a figure, a term or an office."""
    return articles.where(_alive() & (F.coalesce("jo_title", F.lit("")) != "") & F.length("text").between(*FACT_LENGTH) & F.col("text").rlike(FACT))


def pool_l2(links: DataFrame, articles: DataFrame) -> DataFrame:
    """(unit_id, targets): live articles with the live articles of their own document that they cite. ``links`` is (unit_id, target_id)."""
    live = live_articles(articles).select("unit_id")
    good = links.join(live, "unit_id", "left_semi").join(live.withColumnRenamed("unit_id", "target_id"), "target_id", "left_semi")
    return good.groupBy("unit_id").agg(F.array_sort(F.collect_set("target_id")).alias("targets"))


def pool_l4(changes: DataFrame) -> DataFrame:
    """Changes in the order in which they are taken: by application clauses, then signals, both descending, then unit."""
    return changes.withColumn("place", F.struct(-F.col("n_applies"), -F.col("n_signals"), F.col("unit_id")))


def clause_supplements(clauses: DataFrame, units: DataFrame) -> DataFrame:
    """Adds supplement_id: the supplement of the clause's document with its promulgation number; of several the last. Null if there is none."""
    last = units.where("level = 'buchik'").groupBy("doc_id", F.col("promulgation_no").alias("issue_no")).agg(F.max("unit_id").alias("supplement_id"))
    return clauses.join(last, ["doc_id", "issue_no"], "left")


def without_used(candidates: DataFrame, written: DataFrame) -> DataFrame:
    """Candidates (unit_id, target) whose unit and target no unanswerable question already has. ``written`` is (answerable, unit_id, target)."""
    used = written.where(~F.coalesce(F.col("answerable"), F.lit(True)))
    return candidates.join(used.select("unit_id").where("unit_id is not null").distinct(), "unit_id", "left_anti").join(used.select("target").where("target is not null").distinct(), "target", "left_anti")


def question_sample(pools: dict[str, DataFrame], doc: str, rank: str, cap: int, n: int) -> DataFrame:
    """(level, unit_id): of each pool at most ``n`` units and ``cap`` a document, in order of ``rank``."""
    out = None
    for level, pool in pools.items():
        one = sampling.capped(pool, doc, rank, cap, n).select(F.lit(level).alias("level"), "unit_id")
        out = one if out is None else out.unionByName(one)
    return out


def bucket_sample(candidates: DataFrame, bucket: str, rank: str, quotas: Sequence[tuple[str, int]]) -> DataFrame:
    """The first rows of each bucket by rank, as many as its quota; a bucket without one gives none."""
    return sampling.stratified(candidates, bucket, rank, dict(quotas))

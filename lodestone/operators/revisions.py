"""Versions of documents: adjacent pairs, kinds of change, change signals, application clauses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as X

#: Kinds of change of an article between two versions.
ADDED, REMOVED, MARKED_DELETED, REVIVED, AMENDED = "신설", "제거", "삭제표시", "부활", "개정"


def adjacent_versions(versions: DataFrame, key: str, order: list) -> DataFrame:
    """(key, version, next_version) pairs in order; ``versions`` has one row a (key, version)."""
    w = Window.partitionBy(key).orderBy(*order)
    return versions.select(key, "version", F.lead("version").over(w).alias("next_version")).where("next_version is not null")


def article_changes(articles: DataFrame, pairs: DataFrame, key: str, code: str, text: str, deleted: str | None = None) -> DataFrame:
    """(key, version, next_version, code, kind, old_text, new_text): articles of adjacent versions set side by side.

    A full outer match expressed as one aggregate: both versions' rows meet under (pair, code).
    """
    gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
    rows = articles.select(key, F.col("version").alias("_v"), code, X.without_amendments(F.col(text)).alias("_n"), F.col(text).alias("_t"), gone.alias("_d"))
    at = lambda c, s: rows.join(pairs.withColumn("_v", F.col(c)), [key, "_v"]).select(key, "version", "next_version", code, F.lit(s).alias("side"), "_n", "_t", "_d")
    old, new = at("version", 0), at("next_version", 1)
    side = lambda s: F.first(F.when(F.col("side") == s, F.struct("_n", "_t", "_d")), ignorenulls=True)
    g = old.unionByName(new).groupBy(key, "version", "next_version", code).agg(side(0).alias("o"), side(1).alias("n"))
    kind = F.when(F.col("o").isNull(), ADDED).when(F.col("n").isNull(), REMOVED).when(~F.col("o._d") & F.col("n._d"), MARKED_DELETED).when(F.col("o._d") & ~F.col("n._d"), REVIVED).when(F.col("o._n") != F.col("n._n"), AMENDED)
    return g.withColumn("kind", kind).where("kind is not null").select(key, "version", "next_version", code, "kind", F.col("o._t").alias("old_text"), F.col("n._t").alias("new_text"))


def with_signals(changes: DataFrame) -> DataFrame:
    """Adds signals, and signal_types: the names of those that fired."""
    s = X.change_signals(F.coalesce("old_text", F.lit("")), F.coalesce("new_text", F.lit("")))
    out = changes.withColumn("signals", s)
    fired = [F.when(F.size(F.col(f"signals.{n}.removed")) + F.size(F.col(f"signals.{n}.added")) > 0, n) for n in X.SIGNALS]
    return out.withColumn("signal_types", F.array_compact(F.array(*fired, F.when(F.col("signals.modality"), "modality"))))


def candidates(changes: DataFrame) -> DataFrame:
    """Changes with a signal, or of a structural kind."""
    return changes.where((F.size("signal_types") > 0) | F.col("kind").isin(ADDED, REMOVED, MARKED_DELETED, REVIVED))


def link_clauses(clauses: DataFrame, articles: DataFrame, stop: list[str] | None = None, least: float = 0.34) -> DataFrame:
    """(clause_id, unit_id, score, shared): clauses and articles whose titles share enough terms: a share of at least ``least``, or two terms.

    Terms are exploded and joined by value, so only titles with a common term ever meet.
    """
    terms = lambda c: F.array_except(F.array_distinct(F.regexp_extract_all(c, F.lit(r"[가-힣]{2,}"), F.lit(0))), F.array(*map(F.lit, stop or []))) if stop else F.array_distinct(F.regexp_extract_all(c, F.lit(r"[가-힣]{2,}"), F.lit(0)))
    a = clauses.select("doc_id", "clause_id", terms(F.col("title")).alias("t")).withColumn("n", F.size("t"))
    b = articles.select("doc_id", "unit_id", F.explode(terms(F.col("title"))).alias("term"))
    hit = a.select("doc_id", "clause_id", "n", F.explode("t").alias("term")).join(b, ["doc_id", "term"]).groupBy("clause_id", "unit_id", "n").agg(F.count("*").alias("shared"), F.array_sort(F.collect_set("term")).alias("matched_tokens"))
    score = F.round(F.col("shared") / F.col("n"), 6)
    return hit.withColumn("score", score).where((score >= least) | (F.col("shared") >= 2)).select("clause_id", "unit_id", "score", "shared", "matched_tokens")

"""Version queries: a customer's orders are versions, line numbers articles, quantities texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import revisions as V
from lodestone.plans.tables import table
from lodestone.registry import query

_PAIRS = "p AS (SELECT * FROM (SELECT o_custkey, o_orderkey AS version, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next_version FROM orders) WHERE next_version IS NOT NULL)"


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("version"), "o_orderdate")
    return V.adjacent_versions(v, "o_custkey", ["o_orderdate", "version"])


@query("adjacent_versions", f"WITH {_PAIRS} SELECT o_custkey, version, next_version FROM p")
def adjacent_versions(spark: SparkSession, sf: str) -> DataFrame:
    return pairs(spark, sf)


@query("article_changes", f"""WITH {_PAIRS}, a AS (SELECT l_orderkey, l_linenumber, max(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)) AS t, bool_or(l_returnflag = 'R') AS d FROM lineitem GROUP BY ALL),
o AS (SELECT p.*, a.l_linenumber, a.t, a.d FROM p JOIN a ON a.l_orderkey = p.version), n AS (SELECT p.*, a.l_linenumber, a.t, a.d FROM p JOIN a ON a.l_orderkey = p.next_version),
j AS (SELECT coalesce(o.o_custkey, n.o_custkey) AS o_custkey, coalesce(o.version, n.version) AS version, coalesce(o.next_version, n.next_version) AS next_version, coalesce(o.l_linenumber, n.l_linenumber) AS l_linenumber, o.t AS ot, n.t AS nt, o.d AS od, n.d AS nd FROM o FULL JOIN n ON o.version = n.version AND o.next_version = n.next_version AND o.l_linenumber = n.l_linenumber),
k AS (SELECT *, CASE WHEN ot IS NULL THEN '신설' WHEN nt IS NULL THEN '제거' WHEN NOT od AND nd THEN '삭제표시' WHEN od AND NOT nd THEN '부활' WHEN ot <> nt THEN '개정' END AS kind FROM j)
SELECT o_custkey, version, next_version, l_linenumber, kind, ot AS old_text, nt AS new_text FROM k WHERE kind IS NOT NULL""")
def article_changes(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("version"), "l_linenumber").agg(F.max(F.col("l_quantity").cast("int").cast("string")).alias("t"), F.max(F.col("l_returnflag") == "R").alias("d"))
    p = pairs(spark, sf)
    owner = table(spark, sf, "orders").select(F.col("o_orderkey").alias("version"), "o_custkey")
    return V.article_changes(a.join(owner, "version"), p, "o_custkey", "l_linenumber", "t", "d")


@query("version_spans", """
SELECT o_custkey, count(*) AS n_versions, CAST(min(o_orderdate) AS DATE) AS first, CAST(max(o_orderdate) AS DATE) AS last, arg_max(o_orderkey, {'d': o_orderdate, 'k': o_orderkey}) AS label FROM orders GROUP BY o_custkey
""")
def version_spans(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_versions"), F.to_date(F.min("o_orderdate")).alias("first"), F.to_date(F.max("o_orderdate")).alias("last"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("label"))

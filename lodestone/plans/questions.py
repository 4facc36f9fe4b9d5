"""Units, references, pools and question checks over texts that are made from the standard tables by one rule, in Spark and in SQL alike."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import citations, parsing, pools, revisions, sampling, stats
from lodestone.operators import neardup as N
from lodestone.operators import slots as S
from lodestone.plans import tables
from lodestone.registry import query as register
from lodestone.session import shared_dir
from lodestone.sources import catalogue, readers, writers
from lodestone.streaming import ingest


def pick(values: list[str], i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))


def sql_pick(values: list[str], i: str) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][CAST(({i}) % {len(values)} AS INTEGER) + 1]"


_MODES = ["AIR", "MAIL", "RAIL", "SHIP", "TRUCK"]
_LINES = f"(SELECT *, {sql_pick(_MODES, 'l_partkey')} AS l_shipmode FROM lineitem)"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table; line items with a mode of shipping, which stands for titles and names."""
    df = tables.table(spark, sf, name)
    return df.withColumn("l_shipmode", pick(_MODES, F.col("l_partkey"))) if name == "lineitem" else df


def query(name: str, sql: str | None = None):
    return register(name, sql.replace("FROM lineitem", f"FROM {_LINES}") if sql else None)


# Line items as the articles of an order: a paragraph with two items, the first with two sub-items, and a second paragraph.
_ARTICLES = """ar AS (SELECT CAST(l_orderkey AS VARCHAR) AS doc, l_linenumber AS n, l_shipmode AS title, l_returnflag AS a, l_linestatus AS b, CAST(l_quantity AS INTEGER) AS q, l_suppkey % 11 = 0 AS deleted,
 row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipmode, l_quantity) AS again FROM lineitem),
aw AS (SELECT doc, n, title, a, b, q, deleted, again, lpad(CAST(n AS VARCHAR), 4, '0') || '00' AS code, CASE WHEN again > 1 THEN '~' || CAST(again AS VARCHAR) ELSE '' END AS mark, row_number() OVER (PARTITION BY doc, n, deleted ORDER BY again) AS nth FROM ar),
ao AS (SELECT * EXCLUDE (mark), CASE WHEN nth > 1 THEN '~' || CAST(nth AS VARCHAR) ELSE '' END AS mark FROM aw WHERE NOT deleted)
"""


def articles(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    q = F.col("l_quantity").cast("int").cast("string")
    opened = F.concat(F.lit(") ① 첫째 "), "l_returnflag", F.lit(" 1. 하나 가. 작은 것 "), q, F.lit(" 나. 다른 것 2. 둘 ③ 아님 ② 둘째 "), "l_linestatus")
    text = F.concat(F.lit(" 제"), F.col("l_linenumber").cast("string"), F.lit("조("), "l_shipmode", F.when(F.col("l_suppkey") % 11 == 0, ") <삭 제>").otherwise(opened))
    order = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipmode", "l_quantity"))
    return li.select(F.col("l_orderkey").cast("string").alias("doc_id"), (2 * order).alias("pos"), text.alias("text"), F.col("l_linenumber").alias("n"))


@query("parsed_units", f"""WITH {_ARTICLES}
SELECT 'rule:' || doc || ':' || code || mark AS unit_id, 'jo' AS level, CAST(n AS INTEGER) AS jo, NULL AS hang, NULL AS ho, NULL AS mok, CASE WHEN n >= 3 THEN '제1장 ' || doc ELSE '' END AS chapter, CASE WHEN n >= 5 THEN '제2절 끝' ELSE '' END AS section, deleted, '제' || n || '조(' || title || CASE WHEN deleted THEN ') <삭 제>' ELSE ') ① 첫째 ' || a || ' 1. 하나 가. 작은 것 ' || q || ' 나. 다른 것 2. 둘 ③ 아님 ② 둘째 ' || b END AS text FROM aw
UNION ALL SELECT 'rule:' || doc || ':' || code || ':' || h.c || mark, 'hang', n, h.k, NULL, NULL, CASE WHEN n >= 3 THEN '제1장 ' || doc ELSE '' END, CASE WHEN n >= 5 THEN '제2절 끝' ELSE '' END, false, CASE h.k WHEN 1 THEN '① 첫째 ' || a || ' 1. 하나 가. 작은 것 ' || q || ' 나. 다른 것 2. 둘 ③ 아님' ELSE '② 둘째 ' || b END FROM ao, (VALUES (1, '000100'), (2, '000200')) h(k, c)
UNION ALL SELECT 'rule:' || doc || ':' || code || ':000100:' || h.c || mark, 'ho', n, 1, h.k, NULL, CASE WHEN n >= 3 THEN '제1장 ' || doc ELSE '' END, CASE WHEN n >= 5 THEN '제2절 끝' ELSE '' END, false, CASE h.k WHEN 1 THEN '1. 하나 가. 작은 것 ' || q || ' 나. 다른 것' ELSE '2. 둘 ③ 아님' END FROM ao, (VALUES (1, '000100'), (2, '000200')) h(k, c)
UNION ALL SELECT 'rule:' || doc || ':' || code || ':000100:000100:' || h.c || mark, 'mok', n, 1, 1, h.c, CASE WHEN n >= 3 THEN '제1장 ' || doc ELSE '' END, CASE WHEN n >= 5 THEN '제2절 끝' ELSE '' END, false, CASE h.k WHEN 1 THEN '가. 작은 것 ' || q ELSE '나. 다른 것' END FROM ao, (VALUES (1, '가'), (2, '나')) h(k, c)""")
def parsed_units(spark: SparkSession, sf: str) -> DataFrame:
    a = articles(spark, sf)
    head = lambda n, text: a.where(F.col("n") >= n).groupBy("doc_id").agg((F.min("pos") - 1).alias("pos")).select("doc_id", F.col("pos") * 10 + (1 if n > 3 else 0), text.alias("text"))
    lines = a.select("doc_id", F.col("pos") * 10, "text").unionAll(head(3, F.concat(F.lit("제1장 "), "doc_id"))).unionAll(head(5, F.lit("제2절 끝"))).toDF("doc_id", "pos", "text")
    return parsing.parse_units(lines).select("unit_id", "level", "jo", "hang", "ho", "mok", "chapter", "section", "deleted", "text")


@query("statute_units", f"""WITH {_ARTICLES}
SELECT 'law:' || doc || ':' || code || mark AS unit_id, 'jo' AS level, CASE doc_type WHEN '법률' THEN 'T1_법률' WHEN '대통령령' THEN 'T2_대통령령' ELSE 'T3_부령' END AS tier, CAST(n AS INTEGER) AS jo, NULL AS hang, NULL AS ho, a AS text FROM (SELECT aw.*, {sql_pick(['법률', '대통령령', '국방부령'], 'CAST(doc AS INTEGER)')} AS doc_type FROM aw)
UNION ALL SELECT 'law:' || doc || ':' || code || ':000100' || mark, 'hang', CASE {sql_pick(['법률', '대통령령', '국방부령'], 'CAST(doc AS INTEGER)')} WHEN '법률' THEN 'T1_법률' WHEN '대통령령' THEN 'T2_대통령령' ELSE 'T3_부령' END, n, 1, NULL, '① ' || title FROM aw
UNION ALL SELECT 'law:' || doc || ':' || code || ':000100:00' || lpad(CAST(q AS VARCHAR), 2, '0') || '02' || mark, 'ho', CASE {sql_pick(['법률', '대통령령', '국방부령'], 'CAST(doc AS INTEGER)')} WHEN '법률' THEN 'T1_법률' WHEN '대통령령' THEN 'T2_대통령령' ELSE 'T3_부령' END, n, 1, q, b FROM (SELECT * EXCLUDE (mark), CASE WHEN row_number() OVER (PARTITION BY doc, n, q ORDER BY again) > 1 THEN '~' || CAST(row_number() OVER (PARTITION BY doc, n, q ORDER BY again) AS VARCHAR) ELSE '' END AS mark FROM aw)""")
def statute_units(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as statute records: line items are articles, with one paragraph that is an object, not a list, and one item with a branch."""
    li = table(spark, sf, "lineitem")
    fields = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipmode", "l_quantity", "l_returnflag", "l_linestatus")

    def article(x: Column) -> Column:
        item = F.struct(F.concat(x["l_quantity"].cast("int").cast("string"), F.lit("의2.")).alias("호번호"), F.array(F.array(x["l_linestatus"])).alias("호내용"))
        para = F.struct(F.lit("").alias("항번호"), F.concat(F.lit("① "), x["l_shipmode"]).alias("항내용"), F.array(item).alias("호"))
        return F.struct(F.lit("조문").alias("조문여부"), x["l_linenumber"].cast("string").alias("조문번호"), x["l_returnflag"].alias("조문내용"), para.alias("항"))

    per = li.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct(*fields))), article).alias("조문단위"))
    kind = pick(["법률", "대통령령", "국방부령"], F.col("l_orderkey"))
    info = F.struct(F.col("l_orderkey").cast("string").alias("법령ID"), F.struct(kind.alias("content")).alias("법종구분"))
    record = F.to_json(F.struct(F.struct(info.alias("기본정보"), F.struct("조문단위").alias("조문")).alias("법령")))
    records = per.select(F.lit("orders").alias("file"), F.col("l_orderkey").cast("int").alias("pos"), record.alias("record"))
    return parsing.statute_units(records, ["unit_id", "level", "tier", "jo", "hang", "ho", "text"])


# Orders as texts that cite: by a quoted name, by an alias that they define, and their own articles by number.
_LAWS = ["산림보호법", "산림보호법 시행령", "어촌개발규칙", "임업지침", "하천 관리"]
_LAW_TIERS = ["T1_법률", "T2_대통령령", "T3_부령", "T4_행정규칙", "UNK"]
_CITING = f"""ci AS (SELECT o_orderkey AS k, CAST(o_custkey AS VARCHAR) AS doc, 'u' || o_orderkey AS unit, {sql_pick(_LAWS, 'o_orderkey')} AS law, {sql_pick(_LAW_TIERS, 'o_orderkey')} AS tier, {sql_pick(_LAWS, 'o_orderkey + 1')} AS law2, {sql_pick(_LAW_TIERS, 'o_orderkey + 1')} AS tier2, o_orderkey % 90 + 1 AS jo FROM orders),
rf AS (SELECT DISTINCT doc, unit, law AS target_name, tier AS target_tier, CAST(jo AS VARCHAR) AS jo, '2' AS jo_branch, '3' AS hang, '' AS ho, 'full' AS kind FROM ci UNION ALL SELECT doc, unit, law2, tier2, '7', '0', '', '4', 'full' FROM ci WHERE k % 3 = 0)
"""


def citing(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    first = F.concat(F.lit("「"), pick(_LAWS, k), F.lit("」 제"), (k % 90 + 1).cast("string"), F.lit("조의2제3항에 따른다."))
    second = F.when(k % 3 == 0, F.concat(F.lit(" 또한 『"), pick(_LAWS, k + 1), F.lit("』 제 7 조 제4호."))).otherwise(" 갑 제9조.")
    return table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("doc_id"), F.concat(F.lit("u"), k.cast("string")).alias("unit_id"), k.alias("pos"), F.concat(first, second).alias("text"))


@query("references", f"WITH {_CITING} SELECT unit AS unit_id, target_name, target_tier, jo, jo_branch, hang, ho, kind FROM rf")
def references(spark: SparkSession, sf: str) -> DataFrame:
    return citations.references(citing(spark, sf)).select("unit_id", "target_name", "target_tier", "jo", "jo_branch", "hang", "ho", "kind")


@query("alias_references", r"""
WITH d AS (SELECT o_custkey AS doc, min(o_orderkey) AS k, count(*) AS n FROM orders GROUP BY 1)
SELECT CAST(d.doc AS VARCHAR) AS doc_id, '산림보호법' || CASE WHEN d.k % 2 = 0 THEN ' 시행령' ELSE '' END AS target_name, count(*) AS n FROM d JOIN orders o ON o.o_custkey = d.doc WHERE o.o_orderkey <> d.k GROUP BY ALL
""")
def alias_references(spark: SparkSession, sf: str) -> DataFrame:
    """A customer's first order defines the alias that its others use."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    first = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("k"))
    name = F.concat(F.lit("산림보호법"), F.when(F.col("k") % 2 == 0, " 시행령").otherwise(""))
    text = F.when(F.col("o_orderkey") == F.col("k"), F.concat(F.lit("「"), name, F.lit('」(이하 "보호법"이라 한다)'))).otherwise("보호법 제3조에 따른다")
    units = o.join(first, "o_custkey").select(F.col("o_custkey").cast("string").alias("doc_id"), F.col("o_orderkey").cast("string").alias("unit_id"), F.col("o_orderkey").alias("pos"), text.alias("text"))
    return citations.references(units).groupBy("doc_id", "target_name").agg(F.count("*").alias("n"))


@query("external_tier_span", f"WITH {_CITING} SELECT unit AS unit_id, count(*) AS n_refs, count(DISTINCT CASE WHEN target_tier NOT IN ('T4_행정규칙', 'UNK') THEN target_tier END) AS ext_tier_span FROM rf GROUP BY unit")
def external_tier_span(spark: SparkSession, sf: str) -> DataFrame:
    return citations.external_tier_span(citations.references(citing(spark, sf)))


_SCOPES = [("산림보호법", "in_scope_own"), ("산림보호법 시행령", "in_scope"), ("어촌개발규칙", "out_of_scope"), ("임업지침", "in_scope")]


@query("tier_spans", f"""WITH {_CITING}, sc(name, scope) AS (VALUES ('산림보호법', 'in_scope_own'), ('산림보호법 시행령', 'in_scope'), ('어촌개발규칙', 'out_of_scope'), ('임업지침', 'in_scope')),
g AS (SELECT unit AS unit_id, count(DISTINCT CASE WHEN scope LIKE 'in_scope%' AND target_tier NOT IN ('T4_행정규칙', 'UNK') THEN target_tier END) AS valid_ext_tier_span, count(DISTINCT CASE WHEN scope LIKE 'in_scope%' THEN target_name END) AS n_in, count(DISTINCT CASE WHEN scope = 'out_of_scope' THEN target_name END) AS n_out, count(DISTINCT CASE WHEN target_name = '하천 관리' THEN target_name END) AS n_gap FROM rf LEFT JOIN sc ON sc.name = rf.target_name GROUP BY unit)
SELECT *, CASE WHEN valid_ext_tier_span >= 2 AND n_out > 0 THEN 'l3_mixed' WHEN valid_ext_tier_span >= 2 THEN 'l3' WHEN n_out > 0 OR n_gap > 0 THEN 'oos_source' ELSE 'none' END AS kind FROM g""")
def tier_spans(spark: SparkSession, sf: str) -> DataFrame:
    scopes = spark.createDataFrame(_SCOPES, "name string, scope string")
    return pools.tier_spans(citations.references(citing(spark, sf)), scopes, spark.createDataFrame([("하천관리",)], "name string"))


def _units(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as units: six levels, some deleted, some without a title."""
    li = table(spark, sf, "lineitem")
    level = pick(["jo", "hang", "ho", "mok", "buchik", "byeolpyo"], F.col("l_partkey"))
    text = F.concat(F.lit("기한은 "), F.col("l_quantity").cast("int").cast("string"), pick(["일 이내", "개월 안", "쪽", "명까지"], F.col("l_suppkey")), F.lit(" "), F.repeat(F.lit("가"), F.col("l_partkey").cast("int") % 700))
    return li.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("unit_id"), F.col("l_orderkey").alias("doc_id"), level.alias("level"), (F.col("l_suppkey") % 7 == 0).alias("deleted"), F.when(F.col("l_partkey") % 4 != 0, F.col("l_shipmode")).alias("jo_title"), text.alias("text"), F.concat(F.lit("법 "), "l_shipmode").alias("doc_name"))


_UNITS = f"""un AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS unit_id, l_orderkey AS doc_id, {sql_pick(['jo', 'hang', 'ho', 'mok', 'buchik', 'byeolpyo'], 'l_partkey')} AS level, l_suppkey % 7 = 0 AS deleted, CASE WHEN l_partkey % 4 <> 0 THEN l_shipmode END AS jo_title,
 '기한은 ' || CAST(l_quantity AS INTEGER) || {sql_pick(['일 이내', '개월 안', '쪽', '명까지'], 'l_suppkey')} || ' ' || repeat('가', CAST(l_partkey % 700 AS INTEGER)) AS text, l_shipmode AS mode FROM lineitem)"""


@query("live_articles", f"WITH {_UNITS} SELECT unit_id FROM un WHERE level = 'jo' AND NOT deleted")
def live_articles(spark: SparkSession, sf: str) -> DataFrame:
    return pools.live_articles(_units(spark, sf)).select("unit_id")


@query("citing_units", f"WITH {_UNITS} SELECT level, count(*) AS n FROM un WHERE level IN ('jo', 'hang', 'ho', 'mok') AND NOT deleted GROUP BY level")
def citing_units(spark: SparkSession, sf: str) -> DataFrame:
    return pools.citing_units(_units(spark, sf)).groupBy("level").agg(F.count("*").alias("n"))


@query("pool_l1", f"WITH {_UNITS} SELECT unit_id FROM un WHERE level = 'jo' AND NOT deleted AND jo_title IS NOT NULL AND length(text) BETWEEN 60 AND 500 AND regexp_matches(text, '[0-9]+\\s*(일|개월|년|퍼센트|%|명|회|억원|만원|원)')".replace("\\\\", "\\"))
def pool_l1(spark: SparkSession, sf: str) -> DataFrame:
    return pools.pool_l1(pools.live_articles(_units(spark, sf))).select("unit_id")


@query("in_scope_units", f"WITH {_UNITS}, s AS (SELECT *, CASE mode WHEN 'AIR' THEN 'out_of_scope' WHEN 'MAIL' THEN 'abolished' WHEN 'RAIL' THEN 'in_scope_own' END AS scope FROM un) SELECT 'kept' AS name, NULL AS scope, count(*) AS n_units FROM s WHERE scope IS NULL OR scope LIKE 'in_scope%' UNION ALL SELECT '법 ' || mode, scope, count(*) FROM s WHERE scope NOT LIKE 'in_scope%' GROUP BY mode, scope")
def in_scope_units(spark: SparkSession, sf: str) -> DataFrame:
    scopes = spark.createDataFrame([("법AIR", "out_of_scope"), ("법 (MAIL)", "abolished"), ("법 RAIL", "in_scope_own"), ("다른 법", "out_of_scope")], "name string, scope string")
    kept, dropped = pools.in_scope(_units(spark, sf), scopes)
    return kept.agg(F.count("*").alias("n_units")).select(F.lit("kept").alias("name"), F.lit(None).cast("string").alias("scope"), "n_units").unionByName(dropped)


@query("internal_links", """
WITH a AS (SELECT l_orderkey AS doc, l_linenumber AS n, min(l_suppkey) % 5 = 0 AS deleted FROM lineitem GROUP BY ALL)
SELECT x.doc || ':' || x.n AS unit_id, x.doc || ':' || y.n AS target_id FROM a x JOIN a y ON y.doc = x.doc AND (y.n = x.n + 1 OR y.n = 1) AND y.n <> x.n WHERE NOT x.deleted AND NOT y.deleted
""")
def internal_links(spark: SparkSession, sf: str) -> DataFrame:
    """Each article cites itself, the next one, the first one, and other documents' articles by name and by alias."""
    a = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("jo")).agg((F.min("l_suppkey") % 5 == 0).alias("deleted"))
    text = F.concat(F.lit("제"), F.col("jo").cast("string"), F.lit("조 및 제"), (F.col("jo") + 1).cast("string"), F.lit("조, 제1조, 「산림보호법」 제2조, 시행령 제3조"))
    return citations.internal_references(a.withColumn("unit_id", F.concat_ws(":", "doc_id", "jo")).withColumn("jo_branch", F.lit(0)).withColumn("text", text))


@query("article_verdicts", """
WITH a AS (SELECT l_orderkey AS doc, l_linenumber AS n, bool_and(l_suppkey % 5 = 0) AS deleted FROM lineitem GROUP BY ALL),
r AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey END AS doc, unnest([1, 3, 6]) AS n FROM orders),
v AS (SELECT r.k, CASE WHEN r.doc IS NULL THEN 'missing_doc' WHEN a.doc IS NULL THEN 'missing_jo' WHEN a.deleted THEN 'deleted_jo' ELSE 'resolved' END AS verdict FROM r LEFT JOIN a ON a.doc = r.doc AND a.n = r.n)
SELECT 'u' || k AS unit_id, count(*) AS n, count(*) FILTER (WHERE verdict = 'resolved') AS n_resolved, CASE WHEN count(*) FILTER (WHERE verdict = 'resolved') = count(*) THEN 'pass' WHEN count(*) FILTER (WHERE verdict = 'resolved') > 0 THEN 'pass_partial' ELSE 'reject' END AS verdict FROM v GROUP BY k
""")
def article_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    refs = table(spark, sf, "orders").select(F.concat(F.lit("u"), k.cast("string")).alias("unit_id"), F.when(k % 7 != 0, k).alias("cited_doc"), F.explode(F.array(F.lit("1"), F.lit("3"), F.lit("6"))).alias("jo"), F.lit("0").alias("jo_branch"))
    arts = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("jo"), F.lit(0).alias("jo_branch"), (F.col("l_suppkey") % 5 == 0).alias("deleted"))
    # an article is cited by its own order alone; half a million rows a task
    partitions = max(spark.sparkContext.defaultParallelism, -(-(3 * table(spark, sf, "orders").count() + arts.count()) // 500_000))
    return citations.verify_gold(citations.resolve_articles(refs, arts, partitions), partitions=partitions)


@query("preferred_verdicts", """
WITH v AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'pass' ELSE 'pass_partial' END AS verdict FROM orders) SELECT k, verdict, 'some' AS pool FROM v WHERE verdict = 'pass' UNION ALL SELECT k, verdict, 'none' FROM v WHERE verdict <> 'pass'
""")
def preferred_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 3 == 0, "pass").otherwise("pass_partial").alias("verdict"))
    return pools.prefer_full(v).withColumn("pool", F.lit("some")).unionByName(pools.prefer_full(v.where("verdict <> 'pass'")).withColumn("pool", F.lit("none")))


@query("unused_candidates", """
WITH c AS (SELECT o_orderkey AS unit_id, o_custkey AS target FROM orders), w AS (SELECT l_orderkey AS u, l_partkey AS t FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1)
SELECT unit_id, target FROM c WHERE unit_id NOT IN (SELECT u FROM w) AND target NOT IN (SELECT t FROM w)
""")
def unused_candidates(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "orders").select(F.col("o_orderkey").alias("unit_id"), F.col("o_custkey").alias("target"))
    w = table(spark, sf, "lineitem").where("l_linenumber = 1").select((F.col("l_returnflag") != "R").alias("answerable"), F.col("l_orderkey").alias("unit_id"), F.col("l_partkey").alias("target"))
    return pools.without_used(c, w).select("unit_id", "target")


@query("clause_supplements", """
SELECT o_orderkey AS clause_id, (SELECT max('s' || lpad(CAST(l.l_partkey AS VARCHAR), 9, '0') || '-' || l.l_linenumber) FROM lineitem l WHERE l.l_orderkey = o_orderkey AND l.l_suppkey % 4 = o_custkey % 4) AS supplement_id FROM orders
""")
def clause_supplements(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "orders").select(F.col("o_orderkey").alias("clause_id"), F.col("o_orderkey").alias("doc_id"), (F.col("o_custkey") % 4).cast("string").alias("issue_no"))
    u = table(spark, sf, "lineitem").select(F.lit("buchik").alias("level"), F.col("l_orderkey").alias("doc_id"), (F.col("l_suppkey") % 4).cast("string").alias("promulgation_no"), F.concat(F.lit("s"), F.lpad(F.col("l_partkey").cast("string"), 9, "0"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("unit_id"))
    return pools.clause_supplements(c, u).select("clause_id", "supplement_id")


@query("pool_l4_sample", """
WITH c AS (SELECT o_orderkey AS k, o_custkey % 50 AS doc, o_orderkey % 3 AS a, o_custkey % 5 AS s FROM orders), o AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY a DESC, s DESC, k) AS i FROM c)
SELECT k AS unit_id, doc FROM o ORDER BY greatest(i, 2), a DESC, s DESC, k LIMIT 20
""")
def pool_l4_sample(spark: SparkSession, sf: str) -> DataFrame:
    """The best twenty changes, the cap per document rising from two."""
    c = table(spark, sf, "orders").select(F.col("o_orderkey").alias("unit_id"), (F.col("o_custkey") % 50).alias("doc"), (F.col("o_orderkey") % 3).alias("n_applies"), (F.col("o_custkey") % 5).alias("n_signals"))
    return sampling.rising_cap(pools.pool_l4(c), "doc", "place", 2, 20).select("unit_id", "doc")


@query("question_sample", """
WITH d AS (SELECT doc_id, source, lang, md5('20260721|' || CAST(doc_id AS VARCHAR)) AS h FROM documents), c AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY h) AS i FROM d WHERE lang IN ('en', 'de', 'fr')), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY h) AS j FROM c WHERE i <= 3)
SELECT lang AS level, doc_id AS unit_id FROM r WHERE j <= 20
""")
def question_sample(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("unit_id"), "source", "lang", sampling.hash_rank("doc_id").alias("h"))
    return pools.question_sample({x: d.where(F.col("lang") == x) for x in ("en", "de", "fr")}, "source", "h", 3, 20)


@query("bucket_sample", """
WITH d AS (SELECT o_orderkey AS unit_id, o_orderpriority AS bucket, md5('20260721|' || CAST(o_orderkey AS VARCHAR)) AS h FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY h) AS i FROM d)
SELECT unit_id, bucket FROM r WHERE i <= CASE bucket WHEN '1-URGENT' THEN 8 WHEN '2-HIGH' THEN 4 WHEN '3-MEDIUM' THEN 5 WHEN '5-LOW' THEN 3 ELSE 0 END
""")
def bucket_sample(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "orders").select(F.col("o_orderkey").alias("unit_id"), F.col("o_orderpriority").alias("bucket"), sampling.hash_rank("o_orderkey").alias("h"))
    return pools.bucket_sample(d, "bucket", "h", [("1-URGENT", 8), ("2-HIGH", 4), ("3-MEDIUM", 5), ("5-LOW", 3)]).select("unit_id", "bucket")


# Questions made from orders: what each rule should find in them is said beside them.
_ASKED = ["절차는 무엇인가?", "제5조의2 내용은?", "2020년 3월 기준은?", "별지 제3호 서식은?", "「산림보호법」 기준은?", "하나 둘 셋 넷 다섯 여섯", "하나 둘 셋 넷 여섯", ""]
_PLACE, _DATED, _NAMED = "i = 1", "i = 2", "i = 4"
_QUESTIONS = f"""qs AS (SELECT o_orderkey AS qid, o_orderkey % 8 AS i, {sql_pick(_ASKED, 'o_orderkey')} AS question, CASE o_custkey % 4 WHEN 0 THEN '30일' WHEN 1 THEN repeat('가', 20) WHEN 2 THEN repeat('가', 41) ELSE '근거 없음' END AS answer, {sql_pick(['제1조에 따라 적용한다', '가. 나. 다. 라. 마.', '확인할 수 없다'], 'o_custkey')} AS long, o_custkey % 3 AS l, o_custkey % 4 AS s, o_orderkey % 5 <> 0 AS answerable, {sql_pick(['1', '4', '0'], 'o_orderkey')} AS level FROM orders)"""


def asked(spark: SparkSession, sf: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    answer = F.when(c % 4 == 0, "30일").when(c % 4 == 1, "가" * 20).when(c % 4 == 2, "가" * 41).otherwise("근거 없음")
    return table(spark, sf, "orders").select(k.alias("qid"), pick(_ASKED, k).alias("question"), answer.alias("answer_short"), pick(["제1조에 따라 적용한다", "가. 나. 다. 라. 마.", "확인할 수 없다"], c).alias("answer_long"), F.array(F.lit("영, 하나 둘 셋 넷 다섯 끝"), F.lit(None).cast("string")).alias("evidence"), pick(["1", "4", "0"], k).cast("int").alias("level"), (k % 5 != 0).alias("answerable"), F.lit("산림 보호법").alias("cited_target"), F.array(F.lit("산림보호법"), F.lit("")).alias("gold_names"))


def _rules(*rules: tuple[str, str]) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{name}' END" for name, c in rules) + ")"


@query("authoring_checks", f"""WITH {_QUESTIONS}, f AS (SELECT qid, i, {_rules(('leak', 'i = 5'), ('long_answer', 'answerable AND s = 2'), ('date', _DATED), ('position', f'answerable AND {_PLACE}'))} AS fails,
 {_rules(('leak_border', 'i = 6'), ('answer_length', 'answerable AND s = 1'), ('many_sentences', 'l = 1'), ('target_not_named', 'NOT answerable AND i <> 4'), ('no_application', "level = '4' AND l <> 0"), ('no_basis', "level = '4' AND l <> 0"), ('no_time', "level = '4'"), ('not_declined', "level = '0' AND l <> 2"), ('quoted_names', _NAMED))} AS warnings FROM qs)
SELECT qid, CASE WHEN i = 7 THEN 'no_question' ELSE fails END AS fails, CASE WHEN i = 7 THEN '' ELSE warnings END AS warnings, CASE WHEN i = 7 THEN '미작성' WHEN fails <> '' THEN '반려' WHEN warnings <> '' THEN '주의' ELSE '통과' END AS status FROM f""")
def authoring_checks(spark: SparkSession, sf: str) -> DataFrame:
    return S.check_slots(asked(spark, sf)).select("qid", F.array_join("fails", ",").alias("fails"), F.array_join("warnings", ",").alias("warnings"), "status")


@query("sheet_checks", f"WITH {_QUESTIONS} SELECT qid, {_rules(('leak', 'i = 5'), ('date', _DATED), ('answer_length', 'answerable AND s IN (1, 2)'), ('not_declined', 'NOT answerable AND s <> 3'))} AS warnings FROM qs WHERE i <> 7")
def sheet_checks(spark: SparkSession, sf: str) -> DataFrame:
    return S.check_sheet(asked(spark, sf)).select("qid", F.array_join("warnings", ",").alias("warnings"))


@query("reference_scan", f"WITH {_QUESTIONS} SELECT qid, '제거' AS kind, 'place' AS item FROM qs WHERE {_PLACE} UNION ALL SELECT qid, '검토', '산림보호법' FROM qs WHERE answerable AND {_NAMED} UNION ALL SELECT qid, '주의', '산림 보호법' FROM qs WHERE NOT answerable AND i <> 7")
def reference_scan(spark: SparkSession, sf: str) -> DataFrame:
    return S.scan_references(asked(spark, sf))


@query("worksheet", f"WITH {_QUESTIONS}, w AS (SELECT l_orderkey AS qid, max(CAST(l_quantity AS INTEGER)) AS n_dup, max(CAST(l_quantity AS INTEGER)) / 50 AS top_sim FROM lineitem WHERE CAST(l_quantity AS INTEGER) % 2 = 0 GROUP BY 1) SELECT q.qid, w.n_dup, round(w.top_sim, 6) AS top_sim FROM qs q LEFT JOIN w USING (qid) WHERE i IN (0, 7)")
def worksheet(spark: SparkSession, sf: str) -> DataFrame:
    q = asked(spark, sf)
    n = F.col("l_quantity").cast("int")
    dup = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("qid"), F.when(n % 2 == 0, n).otherwise(0).alias("n_dup_other"), (n / 50).alias("top_sim"))
    done = q.select("qid", F.when(F.col("qid") % 8 == 0, " ").otherwise(F.col("question")).alias("question"))
    return S.worksheet(q.select("qid"), done, dup).select("qid", "n_dup", F.round("top_sim", 6).alias("top_sim"))


@query("carried_slots", """
WITH s AS (SELECT o_orderkey AS qid, o_custkey % 3 AS c FROM orders) SELECT qid, CASE WHEN c = 0 THEN 'old' ELSE '' END AS question, CASE WHEN c = 1 THEN 'sheet' ELSE 'kept' END AS note FROM s
""")
def carried_slots(spark: SparkSession, sf: str) -> DataFrame:
    """Questions carried over where the gold agrees in whatever order and the old one is written; notes filled from a sheet where it has one."""
    c = F.col("o_custkey") % 3
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("qid"), c.alias("c"))
    new = o.select("qid", F.array(F.lit("a"), F.lit("b")).alias("gold_ids"), F.lit("").alias("question"), F.lit("kept").alias("note"))
    old = o.select("qid", F.when(F.col("c") == 2, F.array(F.lit("a"))).otherwise(F.array(F.lit("b"), F.lit("a"))).alias("gold_ids"), F.when(F.col("c") == 1, " ").otherwise("old").alias("question"))
    sheet = o.select("qid", F.when(F.col("c") == 1, "sheet").otherwise(" ").alias("note"))
    return S.fill_fields(S.carry_over(new, old, ["question"]), sheet, ["note"]).select("qid", "question", "note")


@query("required_units", """
SELECT DISTINCT l_orderkey AS qid, 'u' || l_partkey AS unit FROM lineitem l WHERE l_returnflag = 'R' OR NOT EXISTS (SELECT 1 FROM lineitem m WHERE m.l_orderkey = l.l_orderkey AND m.l_returnflag = 'R')
""")
def required_units(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    gold = li.select(F.col("l_orderkey").alias("qid"), F.concat(F.lit("u"), F.col("l_partkey").cast("string")).alias("unit_id"), F.when(F.col("l_returnflag") == "R", "required").otherwise("optional").alias("necessity"))
    units = li.select(F.concat(F.lit("u"), F.col("l_partkey").cast("string")).alias("unit_id"), F.lit("d").alias("doc_id"), F.lit(1).alias("jo"), F.lit(0).alias("jo_branch"), F.lit(None).cast("int").alias("hang"), F.lit(None).cast("int").alias("ho"), F.lit(None).cast("string").alias("mok"), F.lit("t").alias("text")).distinct()
    return S.required_units(S.evidence(gold, units))


@query("repaired_spans", """
SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, l_shipmode || CASE WHEN l_returnflag <> l_linestatus AND strpos(l_shipmode, l_returnflag) = 0 THEN chr(10) || l_returnflag ELSE '' END AS span, length(l_shipmode || l_shipmode) IN (8, 14) AS capped FROM lineitem
""")
def repaired_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that were said before go, the last one is always a repetition."""
    li = table(spark, sf, "lineitem")
    span = F.concat_ws("\n", "l_shipmode", F.when(F.col("l_returnflag") != F.col("l_linestatus"), F.col("l_returnflag")), "l_shipmode")
    gold = lambda t: F.array(F.struct(t.alias("text_span")))
    return li.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), S.repair_spans(gold(span))[0]["text_span"].alias("span"), S.at_cap(gold(F.concat("l_shipmode", "l_shipmode")), (8, 14)).alias("capped"))


@query("change_signals", """
WITH c AS (SELECT o_orderkey AS k, o_orderkey % 40 + 1 AS a, o_custkey % 40 + 1 AS b, o_orderkey % 4 = 0 AS duty_old, o_custkey % 4 = 0 AS duty_new FROM orders)
SELECT k, a <> b AS numbers, duty_old <> duty_new AS modality, concat_ws(',', CASE WHEN a <> b THEN 'numbers' END, CASE WHEN duty_old <> duty_new THEN 'modality' END) AS signal_types FROM c WHERE a <> b OR duty_old <> duty_new
""")
def change_signals(spark: SparkSession, sf: str) -> DataFrame:
    text = lambda n, duty: F.concat(F.lit("기한은 "), (n % 40 + 1).cast("string"), F.lit("일이며 보고"), F.when(duty % 4 == 0, "하여야 한다").otherwise("한다"))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    changes = table(spark, sf, "orders").select(k.alias("k"), F.lit(revisions.AMENDED).alias("kind"), text(k, k).alias("old_text"), text(c, c).alias("new_text"))
    found = revisions.with_signals(changes).where(F.size("signal_types") > 0)
    return found.select("k", (F.size("signals.numbers.removed") > 0).alias("numbers"), F.col("signals.modality").alias("modality"), F.array_join("signal_types", ",").alias("signal_types"))


@query("linked_clauses", """
WITH c AS (SELECT DISTINCT p_brand AS doc, p_size AS s FROM part), t AS (SELECT doc, s, s % 5 AS x, s % 7 AS y FROM c)
SELECT a.doc || '-' || a.s AS clause_id, a.doc || '-' || b.s AS unit_id, CAST((a.x = b.x)::INT + (a.y = b.y)::INT AS BIGINT) AS shared, round(((a.x = b.x)::INT + (a.y = b.y)::INT) / 2, 6) AS score FROM t a JOIN t b ON b.doc = a.doc AND (a.x = b.x OR a.y = b.y)
""")
def linked_clauses(spark: SparkSession, sf: str) -> DataFrame:
    x, y = ["가나", "다라", "마바", "사아", "자차"], ["강산", "들판", "바다", "하늘", "구름", "나무", "꽃밭"]
    p = table(spark, sf, "part").select("p_brand", "p_size").distinct()
    key = F.concat_ws("-", "p_brand", "p_size")
    title = F.concat_ws(" ", pick(x, F.col("p_size")), pick(y, F.col("p_size")))
    clauses = p.select(F.col("p_brand").alias("doc_id"), key.alias("clause_id"), title.alias("title"))
    return revisions.link_clauses(clauses, clauses.withColumnRenamed("clause_id", "unit_id")).select("clause_id", "unit_id", "shared", "score")


@query("labels", """
SELECT o_orderkey, '제' || (o_custkey % 99 + 1) || '조' || CASE WHEN o_orderkey % 4 > 0 THEN '의' || (o_orderkey % 4) ELSE '' END AS article, lpad(CAST(o_custkey % 99 + 1 AS VARCHAR), 4, '0') || lpad(CAST(o_orderkey % 4 AS VARCHAR), 2, '0') AS code, (o_custkey % 99 + 1) || CASE WHEN o_orderkey % 4 > 0 THEN '의' || (o_orderkey % 4) ELSE '' END AS label,
 strftime(o_orderdate, '%Y-%m-%d') AS day, (o_custkey % 99 + 1) || ',' || (o_orderkey % 4) AS issue, 'a-' || o_orderkey AS safe, CAST(o_orderkey AS VARCHAR) AS leaf, CAST(o_custkey % 101 AS INTEGER) AS cov, 'core' AS strategy FROM orders
""")
def labels(spark: SparkSession, sf: str) -> DataFrame:
    n, b = F.col("o_custkey") % 99 + 1, F.col("o_orderkey") % 4
    code, key = X.code6(n, b), F.col("o_orderkey").cast("string")
    name = X.condition_parts(F.format_string("cov%03d_core_doc.jsonl", (F.col("o_custkey") % 101).cast("int")))
    issue = F.array_join(F.transform(X.issue_key(F.concat(F.lit("제"), n.cast("string"), F.lit("-"), b.cast("string"), F.lit("호"))), lambda x: x.cast("string")), ",")
    return table(spark, sf, "orders").select("o_orderkey", X.article_label(n, b).alias("article"), code.alias("code"), X.code6_label(code).alias("label"), X.iso_date(F.date_format("o_orderdate", "yyyyMMdd")).alias("day"), issue.alias("issue"), X.safe_name(F.concat(F.lit("a: /"), key)).alias("safe"), X.path_leaf(F.concat(F.lit("a\\b/"), key)).alias("leaf"), name["cov"].alias("cov"), name["strategy"].alias("strategy"))


@query("numbers_of", f"""SELECT p_partkey, {sql_pick(['9의2.', '①', '제12조', '', '표'], 'p_partkey')} AS raw, CAST({sql_pick(['9', '1', '12', '0', '0'], 'p_partkey')} AS INTEGER) AS number, CAST({sql_pick(['2', '0', '0', '0', '0'], 'p_partkey')} AS INTEGER) AS branch FROM part""")
def numbers_of(spark: SparkSession, sf: str) -> DataFrame:
    raw = pick(["9의2.", "①", "제12조", "", "표"], F.col("p_partkey"))
    return table(spark, sf, "part").select("p_partkey", raw.alias("raw"), X.parse_number(raw).alias("n")).select("p_partkey", "raw", "n.*")


_NAMES = ["산림보호법 시행령", "같은 법", "이 규정", "어촌개발규칙 시행세칙", "바다", "해당 고시", "하천관리 지침"]


@query("named_laws", f"""SELECT p_partkey, name, name IN ('같은 법', '이 규정', '바다', '해당 고시') AS noise, CASE name WHEN '산림보호법 시행령' THEN '산림보호법' WHEN '어촌개발규칙 시행세칙' THEN '어촌개발규칙' END AS parent, CASE name WHEN '산림보호법 시행령' THEN 'T2_대통령령' WHEN '같은 법' THEN 'T1_법률' WHEN '바다' THEN 'UNK' ELSE 'T4_행정규칙' END AS tier, CASE WHEN name LIKE '%산림%' THEN 'forest' WHEN name LIKE '%하천%' THEN 'water' ELSE 'unknown' END AS hint FROM (SELECT p_partkey, {sql_pick(_NAMES, 'p_partkey')} AS name FROM part)""")
def named_laws(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("name")
    names = table(spark, sf, "part").select("p_partkey", pick(_NAMES, F.col("p_partkey")).alias("name"))
    return names.select("p_partkey", "name", X.is_noise(n).alias("noise"), X.parent_name(n).alias("parent"), X.tier_of(n).alias("tier"), X.first_hint(n, [("산림", "forest"), ("하천", "water")]).alias("hint"))


@query("triaged_names", f"""WITH n AS (SELECT {sql_pick(_NAMES, 'p_partkey')} || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ' ' || p_brand END AS name, count(*) AS c FROM part GROUP BY 1)
SELECT name, CASE WHEN name IN ('같은 법', '이 규정', '바다', '해당 고시') THEN 'noise' WHEN name = '산림보호법 시행령' THEN 'inherited' WHEN c >= 10 THEN 'P1' WHEN c >= 3 THEN 'P2' ELSE 'P3' END AS outcome, CASE WHEN name = '산림보호법 시행령' THEN 'in_scope' END AS scope FROM n""")
def triaged_names(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(pick(_NAMES, F.col("p_partkey")), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit(" "), "p_brand")))
    counts = table(spark, sf, "part").groupBy(name.alias("name")).agg(F.count("*").alias("citations"))
    return citations.triage(counts, spark.createDataFrame([("산림 보호법", "in_scope")], "name string, scope string"))


@query("last_cited", """
SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN '둘째법' WHEN o_custkey % 3 = 1 THEN '셋째법' END AS target FROM orders
""")
def last_cited(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("o_custkey") % 3
    texts = F.array(F.when(c == 0, "「첫째법」과 「둘째법」").otherwise("없음"), F.when(c <= 1, "「셋째법」"), F.lit(None).cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", citations.last_cited(texts).alias("target"))


@query("format_intervals", """
WITH g AS (SELECT source, CAST(sum(quality) AS BIGINT) AS k, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1), w AS (SELECT *, 1.959963984540054 AS z, k / n AS p FROM g),
b AS (SELECT *, 100 * greatest((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 0) AS lo, 100 * least((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 1) AS hi FROM w)
SELECT source, printf('%.1f%% [%.0f–%.0f] (%d/%d)', 100.0 * k / n, lo, hi, k, n) AS shown FROM b UNION ALL SELECT 'none', '-'
""")
def format_intervals(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id").groupBy("source").agg(F.sum("quality").alias("k"), F.count("*").alias("n"))
    g = g.unionByName(spark.createDataFrame([("none", 0, 0)], "source string, k long, n long"))
    return g.select("source", stats.format_interval(F.col("k"), F.col("n")).alias("shown"))


@query("surrogates", """
WITH e AS (SELECT a.doc_id AS src, b.doc_id AS dst FROM documents a JOIN documents b ON b.text = a.text AND b.doc_id <> a.doc_id)
SELECT src % 100 AS qid, dst AS unit FROM e WHERE src % 3 = 0 AND dst % 3 <> 0 GROUP BY ALL
""")
def surrogates(spark: SparkSession, sf: str) -> DataFrame:
    """Copies of gold documents that are not gold themselves; a document's own language and source are its answer's words."""
    d = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("h"), F.concat(F.lit("세금 30일 "), F.md5("text")).alias("text"))
    edges = d.select(F.col("doc_id").alias("src"), "h").join(d.select(F.col("doc_id").alias("dst"), "h"), "h").where("src <> dst")
    gold = d.where("doc_id % 3 = 0").select((F.col("doc_id") % 100).alias("qid"), "doc_id")
    answers = gold.select("qid").distinct().withColumn("answer", F.lit("세금 30일"))
    return N.surrogates(gold, edges, d.select("doc_id", "text"), answers).where("unit % 3 <> 0")


@query("routed_names", f"""SELECT name, CASE name WHEN '산림보호법 시행령' THEN 'law' WHEN '하천관리 지침' THEN 'rule' ELSE 'none' END AS route, CASE name WHEN '산림보호법 시행령' THEN '산림 보호법 시행령' WHEN '하천관리 지침' THEN '하천 관리지침' END AS match FROM (SELECT DISTINCT {sql_pick(_NAMES, 'p_partkey')} AS name FROM part)""")
def routed_names(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "part").select(pick(_NAMES, F.col("p_partkey")).alias("name")).distinct()
    laws, rules = spark.createDataFrame([("산림 보호법 시행령",), ("민법",)], "name string"), spark.createDataFrame([("하천 관리지침",), ("산림 보호법 시행령",)], "name string")
    return catalogue.routes(names, laws, rules).select("name", "route", "match")


@query("round_trips", """
SELECT 'json_lines' AS way, n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT 'tab_separated', n_nationkey, n_name FROM nation UNION ALL SELECT 'json_document', n_nationkey, n_name FROM nation UNION ALL SELECT 'records', n_nationkey, n_name FROM nation UNION ALL SELECT 'missing', 0, '0'
""")
def round_trips(spark: SparkSession, sf: str) -> DataFrame:
    """A table written and read back by each reader and writer, in the folder that all machines share."""
    n, root = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name")), f"{shared_dir(spark)}/round-{uuid4().hex}"
    writers.json_lines(n, f"{root}/lines")
    writers.delimited(n, f"{root}/tabs", "\t")
    writers.json_document(n, f"{root}/document")
    back = {"json_lines": readers.json_lines(spark, f"{root}/lines", "k long, name string"), "tab_separated": readers.tab_separated(spark, f"{root}/tabs", "k long, name string"), "json_document": readers.json_document(spark, f"{root}/document", "k long, name string")}
    records = readers.records(spark, f"{root}/document")
    back["records"] = records.select(F.from_json("record", "k long, name string").alias("r")).select("r.*")
    none = readers.json_lines(spark, f"{root}/nothing", "k long, name string", optional=True).agg(F.count("*").alias("k")).select("k", F.col("k").cast("string").alias("name"))
    out = none.select(F.lit("missing").alias("way"), "k", "name")
    for way, df in back.items():
        out = out.unionByName(df.select(F.lit(way).alias("way"), "k", "name"))
    return out


@query("streamed_responses", """
SELECT event_type AS condition, 'm' AS model, count(DISTINCT event_id) AS n, count(*) FILTER (WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) = 0) AS n_error, CASE WHEN count(*) FILTER (WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) = 0) > 0 THEN 'failed' WHEN count(DISTINCT event_id) >= 100 THEN 'done' ELSE 'pending' END AS state FROM events GROUP BY event_type
""")
def streamed_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Events as response files, ingested as a stream in two runs: the second finds nothing new."""
    root = f"{shared_dir(spark)}/stream-{uuid4().hex}"
    k = F.from_json("props", "k int")["k"]
    rows = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("qid"), F.col("event_type").alias("condition"), F.lit("m").alias("model"), F.when(k == 0, "x").alias("error"), F.lit("a").alias("raw_answer"))
    rows.write.json(f"{root}/in")
    for _ in range(2):
        ingest.ingest_responses(spark, f"{root}/in", f"{root}/out", f"{root}/checkpoint", "qid string, condition string, model string, error string, raw_answer string")
    return ingest.progress(spark, f"{root}/out", 100)

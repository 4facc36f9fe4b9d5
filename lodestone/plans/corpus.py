"""Corpus-level queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import citations, corpus, parsing, sampling
from lodestone.plans.tables import table
from lodestone.registry import query
from lodestone.sources import catalogue


@query("corpus_manifest", """
WITH d AS (SELECT source, min(lang) AS tier, count(*) AS n_units, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY source)
SELECT 'doc' AS level, source AS name, CAST(1 AS BIGINT) AS n_docs, n_units, n_chars FROM d
UNION ALL SELECT CASE WHEN grouping(tier) = 1 THEN 'total' ELSE 'tier' END, coalesce(tier, ''), count(*), CAST(sum(n_units) AS BIGINT), CAST(sum(n_chars) AS BIGINT) FROM d GROUP BY ROLLUP(tier)
""")
def corpus_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.manifest(table(spark, sf, "documents"), "source", "lang", F.col("n_chars"))


@query("corpus_shares", """
SELECT lang, count(*) AS n_docs, count(DISTINCT source) AS n_sources, CAST(sum(n_chars) AS BIGINT) AS n_chars,
       round(100 * sum(n_chars) / (SELECT sum(n_chars) FROM documents), 4) AS share
FROM documents GROUP BY lang
""")
def corpus_shares(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n_docs"), F.countDistinct("source").alias("n_sources"), F.sum("n_chars").alias("n_chars"))
    return corpus.with_share(g, "n_chars")


@query("keep_first_text", """
SELECT doc_id, lang, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS i FROM documents) WHERE i = 1
""")
def keep_first_text(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.md5("text").alias("k"), "doc_id", "lang", "source", "n_chars")
    return corpus.keep_first(d, ["k"], ["doc_id"]).drop("k")


@query("union_tagged", """
SELECT s_name AS name, s_acctbal AS balance, NULL AS segment, 'supplier' AS _source FROM supplier
UNION ALL SELECT c_name, c_acctbal, c_mktsegment, 'customer' FROM customer
UNION ALL SELECT p_name, NULL, NULL, 'part' FROM part
""")
def union_tagged(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    c = table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    p = table(spark, sf, "part").select(F.col("p_name").alias("name"))
    return corpus.union_tagged({"supplier": s, "customer": c, "part": p}).select("name", "balance", "segment", "_source")


@query("unique_unit_keys", """
SELECT p_partkey, CASE WHEN i > 1 THEN k || '~' || CAST(i AS VARCHAR) ELSE k END AS unit_key, CAST(i - 1 AS INTEGER) AS n_collisions
FROM (SELECT p_partkey, p_brand || ':' || p_type AS k, row_number() OVER (PARTITION BY p_brand || ':' || p_type ORDER BY p_partkey) AS i FROM part)
""")
def unique_unit_keys(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", F.concat_ws(":", "p_brand", "p_type").alias("k"))
    return corpus.unique_keys(p, "k", ["p_partkey"]).select("p_partkey", "unit_key", "n_collisions")


@query("number_gaps", """
WITH g AS (SELECT p_brand, min(p_size) AS lo, max(p_size) AS hi FROM part GROUP BY p_brand),
m AS (SELECT p_brand, lo, hi, unnest(range(lo, hi + 1)) AS n FROM g)
SELECT m.p_brand, m.lo, m.hi, string_agg(CAST(m.n AS VARCHAR), ',' ORDER BY m.n) AS missing
FROM m WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_brand = m.p_brand AND p.p_size = m.n) GROUP BY ALL
""")
def number_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.number_gaps(table(spark, sf, "part"), "p_brand", "p_size").withColumn("missing", F.array_join(F.col("missing").cast("array<string>"), ","))


@query("carry_forward_turns", """
SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS asked_at FROM conversations
""")
def carry_forward_turns(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return corpus.carry_forward(c, "conv_id", ["turn"], F.when(F.col("role") == "user", F.col("turn")), "asked_at")


@query("zipped_arrays", """
WITH a AS (SELECT doc_id, string_split(text, ' ') AS words, string_split(lang || '-' || source, '-') AS tags FROM documents),
p AS (SELECT doc_id, words, tags, unnest(range(greatest(len(words), len(tags)))) AS pos FROM a)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, words[pos + 1] AS words, tags[pos + 1] AS tags FROM p
""")
def zipped_arrays(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.split("text", " ").alias("words"), F.split(F.concat_ws("-", "lang", "source"), "-").alias("tags"))
    return parsing.zipped(d, "doc_id", "words", "tags")


@query("text_forms", r"""
SELECT doc_id, length(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS collapsed, length(regexp_replace(regexp_replace(text, '<[^>]*>', ' ', 'g'), '\s+', '', 'g')) AS comparable,
       md5(regexp_replace(text, '[ㆍ·・()]|\s', '', 'g')) AS name_key, len(list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}_]+'), lambda w: w <> '')) AS n_words,
       md5(concat_ws(chr(1), source, lang, text)) AS mark
FROM documents
""")
def text_forms(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.length(X.collapse(t)).alias("collapsed"), F.length(X.comparable(t)).alias("comparable"), F.md5(X.name_key(t)).alias("name_key"), F.size(X.word_list(t)).alias("n_words"), F.md5(F.concat_ws("\x01", "source", "lang", "text")).alias("mark"))


@query("short_numeric_texts", r"""
SELECT doc_id, n_chars FROM documents WHERE n_chars BETWEEN 60 AND 500 AND regexp_matches(text, '\d') AND lang IS NOT NULL
""")
def short_numeric_texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(F.col("n_chars").between(60, 500) & F.col("lang").isNotNull() & F.col("text").rlike(r"\d")).select("doc_id", "n_chars")


@query("name_tiers", """
SELECT name, tier FROM (VALUES ('국방전력발전업무훈령', 'T4_행정규칙'), ('방위사업법 시행규칙', 'T3_부령'), ('방위사업법 시행령', 'T2_대통령령'), ('방위사업법', 'T1_법률'), ('계약에 관한 법률', 'T1_법률'), ('원가계산 기준', 'T4_행정규칙'), ('업무편람', 'UNK')) v(name, tier)
""")
def name_tiers(spark: SparkSession, sf: str) -> DataFrame:
    names = ["국방전력발전업무훈령", "방위사업법 시행규칙", "방위사업법 시행령", "방위사업법", "계약에 관한 법률", "원가계산 기준", "업무편람"]
    return spark.createDataFrame([(n,) for n in names], "name string").select("name", X.tier_of(F.col("name")).alias("tier"))


@query("spelling_representatives", """
WITH c AS (SELECT p_name || CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE '' END || p_type AS name FROM part), n AS (SELECT name, count(*) AS c FROM c GROUP BY name),
k AS (SELECT name, c, regexp_replace(name, '\\s', '', 'g') AS key FROM n),
b AS (SELECT key, name AS canonical, row_number() OVER (PARTITION BY key ORDER BY c DESC, length(name) - length(replace(name, ' ', '')) DESC, name) AS i FROM k)
SELECT k.name, b.canonical, k.c AS count FROM k JOIN b ON b.key = k.key AND b.i = 1
""".replace("\\\\", "\\"))
def spelling_representatives(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, " ").otherwise(""), "p_type")
    return corpus.representatives(table(spark, sf, "part").select(name.alias("name")), "name")


_RULES = [(1, 1, "small", "abolished"), (2, 1, "red", "out_of_scope"), (2, 2, "blue", "out_of_scope"), (3, 1, "ring", "in_scope_to_collect"), (3, 2, "bolt", "in_scope_to_collect")]


@query("scope_totals", """
WITH d AS (SELECT p_name, CASE WHEN p_name LIKE '%small%' THEN 'abolished' WHEN p_name LIKE '%red%' OR p_name LIKE '%blue%' THEN 'out_of_scope' WHEN p_name LIKE '%ring%' OR p_name LIKE '%bolt%' THEN 'in_scope_to_collect' ELSE 'undecided' END AS scope FROM part)
SELECT scope, count(DISTINCT p_name) AS n_names, count(*) AS n_citations FROM d GROUP BY scope
""")
def scope_totals(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "part").groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("citations"))
    rules = spark.createDataFrame(_RULES, "step int, rule_order int, family string, scope string")
    none = spark.createDataFrame([], "name string, step int")
    scopes = citations.decide_scope(names.withColumn("canonical", F.col("name")), rules, none)
    return scopes.join(names, "name").groupBy("scope").agg(F.count("*").alias("n_names"), F.sum("citations").alias("n_citations"))


@query("link_graph", r"""
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS target FROM pages)
SELECT target, count(*) AS in_degree, count(DISTINCT page_id) AS n_pages FROM l WHERE target LIKE '/%' GROUP BY target
""")
def link_graph(spark: SparkSession, sf: str) -> DataFrame:
    links = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("target"))
    return links.where(F.col("target").startswith("/")).groupBy("target").agg(F.count("*").alias("in_degree"), F.countDistinct("page_id").alias("n_pages"))


@query("citation_match", r"""
WITH l AS (SELECT page_id, regexp_replace(unnest(regexp_extract_all(html, '<a href="/([^"]*)"', 1)), '[()\s]', '', 'g') AS k FROM pages),
w AS (SELECT min(doc_id) AS doc_id, regexp_replace(string_split(text, ' ')[1], '[()\s「」『』\[\]<>ㆍ·・]', '', 'g') AS k FROM documents GROUP BY 2)
SELECT w.doc_id AS cited_doc, count(*) AS in_degree FROM l JOIN w ON l.k = w.k WHERE w.k <> '' GROUP BY 1
""")
def citation_match(spark: SparkSession, sf: str) -> DataFrame:
    links = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="/([^"]*)"'), F.lit(1))).alias("target_name"))
    docs = table(spark, sf, "documents").select("doc_id", F.element_at(F.split("text", " "), 1).alias("doc_name")).where(X.name_key_strict(F.col("doc_name")) != "")
    return citations.in_degree(citations.match_names(links, docs))


@query("top_names", """
SELECT p_name, count(*) AS count FROM part GROUP BY p_name ORDER BY count DESC, p_name LIMIT 15
""")
def top_names(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.top_counts(table(spark, sf, "part"), "p_name", 15)


@query("balanced_sources", """
SELECT source, count(DISTINCT lang) AS n FROM documents GROUP BY source HAVING count(DISTINCT lang) = (SELECT count(DISTINCT lang) FROM documents)
""")
def balanced_sources(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.complete_groups(table(spark, sf, "documents"), "source", "lang")


@query("pending_runs", """
SELECT n.n_name, s.seg AS c_mktsegment FROM nation n, (SELECT DISTINCT c_mktsegment AS seg FROM customer) s
WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = n.n_nationkey AND c.c_mktsegment = s.seg AND c.c_acctbal > 9000)
""")
def pending_runs(spark: SparkSession, sf: str) -> DataFrame:
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    done = c.where("c_acctbal > 9000").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "c_mktsegment")
    return corpus.pending(done, ["n_name", "c_mktsegment"], [n.select("n_name"), c.select("c_mktsegment").distinct()])


@query("capped_sample", """
WITH r AS (SELECT doc_id, source, md5('20260721|' || CAST(doc_id AS VARCHAR)) AS h FROM documents), c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h) AS i FROM r)
SELECT doc_id, source FROM c WHERE i <= 3 ORDER BY h LIMIT 40
""")
def capped_sample(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "source", sampling.hash_rank("doc_id").alias("h"))
    return sampling.capped(d, "source", "h", 3, 40).select("doc_id", "source")


@query("rising_cap_sample", """
WITH r AS (SELECT doc_id, source, md5('20260721|' || CAST(doc_id AS VARCHAR)) AS h FROM documents), c AS (SELECT *, greatest(row_number() OVER (PARTITION BY source ORDER BY h), 2) AS cap FROM r)
SELECT doc_id, source FROM c ORDER BY cap, h LIMIT 60
""")
def rising_cap_sample(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "source", sampling.hash_rank("doc_id").alias("h"))
    return sampling.rising_cap(d, "source", "h", 2, 60).select("doc_id", "source")


@query("stratified_sample", """
WITH r AS (SELECT doc_id, lang, md5('20260721|' || CAST(doc_id AS VARCHAR)) AS h FROM documents), c AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY h) AS i FROM r)
SELECT doc_id, lang FROM c WHERE i <= CASE lang WHEN 'en' THEN 8 WHEN 'de' THEN 4 WHEN 'fr' THEN 5 WHEN 'es' THEN 3 ELSE 0 END
""")
def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "lang", sampling.hash_rank("doc_id").alias("h"))
    return sampling.stratified(d, "lang", "h", {"en": 8, "de": 4, "fr": 5, "es": 3}).select("doc_id", "lang")


@query("balanced_tier_sample", """
WITH r AS (SELECT doc_id, lang, lang IN ('de', 'fr') AS up, md5('20260721|' || CAST(doc_id AS VARCHAR)) AS h FROM documents), c AS (SELECT *, up AND row_number() OVER (PARTITION BY up ORDER BY h) <= 10 AS first FROM r)
SELECT doc_id, lang FROM c ORDER BY first DESC, h LIMIT 20
""")
def balanced_tier_sample(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "lang", sampling.hash_rank("doc_id").alias("h"))
    return sampling.balanced_tiers(d, "lang", "h", ["de", "fr"], 10, 20).select("doc_id", "lang")


@query("json_props", """
SELECT event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2
""")
def json_props(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_type", F.from_json("props", "k int")["k"].alias("k"), "value")
    return e.groupBy("event_type", "k").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("upper_median", """
SELECT lang, list_sort(list(n_chars))[CAST(floor(count(*) / 2) AS INTEGER) + 1] AS upper_median, max(n_chars) AS longest FROM documents GROUP BY lang
""")
def upper_median(spark: SparkSession, sf: str) -> DataFrame:
    """The middle value, the upper of two: by counts per value and running sums, so no group is gathered."""
    from pyspark.sql import Window

    c = table(spark, sf, "documents").groupBy("lang", "n_chars").count()
    w = Window.partitionBy("lang").orderBy("n_chars").rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumn("upto", F.sum("count").over(w)).withColumn("n", F.sum("count").over(Window.partitionBy("lang")))
    return c.groupBy("lang").agg(F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col("n_chars"))).alias("upper_median"), F.max("n_chars").alias("longest"))


@query("fetch_queue", """
WITH q AS (SELECT o_orderkey, o_custkey, 1 AS i, 'urgent' AS _query FROM orders WHERE o_orderpriority LIKE '1%' UNION ALL SELECT o_orderkey, o_custkey, 2, 'open' FROM orders WHERE o_orderstatus = 'O'), f AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY i) AS r FROM q)
SELECT o_orderkey, o_custkey, _query FROM f WHERE r = 1 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
""")
def fetch_queue(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    pick = lambda c: o.where(c).select("o_orderkey", "o_custkey")
    wanted = catalogue.tagged_queries({"urgent": pick(F.col("o_orderpriority").startswith("1")), "open": pick(F.col("o_orderstatus") == "O")}, "o_orderkey")
    fetched = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return catalogue.not_fetched(wanted, fetched, "o_orderkey")


@query("all_versions", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P')
""")
def all_versions(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumn("name", F.concat("o_orderpriority", "o_orderstatus"))
    names = spark.createDataFrame([("1-URGENTP",)], "name string")
    return catalogue.all_versions(o, names, "name", "o_custkey").select("o_orderkey", "o_custkey")

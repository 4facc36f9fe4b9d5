"""Coverage and volume queries: sources are the units that are taken away, benchmark items the questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import coverage as C
from lodestone.operators import stats
from lodestone.plans.tables import table
from lodestone.registry import query
from lodestone.session import stored

_WORDS = r"""
bg AS (SELECT item_id, list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}_]+'), lambda w: w <> '') AS w FROM benchmark),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM bg)),
dg AS (SELECT doc_id, source, list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}_]+'), lambda w: w <> '') AS w FROM documents),
ds AS (SELECT DISTINCT doc_id, source, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, source, w, unnest(range(1, len(w) - 3)) AS i FROM dg)),
gold AS (SELECT item_id, doc_id, source, count(*) AS n_shared FROM ds JOIN bs USING (g) GROUP BY ALL)
"""
_REQ = _WORDS + """, req AS (SELECT DISTINCT item_id AS qid, source AS unit FROM gold),
deg AS (SELECT source AS unit, count(*) AS d FROM gold GROUP BY source),
ord AS (SELECT 'core' AS strategy, unit, row_number() OVER (ORDER BY d DESC, md5(unit), unit) AS rank FROM deg UNION ALL SELECT 'periph', unit, row_number() OVER (ORDER BY d, md5(unit), unit) FROM deg UNION ALL SELECT 'random', unit, row_number() OVER (ORDER BY md5(unit), unit) FROM deg),
lv AS (SELECT unnest([100, 85, 70, 55, 40, 25, 10, 0]) AS level),
fb AS (SELECT strategy, qid, min(rank) AS fb FROM req JOIN ord USING (unit) GROUP BY ALL),
cnt AS (SELECT strategy, fb, sum(count(*)) OVER (PARTITION BY strategy ORDER BY fb) AS upto FROM fb GROUP BY strategy, fb),
nq AS (SELECT count(DISTINCT qid) AS n FROM req),
stop AS (SELECT s.strategy, lv.level, coalesce(min(c.fb) FILTER (WHERE n - round_even(n * lv.level / 100, 0) > 0 AND c.upto >= n - round_even(n * lv.level / 100, 0)), 0) AS stop_rank FROM (SELECT DISTINCT strategy FROM ord) s, lv, nq LEFT JOIN cnt c ON c.strategy = s.strategy GROUP BY ALL),
rem AS (SELECT s.strategy, s.level, o.unit FROM stop s JOIN ord o ON o.strategy = s.strategy AND o.rank <= s.stop_rank),
st AS (SELECT s.strategy, s.level, r.qid, count(*) AS n, count(m.unit) AS g FROM (SELECT strategy, level FROM stop) s, req r LEFT JOIN rem m ON m.strategy = s.strategy AND m.level = s.level AND m.unit = r.unit GROUP BY ALL),
ch AS (SELECT source AS unit, sum(n_chars) AS chars FROM documents GROUP BY source),
kept AS (SELECT s.strategy, s.level, (SELECT sum(chars) FROM ch) - coalesce(sum(ch.chars), 0) AS kept FROM (SELECT strategy, level FROM stop) s LEFT JOIN rem m ON m.strategy = s.strategy AND m.level = s.level LEFT JOIN ch ON ch.unit = m.unit GROUP BY ALL)
"""


def gold(spark: SparkSession, sf: str) -> DataFrame:
    """(item_id, doc_id, source, n_shared): documents that share five words in a row with a benchmark item."""
    docs = table(spark, sf, "documents")
    return C.shared_shingles(table(spark, sf, "benchmark"), docs, keep=["source"]).select("item_id", "doc_id", "source", "n_shared")


@query("shared_passages", f"WITH {_WORDS} SELECT item_id, doc_id, source, n_shared FROM gold")
def shared_passages(spark: SparkSession, sf: str) -> DataFrame:
    return gold(spark, sf)


def _conditions(spark: SparkSession, sf: str, found: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(required units, orders, stops) of three strategies; each a written table that later steps read."""
    found = gold(spark, sf) if found is None else found
    pairs = stored(found.groupBy("item_id", "source").agg(F.count("*").alias("n_docs")), "gold")
    required = pairs.select(F.col("item_id").alias("qid"), F.col("source").alias("unit"))
    units = pairs.groupBy(F.col("source").alias("unit")).agg(F.sum("n_docs").alias("in_degree")).withColumn("shuffle_rank", F.md5("unit")).withColumn("tier", F.lit(""))
    order = stored(C.removal_order(units, "core", "periph", "random"), "order")
    return required, order, stored(C.coverage_levels(required, order), "stops")


@query("coverage_curve", f"WITH {_REQ} SELECT st.strategy, st.level, count(*) FILTER (WHERE g = 0) AS \"full\", count(*) FILTER (WHERE g > 0 AND g < n) AS partial, count(*) FILTER (WHERE g = n) AS none, round(100.0 * count(*) FILTER (WHERE g = 0) / count(*), 4) AS actual_cov, round(min(kept) / (SELECT sum(chars) FROM ch), 6) AS char_ratio FROM st JOIN kept USING (strategy, level) GROUP BY ALL")
def coverage_curve(spark: SparkSession, sf: str) -> DataFrame:
    required, order, stops = _conditions(spark, sf)
    chars = stored(table(spark, sf, "documents").groupBy(F.col("source").alias("unit")).agg(F.sum("n_chars").alias("chars")), "chars")
    total = chars.agg(F.sum("chars")).first()[0]
    lost = C.removed_units(order, stops).join(chars, "unit").groupBy("strategy", "level").agg(F.sum("chars").alias("lost"))
    kept = stops.join(lost, ["strategy", "level"], "left").select("strategy", "level", (F.lit(total) - F.coalesce("lost", F.lit(0))).alias("kept_chars"))
    return C.summarise(C.question_status(required, order, stops), kept, total)


@query("condition_status", f"WITH {_REQ} SELECT strategy, level, qid, CASE WHEN g = 0 THEN 'full' WHEN g = n THEN 'none' ELSE 'partial' END AS status FROM st")
def condition_status(spark: SparkSession, sf: str) -> DataFrame:
    return C.question_status(*_conditions(spark, sf))


@query("run_plan", f"WITH {_REQ}, cond AS (SELECT strategy || '_' || lpad(CAST(level AS VARCHAR), 3, '0') AS condition, strategy, level FROM stop), f AS (SELECT condition, md5(coalesce(string_agg(m.unit, chr(10) ORDER BY m.unit), '')) AS fingerprint FROM cond LEFT JOIN rem m USING (strategy, level) GROUP BY condition) SELECT condition, fingerprint, min(condition) OVER (PARTITION BY fingerprint) AS canonical FROM f")
def run_plan(spark: SparkSession, sf: str) -> DataFrame:
    _, order, stops = _conditions(spark, sf)
    name = F.format_string("%s_%03d", "strategy", "level").alias("condition")
    return C.fingerprints(C.removed_units(order, stops).select(name, "unit"), stops.select(name))


@query("nesting_faults", f"WITH {_REQ}, nx AS (SELECT strategy, level, lead(level) OVER (PARTITION BY strategy ORDER BY level DESC) AS lower FROM stop), f AS (SELECT r.strategy, r.level, r.unit FROM rem r JOIN nx USING (strategy, level) WHERE nx.lower IS NOT NULL AND NOT EXISTS (SELECT 1 FROM rem q WHERE q.strategy = r.strategy AND q.level = nx.lower AND q.unit = r.unit)) SELECT 'core' AS strategy, (SELECT count(*) FROM f WHERE strategy = 'core') AS faults UNION ALL SELECT 'periph', (SELECT count(*) FROM f WHERE strategy = 'periph') UNION ALL SELECT 'random', (SELECT count(*) FROM f WHERE strategy = 'random')")
def nesting_faults(spark: SparkSession, sf: str) -> DataFrame:
    _, order, stops = _conditions(spark, sf)
    faults = C.nesting_faults(C.removed_units(order, stops)).groupBy("strategy").agg(F.count("*").alias("n"))
    return stops.select("strategy").distinct().join(faults, "strategy", "left").select("strategy", F.coalesce("n", F.lit(0)).cast("long").alias("faults"))


@query("regeneration_checks", f"""WITH {_REQ}, tw AS (SELECT g.item_id AS qid FROM gold g JOIN documents a ON a.doc_id = g.doc_id JOIN documents b ON b.text = a.text AND b.doc_id <> a.doc_id GROUP BY 1),
mk AS (SELECT strategy, level, md5(string_agg(DISTINCT unit, chr(10) ORDER BY unit)) AS mark FROM rem GROUP BY ALL), al AS (SELECT level, mark FROM mk GROUP BY ALL HAVING count(*) > 1)
SELECT 'matched' AS "check", count(DISTINCT qid) AS n, count(DISTINCT qid) > 0 AS ok FROM req UNION ALL SELECT 'strategies_alike', count(*), count(*) = 0 FROM al UNION ALL SELECT 'not_nested', 0, true
UNION ALL SELECT 'required_lost_by_volume', 0, true UNION ALL SELECT 'without_surrogate', count(DISTINCT qid), true FROM req WHERE qid NOT IN (SELECT qid FROM tw)""")
def regeneration_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Surrogates are documents of the same text as a gold one; the volume pool has no source that a question needs."""
    found = stored(gold(spark, sf), "shared")
    required, order, stops = _conditions(spark, sf, found)
    docs = table(spark, sf, "documents").select("doc_id", "source", F.md5("text").alias("h"), "n_chars")
    own = found.select(F.col("item_id").alias("qid"), "doc_id").join(docs.select("doc_id", "h"), "doc_id").withColumnRenamed("doc_id", "own")
    twins = own.join(docs.select("doc_id", "h"), "h").where("own <> doc_id").select("qid", F.col("doc_id").alias("unit"))
    pool = docs.groupBy(F.col("source").alias("unit")).agg(F.sum("n_chars").alias("chars")).join(required.select("unit").distinct(), "unit", "left_anti")
    pool = pool.withColumn("rank", F.xxhash64("unit") % 1000)
    volume = C.volume_removed(pool, float(docs.agg(F.sum("n_chars")).first()[0]))
    return C.regeneration_checks(required, C.removed_units(order, stops), volume, twins)


@query("volume_curve", f"""WITH {_WORDS}, gd AS (SELECT DISTINCT doc_id FROM gold),
tot AS (SELECT sum(n_chars) AS t FROM documents),
pool AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS rank FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM gd)),
b AS (SELECT doc_id, n_chars, coalesce(sum(n_chars) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pool),
lv AS (SELECT unnest([100, 85, 70, 55, 40, 30]) AS level)
SELECT level, count(doc_id) AS removed_docs, round((t - coalesce(sum(n_chars), 0)) / t, 6) AS char_ratio, round(100 * (SELECT sum(n_chars) FROM documents WHERE doc_id IN (SELECT doc_id FROM gd)) / t, 4) AS floor_pct
FROM tot, lv LEFT JOIN b ON 100 * (1 - before / (SELECT t FROM tot)) > level GROUP BY level, t""")
def volume_curve(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    keep = stored(gold(spark, sf).select("doc_id").distinct(), "keep")
    pool = docs.join(keep, "doc_id", "left_anti").select(F.col("doc_id").cast("string").alias("unit"), F.col("n_chars").alias("chars"), F.lit(0).alias("in_degree"), F.lit("").alias("tier"), F.md5(F.col("doc_id").cast("string")).alias("shuffle_rank"))
    pool = stored(pool.join(C.removal_order(pool, "random"), "unit").select("unit", "rank", "chars"), "pool")
    total = docs.agg(F.sum("n_chars")).first()[0]
    floor = docs.join(keep, "doc_id", "left_semi").agg(F.sum("n_chars")).first()[0] or 0
    gone = C.volume_removed(pool, total).join(pool, "unit").groupBy("level").agg(F.count("*").alias("removed_docs"), F.sum("chars").alias("lost"))
    levels = spark.createDataFrame([(x,) for x in C.VOLUME_LEVELS], "level int")
    return levels.join(gone, "level", "left").select("level", F.coalesce("removed_docs", F.lit(0)).alias("removed_docs"), F.round((F.lit(total) - F.coalesce("lost", F.lit(0))) / total, 6).alias("char_ratio"), F.lit(round(100 * floor / total, 4)).alias("floor_pct"))


@query("content_status", f"WITH {_WORDS}, alive AS (SELECT doc_id FROM documents WHERE source NOT IN ('src0', 'src1', 'src2', 'src3', 'src4', 'src5', 'src6', 'src7')), cp AS (SELECT g.item_id, d2.doc_id FROM gold g JOIN documents d1 ON d1.doc_id = g.doc_id JOIN documents d2 ON d2.text = d1.text AND d2.doc_id <> d1.doc_id), q AS (SELECT g.item_id, count(*) AS n, count(a.doc_id) AS k FROM gold g LEFT JOIN alive a ON a.doc_id = g.doc_id GROUP BY 1), s AS (SELECT item_id, count(*) AS c FROM cp JOIN alive USING (doc_id) GROUP BY 1) SELECT q.item_id AS qid, CASE WHEN k = n THEN 'full' WHEN k > 0 THEN 'partial' WHEN coalesce(c, 0) > 0 THEN 'surrogate' ELSE 'none' END AS status FROM q LEFT JOIN s USING (item_id)")
def content_status(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", F.md5("text").alias("h"))
    g = gold(spark, sf)
    required = g.select(F.col("item_id").alias("qid"), F.col("doc_id").alias("unit"))
    alive = docs.where(~F.col("source").isin(*(f"src{i}" for i in range(8)))).select(F.col("doc_id").alias("unit"))
    marks = docs.select(F.col("doc_id").alias("unit"), "h")
    twins = required.join(marks, "unit").withColumnRenamed("unit", "own").join(marks, "h").where("own <> unit").select("qid", "unit")
    return C.content_status(required, alive, twins)


@query("wilson_by_source", """
WITH g AS (SELECT d.source, CAST(sum(l.quality) AS BIGINT) AS k, count(*) AS n FROM documents d JOIN labels l USING (doc_id) GROUP BY 1)
SELECT source, k, n,
 round(100 * greatest(((k / n + 1.959963984540054 * 1.959963984540054 / (2 * n)) - 1.959963984540054 * sqrt(k / n * (1 - k / n) / n + 1.959963984540054 * 1.959963984540054 / (4 * n * n))) / (1 + 1.959963984540054 * 1.959963984540054 / n), 0), 6) AS ci_lo,
 round(100 * least(((k / n + 1.959963984540054 * 1.959963984540054 / (2 * n)) + 1.959963984540054 * sqrt(k / n * (1 - k / n) / n + 1.959963984540054 * 1.959963984540054 / (4 * n * n))) / (1 + 1.959963984540054 * 1.959963984540054 / n), 1), 6) AS ci_hi
FROM g
""")
def wilson_by_source(spark: SparkSession, sf: str) -> DataFrame:
    facts = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id")
    return stats.pooled(facts, "source", "quality")

"""Grading and statistics queries. Answers are built from documents by one rule, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import grading as G
from lodestone.operators import stats
from lodestone.operators import slots as S
from lodestone.plans.tables import table
from lodestone.registry import query
from lodestone.session import stored

#: What responses state as their confidence, by turns: the four words, an echoed template, something else.
_CONF = ["높음", "중간", "낮음", "모름", "<높음|중간>", "아마"]
#: How a response is written, by turns: A the answer, B its basis, C the confidence.
_SHAPES = ["<think>생각</think>답: A\n근거: B\n확신도: C", "답: A\n근거: B\n확신도: C", "<think>끝나지 않은 생각\n답: A\n근거: B\n확신도: C", "A", "답: A\n확신도: C", "답：A\n근거：B\n확신도：C", "근거: B\n답: A\n확신도: C"]

_TOKENS = r"list_distinct(list_filter(regexp_split_to_array({0}, '[^\p{{L}}\p{{N}}_]+'), lambda w: length(w) >= 2))"
_GRADED = rf"""
rs AS (SELECT doc_id AS qid, source AS model, lang AS condition, CASE WHEN doc_id % 17 = 0 THEN 'closedbook' ELSE 'rag' END AS arm, coalesce(doc_id % 19 = 0, false) AS failed, doc_id % 23 = 0 AS blank, doc_id % 7 AS shape,
 CASE WHEN doc_id % 13 = 0 THEN '근거가 없어 확인할 수 없음' ELSE coalesce(text, '') || ' ' || CAST(doc_id % 5 AS VARCHAR) END AS ans, ['높음', '중간', '낮음', '모름', '<높음|중간>', '아마'][CAST(doc_id % 6 AS INTEGER) + 1] AS said,
 CASE WHEN doc_id % 10 = 0 THEN 'oos' WHEN doc_id % 11 <= 3 THEN 'full' ELSE 'none' END AS own_status, doc_id % 10 <> 0 AS answerable,
 CASE doc_id % 4 WHEN 0 THEN coalesce(text, '') || ' ' || CAST(doc_id % 3 AS VARCHAR) WHEN 1 THEN translate(coalesce(text, ''), 'aeiou', 'uoiea') WHEN 2 THEN '' ELSE coalesce(text, '') END AS gold
 FROM documents WHERE doc_id % 29 <> 0),
pa AS (SELECT * EXCLUDE (said), CASE WHEN blank THEN '' ELSE regexp_replace(ans, '^\s+|\s+$', '', 'g') END AS a, CASE WHEN blank OR shape IN (3, 4) THEN '' ELSE '제' || CAST(qid % 7 + 1 AS VARCHAR) || '조' END AS basis,
 CASE WHEN blank OR shape = 3 THEN 'missing' WHEN said LIKE '<%' THEN 'template_echo' WHEN said = '아마' THEN 'unparsed' ELSE 'ok' END AS conf_parse, CASE WHEN blank OR shape = 3 OR said LIKE '<%' OR said = '아마' THEN '' ELSE said END AS conf,
 CASE WHEN qid % 3 = 0 THEN ['surrogate', 'none', 'partial', 'full'][CAST(qid % 4 AS INTEGER) + 1] ELSE own_status END AS q_status FROM rs),
kw AS (SELECT *, {_TOKENS.format('gold')} AS gtok, {_TOKENS.format('a')} AS atok, list_distinct(regexp_extract_all(gold, '[0-9]+')) AS ng, list_distinct(regexp_extract_all(a, '[0-9]+')) AS na,
 a LIKE '%확인할 수 없%' OR conf = '모름' AS abst FROM pa),
vd AS (SELECT *, CASE WHEN gold = '' OR len(gtok) = 0 THEN 'ambiguous' WHEN len(ng) > 0 THEN CASE WHEN len(list_intersect(ng, na)) = 0 THEN 'no' WHEN len(list_intersect(gtok, atok)) / len(gtok) >= 0.3 THEN 'yes' ELSE 'ambiguous' END WHEN len(list_intersect(gtok, atok)) / len(gtok) >= 0.7 THEN 'yes' ELSE 'ambiguous' END AS rule FROM kw),
ju AS (SELECT *, CASE WHEN rule <> 'ambiguous' THEN rule ELSE ['yes', 'partial', 'no', 'review', 'review'][CAST(qid % 5 AS INTEGER) + 1] END AS verdict FROM vd),
gr AS (SELECT qid, model, condition, arm, q_status, conf AS confidence, conf_parse, CASE WHEN NOT failed THEN abst END AS abstained, answerable,
 CASE WHEN failed THEN 'none' WHEN NOT answerable THEN 'oos_rule' WHEN abst THEN 'abstain_rule' WHEN rule <> 'ambiguous' THEN 'keyword' WHEN verdict <> 'review' THEN 'judge' ELSE 'pending' END AS acc_method,
 CASE WHEN failed THEN 'error' WHEN abst THEN 'honest_abstain' WHEN NOT answerable OR verdict = 'no' THEN CASE WHEN conf IN ('높음', '중간') THEN 'overconfident' ELSE 'hedged_wrong' END WHEN verdict = 'yes' THEN 'correct' WHEN verdict = 'partial' THEN 'partial' ELSE 'review' END AS state,
 CASE WHEN failed THEN NULL WHEN NOT answerable THEN abst WHEN abst THEN q_status NOT IN ('full', 'partial', 'surrogate') WHEN verdict IN ('yes', 'partial') THEN true WHEN verdict = 'no' THEN false END AS correct,
 CASE WHEN NOT failed AND answerable AND NOT abst THEN basis = '제' || CAST(qid % 5 + 1 AS VARCHAR) || '조' END AS cited_ok FROM ju),
me(condition, cov_pct, char_pct) AS (VALUES ('en', 100.0, 80.0), ('de', 70.0, 55.5), ('fr', 40.0, 30.0)),
fa AS (SELECT gr.*, cov_pct, char_pct, state = 'honest_abstain' AS abstain, state = 'overconfident' AS overconf, state NOT IN ('review', 'error') AS judged, state NOT IN ('review', 'error', 'honest_abstain') AS answered, q_status = 'oos' AS oos FROM gr LEFT JOIN me ON me.condition = gr.condition),
rag AS (SELECT * FROM fa WHERE arm = 'rag' AND cov_pct IS NOT NULL)
"""


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """A response to each document as its own question, in every shape that models answer in, some failed or blank."""
    i, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    answer = F.when(i % 13 == 0, "근거가 없어 확인할 수 없음").otherwise(F.concat(text, F.lit(" "), (i % 5).cast("string")))
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (i % n + 1).cast("int"))
    basis = F.concat(F.lit("제"), (i % 7 + 1).cast("string"), F.lit("조"))
    raw = F.replace(F.replace(F.replace(pick(_SHAPES, 7), F.lit("C"), pick(_CONF, 6)), F.lit("B"), basis), F.lit("A"), answer)
    status = F.when(i % 10 == 0, "oos").when(i % 11 <= 3, "full").otherwise("none")
    arm = F.when(i % 17 == 0, "closedbook").otherwise("rag")
    return table(spark, sf, "documents").select(i.alias("qid"), F.col("source").alias("model"), F.col("lang").alias("condition"), arm.alias("arm"), F.when(i % 23 == 0, " \n").otherwise(raw).alias("raw_answer"), F.when(i % 19 == 0, "timeout").alias("error"), status.alias("q_status"))


def slots(spark: SparkSession, sf: str) -> DataFrame:
    i, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    gold = F.when(i % 4 == 0, F.concat(text, F.lit(" "), (i % 3).cast("string"))).when(i % 4 == 1, F.translate(text, "aeiou", "uoiea")).when(i % 4 == 2, "").otherwise(text)
    return table(spark, sf, "documents").where(i % 29 != 0).select(i.alias("qid"), (i % 10 != 0).alias("answerable"), gold.alias("gold_short"), F.concat(F.lit("q"), i.cast("string")).alias("question"), F.array((i % 5 + 1).cast("string")).alias("gold_articles"), F.lit(1).alias("level"))


def graded(spark: SparkSession, sf: str) -> DataFrame:
    """Responses graded with content statuses for a third of them and a judge's verdicts on three of five ambiguous answers."""
    i = F.col("doc_id")
    content = table(spark, sf, "documents").where(i % 3 == 0).select(F.col("lang").alias("condition"), i.alias("qid"), F.element_at(F.array(*map(F.lit, ("surrogate", "none", "partial", "full"))), (i % 4 + 1).cast("int")).alias("status"))
    n = F.substring("question", 2, 30).cast("long") % 5
    judge = lambda asked: asked.where(n < 3).select("key", F.when(n == 0, "yes").when(n == 1, "partial").otherwise("no").alias("verdict"))
    return G.graded_once(responses(spark, sf), slots(spark, sf), content, judge)


def analysed(spark: SparkSession, sf: str) -> DataFrame:
    meta = spark.createDataFrame([("en", 100.0, 80.0), ("de", 70.0, 55.5), ("fr", 40.0, 30.0)], "condition string, cov_pct double, char_pct double")
    return G.outcomes(G.with_condition_meta(graded(spark, sf), meta))


@query("graded_answers", f"WITH {_GRADED} SELECT qid, state, correct, abstained, cited_ok, confidence, conf_parse, acc_method, q_status FROM gr")
def graded_answers(spark: SparkSession, sf: str) -> DataFrame:
    return graded(spark, sf).select("qid", "state", "correct", "abstained", "cited_ok", "confidence", "conf_parse", "acc_method", "q_status")


@query("pending_verdicts", f"WITH {_GRADED} SELECT qid, rule FROM vd WHERE NOT failed AND answerable AND NOT abst AND rule = 'ambiguous' AND qid % 5 <> 0")
def pending_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Ambiguous answers that a cache of verdicts, which has every fifth question, does not decide."""
    rows = G.with_slots(responses(spark, sf), slots(spark, sf), spark.createDataFrame([], "condition string, qid long, status string"))
    qid = F.substring("question", 2, 30).cast("long")
    cache = G.ambiguous_keys(rows).where(qid % 5 == 0).select("key", F.lit("yes").alias("verdict"))
    return G.pending_verdicts(rows, cache).select(qid.alias("qid"), F.lit("ambiguous").alias("rule"))


_ANSWERED = "('correct', 'partial', 'overconfident', 'hedged_wrong')"


@query("grade_cells", f"WITH {_GRADED}, c AS (SELECT condition, model, count(*) AS n, " + ", ".join(f"count(*) FILTER (WHERE state = '{x}') AS {x}" for x in ("correct", "honest_abstain", "overconfident", "hedged_wrong", "partial", "review", "error")) + " FROM gr GROUP BY condition, model) SELECT *, round((correct + 0.5 * partial) / nullif(n - review - error, 0), 6) AS accuracy, round(overconfident / n, 6) AS overconf_rate FROM c")
def grade_cells(spark: SparkSession, sf: str) -> DataFrame:
    return G.cells(graded(spark, sf), "condition", "model")


@query("calibration", f"WITH {_GRADED}, c AS (SELECT condition, model, confidence IN ('높음', '중간') AS high, correct FROM gr WHERE state IN {_ANSWERED} AND correct IS NOT NULL AND confidence <> ''), g AS (SELECT condition, model, count(*) FILTER (WHERE high) AS n_high, count(*) FILTER (WHERE high AND correct) AS k_high, count(*) FILTER (WHERE NOT high) AS n_low, count(*) FILTER (WHERE NOT high AND correct) AS k_low FROM c GROUP BY condition, model) SELECT *, round(k_high / nullif(n_high, 0), 6) AS acc_high, round(k_low / nullif(n_low, 0), 6) AS acc_low, round(round(k_high / nullif(n_high, 0), 6) - round(k_low / nullif(n_low, 0), 6), 6) AS gap FROM g")
def calibration(spark: SparkSession, sf: str) -> DataFrame:
    return G.calibration(graded(spark, sf), "condition", "model")


@query("confidence_distribution", f"WITH {_GRADED} SELECT model, CASE WHEN confidence = '' THEN '[' || conf_parse || ']' ELSE confidence END AS confidence, count(*) AS n FROM gr GROUP BY 1, 2")
def confidence_distribution(spark: SparkSession, sf: str) -> DataFrame:
    said = F.when(F.col("confidence") == "", F.concat(F.lit("["), F.col("conf_parse"), F.lit("]"))).otherwise(F.col("confidence"))
    return graded(spark, sf).groupBy("model", said.alias("confidence")).agg(F.count("*").alias("n"))


@query("citation_rates", f"WITH {_GRADED} SELECT model, condition, count(*) FILTER (WHERE cited_ok) AS k, count(*) AS n FROM gr WHERE cited_ok IS NOT NULL GROUP BY model, condition")
def citation_rates(spark: SparkSession, sf: str) -> DataFrame:
    return graded(spark, sf).where("cited_ok is not null").groupBy("model", "condition").agg(F.count(F.when(F.col("cited_ok"), 1)).alias("k"), F.count("*").alias("n"))


@query("cell_statistics", f"WITH {_GRADED} SELECT model, condition, count(*) AS n, count(*) FILTER (WHERE abstain) AS k_abstain, count(*) FILTER (WHERE judged AND overconf) AS k_overconf, count(*) FILTER (WHERE judged) AS n_judged, count(*) FILTER (WHERE answered AND correct) AS k_correct_answered, count(*) FILTER (WHERE answered AND correct IS NOT NULL) AS n_correct_answered, count(*) FILTER (WHERE judged AND correct) AS k_correct_all, count(*) FILTER (WHERE cited_ok) AS k_cited, count(*) FILTER (WHERE cited_ok IS NOT NULL) AS n_cited, count(*) FILTER (WHERE oos AND abstain) AS k_oos_abstain, count(*) FILTER (WHERE oos) AS n_oos FROM rag GROUP BY model, condition")
def cell_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return G.cell_statistics(G.analysis_sample(analysed(spark, sf)), "model", "condition")


@query("balanced_sample", f"WITH {_GRADED}, k AS (SELECT condition FROM rag WHERE regexp_matches(model, '(^|[^0-9a-z])src[12]$') GROUP BY condition HAVING count(DISTINCT model) = (SELECT count(DISTINCT model) FROM rag WHERE regexp_matches(model, '(^|[^0-9a-z])src[12]$'))) SELECT qid, model, condition, judged, answered, oos FROM rag WHERE regexp_matches(model, '(^|[^0-9a-z])src[12]$') AND condition IN (SELECT condition FROM k) AND condition IN ('en', 'fr')")
def balanced_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of two models, under listed conditions that both have."""
    rows = analysed(spark, sf)
    rows = rows.where(F.col("model").rlike("src[12]$"))
    return G.analysis_sample(rows, models=["src1", "src2"], conditions=["en", "fr"], balanced=True).select("qid", "model", "condition", "judged", "answered", "oos")


@query("regression_samples", f"""WITH {_GRADED}, o AS (SELECT 'cite_ok' AS outcome, qid, cited_ok AS y FROM rag WHERE cited_ok IS NOT NULL UNION ALL SELECT 'correct_answered', qid, correct FROM rag WHERE answered AND correct IS NOT NULL UNION ALL SELECT 'overconf_answered', qid, overconf FROM rag WHERE answered UNION ALL SELECT 'abstain', qid, abstain FROM rag
 UNION ALL SELECT 'correct_all', qid, correct FROM rag WHERE judged AND correct IS NOT NULL UNION ALL SELECT 'overconf_all', qid, overconf FROM rag WHERE judged UNION ALL SELECT 'oos_abstain', qid, abstain FROM rag WHERE oos),
v(outcome) AS (VALUES ('cite_ok'), ('correct_answered'), ('overconf_answered'), ('abstain'), ('correct_all'), ('overconf_all'), ('oos_abstain')),
s AS (SELECT v.outcome, count(o.outcome) AS n, count(*) FILTER (WHERE y) AS events, count(DISTINCT qid) AS n_clusters FROM v LEFT JOIN o ON o.outcome = v.outcome GROUP BY v.outcome) SELECT *, n >= 50 AND events >= 10 AND n - events >= 10 AND (outcome <> 'oos_abstain' OR n_clusters >= 5) AS fits FROM s""")
def regression_samples(spark: SparkSession, sf: str) -> DataFrame:
    return stats.regression_samples(G.analysis_sample(analysed(spark, sf)))


@query("regressions")
def regressions(spark: SparkSession, sf: str) -> DataFrame:
    """All outcomes on coverage, characters and two models. Newton steps are beyond SQL; tests hold them against numpy on gathered rows."""
    facts = G.analysis_sample(analysed(spark, sf)).withColumn("model", F.when(F.col("qid") % 2 == 0, "a").otherwise("b"))
    facts = facts.select("qid", "model", "cov_pct", "char_pct", "cited_ok", "answered", "judged", "correct", "overconf", "abstain", "oos")
    rows = stats.regressions(stored(facts, "facts"))
    return spark.createDataFrame([tuple(r.values()) for r in rows], "outcome string, term string, coef double, se double, z double, p double, odds_ratio double, ci_lo double, ci_hi double")


_LF = "lgamma({0} + 1)"


@query("closed_book_contrast", f"""WITH {_GRADED}, g AS (SELECT model, count(*) FILTER (WHERE arm = 'closedbook' AND confidence = '높음') AS k_closed, count(*) FILTER (WHERE arm = 'closedbook') AS n_closed, count(*) FILTER (WHERE arm = 'rag' AND condition = 'en' AND confidence = '높음') AS k_rag, count(*) FILTER (WHERE arm = 'rag' AND condition = 'en') AS n_rag FROM fa GROUP BY model HAVING count(*) FILTER (WHERE arm = 'closedbook') > 0 AND count(*) FILTER (WHERE arm = 'rag' AND condition = 'en') > 0),
x AS (SELECT *, n_closed + n_rag AS t, k_closed + k_rag AS c1, unnest(range(greatest(0, k_closed + k_rag - n_rag), least(n_closed, k_closed + k_rag) + 1)) AS i FROM g),
l AS (SELECT *, lgamma(n_closed + 1) + lgamma(n_rag + 1) + lgamma(c1 + 1) + lgamma(t - c1 + 1) - lgamma(t + 1) AS f FROM x),
q AS (SELECT *, f - lgamma(i + 1) - lgamma(n_closed - i + 1) - lgamma(c1 - i + 1) - lgamma(n_rag - c1 + i + 1) AS lp, f - lgamma(k_closed + 1) - lgamma(n_closed - k_closed + 1) - lgamma(k_rag + 1) - lgamma(n_rag - k_rag + 1) AS seen FROM l)
SELECT model, k_closed, n_closed, k_rag, n_rag, round(least(1, sum(CASE WHEN lp <= seen + 1e-7 THEN exp(lp) ELSE 0 END)), 9) AS p FROM q GROUP BY ALL""")
def closed_book_contrast(spark: SparkSession, sf: str) -> DataFrame:
    return G.closed_book(analysed(spark, sf), "en")


@query("judge_majority", """
WITH v AS (SELECT conv_id AS key, CASE WHEN length(text) % 4 = 0 THEN 'yes' WHEN length(text) % 4 = 1 THEN 'no' WHEN length(text) % 4 = 2 THEN 'partial' ELSE '?' END AS vote FROM conversations),
c AS (SELECT key, vote, count(*) AS n FROM v WHERE vote <> '?' GROUP BY ALL), b AS (SELECT key, vote, n, row_number() OVER (PARTITION BY key ORDER BY n DESC, vote DESC) AS i FROM c)
SELECT k.key, CASE WHEN b.n > k.n / 2 THEN b.vote ELSE 'review' END AS verdict FROM (SELECT key, count(*) AS n FROM v GROUP BY key) k LEFT JOIN b ON b.key = k.key AND i = 1
""")
def judge_majority(spark: SparkSession, sf: str) -> DataFrame:
    n = F.length("text") % 4
    vote = F.when(n == 0, "yes").when(n == 1, "no").when(n == 2, "partial").otherwise("?")
    return G.majority(table(spark, sf, "conversations").select(F.col("conv_id").alias("key"), vote.alias("vote")))


_FACTS = "f AS (SELECT d.doc_id, d.source, d.lang, d.n_chars, l.quality, l.toxic, d.doc_id % 50 AS unit FROM documents d JOIN labels l USING (doc_id))"


def facts(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars", (F.col("doc_id") % 50).alias("unit"))
    return d.join(table(spark, sf, "labels"), "doc_id")


@query("mcnemar_pairs", f"""WITH {_FACTS}, u AS (SELECT unit, max(CASE WHEN lang = 'en' THEN quality END) AS x, max(CASE WHEN lang = 'de' THEN quality END) AS z FROM f WHERE lang IN ('en', 'de') GROUP BY unit),
c AS (SELECT count(*) AS n, count(*) FILTER (WHERE x = 1 AND z = 1) AS "both", count(*) FILTER (WHERE x = 1 AND z = 0) AS b, count(*) FILTER (WHERE x = 0 AND z = 1) AS c, count(*) FILTER (WHERE x = 0 AND z = 0) AS neither FROM u WHERE x IS NOT NULL AND z IS NOT NULL)
SELECT n, "both", b, c, neither, round(CASE WHEN b + c = 0 THEN 1 ELSE least(1, 2 * (SELECT sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))) FROM unnest(range(0, least(b, c) + 1)) t(i))) END, 9) AS p FROM c""")
def mcnemar_pairs(spark: SparkSession, sf: str) -> DataFrame:
    d = stats.discordant(facts(spark, sf), "lang", "unit", "quality", "en", "de")
    return d.withColumn("p", F.round(stats.mcnemar(F.col("b"), F.col("c")), 9))


@query("fisher_by_source", f"""WITH {_FACTS}, g AS (SELECT source, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS a, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS b, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS c, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS d FROM f GROUP BY source),
x AS (SELECT *, unnest(range(greatest(0, (a + c) - (c + d)), least(a + b, a + c) + 1)) AS i FROM g),
p AS (SELECT *, lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) AS k FROM x),
l AS (SELECT source, a, b, c, d, k - lgamma(i + 1) - lgamma(a + b - i + 1) - lgamma(a + c - i + 1) - lgamma(d - a + i + 1) AS lp, k - lgamma(a + 1) - lgamma(b + 1) - lgamma(c + 1) - lgamma(d + 1) AS seen FROM p)
SELECT source, a, b, c, d, round(least(1, sum(CASE WHEN lp <= seen + 1e-7 THEN exp(lp) ELSE 0 END)), 9) AS p FROM l GROUP BY source, a, b, c, d""")
def fisher_by_source(spark: SparkSession, sf: str) -> DataFrame:
    n = lambda q, t, name: F.count(F.when((F.col("quality") == q) & (F.col("toxic") == t), 1)).alias(name)
    g = facts(spark, sf).groupBy("source").agg(n(1, 1, "a"), n(1, 0, "b"), n(0, 1, "c"), n(0, 0, "d"))
    return g.withColumn("p", F.round(stats.fisher(*map(F.col, "abcd")), 9))


@query("pooled_rates", f"WITH {_FACTS} SELECT lang, CAST(sum(quality) AS BIGINT) AS k, count(*) AS n, round(avg(n_chars), 6) AS n_chars FROM f GROUP BY lang")
def pooled_rates(spark: SparkSession, sf: str) -> DataFrame:
    return stats.pooled(facts(spark, sf), "lang", "quality", "n_chars").select("lang", "k", "n", F.round("n_chars", 6).alias("n_chars"))


@query("logit_quality")
def logit_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Quality on length and toxicity, errors clustered by source."""
    f = facts(spark, sf).select((F.log1p("n_chars")).alias("log_chars"), "toxic", "quality", "source")
    rows = stats.logit_cluster(f, "quality", ["log_chars", "toxic"], "source")
    return spark.createDataFrame([tuple(r.values()) for r in rows], "term string, coef double, se double, z double, p double, odds_ratio double, ci_lo double, ci_hi double")


_EVENTS = "e AS (SELECT event_type AS key, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(value * 100 AS BIGINT) AS tokens FROM events)"


def _run_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Events as responses: some failed, some blank, some with the older failure text."""
    k = F.from_json("props", "k int")["k"]
    raw = F.when(k == 1, " \n").when(k == 2, F.concat(F.lit(G.LEGACY_FAILURE), F.lit(": timeout]"))).otherwise("답: a")
    return table(spark, sf, "events").select(F.col("event_type").alias("key"), F.when(k == 0, "failed").alias("error"), F.when(k != 0, raw).alias("raw_answer"), F.round(F.col("value") * 100).cast("long").alias("prompt_eval_count"), F.lit(16384).alias("num_ctx"), k.alias("k"))


@query("run_summary", f"WITH {_EVENTS} SELECT key, count(*) AS n, count(*) FILTER (WHERE k > 1) AS n_ok, count(*) FILTER (WHERE k = 0) AS n_error, count(*) FILTER (WHERE tokens >= 16384 - 1024 - 16) AS n_trunc, max(tokens) AS max_prompt_tokens FROM e GROUP BY key")
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    return G.run_summary(G.truncation_suspects(_run_rows(spark, sf), 1024), "key")


@query("finished_runs", f"WITH {_EVENTS}, r AS (SELECT key || CASE WHEN k > 2 THEN '' ELSE '_failing' END AS run, k FROM e) SELECT run, count(*) >= 500 AND count(*) FILTER (WHERE k IN (0, 1, 2)) = 0 AS done FROM r GROUP BY run")
def finished_runs(spark: SparkSession, sf: str) -> DataFrame:
    rows = _run_rows(spark, sf).withColumn("run", F.concat("key", F.when(F.col("k") > 2, "").otherwise("_failing")))
    return G.finished(rows, "run", 500)


@query("merged_slots", """
WITH s AS (SELECT conv_id AS qid, turn AS file_order, CASE WHEN role = 'assistant' THEN '' ELSE text END AS question FROM conversations)
SELECT qid, file_order, md5(question) AS q, n_files FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN trim(question) <> '' THEN 0 ELSE 1 END, file_order) AS i, count(*) OVER (PARTITION BY qid) AS n_files FROM s) WHERE i = 1
""")
def merged_slots(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "conversations").select(F.col("conv_id").alias("qid"), F.col("turn").alias("file_order"), F.when(F.col("role") == "assistant", "").otherwise(F.col("text")).alias("question"))
    return S.merge_slots(s).select("qid", "file_order", F.md5("question").alias("q"), "n_files")


@query("recovered_slots", """
WITH r AS (SELECT l_orderkey AS qid, l_partkey AS chunk, CASE WHEN l_returnflag = 'A' THEN 'oos' WHEN l_returnflag = 'R' THEN 'full' ELSE 'none' END AS s FROM lineitem)
SELECT qid, string_agg(DISTINCT CAST(chunk AS VARCHAR), ',' ORDER BY CAST(chunk AS VARCHAR)) AS gold_chunks, string_agg(DISTINCT s, ',' ORDER BY s) AS statuses, NOT bool_or(s = 'oos') AS answerable FROM r GROUP BY qid
""")
def recovered_slots(spark: SparkSession, sf: str) -> DataFrame:
    f = F.col("l_returnflag")
    r = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("qid"), F.array(F.col("l_partkey").cast("string")).alias("gold_chunks"), F.when(f == "A", "oos").when(f == "R", "full").otherwise("none").alias("q_status"))
    return S.recover_slots(r).select("qid", F.array_join("gold_chunks", ",").alias("gold_chunks"), F.array_join("statuses", ",").alias("statuses"), "answerable")


@query("replicated_conditions", """
WITH r AS (SELECT doc_id, lang FROM documents), p(c, k) AS (VALUES ('es', 'en'), ('fr', 'de'), ('en', 'en'), ('de', 'de'))
SELECT lang AS condition, NULL AS aliased_from, count(*) AS n FROM r GROUP BY lang UNION ALL SELECT p.c, r.lang, count(*) FROM r JOIN p ON p.k = r.lang AND p.c <> p.k GROUP BY 1, 2
""")
def replicated_conditions(spark: SparkSession, sf: str) -> DataFrame:
    plan = spark.createDataFrame([("es", "en"), ("fr", "de"), ("en", "en"), ("de", "de")], "condition string, canonical string")
    r = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("condition"))
    return G.replicate(r, plan).groupBy("condition", "aliased_from").agg(F.count("*").alias("n"))


@query("answer_terms", r"""
SELECT doc_id, len(list_distinct(list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}_]+'), lambda w: length(w) >= 2))) AS n_terms, len(list_distinct(regexp_extract_all(text, '[0-9]+'))) AS n_numbers FROM documents
""")
def answer_terms(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.size(X.key_terms(F.col("text"))).alias("n_terms"), F.size(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\d+"), F.lit(0)))).alias("n_numbers"))


@query("overconfidence_split", f"WITH {_GRADED} SELECT model, condition, count(*) FILTER (WHERE NOT oos) AS n_in_scope, count(*) FILTER (WHERE NOT oos AND overconf) AS k_in_scope, count(*) FILTER (WHERE oos) AS n_out, count(*) FILTER (WHERE oos AND overconf) AS k_out FROM rag WHERE judged GROUP BY model, condition")
def overconfidence_split(spark: SparkSession, sf: str) -> DataFrame:
    return G.overconfidence_split(G.analysis_sample(analysed(spark, sf)), "model", "condition")


@query("paired_contrasts", f"""WITH {_FACTS}, m AS (SELECT lang, unit, 'quality' AS metric, quality AS v FROM f UNION ALL SELECT lang, unit, 'toxic', toxic FROM f), q(x1, x2) AS (VALUES ('en', 'de'), ('en', 'fr'), ('de', 'fr')),
u AS (SELECT x1, x2, metric, unit, max(CASE WHEN lang = x1 THEN v END) AS x, max(CASE WHEN lang = x2 THEN v END) AS z FROM m, q GROUP BY ALL),
c AS (SELECT x1 AS first, x2 AS second, metric, count(*) AS n, count(*) FILTER (WHERE x = 1 AND z = 1) AS "both", count(*) FILTER (WHERE x = 1 AND z = 0) AS b, count(*) FILTER (WHERE x = 0 AND z = 1) AS c, count(*) FILTER (WHERE x = 0 AND z = 0) AS neither FROM u WHERE x IS NOT NULL AND z IS NOT NULL GROUP BY ALL)
SELECT first, second, metric, n, "both", b, c, neither, round(CASE WHEN b + c = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))))) END, 9) AS p FROM c WHERE n >= 10""")
def paired_contrasts(spark: SparkSession, sf: str) -> DataFrame:
    return stats.contrasts(facts(spark, sf), "lang", "unit", [("en", "de"), ("en", "fr"), ("de", "fr")], ["quality", "toxic"]).withColumn("p", F.round("p", 9))


@query("label_flips", """
WITH a AS (SELECT doc_id, CASE WHEN n_chars > 1000 THEN 'full' WHEN n_chars > 100 THEN 'partial' ELSE 'none' END AS s FROM documents), b AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'none' WHEN quality = 1 THEN 'full' ELSE 'partial' END AS s FROM labels)
SELECT a.s AS before, b.s AS after, count(*) AS n FROM a JOIN b USING (doc_id) GROUP BY 1, 2
""")
def label_flips(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_chars")
    a = table(spark, sf, "documents").select("doc_id", F.when(n > 1000, "full").when(n > 100, "partial").otherwise("none").alias("status"))
    b = table(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 1, "none").when(F.col("quality") == 1, "full").otherwise("partial").alias("status"))
    return G.label_flips(a, b, "doc_id")

"""Grading and analysis against cells counted by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import grading as G
from lodestone.operators import stats

SCHEMA = "qid int, model string, condition string, arm string, raw_answer string, error string, q_status string"


def said(answer, basis="제3조", confidence="높음"):
    return f"답: {answer}\n근거: {basis}\n확신도: {confidence}"


@pytest.fixture(scope="module")
def graded(spark):
    """Twelve responses of one cell: what becomes of each is noted beside it."""
    rows = [
        (1, said("alpha beta gamma")),  # keyword yes, confident: correct, cites the gold article
        (2, said("alpha beta gamma", "제4조", "낮음")),  # correct, hesitant, cites another
        (3, said("nothing alike", confidence="중간")),  # ambiguous, judged no, confident: overconfident
        (4, said("nothing alike either", confidence="모름")),  # "unknown" confidence: an abstention; evidence is there, so wrong
        (5, said("half of it", confidence="<높음|중간|낮음|모름>")),  # template echoed, judged partial: no confidence
        (6, said("근거가 없어 확인할 수 없음")),  # abstains, evidence gone: right
        (7, said("some answer")),  # not answerable, confident: overconfident
        (8, said("확인할 수 없음")),  # not answerable, abstains: right
        (9, said("undecided words", confidence="아마")),  # ambiguous and unjudged: review; confidence unparsed
        (10, None),  # failed
        (11, said("12 days")),  # numbers contradict: overconfident
        (12, said("12 days", confidence="낮음")),  # the same, hesitant: hedged_wrong
        (13, said("no slot")),  # its question is unknown: dropped
    ]
    status = {4: "full", 6: "none", 7: "oos", 8: "oos"}
    df = spark.createDataFrame([(q, "m-4b", "c1", "rag", raw, "boom" if raw is None else None, status.get(q, "none")) for q, raw in rows], SCHEMA)
    slots = [(q, q not in (7, 8), "30 days" if q in (11, 12) else "alpha beta gamma", f"q{q}", ["3"], 1) for q, _ in rows if q != 13]
    slots = spark.createDataFrame(slots, "qid int, answerable boolean, gold_short string, question string, gold_articles array<string>, level int")
    content = spark.createDataFrame([("c1", 4, "surrogate"), ("other", 6, "full")], "condition string, qid int, status string")
    judged = {3: "no", 5: "partial"}
    keys = G.ambiguous_keys(G.with_slots(df, slots, content))
    verdicts = keys.select("key", F.col("question")).collect()
    table = spark.createDataFrame([(r["key"], judged[int(r["question"][1:])]) for r in verdicts if int(r["question"][1:]) in judged], "key string, verdict string")
    assert sorted(r["question"] for r in G.pending_verdicts(G.with_slots(df, slots, content), table).collect()) == ["q9"]
    return G.grade(df, slots, content, table).persist()


def test_states(graded):
    got = {r["qid"]: (r["state"], r["correct"], r["acc_method"], r["cited_ok"]) for r in graded.collect()}
    assert got == {
        1: ("correct", True, "keyword", True), 2: ("correct", True, "keyword", False), 3: ("overconfident", False, "judge", True), 4: ("honest_abstain", False, "abstain_rule", None),
        5: ("partial", True, "judge", True), 6: ("honest_abstain", True, "abstain_rule", None), 7: ("overconfident", False, "oos_rule", None), 8: ("honest_abstain", True, "oos_rule", None),
        9: ("review", None, "pending", True), 10: ("error", None, "none", None), 11: ("overconfident", False, "keyword", True), 12: ("hedged_wrong", False, "keyword", True),
    }
    conf = {r["qid"]: (r["confidence"], r["conf_parse"]) for r in graded.collect()}
    assert conf[5] == ("", "template_echo") and conf[9] == ("", "unparsed") and conf[10] == ("", "missing") and conf[4] == ("모름", "ok")


def test_cells(graded):
    r = G.cells(graded, "model", "condition").first()
    assert (r["n"], r["correct"], r["honest_abstain"], r["overconfident"], r["hedged_wrong"], r["partial"], r["review"], r["error"]) == (12, 2, 3, 3, 1, 1, 1, 1)
    assert r["accuracy"] == 0.25  # (2 + 0.5) / 10: abstentions are in the denominator
    assert r["overconf_rate"] == 0.25  # 3 / 12


def test_calibration(graded):
    r = G.calibration(graded, "model").first()
    # high: 1 right; 3, 7, 11 wrong. low: 2 right, 12 wrong. 5 has no confidence, 4, 6, 8 abstain, 9 is undecided.
    assert (r["n_high"], r["k_high"], r["n_low"], r["k_low"], r["gap"]) == (4, 1, 2, 1, -0.25)


def test_cell_statistics(spark, graded):
    meta = spark.createDataFrame([("c1", 40.0, 50.0)], "condition string, cov_pct double, char_pct double")
    facts = G.outcomes(G.with_condition_meta(graded, meta))
    r = G.cell_statistics(G.analysis_sample(facts), "model", "condition").first().asDict()
    assert r == {"model": "m-4b", "condition": "c1", "n": 12, "k_abstain": 3, "k_overconf": 3, "n_judged": 10, "k_correct_answered": 3, "n_correct_answered": 7, "k_correct_all": 5, "k_cited": 6, "n_cited": 7, "k_oos_abstain": 1, "n_oos": 2}
    s = G.overconfidence_split(facts, "model").first()
    assert (s["n_in_scope"], s["k_in_scope"], s["n_out"], s["k_out"]) == (8, 2, 2, 1)
    assert G.analysis_sample(facts, models=["4b"]).count() == 12 and G.analysis_sample(facts.withColumn("model", F.lit("m-14b")), models=["4b"]).count() == 0
    samples = {x["outcome"]: (x["n"], x["events"], x["fits"]) for x in stats.regression_samples(facts).collect()}
    assert samples["cite_ok"] == (7, 6, False) and samples["oos_abstain"] == (2, 1, False) and samples["correct_all"] == (10, 5, False)


def test_finished_and_summary(spark):
    rows = [("a", None, "답: x"), ("a", None, "y"), ("b", None, "[생성 실패: x]"), ("b", None, "y"), ("c", None, " \n"), ("c", None, "y"), ("d", "e", None), ("d", None, "y"), ("e", None, "y")]
    df = spark.createDataFrame(rows, "run string, error string, raw_answer string")
    assert {r["run"] for r in G.finished(df, "run", 2).where("done").collect()} == {"a"}
    s = {r["run"]: (r["n"], r["n_ok"], r["n_error"]) for r in G.run_summary(df.withColumns({"trunc_suspect": F.lit(False), "prompt_eval_count": F.lit(1)}), "run").collect()}
    assert s == {"a": (2, 2, 0), "b": (2, 2, 0), "c": (2, 1, 0), "d": (2, 1, 1), "e": (1, 1, 0)}


def test_closed_book(spark):
    rows = [("m", "closedbook", "x", "높음", None)] * 8 + [("m", "closedbook", "x", "낮음", None)] * 2 + [("m", "rag", "full", "높음", 100.0)] * 3 + [("m", "rag", "full", "낮음", 100.0)] * 7 + [("n", "rag", "full", "높음", 100.0)] + [("m", "rag", "less", "높음", 10.0)]
    r = G.closed_book(spark.createDataFrame(rows, "model string, arm string, condition string, confidence string, cov_pct double"), "full").collect()
    assert len(r) == 1 and (r[0]["k_closed"], r[0]["n_closed"], r[0]["k_rag"], r[0]["n_rag"], round(r[0]["p"], 6)) == (8, 10, 3, 10, 0.069779)


def test_exact_tests_of_large_counts(spark):
    """Log factorials in closed form: right for small counts, finite and quick for large ones."""
    import math

    df = spark.createDataFrame([(n,) for n in (0, 1, 2, 7, 50, 1000, 10**6)], "n long")
    for r in df.select("n", stats._log_factorial(F.col("n")).alias("v")).collect():
        assert abs(r["v"] - math.lgamma(r["n"] + 1)) <= 1e-11 * max(1, math.lgamma(r["n"] + 1))
    big = spark.createDataFrame([(20_000, 20_400)], "b long, c long").select(stats.mcnemar(F.col("b"), F.col("c")).alias("p")).first()["p"]
    assert 0.045 < big < 0.05


def test_regressions_against_numpy(spark):
    rng = np.random.default_rng(0)
    rows = []
    for q in range(60):
        for cov, char in ((100.0, 100.0), (60.0, 80.0), (20.0, 30.0)):
            for m in ("a", "b"):
                y = bool(rng.random() < 1 / (1 + np.exp(-(-1 + 0.02 * cov - 0.4 * (m == "b")))))
                rows.append((q, m, cov, char, None, True, True, y, not y, bool(rng.random() < 0.2), q % 9 == 0))
    facts = spark.createDataFrame(rows, "qid int, model string, cov_pct double, char_pct double, cited_ok boolean, answered boolean, judged boolean, correct boolean, overconf boolean, abstain boolean, oos boolean")
    got = stats.regressions(facts)
    assert {r["outcome"] for r in got} == {"correct_answered", "overconf_answered", "abstain", "correct_all", "overconf_all"} and [r["term"] for r in got[:4]] == ["const", "cov10", "char10", "model=b"]
    x = np.array([[1, r[2] / 10, r[3] / 10, r[1] == "b"] for r in rows], float)
    y, g, beta = np.array([r[7] for r in rows], float), np.array([r[0] for r in rows]), np.zeros(4)
    for _ in range(40):
        p = 1 / (1 + np.exp(-x @ beta))
        beta += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-8 * np.eye(4), x.T @ (y - p))
    p = 1 / (1 + np.exp(-x @ beta))
    bread = np.linalg.inv((x * (p * (1 - p))[:, None]).T @ x)
    s = np.array([(x * (y - p)[:, None])[g == q].sum(0) for q in np.unique(g)])
    se = np.sqrt(np.diag(bread @ (s.T @ s) @ bread) * 60 / 59)
    assert np.allclose([r["coef"] for r in got[:4]], beta, atol=1e-6) and np.allclose([r["se"] for r in got[:4]], se, atol=1e-6)


def test_graded_queries_read_no_text_after_it_met_its_slot(spark, sf):
    """Grading in one pass is grading with a join of verdicts; its plan reads written figures, not texts."""
    from lodestone.plans import grading as P

    rows = G.with_slots(P.responses(spark, sf), P.slots(spark, sf), spark.createDataFrame([("en", 3, "none")], "condition string, qid long, status string"))
    n = F.substring("question", 2, 30).cast("long")
    judge = lambda asked: asked.where(n % 2 == 0).select("key", F.lit("no").alias("verdict"))
    got = G.graded_once(P.responses(spark, sf), P.slots(spark, sf), spark.createDataFrame([("en", 3, "none")], "condition string, qid long, status string"), judge)
    want = G.classify(rows, judge(G.ambiguous_keys(rows)))
    names = ["qid", "state", "correct", "abstained", "cited_ok", "confidence", "conf_parse", "acc_method", "q_status", "model", "condition", "arm", "answerable"]
    key = lambda df: sorted(map(str, df.select(*names).collect()))
    assert key(got) == key(want)
    assert "raw_answer" not in P.graded(spark, sf)._jdf.queryExecution().toString()

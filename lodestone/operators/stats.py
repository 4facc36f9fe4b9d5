"""Statistics: Wilson intervals, exact McNemar and Fisher tests, cluster-robust logistic regression."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def wilson(k: Column, n: Column, z: float = Z95) -> Column:
    """struct(lo, hi) of a proportion's interval, in percent; null at n = 0."""
    p, d = k / n, 1 + z * z / n
    mid = (p + z * z / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.when(n > 0, F.struct((100 * F.greatest(mid - half, F.lit(0.0))).alias("lo"), (100 * F.least(mid + half, F.lit(1.0))).alias("hi")))


def format_interval(k: Column, n: Column) -> Column:
    """'23.7% [16–33] (23/97)', ties rounded to even; '-' at n = 0."""
    w = wilson(k, n)
    return F.when(n > 0, F.format_string("%.1f%% [%.0f–%.0f] (%d/%d)", F.bround(100.0 * k / n, 1), F.bround(w["lo"], 0), F.bround(w["hi"], 0), k.cast("long"), n.cast("long"))).otherwise("-")


def _log_factorial(n: Column) -> Column:
    """log n! by Stirling's series at n + 8, taken down by the seven factors above n."""
    n = n.cast("double")
    x = n + 8
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7) + 1 / (1188 * x**9)
    above = n + 1
    for i in range(2, 8):
        above = above * (n + i)
    return series - F.log(above)


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided p of discordant counts: binomial(b + c, 1/2); 1 if there are none."""
    n, k = (b + c).cast("long"), F.least(b, c).cast("long")
    base = _log_factorial(n) - n * math.log(2)
    tail = F.aggregate(F.sequence(F.lit(0).cast("long"), k), F.lit(0.0), lambda s, i: s + F.exp(base - _log_factorial(i) - _log_factorial(n - i)))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def fisher(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-sided exact p of a 2 x 2 table: tables no likelier than the one seen (up to 1e-7, relative)."""
    a, b, c, d = (x.cast("long") for x in (a, b, c, d))
    r1, r2, c1, n = a + b, c + d, a + c, a + b + c + d
    fixed = _log_factorial(r1) + _log_factorial(r2) + _log_factorial(c1) + _log_factorial(n - c1) - _log_factorial(n)
    log_p = lambda x: fixed - _log_factorial(x) - _log_factorial(r1 - x) - _log_factorial(c1 - x) - _log_factorial(r2 - c1 + x)
    low, high = F.greatest(F.lit(0).cast("long"), c1 - r2), F.least(r1, c1)
    seen = log_p(a) + 1e-7
    return F.least(F.lit(1.0), F.aggregate(F.sequence(low, high), F.lit(0.0), lambda s, x: s + F.when(log_p(x) <= seen, F.exp(log_p(x))).otherwise(0.0)))


def discordant(facts: DataFrame, pair: str, unit: str, metric: str, first: str, second: str) -> DataFrame:
    """One row (n, both, b, c, neither) of units that have the metric under both values of ``pair``.

    An aggregate by unit, not a self-join: rows of a unit meet once.
    """
    v = lambda name: F.max(F.when(F.col(pair) == name, F.col(metric).cast("int")))
    rows = facts.where(F.col(pair).isin(first, second)).groupBy(unit).agg(v(first).alias("x"), v(second).alias("z")).where("x is not null and z is not null")
    n = lambda x, z, name: F.count(F.when((F.col("x") == x) & (F.col("z") == z), 1)).alias(name)
    return rows.agg(F.count("*").alias("n"), n(1, 1, "both"), n(1, 0, "b"), n(0, 1, "c"), n(0, 0, "neither"))


def pooled(facts: DataFrame, level: str, outcome: str, *covariates: str) -> DataFrame:
    """Per level: k, n over non-null outcomes, mean covariates, and the interval."""
    rows = facts.where(F.col(outcome).isNotNull())
    g = rows.groupBy(level).agg(F.sum(F.col(outcome).cast("long")).alias("k"), F.count("*").alias("n"), *(F.avg(c).alias(c) for c in covariates))
    w = wilson(F.col("k"), F.col("n"))
    return g.withColumn("ci_lo", F.round(w["lo"], 6)).withColumn("ci_hi", F.round(w["hi"], 6))


def logit_cluster(data: DataFrame, outcome: str, predictors: Sequence[str], cluster: str, rounds: int = 60, tol: float = 1e-9, ridge: float = 1e-8) -> list[dict]:
    """Logistic regression by Newton's method, with cluster-robust errors: one dict a term.

    Each round is one aggregate of X'WX and X'(y-p), k(k+1)/2 + k sums; the small system is solved on the
    driver.  The sandwich's middle is a sum over clusters of outer products of their score sums, again aggregates.
    """
    names = ["const", *predictors]
    k = len(names)
    rows = data.select(*(F.col(c).cast("double").alias(f"x{i + 1}") for i, c in enumerate(predictors)), F.col(outcome).cast("double").alias("y"), F.col(cluster).alias("g")).dropna().withColumn("x0", F.lit(1.0))
    rows = rows.persist()  # read in every round; k + 2 columns
    try:
        return _newton(rows, names, rounds, tol, ridge)
    finally:
        rows.unpersist()


def _newton(rows: DataFrame, names: list[str], rounds: int, tol: float, ridge: float) -> list[dict]:
    k = len(names)
    xs = [F.col(f"x{i}") for i in range(k)]
    beta = np.zeros(k)

    def fitted(b: np.ndarray) -> Column:
        eta = sum((x * float(v) for x, v in zip(xs, b, strict=True)), F.lit(0.0))
        return 1 / (1 + F.exp(-F.greatest(F.least(eta, F.lit(30.0)), F.lit(-30.0))))

    def hessian(p: Column) -> list[Column]:
        return [F.sum(xs[i] * xs[j] * p * (1 - p)).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]

    def matrix(r, prefix: str) -> np.ndarray:
        m = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                m[i, j] = m[j, i] = r[f"{prefix}{i}_{j}"] or 0.0
        return m

    for _ in range(rounds):
        p = fitted(beta)
        r = rows.agg(*hessian(p), *(F.sum(xs[i] * (F.col("y") - p)).alias(f"s{i}") for i in range(k))).first()
        step = np.linalg.solve(matrix(r, "h") + ridge * np.eye(k), np.array([r[f"s{i}"] or 0.0 for i in range(k)]))
        beta = beta + step
        if np.abs(step).max() < tol:
            break
    p = fitted(beta)
    bread = np.linalg.pinv(matrix(rows.agg(*hessian(p)).first(), "h"))
    scores = rows.groupBy("g").agg(*(F.sum(xs[i] * (F.col("y") - p)).alias(f"s{i}") for i in range(k)))
    r = scores.agg(F.count("*").alias("n"), *(F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k))).first()
    adjust = r["n"] / (r["n"] - 1) if r["n"] > 1 else 1.0
    se = np.sqrt(np.diag(bread @ matrix(r, "m") @ bread) * adjust)
    out = []
    for name, b, s in zip(names, beta.tolist(), se.tolist(), strict=True):
        z = b / s if s else math.nan
        out.append({"term": name, "coef": b, "se": s, "z": z, "p": math.erfc(abs(z) / math.sqrt(2)), "odds_ratio": math.exp(b), "ci_lo": math.exp(b - Z95 * s), "ci_hi": math.exp(b + Z95 * s)})
    return out


def contrasts(facts: DataFrame, pair: str, unit: str, pairs: Sequence[tuple[str, str]], metrics: Sequence[str], least: int = 10) -> DataFrame:
    """One row a (pair, metric): discordant counts and exact p, where at least ``least`` units are paired.

    One aggregate by unit and one over units, whatever the number of pairs and metrics.
    """
    levels = sorted({x for p in pairs for x in p})
    v = lambda level, metric: f"v{levels.index(level)}_{metrics.index(metric)}"
    units = facts.where(F.col(pair).isin(*levels)).groupBy(unit).agg(*(F.max(F.when(F.col(pair) == x, F.col(m).cast("int"))).alias(v(x, m)) for x in levels for m in metrics))

    def counts(first: str, second: str, metric: str) -> Column:
        x, z = F.col(v(first, metric)), F.col(v(second, metric))
        n = lambda c, name: F.count(F.when(c, 1)).alias(name)
        return F.struct(F.lit(first).alias("first"), F.lit(second).alias("second"), F.lit(metric).alias("metric"), n(x.isNotNull() & z.isNotNull(), "n"), n((x == 1) & (z == 1), "both"), n((x == 1) & (z == 0), "b"), n((x == 0) & (z == 1), "c"), n((x == 0) & (z == 0), "neither"))

    found = units.agg(F.array(*(counts(a, b, m) for a, b in pairs for m in metrics)).alias("all")).select(F.inline("all"))
    return found.where(F.col("n") >= least).withColumn("p", mcnemar(F.col("b"), F.col("c")))


#: Outcomes of the regressions: name, rows, 0/1 column.
OUTCOMES = (
    ("cite_ok", "cited_ok is not null", "cited_ok"),
    ("correct_answered", "answered and correct is not null", "correct"),
    ("overconf_answered", "answered", "overconf"),
    ("abstain", "true", "abstain"),
    ("correct_all", "judged and correct is not null", "correct"),
    ("overconf_all", "judged", "overconf"),
    ("oos_abstain", "oos", "abstain"),
)


def regression_samples(facts: DataFrame, least: int = 50, events: int = 10, oos_clusters: int = 5) -> DataFrame:
    """(outcome, n, events, n_clusters, fits): of each outcome's rows with known predictors, whether a regression can be fitted.

    It takes ``least`` rows, and ``events`` events and non-events; the one on unanswerable questions ``oos_clusters`` questions too.
    One pass: outcomes are conditions of one aggregate.
    """
    known = F.col("cov_pct").isNotNull() & F.col("char_pct").isNotNull()
    parts = []
    for name, rows, y in OUTCOMES:
        here = known & F.expr(rows)
        parts.append(F.struct(F.lit(name).alias("outcome"), F.count(F.when(here, 1)).alias("n"), F.count(F.when(here & F.col(y), 1)).alias("events"), F.countDistinct(F.when(here, F.col("qid"))).alias("n_clusters")))
    found = facts.agg(F.array(*parts).alias("all")).select(F.inline("all"))
    enough = (F.col("n") >= least) & (F.col("events") >= events) & (F.col("n") - F.col("events") >= events)
    return found.withColumn("fits", enough & ((F.col("outcome") != "oos_abstain") | (F.col("n_clusters") >= oos_clusters)))


def regressions(facts: DataFrame, **guards: int) -> list[dict]:
    """Terms of all regressions that can be fitted: coverage and characters per ten points, and a dummy for each model but the first, errors clustered by question."""
    fits = {r["outcome"] for r in regression_samples(facts, **guards).collect() if r["fits"]}
    out = []
    for name, rows, y in OUTCOMES:
        if name not in fits:
            continue
        data = facts.where(rows).where("cov_pct is not null and char_pct is not null")
        models = sorted(r[0] for r in data.select("model").distinct().collect())
        dummies = {f"model={m}": (F.col("model") == m).cast("int") for m in models[1:]}
        data = data.select("qid", F.col(y).cast("int").alias("y"), (F.col("cov_pct") / 10).alias("cov10"), (F.col("char_pct") / 10).alias("char10"), *(c.alias(f"d{i}") for i, c in enumerate(dummies.values())))
        terms = logit_cluster(data, "y", ["cov10", "char10", *(f"d{i}" for i in range(len(dummies)))], "qid")
        names = {f"d{i}": m for i, m in enumerate(dummies)}
        out += [{"outcome": name} | t | {"term": names.get(t["term"], t["term"])} for t in terms]
    return out


def fit_ready(data: DataFrame, outcome: str, least: int = 50, events: int = 10) -> bool:
    """Enough rows, events and non-events for a regression."""
    r = data.where(F.col(outcome).isNotNull()).agg(F.count("*").alias("n"), F.sum(F.col(outcome).cast("int")).alias("k")).first()
    return r["n"] >= least and min(r["k"] or 0, r["n"] - (r["k"] or 0)) >= events

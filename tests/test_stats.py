import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import stats as S


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_wilson(spark):
    w = value(spark, S.wilson(F.lit(63), F.lit(72)))
    assert (round(w["lo"], 4), round(w["hi"], 4)) == (77.9189, 93.2822)
    assert value(spark, S.wilson(F.lit(0), F.lit(0))) is None
    assert value(spark, S.format_interval(F.lit(23), F.lit(97))) == "23.7% [16–33] (23/97)"


@pytest.mark.parametrize(("b", "c", "p"), [(0, 11, 9.766e-4), (56, 5, 5.646e-12), (2, 10, 3.857e-2), (0, 0, 1.0), (4, 4, 1.0), (900, 700, 6.5e-7)])
def test_mcnemar(spark, b, c, p):
    got = value(spark, S.mcnemar(F.lit(b), F.lit(c)))
    n = b + c
    exact = min(1.0, 2 * sum(math.comb(n, i) for i in range(min(b, c) + 1)) / 2**n) if n else 1.0
    assert got == pytest.approx(exact, rel=1e-6) and got == pytest.approx(p, rel=0.1)


@pytest.mark.parametrize(("t", "p"), [((2, 95, 75, 22), 1.401e-30), ((2, 95, 96, 1), 6.354e-52), ((3, 3, 3, 3), 1.0)])
def test_fisher(spark, t, p):
    assert value(spark, S.fisher(*map(F.lit, t))) == pytest.approx(p, rel=1e-3)


def test_logit_matches_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 2))
    g = rng.integers(0, 25, 400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.3 + x @ [0.8, -0.5] + rng.normal(0, 0.5, 25)[g])))).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c), int(d)) for (a, b), c, d in zip(x, y, g)], "a double, b double, y int, g int")
    got = S.logit_cluster(df, "y", ["a", "b"], "g")
    m, beta = np.c_[np.ones(400), x], np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-m @ beta))
        beta += np.linalg.solve((m.T * (p * (1 - p))) @ m, m.T @ (y - p))
    bread = np.linalg.inv((m.T * (p * (1 - p))) @ m)
    u = np.array([(m[g == k] * (y - p)[g == k, None]).sum(0) for k in np.unique(g)])
    se = np.sqrt(np.diag(bread @ (u.T @ u) @ bread) * len(u) / (len(u) - 1))
    assert np.allclose([r["coef"] for r in got], beta, atol=1e-6) and np.allclose([r["se"] for r in got], se, atol=1e-6)
    assert got[1]["odds_ratio"] == pytest.approx(math.exp(got[1]["coef"]))


def test_discordant(spark):
    rng = random.Random(0)
    rows = [(c, u, rng.choice([0, 1, None])) for c in ("x", "z", "w") for u in range(50)]
    r = S.discordant(spark.createDataFrame(rows, "cond string, qid int, ok int"), "cond", "qid", "ok", "x", "z").first()
    at = {(c, u): v for c, u, v in rows}
    pairs = [(at["x", u], at["z", u]) for u in range(50) if None not in (at["x", u], at["z", u])]
    assert (r["n"], r["b"], r["c"]) == (len(pairs), pairs.count((1, 0)), pairs.count((0, 1)))

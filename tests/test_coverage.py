import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import coverage as C


def loop_coverage(required, order, level):
    """The removal loop, spelt out."""
    gone, target = set(), round(len(required) * level / 100)
    for u in order:
        if sum(not (r & gone) for r in required.values()) <= target:
            break
        gone.add(u)
    return gone


@pytest.mark.parametrize("seed", range(3))
def test_closed_forms(spark, seed):
    rng = random.Random(seed)
    units = [f"u{i}" for i in range(12)]
    required = {q: {rng.choice(units) for _ in range(rng.randrange(1, 4))} for q in range(17)}
    order = units[:]
    rng.shuffle(order)
    req = spark.createDataFrame([(q, u) for q, us in required.items() for u in us], "qid int, unit string")
    orders = {"own": order, "back": order[::-1]}
    ranks = spark.createDataFrame([(s, u, i + 1) for s, o in orders.items() for i, u in enumerate(o)], "strategy string, unit string, rank int")
    stops = C.coverage_levels(req, ranks)
    gone = {}
    for r in C.removed_units(ranks, stops).collect():
        gone.setdefault((r["strategy"], r["level"]), set()).add(r["unit"])
    for s, o in orders.items():
        for level in C.COVERAGE_LEVELS:
            assert gone.get((s, level), set()) == loop_coverage(required, o, level), (s, level)
    for r in C.question_status(req, ranks, stops).collect():
        lost = len(required[r["qid"]] & gone.get((r["strategy"], r["level"]), set()))
        assert r["status"] == ("full" if not lost else "none" if lost == len(required[r["qid"]]) else "partial")
    chars = {u: rng.randrange(1, 50) for u in units}
    total = sum(chars.values()) + 60
    pool = spark.createDataFrame([(u, i + 1, chars[u]) for i, u in enumerate(order)], "unit string, rank int, chars int")
    got = {}
    for r in C.volume_removed(pool, total).collect():
        got.setdefault(r["level"], set()).add(r["unit"])
    for level in C.VOLUME_LEVELS:
        gone, kept = set(), total
        for u in order:
            if kept / total * 100 <= level:
                break
            gone.add(u)
            kept -= chars[u]
        assert got.get(level, set()) == gone, level


def test_orders(spark):
    u = spark.createDataFrame([("a", 3, "T2", 2), ("b", 5, "T1", 1), ("c", 3, "T1", 0)], "unit string, in_degree int, tier string, shuffle_rank int")
    names = lambda s: [r["unit"] for r in C.removal_order(u, "core", "periph", "random", "tier_up").where(F.col("strategy") == s).orderBy("rank").collect()]
    assert names("core") == ["b", "c", "a"] and names("periph") == ["c", "a", "b"] and names("random") == ["c", "b", "a"] and names("tier_up") == ["c", "b", "a"]
    want = sorted("abcdef")
    random.Random(5).shuffle(want)
    assert [r["unit"] for r in C.shuffle_ranks(spark, list("fedcba"), 5).orderBy("shuffle_rank").collect()] == want


def test_status_and_plan(spark):
    req = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "a")], "qid int, unit string")
    order = spark.createDataFrame([("s", "a", 1), ("s", "c", 2), ("s", "b", 3)], "strategy string, unit string, rank int")
    stops = spark.createDataFrame([("s", 100, 0), ("s", 50, 1), ("s", 0, 2)], "strategy string, level int, stop_rank int")
    got = {(r["level"], r["qid"]): r["status"] for r in C.question_status(req, order, stops).collect()}
    assert got[100, 1] == "full" and got[50, 1] == "partial" and got[50, 3] == "none" and got[50, 2] == "full" and got[0, 2] == "none"
    gone = C.removed_units(order, stops)
    assert {tuple(r) for r in gone.collect()} == {("s", 50, "a"), ("s", 0, "a"), ("s", 0, "c")}
    broken = gone.where("not (level = 0 and unit = 'a')")
    assert C.nesting_faults(gone).count() == 0 and C.nesting_faults(broken).count() == 1
    checks = {r["check"]: (r["n"], r["ok"]) for r in C.regeneration_checks(req, broken.unionByName(broken.withColumn("strategy", F.lit("t"))), spark.createDataFrame([(30, "b"), (30, "x")], "level int, unit string"), spark.createDataFrame([(2, "z")], "qid int, unit string")).collect()}
    assert checks == {"matched": (3, True), "strategies_alike": (2, False), "not_nested": (2, False), "required_lost_by_volume": (1, False), "without_surrogate": (2, True)}
    named = gone.select(F.col("level").cast("string").alias("condition"), "unit").unionByName(spark.createDataFrame([("x", "a")], "condition string, unit string"))
    plan = {r["condition"]: r["canonical"] for r in C.fingerprints(named, spark.createDataFrame([("100",), ("50",), ("0",), ("x",)], "condition string")).collect()}
    assert plan == {"100": "100", "50": "50", "x": "50", "0": "0"}
    twins = spark.createDataFrame([(2, "z")], "qid int, unit string")
    live = spark.createDataFrame([("b",), ("z",)], "unit string")
    assert {r["qid"]: r["status"] for r in C.content_status(req, live, twins).collect()} == {1: "partial", 2: "surrogate", 3: "none"}


def test_shared_shingles_leave_only_what_is_shared(spark, monkeypatch):
    """Sent shingles give what the join by value gives, with kept columns, and without a join."""
    items = spark.createDataFrame([(1, "a b c d e f"), (2, "ä_1 b c d e, f g"), (3, None), (4, "a b")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x a b c d e f g; a b c d e", "s"), (2, "Ä_1 ä_1 b c d e f", None), (3, None, "s"), (4, "a b c", "t"), (5, "b-c.d\ne f", "t")], "doc_id long, text string, source string")
    rows = lambda df: sorted((tuple(r[c] for c in ("item_id", "doc_id", "source", "n_shared")) for r in df.collect()), key=str)
    sent = C.shared_shingles(items, docs, keep=["source"])
    assert "Join" not in sent._jdf.queryExecution().toString()
    monkeypatch.setattr(C, "SENT_SHINGLES", 0)
    assert rows(sent) == rows(C.shared_shingles(items, docs, keep=["source"]))
    assert (1, 1, "s", 2) in rows(sent)

"""Near-duplicates by blocks are those of the pair tables."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone import registry
from lodestone.operators import neardup


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("ab가나\U0001f600") for _ in range(rng.randint(1, 5)))
    texts = [" ".join(word() for _ in range(rng.randint(5, 60))) for _ in range(60)]
    near = [t[:-4] + "<b>ab가</b>" for t in texts[:20]]
    rows = list(enumerate([*texts, *near, *[texts[3]] * 13, None, "", "abc"]))
    rows += [(2, texts[30]), (None, texts[4])]  # a second row of one id, and one without
    return spark.createDataFrame(rows, "doc_id long, text string")


def found(df):
    return sorted((r["src"], r["rank"], r["dst"], round(r["sim"], 7)) for r in df.collect())


@pytest.mark.parametrize(("block", "own", "shared"), [(4096, 4096, 2048), (7, 20, 5)])
def test_nearest_are_the_neighbours_of_all_pairs(docs, monkeypatch, block, own, shared):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "OWN", own)
    monkeypatch.setattr(neardup, "SHARED", shared)
    pairs = neardup.similar_pairs(neardup.gram_vectors(docs)).withColumn("sim", F.round("sim", 9))
    want = found(neardup.neighbours(pairs))
    assert len(want) > 150 and found(neardup.nearest(docs)) == want


def test_nearest_takes_ids_of_text(docs):
    named = docs.select(F.concat(F.lit("n"), "doc_id").alias("doc_id"), "text")
    pairs = neardup.similar_pairs(neardup.gram_vectors(named)).withColumn("sim", F.round("sim", 9))
    assert found(neardup.nearest(named)) == found(neardup.neighbours(pairs))


def test_nearest_of_nothing(docs):
    assert neardup.nearest(docs.where("false")).count() == neardup.nearest(docs.where("doc_id = 1")).count() == 0


@pytest.mark.parametrize("name", ["near_duplicates_tfidf", "similarity_bands", "duplicate_group_pairs"])
def test_queries_join_no_grams(spark, sf, name):
    assert "gram" not in registry.queries()[name](spark, sf)._jdf.queryExecution().analyzed().toString()

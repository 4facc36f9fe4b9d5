"""Searches without pair tables give what the table forms give."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone import registry
from lodestone.operators import retrieval as R
from lodestone.operators import search


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    words = ["제12조", "제3조의2", "가나다라마바", "abcdefg", "12345678", "of", "The", "ab", "제", "xyz"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(i, text(rng.randint(0, 30)), i % 4 != 0) for i in range(120)] + [(120, None, True), (121, "", True)]
    docs += [(200 + i, docs[5][1], True) for i in range(9)]  # copies: ties
    items = [(i, text(6)) for i in range(8)] + [(8, None), (9, "nowhere")]
    vectors = [(i, [rng.random() - 0.5 for _ in range(4)]) for i, *_ in docs if i % 7] + [(7, [0.0] * 4), (14, [1.0, None, 2.0, 3.0]), (21, None), (28, [1.0])]
    return (spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string, live boolean"), spark.createDataFrame(vectors, "vec_id long, v array<double>"))


def found(df):
    return sorted((r["qid"], r["rank"], r["doc_id"], round(r["score"], 7) + 0.0) for r in df.collect())


def test_term_counts_are_the_tokens(spark, corpus):
    from collections import Counter

    from lodestone.functions import text as X

    odd = spark.createDataFrame([("제12조의3 가제4조가나다라마 ABCDEF 1234567 İstanbul Kelvin 제5 조",)], "text string")
    for r in corpus[1].where("text is not null").select("text").union(odd).select(F.lower("text").alias("low"), X.tokens(F.col("text")).alias("t")).collect():
        assert dict(search.term_counts(r["low"])) == dict(Counter(r["t"]))


def test_bm25_top_is_the_top_of_all_scores(corpus):
    items, docs, _ = corpus
    want = R.top_k(R.bm25_scores(items, docs).withColumn("score", F.round("bm25", 9)), 5)
    got = search.bm25_top(items, docs.drop("live"))
    assert found(got) == found(want)


def test_bm25_query_moves_no_pairs(spark, sf):
    assert "Join" not in plan(registry.queries()["bm25_top5"](spark, sf))


def test_hybrid_top_is_the_top_of_all_fused_scores(corpus):
    items, docs, vectors = corpus
    live = docs.where("live").select("doc_id").join(vectors.withColumnRenamed("vec_id", "doc_id"), "doc_id")
    queries = items.select(F.col("item_id").alias("qid")).join(vectors.withColumnRenamed("vec_id", "qid"), "qid")
    cos = R.cosine_scores(queries, live.withColumnRenamed("doc_id", "vec_id")).select("qid", F.col("vec_id").alias("doc_id"), F.col("cos").alias("vec"))
    both = cos.join(R.bm25_scores(items, docs.drop("live")), ["qid", "doc_id"], "left").withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))
    want = R.top_k(R.fused(both).withColumn("score", F.round("score", 9)), 5)
    assert found(search.hybrid_top(items, docs, vectors)) == found(want)


def test_hybrid_query_moves_no_pairs(spark, sf):
    assert "Join" not in plan(registry.queries()["hybrid_top5"](spark, sf))


def test_prompts_query_leaves_texts_in_place(spark, sf):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        steps = plan(registry.queries()["prompts"](spark, sf)).split("== Physical Plan ==")[1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert steps.count("SortMergeJoin") == 1  # items with their contexts, by item


def test_cosine_top_is_the_top_of_all_cosines(corpus):
    vectors = corpus[2]
    queries = vectors.where("vec_id % 5 = 0").select(F.col("vec_id").alias("qid"), "v")
    want = R.top_k(R.cosine_scores(queries, vectors).withColumnRenamed("vec_id", "doc_id").withColumn("score", F.round("cos", 9)), 5)
    assert found(search.cosine_top(queries, vectors)) == found(want) == found(search.cosine_top(queries, vectors, limit_bytes=200))


def test_cosine_query_moves_no_pairs(spark, sf):
    assert "Join" not in plan(registry.queries()["cosine_top5"](spark, sf))


def test_gram_counts_add_up_in_the_tasks(spark, monkeypatch):
    texts = spark.createDataFrame([("aabbaabb",), ("abc",), ("",), ("bbaa",)], "text string")
    assert {r["gram"]: r["n"] for r in search.counted(texts, search.char_grams, "gram").collect()} == {"aabb": 1, "abba": 1, "bbaa": 2, "baab": 1}


def test_gram_query_spreads_no_rows_in_the_jvm(spark, sf):
    assert "Generate" not in plan(registry.queries()["gram_document_frequency"](spark, sf))


def test_index_faults_are_counted_from_sums(spark):
    postings = spark.createDataFrame([("a", 1, 2), ("a", 1, 2), ("b", 1, 1), ("b", 2, 1), ("c", 3, 4), (None, None, 1)], "term string, doc_id long, tf long")
    lengths = spark.createDataFrame([(1, 5), (2, 9), (4, 0), (5, 1)], "doc_id long, dl long")
    idf = spark.createDataFrame([("b", 1.0), ("c", 1.0)], "term string, idf double")
    found = R.index_is_sound(postings, lengths, idf)
    assert found.first().asDict() == {"no_length": 2, "no_idf": 3, "repeated": 1, "wrong_length": 2}
    steps = plan(found).split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert steps.count("LeftAnti") == 1  # terms' counts; postings were joined twice before

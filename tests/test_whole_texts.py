"""Queries run over whole tables and whole texts: held against plain Python on small fixtures."""

import pytest

from lodestone import registry


@pytest.fixture
def run(spark, tmp_path):
    """Writes one table and runs a registered query over it."""

    def call(query, name, rows, schema):
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return registry.queries()[query](spark, str(tmp_path)).collect()

    return call


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_zipped_arrays_takes_every_word(run):
    text = " ".join(f"word{i}" for i in range(200))
    got = run("zipped_arrays", "documents", [(1, text, "en", "web", len(text)), (2, "a", "de", "news", 1)], DOCS)
    want = [(1, i, w, {0: "en", 1: "web"}.get(i)) for i, w in enumerate(text.split(" "))] + [(2, 0, "a", "de"), (2, 1, None, "news")]
    assert sorted((r["doc_id"], r["pos"], r["words"], r["tags"]) for r in got) == want


def test_judge_majority_counts_all_turns(run):
    vote = {"yes": "abcd", "no": "a", "partial": "ab", "?": "abc"}
    votes = {1: ["no", "no", "yes", "yes", "yes"], 2: ["yes", "yes", "no", "no"], 3: ["yes", "yes", "?", "?", "?"], 4: ["partial"], 5: ["?", "?", "no"]}
    rows = [(k, i, "user", vote[v]) for k, vs in votes.items() for i, v in enumerate(vs)]
    got = run("judge_majority", "conversations", rows, "conv_id bigint, turn bigint, role string, text string")
    assert {r["key"]: r["verdict"] for r in got} == {1: "yes", 2: "review", 3: "review", 4: "partial", 5: "review"}


def test_graded_answers_read_whole_texts(run):
    long = " ".join(f"word{chr(97 + i % 26)}" for i in range(100))
    rows = [(1, f"{long} 확인할 수 없음"), (7, f"{long} 42"), (12, long), (13, long)]
    got = run("graded_answers", "documents", [(i, t, "en", "web", len(t)) for i, t in rows], DOCS)
    # 1 abstains at its end; 7 (whose gold is its whole text) shares the number at its end; 12 has no number but the differing ones of gold (0) and answer (2); 13 abstains by rule
    assert {r["qid"]: r["state"] for r in got} == {1: "honest_abstain", 7: "correct", 12: "overconfident", 13: "honest_abstain"}


def test_rising_cap_sample_draws_from_all_documents(run):
    rows = [(1, "a", "en", "web", 10), (2, "b", "en", "web", 400), (3, "c", "de", "news", 20_000), (4, "d", "de", "news", None)]
    assert sorted(r["doc_id"] for r in run("rising_cap_sample", "documents", rows, DOCS)) == [1, 2, 3, 4]

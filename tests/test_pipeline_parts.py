"""Parsing, citations, revisions, grading, sampling, slots, readers, writers, streaming."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import citations, grading, neardup, parsing, retrieval, revisions, sampling, slots
from lodestone.sources import catalogue, readers, writers
from lodestone.streaming import ingest

ARTICLE = "제5조(절차) ① 신청은 다음과 같다. 1. 서류 가. 원본 나. 사본 2. 기한 ③ 틀린 번호 ② 승인은 10일 이내"


def test_units(spark):
    rows = [("d", 0, "제1장 총칙 "), ("d", 1, ARTICLE), ("d", 2, "제6조의2(삭제) <삭 제>"), ("d", 3, "제2절 심사 "), ("d", 4, "제7조(끝) 본문"), ("e", 0, "머리말")]
    u = {r["unit_id"]: r for r in parsing.parse_units(spark.createDataFrame(rows, "doc_id string, pos int, text string")).collect()}
    assert {i for i, r in u.items() if r["level"] == "jo"} == {"rule:d:000500", "rule:d:000602", "rule:d:000700"}
    assert u["rule:d:000500"]["chapter"] == "제1장 총칙" and (u["rule:d:000700"]["chapter"], u["rule:d:000700"]["section"]) == ("제1장 총칙", "제2절 심사") and u["rule:d:000602"]["deleted"]
    assert u["rule:d:000500:000100"]["text"].startswith("① 신청") and u["rule:d:000500:000200"]["text"] == "② 승인은 10일 이내"
    assert u["rule:d:000500:000100:000100:나"]["text"].startswith("나. 사본") and u["rule:d:000500:000100:000200"]["parent_id"] == "rule:d:000500:000100"
    assert not [i for i in u if i.startswith("rule:d:000602:")]


def test_headers_and_repeated_keys(spark):
    """A part or chapter ends the section before it; an article that comes again is told apart."""
    lines = ["제1조(가) x", "제1장 하나 ", "제1절 작은 것 ", "제2조(나) y", "제2장 둘 ", "제3조(다) z", "제3조(다) 다시", "표지", "제2절 또 ", "제4조(라) w"]
    u = {r["unit_id"]: (r["chapter"], r["section"]) for r in parsing.parse_units(spark.createDataFrame([("d", i, t) for i, t in enumerate(lines)], "doc_id string, pos int, text string")).where("level = 'jo'").collect()}
    assert u == {"rule:d:000100": ("", ""), "rule:d:000200": ("제1장 하나", "제1절 작은 것"), "rule:d:000300": ("제2장 둘", ""), "rule:d:000300~2": ("제2장 둘", ""), "rule:d:000400": ("제2장 둘", "제2절 또")}


def test_rule_records(spark):
    """Articles, supplements as one text or several, annexes as one object or several, and the metadata."""
    a = {"AdmRulService": {"행정규칙기본정보": {"행정규칙일련번호": 77, "행정규칙명": "임업지침", "행정규칙종류": "훈령", "발령번호": "12", "시행일자": "20200101", "소관부처명": "산림청"}, "조문내용": ["제1장 총칙", "제1조(목적) ① 가 1. 나 ② 다", " "], "부칙": {"부칙공포번호": "9", "부칙내용": "[시행] 공포한 날", "부칙공포일자": "20191231"}, "별표": {"별표단위": {"별표키": "k1", "별표제목": "표", "별표번호": "0001", "별표구분": "서식", "별표내용": ["줄1", "줄2"]}}}}
    b = {"행정규칙기본정보": {"행정규칙일련번호": "78"}, "조문내용": "제2조(하나) 한 줄", "부칙": {"부칙내용": ["첫째", "둘째"], "부칙공포번호": ["1"]}, "별표": {"별표단위": [{"별표내용": "<삭 제>" + "x" * 30_000}, {"별표키": "z"}]}}
    df = spark.createDataFrame([("f", i, json.dumps(x, ensure_ascii=False)) for i, x in enumerate([a, b, {"행정규칙기본정보": {"행정규칙일련번호": "79"}}])] + [("f", 3, "no json")], "file string, pos int, record string")
    u = {r["unit_id"]: r for r in parsing.rule_units(df).collect()}
    assert set(u) == {"rule:77:000100", "rule:77:000100:000100", "rule:77:000100:000100:000100", "rule:77:000100:000200", "rule:77:buchik:000:9", "rule:77:byeolpyo:000:서식:k1", "rule:78:000200", "rule:78:buchik:000:1", "rule:78:buchik:001:1", "rule:78:byeolpyo:000:별표:", "rule:78:byeolpyo:001:별표:z"}
    assert u["rule:77:000100"]["doc_name"] == "임업지침" and u["rule:77:000100"]["chapter"] == "제1장 총칙" and u["rule:77:buchik:000:9"]["text"] == "[시행] 공포한 날" and u["rule:77:buchik:000:9"]["promulgation_date"] == "20191231"
    assert u["rule:77:byeolpyo:000:서식:k1"]["text"] == "줄1\n줄2" and u["rule:77:byeolpyo:000:서식:k1"]["byeolpyo_title"] == "표"
    assert u["rule:78:byeolpyo:000:별표:"]["char_len"] == 20_000 and u["rule:78:byeolpyo:000:별표:"]["deleted"] and {r["tier"] for r in u.values()} == {"T4_행정규칙"}


def test_statute_records(spark):
    """Paragraph numbers by field, mark or place; items with branches; single objects where lists are usual; nested texts."""
    law = {"법령": {"기본정보": {"법령ID": "000123", "법령명_한글": "산림보호법", "법종구분": {"content": "법률"}, "소관부처": {"content": "산림청"}, "공포번호": "5", "시행일자": "20210101"}, "조문": {"조문단위": [
        {"조문여부": "전문", "조문내용": ["제1장 총칙"]},
        {"조문번호": "1", "조문제목": "목적", "조문내용": "제1조(목적) 이 법은", "조문변경여부": "N"},
        {"조문번호": "2", "조문가지번호": "3", "조문내용": "제2조의3", "항": [{"항번호": "①", "항내용": [["첫째"], "줄"]}, {"항내용": "② 둘째"}, {"항내용": "셋째", "호": {"호번호": "1의2.", "호내용": "호", "목": [{"목번호": "가.", "목내용": "목"}, {"목내용": "번호 없음"}]}}]},
        {"조문번호": "4", "조문내용": "제4조", "항": {"호": [{"호번호": "1.", "호내용": "하나"}, {"호내용": "번호 없음"}]}},
        {"조문번호": "5", "조문내용": "제5조 삭제 <2020.1.1>", "항": [{"항번호": "①", "항내용": "x"}]},
        {"조문번호": "1", "조문내용": "제1조 다시"}, "잘못"]},
        "부칙": {"부칙단위": {"부칙공포번호": "99", "부칙공포일자": "20200202", "부칙내용": [["부칙", " "], ["둘"]]}}}}
    df = spark.createDataFrame([("f", 0, json.dumps(law, ensure_ascii=False)), ("f", 1, "{broken"), ("f", 2, "[1]"), ("g", 0, json.dumps({"기본정보": {"법종구분": "국방부령", "법령ID": 7}, "조문": {"조문단위": {"조문번호": 1, "조문내용": "하나"}}}, ensure_ascii=False))], "file string, pos int, record string")
    u = {r["unit_id"]: r for r in parsing.statute_units(df).collect()}
    b = "law:000123"
    assert set(u) == {f"{b}:000100", f"{b}:000203", f"{b}:000203:000100", f"{b}:000203:000200", f"{b}:000203:000300", f"{b}:000203:000300:000102", f"{b}:000203:000300:000102:가", f"{b}:000400", f"{b}:000400:000000:000100", f"{b}:000500", f"{b}:000100~2", f"{b}:buchik:000", "law:7:000100"}
    assert u[f"{b}:000203:000100"]["text"] == "첫째\n줄" and u[f"{b}:000100"]["chapter"] == "제1장 총칙" and u[f"{b}:000100"]["tier"] == "T1_법률" and u["law:7:000100"]["tier"] == "T3_부령"
    item = u[f"{b}:000203:000300:000102"]
    assert (item["jo"], item["jo_branch"], item["hang"], item["ho"], item["ho_branch"], item["parent_id"]) == (2, 3, 3, 1, 2, f"{b}:000203:000300")
    assert u[f"{b}:000400:000000:000100"]["hang"] is None or u[f"{b}:000400:000000:000100"]["hang"] == 0
    assert u[f"{b}:000500"]["deleted"] and not u[f"{b}:000100"]["deleted"] and (u[f"{b}:buchik:000"]["text"], u[f"{b}:buchik:000"]["promulgation_no"]) == ("부칙\n둘", "99")


def test_references_without_a_document_are_spread(spark):
    """They have no key to meet by; one task had them all. A task's share is fixed by the number of tasks."""
    refs = spark.range(800).select(F.concat(F.lit("u"), F.col("id") % 200).alias("unit_id"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("cited_doc"), F.lit("1").alias("jo"), F.lit(None).cast("string").alias("jo_branch"))
    arts = spark.range(400).select(F.col("id").alias("doc_id"), F.lit(1).alias("jo"), F.lit(0).alias("jo_branch"), (F.col("id") % 4 == 0).alias("deleted"))
    found = citations.resolve_articles(refs, arts, 8)
    assert max(r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()) < 200
    want = {"missing_doc": 400, "missing_jo": 200, "deleted_jo": 100, "resolved": 100}
    for df in (found, citations.resolve_articles(refs, arts)):
        assert {r["verdict"]: r["count"] for r in df.groupBy("verdict").count().collect()} == want
    assert sorted(map(tuple, citations.verify_gold(found, partitions=8).collect())) == sorted(map(tuple, citations.verify_gold(found).collect()))


def test_statute_units_leave_together(spark):
    """Units of many records come in one batch, numbered where they are made: nothing is shuffled, and only what is asked for is made."""
    rows = [("f", i, json.dumps({"기본정보": {"법령ID": i}, "조문": {"조문단위": [{"조문번호": 1, "조문내용": "a"}, {"조문번호": 1, "조문내용": "b"}]}}, ensure_ascii=False)) for i in range(5)]
    df = spark.createDataFrame(rows, "file string, pos int, record string").coalesce(1)
    told = parsing.statute_units(df, ["pos", "unit_id", "text"])
    assert told.columns == ["pos", "unit_id", "text"] and "Window" not in told._jdf.queryExecution().toString()
    sizes = told.mapInArrow(lambda batches: (b.select(["pos"]).slice(0, 1) for b in batches if b.num_rows), "pos int").count()
    assert sizes == 1
    assert sorted(tuple(r) for r in told.where("pos = 3").collect()) == [(3, "law:3:000100", "a"), (3, "law:3:000100~2", "b")]
    assert set(parsing.statute_units(df).columns) == {f.split()[0] for f in parsing.STATUTE_COLUMNS.split(", ")} | {"file", "pos"}


def test_cutting(spark):
    cut = lambda f, t: [tuple(x) for x in spark.createDataFrame([(t,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]]
    assert cut(parsing.items, "앞 1. 하나 9. 아홉 2. 둘 9의2. 가지") == [(0, "앞"), (1, "1. 하나 9. 아홉"), (2, "2. 둘 9의2. 가지")]
    assert cut(parsing.paragraphs, "표지 없음 ") == [(0, "표지 없음")]
    clauses = parsing.application_clauses(spark.createDataFrame([("d", "제1조(시행일) 공포한 날 제2조(계약에 관한 적용례) 이후 체결분 제3조(끝맺음) x")], "doc_id string, text string")).collect()
    assert [(r["art_no"], r["title"]) for r in clauses] == [("2", "계약에 관한 적용례")] and clauses[0]["text"].startswith("제2조(계약") and "끝" not in clauses[0]["text"]


def test_json_shapes(spark):
    df = spark.createDataFrame([('{"a": 1}',), ('[{"a": 2}, {"a": 3}]',), (None,)], "j string")
    assert [[x["a"] for x in r["x"]] if r["x"] else None for r in df.select(parsing.as_list(F.col("j"), "struct<a:int>").alias("x")).collect()] == [[1], [2, 3], None]
    flat = spark.createDataFrame([('["a", ["b", {"k": "c"}]]',), ('"x"',)], "j string").select(parsing.flatten_json(F.col("j")).alias("x")).collect()
    assert flat[0]["x"] == "a\nb\nc"
    escaped = spark.createDataFrame([(json.dumps(["tab\t", 'quote " back \\ slash', "줄\n바꿈", "é😀"]),)], "j string").select(parsing.flatten_json(F.col("j")).alias("x")).first()["x"]
    assert escaped == 'tab\t\nquote " back \\ slash\n줄\n바꿈\né😀'


def test_references(spark):
    text = "「산림보호법」(이하 \"법\"이라 한다) 제3조제2항에 따라 법 제12조의2, 영 제5조 및 「어촌개발법 시행령」 제26조제1항제3호"
    units = spark.createDataFrame([("d", "u1", 0, text)], "doc_id string, unit_id string, pos int, text string")
    refs = {(r["target_name"], r["jo"], r["jo_branch"], r["hang"], r["ho"]): r for r in citations.references(units).collect()}
    assert set(refs) == {("산림보호법", "12", "2", "", ""), ("어촌개발법 시행령", "26", "0", "1", "3")}
    assert refs["어촌개발법 시행령", "26", "0", "1", "3"]["target_tier"] == "T2_대통령령"
    span = citations.external_tier_span(citations.references(units)).first()
    assert (span["n_refs"], span["ext_tier_span"]) == (2, 2)
    arts = spark.createDataFrame([("d", "a1", 1, 0, "제2조와 법 제3조 및 제9조", False), ("d", "a2", 2, 0, "x", False), ("d", "a3", 3, 0, "x", False)], "doc_id string, unit_id string, jo int, jo_branch int, text string, deleted boolean")
    assert [tuple(r) for r in citations.internal_references(arts).collect()] == [("a1", "a2")]


def test_resolution(spark):
    docs = spark.createDataFrame([("1", "방위사업법"), ("2", "(방위사업청) 보직관리규정")], "doc_id string, doc_name string")
    edges = spark.createDataFrame([("방위 사업법", "1", "0"), ("보직관리규정", "2", "0"), ("없는법", "1", "0"), ("방위사업법", "9", "0"), ("방위사업법", "4", "0")], "target_name string, jo string, jo_branch string")
    m = citations.match_names(edges, docs)
    arts = spark.createDataFrame([("1", 1, 0, False), ("1", 4, 0, True), ("2", 2, 0, False)], "doc_id string, jo int, jo_branch int, deleted boolean")
    got = sorted((r["target_name"], r["jo"], r["verdict"]) for r in citations.resolve_articles(m, arts).collect())
    assert got == sorted([("방위 사업법", "1", "resolved"), ("보직관리규정", "2", "resolved"), ("없는법", "1", "missing_doc"), ("방위사업법", "9", "missing_jo"), ("방위사업법", "4", "deleted_jo")])
    totals, missing = citations.match_diagnostics(m)
    assert tuple(totals.first()) == (5, 4, 2) and missing.first()["name"] == "없는법"
    cat = spark.createDataFrame([("국방과학기술혁신 촉진법",), ("방위사업법",)], "name string")
    f = {r["name"]: r["match"] for r in citations.fuzzy_match(spark.createDataFrame([("방위 사업법",), ("국방과학기술혁신촉진법률",), ("민법",)], "name string"), cat, 0.86).collect()}
    assert f == {"방위 사업법": "방위사업법", "국방과학기술혁신촉진법률": "국방과학기술혁신 촉진법"}


def test_scope_and_triage(spark):
    names = spark.createDataFrame([("방위사업법 시행령",), ("국가공무원법",), ("폐지규정",), ("우리규정",), ("모르는법",)], "name string").withColumn("canonical", F.col("name"))
    rules = spark.createDataFrame([(1, 1, "폐지규정", "abolished_cited"), (5, 1, "국가공무원법", "out_of_scope"), (6, 1, "방위사업법", "in_scope_to_collect")], "step int, rule_order int, family string, scope string")
    own = spark.createDataFrame([("우리 규정", 3)], "name string, step int")
    over = spark.createDataFrame([("모르는법", "out_of_scope"), ("국가공무원법", "in_scope")], "name string, scope string")
    got = {r["name"]: r["scope"] for r in citations.decide_scope(names, rules, own, over).collect()}
    assert got == {"방위사업법 시행령": "in_scope_to_collect", "국가공무원법": "out_of_scope", "폐지규정": "abolished_cited", "우리규정": "in_scope", "모르는법": "out_of_scope"}
    und = spark.createDataFrame([("같은 법", 50), ("관세법 시행령", 2), ("새 법률", 12), ("관세법 시행령 시행규칙", 4)], "name string, citations int")
    dec = spark.createDataFrame([("관세법", "out_of_scope")], "name string, scope string")
    assert {r["name"]: r["outcome"] for r in citations.triage(und, dec).collect()} == {"같은 법": "noise", "관세법 시행령": "inherited", "새 법률": "P1", "관세법 시행령 시행규칙": "P2"}
    assert {r["name"]: r["scope"] for r in citations.settle(und, und, dec).collect()}["관세법 시행령 시행규칙"] == "out_of_scope"


def test_revisions(spark):
    a = spark.createDataFrame([("r", 1, "c1", "10일 이내", False), ("r", 2, "c1", "20일 이내", False), ("r", 2, "c2", "새 조", False), ("r", 1, "c3", "옛 조", False), ("r", 1, "c4", "살아", False), ("r", 2, "c4", "<삭제>", True), ("r", 1, "c5", "같다 <개정 1>", False), ("r", 2, "c5", "같다", False)], "rule string, version int, code string, t string, d boolean")
    pairs = revisions.adjacent_versions(a.select("rule", "version").distinct(), "rule", ["version"])
    ch = revisions.with_signals(revisions.article_changes(a, pairs, "rule", "code", "t", "d"))
    got = {r["code"]: (r["kind"], r["signal_types"]) for r in ch.collect()}
    assert got == {"c1": ("개정", ["numbers"]), "c2": ("신설", []), "c3": ("제거", []), "c4": ("삭제표시", [])}
    assert revisions.candidates(ch).count() == 4
    cl = spark.createDataFrame([("d", "k1", "계약 체결 적용례")], "doc_id string, clause_id string, title string")
    ar = spark.createDataFrame([("d", "u1", "계약 체결"), ("d", "u2", "원가"), ("e", "u3", "계약 체결")], "doc_id string, unit_id string, title string")
    assert [(r["unit_id"], r["shared"]) for r in revisions.link_clauses(cl, ar).collect()] == [("u1", 2)]


def test_grading(spark):
    rows = [
        (1, "답: 30일\n근거: 제5조\n확신도: 높음", None, True, "30일", ["5"], "full"),
        (2, "답: 20일\n근거: 제6조\n확신도: 높음", None, True, "30일", ["5"], "full"),
        (3, "답: 모름\n확신도: 모름", None, True, "30일", ["5"], "none"),
        (4, "답: 모름\n확신도: 모름", None, True, "30일", ["5"], "surrogate"),
        (5, "답: 모름\n확신도: 모름", None, False, "", [], "oos"),
        (6, "답: 40일\n확신도: 낮음", None, False, "", [], "oos"),
        (7, "", "timeout", True, "x", [], "full"),
        (8, "답: 위원회 심의\n확신도: 중간", None, True, "장관 승인 필요", [], "full"),
    ]
    df = spark.createDataFrame(rows, "qid int, raw_answer string, error string, answerable boolean, gold_short string, gold_articles array<string>, q_status string").withColumn("question", F.lit("q"))
    g = grading.classify(df)
    got = {r["qid"]: (r["state"], r["correct"], r["cited_ok"]) for r in g.collect()}
    assert got == {1: ("correct", True, True), 2: ("overconfident", False, False), 3: ("honest_abstain", True, None), 4: ("honest_abstain", False, None), 5: ("honest_abstain", True, None), 6: ("hedged_wrong", False, None), 7: ("error", None, None), 8: ("review", None, None)}
    keys = grading.ambiguous_keys(df)
    assert keys.count() == 1
    votes = keys.select("key", F.explode(F.array(F.lit("yes"), F.lit("yes"), F.lit("?"))).alias("vote"))
    assert {r["qid"]: r["state"] for r in grading.classify(df, grading.majority(votes, 3)).collect()}[8] == "correct"
    split = spark.createDataFrame([("k", "yes"), ("k", "no"), ("k", "partial"), ("m", "?"), ("n", "yes"), ("n", "?"), ("n", "?")], "key string, vote string")
    assert {r["key"]: r["verdict"] for r in grading.majority(split, 3).collect()} == {"k": "review", "m": "review", "n": "review"}


def test_retrieval_parts(spark):
    parts = spark.createDataFrame([(1, 0, "가 나"), (1, 1, "나"), (1, 2, " 다 "), (2, 0, None)], "k int, i int, text string")
    assert {r["k"]: r["text"] for r in retrieval.chunks(parts, "k", ["i"]).collect()} == {1: "가 나\n다", 2: ""}
    s = spark.createDataFrame([(1, 1, 0.5, 2.0), (1, 2, 0.5, 4.0), (1, 3, 0.5, 4.0)], "qid int, doc_id int, vec double, bm25 double")
    top = retrieval.top_k(retrieval.fused(s), 2).orderBy("rank").collect()
    assert [(r["doc_id"], r["score"]) for r in top] == [(2, 0.5), (3, 0.5)]
    assert {r["score"] for r in retrieval.fused(s, mode="bm25").collect()} == {2.0, 4.0}


def test_sampling(spark):
    df = spark.createDataFrame([(i, i % 2 if i < 8 else 0) for i in range(10)], "r int, k int")
    assert [r["r"] for r in sampling.capped(df, "k", "r", 2, 10).collect()] == [0, 1, 2, 3]
    assert sorted(r["r"] for r in sampling.rising_cap(df, "k", "r", 1, 5).collect()) == [0, 1, 2, 3, 4]
    rows = [{"t": "a", "u": 1}, {"t": "a", "u": 2}, {"t": "a", "u": 3}, {"t": "b", "u": 1}, {"t": "b", "u": 4}]
    assert sampling.greedy_unique(rows, "t", "u", 2, 9) == [rows[0], rows[1], rows[4]]


def test_slots(spark):
    s = spark.createDataFrame([("q1", "", 0), ("q1", "써진 질문", 1), ("q2", "a", 0), ("q2", "b", 1)], "qid string, question string, file_order int")
    assert {r["qid"]: (r["question"], r["n_files"]) for r in slots.merge_slots(s).collect()} == {"q1": ("써진 질문", 2), "q2": ("a", 2)}
    a = spark.createDataFrame([("q1", ["u1", "u2"], ""), ("q2", ["u3"], "")], "qid string, gold_ids array<string>, question string")
    w = spark.createDataFrame([("q1", ["u2", "u1"], "옮김"), ("q2", ["u9"], "버림")], "qid string, gold_ids array<string>, question string")
    assert {r["qid"]: r["question"] for r in slots.carry_over(a, w, ["question"]).collect()} == {"q1": "옮김", "q2": ""}
    long_ = "제1조에 따라 적용한다."
    rows = [
        ("ok", "절차는 무엇인가?", "30일", long_, ["다른 글"], 1, True, None, "통과", [], []),
        ("empty", "", "", "", [], 1, True, None, "미작성", ["no_question", "no_short_answer", "no_long_answer"], []),
        ("half", "묻는다", None, long_, [], 1, True, None, "미작성", ["no_short_answer"], []),
        ("leak", "하나 둘 셋 넷 다섯 여섯", "a", long_, ["영 하나, 둘 셋 넷 다섯"], 1, True, None, "반려", ["leak"], []),
        ("border", "하나 둘 셋 넷 여섯", "a", long_, ["영 하나 둘 셋 넷 다섯"], 1, True, None, "주의", [], ["leak_border"]),
        ("quoted", "「하나 둘 셋 넷 다섯 여섯」 기준은", "a", long_, ["하나 둘 셋 넷 다섯"], 1, True, None, "주의", [], ["quoted_names"]),
        ("place", "제5조의2 내용은?", "a", long_, [], 1, True, None, "반려", ["position"], []),
        ("place_out", "제5조의2 내용은?", "a", "확인할 수 없다", [], 0, False, None, "통과", [], []),
        ("form", "별지 제3호 서식은?", "a", long_, [], 1, True, None, "통과", [], []),
        ("date", "2020년 3월 기준은?", "a", long_, [], 1, True, None, "반려", ["date"], []),
        ("long", "무엇", "x" * 41, "가. 나. 다. 라. 마.", [], 1, True, None, "반려", ["long_answer"], ["many_sentences"]),
        ("longer_out", "무엇", "x" * 41, "소관 아님", [], 0, False, "산림 법", "주의", [], ["target_not_named"]),
        ("named_out", "산림법 에 무엇", "없음", "아무 말", [], 0, False, "산림 법", "주의", [], ["not_declined"]),
        ("four", "무엇", "a", "말", [], 4, True, None, "주의", [], ["no_application", "no_basis", "no_time"]),
        ("years", "2001 2002 2003 중", "a" * 16, long_, None, 1, True, None, "주의", [], ["answer_length", "names_and_years"]),
    ]
    c = spark.createDataFrame([r[:8] for r in rows], "qid string, question string, answer_short string, answer_long string, evidence array<string>, level int, answerable boolean, cited_target string")
    assert {r["qid"]: (r["status"], r["fails"], r["warnings"]) for r in slots.check_slots(c).collect()} == {r[0]: r[8:] for r in rows}
    sheet = {r["qid"]: r["warnings"] for r in slots.check_sheet(c).collect()}
    assert "empty" not in sheet and sheet["leak"] == ["leak"] and sheet["date"] == ["date"] and sheet["longer_out"] == ["not_declined"] and sheet["named_out"] == [] and sheet["ok"] == []
    r = spark.createDataFrame([("a", "제5조는?", True, ["산림법"], None), ("b", "산림법 기준은?", True, ["산림법", ""], None), ("c", "목적은?", True, ["산림법"], None), ("d", "산림법은?", False, None, "산림법"), ("e", "무엇?", False, None, "산림법"), ("f", "무엇?", True, None, None), ("g", " ", True, None, None)], "qid string, question string, answerable boolean, gold_names array<string>, cited_target string")
    assert {tuple(x) for x in slots.scan_references(r).collect()} == {("a", "제거", "place"), ("b", "검토", "산림법"), ("c", "주의", "generic"), ("d", "필요", "산림법"), ("e", "주의", "산림법")}
    todo = slots.worksheet(spark.createDataFrame([("a",), ("b",), ("c",)], "qid string"), spark.createDataFrame([("a", "써짐"), ("b", " ")], "qid string, question string"), spark.createDataFrame([("b", 2, 0.7), ("b", 3, 0.65), ("c", 0, 0.9)], "qid string, n_dup_other int, top_sim double"))
    assert {tuple(x) for x in todo.collect()} == {("b", 3, 0.65), ("c", None, None)}
    assert slots.longest_common_run("a b c d".split(), "x b c y".split()) == 2
    g = spark.createDataFrame([("q", [("u1", "a\na\nb", "optional"), ("u2", "c", "required")])], "qid string, gold_evidence array<struct<unit_id:string,text_span:string,necessity:string>>")
    assert [r["unit"] for r in slots.required_units(g).collect()] == ["u2"]
    assert g.select(slots.repair_spans(F.col("gold_evidence")).alias("g")).first()["g"][0]["text_span"] == "a\nb"


def test_readers(spark, tmp_path):
    d = tmp_path / "recs"
    d.mkdir()
    (d / "a.json").write_text('[{"id": 1}, {"id": 2}]')
    (d / "b.json").write_text('{"id": 3}')
    (d / "c.json").write_text('{"id": 1}\n\n{"id": 5}\n')
    (tmp_path / "pretty").mkdir()
    (tmp_path / "pretty" / "x.json").write_text('{\n "id": 7,\n "list": [\n  {"a": 1}\n ]\n}')
    (tmp_path / "pretty" / "y.json").write_text('[\n{"id": 8},\n{"id": 9}\n]\n')
    assert sorted(r["id"] for r in readers.records(spark, str(tmp_path / "pretty")).select(F.get_json_object("record", "$.id").alias("id")).collect()) == ["7", "8", "9"]
    both = readers.versions(spark, str(tmp_path / "pretty"), "$.id")
    assert {(r["version"], r["key"]) for r in both.collect()} == {("x", "7"), ("y", "8"), ("y", "9")}
    (tmp_path / "broken.jsonl").write_text('{"id": 1}\n\nno json\n{"id": 2}\n')
    assert readers.json_lines(spark, str(tmp_path / "broken.jsonl"), "id int", tolerant=True).count() == 2 and readers.broken_lines(spark, str(tmp_path / "broken.jsonl")).first()["n"] == 1
    with pytest.raises(Exception, match="MALFORMED"):
        readers.json_lines(spark, str(tmp_path / "broken.jsonl"), "id int").collect()
    recs = readers.records(spark, str(d)).withColumn("id", F.get_json_object("record", "$.id"))
    assert sorted(r["id"] for r in recs.collect()) == ["1", "1", "2", "3", "5"] and readers.first_per_key(recs, "id").count() == 4
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\nbroken\n{"a": 2}\n')
    assert sorted(r["a"] for r in readers.json_lines(spark, str(tmp_path / "x.jsonl"), "a int", tolerant=True).collect()) == [1, 2]
    assert readers.json_lines(spark, str(tmp_path / "none.jsonl"), "a int", optional=True).count() == 0
    form = spark.createDataFrame([("f", "# x\n## q1\n- 질문: 첫 줄\n둘째 줄\n```\n- 질문: 무시\n```\n- 정답: 30일\n## q2\n- 질문:\n")], "file string, value string")
    assert {(r["qid"], r["field"]): r["value"] for r in readers.form(form).collect()} == {("q1", "질문"): "첫 줄\n둘째 줄", ("q1", "정답"): "30일", ("q2", "질문"): ""}
    (tmp_path / "t.tsv").write_text("a\tb\n1\tx\n2\ty\n")
    assert readers.tab_separated(spark, str(tmp_path / "t.tsv"), "a int, b string").count() == 2
    spark.dataSource.register(readers.paged_source("pages_test", "id int", lambda page: [{"id": i} for i in range(7) if i // 3 == page - 1], lambda: 7, 3))
    assert sorted(r["id"] for r in spark.read.format("pages_test").load().collect()) == list(range(7))
    tries = iter([OSError("x"), '{"ok": 1}'])

    def get():
        x = next(tries)
        if isinstance(x, Exception):
            raise x
        return x

    assert readers.with_retries(get) == {"ok": 1}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "가,나"), (2, None)], "a int, b string")
    writers.delimited(df, str(tmp_path / "csv"), bom=True)
    text = next((tmp_path / "csv").glob("part-*")).read_bytes().decode()
    assert text.startswith("﻿a,b\n") and '1,"가,나"\n' in text
    writers.json_lines(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert "| 1 | 가,나 |" in writers.report([("표", df)])
    df.write.parquet(str(tmp_path / "p"))
    with pytest.raises(ValueError, match="replace"):
        writers.guarded(df.limit(1), str(tmp_path / "p"), spark)
    assert writers.guarded(df, str(tmp_path / "p"), spark).endswith(".new")
    assert writers.content_key(df, "a", "b") == writers.content_key(df.orderBy(F.desc("a")), "a", "b") != writers.content_key(df, "a")
    made = []
    for _ in range(2):
        assert writers.cached(spark, str(tmp_path), "k1", lambda: made.append(1) or df).count() == 2
    assert made == [1]


def test_streaming(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    row = lambda q, e=None: json.dumps({"qid": q, "condition": "c", "model": "m", "raw_answer": "a", "error": e})
    (src / "responses_1.jsonl").write_text(row("q1") + "\n")
    schema = "qid string, condition string, model string, raw_answer string, error string"
    args = (spark, str(src), str(tmp_path / "out"), str(tmp_path / "cp"), schema)
    ingest.ingest_responses(*args)
    (src / "responses_2.jsonl").write_text(row("q2") + "\n")
    ingest.ingest_responses(*args)
    ingest.ingest_responses(*args)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert ingest.progress(spark, str(tmp_path / "out"), 2).first()["state"] == "done"


def test_catalogue(spark):
    a, b = (spark.createDataFrame(r, "id int, v string") for r in ([(1, "a"), (2, "a")], [(2, "b"), (3, "b")]))
    assert {r["id"]: r["_query"] for r in catalogue.tagged_queries({"x": a, "y": b}, "id").collect()} == {1: "x", 2: "x", 3: "y"}
    assert catalogue.list_with_fallback(a.limit(0), {"x": a, "y": b}, F.col("v") == "b", "id").count() == 1
    assert catalogue.list_with_fallback(a, {"y": b}, F.lit(True), "id").count() == 2
    names = spark.createDataFrame([("방위사업법",), ("보직 관리규정",), ("없음",)], "name string")
    laws, rules = (spark.createDataFrame([(n,)], "name string") for n in ("방위사업법", "보직관리규정"))
    assert {r["name"]: r["route"] for r in catalogue.routes(names, laws, rules).collect()} == {"방위사업법": "law", "보직 관리규정": "rule", "없음": "none"}
    link = spark.range(1).select(catalogue.link_parameter(F.lit("http://x/y?a=1&id=7"), "id").alias("x")).first()
    assert link["x"] == "7"


def test_surrogates(spark):
    gold = spark.createDataFrame([(1, 10)], "qid int, doc_id int")
    edges = spark.createDataFrame([(10, 11, 0.9), (10, 12, 0.7)], "src int, dst int, sim double")
    docs = spark.createDataFrame([(10, "x", "s"), (11, "기한은 30일 이내", "s"), (12, "다른 말", "t")], "doc_id int, text string, source string")
    answers = spark.createDataFrame([(1, "30일이내")], "qid int, answer string")
    assert [tuple(r) for r in neardup.surrogates(gold, edges, docs, answers).collect()] == [(1, 11)]
    assert tuple(neardup.gold_duplicates(gold, edges, docs).first()) == (1, 10, 2, 1, 0.9)

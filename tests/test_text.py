import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as X


@pytest.fixture(scope="module")
def say(spark):
    """Value of an expression over literal columns a, b, c."""

    def run(make, *args):
        df = spark.createDataFrame([args], ", ".join(f"{n} {'array<string>' if isinstance(v, list) else 'int' if isinstance(v, int) else 'string'}" for n, v in zip("abc", args)))
        return df.select(make(*(F.col(n) for n in df.columns)).alias("x")).first()["x"]

    return run


@pytest.mark.parametrize(("f", "value", "want"), [
    (X.name_key, "전략물자 수출입고시", "전략물자수출입고시"),
    (X.name_key, "민ㆍ군(기술)　협력", "민군기술협력"),
    (X.name_key_strict, "「국가계약법」 시행령", "국가계약법시행령"),
    (X.name_key_no_agency, "(방위사업청) 보직관리규정", "보직관리규정"),
    (X.collapse, "  a \n\t b　c ", "a b c"),
    (X.without_amendments, "가 <개정 2020.1.1> 나<신설>다<그림>", "가나다<그림>"),
    (X.comparable, "가<b>ㆍ 나", "가·나"),
    (X.answer_key, "⑫항ㆍ③ <x>1，2", "12항·31,2"),
    (X.tier_of, "국방전력발전업무훈령", "T4_행정규칙"),
    (X.tier_of, "방위사업법 시행령", "T2_대통령령"),
    (X.is_noise, "같은 법", True),
    (X.is_noise, "이 법 시행령", True),
    (X.is_noise, "이자제한법", False),
    (X.is_noise, "민법", False),
    (X.is_noise, "제3조제2항", True),
    (X.parent_name, "방위사업법 시행령", "방위사업법"),
    (X.parent_name, "방위사업법", None),
    (X.issue_key, "제2023-8호", [2023, 8]),
    (X.issue_key, "969", [969]),
    (X.issue_key, None, [0]),
    (X.code6_label, "002702", "27의2"),
    (X.code6_label, "000500", "5"),
    (X.iso_date, "20230105", "2023-01-05"),
    (X.chunk_id, "law:010107:004602:000100", "law:010107:004602"),
    (X.path_leaf, "a\\b/c.jsonl", "c.jsonl"),
    (X.safe_name, "qwen3:8b/x", "qwen3-8b-x"),
    (X.tokens, "제46조의2 착수금지급 ABC 123456", ["제46조의2", "착수금지급", "착수", "수금", "금지", "지급", "abc", "123456"]),
    (X.word_list, "국방 (개혁), A_1!", ["국방", "개혁", "A_1"]),
    (X.char_grams, "abcde", ["abcd", "bcde"]),
    (X.char_grams, "abc", []),
])
def test_expressions(say, f, value, want):
    assert say(f, value) == want


def test_numbers(say):
    assert tuple(say(X.parse_number, "9의2.")) == (9, 2)
    assert tuple(say(X.parse_number, "①")) == (1, 0)
    assert tuple(say(X.parse_number, "")) == (0, 0)
    assert say(X.code6, 10, 2) == "001002"
    assert say(lambda a: X.word_shingles(X.word_list(a), 5), "a b c d e f") == ["a b c d e", "b c d e f"]


def test_sequential_markers(spark):
    df = spark.createDataFrame([([(1, 1), (5, 2), (2, 3), (3, 4), (9, 5)],)], "c array<struct<number:int,at:int>>")
    assert [r["number"] for r in df.select(X.in_sequence(F.col("c")).alias("x")).first()["x"]] == [1, 2, 3]


def test_dedup_parts(say):
    assert say(X.dedup_parts, ["가 나다", "나 다", "라", "", "가나 다라"]) == ["가 나다", "라"]


@pytest.mark.parametrize(("raw", "want"), [
    ("<think>음</think>답: 30일\n근거: 제5조\n확신도: 높음", ("30일", "제5조", "높음", "ok")),
    ("답: 모름\n확신도: <높음|중간|낮음|모름>", ("모름", "", "", "template_echo")),
    ("그냥 문장", ("그냥 문장", "", "", "missing")),
    ("답: a\n확신도: 글쎄", ("a", "", "", "unparsed")),
    ("<think>끝나지 않은 답: 5일\n근거: 제2조", ("5일", "제2조", "", "missing")),
    (None, ("", "", "", "missing")),
])
def test_parse_answer(say, raw, want):
    assert tuple(say(X.parse_answer, raw)) == want


def test_answers(say):
    assert say(X.keyword_match, "30일 이내 통보", "30일 이내") == "yes"
    assert say(X.keyword_match, "20일 이내", "30일 이내") == "no"
    assert say(X.keyword_match, "제5조에 따라", "") == "ambiguous"
    assert say(X.keyword_match, "전혀 다른 말", "방위사업청장 승인") == "ambiguous"
    assert say(lambda a, b: X.citation_ok(a, b), "제27조의2에 따라", ["27의2"]) is True
    assert say(lambda a, b: X.citation_ok(a, b), "없음", ["27의2"]) is False
    assert say(lambda a, b: X.citation_ok(a, b), "제1조", []) is None
    assert say(X.is_abstention, "규정에서 찾을 수 없음", "", "높음") is True
    assert say(X.covers, "30일 이내", "통보는 30일이내에 한다") is True
    assert say(X.covers, "장관 승인 없음", "장관이 승인") is False


def test_signals(say):
    s = say(X.change_signals, "10일 이내에 하여야 한다", "20일 이내에 할 수 있다")
    assert s["numbers"]["removed"] == ["10일"] and s["numbers"]["added"] == ["20일"] and s["modality"] is True
    c = say(X.condition_parts, "cov040_core_doc.jsonl")
    assert (c["cov"], c["strategy"], c["unit"]) == (40, "core", "doc")
    assert say(lambda a: X.model_matches(a, "4b"), "qwen3:4b") is True and say(lambda a: X.model_matches(a, "4b"), "qwen3:14b") is False
    assert [say(X.paragraph_number, f, t, 9) for f, t in (("2", "x"), ("", "③ x"), ("", "x"))] == [2, 3, 9]

"""Question slots: merging, recovery, carry-over, span repair, authoring checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as X


def merge_slots(slots: DataFrame, qid: str = "qid", question: str = "question", file_order: str = "file_order") -> DataFrame:
    """One row a qid from several files: a written one before an unwritten one, then the earlier file; adds n_files."""
    rest = [c for c in slots.columns if c != qid]
    written = F.when(F.trim(F.coalesce(question, F.lit(""))) != "", 0).otherwise(1)
    g = slots.groupBy(qid).agg(F.min_by(F.struct(*rest), F.struct(written.alias("w"), F.col(file_order).alias("f"))).alias("s"), F.count("*").alias("n_files"))
    return g.select(qid, "s.*", "n_files")


def recover_slots(responses: DataFrame) -> DataFrame:
    """(qid, gold_chunks, statuses, answerable): what responses still know of their questions; any oos makes it unanswerable."""
    g = responses.groupBy("qid").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gold_chunks")))).alias("gold_chunks"), F.array_sort(F.collect_set("q_status")).alias("statuses"))
    return g.withColumn("answerable", ~F.array_contains("statuses", "oos"))


def carry_over(slots: DataFrame, written: DataFrame, fields: list[str]) -> DataFrame:
    """Slots with the fields of earlier written ones, where qid and the set of gold ids agree; blanks never overwrite."""
    key = F.array_sort("gold_ids")
    w = written.select("qid", key.alias("_g"), *(F.col(f).alias(f"_{f}") for f in fields))
    out = slots.withColumn("_g", key).join(w, ["qid", "_g"], "left")
    for f in fields:
        out = out.withColumn(f, F.coalesce(F.nullif(F.trim(f"_{f}"), F.lit("")), F.col(f)))
    return out.drop("_g", *(f"_{f}" for f in fields))


def fill_fields(slots: DataFrame, sheet: DataFrame, fields: list[str]) -> DataFrame:
    """Slots overwritten by a worksheet's non-empty fields."""
    w = sheet.select("qid", *(F.col(f).alias(f"_{f}") for f in fields))
    out = slots.join(w, "qid", "left")
    for f in fields:
        out = out.withColumn(f, F.coalesce(F.nullif(F.trim(f"_{f}"), F.lit("")), F.col(f)))
    return out.drop(*(f"_{f}" for f in fields))


def repair_spans(gold: Column, cap: int = 8000) -> Column:
    """Evidence spans with repeated lines removed and cut to the cap."""
    fixed = lambda t: F.substring(F.array_join(X.dedup_parts(F.split(t, "\n")), "\n"), 1, cap)
    return F.transform(gold, lambda g: g.withField("text_span", fixed(g["text_span"])))


def at_cap(gold: Column, caps: tuple[int, ...] = (1500, 8000)) -> Column:
    return F.exists(gold, lambda g: F.length(g["text_span"]).isin(*caps))


def longest_common_run(a: list[str], b: list[str]) -> int:
    """Length of the longest common contiguous run of words."""
    best, last = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0] * (len(b) + 1)
        for j, y in enumerate(b, 1):
            if x == y:
                row[j] = last[j - 1] + 1
                best = max(best, row[j])
        last = row
    return best


def leaks(question: Column, evidence: Column, limit: int = 5) -> Column:
    """Does a question share a run of ``limit`` words with its evidence?"""
    return F.arrays_overlap(X.word_shingles(X.word_list(question), limit), X.word_shingles(X.word_list(evidence), limit))


#: Patterns and word lists of the authoring checks, of the worksheet checks and of the reference scan.
LEAK_LIMIT, SHORT_WARN, SHORT_FAIL, MANY_SENTENCES, MANY_NAMES = 5, 15, 40, 4, 3
DATE = r"(?:19|20)\d{2}\s*년|(?:19|20)\d{2}[.\-/]\d{1,2}|\d{1,2}\s*월\s*\d{1,2}\s*일"
YEAR = r"(?:19|20)\d{2}"
QUOTED = r"[「『][^」』]{2,60}[」』]"
ARTICLE_PLACE, PARAGRAPH_PLACE, ITEM_PLACE = r"제\s*\d{1,3}\s*조(?:\s*의\s*\d+)?", r"제\s*\d{1,2}\s*항|[①-⑳]", r"제\s*\d{1,3}\s*호"
FORM_NUMBER = r"별지\s*제?\s*\d+\s*호(?:\s*서식)?"
APPLIES = ("적용", "해당", "포함", "대상", "제외")
WHEN = ("현행", "개정", "시행", "종전", "이전", "이후", "당시", "기존", "소급", "착수", "체결", "발령", "종래", "구법", "신법", "경과", "부터", "까지", "전에", "후에", "당초", "최초", "이미")
NO_BASIS = (
    "확인할 수 없", "확인이 어렵", "확인 불가", "알 수 없", "판단할 수 없", "근거가 없", "근거를 찾을 수 없", "규정되어 있지 않", "포함되어 있지 않", "포함되지 않", "다루지 않", "범위 밖", "범위를 벗어",
    "대상이 아니", "소관", "적용되지 않", "해당하지 않", "폐지", "미공개", "다른 법령", "타 법령", "일반법", "국가계약법", "이 규정집", "이 코퍼스", "명시되어 있지 않",
)
SHEET_DATE = r"\d{4}\s*[.\-년/]\s*\d{1,2}|\d{4}년|\d{8}"
GENERIC = ("적용범위", "적용 범위", "목적", "정의", "적용대상", "적용 대상", "구성", "운영원칙", "관리ㆍ운용 원칙", "기본원칙", "업무분장")


def _words(c: Column) -> Column:
    """Words between white space, after everything but letters, digits and underscores became a blank."""
    return F.filter(F.split(F.regexp_replace(c, r"[^\p{L}\p{N}_]", " "), X.SPACE + "+"), lambda w: w != "")


def _any_of(c: Column, words: tuple[str, ...]) -> Column:
    return c.rlike("|".join(words))


def _count(c: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1)))


def _places(q: Column) -> Column:
    """Does a text point at an article, paragraph or item? The number of a form is no such place."""
    bare = F.regexp_replace(q, FORM_NUMBER, " ")
    return bare.rlike(f"{ARTICLE_PLACE}|{PARAGRAPH_PLACE}|{ITEM_PLACE}")


def check_slots(slots: DataFrame) -> DataFrame:
    """Adds fails and warnings (arrays of rule names) and status of the authoring checks: 미작성, 반려, 주의 or 통과.

    Needs question, answer_short, answer_long, evidence (array of texts), level, answerable, cited_target.  Rules:
    shared runs of words with the evidence, quoted names apart (leak; leak_border one word before); length of a short
    answer to an answerable question; sentences of the long one; names and years; a date in the question; a place in
    an answerable question; the cited document's name in an unanswerable one; the three elements of level 4; the
    wording of level 0; quoted names.
    """
    q, a, long_ = (X.strip(F.coalesce(c, F.lit(""))) for c in ("question", "answer_short", "answer_long"))
    answerable, level = F.coalesce(F.col("answerable"), F.lit(True)), F.coalesce(F.col("level"), F.lit(-1))
    n = F.length(a)
    own = _words(F.regexp_replace(q, QUOTED, " "))
    runs = lambda size: F.exists(F.coalesce("evidence", F.array().cast("array<string>")), lambda e: F.arrays_overlap(X.word_shingles(own, size), X.word_shingles(_words(F.coalesce(e, F.lit(""))), size)))
    flat = lambda c: X.replace(c, f"{X.SPACE}+")
    target = F.coalesce("cited_target", F.lit(""))
    rows = slots.withColumns({"_leak": runs(LEAK_LIMIT), "_border": runs(LEAK_LIMIT - 1)})
    fail = {
        "leak": F.col("_leak"),
        "long_answer": answerable & (n > SHORT_FAIL),
        "date": q.rlike(DATE),
        "position": answerable & _places(q),
    }
    warn = {
        "leak_border": ~F.col("_leak") & F.col("_border"),
        "answer_length": answerable & (n > SHORT_WARN) & (n <= SHORT_FAIL),
        "many_sentences": F.size(F.filter(F.split(long_, r"[.!?。]\s*"), lambda s: X.strip(s) != "")) > MANY_SENTENCES,
        "names_and_years": _count(q, QUOTED) + _count(q, YEAR) >= MANY_NAMES,
        "target_not_named": ~answerable & (target != "") & ~flat(q).contains(flat(target)),
        "no_application": (level == 4) & ~_any_of(long_, APPLIES),
        "no_basis": (level == 4) & ~long_.rlike(r"제\s*\d{1,3}\s*조|부칙|별표"),
        "no_time": (level == 4) & ~_any_of(long_, WHEN) & ~long_.rlike(r"20\d{2}|\d+년|\d+월"),
        "not_declined": (level == 0) & ~_any_of(long_, NO_BASIS),
        "quoted_names": q.rlike(QUOTED),
    }
    missing = {"no_question": q == "", "no_short_answer": a == "", "no_long_answer": long_ == ""}
    names = lambda rules: F.array_compact(F.array(*(F.when(c, name) for name, c in rules.items())))
    out = rows.withColumn("_missing", names(missing)).withColumn("fails", F.when(F.size("_missing") > 0, F.col("_missing")).otherwise(names(fail)))
    out = out.withColumn("warnings", F.when(F.size("_missing") > 0, F.array().cast("array<string>")).otherwise(names(warn)))
    status = F.when(F.size("_missing") > 0, "미작성").when(F.size("fails") > 0, "반려").when(F.size("warnings") > 0, "주의").otherwise("통과")
    return out.withColumn("status", status).drop("_missing", "_leak", "_border")


def check_sheet(slots: DataFrame) -> DataFrame:
    """(qid, warnings) of what a filled worksheet should be looked at for; only written questions.

    Needs question, answer_short, answer_long, evidence (array of texts), answerable.
    """
    q, a = F.coalesce("question", F.lit("")), F.coalesce("answer_short", F.lit(""))
    answerable = F.coalesce(F.col("answerable"), F.lit(True))
    leak = F.exists(F.coalesce("evidence", F.array().cast("array<string>")), lambda e: leaks(q, F.coalesce(e, F.lit("")), LEAK_LIMIT))
    warn = {
        "leak": leak,
        "date": q.rlike(SHEET_DATE),
        "answer_length": answerable & (F.length(a) > SHORT_WARN),
        "not_declined": ~answerable & ~a.contains("근거") & ~a.contains("없"),
        "no_long_answer": X.strip(F.coalesce("answer_long", F.lit(""))) == "",
    }
    return slots.where(X.strip(q) != "").select("qid", F.array_compact(F.array(*(F.when(c, name) for name, c in warn.items()))).alias("warnings"))


def scan_references(slots: DataFrame) -> DataFrame:
    """(qid, kind, item) of written questions: 제거 (a place), and, of an answerable one, 검토 (names a gold document) or 주의
    (generic words alone), of an unanswerable one, 필요 (names the cited document) or 주의 (does not).

    Needs question, answerable, gold_names (array), cited_target.
    """
    q, target = X.strip(F.coalesce("question", F.lit(""))), F.coalesce("cited_target", F.lit(""))
    answerable = F.coalesce(F.col("answerable"), F.lit(True))
    named = F.filter(F.array_distinct(F.coalesce("gold_names", F.array().cast("array<string>"))), lambda n: (n != "") & q.contains(n))
    flag = lambda c, kind, item: F.when(c, F.struct(F.lit(kind).alias("kind"), item.alias("item")))
    flags = F.array_compact(F.array(
        flag(_places(q), "제거", F.lit("place")),
        flag(~answerable & (target != ""), "필요", target), flag(answerable & (F.size(named) > 0), "검토", F.array_min(named)),
        flag(answerable & (F.size(named) == 0) & _any_of(q, GENERIC), "주의", F.lit("generic")),
    ))
    rows = slots.where(q != "").select("qid", q.alias("_q"), F.explode(flags).alias("f")).select("qid", "_q", "f.*")
    unnamed = (F.col("kind") == "필요") & ~F.col("_q").contains(F.col("item"))
    return rows.select("qid", F.when(unnamed, "주의").otherwise(F.col("kind")).alias("kind"), "item")


def worksheet(slots: DataFrame, done: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Slots still to be written, by level, with the gold document that most others repeat (a weak instrument): n_dup and top_sim, null if none is repeated.

    ``done`` has (qid, question), ``duplicates`` (qid, n_dup_other, top_sim).
    """
    written = done.where(X.strip(F.coalesce("question", F.lit(""))) != "").select("qid")
    weak = duplicates.where("n_dup_other > 0").groupBy("qid").agg(F.max(F.struct("n_dup_other", "top_sim")).alias("w"))
    out = slots.join(written, "qid", "left_anti").join(weak, "qid", "left")
    return out.select(*slots.columns, F.col("w.n_dup_other").alias("n_dup"), F.col("w.top_sim").alias("top_sim"))


def evidence(gold: DataFrame, units: DataFrame, cap: int = 8000) -> DataFrame:
    """(qid, gold_evidence): evidence objects of a question's units, in unit order."""
    locator = F.map_filter(F.create_map(F.lit("조"), F.when(F.coalesce("jo_branch", F.lit(0)) > 0, F.concat(F.col("jo").cast("string"), F.lit("의"), F.col("jo_branch").cast("string"))).otherwise(F.col("jo").cast("string")), F.lit("항"), F.col("hang").cast("string"), F.lit("호"), F.col("ho").cast("string"), F.lit("목"), F.col("mok")), lambda k, v: v.isNotNull())
    o = F.struct("unit_id", "doc_id", locator.alias("locator"), F.substring("text", 1, cap).alias("text_span"), "necessity")
    return gold.join(units, "unit_id").groupBy("qid").agg(F.array_sort(F.collect_list(o), lambda a, b: F.when(a["unit_id"] < b["unit_id"], -1).when(a["unit_id"] > b["unit_id"], 1).otherwise(0)).alias("gold_evidence"))


def required_units(slots: DataFrame) -> DataFrame:
    """(qid, unit): the units marked required, or all where none is."""
    g = F.col("gold_evidence")
    must = F.filter(g, lambda x: x["necessity"] == "required")
    return slots.select("qid", F.explode(F.array_distinct(F.transform(F.when(F.size(must) > 0, must).otherwise(g), lambda x: x["unit_id"]))).alias("unit"))

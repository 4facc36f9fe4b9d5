r"""Column expressions over text: normalisers, tokenisers, legal-document numbering, answer parsing.

All are built-in expressions, so they stay inside whole-stage codegen.  Regular
expressions use explicit Unicode classes: Java's ``\s``, ``\w`` and ``\d`` are ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Circled digits, sub-item order, and the space class of the normalisers.
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳㉑㉒㉓㉔㉕㉖㉗㉘㉙㉚"
SUB_ITEMS = "가나다라마바사아자차카타파하거너더러머버서어저처커터퍼허"
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
ARTICLE = r"제?\s*(\d{1,3})\s*조(?:\s*의\s*(\d{1,2}))?"


def let(value: Column, body) -> Column:
    """body(value), with the value computed once a row: an inlined expression would be evaluated per element inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def replace(c: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(c, pattern, by)


def strip(c: Column) -> Column:
    """Trim white space of all kinds, not only blanks."""
    return replace(replace(c, f"^{SPACE}+", ""), f"{SPACE}+$", "")


def name_key(c: Column) -> Column:
    """Comparison key of a document name: without middle dots, white space and parentheses."""
    return replace(c, f"[ㆍ·・()]|{SPACE}")


def name_key_strict(c: Column) -> Column:
    """As name_key, and without quotation brackets."""
    return replace(c, f"[ㆍ·・()「」『』\\[\\]<>]|{SPACE}")


def name_key_no_agency(c: Column) -> Column:
    """As name_key_strict, after a leading "(agency)" is dropped."""
    return name_key_strict(replace(c, f"^{SPACE}*\\([^)]*\\)"))


def collapse(c: Column) -> Column:
    """Runs of white space to one blank, ends trimmed."""
    return F.trim(replace(c, f"{SPACE}+", " "))


def without_amendments(c: Column) -> Column:
    """Without amendment tags and white space."""
    return replace(replace(c, r"<(?:개정|신설|삭제)[^>]*>", " "), f"{SPACE}+")


def comparable(c: Column) -> Column:
    """Without any tag, one kind of middle dot, no white space."""
    return replace(F.translate(replace(c, r"<[^>]*>", " "), "ㆍ", "·"), f"{SPACE}+")


def answer_key(c: Column) -> Column:
    """As comparable, with circled digits up to fifteen and the wide comma in plain form."""
    c = replace(F.coalesce(c, F.lit("")), r"<[^>]*>", " ")
    c = F.translate(c, CIRCLED[:9] + "ㆍ，", "123456789·,")
    for i in range(9, 15):
        c = F.replace(c, F.lit(CIRCLED[i]), F.lit(str(i + 1)))
    return replace(c, f"{SPACE}+")


#: Tiers by suffix, most specific first ("훈령" ends in "령" too).
TIERS = (("T4_행정규칙", r"(?:훈령|예규|고시|지침|규정|기준|세칙|조건|표준)$"), ("T3_부령", r"(?:시행규칙|규칙)$"), ("T2_대통령령", r"(?:시행령|령)$"), ("T1_법률", r"(?:법률|법)$"))


def tier_of(name: Column) -> Column:
    out = F.lit("UNK")
    for tier, suffix in reversed(TIERS):
        out = F.when(strip(name).rlike(suffix), tier).otherwise(out)
    return out


def first_hint(name: Column, hints: list[tuple[str, str]], otherwise: str = "unknown") -> Column:
    """Value of the first hint (text, value) that the name contains."""
    out = F.lit(otherwise)
    for text, value in reversed(hints):
        out = F.when(name.contains(text), value).otherwise(out)
    return out


def decide(tests: list[tuple[Column, str]], otherwise: str) -> Column:
    """Ordered decision list: value of the first test that holds."""
    out = F.lit(otherwise)
    for test, value in reversed(tests):
        out = F.when(test, value).otherwise(out)
    return out


#: References that are no names.
NOISE_KEYS = ("같은법", "이법", "동법", "본법", "해당법률", "이규정", "같은규정", "이훈령", "같은훈령", "이지침", "같은영", "같은시행령", "이기준", "같은규칙", "이세칙", "해당법령", "관계법령", "법령")
NOISE_POINTER = r"^(?:같은|이|동|본|해당|위|당해|전기|후기)\s*(?:법률|법|령|영|규정|규칙|훈령|예규|고시|지침|기준|세칙|조항|법령|조|항|호|목)(?:\s*(?:시행령|시행규칙|시행세칙))?$"
LEGAL_SUFFIX = r"(?:법|법률|령|규칙|규정|훈령|예규|고시|지침|기준|세칙|조건|표준|조약|협정|헌법)$"
SUFFIXES = ("시행규칙", "시행령", "시행세칙", "시행규정", "施行令")


def is_noise(name: Column) -> Column:
    key, bare = name_key(name), strip(name)
    certain = key.isin(*NOISE_KEYS) | bare.rlike(r"^[제\d조항호목의\s]+$") | bare.rlike(NOISE_POINTER)
    return certain | (~key.rlike(LEGAL_SUFFIX) & (F.length(key) <= 2))


def parent_name(name: Column) -> Column:
    """The name without its enforcement suffix; null if there is none or too little would be left."""
    out = F.lit(None).cast("string")
    for s in reversed(SUFFIXES):
        out = F.when(name.endswith(s) & (F.length(name) > len(s) + 2), strip(name.substr(F.lit(1), F.length(name) - len(s)))).otherwise(out)
    return out


def numbers(c: Column, pattern: str = r"\d+") -> Column:
    """All numbers in a text, in order, as array<bigint>."""
    return F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), lambda x: x.cast("bigint"))


def issue_key(c: Column) -> Column:
    """Issue number as an orderable array: '제2023-8호' -> [2023, 8]; nothing -> [0]."""
    found = numbers(F.coalesce(c.cast("string"), F.lit("")))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(0).cast("bigint")))


def code6(number: Column, branch: Column) -> Column:
    """(10, 2) -> '001002'."""
    return F.format_string("%04d%02d", number.cast("int"), F.coalesce(branch.cast("int"), F.lit(0)))


def code6_label(code: Column) -> Column:
    """'002702' -> '27의2', '000500' -> '5'."""
    n, b = F.substring(code, 1, 4).cast("int"), F.substring(code, 5, 2).cast("int")
    return F.concat(n.cast("string"), F.when(b > 0, F.concat(F.lit("의"), b.cast("string"))).otherwise(""))


def parse_number(c: Column) -> Column:
    """struct(number, branch): '9의2.' -> (9, 2), '①' -> (1, 0), nothing -> (0, 0)."""
    c = F.coalesce(c, F.lit(""))
    circled = F.instr(F.lit(CIRCLED), F.substring(strip(c), 1, 1))
    n, b = F.regexp_extract(c, r"(\d+)(?:\s*의\s*(\d+))?", 1), F.regexp_extract(c, r"(\d+)\s*의\s*(\d+)", 2)
    plain = F.when(n != "", n.cast("int")).otherwise(0)
    use = (F.length(strip(c)) > 0) & (circled > 0)
    return F.struct(F.when(use, circled).otherwise(plain).alias("number"), F.when(use | (b == ""), 0).otherwise(b.cast("int")).alias("branch"))


def chunk_id(unit_id: Column) -> Column:
    """First three path segments of a unit id."""
    return F.substring_index(unit_id, ":", 3)


def article_label(number: Column, branch: Column) -> Column:
    return F.concat(F.lit("제"), number.cast("string"), F.lit("조"), F.when(F.coalesce(branch, F.lit(0)) > 0, F.concat(F.lit("의"), branch.cast("string"))).otherwise(""))


def iso_date(c: Column) -> Column:
    """YYYYMMDD -> YYYY-MM-DD; anything else stays."""
    return F.when(c.rlike(r"^\d{8}$"), F.concat_ws("-", F.substring(c, 1, 4), F.substring(c, 5, 2), F.substring(c, 7, 2))).otherwise(c)


def tokens(c: Column) -> Column:
    """Search tokens, lower-cased, repeats kept: article tokens, runs of Hangul, Latin letters or digits; words of over four characters also give their bigrams."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"제\d+조(?:의\d+)?|[가-힣]+|[a-z]+|\d+"), F.lit(0))
    pairs = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: w.substr(i, F.lit(2)))
    return F.flatten(F.transform(words, lambda w: F.when((F.length(w) > 4) & ~w.rlike(r"^(?:제\d|\d)"), F.concat(F.array(w), pairs(w))).otherwise(F.array(w))))


def word_list(c: Column) -> Column:
    """Words in order: what is left between characters that are no letter, digit or underscore."""
    return F.filter(F.split(c, r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def key_terms(c: Column, least: int = 2) -> Column:
    """Distinct words of at least ``least`` characters."""
    return F.filter(F.array_distinct(word_list(F.coalesce(c, F.lit("")))), lambda w: F.length(w) >= least)


def word_shingles(words: Column, n: int = 5) -> Column:
    """Runs of n words joined by a blank; none where there are fewer."""

    def runs(w: Column) -> Column:
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), " "))

    return let(words, runs)


def char_grams(c: Column, n: int = 4) -> Column:
    """Character n-grams; none where the text is shorter (sequence would count down)."""

    def grams(t: Column) -> Column:
        letters = F.filter(F.split(t, ""), lambda x: x != "")  # an array: a substring of a string is a scan from its start

        def cut(a: Column) -> Column:
            starts = F.when(F.size(a) >= n, F.sequence(F.lit(1), F.size(a) - n + 1)).otherwise(F.array().cast("array<int>"))
            return F.transform(starts, lambda i: F.array_join(F.slice(a, i, n), ""))

        return let(letters, cut)

    return let(c, grams)


def dedup_parts(parts: Column) -> Column:
    """Fragments in order, each only if its white-space-free form is not yet contained in what was kept."""
    start = F.struct(F.lit("").alias("flat"), F.array().cast("array<string>").alias("kept"))

    def add(acc: Column, x: Column) -> Column:
        flat = replace(x, f"{SPACE}+")
        grown = F.struct(F.concat(acc["flat"], flat).alias("flat"), F.concat(acc["kept"], F.array(x)).alias("kept"))
        return F.when((flat == "") | acc["flat"].contains(flat), acc).otherwise(grown)

    return F.aggregate(parts, start, add, lambda acc: acc["kept"])


def in_sequence(candidates: Column, number: str = "number") -> Column:
    """Of candidates with a number field, those that continue 1, 2, 3, ... greedily."""
    kind = "array<struct<number:int,at:int>>"
    start = F.struct(F.lit(1).alias("next"), F.array().cast(kind).alias("kept"))

    def add(acc: Column, x: Column) -> Column:
        taken = F.struct((acc["next"] + 1).alias("next"), F.concat(acc["kept"], F.array(x)).alias("kept"))
        return F.when(x[number] == acc["next"], taken).otherwise(acc)

    return F.aggregate(candidates, start, add, lambda acc: acc["kept"])


#: Confidence words in order of search, abstention phrases, states in which evidence is present, an echoed template.
CONFIDENCE = ("높음", "중간", "낮음", "모름")
CONFIDENT = ("높음", "중간")
ABSTENTION = ("근거 없", "근거가 없", "확인할 수 없", "알 수 없", "판단할 수 없", "모르", "모름", "해당 없", "정보가 없", "규정되어 있지 않", "명시되어 있지 않", "찾을 수 없")
EVIDENCE = ("full", "partial", "surrogate")
_TEMPLATE = r"[<〈][^>〉]*[|｜][^>〉]*[>〉]"


def parse_answer(raw: Column) -> Column:
    """struct(answer, basis, confidence, conf_parse) of a formatted model answer; each step is computed once a row."""

    def visible(raw: Column) -> Column:
        """What follows an unfinished thought, from its first answer label on."""
        think, at = F.instr(raw, "<think>"), F.instr(raw, "답")
        return replace(F.when((think > 0) & (at > think), F.substring(raw, at, F.length(raw))).otherwise(raw), r"</?think>")

    def fields(raw: Column) -> Column:
        pick = lambda label, rest: strip(F.regexp_extract(raw, rf"(?s){label}\s*[:：]\s*(.+?)(?=\n\s*(?:{rest})|$)", 1))
        answer = F.when(raw.rlike(r"(?s)답\s*[:：]\s*."), pick("답", "근거|확신")).otherwise(strip(raw))
        stated = strip(F.regexp_extract(raw, r"확신도\s*[:：]\s*(.+?)(?=\n|$)", 1))
        return F.struct(answer.alias("answer"), pick("근거", "확신|답").alias("basis"), stated.alias("stated"))

    def judged(f: Column) -> Column:
        echo, word = f["stated"].rlike(_TEMPLATE), decide([(f["stated"].contains(w), w) for w in CONFIDENCE], "")
        why = F.when(echo, "template_echo").when(word != "", "ok").when(f["stated"] == "", "missing").otherwise("unparsed")
        answer = F.when(~echo & f["answer"].rlike(_TEMPLATE), strip(replace(f["answer"], _TEMPLATE))).otherwise(f["answer"])
        return F.struct(answer.alias("answer"), f["basis"].alias("basis"), F.when(echo, "").otherwise(word).alias("confidence"), why.alias("conf_parse"))

    cleaned = strip(replace(F.coalesce(raw, F.lit("")), r"(?s)<think>.*?</think>"))
    return let(let(let(cleaned, visible), fields), judged)


def is_abstention(answer: Column, basis: Column, confidence: Column) -> Column:
    said = F.concat_ws(" ", F.coalesce(answer, F.lit("")), F.coalesce(basis, F.lit("")))
    return said.rlike("|".join(ABSTENTION)) | (F.coalesce(confidence, F.lit("")) == "모름")


def keyword_match(answer: Column, gold: Column) -> Column:
    """'yes', 'no' or 'ambiguous': shared words, and numbers other than article numbers must not contradict."""
    gold, answer = F.coalesce(gold, F.lit("")), F.coalesce(answer, F.lit(""))
    digits = lambda c: F.array_distinct(F.regexp_extract_all(replace(c, ARTICLE, " "), F.lit(r"\d+"), F.lit(0)))
    parts = F.struct(key_terms(gold).alias("want"), key_terms(answer).alias("got"), digits(gold).alias("n"), digits(answer).alias("m"), (gold == "").alias("blank"))

    def verdict(p: Column) -> Column:
        share = F.size(F.array_intersect(p["want"], p["got"])) / F.size(p["want"])
        numeric = F.when(~F.arrays_overlap(p["n"], p["m"]), "no").when(share >= 0.3, "yes").otherwise("ambiguous")
        return F.when(p["blank"] | (F.size(p["want"]) == 0), "ambiguous").when(F.size(p["n"]) > 0, numeric).when(share >= 0.7, "yes").otherwise("ambiguous")

    return let(parts, verdict)


def cited_articles(c: Column) -> Column:
    """Distinct (article, branch) pairs a text cites, as '27-2' strings."""
    c = F.coalesce(c, F.lit(""))
    n = F.regexp_extract_all(c, F.lit(ARTICLE), F.lit(1))
    b = F.regexp_extract_all(c, F.lit(ARTICLE), F.lit(2))
    return F.array_distinct(F.zip_with(n, b, lambda x, y: F.concat(x.cast("int").cast("string"), F.lit("-"), F.when(y == "", "0").otherwise(y.cast("int").cast("string")))))


def citation_ok(basis: Column, gold_articles: Column) -> Column:
    """Does the basis cite a gold article? Null without gold; false if nothing is cited. Gold as '27의2' labels."""
    gold = F.transform(F.filter(gold_articles, lambda g: g.rlike(r"^\d+")), lambda g: F.concat(F.regexp_extract(g, r"^(\d+)", 1).cast("int").cast("string"), F.lit("-"), F.when(F.regexp_extract(g, r"^\d+의(\d+)", 1) == "", "0").otherwise(F.regexp_extract(g, r"^\d+의(\d+)", 1).cast("int").cast("string"))))
    return F.when(F.size(gold_articles) > 0, F.arrays_overlap(cited_articles(basis), gold))


def covers(answer: Column, text: Column, ratio: float = 0.8) -> Column:
    """Does a text hold an answer: contained in normal form, or enough of its tokens are."""
    a, t = answer_key(answer), answer_key(text)
    parts = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"[가-힣]{2,}|[A-Za-z]{2,}|\d+"), F.lit(0))
    held = F.size(F.filter(parts, lambda p: t.contains(p))) / F.size(parts)
    return F.when(a == "", False).when(t.contains(a), True).when(F.size(parts) == 0, False).otherwise(held >= ratio)


#: What counts as an answer-changing signal between two versions of a text.
SIGNALS = {
    "numbers": r"\d[\d,]*\s*(?:일|개월|년|원|만원|억원|퍼센트|%|명|회|건|배|년간|일간)",
    "actors": r"[가-힣]{2,12}(?:국장|본부장|실장|과장|팀장|청장|장관|위원장|담당관|사업부장|기관장)",
    "orgs": r"[가-힣]{2,15}(?:위원회|본부|부서|팀|국|과)(?=[는이가을를에의])",
    "refs": r"제\s*\d{1,3}\s*조(?:\s*의\s*\d{1,2})?",
}
DUTY, CHOICE = r"하여야\s*한다|해야\s*한다", r"할\s*수\s*있다"


def change_signals(old: Column, new: Column, most: int = 8) -> Column:
    """struct per signal of (removed, added), plus modality flips, for two versions of a text."""
    found = lambda c, p: F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(p), F.lit(0)))
    one_way = lambda a, b: F.slice(F.array_sort(F.array_except(a, b)), 1, most)
    fields = []
    for name, p in SIGNALS.items():
        a, b = found(old, p), found(new, p)
        fields.append(F.struct(one_way(a, b).alias("removed"), one_way(b, a).alias("added")).alias(name))
    flip = (old.rlike(DUTY) != new.rlike(DUTY)) | (old.rlike(CHOICE) != new.rlike(CHOICE))
    return F.struct(*fields, F.coalesce(flip, F.lit(False)).alias("modality"))


def safe_name(c: Column) -> Column:
    return replace(c, r"[^\p{L}\p{N}._-]+", "-")


def short_name(c: Column, names: list[tuple[str, str]]) -> Column:
    """First of (part, short) whose part stands in the name, else the name."""
    out = c
    for part, short in reversed(names):
        out = F.when(c.contains(part), short).otherwise(out)
    return out


def path_leaf(c: Column) -> Column:
    """Last path element, whichever slash."""
    return F.element_at(F.split(F.translate(c, "\\", "/"), "/"), -1)


def fingerprint(*columns: Column) -> Column:
    """md5 over the columns, separated by a NUL; null counts as empty."""
    return F.md5(F.concat_ws("\x00", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)))


def condition_parts(c: Column) -> Column:
    """struct(cov, strategy, unit) of a name like cov040_core_doc(.jsonl)."""
    p = r"cov(\d+)_([^_]+?)_(\w+?)(?:\.jsonl)?$"
    return F.struct(F.regexp_extract(c, p, 1).cast("int").alias("cov"), F.regexp_extract(c, p, 2).alias("strategy"), F.regexp_extract(c, p, 3).alias("unit"))


def min_max(x: Column, over) -> Column:
    """(x - min) / (max - min) over a window; 0 where all are equal."""
    low, high = F.min(x).over(over), F.max(x).over(over)
    return F.when(high - low < 1e-9, 0.0).otherwise((x - low) / (high - low))


def share(k: Column, n: Column, digits: int | None = None) -> Column:
    """k / n, null at n = 0; with digits rounded half to even."""
    out = F.when(n > 0, k / n)
    return out if digits is None else F.bround(out, digits)


def model_matches(c: Column, key: str) -> Column:
    """Does a model name hold a key that no letter or digit precedes: '4b' is in 'qwen3:4b', not in 'qwen3:14b'."""
    return F.lower(c).rlike(f"(?<![0-9a-z])\\Q{key.lower()}\\E")


def paragraph_number(field: Column, text: Column, position: Column) -> Column:
    """A paragraph's number: from its field, else from a leading circled digit, else its position."""
    n, circled = parse_number(field)["number"], F.instr(F.lit(CIRCLED), F.substring(strip(text), 1, 1))
    return F.when(n > 0, n).when((F.length(strip(text)) > 0) & (circled > 0), circled).otherwise(position)

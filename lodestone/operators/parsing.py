"""Hierarchical parsing: articles into paragraphs, items and sub-items, as expressions over arrays.

Markers are found, filtered to those that continue 1, 2, 3, ... and the text is
cut between them; a leading part without a marker has number 0.  An item's
branch number never moves the sequence on, so `9의2.` after `9.` stays in item 9.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as X

#: How headers, articles, deletions and application clauses are written, and the tier of each kind of statute.
HEADER = r"^\s*제\s*\d+\s*[편장절관]\s"
ARTICLE_HEAD = r"^\s*제\s*(\d+)\s*조(?:\s*의\s*(\d+))?\s*(?:\(([^)]{0,80})\))?"
DELETED = r"<\s*삭\s*제\s*>"
CHAPTER = r"^\s*제\s*\d+\s*[편장]"
APPLICATION = ("적용례", "경과조치", "경과규정", "특례", "유효기간", "재검토")


def _markers(body: Column, pattern: str, number) -> Column:
    """Candidates struct(number, at) of all matches, at being the match's 1-based place.

    The text is split by the pattern; places follow from the lengths of what stands between.
    """
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<number:int,at:int>>").alias("kept"))

    def step(acc: Column, s: Column) -> Column:
        at = acc["at"] + s["gap"]
        return F.struct((at + s["own"]).alias("at"), F.concat(acc["kept"], F.array(F.struct(s["number"].alias("number"), at.alias("at")))).alias("kept"))

    def placed(found: Column) -> Column:
        between = F.slice(F.split(body, pattern), 1, F.size(found))
        steps = F.zip_with(found, between, lambda m, gap: F.struct(F.length(gap).alias("gap"), F.length(m).alias("own"), number(m).cast("int").alias("number")))
        return F.aggregate(steps, start, step, lambda acc: acc["kept"])

    return X.let(F.regexp_extract_all(body, F.lit(f"({pattern})"), F.lit(1)), placed)


def _cut(body: Column, pattern: str, number) -> Column:
    """array<struct(number, text)>: the body cut at its sequential markers, each step computed once."""

    def cut(body: Column, marks: Column) -> Column:
        stops = F.concat(F.transform(F.slice(marks, 2, F.greatest(F.size(marks) - 1, F.lit(0))), lambda m: m["at"]), F.array(F.length(body) + 1))
        pieces = F.zip_with(marks, stops, lambda m, stop: F.struct(m["number"].alias("number"), X.strip(F.substring(body, m["at"], stop - m["at"])).alias("text")))
        none = F.struct(F.lit(0).alias("number"), X.strip(body).alias("text"))
        lead = lambda head: F.when(head != "", F.array(F.struct(F.lit(0).alias("number"), head.alias("text")))).otherwise(F.array().cast("array<struct<number:int,text:string>>"))
        head = X.strip(F.substring(body, F.lit(1), F.try_element_at(marks, F.lit(1))["at"] - 1))
        return F.when(F.size(marks) == 0, F.array(none)).otherwise(F.concat(X.let(head, lead), pieces))

    return X.let(body, lambda b: X.let(X.in_sequence(_markers(b, pattern, number)), lambda marks: cut(b, marks)))


def paragraphs(body: Column) -> Column:
    return _cut(body, f"[{X.CIRCLED}]", lambda m: F.instr(F.lit(X.CIRCLED), m))


def items(body: Column) -> Column:
    return _cut(body, r"\d{1,3}(?:\s*의\s*\d{1,2})?\.\s", lambda m: F.regexp_extract(m, r"^(\d+)", 1))


def sub_items(body: Column) -> Column:
    return _cut(body, r"[가-힣]\.\s", lambda m: F.instr(F.lit(X.SUB_ITEMS), F.substring(m, 1, 1)))


def article_head(line: Column) -> Column:
    """struct(number, branch, title); number null if the line heads no article."""
    n, b = F.regexp_extract(line, ARTICLE_HEAD, 1), F.regexp_extract(line, ARTICLE_HEAD, 2)
    return F.struct(F.when(n != "", n.cast("int")).alias("number"), F.when(b != "", b.cast("int")).otherwise(0).alias("branch"), F.regexp_extract(line, ARTICLE_HEAD, 3).alias("title"))


def is_deleted(c: Column, statute: bool = False) -> Column:
    """Deletion mark; statutes write it without brackets, near the start of a short text."""
    return (F.substring(c, 1, 40).contains("삭제") & (F.length(c) < 60)) if statute else c.rlike(DELETED)


def parse_units(articles: DataFrame) -> DataFrame:
    """Rows (doc_id, pos, text) of articles and headers -> units: article, paragraph, item and sub-item rows.

    Columns: unit_id, parent_id, level, doc_id, pos, chapter, section, jo, jo_branch, jo_title, hang, ho, ho_branch, mok, text,
    char_len, deleted.  Headers apply to the articles after them, and a part or chapter ends the section before it.
    Deleted articles are not opened.  A unit_id that comes again gets ~2, ~3, ... in order; lines that are no article are left out.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    head, part = F.col("text").rlike(HEADER), F.col("text").rlike(CHAPTER)
    line = X.strip(F.col("text"))
    rows = articles.withColumn("chapter", F.coalesce(F.last(F.when(head & part, line), ignorenulls=True).over(w), F.lit("")))
    rows = rows.withColumn("section", F.coalesce(F.last(F.when(head, F.when(part, "").otherwise(line)), ignorenulls=True).over(w), F.lit(""))).where(~head)
    found = F.struct(article_head(F.col("text")).alias("h"), is_deleted(F.col("text")).alias("deleted"))
    rows = rows.withColumn("text", line).select("doc_id", "pos", "chapter", "section", "text", F.inline(F.array(found))).where("h.number is not null")
    rows = rows.withColumn("jo_id", F.concat_ws(":", F.lit("rule"), "doc_id", X.code6(F.col("h.number"), F.col("h.branch"))))
    body = X.strip(F.regexp_replace("text", ARTICLE_HEAD, ""))
    pos, jo_id = F.col("pos"), F.col("jo_id")

    def unit(level: str, uid: Column, parent: Column | None, text: Column, place: list[Column], hang: Column | None = None, ho: Column | None = None, branch: Column | None = None, mok: Column | None = None, deleted: Column | None = None) -> Column:
        known = {"unit_id": uid, "parent_id": parent, "level": F.lit(level), "hang": hang, "ho": ho, "ho_branch": branch, "mok": mok, "text": text, "deleted": deleted}
        kinds = {"hang": "int", "ho": "int", "ho_branch": "int", "deleted": "boolean"}
        fields = [(F.lit(None) if v is None else v).cast(kinds.get(k, "string")).alias(k) for k, v in known.items()]
        return F.array(F.struct(*fields, F.array(*(p.cast("int") for p in (pos, *place))).alias("_order")))

    none = F.array().cast("array<struct<unit_id:string,parent_id:string,level:string,hang:int,ho:int,ho_branch:int,mok:string,text:string,deleted:boolean,_order:array<int>>>")
    live, flat = F.lit(False), lambda parts, f: F.flatten(F.transform(parts, f))

    def paragraph(hp: Column, i: Column) -> Column:
        def opened(hang_id: Column) -> Column:
            def item(op: Column, j: Column) -> Column:
                branch = F.regexp_extract(op["text"], r"^\d{1,3}\s*의\s*(\d{1,2})\.", 1)

                def numbered(ho_branch: Column) -> Column:
                    def named(ho_id: Column) -> Column:
                        def sub_item(mp: Column, k: Column) -> Column:
                            letter = F.substring(F.lit(X.SUB_ITEMS), mp["number"], F.lit(1))
                            return F.when(mp["number"] > 0, unit("mok", F.concat_ws(":", ho_id, letter), ho_id, mp["text"], [i, j, k], hp["number"], op["number"], ho_branch, letter, live)).otherwise(none)

                        below = sub_items(F.regexp_replace(op["text"], r"^\d{1,3}(?:\s*의\s*\d{1,2})?\.\s", ""))
                        return F.concat(unit("ho", ho_id, hang_id, op["text"], [i, j], hp["number"], op["number"], ho_branch, None, live), flat(below, sub_item))

                    return X.let(F.concat_ws(":", hang_id, X.code6(op["number"], ho_branch)), named)

                return F.when(op["number"] > 0, X.let(F.when(branch != "", branch.cast("int")).otherwise(0), numbered)).otherwise(none)

            own = F.when(hp["number"] > 0, unit("hang", hang_id, jo_id, hp["text"], [i], hp["number"], deleted=live)).otherwise(none)
            return F.concat(own, flat(items(hp["text"]), item))

        return X.let(F.concat_ws(":", jo_id, X.code6(hp["number"], F.lit(0))), opened)

    # one pass: an article's units are one array, so neither the articles nor their parts are computed again for each level
    own = unit("jo", jo_id, None, F.col("text"), [], deleted=F.col("deleted"))
    units = F.concat(own, F.when(F.col("deleted"), none).otherwise(flat(paragraphs(body), paragraph)))
    c = F.col
    whole = rows.select("doc_id", "pos", "chapter", "section", "h", F.explode(units).alias("u")).select(
        "u.unit_id", "u.parent_id", "u.level", "doc_id", "pos", "chapter", "section", c("h.number").alias("jo"), c("h.branch").alias("jo_branch"), c("h.title").alias("jo_title"),
        "u.hang", "u.ho", "u.ho_branch", "u.mok", "u.text", F.length("u.text").alias("char_len"), "u.deleted", "u._order",
    )
    return numbered_again(whole, "unit_id", ["_order"]).drop("_order")


def numbered_again(units: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Keys made unique: ~2, ~3, ... for those that come again."""
    from lodestone.operators.corpus import unique_keys

    return unique_keys(units, key, order).withColumn(key, F.col("unit_key")).drop("unit_key", "n_collisions").select(units.columns)


def _texts(record: Column, path: str) -> Column:
    """A field that is a text, an array of texts, or missing, as an array."""
    many, one = F.try_variant_get(record, path, "array<string>"), F.try_variant_get(record, path, "string")
    return F.when(F.schema_of_variant(F.try_variant_get(record, path, "variant")).startswith("ARRAY"), many).when(one.isNotNull(), F.array(one)).otherwise(F.array().cast("array<string>"))


def _objects(record: Column, path: str) -> Column:
    """A field that is an object, an array of them, or missing, as an array."""
    one = F.try_variant_get(record, path, "variant")
    return F.coalesce(F.try_variant_get(record, path, "array<variant>"), F.when(one.isNotNull(), F.array(one)), F.array().cast("array<variant>"))


#: Fields of a rule record, by what they are called here.
RULE_FIELDS = {"doc_id": "행정규칙일련번호", "doc_name": "행정규칙명", "doc_type": "행정규칙종류", "rule_id": "행정규칙ID", "issue_no": "발령번호", "effective_date": "시행일자", "ministry": "소관부처명", "jo_format": "조문형식여부"}
ANNEX_CAP = 20_000


def rule_units(records: DataFrame) -> DataFrame:
    """Units of raw rule records (file, pos, record): articles and below, supplements and annexes, with the record's metadata.

    A supplement has its promulgation number and date, an annex its title, number and kind and at most ANNEX_CAP characters.
    Of records with the same id all are kept; ``first_per_key`` before it keeps the first.
    """
    whole = F.try_parse_json("record")
    v = F.coalesce(F.try_variant_get(whole, "$.AdmRulService", "variant"), whole)
    docs = records.select(v.alias("v")).select("v", *(F.coalesce(F.try_variant_get("v", f"$.행정규칙기본정보.{name}", "string"), F.lit("")).alias(c) for c, name in RULE_FIELDS.items()))
    meta = list(RULE_FIELDS)
    articles = docs.select("doc_id", F.posexplode(_texts(F.col("v"), "$.조문내용")).alias("pos", "text")).where(X.strip(F.col("text")) != "")
    units = parse_units(articles)
    extra = {c: F.lit(None).cast("string") for c in ("promulgation_no", "promulgation_date", "byeolpyo_title", "byeolpyo_no", "byeolpyo_gubun")}
    empty = {c: F.lit(None).cast(units.schema[c].dataType) for c in units.columns}

    def shape(df: DataFrame, **own: Column) -> DataFrame:
        text = own["text"]
        known = empty | {"doc_id": F.col("doc_id"), "pos": F.col("i"), "chapter": F.lit(""), "section": F.lit(""), "char_len": F.length(text), "deleted": F.lit(False)} | extra | own
        return df.select(*(known[c].alias(c) for c in (*units.columns, *extra)))

    field = lambda name: _texts(F.col("v"), f"$.부칙.{name}")
    rows = docs.select("doc_id", field("부칙공포번호").alias("nos"), field("부칙공포일자").alias("dates"), F.posexplode(field("부칙내용")).alias("i", "t"))
    no, date = F.coalesce(F.get("nos", F.col("i")), F.col("i").cast("string")), F.coalesce(F.get("dates", F.col("i")), F.lit(""))
    supplements = shape(rows, unit_id=F.format_string("rule:%s:buchik:%03d:%s", "doc_id", "i", no), level=F.lit("buchik"), text=F.coalesce("t", F.lit("")), promulgation_no=no, promulgation_date=date)
    rows = docs.select("doc_id", F.posexplode(_objects(F.col("v"), "$.별표.별표단위")).alias("i", "b"))
    get = lambda name, otherwise="": F.coalesce(F.try_variant_get("b", f"$.{name}", "string"), F.lit(otherwise))
    kind, body = get("별표구분", "별표"), F.array_join(_texts(F.col("b"), "$.별표내용"), "\n")
    annexes = shape(rows, unit_id=F.format_string("rule:%s:byeolpyo:%03d:%s:%s", "doc_id", "i", kind, get("별표키")), level=F.lit("byeolpyo"), text=F.substring(body, 1, ANNEX_CAP), deleted=F.substring(body, 1, 200).rlike(DELETED), byeolpyo_title=get("별표제목"), byeolpyo_no=get("별표번호"), byeolpyo_gubun=kind)
    out = units.withColumns(extra).unionByName(supplements).unionByName(annexes).withColumn("tier", F.lit("T4_행정규칙"))
    return out.join(docs.select(*meta).dropDuplicates(["doc_id"]), "doc_id")


#: The levels below an article in a statute record, with the names of their list, number and text; kinds of statute.
STATUTE_LEVELS = (("hang", "항", "항번호", "항내용"), ("ho", "호", "호번호", "호내용"), ("mok", "목", "목번호", "목내용"))
STATUTE_TIERS = {"법률": "T1_법률", "대통령령": "T2_대통령령", "총리령": "T3_부령", "부령": "T3_부령"}
STATUTE_COLUMNS = "unit_id string, parent_id string, level string, tier string, doc_id string, doc_name string, doc_type string, issue_no string, effective_date string, ministry string, chapter string, jo int, jo_branch int, jo_title string, hang int, ho int, ho_branch int, mok string, text string, char_len int, deleted boolean, jo_effective string, jo_changed string, jo_revision_type string, promulgation_no string, promulgation_date string, seq int"


def lines_of(x: object) -> str:
    """All text of any nesting of lists and objects, a line each; what is blank is left out."""
    if isinstance(x, dict):
        x = list(x.values())
    if isinstance(x, list):
        return "\n".join(t for t in map(lines_of, x) if t.strip())
    return "" if x is None else str(x)


def number_of(x: object) -> tuple[int, int]:
    """'9의2.' -> (9, 2), '①' -> (1, 0), nothing -> (0, 0)."""
    text = str(x or "").strip()
    if text and text[0] in X.CIRCLED:
        return X.CIRCLED.index(text[0]) + 1, 0
    m = re.search(r"(\d+)(?:\s*의\s*(\d+))?", text)
    return (int(m[1]), int(m[2] or 0)) if m else (0, 0)


def _as_list(x: object) -> list:
    return [] if x is None else x if isinstance(x, list) else [x]


def _word(x: object) -> str:
    """A field that is a text or an object with a content."""
    return str((x.get("content") if isinstance(x, dict) else x) or "")


class _Statute:
    """One record's units, depth first."""

    def __init__(self, record: dict):
        inner = [v for v in record.values() if isinstance(v, dict)]
        self.body = record if "기본정보" in record or not inner else inner[0]
        info = self.body.get("기본정보") or {}
        kind = _word(info.get("법종구분"))
        self.own = {"doc_id": str(info.get("법령ID") or ""), "doc_name": str(info.get("법령명_한글") or ""), "doc_type": kind, "issue_no": str(info.get("공포번호") or ""), "effective_date": str(info.get("시행일자") or ""), "ministry": _word(info.get("소관부처"))}
        self.own["tier"] = STATUTE_TIERS.get(kind, "T3_부령" if "령" in kind else "T1_법률")
        self.root, self.chapter, self.rows = f"law:{self.own['doc_id']}", "", []

    def put(self, level: str, path: tuple[str, ...], text: str, deleted: bool = False, **fields: object) -> None:
        above = ":".join((self.root, *path[:-1])) if level in ("hang", "ho", "mok") else ""
        self.rows.append(self.own | {"unit_id": ":".join((self.root, *path)), "parent_id": above, "level": level, "chapter": self.chapter, "text": text, "char_len": len(text), "deleted": deleted, "seq": len(self.rows)} | fields)

    def units(self) -> list[dict]:
        for article in _as_list((self.body.get("조문") or {}).get("조문단위")):
            if isinstance(article, dict):
                self.article(article)
        supplement = self.body.get("부칙")
        for i, b in enumerate(_as_list(supplement.get("부칙단위") if isinstance(supplement, dict) else None)):
            if isinstance(b, dict):
                self.put("buchik", ("buchik", f"{i:03d}"), lines_of(b.get("부칙내용")), promulgation_no=str(b.get("부칙공포번호") or ""), promulgation_date=str(b.get("부칙공포일자") or ""))
        return self.rows

    def article(self, a: dict) -> None:
        text = lines_of(a.get("조문내용"))
        if str(a.get("조문여부", "조문")) != "조문":  # a header: for what follows
            self.chapter = text
            return
        number, branch = (int(str(a.get(k) or 0) or 0) for k in ("조문번호", "조문가지번호"))
        path, gone = (f"{number:04d}{branch:02d}",), "삭제" in text[:40] and len(text) < 60
        fields = {"jo": number, "jo_branch": branch, "jo_title": str(a.get("조문제목") or "")}
        self.put("jo", path, text, gone, **fields, jo_effective=str(a.get("조문시행일자") or ""), jo_changed=str(a.get("조문변경여부") or ""), jo_revision_type=str(a.get("조문제개정유형") or ""))
        if not gone:
            self.below(a, 0, path, fields)

    def below(self, node: dict, depth: int, path: tuple[str, ...], fields: dict) -> None:
        level, children, number_key, text_key = STATUTE_LEVELS[depth]
        kids = [k for k in _as_list(node.get(children)) if isinstance(k, dict)]
        for place, kid in enumerate(kids, 1):
            text = lines_of(kid.get(text_key))
            if level == "mok":
                label = str(kid.get(number_key) or "").strip().rstrip(".")
                if label:
                    self.put(level, (*path, label), text, **fields, mok=label)
                continue
            number, branch = number_of(kid.get(number_key))
            if level == "hang":  # by its field, else by its text's first mark, else by its place
                number, branch = number or number_of(text[:4])[0] or (place if len(kids) > 1 else 0), 0
            elif not number:
                continue
            inner, own = (*path, f"{number:04d}{branch:02d}"), fields | ({"hang": number} if level == "hang" else {"ho": number, "ho_branch": branch})
            if number:
                self.put(level, inner, text, **own)
            if depth + 1 < len(STATUTE_LEVELS):
                self.below(kid, depth + 1, inner, own)


#: Units of statute records that are handed on at a time.
HANDED = 8192


def statute_units(records: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Units of raw statute records (file, pos, record), with metadata (all of it, or ``columns``); keys that come again within a record get ~2, ~3, ...

    Records are trees of mixed types (an object or a list of them, a text or nested lists), so they are walked in Python, and
    units of many records leave together.  A record that is no JSON object gives no units.
    """
    declared = [tuple(f.split()) for f in STATUTE_COLUMNS.split(", ")] + [("file", "string"), ("pos", "int")]
    kinds = {n: k for n, k in declared if columns is None or n in columns}
    arrow = {"int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(units: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([u.get(n) for u in units], arrow[k]) for n, k in kinds.items()], names=list(kinds))

        units: list[dict] = []
        for batch in batches:
            for file, pos, text in zip(*(batch.column(c).to_pylist() for c in ("file", "pos", "record")), strict=True):
                try:
                    record = json.loads(text or "null")
                except ValueError:
                    continue
                seen: dict[str, int] = {}
                for unit in _Statute(record).units() if isinstance(record, dict) else []:
                    key = unit["unit_id"]
                    seen[key] = n = seen.get(key, 0) + 1
                    if n > 1:
                        unit["unit_id"] = f"{key}~{n}"
                    unit["file"], unit["pos"] = file, pos
                    units.append(unit)
                if len(units) >= HANDED:
                    yield told(units)
                    units = []
        yield told(units)

    found = records.select("file", F.col("pos").cast("int").alias("pos"), "record").mapInArrow(run, ", ".join(map(" ".join, kinds.items())))
    return found if columns is None else found.select(*columns)


def application_clauses(texts: DataFrame, cap: int = 600) -> DataFrame:
    """(doc_id, art_no, title, text) of supplement articles whose title names an application rule; text up to the next article."""
    head = r"제\d{1,2}조\([^)]{2,40}\)"
    heads = F.regexp_extract_all("text", F.lit(f"({head})"), F.lit(1))
    bodies = F.slice(F.split("text", head), 2, F.size(heads))
    rows = texts.select("doc_id", F.explode(F.arrays_zip(heads.alias("h"), bodies.alias("b"))).alias("z"))
    title = F.regexp_extract("z.h", r"\(([^)]+)\)", 1)
    return rows.select("doc_id", F.regexp_extract("z.h", r"제(\d+)조", 1).alias("art_no"), title.alias("title"), F.substring(F.concat("z.h", "z.b"), 1, cap).alias("text")).where(F.col("title").rlike("|".join(APPLICATION)))


def zipped(df: DataFrame, key: str, *arrays: str) -> DataFrame:
    """Parallel arrays to rows (key, pos, one column an array); shorter arrays give nulls."""
    return df.select(key, F.posexplode(F.arrays_zip(*arrays)).alias("pos", "z")).select(key, "pos", *(F.col("z")[a].alias(a) for a in arrays))


def as_list(value: Column, element: str) -> Column:
    """A JSON value that is an object, an array of such, or missing -> array."""
    one, many = F.from_json(value, element), F.from_json(value, f"array<{element}>")
    return F.when(F.trim(value).startswith("["), many).when(value.isNotNull(), F.array(one)).otherwise(many)


def flatten_json(value: Column) -> Column:
    """All string leaves of any nesting, in order, a line each; escapes are resolved."""
    leaves = F.regexp_extract_all(value, F.lit(r'(?<=[\[,:\s{])\s*"((?:[^"\\]|\\.)*)"(?!\s*:)|^\s*"((?:[^"\\]|\\.)*)"\s*$'), F.lit(0))
    return F.array_join(F.from_json(F.concat(F.lit("["), F.array_join(F.transform(leaves, lambda s: F.trim(s)), ","), F.lit("]")), "array<string>"), "\n")

"""URL rules, indexed by each rule's rarest literal token.

A rule is either a host-and-path rule (`net/`, `example.net/en/`) or a regular
expression with the literal tokens that every match contains.  A rule is filed
under its rarest token (by how many URLs hold it; ties: longer, then smaller).
A URL is cut into tokens, the tokens fetch candidate rules, and only those run
their regular expressions.  Of matching host rules the longest decides; else
matching pattern rules block, unless one allows; else the URL is allowed.

A token is a run of letters and digits in folded form: lower-cased, and `ſ`, `ı`, `İ`
and the like brought to the letter that a caseless expression takes them for, so a
match that differs from its literal in case alone still has it as a token.

Rule lists are text: a rule a line, `@@` before allowing ones, `!` before comments,
`||host/path` for host-and-path rules, `/expression/` for regular expressions, whose
literals are found by parsing them, and anything else a word between delimiters.

Defined results: a null URL, or one without `://`, has empty host and path and
is allowed unless a rule matches the empty strings.  Rows are judged one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property, lru_cache
from re import _parser as sre_parse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_LIMIT

_TOKEN = re.compile(r"[^\W_]+")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@lru_cache(maxsize=1)
def _folds() -> dict[int, str]:
    """Letters that a caseless expression takes for another letter, which lower() does not give."""
    out = {}
    for code in range(128, 0x1F000):
        c = chr(code)
        if c.isalpha():
            low = c.lower()
            for plain in sorted({low[0], c.upper()[0].lower()[0]}):
                if plain != low and re.fullmatch(plain, c, re.IGNORECASE):
                    out[code] = plain
    return out


def fold(text: str) -> str:
    """Lower-cased, and one form for letters that caseless expressions do not tell apart; the length stays."""
    if text.isascii():
        return text.lower()
    folds = _folds()
    return "".join(folds.get(ord(c)) or c.lower()[0] for c in text)


def tokens_of(text: str) -> list[str]:
    return _TOKEN.findall(fold(text))


def literals_of(pattern: str) -> tuple[str, ...]:
    """Whole tokens of every match of a regular expression, by parsing it: runs of plain characters on the top
    level that something else than a letter or digit, or an assertion of a border, ends on both sides.
    """
    tree, runs, run = sre_parse.parse(pattern), [], ""
    left = False  # does the run begin at a border of tokens?
    edge = sre_parse.parse(r"(?<![^\W_])")[0], sre_parse.parse(r"(?![^\W_])")[0]

    def border(item) -> bool:
        if item[0] is sre_parse.IN:  # a class of other characters only
            return all(op is sre_parse.LITERAL and not _TOKEN.fullmatch(chr(x)) for op, x in item[1])
        return str(item) in (str(edge[0]), str(edge[1])) or item[0] is sre_parse.AT and item[1] is not sre_parse.AT_NON_BOUNDARY

    for item in [*tree, None]:
        if item is not None and item[0] is sre_parse.LITERAL:
            c = chr(item[1])
            if _TOKEN.fullmatch(c):
                run += c
                continue
            if run and left:
                runs.append(run)
            run, left = "", True
            continue
        # \b, ^ and $ are borders of tokens but for `_`, which is none of a token's characters and so a border too
        if run and left and item is not None and border(item):
            runs.append(run)
        run, left = "", item is not None and border(item)
    return tuple(fold(x) for x in runs)


@dataclass(frozen=True)
class Rule:
    """``pattern`` searches host + path; ``literals`` are whole tokens of every match."""

    name: str
    verdict: str
    pattern: str
    literals: tuple[str, ...]
    host_rule: bool = False

    @cached_property
    def compiled(self) -> re.Pattern:
        """Compiled when a URL first fetches the rule."""
        return re.compile(self.pattern, re.DOTALL)


def host_rule(name: str, verdict: str) -> Rule:
    """A rule such as `example.net/en/`: its host and all subdomains, paths that start with its path."""
    host, slash, rest = name.partition("/")
    path = slash + rest
    whole = tokens_of(host)
    inner = tokens_of(path)
    if inner and re.search(r"[^\W_]$", path):
        inner = inner[:-1]  # the last token may go on in the URL
    return Rule(name, verdict, rf"\A(?:[^\x00]*\.)?{re.escape(host)}\x00{re.escape(path)}", tuple(whole + inner), True)


def word_rule(word: str, verdict: str = "block") -> Rule:
    """Blocks URLs that hold the word, or hyphenated words, between delimiters."""
    return Rule(word, verdict, rf"(?i)(?<![^\W_]){re.escape(word)}(?![^\W_])", tuple(tokens_of(word)))


def pattern_rule(name: str, verdict: str, pattern: str) -> Rule:
    """A caseless regular expression over host, NUL and path; its literals are found in it."""
    return Rule(name, verdict, f"(?i){pattern}", literals_of(pattern))


def read_rules(lines: Iterable[str]) -> list[Rule]:
    """Rules of a list, in order; blank lines and comments are left out. A broken expression raises with its line."""
    out = []
    for i, line in enumerate(lines, 1):
        line = line.strip()
        if not line or line.startswith("!"):
            continue
        verdict, body = ("allow", line[2:]) if line.startswith("@@") else ("block", line)
        try:
            if body.startswith("||"):
                out.append(host_rule(body[2:], verdict))
            elif len(body) > 1 and body.startswith("/") and body.endswith("/"):
                re.compile(body[1:-1])
                out.append(pattern_rule(body, verdict, body[1:-1]))
            else:
                out.append(word_rule(body, verdict))
        except re.error as e:
            raise ValueError(f"line {i}: {e}") from e
    return out


def rules_from(spark: SparkSession, path: str) -> list[Rule]:
    """Rules of a text file, or of a folder of them in order of their names, wherever Spark can read."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value").orderBy("file").collect()
    return [rule for r in rows for rule in read_rules(r["value"].splitlines())]


#: The contract's rules.
CONTRACT_RULES = (host_rule("net/", "block"), host_rule("example.net/en/", "allow"), host_rule("example.com/de/", "block"), host_rule("org/fr/", "allow"))
#: The method's own rules for URLs that no host rule decides.
PATTERN_RULES = (
    *map(word_rule, ("spam", "spam-farm", "cheap-pills", "casino", "porn", "xxx", "viagra", "torrent", "malware", "phishing", "adserver", "doubleclick")),
    Rule("click-tracker", "block", r"(?i)(?<![^\W_])redirect(?![^\W_])[^\x00]*\x00.*[?&]?(?<![^\W_])click(?![^\W_])", ("redirect", "click")),
)


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end; A-Z lower-cased only."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(raw, _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


class RuleIndex:
    """Rules under their rarest literal; rules without a literal are always tried."""

    def __init__(self, rules: Sequence[Rule], frequency: dict[str, int]):
        self.by_token: dict[str, list[Rule]] = {}
        self.always: list[Rule] = []
        for rule in rules:
            if rule.literals:
                token = min(rule.literals, key=lambda t: (frequency.get(t, 0), -len(t), t))
                self.by_token.setdefault(token, []).append(rule)
            else:
                self.always.append(rule)

    def judge(self, host: str, path: str) -> tuple[str | None, str]:
        """(deciding host rule or None, verdict)."""
        subject, best, blocked, excused = f"{host}\x00{path}", None, False, False
        index = self.by_token
        candidates = [rule for token in {*tokens_of(host), *tokens_of(path)} if token in index for rule in index[token]] + self.always
        for rule in candidates:
            if rule.compiled.search(subject):
                if not rule.host_rule:
                    blocked |= rule.verdict == "block"
                    excused |= rule.verdict == "allow"
                elif best is None or (len(rule.name), rule.name) > (len(best.name), best.name):
                    best = rule
        return (best.name, best.verdict) if best else (None, "block" if blocked and not excused else "allow")


def token_frequency(urls: Column, pages: DataFrame, rules: Sequence[Rule]) -> dict[str, int]:
    """How many URLs hold each literal token; only the rules' own tokens are counted, so the driver gets at most as many.

    It decides under which token a rule is filed, never what matches, so lower-casing is near enough here.
    """
    wanted = sorted({t for r in rules for t in r.literals})
    if not wanted:
        return {}
    text = F.lower(F.concat_ws("/", host_of(urls), path_of(urls)))
    found = F.array_intersect(F.split(text, r"[^\p{L}\p{N}]+"), F.array(*map(F.lit, wanted)))
    counts = pages.select(F.explode(found).alias("token")).groupBy("token").count().collect()
    return {r["token"]: r["count"] for r in counts}


def judge_urls(pages: DataFrame, rules: Sequence[Rule] = CONTRACT_RULES + PATTERN_RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict); one pass after the token count, no shuffle of pages.

    Rules travel with the task and must stay under BROADCAST_LIMIT bytes of pattern text.
    """
    if sum(len(r.pattern) + len(r.name) for r in rules) > BROADCAST_LIMIT:
        raise ValueError("too many rules for one index: judge by several lists in turn")
    url = pages[url_col]
    index = RuleIndex(rules, token_frequency(url, pages, rules))
    source = pages.select(pages[id_col].alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    fields = T.StructType([*source.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            judged = [index.judge(h, p) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r for r, _ in judged], pa.string()), pa.array([v for _, v in judged], pa.string())], names=fields.fieldNames())

    return source.mapInArrow(run, fields)

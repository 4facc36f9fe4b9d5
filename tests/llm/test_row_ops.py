"""Language ID, URL rules, chat formatting and top-k search."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import chat, langid, queries, topk, urlrules


def test_language_id_held_out(spark, sf):
    rows = queries.op1_language_id(spark, sf).collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(lang)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_id_odd_rows(odd_docs, no_docs):
    model = langid.train_on(odd_docs, "text", "lang", F.col("doc_id"))
    got = langid.identify(odd_docs, model).collect()
    assert len(got) == odd_docs.count()
    assert {r["lang_pred"] for r in got if r["doc_id"] in (2, 3, 4)} == {"und"}
    assert {r["lang_pred"] for r in got} <= {"en", "fr", "und"}
    assert next(r["n_windows"] for r in got if r["doc_id"] == 5) > 500
    assert langid.train_on(no_docs, "text", "lang", F.col("doc_id")) is None
    assert {r["lang_pred"] for r in langid.identify(odd_docs, None).collect()} == {"und"}


def plain_network(net, text):
    """(mean probability per language) spelt out: every filter at every place of every window."""
    total, weight = np.zeros(len(net.labels)), 0
    for i in range(0, len(text), langid.WINDOW):
        x = list(text[i : i + langid.WINDOW])
        own = sum(b != 0 for b in x) or 1
        x += [0] * (langid.WINDOW - len(x))
        emb = net.emb[x].astype(float)
        pooled, at = [], 0
        for width, filters in net.WIDTHS:
            for f in range(at, at + filters):
                w = net.conv[: width * net.DIM, f].reshape(width, net.DIM)
                places = range(langid.WINDOW - net.span + 1)
                scores = sum((emb[j : j + len(places)] * w[j]).sum(1) for j in range(width))
                pooled.append(max(0.0, float(scores.max()) + float(net.bias[f])))
            at += filters
        logits = np.array(pooled) @ net.out.astype(float) + net.out_bias
        e = np.exp(logits - logits.max())
        total += e / e.sum() * own
        weight += own
    return total / weight


def test_language_id_query_against_a_plain_network(spark, sf):
    """Every row of the query, by a model trained on the same rows and run by loops; held-out rows by their own crc."""
    import unicodedata
    import zlib

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in docs.collect()}
    learn = docs.where(F.col("doc_id").isin([d for d, h in held.items() if not h]))
    net = langid.train_on(learn, "text", "lang", F.col("doc_id"))
    got = {r["doc_id"]: r for r in queries.op1_language_id(spark, sf).collect()}
    assert set(got) == set(held)
    for r in docs.collect():
        row, text = got[r["doc_id"]], (r["text"] or "")
        assert row["held_out"] == held[r["doc_id"]]
        if not any(unicodedata.category(c).startswith("L") for c in text):
            assert (row["lang_pred"], row["score"]) == ("und", 0.0)
        elif len(text) < 6000:
            p = plain_network(net, text.encode())
            assert row["lang_pred"] == net.labels[int(p.argmax())] and abs(row["score"] - p.max()) < 1e-4


def test_letters_are_of_category_l(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["²", "½", "Ⅷ", "12 _ !", "ª", "é", "字", "\u0301"])], "doc_id bigint, text string")
    net = langid.ByteConvNet(["en", "fr"])
    assert {r["doc_id"] for r in langid.identify(docs, net).collect() if r["lang_pred"] != "und"} == {4, 5, 6}


def test_many_languages_share_the_sample(spark):
    docs = spark.createDataFrame([(i, f"text {i}", f"l{i % 30}") for i in range(300)], "doc_id bigint, text string, lang string")
    net = langid.train_on(docs, "text", "lang", F.col("doc_id"), total=60)
    assert len(net.labels) == 30


def test_windows_cover_the_text():
    text = bytes(range(1, 256)) * 3
    w = langid.windows_of(text)
    assert w.tobytes()[: len(text)] == text and not any(w.tobytes()[len(text) :])


def test_gradients():
    """The loss goes down on a task that needs more than single bytes."""
    rng = np.random.default_rng(0)
    x = np.zeros((400, langid.WINDOW), np.uint8)
    y = rng.integers(0, 2, 400)
    for i in range(400):
        x[i, :60] = np.frombuffer((b"abab" if y[i] else b"aabb") * 15, np.uint8)
    net = langid.ByteConvNet(["p", "q"]).train(x, y, steps=150)
    assert (net.probabilities(x).argmax(1) == y).mean() > 0.95


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("http://A.NET/x", "a.net", "/x", "net/", "block"),
        ("https://example.net/en/1?q#f", "example.net", "/en/1", "example.net/en/", "allow"),
        ("https://b.example.net/english", "b.example.net", "/english", "net/", "block"),
        ("http://www.example.com/de/", "www.example.com", "/de/", "example.com/de/", "block"),
        ("http://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
        ("http://x.org/fr/a", "x.org", "/fr/a", "org/fr/", "allow"),
        ("http://x.org/FR/a", "x.org", "/FR/a", None, "allow"),
        ("http://net/", "net", "/", "net/", "block"),
        ("http://a.net?x", "a.net", "", None, "allow"),
        ("http://a.net#x", "a.net", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
        ("http://cheap-pills.example.com/x", "cheap-pills.example.com", "/x", None, "block"),
        ("http://spamming.example.com/x", "spamming.example.com", "/x", None, "allow"),
        ("a://b://c.net/", "b:", "//c.net/", None, "allow"),
        ("http://ÄB.net/x\ny", "Äb.net", "/x\ny", "net/", "block"),
    ],
)
def test_url_rules(spark, url, host, path, rule, verdict):
    pages = spark.createDataFrame([(1, url, "clash", "clash")], "page_id bigint, url string, host string, verdict string")
    r = urlrules.judge_urls(pages).first()
    assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict)


def test_url_index_equals_trying_all_rules(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rules = urlrules.CONTRACT_RULES + urlrules.PATTERN_RULES
    flat = urlrules.RuleIndex([urlrules.Rule(r.name, r.verdict, r.pattern, (), r.host_rule) for r in rules], {})
    rows = urlrules.judge_urls(pages, rules).collect()
    assert len(rows) == pages.count() and all(flat.judge(r["host"], r["path"]) == (r["rule"], r["verdict"]) for r in rows)
    assert urlrules.judge_urls(pages.limit(0)).collect() == []


def test_folding_follows_caseless_expressions():
    """What (?i) takes for the same letter has one folded form: over all letters, against their own case forms."""
    import re

    for code in range(0x1F000):
        c = chr(code)
        if c.isalpha():
            for other in {*c.lower(), *c.upper(), *c.casefold()}:
                if len(other) == 1 and other.isalpha() and re.fullmatch(re.escape(other), c, re.IGNORECASE):
                    assert urlrules.fold(other) == urlrules.fold(c), (c, other)
    index = urlrules.RuleIndex([urlrules.word_rule("spam")], {})
    assert index.judge("ſpam.example.com", "/") == (None, "block") == index.judge("x.com", "/SPAM")


def test_literals_of_expressions():
    for pattern, want in {r"\bspam\b": ("spam",), "foo-bar/baz": ("bar",), "a.b": (), "-track-x": ("track",), r"^ads?\.": (), r"^ads\.": ("ads",), r"x\d+-yes-no": ("yes",), r"-(a|b)-both-": ("both",), "_under_score": ("under",), "-ſet-": ("set",)}.items():
        assert urlrules.literals_of(pattern) == want, pattern


def test_rule_lists(spark, tmp_path):
    (tmp_path / "rules.txt").write_text("! comment\n\n||tracker.example/px\nbadword\n/-promo-[0-9]+/\n@@||good.tracker.example/px\n@@/-promo-7/\n", encoding="utf-8")
    rules = urlrules.rules_from(spark, str(tmp_path))
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(["http://a.tracker.example/px1", "http://good.tracker.example/px", "http://x/a-promo-5", "http://x/a-promo-7", "http://x/badword", "http://x/badwords"])], "page_id bigint, url string")
    assert [r["verdict"] for r in urlrules.judge_urls(pages, rules).orderBy("page_id").collect()] == ["block", "allow", "block", "allow", "block", "allow"]
    with pytest.raises(ValueError, match="line 2"):
        urlrules.read_rules(["ok", "/(/"])


def test_ten_thousand_rules(spark, sf):
    """The index gives what trying every rule gives, and runs few expressions."""
    rng = np.random.default_rng(8)
    urls = [r["url"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    words = sorted({w for u in urls for w in urlrules.tokens_of(u or "")})
    lines = []
    for i in range(10_000):
        a, b = (words[j] if i % 5 == 0 else f"w{j}x{i}" for j in rng.integers(0, len(words), 2))
        lines.append([f"||{a}.{b}/{i % 3}", f"{a}-{b}", f"/-{a}[0-9]*[.-]{b}-/", f"@@||{a}.example/{b}", a if i < 400 else f"{a}-x{i}"][i % 5 if i % 5 else (i // 5) % 5])
    rules = urlrules.read_rules(lines)
    pages = spark.createDataFrame([*enumerate(urls)], "page_id bigint, url string")
    rows = urlrules.judge_urls(pages, rules).collect()
    index = urlrules.RuleIndex(rules, {})
    flat = urlrules.RuleIndex([urlrules.Rule(r.name, r.verdict, r.pattern, (), r.host_rule) for r in rules], {})
    for r in rows[:40]:
        assert (r["rule"], r["verdict"]) == index.judge(r["host"], r["path"]) == flat.judge(r["host"], r["path"])
    assert len(index.always) < 20 and len({r["verdict"] for r in rows}) == 2


def test_rules_stand_under_their_rarest_token():
    index = urlrules.RuleIndex([urlrules.host_rule("example.net/en/", "allow")], {"example": 9, "net": 5, "en": 7})
    assert [*index.by_token] == ["net"]


@pytest.mark.parametrize("text", ["", "plain", "</s>", "<\\/s>", "<\\\\/s>", "[INST] x [/INST]", "<<s>", "[[INST]]", "<s", "\\", "<\\s>\\"])
def test_escape_is_reversible(text):
    e = chat.escape(text)
    assert chat.unescape(e) == text and not any(c in e for c in chat.CONTROL)


def test_template_compiler():
    tree = chat.fold(chat.parse("{# note #}a{{ 'b' ~ 1 }}{% if 'x' == 'y' %}no{% elif bos == '<s>' %}{{ bos }}{% else %}no{% endif %}"), {"bos": "<s>"})
    assert tree == [("text", "ab1<s>")]
    out, spans = chat.render("{% for m in messages %}{{ m.role | upper }}:{% generation %}{{ m.text }}{% endgeneration %};{% endfor %}", iter([{"role": "u", "text": "hi"}, {"role": "a", "text": "yo"}]))
    assert out == "U:hi;A:yo;" and [out[a:b] for a, b in spans] == ["hi", "yo"]
    for bad in ("{% for in other %}{% endfor %}", "{{ m.__class__ }}", "{{ _x }}", "{{ m.text | eval }}", "{% if x %}", "{{ f() }}", "{{ m.text.upper() }}", "{% include 'x' %}", "{{ m is callable }}", "{{ m[0 }}", "{% set x %}"):
        with pytest.raises(chat.TemplateError):
            chat.parse(bad)


TALK = [{"role": "system", "content": "be brief"}, {"role": "user", "content": " hi "}, {"role": "assistant", "content": "yo"}, {"role": "user", "content": "more"}, {"role": "assistant", "content": "no"}]

#: Templates in the manner of published ones, and what they make of TALK.
PUBLISHED = [
    (
        "{% for message in messages %}{{ '<|' + message['role'] + '|>\\n' + message['content'] + eos_token + '\\n' }}{% if loop.last and add_generation_prompt %}{{ '<|assistant|>\\n' }}{% endif %}{% endfor %}",
        "".join(f"<|{m['role']}|>\n{m['content']}</s>\n" for m in TALK),
    ),
    (
        "{% if messages[0]['role'] == 'system' %}{% set loop_messages = messages[1:] %}{% set system = messages[0].content %}{% else %}{% set loop_messages = messages %}{% endif %}"
        "{%- for m in loop_messages -%}  {% if loop.index0 == 0 and system is defined %}{{ '<<' ~ system ~ '>>' }}{% endif %}{{ '[U]' ~ m.content | trim if loop.index0 % 2 == 0 else '[A]' ~ m.content }}{% generation %}{{ m.content if m.role == 'assistant' }}{% endgeneration %}\n{%- endfor %}",
        "<<be brief>>[U]hi[A]yoyo[U]more[A]nono",
    ),
    (
        "{% set ns = namespace(n=0, seen='') %}{% for m in messages %}{% if m.role in ['x', 'user'] or m.role == 'user' %}{% set ns.n = ns.n + 1 %}{% set ns.seen = ns.seen ~ m.content[0:1] %}{% endif %}{% endfor %}{{ ns.n }}{{ ns.seen }}{{ messages | length }}{{ messages[-1].role }}{{ missing }}{{ not missing }}".replace("m.role in ['x', 'user'] or ", ""),
        "2 m5assistantTrue",
    ),
    ("{% for m in messages %}[{{ m.role | first }}]{% endfor %}|{% for m in messages %}[{{ loop.index }}{{ ',' if not loop.last }}]{% endfor %}", "[s][u][a][u][a]|[1,][2,][3,][4,][5]"),
]


@pytest.mark.parametrize(("template", "want"), PUBLISHED)
def test_templates_as_models_publish_them(template, want):
    out, spans = chat.render(template, iter(TALK))
    assert out == want
    if "generation %}" in template:
        assert [out[a:b] for a, b in spans if a < b] == ["yo", "no"]


def test_generation_prompt_and_scopes():
    t = "{% for m in messages %}{% set x = m.role %}{% endfor %}{{ x }}{% if add_generation_prompt %}GO{% endif %}"
    assert "".join(p for p, _ in chat.compile_template(t, (("add_generation_prompt", True),))(iter(TALK))) == "GO"
    assert chat.render(t, iter([]))[0] == ""


def test_ids_of_any_type(spark):
    from decimal import Decimal

    for kind, ids in (("string", ["b", "a"]), ("decimal(9,2)", [Decimal("1.50"), Decimal("-2.00")]), ("date", None), ("smallint", [3, -4])):
        import datetime

        ids = ids or [datetime.date(2020, 1, 2), datetime.date(1999, 1, 1)]
        df = spark.createDataFrame([(i, 0, "user", "hi") for i in [*ids, None]], f"conv_id {kind}, turn int, role string, text string")
        assert {r["conv_id"] for r in chat.digest_chats(chat.format_chats(df)).collect()} == {*ids, None}


def digest(rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    said = "".join(r[3] or "" for r in rows if r[2] == "assistant")
    return (len(rows), hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in rows).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())


def test_chats(spark):
    rows = [(1, 1, "assistant", "<s>ok</s>"), (1, 0, "user", None), (1, 1, "assistant", "<s>ok</s>"), (2, None, None, "[INST]"), (2, 0, "tool\n", "é😀"), (None, 0, "assistant", "lost"), (3, 0, "assistant", "x" * 200_000), (4, 0, "[INST] a [/INST]", " </s>")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.digest_chats(chat.format_chats(df)).collect()}
    for c in {r[0] for r in rows}:
        r = got.pop(c)
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == digest([x for x in rows if x[0] == c])
    assert not got and chat.digest_chats(chat.format_chats(df.limit(0))).collect() == []


def test_chat_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()] + queries.TRICKY
    got = {r["conv_id"]: r for r in queries.op3_chat_format(spark, sf).collect()}
    assert set(got) == {r[0] for r in rows}
    for c, r in got.items():
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == digest([x for x in rows if x[0] == c])


def top_brute(vectors, k=5):
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, q in usable:
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, w)), j) for j, w in usable if j != i)[:k]
            out |= {(i, r, j, -s) for r, (s, j) in enumerate(best, 1)}
    return out


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.round(rng.normal(0, 0.3, 8) * 2) / 2]) for i in range(301)]
    rows += [(401, None), (402, [float("nan")] * 8), (450, [1.0, None] + [0.0] * 6), (403, [float("inf")] * 8), (404, [0.5]), (500, []), (405, [-0.001] * 9)]
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id bigint, embedding array<double>, score string").repartition(3)
    named = df.select("vec_id", topk.quantise(F.col("embedding")).alias("weights"), "score")
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(named, F.col("vec_id") % 50 == 0).collect()}
    assert got == top_brute(rows)
    assert topk.top_k(named.limit(0), F.col("vec_id") % 50 == 0).collect() == []
    few = named.where("vec_id in (0, 1, 2)")
    assert topk.top_k(few, F.col("vec_id") % 50 == 0).count() == 2


def test_top_k_in_query_blocks(spark, sf, monkeypatch):
    monkeypatch.setattr(topk, "BROADCAST_LIMIT", 700)
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in queries.op7_top_k(spark, sf).collect()}
    assert got == top_brute(rows)


def test_top_k_of_large_values(spark, monkeypatch):
    """Scores that fill a long, and some beyond it; one block of queries and many."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-100_000, 100_000, 64)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(2)
    named = df.select("vec_id", topk.quantise(F.col("embedding")).alias("weights"))
    for limit in (topk.BROADCAST_LIMIT, 2_000):
        monkeypatch.setattr(topk, "BROADCAST_LIMIT", limit)
        got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(named, F.col("vec_id") % 50 == 0).collect()}
        assert got == top_brute(rows)
    huge = spark.createDataFrame([(0, [2**40, 1]), (1, [2**40, 0]), (2, [-(2**40), 0]), (3, [1, 1])], "vec_id bigint, weights array<bigint>")
    got = [(r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(huge, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(1, 1, 2**63 - 1), (2, 3, 2**40 + 1), (3, 2, -(2**63) + 1)]


def test_partition_selection():
    rng = np.random.default_rng(5)
    for n in (1, 5, 40):
        for k in (1, 3, 5, 50):
            s = rng.integers(-3, 3, n)
            assert topk.select_best(s, min(k, n)).tolist() == sorted(range(n), key=lambda i: (-s[i], i))[:k]

"""Citations: extraction, aliases, resolution to documents and articles, in-degree, scope decisions."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as X

#: Reference patterns (article, branch, paragraph, item).
_ART = r"제\s*(\d{1,3})\s*조(?:\s*의\s*(\d{1,2}))?(?:\s*제\s*(\d{1,3})\s*항)?(?:\s*제\s*(\d{1,3})\s*호)?"
FULL_REF = r"[「『]([^」』]{2,60})[」』]\s*" + _ART
ALIAS_REF = r"(?<![가-힣A-Za-z])([가-힣]{1,10})\s*" + _ART
ALIAS_DEFINITION = r"""[「『]([^」』]{2,60})[」』]\s*\(\s*이하\s*["'“”‘’]([^"'“”‘’]{1,20})["'“”‘’]\s*(?:이)?라\s*한다\s*\)"""
QUOTED_EXTERNAL = r"[「『][^」』]{2,60}[」』]\s*제\s*\d{1,3}\s*조(?:\s*의\s*\d{1,2})?"
ALIAS_EXTERNAL = r"[가-힣]{0,12}(?:법률|법|시행령|령|영|시행규칙|규칙|규정|훈령|예규|고시|지침|기준|세칙)\s*제\s*\d{1,3}\s*조(?:\s*의\s*\d{1,2})?"
BARE_ARTICLE = r"(?<![가-힣」』])제\s*(\d{1,3})\s*조(?:\s*의\s*(\d{1,2}))?"


def _groups(c: Column, pattern: str, names: list[str]) -> Column:
    """Groups of all matches, as structs; an optional group that did not match is ''."""
    arrays = [F.regexp_extract_all(c, F.lit(pattern), F.lit(i + 1)).alias(n) for i, n in enumerate(names)]
    return F.arrays_zip(*arrays)


def alias_map(units: DataFrame) -> DataFrame:
    """(doc_id, alias, full): abbreviations that a document defines; the first definition wins. Needs doc_id, pos, text."""
    found = units.select("doc_id", "pos", F.posexplode(_groups(F.col("text"), ALIAS_DEFINITION, ["full", "alias"])).alias("at", "z"))
    rows = found.select("doc_id", "pos", "at", X.collapse(F.col("z.full")).alias("full"), X.strip(F.col("z.alias")).alias("alias")).where("alias <> ''")
    return rows.groupBy("doc_id", "alias").agg(F.min_by("full", F.struct("pos", "at")).alias("full"))


def references(units: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Distinct references of each unit: by quoted full name, and by an alias its own document defines.

    (doc_id, unit_id, kind, target_name, target_tier, jo, jo_branch, hang, ho)
    """
    aliases = alias_map(units) if aliases is None else aliases
    names = ["name", "jo", "jo_branch", "hang", "ho"]
    pick = lambda p: units.select("doc_id", "unit_id", F.explode(_groups(F.col("text"), p, names)).alias("z")).select("doc_id", "unit_id", "z.*")
    full = pick(FULL_REF).withColumn("kind", F.lit("full")).withColumn("target_name", X.collapse(F.col("name")))
    short = pick(ALIAS_REF).withColumn("kind", F.lit("alias")).withColumn("alias", X.strip(F.col("name"))).join(aliases, ["doc_id", "alias"]).withColumn("target_name", F.col("full"))
    cols = ["doc_id", "unit_id", "target_name", "jo", F.when(F.col("jo_branch") == "", "0").otherwise(F.col("jo_branch")).alias("jo_branch"), "hang", "ho", "kind"]
    both = full.select(*cols).unionByName(short.select(*cols))
    keys = ["doc_id", "unit_id", "target_name", "jo", "jo_branch", "hang", "ho"]
    return both.groupBy(*keys).agg(F.max("kind").alias("kind")).withColumn("target_tier", X.tier_of(F.col("target_name")))


def external_tier_span(refs: DataFrame, key: str = "unit_id") -> DataFrame:
    """(key, n_refs, ext_tier_span): distinct cited tiers but the lowest and the unknown."""
    outside = F.when(~F.col("target_tier").isin("T4_행정규칙", "UNK"), F.col("target_tier"))
    return refs.groupBy(key).agg(F.count("*").alias("n_refs"), F.countDistinct(outside).alias("ext_tier_span"))


def internal_references(articles: DataFrame) -> DataFrame:
    """(unit_id, target_id): articles of the same document cited by bare number, other than itself and alive.

    Needs doc_id, unit_id, jo, jo_branch, text, deleted.
    """
    body = F.regexp_replace(F.regexp_replace("text", QUOTED_EXTERNAL, " "), ALIAS_EXTERNAL, " ")
    live = articles.where(~F.coalesce("deleted", F.lit(False)))
    cited = live.select("doc_id", "unit_id", F.explode(_groups(body, BARE_ARTICLE, ["n", "b"])).alias("z"))
    cited = cited.select("doc_id", "unit_id", F.col("z.n").cast("int").alias("jo"), F.when(F.col("z.b") == "", 0).otherwise(F.col("z.b").cast("int")).alias("jo_branch"))
    targets = live.select("doc_id", "jo", F.coalesce("jo_branch", F.lit(0)).alias("jo_branch"), F.col("unit_id").alias("target_id"))
    return cited.join(targets, ["doc_id", "jo", "jo_branch"]).where("unit_id <> target_id").select("unit_id", "target_id").distinct()


def match_names(edges: DataFrame, docs: DataFrame, name: str = "target_name", doc_id: str = "doc_id", doc_name: str = "doc_name") -> DataFrame:
    """edges with doc_id of the named document, by strict key, else by the key without a leading agency; null if none. The smallest id wins a key."""
    first = lambda key, alias: docs.groupBy(key.alias("_k")).agg(F.min(doc_id).alias(alias))
    a, b = first(X.name_key_strict(F.col(doc_name)), "_a"), first(X.name_key_no_agency(F.col(doc_name)), "_b")
    out = edges.withColumn("_k", X.name_key_strict(F.col(name))).join(a, "_k", "left").join(b, "_k", "left")
    return out.withColumn("cited_doc", F.coalesce("_a", "_b")).drop("_k", "_a", "_b")


def in_degree(matched: DataFrame) -> DataFrame:
    return matched.where("cited_doc is not null").groupBy("cited_doc").agg(F.count("*").alias("in_degree"))


def match_diagnostics(matched: DataFrame, name: str = "target_name", top: int = 15) -> tuple[DataFrame, DataFrame]:
    """(one row: edges, matched, docs_with_citation), (the most frequent unmatched names)."""
    totals = matched.agg(F.count("*").alias("edges"), F.count("cited_doc").alias("matched"), F.countDistinct("cited_doc").alias("docs_with_citation"))
    missing = matched.where("cited_doc is null").groupBy(F.col(name).alias("name")).count().orderBy(F.desc("count"), "name").limit(top)
    return totals, missing


def ratio_score(a: str, b: str, floor: float = 0.0, least_len: int = 0, least_ratio: float = 0.0) -> float:
    """Ratcliff-Obershelp ratio of (a, b) in this order, raised to ``floor`` where one contains the other."""
    r = SequenceMatcher(None, a, b).ratio()
    if floor and a and b and (a in b or b in a) and min(len(a), len(b)) >= least_len and min(len(a), len(b)) / max(len(a), len(b)) >= least_ratio:
        r = max(r, floor)
    return r


def fuzzy_match(names: DataFrame, catalogue: DataFrame, least: float, floor: float = 0.0, least_len: int = 0, least_ratio: float = 0.0, limit_bytes: int = 16 << 20) -> DataFrame:
    """(name, match, score): equal keys first (score 1); only the rest is compared by ratio with every catalogue name, best one kept.

    The catalogue must stay under ``limit_bytes``: it travels with the tasks, and each name is one scan of it.
    """
    keyed = names.select("name").distinct().withColumn("_k", X.name_key(F.col("name")))
    known = catalogue.groupBy(X.name_key(F.col("name")).alias("_k")).agg(F.min("name").alias("match"))
    joined = keyed.join(known, "_k", "left")
    exact = joined.where("match is not null").select("name", "match", F.lit(1.0).alias("score"))
    size = catalogue.agg(F.coalesce(F.sum(F.octet_length("name")), F.lit(0))).first()[0]
    if size > limit_bytes:
        raise ValueError("catalogue too large for a similarity scan: narrow it by a prefix or an agency first")
    pool = sorted(r[0] for r in catalogue.select(X.name_key(F.col("name"))).distinct().collect())

    def best(batches):
        for batch in batches:
            rows = []
            for name, key in zip(batch["name"], batch["_k"], strict=True):
                scored = [(ratio_score(key, other, floor, least_len, least_ratio), other) for other in pool]
                score, other = max(scored, key=lambda s: (s[0], [-ord(c) for c in s[1]]), default=(0.0, None))
                if score >= least:
                    rows.append((name, other, score))
            yield pd.DataFrame(rows, columns=["name", "_m", "score"])

    rest = joined.where("match is null").select("name", "_k").mapInPandas(best, "name string, _m string, score double")
    rest = rest.join(known.withColumnRenamed("_k", "_m"), "_m").select("name", "match", "score")
    return exact.unionByName(rest)


def _dealt(df: DataFrame, partitions: int | None, *keys: str) -> DataFrame:
    return df.repartition(partitions, *keys) if partitions else df


def resolve_articles(refs: DataFrame, articles: DataFrame, partitions: int | None = None) -> DataFrame:
    """Adds verdict: resolved, missing_doc, missing_jo or deleted_jo. ``refs`` has cited_doc, jo, jo_branch; ``articles`` doc_id, jo, jo_branch, deleted.

    References without a document meet nothing and are spread over all tasks.  ``partitions`` fixes the number of tasks,
    so that a task's share does not grow with the tables; it is for keys none of which is very frequent.
    """
    keys = ["cited_doc", "_a", "_s"]
    article = F.shiftleft(F.col("jo").cast("int").cast("long"), 32) + F.coalesce(F.col("jo_branch").cast("int"), F.lit(0))
    none = F.pmod(F.xxhash64("doc_id"), F.lit(1)).cast("int")  # 0, but a column to the planner, which would drop a constant key and deal the rows again
    a = articles.select(F.col("doc_id").alias("cited_doc"), article.alias("_a"), none.alias("_s"), F.coalesce("deleted", F.lit(False)).alias("deleted"))
    a = _dealt(a, partitions, *keys).groupBy(*keys).agg(F.min("deleted").alias("_deleted"))
    spread = F.when(F.col("cited_doc").isNull(), F.pmod(F.xxhash64(*refs.columns), F.lit(1 << 20)).cast("int")).otherwise(0)
    out = refs.withColumn("_a", article).withColumn("_s", spread)
    out = _dealt(out, partitions, *keys).join(a, keys, "left")
    verdict = F.when(F.col("cited_doc").isNull(), "missing_doc").when(F.col("_deleted").isNull(), "missing_jo").when(F.col("_deleted"), "deleted_jo").otherwise("resolved")
    return out.withColumn("verdict", verdict).drop("_a", "_s", "_deleted")


def verify_gold(resolved: DataFrame, key: str = "unit_id", partitions: int | None = None) -> DataFrame:
    """(key, n, n_resolved, verdict): pass, pass_partial or reject."""
    g = _dealt(resolved.select(key, "verdict"), partitions, key).groupBy(key).agg(F.count("*").alias("n"), F.count(F.when(F.col("verdict") == "resolved", 1)).alias("n_resolved"))
    return g.withColumn("verdict", F.when(F.col("n_resolved") == F.col("n"), "pass").when(F.col("n_resolved") > 0, "pass_partial").otherwise("reject"))


def decide_scope(names: DataFrame, rules: DataFrame, collected: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(name, canonical, scope, rule) by an ordered rule table.

    ``rules`` is (step, rule_order, family, scope): a family applies if its key stands in the name's key; the
    lowest (step, rule_order) wins.  ``collected`` (name, step) puts names themselves into scope at their step.
    ``overrides`` (name, scope) decide what no rule does.  The rule table is small and travels to the names.
    """
    keyed = names.select("name", "canonical").withColumn("_k", X.name_key(F.col("canonical")))
    table = rules.select("step", "rule_order", "scope", "family", X.name_key(F.col("family")).alias("_f")).where("_f <> ''")
    hits = keyed.join(F.broadcast(table), F.col("_k").contains(F.col("_f"))).select("name", F.struct("step", "rule_order", "scope", "family").alias("h"))
    own = collected.select(X.name_key(F.col("name")).alias("_k"), "step").distinct()
    mine = keyed.join(own, "_k").select("name", F.struct("step", F.lit(0).alias("rule_order"), F.lit("in_scope").alias("scope"), F.lit("collected").alias("family")).alias("h"))
    best = hits.unionByName(mine).groupBy("name").agg(F.min("h").alias("h"))
    out = keyed.join(best, "name", "left")
    if overrides is not None:
        out = out.join(overrides.select(X.name_key(F.col("name")).alias("_k"), F.col("scope").alias("_o")), "_k", "left")
    else:
        out = out.withColumn("_o", F.lit(None).cast("string"))
    return out.select("name", "canonical", F.coalesce("h.scope", "_o", F.lit("undecided")).alias("scope"), F.coalesce("h.family", F.when(F.col("_o").isNotNull(), "override"), F.lit("")).alias("rule"))


def triage(undecided: DataFrame, decided: DataFrame) -> DataFrame:
    """(name, outcome, scope): noise, inherited from the name without its enforcement suffix, or open with a priority band by citations.

    ``undecided`` is (name, citations), ``decided`` (name, scope).
    """
    parent = undecided.withColumn("noise", X.is_noise(F.col("name"))).withColumn("_k", X.name_key(X.parent_name(F.col("name"))))
    known = decided.groupBy(X.name_key(F.col("name")).alias("_k")).agg(F.min("scope").alias("_s"))
    out = parent.join(known, "_k", "left")
    band = F.when(F.col("citations") >= 10, "P1").when(F.col("citations") >= 3, "P2").otherwise("P3")
    return out.select("name", F.when(F.col("noise"), "noise").when(F.col("_s").isNotNull(), "inherited").otherwise(band).alias("outcome"), F.when(~F.col("noise"), F.col("_s")).alias("scope"))


def settle(names: DataFrame, undecided: DataFrame, decided: DataFrame, rounds: int = 5) -> DataFrame:
    """Triage until no further name inherits a scope: decisions found feed the next round; (name, scope)."""
    known, left = decided.select("name", "scope"), undecided
    for _ in range(rounds):
        found = triage(left, known).where("outcome = 'inherited'").select("name", "scope")
        if found.isEmpty():
            break
        known = known.unionByName(found)
        left = left.join(found.select("name"), "name", "left_anti")
    return names.select("name").distinct().join(known, "name", "left").select("name", F.coalesce("scope", F.lit("undecided")).alias("scope"))


def last_cited(texts: Column) -> Column:
    """Last quoted name of the first text that has one, from an array of texts."""
    names = F.transform(texts, lambda t: F.try_element_at(F.regexp_extract_all(t, F.lit(r"[「『]([^」』]{2,60})[」』]"), F.lit(1)), F.lit(-1)))
    return F.try_element_at(F.filter(names, lambda n: n.isNotNull()), F.lit(1))



"""What to fetch: lists with a fallback, tagged query unions, what is still missing, version histories, routes by name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.citations import fuzzy_match
from lodestone.operators.corpus import keep_first


def tagged_queries(results: dict[str, DataFrame], key: str) -> DataFrame:
    """Union of several queries' results; a record found by several is kept once, from the first query; _query says which."""
    parts = [df.withColumn("_query", F.lit(q)).withColumn("_order", F.lit(i)) for i, (q, df) in enumerate(results.items())]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return keep_first(whole, [key], ["_order"]).drop("_order")


def list_with_fallback(primary: DataFrame, fallback: dict[str, DataFrame], wanted: Column, key: str) -> DataFrame:
    """The primary list, or, where it is empty, the wanted rows of a union of queries, one a key."""
    if not primary.isEmpty():
        return keep_first(primary, [key], [key])
    return tagged_queries(fallback, key).where(wanted).drop("_query")


def not_fetched(wanted: DataFrame, fetched: DataFrame, key: str) -> DataFrame:
    return wanted.join(fetched.select(key).distinct(), key, "left_anti")


def all_versions(history: DataFrame, names: DataFrame, name: str, rule: str) -> DataFrame:
    """Every version of the rules that carry one of the names in some version: names change, the rule id stays."""
    rules = history.join(names.select(name).distinct(), name, "left_semi").select(rule).distinct()
    return history.join(rules, rule, "left_semi")


def link_parameter(link: Column, parameter: str) -> Column:
    return F.parse_url(link, F.lit("QUERY"), F.lit(parameter))


def routes(names: DataFrame, laws: DataFrame, rules: DataFrame, least: float = 0.82) -> DataFrame:
    """(name, route, match, score): best catalogue name of at least ``least``, laws first, then rules; unmatched names have route none."""
    law = fuzzy_match(names, laws, least, floor=0.92, least_len=2)
    left = names.select("name").distinct().join(law.select("name"), "name", "left_anti")
    rule = fuzzy_match(left, rules, least, floor=0.92, least_len=2)
    found = law.withColumn("route", F.lit("law")).unionByName(rule.withColumn("route", F.lit("rule")))
    return names.select("name").distinct().join(found, "name", "left").select("name", F.coalesce("route", F.lit("none")).alias("route"), "match", "score")

"""Hosts against pattern lists.

Pattern lists are configuration.  Exact and wildcard patterns become keys, so a host meets them in an
equality join on itself and its parent domains; regular expressions are tested in place.  For a table
of URLs the whole decision is one column expression and nothing is joined at all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shroudline.config import HostRule, as_rows
from shroudline.functions import regex, text as T

# Which list wins, and what it means.
PRIORITY = {"floor": 0, "passthrough": 1, "intercept": 2}
ROUTE = {"floor": "intercept", "passthrough": "passthrough", "intercept": "intercept"}


def _suffix(rule: HostRule) -> str:
    return rule.value.removeprefix("*.").lower()


def _pattern(rule: HostRule) -> str:
    return "(?i)" + regex.to_java(rule.value)


def matches(host: Column, rules: tuple[HostRule, ...]) -> Column:
    """Whether any pattern covers a host: itself, a strict sub-domain, or a regular expression."""
    exact = [r.value.lower() for r in rules if r.kind == "exact"]
    tests = [host.isin(*exact)] if exact else []
    tests += [host.endswith("." + _suffix(r)) for r in rules if r.kind == "wildcard"]
    tests += [host.rlike(_pattern(r)) for r in rules if r.kind == "regex"]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def route(host: Column, rules: tuple[HostRule, ...], default: str = "intercept") -> Column:
    """What happens to a host: floor, then passthrough, then intercept, then the default."""
    chain = F
    for name in PRIORITY:
        chain = chain.when(matches(host, tuple(r for r in rules if r.list == name)), F.lit(ROUTE[name]))
    return chain.otherwise(F.lit(default))


def signs_body(host: Column, rules: tuple[HostRule, ...]) -> Column:
    return matches(host, tuple(r for r in rules if r.list == "signs_body"))


def match_hosts(hosts: DataFrame, rules: tuple[HostRule, ...], host: str = "host") -> DataFrame:
    """(host, list, kind, value) for every pattern that covers a host."""
    as_rows(rules)  # bounds what is broadcast
    spark = hosts.sparkSession
    fixed = [
        (r.kind, _suffix(r) if r.kind == "wildcard" else r.value.lower(), r.list, r.value) for r in rules if r.kind != "regex"
    ]
    keys = spark.createDataFrame(fixed, "_kind string, _key string, list string, value string") if fixed else None
    labels = F.split(F.col(host), r"\.")
    parents = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.struct(
            F.when(i == 1, "exact").otherwise("wildcard").alias("_kind"),
            F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("_key"),
        ),
    )
    out = []
    if keys is not None:
        candidates = hosts.select(host, F.explode(parents).alias("_p")).select(host, "_p.*")
        out.append(candidates.join(F.broadcast(keys), ["_kind", "_key"]).select(host, "list", F.col("_kind").alias("kind"), "value"))
    patterns = [r for r in rules if r.kind == "regex"]
    if patterns:
        hits = F.array_compact(F.array(*[
            F.when(F.col(host).rlike(_pattern(r)), F.struct(F.lit(r.list).alias("list"), F.lit("regex").alias("kind"), F.lit(r.value).alias("value")))
            for r in patterns
        ]))
        out.append(hosts.select(host, F.explode(hits).alias("_m")).select(host, "_m.*"))
    return reduce(DataFrame.unionByName, out)


def route_hosts(hosts: DataFrame, rules: tuple[HostRule, ...], default: str = "intercept", host: str = "host") -> DataFrame:
    """Route of each distinct host through its matches, for pattern lists too long for an expression."""
    found = match_hosts(hosts, tuple(r for r in rules if r.list in PRIORITY), host)
    rank = reduce(lambda acc, kv: acc.when(F.col("list") == kv[0], kv[1]), list(PRIORITY.items())[1:], F.when(F.col("list") == "floor", 0))
    best = found.groupBy(host).agg(F.min(rank).alias("_best"))
    action = F.when(F.col("_best") == 1, "passthrough").when(F.col("_best").isNotNull(), "intercept").otherwise(default)
    return hosts.select(host).distinct().join(best, host, "left").select(host, action.alias("route"))


def effective_rules(history: DataFrame, floor: DataFrame) -> DataFrame:
    """Patterns in force: the newest version (first copy received of it), plus the built-in floor.

    ``history``: version, received (order of arrival), list, kind, value.
    """
    newest = history.agg(F.max(F.struct("version", (-F.col("received")).alias("before"))).alias("_top"))
    # one row: the newest version and when it first came
    current = history.join(
        F.broadcast(newest), (F.col("version") == F.col("_top.version")) & (F.col("received") == -F.col("_top.before"))
    ).select("list", "kind", "value")
    return current.unionByName(floor.select("list", "kind", "value")).distinct()


def route_urls(df: DataFrame, url: str, rules: tuple[HostRule, ...], default: str = "intercept") -> DataFrame:
    """Add host, route and signs_body to a table of URLs, row by row."""
    return (
        df.withColumn("host", T.host_of(F.col(url)))
        .withColumn("route", route(F.col("host"), rules, default))
        .withColumn("signs_body", signs_body(F.col("host"), rules))
    )

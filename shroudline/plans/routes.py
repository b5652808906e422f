"""Host routing queries over page URLs."""

from __future__ import annotations

from pyspark.sql import functions as F

from shroudline.config import FLOOR_HOSTS, PASSTHROUGH_HOSTS, SIGNED_HOSTS, HostRule
from shroudline.functions import text as T
from shroudline.operators import routing as G
from shroudline.plans import sql as S, views as V
from shroudline.plans.registry import query

RULES = (
    *FLOOR_HOSTS, *PASSTHROUGH_HOSTS, *SIGNED_HOSTS,
    HostRule("floor", "regex", r"^th[a-z]+\.example\.com$"),
    HostRule("passthrough", "wildcard", "*.example.com"),
    HostRule("passthrough", "exact", "example.org"),
    HostRule("intercept", "wildcard", "*.example.net"),
    HostRule("intercept", "regex", r"^[A-M].*\.example\.(org|com)$"),
    HostRule("signs_body", "wildcard", "*.example.org"),
    HostRule("signs_body", "regex", r"^e[a-z]*\."),
)

HOST = r"rtrim(lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)), '.')"


def covers(host: str, rule: HostRule) -> str:
    if rule.kind == "exact":
        return f"{host} = {S.lit(rule.value.lower())}"
    if rule.kind == "wildcard":
        return f"ends_with({host}, {S.lit('.' + rule.value.removeprefix('*.').lower())})"
    return f"regexp_matches({host}, {S.lit('(?i)' + rule.value)})"


def any_of(host: str, name: str) -> str:
    return "(" + " OR ".join(covers(host, r) for r in RULES if r.list == name) + ")"


HOSTS_SQL = f"hosts AS (SELECT DISTINCT {HOST} AS host FROM pages)"
ROUTED = f"""CASE WHEN {any_of('host', 'floor')} THEN 'intercept' WHEN {any_of('host', 'passthrough')} THEN 'passthrough'
  WHEN {any_of('host', 'intercept')} THEN 'intercept' ELSE 'passthrough' END"""


def hosts(spark, d):
    return V.table(spark, d, "pages").select(T.host_of(F.col("url")).alias("host")).distinct()


@query("host_match", f"WITH {HOSTS_SQL} " + " UNION ALL ".join(
    f"SELECT host, {S.lit(r.list)} AS list, {S.lit(r.kind)} AS kind, {S.lit(r.value)} AS value FROM hosts WHERE {covers('host', r)}" for r in RULES))
def host_match(spark, d):
    return G.match_hosts(hosts(spark, d), RULES)


@query("host_route", f"WITH {HOSTS_SQL} SELECT host, {ROUTED} AS route FROM hosts")
def host_route(spark, d):
    return G.route_hosts(hosts(spark, d), RULES, "passthrough")


@query("host_signed", f"WITH {HOSTS_SQL} SELECT host, {any_of('host', 'signs_body')} AS signs_body FROM hosts")
def host_signed(spark, d):
    return hosts(spark, d).select("host", G.signs_body(F.col("host"), RULES).alias("signs_body"))


@query("ruleset_latest", f"""WITH history AS (SELECT page_id % 4 AS version, page_id % 12 AS received, CASE WHEN page_id % 2 = 0 THEN 'intercept' ELSE 'passthrough' END AS list,
    'exact' AS kind, {HOST} AS value FROM pages)
  SELECT DISTINCT list, kind, value FROM history WHERE version = (SELECT max(version) FROM history)
    AND received = (SELECT min(received) FROM history WHERE version = (SELECT max(version) FROM history))
  UNION SELECT * FROM (VALUES {', '.join(f"('floor', {S.lit(r.kind)}, {S.lit(r.value)})" for r in FLOOR_HOSTS)}) AS f(list, kind, value)""")
def ruleset_latest(spark, d):
    history = V.table(spark, d, "pages").select(
        (F.col("page_id") % 4).alias("version"), (F.col("page_id") % 12).alias("received"),
        F.when(F.col("page_id") % 2 == 0, "intercept").otherwise("passthrough").alias("list"), F.lit("exact").alias("kind"), T.host_of(F.col("url")).alias("value"),
    )
    floor = spark.createDataFrame([(r.list, r.kind, r.value) for r in FLOOR_HOSTS], "list string, kind string, value string")
    return G.effective_rules(history, floor)


@query("route_pages", f"SELECT page_id, host, {ROUTED} AS route, {any_of('host', 'signs_body')} AS signs_body FROM (SELECT page_id, {HOST} AS host FROM pages)")
def route_pages(spark, d):
    return G.route_urls(V.table(spark, d, "pages").select("page_id", "url"), "url", RULES, "passthrough").drop("url")

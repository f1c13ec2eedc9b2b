"""URL filters with redirect equivalence.

A url is judged by the longest rule (host and path prefix) that fits it. Urls that redirect to each other or name each
other as canonical are aliases: their connected components are computed over all edges, and a page without a rule of
its own takes its component's decision: allow if any alias is allowed by a rule, else block if any is blocked, else
allow. So an explicit allow always comes first. Aliases are compared by host and path.

Edges come from the pages (``<link rel=canonical href>``, ``<meta http-equiv=refresh content="..url=">``) and from an
optional table (url, target). Absolute, scheme-relative and root-relative targets are resolved; others and targets of
null or hostless urls are no edges. Null and hostless urls have empty host and path and fit no rule; repeated rows are
judged alike; empty tables give empty tables; extra columns pass through unless they carry the name of an output
column (host, path, rule, verdict), which then wins.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stoplens.llm.common import written
from stoplens.llm.components import connected_components

#: (verdict, host, path prefix)
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (size, verdict, rule) of the longest rule that fits, null if none; of equally long ones, allow.
    ``rules`` is a literal of the plan: keep it to some hundreds."""
    table = F.array(*[F.struct(F.lit(len(h) + len(p)).alias("size"), F.lit(1 if v == "allow" else 0).alias("first"), F.lit(v).alias("verdict"),
                               F.lit(h + p).alias("rule"), F.lit(h).alias("h"), F.lit(p).alias("p")) for v, h, p in rules])
    fits = F.filter(table, lambda r: ((host == r["h"]) | F.endswith(host, F.concat(F.lit("."), r["h"]))) & F.startswith(path, r["p"]))
    return F.array_max(fits)


def _targets(html: Column) -> Column:
    """Targets of canonical links and refreshes, as written."""
    links = F.filter(F.regexp_extract_all(html, F.lit(r"(?i)<link\b[^>]*>"), F.lit(0)), lambda x: x.rlike(r"""(?i)\brel\s*=\s*["']?canonical\b"""))
    metas = F.filter(F.regexp_extract_all(html, F.lit(r"(?i)<meta\b[^>]*>"), F.lit(0)), lambda x: x.rlike(r"""(?i)\bhttp-equiv\s*=\s*["']?refresh\b"""))
    href = lambda x: F.regexp_extract(x, r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)""", 1)
    goes = lambda x: F.regexp_extract(x, r"""(?i)\bcontent\s*=\s*["']?[^"'>]*?url\s*=\s*['"]?([^"'\s>]+)""", 1)
    return F.filter(F.concat(F.transform(links, href), F.transform(metas, goes)), lambda x: x != "")


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html", redirects: DataFrame | None = None) -> DataFrame:
    """(u, v): host and path of a url, and of one it redirects to or names as canonical."""
    edges = pages.select(F.col(url).alias("url"), F.explode(_targets(F.col(html))).alias("target"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select("url", "target"))
    scheme = F.regexp_extract("url", "^([^:/?#]*)://", 1)
    full = F.when(F.col("target").rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), F.col("target")).when(F.startswith("target", F.lit("//")), F.concat(scheme, F.lit(":"), F.col("target")))\
        .when(F.startswith("target", F.lit("/")), F.concat(scheme, F.lit("://"), host_of(F.col("url")), F.col("target")))
    key = lambda c: F.when(host_of(c) != "", F.concat(host_of(c), path_of(c)))
    return edges.withColumn("full", full).select(key(F.col("url")).alias("u"), key(F.col("full")).alias("v")).where("u is not null and v is not null")


def alias_decisions(edges: DataFrame, rules=RULES) -> DataFrame:
    """(key, decision) for urls in a component that holds a url with a rule; allow precedes block."""
    parts = written(connected_components(edges), "aliases")
    host = F.substring_index("node", "/", 1)
    own = parts.withColumn("own", best_rule(host, F.substr("node", F.length(host) + 1), rules)["verdict"]).where("own is not null")
    decided = own.groupBy("component").agg(F.min("own").alias("decision")).hint("rebalance")  # 'allow' comes before 'block'
    return parts.join(decided, "component").select(F.col("node").alias("key"), "decision")


def judge_urls(pages: DataFrame, url: str = "url", html: str = "html", redirects: DataFrame | None = None, rules=RULES) -> DataFrame:
    """``pages`` with host, path, rule and verdict."""
    decisions = alias_decisions(alias_edges(pages, url, html, redirects), rules).withColumnRenamed("key", "_key")
    pages = pages.drop(*[c for c in ("host", "path", "rule", "verdict", "decision") if c not in (url, html)])
    judged = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})\
        .withColumn("_rule", best_rule(F.col("host"), F.col("path"), rules))
    return judged.join(decisions.hint("rebalance"), F.when(F.col("host") != "", F.concat("host", "path")) == F.col("_key"), "left")\
        .withColumns({"rule": F.col("_rule.rule"), "verdict": F.coalesce("_rule.verdict", "decision", F.lit("allow"))}).drop("_rule", "_key", "decision")

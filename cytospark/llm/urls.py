"""URL filters: longest-match rules, and decisions carried to aliases through redirects and canonical links.

A page's node is its url without scheme, fragment and trailing slash. Edges are the canonical links and refresh
redirects in the html (all of them; relative ones are resolved, ``&amp;`` is read as &), and any rows of a links table
(src, dst urls). A page that a rule fits gets that rule's verdict.
Any other page gets its component's: allow if a rule allows any url in it, else block if a rule blocks one, else
allow; targets, and urls of the links table, that are no rows of pages count as well (the SQL knows rows only). Everything is DataFrame functions; components are found by distributed rounds over the edges.

Null urls and urls without ``://`` have empty host and path, no node, and are allowed unless a rule fits. Of fitting rules
of one length the least is taken. Repeated rows, and rows of one page_id (null or not) with other urls, are judged each for
itself. Html of any length is read whole; null html names no target. Extra columns are not read. An empty table gives an
empty result. Nodes are 64-bit hashes of urls.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stash, let, table
from .components import components

#: (verdict, "host/path prefix"): fits the host and all its subdomains.
RULES = (
    ("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"),
    ("block", "example.net/de/8"), ("block", "org/es/"),
)

#: Up to so many rules are one conditional expression; a longer list is joined as a table on the hosts' suffixes.
MOST_RULES = 500


def lower_az(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_path(url: Column) -> tuple[Column, Column]:
    part = lambda k: F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)([^?#]*)", k)
    return lower_az(part(1)), part(2)


def fitting(rules, host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest fitting rule (of equal ones the least); nulls where none fits."""
    rule = verdict = None
    for v, r in sorted(rules, key=lambda x: (-len(x[1]), x[1])):
        h, _, p = r.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule = F.when(fits, r) if rule is None else rule.when(fits, r)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def fitted(urls: DataFrame, rules, stash: Stash, name: str) -> DataFrame:
    """urls (host, path, more) with rule and said: of the longest fitting rule, of equal ones the least."""
    if len(rules) <= MOST_RULES:
        rule, verdict = fitting(rules, F.col("host"), F.col("path"))
        return urls.select("*", rule.alias("rule"), verdict.alias("said"))
    rows = [(h, "/" + p, r, v) for v, r in rules for h, _, p in [r.partition("/")]]
    known = urls.sparkSession.createDataFrame(rows, "h string, start string, rule string, said string")
    own = stash(urls.select("*", F.monotonically_increasing_id().alias("number")), name)
    suffix = let(F.split("host", r"\."), lambda p: F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, i, F.size(p)), ".")))
    hits = own.select("number", "path", F.explode(suffix).alias("h")).join(known, "h").where(F.col("path").startswith(F.col("start")))
    best = hits.groupBy("number").agg(F.min(F.struct((-F.length("rule")).alias("n"), "rule", "said")).alias("best"))
    return own.join(stash(best, f"{name}-best"), "number", "left").select(*urls.columns, "best.rule", "best.said")


def node(url: Column) -> Column:
    """A url's node; null without ``://``."""
    host, path = host_path(url)
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)?", 1)
    return F.when(url.contains("://"), F.xxhash64(host, F.regexp_replace(path, "/+$", ""), query))


def undotted(path: Column) -> Column:
    """The path without its . and .. segments."""
    parts = F.split(path, "/", -1)
    step = lambda got, x: F.when(x == ".", got).when(x == "..", F.slice(got, 1, F.greatest(F.size(got) - 1, F.lit(0)))).otherwise(F.concat(got, F.array(x)))
    kept = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.array().cast("array<string>"), step)
    return F.when(path.contains("/."), F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(path.rlike(r"/\.\.?$") & (F.size(kept) > 0), "/").otherwise(""))).otherwise(path)


def resolved(ref: Column, base: Column) -> Column:
    """The absolute url of a reference found under the url base; null where it names no other page."""
    part = lambda x, pattern: F.regexp_extract(x, pattern, 1)
    scheme, site = part(base, r"^([^:/?#]*)://"), part(base, r"^([^:/?#]*://[^/?#]*)")
    path = part(base, r"^[^:/?#]*://[^/?#]*([^?#]*)")
    own, rest = part(ref, r"^([^?#]*)"), F.regexp_extract(ref, r"^[^?#]*(.*)$", 1)
    folder = F.when(path == "", "/").otherwise(F.regexp_replace(path, "[^/]*$", ""))
    return (
        F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), ref)
        .when(ref.rlike(r"^([A-Za-z][A-Za-z0-9+.-]*:|#|$)") | (site == ""), F.lit(None).cast("string"))
        .when(ref.startswith("//"), F.concat(scheme, F.lit(":"), ref))
        .when(ref.startswith("/"), F.concat(site, undotted(own), rest))
        .when(ref.startswith("?"), F.concat(site, path, rest))
        .otherwise(F.concat(site, undotted(F.concat(folder, own)), rest))
    )


def targets(html: Column, url: Column) -> Column:
    """Absolute urls that the page declares as its canonical forms or redirects to, relative ones taken from its base."""
    tags = lambda p: F.regexp_extract_all(html, F.lit(p), F.lit(0))
    plain = lambda x: F.regexp_replace(x, r"(?i)&(?:amp|#0*38|#x0*26);", "&")
    href = lambda x: plain(F.regexp_extract(x, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1))
    found = F.concat(
        F.transform(tags(r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"), href),
        F.transform(tags(r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"), lambda x: plain(F.regexp_extract(x, r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1))),
    )
    under = F.coalesce(resolved(href(F.regexp_extract(html, r"(?is)<base\b[^>]*\bhref\s*=[^>]*>", 0)), url), url)
    whole = let(under, lambda base: F.filter(F.transform(found, lambda x: resolved(x, base)), lambda x: x.isNotNull()))
    some = html.rlike(r"(?i)canonical|http-equiv\s*=\s*[\"']?refresh")
    return F.when(some, whole).otherwise(F.array().cast("array<string>"))


def judge(pages: DataFrame, stash: Stash, rules=RULES, links: DataFrame | None = None) -> DataFrame:
    host, path = host_path(F.col("url"))
    p = pages.select("page_id", host.alias("host"), path.alias("path"), node(F.col("url")).alias("node"), targets(F.col("html"), F.col("url")).alias("to"))
    p = stash(fitted(p, rules, stash, "pages"), "scan")
    aims = p.select(F.col("node").alias("a"), F.explode("to").alias("url"))
    edges = aims.select("a", node(F.col("url")).alias("b"))
    named = aims.select("url")
    if links is not None:
        edges = edges.unionAll(links.select(node(F.col("src")).alias("a"), node(F.col("dst")).alias("b")))
        named = named.unionAll(links.select("src")).unionAll(links.select("dst"))
    cc = components(edges, stash, "urls").withColumnRenamed("id", "node")
    # written before they are joined: the largest component is a key that Spark can then split
    placed = stash(p.join(cc, "node", "left").select("page_id", "host", "path", "rule", "said", F.coalesce("component", "node").alias("group")), "placed")
    # urls that edges name are judged as well: most targets of redirects are no rows of pages
    judged = fitted(named.select(node(F.col("url")).alias("node"), host.alias("host"), path.alias("path")), rules, stash, "named").select("node", "said")
    judged = judged.where("node is not null and said is not null").distinct().join(cc, "node", "left").select(F.coalesce("component", "node").alias("group"), "said")
    said = placed.where("said is not null and group is not null").select("group", "said").unionAll(judged)
    said = stash(said.groupBy("group").agg(F.max(F.col("said") == "allow").alias("allowed")), "said")
    out = placed.join(said, "group", "left")
    final = F.coalesce("said", F.when(~F.col("allowed"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", final.alias("verdict"))


def op2(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), Stash(spark))


#: The same with strings for nodes and a recursive closure of the links.
ORACLE_SQL = r"""
with recursive
rules(said, rule) as (values """ + ", ".join(f"('{v}', '{r}')" for v, r in RULES) + r"""),
base as (
  select row_number() over () as k, page_id, url, html,
    regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>', 0) as link,
    regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>', 0) as meta from pages),
found as (
  select k, url, unnest([regexp_extract(link, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1), regexp_extract(meta, '(?is)\burl\s*=\s*["'']?([^"''\s>;]+)', 1)]) as x from base),
whole as (
  select k, case when contains(x, '://') then x when starts_with(x, '//') then regexp_extract(url, '^([^:/?#]*)://', 1) || ':' || x
    when starts_with(x, '/') then regexp_extract(url, '^([^:/?#]*://[^/?#]*)', 1) || x end as url from found where x <> ''),
urls as (select k, false as target, url from base union all select k, true, url from whole),
parts as (
  select k, target, url, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 2) as path from urls),
nodes as (select *, case when contains(url, '://') then host || chr(10) || regexp_replace(path, '/+$', '') || chr(10) || regexp_extract(url, '^[^?#]*(\?[^#]*)?', 1) end as node from parts),
edges as (select a.node as x, b.node as y from nodes a join nodes b on a.k = b.k and not a.target and b.target where a.node <> b.node),
ways as (select x, y from edges union select y, x from edges),
reach(x, y) as (select x, y from ways union select reach.x, ways.y from reach join ways on ways.x = reach.y),
own as (
  select n.k, n.host, n.path, n.node, arg_max(rule, length(rule)) as rule, arg_max(said, length(rule)) as said from nodes n left join rules
    on (n.host = split_part(rule, '/', 1) or ends_with(n.host, '.' || split_part(rule, '/', 1))) and starts_with(n.path, substr(rule, strpos(rule, '/')))
  where not n.target group by all),
near as (select node as x, node as y from own where node is not null union select x, y from reach),
told as (select near.x as node, bool_or(own.said = 'allow') as allowed from near join own on own.node = near.y where own.said is not null group by near.x)
select page_id, host, path, rule, coalesce(said, case when not allowed then 'block' else 'allow' end) as verdict
from own join base using (k) left join told using (node)
"""

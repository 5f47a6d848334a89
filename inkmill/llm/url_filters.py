"""URL filters with redirect equivalence. DataFrame functions only.

A page's own rule decides where one fits. Other pages follow their class: URLs joined by canonical links,
meta refreshes and given redirects, directly or through others, are aliases, and an alias of a blocked
URL is blocked, unless any URL of its class is explicitly allowed. URLs that are only linked to are judged
too. Aliases are keyed by host, path and query; scheme and fragment don't tell URLs apart.

Of the rules that fit a URL the longest counts, of equally long ones the greatest text; where one rule is given with both actions,
it allows. Null URLs and URLs without ``://`` have an empty host and path, fit no rule, join no class and are allowed.
Null HTML has no links. Rows that repeat are judged alike and all returned; an empty table gives no rows. Of pages only page_id, url and html are
read, so other columns may have any names. Long URLs and texts are only matched against patterns without backtracking over them. What has one host and
path, one class or one key may be any share of the rows: such joins go through ``attach``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, components, stash

#: Up to this many rules are one CASE expression; more go through a join on the host's suffixes.
INLINE = 256
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UP, _LOW), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(url: Column) -> Column:
    """128 bits of host, path and query; null where there is no host."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*(\?[^#]*)", 1)
    digest = F.unhex(F.substring(F.sha2(F.concat(host_of(url), path_of(url), query), 256), 1, 32))
    return F.when(host_of(url) != "", digest)


def _split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def settled(rules: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """One action for each rule: allow precedes block."""
    return [("allow" if ("allow", text) in rules else action, text) for text, action in {t: a for a, t in rules}.items()]


def judged(df: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Adds rule and action (null where none fits) to a frame with host and path. rules: (action, rule)."""
    rules = settled(rules)
    if len(rules) <= INLINE:
        rule = action = F.lit(None).cast("string")
        for act, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
            host, path = _split_rule(text)
            fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
            rule, action = F.when(fits, text).otherwise(rule), F.when(fits, act).otherwise(action)
        return df.withColumn("rule", rule).withColumn("action", action)
    listed = df.sparkSession.createDataFrame([(*_split_rule(t), t, a) for a, t in rules], "rule_host string, rule_path string, rule string, action string")
    places = stash(df.groupBy("host", "path").agg(F.count(F.lit(1)).alias("_pages")), "url-places")
    parts = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    tried = places.select("host", "path", F.explode(ends).alias("rule_host"))
    of_host = listed.groupBy("rule_host").agg(F.collect_list(F.struct("rule_path", "rule", "action")).alias("_rules"))
    of_host = stash(tried.groupBy("rule_host").agg(F.count(F.lit(1)).alias("_tried")).join(of_host, "rule_host"), "url-rules")
    found = attach(tried, of_host, ["rule_host"], "_tried", tried.count())
    fitting = F.filter("_rules", lambda r: F.col("path").startswith(r["rule_path"]))
    longest = F.array_max(F.transform(fitting, lambda r: F.struct(F.length(r["rule"]).alias("n"), r["rule"].alias("rule"), r["action"].alias("action"))))
    best = found.groupBy("host", "path").agg(F.max(longest).alias("m")).join(places, ["host", "path"])
    return attach(df, best.select("host", "path", "m.rule", "m.action", "_pages"), ["host", "path"], "_pages", df.count(), "left").drop("_pages")


_DOTS = r"://[^?#]*/\.\.?(?:[/?#]|$)"


def decoded(text: Column) -> Column:
    """Character references of ASCII characters, by number or the five names of XML."""
    parts = F.split(text, "&#")
    number = lambda p: F.coalesce(F.conv(F.regexp_extract(p, "^[xX]([0-9a-fA-F]{1,6});", 1), 16, 10), F.nullif(F.regexp_extract(p, "^([0-9]{1,7});", 1), F.lit(""))).try_cast("long")
    one = lambda p: F.when(number(p).between(1, 127), F.concat(F.char(number(p)), F.regexp_replace(p, "^[^;]*;", ""))).otherwise(F.concat(F.lit("&#"), p))
    out = F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), one), ""))
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def without_dots(url: Column) -> Column:
    """The URL without segments . and .. in its path."""
    site, tail = F.regexp_extract(url, "^[^?#]*?://[^/?#]*", 0), F.regexp_extract(url, "[?#].*$", 0)
    parts = F.split(F.substring(path_of(url), 2, F.length(url)), "/")
    empty = F.array().cast("array<string>")
    up = lambda a: F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))
    kept = F.aggregate(parts, empty, lambda a, p: F.when(p == "..", up(a)).when(p == ".", a).otherwise(F.concat(a, F.array(p))))
    end = F.when(F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0), "/").otherwise("")
    return F.concat(site, F.lit("/"), F.array_join(kept, "/"), end, tail)


def link_edges(pages: DataFrame) -> DataFrame:
    """(url, target): canonical links and meta refreshes of pages, made absolute."""
    quote = "[\"']?"
    canonical = F.regexp_extract_all("html", F.lit(rf"(?is)<link\s[^>]*rel\s*=\s*{quote}canonical\b[^>]*>"), F.lit(0))
    refresh = F.regexp_extract_all("html", F.lit(rf"(?is)<meta\s[^>]*http-equiv\s*=\s*{quote}refresh\b[^>]*>"), F.lit(0))
    href = F.transform(canonical, lambda tag: F.regexp_extract(tag, rf"(?is)href\s*=\s*{quote}([^\"'\s>]+)", 1))
    url = F.transform(refresh, lambda tag: F.regexp_extract(tag, rf"(?is)url\s*=\s*{quote}((?:&#?\w+;|[^\"'\s>;])+)", 1))  # the ; of a reference ends no url
    # outer, as a plain explode has the patterns searched again to find out whether the array is empty; written, as most pages have no link and the
    # expressions below would be planned into one another
    raw = pages.where(host_of(F.col("url")) != "").select("url", F.explode_outer(F.array_distinct(F.concat(href, url))).alias("to")).where("to <> ''")
    raw = stash(stash(raw, "url-links").withColumn("to", decoded(F.col("to"))), "url-decoded")
    folder = F.regexp_replace(path_of(F.col("url")), "[^/]*$", "")
    site = F.concat(F.lit("http://"), host_of(F.col("url")))
    target = (
        F.when(F.col("to").contains("://"), F.col("to"))
        .when(F.col("to").startswith("//"), F.concat(F.lit("http:"), "to"))
        .when(F.col("to").startswith("/"), F.concat(site, "to"))
        .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), "to"))
    )
    raw = stash(raw.select("url", target.alias("target")), "url-targets")
    return raw.withColumn("target", F.when(F.col("target").rlike(_DOTS), without_dots(F.col("target"))).otherwise(F.col("target")))


def url_filter(pages: DataFrame, rules: list[tuple[str, str]], redirects: DataFrame | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict. redirects: more edges (url, target)."""
    edges = link_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("url", "target"))
    edges = stash(edges.select("url", "target"), "url-pairs")
    ends = stash(edges.select("url", "target", key_of(F.col("url")).alias("a"), key_of(F.col("target")).alias("b")), "url-edges").where("a is not null and b is not null")
    own = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), key_of(F.col("url")).alias("key"))
    own = judged(own, rules)
    verdict = F.coalesce("action", F.lit("allow"))
    roots = components(ends.select("a", "b"), "url")
    if roots.isEmpty():  # nothing to propagate: a key has one host and path, so one rule
        return own.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
    nodes = ends.select(F.col("url"), F.col("a").alias("node")).union(ends.select("target", "b"))
    nodes = judged(nodes.select("node", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).distinct(), rules)
    some = [F.coalesce(F.bool_or(F.col("action") == a), F.lit(False)).alias(f"{a}s") for a in ("block", "allow")]
    classes = roots.join(nodes.select("node", "action"), "node").groupBy("root").agg(*some, F.count(F.lit(1)).alias("_nodes"))
    bad = stash(classes.where("blocks and not allows").select("root", "_nodes"), "url-classes")
    blocked = attach(roots, bad, ["root"], "_nodes", roots.count()).select(F.col("node").alias("key"))
    pages_of = own.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    blocked = stash(blocked.join(pages_of, "key").withColumn("aliased", F.lit("block")), "url-blocked")
    out = attach(own, blocked, ["key"], "size", own.count(), "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("action", "aliased", F.lit("allow")).alias("verdict"))

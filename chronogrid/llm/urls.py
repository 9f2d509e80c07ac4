"""URL filters with redirect equivalence.

Rules of host and path decide URLs that they fit, the longest one first.  Redirects and canonical links make URLs aliases:
connected components over these edges carry a block from a URL that a rule blocks, whether it is a page itself or only a
target, to its aliases; where a component also has a URL that a rule allows, the allow takes precedence.  A rule that fits a
URL always decides that URL.  URLs are the same if they differ in the case of scheme and host or in the fragment, or if one
has no path and the other `/`; other spellings (`www.`, tracking parameters, a final slash) are aliases only if asked for.

Null URLs and such without `://` have an empty host and path, fit no rule and have no alias; their verdict is allow.
Repeated rows are judged each; further columns of `pages` are passed on (columns named like the outputs are replaced).
"""

from __future__ import annotations

import html as references

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components

#: (verdict, host, path): the rules of the contract.  Fixed values.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

#: Query parameters that tell where a visitor came from and name no other page.
TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid)"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct of verdict and rule; null if none does."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    chain = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in reversed(ordered):
        fits = (F.concat(F.lit("."), host).endswith("." + h)) & path.startswith(p)
        chain = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(chain)
    return chain


def url_key(url: Column) -> Column:
    """What URLs of the same page have in common; null without `://`."""
    scheme, path = F.regexp_extract(url, r"(?s)\A(.*?)://", 1), path_of(url)
    query = F.regexp_extract(url, r"(?s)\A.*?://[^?#]*(\?[^#]*)", 1)
    return F.when(url.contains("://"), F.concat(ascii_lower(scheme), F.lit("://"), host_of(url), F.when(path == "", "/").otherwise(path), query))


def canonical(url: Column) -> Column:
    """The form that a site's own spellings of one page often share, to be used instead of `url_key`: without `www.` or `m.`, tracking parameter, fragment, final slash or `.html`, and with no scheme but `any`; null without `://`."""
    query = F.regexp_extract(url, r"(?s)\A[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(rf"\A{TRACKING}=")))
    host = F.regexp_replace(host_of(url), r"\A(?:www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"(?:/|\.html?|/index\.html?)\z", "")
    return F.when(url.contains("://"), F.concat(F.lit("any://"), host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))))


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of a tag, quoted or not; empty without one."""
    found = rf"(?is)[\s\"'/]{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\"'\s>]+))"
    return F.trim(F.concat(*[F.regexp_extract(tag, found, k) for k in (1, 2, 3)]))


def targets(html: Column) -> Column:
    """All URLs that a page names as its canonical form or sends its visitors to, as they are written: link rel=canonical, meta refresh, og:url."""
    tag = r"(?is)<%s(?=[\s/])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>"
    of = lambda name: F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(tag % name), F.lit(0))
    links = F.transform(F.filter(of("link"), lambda t: attribute(t, "rel").rlike(r"(?i)(?:\A|\s)canonical(?:\s|\z)")), lambda t: attribute(t, "href"))
    metas = of("meta")
    url = r"(?is)\A[^;,]*[;,]\s*url\s*=\s*[\"']?([^\"'\s>;]+)"
    sent = F.transform(F.filter(metas, lambda t: attribute(t, "http-equiv").rlike(r"(?i)\Arefresh\z")), lambda t: F.regexp_extract(attribute(t, "content"), url, 1))
    shared = F.transform(F.filter(metas, lambda t: attribute(t, "property").rlike(r"(?i)\Aog:url\z")), lambda t: attribute(t, "content"))
    return F.filter(F.concat(links, sent, shared), lambda t: t != "")


def resolved(target: Column, base: Column) -> Column:
    """`target` as it is meant on the page `base`, whose URL has a host: RFC 3986 without a check of the parts; null for schemes without one."""
    scheme = F.regexp_extract(base, r"(?s)\A(.*?)://", 1)
    site = F.regexp_extract(base, r"(?s)\A.*?://[^/?#]*", 0)
    path = path_of(base)
    folder = F.concat(site, F.when(path == "", "/").otherwise(F.regexp_extract(path, r"(?s)\A.*/", 0)))
    page = F.regexp_extract(base, r"(?s)\A[^?#]*", 0)
    whole = (
        F.when(target.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*://"), target).when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(site, target)).when(target.startswith("?"), F.concat(page, target)).when(target.startswith("#"), base)
        .when(~target.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:"), F.concat(folder, target))
    )
    host, own = F.regexp_extract(whole, r"(?s)\A.*?://[^/?#]*", 0), path_of(whole)
    rest = F.substring(whole, F.char_length(host) + F.char_length(own) + 1, F.char_length(whole))
    parts = F.slice(F.split(own, "/"), 2, F.greatest(F.size(F.split(own, "/")) - 1, F.lit(0)))

    def step(acc: Column, x: Column) -> Column:
        return F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x)))

    walked = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    final = F.when(own.rlike(r"/\.{1,2}\z") & (walked != ""), "/").otherwise("")
    return F.when(own.rlike(r"/\.{1,2}(?:/|\z)"), F.concat(host, F.lit("/"), walked, final, rest)).otherwise(whole)


@F.pandas_udf(T.StringType())
def unescaped(text: pd.Series) -> pd.Series:
    """Character references as what they stand for."""
    return text.map(references.unescape, na_action="ignore")


def page_edges(pages: DataFrame, key=url_key) -> DataFrame:
    """(u, v) of the keys of each page's URL and of all that it redirects or links to as its canonical form."""
    found = pages.where(F.col("html").rlike(r"(?i)canonical|http-equiv|og:url") & F.col("url").contains("://")).select("url", F.explode(targets(F.col("html"))).alias("t"))
    found = found.select("url", F.trim(unescaped("t")).alias("t"))
    return found.select(key(F.col("url")).alias("u"), key(resolved(F.col("t"), F.col("url"))).alias("v")).where("u is not null and v is not null and u <> v")


def judge(pages: DataFrame, edges: DataFrame, rules=RULES, key=url_key) -> DataFrame:
    """`pages` with host, path, rule, verdict; `edges` (u, v) join keys of URLs."""
    url = F.col("url")
    own = pages.select(*[c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "_key", "_fit")])
    own = own.withColumn("host", host_of(url)).withColumn("path", path_of(url)).withColumn("_key", key(url))
    own = own.withColumn("_fit", rule_of(F.col("host"), F.col("path"), rules))

    # a key ties all URLs that have it, and edges tie keys; only keys of components that are blocked go back to the pages
    joined = components(edges)
    fit = rule_of(host_of(F.col("node")), path_of(F.col("node")), rules)["verdict"]
    blocked, allowed = (F.max(F.when(fit == v, 1).otherwise(0)) for v in ("block", "allow"))
    tied = joined.groupBy("root").agg(blocked.alias("b"), allowed.alias("a")).where("b = 1 and a = 0")
    carried = joined.join(tied.select("root"), "root", "left_semi").select(F.col("node").alias("_key"), F.lit(True).alias("_blocked"))
    out = own.join(carried, "_key", "left")
    verdict = F.coalesce(F.col("_fit.verdict"), F.when(F.col("_blocked"), "block").otherwise("allow"))
    return out.select(*[c for c in own.columns if c not in ("_key", "_fit")], F.col("_fit.rule").alias("rule"), verdict.alias("verdict"))


def op5_urls(pages: DataFrame) -> DataFrame:
    """Contract digest: page_id, host, path, rule and verdict of every page."""
    return judge(pages.select("page_id", "url"), page_edges(pages)).select("page_id", "host", "path", "rule", "verdict")

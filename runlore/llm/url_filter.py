"""URL rules spread over redirects and canonical links (operator 2).

A rule names a host (with its subdomains) and a path prefix, and allows or blocks. The longest that fits decides. Pages
that no rule fits are judged by their aliases: the urls that redirects and canonical links join, as connected components
of all urls. An alias that is allowed by a rule outweighs any that is blocked; else one that is blocked blocks; else
pages are allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlore.llm.common import written
from runlore.llm.components import connected_components

#: A list of rules up to this many rows is broadcast (some MB); a longer one is joined by shuffle.
BROADCAST_RULES = 20_000
#: A name and its value; read one after another, so that what stands in a quoted value is no name. A name begins where no
#: letter of a name stands before it, and nothing is given back, so a tag is read once however long its names are.
ATTRIBUTE = "(?s)(?<![^\\s\"'<>/=])([^\\s\"'<>/=]++)\\s*+=\\s*+(\"[^\"]*+\"|'[^']*+'|[^\\s\"'>]++)"
#: A tag that can hold a link; a > or < in a quoted value does not end it.
LINK_TAG = "(?is)<(?:link|meta)[\\s/](?:[^<>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+>"
#: What holds no tags; without its end it reaches to the end of the page.
HIDDEN = "(?is)<!--.*?(?:-->|\\z)|<(script|style)\\b.*?(?:</\\1\\s*>|\\z)"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for a null url or none with ://."""
    host = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty for a null url or none with ://."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def attribute(names: Column, values: Column, name: str) -> Column:
    """The value of a tag's first attribute of that name; empty where it has none."""
    at = F.array_position(names, name)
    return F.when(at > 0, F.regexp_replace(F.get(values, at.cast("int") - 1), "(?s)^([\"'])(.*)\\1$", "$2")).otherwise(F.lit(""))


def resolved(link: Column, base: Column) -> Column:
    """A link's absolute url, without its fragment; empty where it names no page."""
    link = F.regexp_replace(F.regexp_replace(F.trim(link), "&amp;", "&"), "(?s)#.*$", "")
    scheme = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    site = F.regexp_extract(base, "(?s)^(.*?://[^/?#]*)", 1)
    folder = F.concat(site, F.regexp_replace(F.concat(F.lit("/"), F.regexp_replace(path_of(base), "^/", "")), "[^/]*$", ""))
    return (
        F.when((link == "") | F.coalesce(~base.contains("://"), F.lit(True)), F.lit(""))
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(site, link))
        .when(link.startswith("?"), F.concat(site, path_of(base), link))
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(""))
        .otherwise(F.concat(folder, link))
    )


def alias_links(pages: DataFrame) -> DataFrame:
    """src, dst: the links of pages (url, html) to the urls that their canonical links and refresh redirects name."""
    shown = F.regexp_replace(F.coalesce(F.col("html").cast("string"), F.lit("")), HIDDEN, " ")
    tags = F.regexp_extract_all(shown, F.lit(LINK_TAG), F.lit(0))
    rows = pages.select(F.col("url").cast("string").alias("url"), F.explode(tags).alias("tag"))
    # Step by step, so that no expression holds another one many times over.
    named = {"rel": "rel", "to": "href", "kind": "http-equiv", "content": "content"}
    found = [F.regexp_extract_all("tag", F.lit(ATTRIBUTE), F.lit(i)) for i in (1, 2)]
    rows = rows.select("url", F.transform(found[0], F.lower).alias("names"), found[1].alias("values"))
    rows = rows.select("url", *(attribute(F.col("names"), F.col("values"), x).alias(c) for c, x in named.items()))
    canonical = F.when(F.array_contains(F.split(F.lower("rel"), "\\s+"), "canonical"), F.col("to"))
    moved = F.when(F.lower("kind") == "refresh", F.regexp_extract("content", "(?is)url\\s*=\\s*['\"]?([^'\"]*)", 1))
    rows = rows.select("url", F.coalesce(canonical, moved, F.lit("")).alias("link")).where("link <> '' and url is not null")
    rows = rows.select("url", resolved(F.col("link"), F.col("url")).alias("dst")).where("dst <> ''")
    return rows.select(plain(F.col("url")).alias("src"), plain(F.col("dst")).alias("dst"))


def plain(url: Column) -> Column:
    """The one spelling of a url that stands for all that name the same page: no fragment, scheme and host in lower case,
    no default port, dot segments resolved, / for an empty path. A text without :// only loses its fragment."""
    url = F.regexp_replace(url, "(?s)#.*$", "")
    part = lambda i: F.regexp_extract(url, "(?s)^(.*?)://([^/?]*)([^?]*)(.*)$", i)
    scheme = F.lower(part(1))
    host = F.translate(part(2), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    host = F.when(scheme == "http", F.regexp_replace(host, ":(?:80)?$", "")).when(scheme == "https", F.regexp_replace(host, ":(?:443)?$", "")).otherwise(host)
    names = F.split(part(3), "/", -1)
    last = F.when(F.element_at(names, -1).isin(".", ".."), F.concat(names, F.array(F.lit("")))).otherwise(names)
    step = lambda a, x: F.when(x == ".", a).when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(1)))).otherwise(F.concat(a, F.array(x)))
    path = F.when(part(3).contains("/."), F.array_join(F.aggregate(last, F.array().cast("array<string>"), step), "/")).otherwise(part(3))
    return F.when(url.contains("://"), F.concat(scheme, F.lit("://"), host, F.when(path == "", F.lit("/")).otherwise(path), part(4))).otherwise(url)


def with_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (distinct url) as url, host, path, rule, decision; the last two null where no rule fits. Of rules with the
    same host and path, allow wins. A rule without a host fits nothing."""
    own = urls.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    tidy = rules.where("host <> ''").groupBy("host", F.coalesce(F.col("path"), F.lit("")).alias("prefix")).agg(F.min("verdict").alias("decision"))
    tidy = tidy.withColumnRenamed("host", "suffix")
    if tidy.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        tidy = F.broadcast(tidy)
    # A host's suffixes at its dots are as many as its labels.
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    fits = own.select("url", "path", F.explode(suffixes).alias("suffix")).join(tidy, "suffix").where(F.col("path").startswith(F.col("prefix")))
    rule = F.concat("suffix", "prefix")
    best = fits.groupBy("url").agg(F.max(F.struct(F.length(rule).alias("n"), (F.col("decision") == "allow").alias("allowed"), rule.alias("rule"), "decision")).alias("b"))
    return own.join(best.select("url", "b.rule", "b.decision"), "url", "left")


def judge_urls(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, url, host, path, rule, verdict, alias_verdict for every row of pages (page_id, url, html).

    rules: host, path, verdict (allow or block). redirects: further links src, dst between urls, such as those of a
    crawl's log. alias_verdict: what the component says, null where no rule fits any url of it. Null urls and urls
    without :// have an empty host and path, fit no rule and have no aliases: allowed. Null html has no links. Fragments,
    the case of hosts, default ports, empty paths and dot segments do not tell aliases apart. Tags in comments, scripts and
    styles make no links. Null page_ids pass through; ties and repeated rows are judged alike; an empty table gives
    an empty one, and no rules allow everything. Other columns are ignored.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    links = alias_links(own)
    if redirects is not None:
        links = links.unionByName(redirects.select(plain(F.col("src")).alias("src"), plain(F.col("dst")).alias("dst")))
    links = written(links.distinct(), "links")
    roots = connected_components(links)
    names = own.select("url").unionByName(links.select(F.col("src").alias("url"))).unionByName(links.select(F.col("dst").alias("url"))).where("url is not null").distinct()
    judged = written(with_rules(names, rules).withColumn("node", plain(F.col("url"))), "judged")
    classes = judged.where("decision is not null").join(roots, "node").groupBy("root").agg(F.min("decision").alias("alias_verdict"))
    known = roots.join(classes, "root").select("node", "alias_verdict")
    urls = judged.join(known, "node", "left").drop("node")
    out = own.select("page_id", "url").join(urls, "url", "left")
    verdict = F.coalesce("decision", "alias_verdict", F.lit("allow"))
    return out.select("page_id", "url", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "rule", verdict.alias("verdict"), "alias_verdict")

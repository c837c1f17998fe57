"""URL filtering with redirect equivalence: rules judge an address, aliases inherit the judgement.

DataFrame functions only. Addresses joined by redirects or canonical links form components; a component
that holds an explicitly allowed address is allowed, else one that holds a blocked address is blocked.
An address's own rule always wins over what its component says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import LOWER, UPPER, fresh, settled
from cuelake.llm.components import components

#: Rule tables up to so many rows are broadcast (about 100 bytes each); longer ones are joined by a shuffle.
BROADCAST_RULES = 100_000


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty if there is none."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def address_of(url: Column) -> Column:
    """Host, path and query: http and https, and any fragment, name the same page. Null without a host."""
    tail = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), tail))


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, quoted or not, with its character references undone; empty without one."""
    value = rf"(?is)<[^>]*?(?<![\w-]){name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\"'\s>]+))"
    text = F.concat(*[F.regexp_extract(tag, value, k) for k in (1, 2, 3)])
    for mark, meant in (("(?i)&(?:quot|#0*34|#x0*22);", '"'), ("(?i)&(?:apos|#0*39|#x0*27);", "'"), ("(?i)&(?:lt|#0*60|#x0*3c);", "<"), ("(?i)&(?:gt|#0*62|#x0*3e);", ">"), ("(?i)&(?:amp|#0*38|#x0*26);", "&")):
        text = F.regexp_replace(text, mark, meant)
    return F.trim(F.translate(text, "\t\r\n", ""))


def _without_dots(path: Column) -> Column:
    """A path that starts with a slash, its . and .. steps taken."""
    steps = F.split(path, "/")
    last = F.element_at(steps, -1)
    kept = F.aggregate(
        F.slice(steps, 2, F.size(steps)),
        F.array().cast("array<string>"),
        lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.concat(done, F.array(x))),
    )
    return F.concat(F.lit("/"), F.array_join(F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/"))


def resolve(base: Column, to: Column) -> Column:
    """The url that a reference on the page at base means (RFC 3986, 5.2). A url that has its own host stays as
    it is; null for the page itself, other schemes (mailto:) and relative references on a page without host."""
    host, path = host_of(base), path_of(base)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, r"(?s)^.*/", 0))
    plain = F.regexp_extract(to, r"(?s)^[^?#]*", 0)
    rest = F.regexp_extract(to, r"(?s)^[^?#]*(.*)$", 1)
    return (
        F.when((to == "") | to.startswith("#"), F.lit(None))
        .when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to)
        .when(to.startswith("//"), F.concat(F.lit("http:"), to))
        .when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (host == ""), F.lit(None))
        .when(to.startswith("?"), F.concat(F.lit("http://"), host, path, to))
        .otherwise(F.concat(F.lit("http://"), host, _without_dots(F.when(to.startswith("/"), plain).otherwise(F.concat(folder, plain))), rest))
    )


def _step(rows: DataFrame, **columns: Column) -> DataFrame:
    """A projection that stands by itself: the optimiser would put its expressions into every place where a later
    step or filter names its columns, and texts that are taken apart in steps would multiply."""
    return rows.select(F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def html_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst) addresses: each page and the targets of its canonical links and refresh redirects.

    Relative targets are resolved against the page's first <base href>, else its url; of character references
    those for & < > " and ' are undone. Pages without such a link give no row.
    """
    html, url = F.col(html_col), F.col(url_col)
    rel = r"<link\b[^>]*(?<![\w-])rel\s*=\s*(?:\"(?:[^\">]*\s)?canonical[\s\"]|'(?:[^'>]*\s)?canonical[\s']|canonical(?=[\s/>]))[^>]*>"
    refresh = r"<meta\b[^>]*(?<![\w-])http-equiv\s*=\s*[\"']?\s*refresh\b[^>]*>"
    # seconds, then a url that may be named and quoted
    told = r"(?is)^\s*(?:[\d.]+\s*[;,\s]\s*(?:url\s*=\s*)?|[;,]?\s*url\s*=\s*)(?:\"([^\"]*)|'([^']*)|(.*))"
    base = F.regexp_extract(html, r"(?is)<base\b[^>]*(?<![\w-])href\s*=[^>]*>", 0)
    tags = F.regexp_extract_all(html, F.lit(f"(?is){rel}|{refresh}"), F.lit(0))
    marked = pages.where(html.rlike("(?i)canonical|http-equiv")).select(url.alias("url"), base.alias("base"), tags.alias("tags"))
    found = marked.select("url", "base", F.explode("tags").alias("tag"))
    u, to = F.col("url"), F.col("to")
    is_link = F.lower(F.substring("tag", 1, 5)) == "<link"
    named = _step(found, url=u, base=_attribute(F.col("base"), "href"), is_link=is_link, to=F.when(is_link, _attribute(F.col("tag"), "href")).otherwise(_attribute(F.col("tag"), "content")))
    redirect = F.trim(F.concat(*[F.regexp_extract(to, told, k) for k in (1, 2, 3)]))
    based = _step(named, url=u, base=F.coalesce(resolve(u, F.col("base")), u), to=F.when(F.col("is_link"), to).otherwise(redirect))
    resolved = _step(based, url=u, to=resolve(F.col("base"), to))
    links = _step(resolved, src=address_of(u), dst=address_of(to))
    return links.where("src is not null and dst is not null and src <> dst").distinct()


def match_rules(places: DataFrame, rules: DataFrame, key: str, host: str = "host", path: str = "path") -> DataFrame:
    """(key, rule, verdict): for each place the longest rule whose host is its host or a parent of it and
    whose path starts the place's path. Equal lengths: allow wins, then the smaller rule."""
    labels = F.split(host, r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    probes = places.where(F.col(host) != "").select(key, F.col(path).alias("_path"), F.explode(ends).alias("_host"))
    known = rules.select(F.col("host").alias("_host"), F.col("path").alias("_start"), F.col("verdict").alias("_verdict")).distinct()
    if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        known = F.broadcast(known)
    rule = F.concat("_host", "_start")
    best = F.struct(-F.length(rule), F.col("_verdict"), rule.alias("rule"))
    return (
        probes.join(known, "_host").where(F.col("_path").startswith(F.col("_start"))).groupBy(key).agg(F.min(best).alias("_best")).select(key, F.col("_best.rule").alias("rule"), F.col("_best._verdict").alias("verdict"))
    )


def filter_urls(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, url_col: str = "url", html_col: str | None = "html", default: str = "allow") -> DataFrame:
    """pages with host, path, rule, alias_group and verdict (allow or block).

    rules: (host, path, verdict). redirects: more (src, dst) urls that name the same page. A null url, or
    one without ://, has an empty host and path, fits no rule and gets the default. Repeated pages are
    judged alike; empty tables give an empty result. An input column named like a result is replaced.
    """
    pages = settled(pages)
    row, addr, told, said = fresh(pages, "_row", "_address", "_told", "_said")
    url = F.col(url_col)
    judged = ["host", "path", "rule", "alias_group", "verdict"]
    keep = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in judged and c != html_col]
    places = pages.select(F.monotonically_increasing_id().alias(row), *keep, host_of(url).alias("host"), path_of(url).alias("path"), address_of(url).alias(addr))
    own = match_rules(places.select(row, "host", "path"), rules, row)
    links = None
    if html_col is not None and html_col in pages.columns:
        links = html_links(pages, url_col, html_col)
    if redirects is not None:
        more = redirects.select(address_of(F.col("src")).alias("src"), address_of(F.col("dst")).alias("dst"))
        links = more if links is None else links.unionByName(more)
    out = places.join(own.withColumnRenamed("verdict", told), row, "left")
    groups = None if links is None else components(links)
    if groups is None or groups.isEmpty():  # no aliases: every verdict is the page's own
        return out.select(*keep, "host", "path", "rule", F.lit(None).cast("string").alias("alias_group"), F.coalesce(told, F.lit(default)).alias("verdict"))
    nodes = groups.select("node", "component", host_of(F.concat(F.lit("x://"), F.col("node"))).alias("host"), path_of(F.concat(F.lit("x://"), F.col("node"))).alias("path"))
    decided = (
        nodes.join(match_rules(nodes, rules, "node"), "node")
        .groupBy("component")
        .agg(F.min("verdict").alias(said))  # 'allow' sorts before 'block'
    )
    by_node = groups.join(decided, "component", "left").select(F.col("node").alias(addr), F.col("component").alias("alias_group"), said)
    return out.join(by_node, addr, "left").select(*keep, "host", "path", "rule", "alias_group", F.coalesce(told, said, F.lit(default)).alias("verdict"))

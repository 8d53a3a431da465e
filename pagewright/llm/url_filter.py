"""URL filter with redirect equivalence, DataFrame operations only.

URLs that redirect to each other or name each other as canonical are aliases.
Rules (host and path prefix; block or allow) judge a URL by its longest match.
A URL without a rule is blocked if an alias of it is blocked by a rule: block
decisions spread over connected components of the alias graph, while a URL's
own allow rule takes precedence over what its aliases bring.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components

#: Fixed values: (host, path prefix, verdict).
RULES: tuple[tuple[str, str, str], ...] = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""
_REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*?\bcontent\s*=\s*["']?[^"'>]*?\burl\s*=\s*([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty where the host is."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """``struct(rule, verdict)`` of the longest matching rule, null if none matches.

    A rule fits its host and all its subdomains if the path starts with the
    rule's; the longest is that with most characters in host and path, ties by name.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[0]) - len(r[1]), r[0], r[1]))
    fits = [((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p)) for h, p, _ in ordered]
    return F.coalesce(*[F.when(fit, F.struct(F.lit(f"{h}{p}").alias("rule"), F.lit(v).alias("verdict"))) for fit, (h, p, v) in zip(fits, ordered, strict=True)], F.lit(None))


def alias_key(url: Column) -> Column:
    """A URL's node in the alias graph: scheme and fragment dropped, host lower-cased."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), F.when(rest == "", "/").otherwise(rest)))


def _without_dots(path: Column) -> Column:
    """A path that begins with ``/`` without its ``.`` and ``..`` segments."""
    steps = F.split(F.substring(path, 2, 1 << 30), "/")
    up = F.element_at(steps, -1).isin(".", "..")
    dropped = lambda kept: F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
    kept = F.aggregate(steps, F.array().cast("array<string>"), lambda held, x: F.when(x == "..", dropped(held)).when(x == ".", held).otherwise(F.concat(held, F.array(x))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(up & (F.size(kept) > 0), "/").otherwise(""))


def page_links(pages: DataFrame) -> DataFrame:
    """``(src, dst)`` URLs of canonical links and refresh redirects in the pages' HTML.

    Targets that name no host are completed from the page's URL: ``/`` from its host,
    ``?`` from its path, others from the directory of its path, with ``.`` and ``..``
    taken out; ``&amp;`` stands for ``&``.  Targets of other schemes (``mailto:``) are left out.
    """
    named = pages.where("url is not null and html is not null").select("url", F.explode(F.array_distinct(F.concat(F.regexp_extract_all("html", F.lit(_CANONICAL), 1), F.regexp_extract_all("html", F.lit(_REFRESH), 1)))).alias("to")).withColumn("to", F.replace(F.col("to"), F.lit("&amp;"), F.lit("&")))
    scheme = F.regexp_extract("url", r"(?s)^(.*?)://", 1)
    root = F.concat(scheme, F.lit("://"), host_of(F.col("url")))
    own = F.when(path_of(F.col("url")) == "", "/").otherwise(path_of(F.col("url")))
    path, rest = F.regexp_extract("to", r"(?s)^[^?#]*", 0), F.regexp_extract("to", r"(?s)^[^?#]*(.*)$", 1)
    below = F.concat(root, _without_dots(F.concat(F.regexp_extract(own, r"(?s)^.*/", 0), path)), rest)
    full = (
        F.when(F.startswith("to", F.lit("//")), F.concat(scheme, F.lit(":"), "to"))
        .when(F.col("to").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.when(F.contains("to", F.lit("://")), F.col("to")))
        .when(F.startswith("to", F.lit("/")), F.concat(root, "to"))
        .when(path == "", F.concat(root, own, F.when(F.startswith("to", F.lit("?")), "").otherwise(F.regexp_extract("url", r"(?s)^[^?#]*(\?[^#]*)", 1)), rest))
        .otherwise(below)
    )
    return named.select(F.col("url").alias("src"), full.alias("dst")).where("dst is not null")


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """``(page_id, host, path, rule, verdict)``, one row for each row of ``pages``.

    ``redirects`` adds ``(src, dst)`` URLs, say of a crawl log.  A null url, or one
    without ``://``, has an empty host and path, no aliases, and is allowed.  URLs
    that pages share are one node; targets need not be pages, and a rule that
    blocks a target blocks its aliases too.
    """
    base = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = base.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).withColumn("key", F.when(F.col("host") != "", F.xxhash64(alias_key(F.col("url")))))
    links = page_links(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select("src", "dst"))
    links = links.select(alias_key(F.col("src")).alias("a"), alias_key(F.col("dst")).alias("b"), "src", "dst").where("a is not null and b is not null and a <> b")
    edges = links.select(F.xxhash64("a").alias("src"), F.xxhash64("b").alias("dst"))
    groups = connected_components(edges)
    ends = links.select(F.xxhash64("a").alias("node"), F.col("src").alias("u")).unionByName(links.select(F.xxhash64("b").alias("node"), F.col("dst").alias("u")))
    blocked_ends = ends.where(rule_of(host_of(F.col("u")), path_of(F.col("u")), rules)["verdict"] == "block").select("node").distinct()
    tainted = groups.join(blocked_ends, "node").select("component").distinct()
    blocked = groups.join(tainted, "component").select(F.col("node").alias("key")).distinct().withColumn("hit", F.lit(True))
    # URLs without a host have no aliases, and no part in the join that their one key would crowd
    named = judged.where("key is not null").join(blocked, "key", "left")
    decided = named.unionByName(judged.where("key is null").withColumn("hit", F.lit(None).cast("boolean")))
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("hit"), "block"), F.lit("allow"))
    return decided.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"))

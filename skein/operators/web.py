"""Links of web pages and a breadth-first crawl over a table of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import strip, unescape_html
from skein.session import materialize

HREF = r"""(?is)<a\s+[^>]*href=["']([^"']+)["']"""


#: The parts of a reference (RFC 3986, appendix B).
PARTS = r"^(?:([^:/?#]+):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?"


def without_dots(segments: Column) -> Column:
    """The segments of a path without ``.`` and ``..``, which take away the one before them."""
    start = F.array().cast("array<string>")
    step = lambda kept, s: F.when(s == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).when(s == ".", kept).otherwise(F.concat(kept, F.array(s)))
    last = F.element_at(segments, -1)
    return F.aggregate(segments, start, step, lambda kept: F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept))


def resolved(base: Column, ref: Column) -> Column:
    """The reference as an absolute address (RFC 3986, section 5.2), without its fragment."""
    part = lambda c, k: F.regexp_extract(c, PARTS, k)
    scheme, authority, path = part(base, 1), part(base, 2), part(base, 3)
    own, query = part(ref, 3), part(ref, 4)
    folder = F.split(path, "/")
    folder = F.when(F.element_at(folder, -1) == "", folder).otherwise(F.slice(folder, F.lit(1), F.size(folder) - 1))
    steps = F.when(own.startswith("/"), F.split(own, "/")).otherwise(F.concat(folder, F.split(own, "/")))
    # empty names inside a path are dropped, but not its first and last
    inner = F.filter(steps, lambda s, i: (s != "") | (i == 0) | (i == F.size(steps) - 1))
    kept = F.array_join(without_dots(inner), "/")
    kept = F.when(kept.startswith("/"), kept).otherwise(F.concat(F.lit("/"), kept))
    stem = F.concat(scheme, F.lit(":"))
    same = F.concat(path, F.when(query != "", query).otherwise(part(base, 4)))
    full = (
        F.when(part(ref, 1) != "", F.regexp_replace(ref, "#.*$", ""))
        .when(part(ref, 2) != "", F.concat(stem, part(ref, 2), own, query))
        .when(own == "", F.concat(stem, authority, same))
        .otherwise(F.concat(stem, authority, kept, query))
    )
    return full


def links(pages: DataFrame) -> DataFrame:
    """pages: url, html. Returns url, pos, link: references in order, with entities decoded, resolved against the page, without fragment."""
    raw = pages.select("url", F.posexplode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("pos", "href"))
    raw = raw.withColumn("href", strip(unescape_html(F.col("href")))).where("href <> '' and not href rlike '^(?:mailto:|javascript:|#)'")
    return raw.select("url", "pos", resolved(F.col("url"), F.col("href")).alias("link"))


def allowed(url: Column, domains: list[str], prefixes: list[str] | None = None) -> Column:
    """Scheme http or https, host in domains, and a beginning in prefixes if there are any."""
    ok = F.lower(F.regexp_extract(url, r"^(https?)://", 1)).isin("http", "https") & F.regexp_extract(url, r"^https?://([^/?#]*)", 1).isin(*domains)
    if prefixes:
        begins = F.lit(False)
        for p in prefixes:
            begins = begins | url.startswith(p)
        ok = ok & begins
    return ok


def crawl(pages: DataFrame, seeds: DataFrame, depth: int, domains: list[str], prefixes: list[str] | None = None, most: int | None = None) -> DataFrame:
    """pages: url, html; seeds: url. Returns url, depth: pages reached in at most ``depth`` steps over allowed links, each at its least depth.

    ``most``: only the first pages by depth and address.  One join per level against the pages and one anti-join against what was seen; nothing comes to the driver.
    """
    edges = materialize(links(pages).where(allowed(F.col("link"), domains, prefixes)).select("url", "link").distinct(), "crawl-edges")
    known = pages.select("url").distinct()
    level = materialize(seeds.where(allowed(F.col("url"), domains, prefixes)).distinct().join(known, "url", "left_semi").withColumn("depth", F.lit(0)), "crawl-0")
    seen = level
    for k in range(1, depth + 1):
        reached = edges.join(level.select("url"), "url").select(F.col("link").alias("url")).distinct()
        level = materialize(reached.join(known, "url", "left_semi").join(seen, "url", "left_anti").withColumn("depth", F.lit(k)), f"crawl-{k}")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen if most is None else seen.orderBy("depth", "url").limit(most)

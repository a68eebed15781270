"""Discovery over pages that are at hand: sitemaps first, else breadth first within a site, up to a budget of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigrain.functions import text as T
from evigrain.operators.elements import anchors
from evigrain.operators.relational import top_k
from evigrain.sources.staging import written

#: What makes a link a document that is listed, but not read for links.
TERMINAL = r"(?i)\.(pdf|docx?|rtf|xlsx?|odt|zip)$"


def resolved(base: Column, href: Column) -> Column:
    """A link's absolute, normalised address: links with a scheme as they are, ``//host`` with the page's scheme, ``/path`` on its host, others beside the page."""
    origin = F.regexp_extract(base, "^([a-zA-Z]+://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, "[?#].*$", ""), "(?<=[^:/])/[^/]*$", "")
    absolute = F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(F.regexp_extract(base, "^[a-zA-Z]+:", 0), href))
    return T.normalised_url(absolute.when(href.startswith("/"), F.concat(origin, href)).otherwise(F.concat(folder, F.lit("/"), href)))


def page_links(pages: DataFrame) -> DataFrame:
    """``(source, seq, target, label)``: links of pages ``(page_id, url, html)`` to the same host, both ends normalised; of pages with one address the first counts."""
    first = pages.select("page_id", T.normalised_url(F.col("url")).alias("source"), "url", "html").groupBy("source").agg(F.min_by(F.struct("page_id", "url", "html"), "page_id").alias("x"))
    links = anchors(first.select("x.*")).select(T.normalised_url(F.col("url")).alias("source"), "seq", resolved(F.col("url"), F.trim("href")).alias("target"), "label")
    return links.where(T.host(F.col("source")) == T.host(F.col("target")))


def crawled(links: DataFrame, seeds: DataFrame, budget: int, terminal: str = TERMINAL) -> DataFrame:
    """``(site, url, depth, place)``: the first ``budget`` addresses of each site, in the order of a queue.

    ``seeds`` are ``(site, url, seq)``, read in the order of ``seq``, then address; each address
    takes one place of its site's budget, at its first arrival, whether there is a page at it or
    not. The links of a page come after those of the pages before it, in their order on the page.
    Terminal documents take no place. A round reads one level of all sites; as a level is cut to
    the budget that is left, no task gets more than that many rows of a site. Rounds end when none
    adds an address. Links are written once, not found anew in each round.
    """
    links = written(links.select("source", "seq", "target"), "links")
    seeds = seeds.where(F.col("url").isNotNull()).groupBy("site", "url").agg(F.min("seq").alias("seq"))
    level = written(top_k(seeds, ["site"], [F.col("seq").asc_nulls_last(), F.asc("url")], budget).select("site", "url", F.lit(0).alias("depth"), F.col("rank").alias("place")), "crawl")
    seen, depth = level, 0
    while not level.isEmpty():
        depth += 1
        used = seen.groupBy("site").agg(F.max("place").alias("used"))
        open_ = level.join(used.where(F.col("used") < budget), "site")
        new = open_.join(links.where(~F.col("target").rlike(terminal)), F.col("url") == F.col("source"))
        arrivals = new.groupBy("site", F.col("target").alias("url")).agg(F.min(F.struct("place", "seq")).alias("at"), F.first("used").alias("used"))
        fresh = arrivals.join(seen.select("site", "url"), ["site", "url"], "left_anti")
        ranked = top_k(fresh, ["site"], [F.asc("at"), F.asc("url")], budget).withColumn("place", F.col("rank") + F.col("used"))
        level = written(ranked.where(F.col("place") <= budget).select("site", "url", F.lit(depth).alias("depth"), "place"), "crawl")
        seen = seen.unionByName(level)
    return seen


def discovered(links: DataFrame, seeds: DataFrame, sitemaps: DataFrame, budget: int, hint: str = T.LEGAL) -> DataFrame:
    """``(site, url, label, via)``: addresses that look like law, each once in a site.

    A site with rows in ``sitemaps (site, url)`` gives those of its own host and isn't crawled; of
    the others, links of the pages that the budget reaches, terminal documents among them, with the
    label of the first such link.
    """
    listed = sitemaps.select("site", T.normalised_url(F.col("url")).alias("url")).distinct()
    hosts = seeds.groupBy("site").agg(F.min(T.host(F.col("url"))).alias("host"))
    own = listed.join(hosts, "site").where(T.host(F.col("url")) == F.col("host")).select("site", "url", F.lit("").alias("label"), F.lit("sitemap").alias("via"))
    reached = crawled(links, seeds.join(listed.select("site").distinct(), "site", "left_anti"), budget)
    hits = reached.join(links, F.col("url") == F.col("source")).where(F.col("target").rlike(hint) | F.col("label").rlike(hint))
    first = hits.groupBy("site", F.col("target").alias("url")).agg(F.min(F.struct("place", "seq", "label")).alias("x"))
    return own.where(F.col("url").rlike(hint)).unionByName(first.select("site", "url", "x.label", F.lit("link").alias("via")))

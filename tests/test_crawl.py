"""Crawls with a budget, by hand-made sites and against a queue in Python."""

import random
from collections import deque

from evigrain.operators.crawl import crawled, discovered, page_links

PAGES = "page_id long, url string, html string"
SEEDS = "site string, url string, seq int"
MAPS = "site string, url string"


def _site(spark):
    return spark.createDataFrame(
        [
            (1, "http://X.org/", '<a href="/a">a</a><a href="b.html">b</a><a href="http://other.org/law">away</a><a href="/acts/1.pdf">one</a>'),
            (2, "http://x.org/a", '<a href="/c">the law</a><a href="/b.html">b</a>'),
            (3, "http://x.org/b.html", '<a href="//x.org/d">d</a><a href="/">home</a>'),
            (4, "http://x.org/c", '<a href="/regulation/9">nine</a>'),
            (5, "http://x.org/a/", '<a href="/never">a second page at one address</a>'),
            (6, None, None),
        ],
        PAGES,
    )


def test_queue_order_and_budget(spark):
    links, seeds = page_links(_site(spark)), spark.createDataFrame([("x", "http://x.org", 0), ("y", "http://y.org", 0), ("x", None, 1)], SEEDS)
    whole = [(r.url.removeprefix("http://x.org"), r.depth, r.place) for r in crawled(links, seeds, 99).where("site = 'x'").orderBy("place").collect()]
    assert whole == [("", 0, 1), ("/a", 1, 2), ("/b.html", 1, 3), ("/c", 2, 4), ("/d", 2, 5), ("/regulation/9", 3, 6)]
    for budget in (1, 3, 4):
        assert [r.place for r in crawled(links, seeds, budget).where("site = 'x'").orderBy("place").collect()] == list(range(1, budget + 1))
    assert crawled(links, seeds.limit(0), 5).count() == 0


def test_hits(spark):
    links, seeds = page_links(_site(spark)), spark.createDataFrame([("x", "http://x.org", 0)], SEEDS)
    none = spark.createDataFrame([], MAPS)
    hits = lambda maps, budget: sorted((r.url.removeprefix("http://x.org"), r.label, r.via) for r in discovered(links, seeds, maps, budget).collect())
    assert hits(none, 2) == [("/acts/1.pdf", "one", "link"), ("/c", "the law", "link")]
    assert hits(none, 9) == [("/acts/1.pdf", "one", "link"), ("/c", "the law", "link"), ("/regulation/9", "nine", "link")]
    maps = spark.createDataFrame([("x", "http://x.org/statute#top"), ("x", "http://x.org/statute"), ("x", "http://z.org/law"), ("x", "http://x.org/news")], MAPS)
    assert hits(maps, 9) == [("/statute", "", "sitemap")]


def test_against_a_queue(spark):
    chance = random.Random(5)
    rows = [(f"http://h/{a}", s, f"http://h/{chance.randrange(60)}", "") for a in range(60) for s in range(chance.randrange(4))]
    links = spark.createDataFrame(rows, "source string, seq int, target string, label string")
    for budget in (7, 25):
        queue, order = deque(["http://h/0"]), []
        while queue and len(order) < budget:
            url = queue.popleft()
            order.append(url)
            queue += dict.fromkeys(t for u, _, t, _ in rows if u == url and t not in order and t not in queue)
        found = crawled(links, spark.createDataFrame([("h", "http://h/0", 0)], SEEDS), budget).orderBy("place").collect()
        assert [r.url for r in found] == order

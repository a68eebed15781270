"""Scans of registries, law files and crawls."""

from pyspark.sql import functions as F

from evigrain.operators import elements
from evigrain.sources import scans


def test_registries(spark, tmp_path):
    (tmp_path / "pillar.yaml").write_text("pillar_id: '6'\nstatus: built\nindicators:\n  - indicator_id: '6.1'\n    name: Transfer\n    weight: 0.5\n    positive_keywords:\n      en: [data, transfer]\n")
    row = scans.load_indicators(spark, f"file://{tmp_path}/pillar.yaml").first()
    assert (row.indicator_id, row.pillar_id, row.status, row.weight, row.positive_keywords["en"]) == ("6.1", "6", "built", 0.5, ["data", "transfer"])
    (tmp_path / "economy.yaml").write_text("jurisdiction: X\nlanguage: fr\nsources:\n  - source_id: a\n    title: A\n    note: kept\n  - source_id: b\n    language: en\n")
    rows = {r.source_id: r for r in scans.load_sources(spark, f"file://{tmp_path}/economy.yaml").collect()}
    assert (rows["a"].language, rows["b"].language, rows["a"].jurisdiction, rows["a"].extra["note"]) == ("fr", "en", "X", "kept")
    (tmp_path / "gold.yaml").write_text("- gold_id: g1\n  indicator_id: '6.10'\n  doc_id: d\n")
    assert scans.load_gold(spark, f"file://{tmp_path}/gold.yaml").first().indicator_id == "6.10"


def test_law_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Section 1")
    (tmp_path / "b.txt").write_text("Section 1")
    (tmp_path / "c.txt").write_text("%PDF-1.4")
    (tmp_path / "d.html").write_text("<html></html>")
    files = scans.law_files(spark, f"file://{tmp_path}")
    assert {r.path.rsplit("/", 1)[1]: r.extractor for r in files.collect()} == {"a.txt": "text", "b.txt": "text", "c.txt": "pdf", "d.html": "html"}
    known = files.where(F.col("path").endswith("d.html")).select("sha256")
    assert sorted(r.path[-5:] for r in scans.new_files(files, known).collect()) == ["a.txt", "c.txt"]


def test_crawl(spark):
    pages = spark.createDataFrame([(1, "http://X.org/en", '<a href="/acts/5.pdf">one</a><a href="/contact">contact</a><a href="http://y.org/law#top">b <b>law</b></a><script><a href="/law">no</a></script>')], "page_id long, url string, html string")
    links = elements.anchors(pages)
    assert [r.href for r in links.orderBy("seq").collect()] == ["/acts/5.pdf", "/contact"]
    assert [r.source_url for r in scans.proposals(pages, links).collect()] == ["http://x.org/acts/5.pdf"]
    now = spark.createDataFrame([("u", "1"), ("v", "2"), ("w", "3")], "url string, sha256 string")
    before = spark.createDataFrame([("u", "1"), ("v", "9")], "url string, sha256 string")
    assert sorted(r.url for r in scans.changed(now, before).collect()) == ["v", "w"]

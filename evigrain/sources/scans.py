"""Scans: registries from YAML or JSON lines, law files with their hashes, change detection between crawls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrain.functions import text as T

INDICATOR_SCHEMA = "indicator_id string, name string, definition string, clause_pattern string, weight double, scoring_criteria map<string,string>, positive_keywords map<string,array<string>>, negative_cues map<string,array<string>>"
SOURCE_SCHEMA = "source_id string, title string, source_url string, local_path string, document_type string, authority_tier string, language string, law_number_ref string, last_amended string"
PILLAR_SCHEMA = "pillar_id string, name string, status string, config_path string"
GOLD_SCHEMA = "gold_id string, pillar_id string, indicator_id string, jurisdiction string, doc_id string, span_text string, expected_score_band string, expected_authority_tier string"


def _yaml_rows(spark: SparkSession, path: str, key: str, fields: list[str], more: list[str]) -> list[dict]:
    """The items below ``key`` of each YAML file, with the file's own values for ``more``; configuration is small."""
    import yaml

    rows = []
    for _, content in sorted(spark.sparkContext.wholeTextFiles(path).collect()):
        data = yaml.safe_load(content) or {}
        head = {} if isinstance(data, list) else {f"file_{m}": data.get(m) for m in more}
        items = data if isinstance(data, list) else data.get(key) or []
        rows += [{f: item.get(f) for f in fields} | {"extra": {k: str(v) for k, v in item.items() if k not in fields}} | head for item in items]
    return rows


def _names(schema: str) -> list[str]:
    return [p.strip().split(" ")[0] for p in _top_level(schema)]


def _top_level(schema: str) -> list[str]:
    parts, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return parts


def load_pillars(spark: SparkSession, path: str) -> DataFrame:
    """The registry's pillars, each with the path of its file and its status."""
    rows = [{k: v for k, v in r.items() if k != "extra"} for r in _yaml_rows(spark, path, "pillars", _names(PILLAR_SCHEMA), [])]
    return spark.createDataFrame(rows, PILLAR_SCHEMA)


def economies(spark: SparkSession, path: str) -> DataFrame:
    """The names of the YAML files of a folder, without those that begin with an underscore; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.yaml").load(path).select("path")
    name = F.regexp_extract("path", r"([^/]+)\.yaml$", 1)
    return files.select(name.alias("economy")).where(~F.col("economy").startswith("_")).distinct()


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``(jurisdiction, indicator, document_type)`` of manifest files; a null indicator is a file's own default. Types are checked by rules (``checks``)."""
    import yaml

    rows = []
    for _, content in sorted(spark.sparkContext.wholeTextFiles(path).collect()):
        data = yaml.safe_load(content) or {}
        rows += [(data.get("jurisdiction"), None, str(t)) for t in data.get("default_expected_source_types") or []]
        rows += [(data.get("jurisdiction"), str(i), str(t)) for i, body in (data.get("indicators") or {}).items() for t in body.get("expected_source_types") or []]
    return spark.createDataFrame(rows, "jurisdiction string, indicator string, document_type string")


def load_indicators(spark: SparkSession, path: str, statuses: list[str] | None = None) -> DataFrame:
    """Indicators of pillar files, with their pillar and its status; only of pillars with one of ``statuses``, if given."""
    names = _names(INDICATOR_SCHEMA)
    rows = [{k: v for k, v in r.items() if k != "extra"} for r in _yaml_rows(spark, path, "indicators", names, ["pillar_id", "status"])]
    found = spark.createDataFrame(rows, INDICATOR_SCHEMA + ", file_pillar_id string, file_status string").withColumnsRenamed({"file_pillar_id": "pillar_id", "file_status": "status"})
    return found.where(F.col("status").isin(statuses)) if statuses else found


def load_sources(spark: SparkSession, path: str) -> DataFrame:
    """Registered sources; language and jurisdiction are the file's where a source has none; other keys stay in ``extra``."""
    rows = _yaml_rows(spark, path, "sources", _names(SOURCE_SCHEMA), ["jurisdiction", "language"])
    found = spark.createDataFrame(rows, SOURCE_SCHEMA + ", extra map<string,string>, file_jurisdiction string, file_language string")
    return found.withColumn("language", F.coalesce("language", "file_language")).withColumnRenamed("file_jurisdiction", "jurisdiction").drop("file_language")


def load_gold(spark: SparkSession, path: str) -> DataFrame:
    rows = [{k: v for k, v in r.items() if k != "extra"} for r in _yaml_rows(spark, path, "items", _names(GOLD_SCHEMA), [])]
    return spark.createDataFrame(rows, GOLD_SCHEMA)


def law_files(spark: SparkSession, path: str, glob: str = "*.{txt,html,pdf}") -> DataFrame:
    """Files with their bytes, content hash and the extractor that fits them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    head = F.decode(F.substring("content", 1, 1024), "ISO-8859-1")
    low = F.lower("path")
    kind = F.when(low.rlike("scanned|ocr"), "scanned").when(low.endswith(".pdf") | head.startswith("%PDF-"), "pdf").when(low.endswith(".html") | F.lower(head).contains("<html"), "html").otherwise("text")
    return files.select("path", "length", "content", F.sha2("content", 256).alias("sha256"), kind.alias("extractor"))


def new_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """The first file of each content hash that isn't known."""
    first = files.groupBy("sha256").agg(F.min("path").alias("path"))
    return files.join(first, ["sha256", "path"], "left_semi").join(known.select("sha256"), "sha256", "left_anti")


def changed(now: DataFrame, before: DataFrame) -> DataFrame:
    """Pages whose ``(url, sha256)`` is new or has changed."""
    old = before.select("url", F.col("sha256").alias("_old"))
    return now.join(old, "url", "left").where(F.col("_old").isNull() | (F.col("_old") != F.col("sha256"))).drop("_old")


def proposals(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Linked pages that look like law, each url once, with a provisional tier."""
    url = T.normalised_url(F.when(F.col("href").rlike("^[a-zA-Z]+://"), F.col("href")).otherwise(F.concat(F.regexp_extract("url", "^[a-zA-Z]+://[^/?#]+", 0), "href")))
    rows = links.where(F.col("href").rlike(T.LEGAL) | F.col("label").rlike(T.LEGAL)).withColumn("target", url)
    first = rows.groupBy("target").agg(F.min(F.struct("page_id", "seq", "label")).alias("x"))
    return first.select(F.col("target").alias("source_url"), F.md5(F.col("target").cast("binary")).alias("source_id"), F.col("x.label").alias("title"), F.lit("tier_3_guideline").alias("authority_tier"))

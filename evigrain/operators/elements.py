"""Elements of documents and pages: paragraphs, blocks, anchors, table cells, entities, chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigrain.functions import text as T

ANCHOR = r"""(?is)<a\s[^>]*href\s*=\s*["']([^"'#]+)["'][^>]*>(.*?)</a>"""
BLOCK = r"(?is)<(h[1-6]|p|li)(?:\s[^>]*)?>(.*?)</(?:h[1-6]|p|li)>"
CHUNK_CHARS, OVERLAP_CHARS = 480, 64


def paragraphs(docs: DataFrame) -> DataFrame:
    """A row for each line that isn't blank, with half-open character offsets into the document.

    Offsets are sums of the lengths before a line over the document's rows, so a text costs no more
    than its length. Plans that use none don't compute them.
    """
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("seq", "text"))
    upto = F.sum(F.length("text") + 1).over(Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("char_start", (upto - F.length("text") - 1).cast("int"))
    end = F.col("char_start") + F.length("text")
    return rows.select(F.concat_ws("_p", "doc_id", "seq").alias("element_id"), "doc_id", "seq", "char_start", end.alias("char_end"), "text").where(F.trim("text") != "")


def without_scripts(html: Column) -> Column:
    return F.regexp_replace(html, r"(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>|<!--.*?-->", " ")


def plain(markup: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(markup, "<[^>]*>", " "), r"\s+", " "))


def _pairs(html: Column, pattern: str) -> Column:
    """First and second group of every match, in order."""
    group = lambda i: F.regexp_extract_all(html, F.lit(pattern), F.lit(i))
    return F.arrays_zip(group(1).alias("first"), group(2).alias("second"))


def anchors(pages: DataFrame) -> DataFrame:
    rows = pages.select("page_id", "url", F.posexplode(_pairs(without_scripts(F.col("html")), ANCHOR)).alias("seq", "x"))
    return rows.select("page_id", "url", "seq", F.col("x.first").alias("href"), plain(F.col("x.second")).alias("label"))


def html_blocks(pages: DataFrame) -> DataFrame:
    """Headings, paragraphs and list items in document order, with offsets into the joined text."""
    rows = pages.select("page_id", F.posexplode(_pairs(without_scripts(F.col("html")), BLOCK)).alias("seq", "x"))
    rows = rows.select("page_id", "seq", F.lower("x.first").alias("tag"), plain(F.col("x.second")).alias("text")).where("text <> ''")
    kind = F.when(F.col("tag") == "p", "paragraph").when(F.col("tag") == "li", "list_item").otherwise("heading")
    upto = F.sum(F.length("text") + 1).over(Window.partitionBy("page_id").orderBy("seq"))
    return rows.select("page_id", "seq", kind.alias("element_type"), "text", (upto - F.length("text") - 1).cast("int").alias("char_start"))


def cells(rows: DataFrame) -> DataFrame:
    """The cells of lines that are parted by bars."""
    found = rows.where(F.contains("text", F.lit(" | "))).select("doc_id", F.col("seq").alias("row_no"), F.posexplode(F.split("text", r" \| ", -1)).alias("column_no", "cell"))
    return found.withColumn("cell", F.trim("cell"))


def entities(docs: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Distinct entities of each document by kind."""
    found = F.concat(*(_entities_of(kind, pattern) for kind, pattern in patterns.items()))
    return docs.select("doc_id", F.explode(F.array_distinct(found)).alias("x")).select("doc_id", "x.kind", "x.entity")


def _entities_of(kind: str, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda e: F.struct(F.lit(kind).alias("kind"), T.collapsed(e).alias("entity")))


def chunk_spans(text: str, target: int, overlap: int) -> list[tuple[int, int]]:
    """Spans of whole words of about ``target`` characters; each begins within ``overlap`` of the last one's end, and after its start.

    Where a chunk that begins at a word ends, and where the one after it begins, are places in the
    sorted begins and ends of all words, so both are searched for at once for every word.
    """
    found = list(re.finditer(r"\S+", text))
    begins, ends = (np.array([m.span()[side] for m in found], np.int64) for side in (0, 1))
    order = np.arange(len(found))
    lasts = np.maximum(np.searchsorted(ends, begins + target, "right") - 1, order)
    following = np.clip(np.searchsorted(begins, ends[lasts] - overlap), order + 1, lasts + 1)
    spans, at = [], 0
    while at < len(found):
        spans.append((int(begins[at]), int(ends[lasts[at]])))
        at = len(found) if lasts[at] == len(found) - 1 else int(following[at])
    return spans


def chunks(rows: DataFrame, target: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """Overlapping chunks of elements; chunking looks back over words, so it runs in Arrow batches."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, element, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out += [(doc, element, f"{element}__c{i}", a, b, text[a:b]) for i, (a, b) in enumerate(chunk_spans(text, target, overlap))]
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "element_id", "child_id", "char_start", "char_end", "snippet"])

    return rows.select("doc_id", "element_id", "text").mapInArrow(cut, "doc_id long, element_id string, child_id string, char_start int, char_end int, snippet string")

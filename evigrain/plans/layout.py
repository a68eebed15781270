"""Queries over tables and layout: rows and cells with offsets, blocks with the layout rows that they overlap."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigrain.functions import text as T
from evigrain.operators import crawl, elements, html, overlap, tables
from evigrain.plans.corpus import ANCHORS_SQL, PAGE_SQL, URL_SQL
from evigrain.plans.registry import query, sql_list

BARE_SQL = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


@query(f"""WITH t AS (SELECT doc_id, doc_id || '_t' AS tid, text FROM documents WHERE contains(text, ' | ') AND doc_id % 4 <> 0), l AS (SELECT doc_id, tid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM t),
o AS (SELECT *, 5 + sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) - length(line) - 1 AS begin, CASE WHEN contains(line, chr(9)) THEN chr(9) WHEN contains(line, ' | ') THEN ' | ' WHEN contains(line, '|') THEN '|' END AS sep FROM l),
p AS (SELECT *, CASE WHEN sep IS NULL THEN [line] ELSE string_split(line, sep) END AS pieces FROM o), c AS (SELECT doc_id, tid, line_no, line, begin, coalesce(length(sep), 0) AS gap, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS pos FROM p),
s AS (SELECT *, begin + sum(length(piece) + gap) OVER (PARTITION BY doc_id, line_no ORDER BY pos) - length(piece) - gap + length(regexp_extract(piece, '^\\s*')) AS start, {BARE_SQL.format('piece')} AS cell FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY pos) - 1 AS col, dense_rank() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS r FROM s WHERE cell <> '')
SELECT tid || '.r' || r AS element_id, tid AS parent_id, 'other' AS element_type, 'row:' || r AS numbering, CAST(begin AS INT) AS char_start, CAST(begin + length(line) AS INT) AS char_end, md5(line) AS digest, '-' AS tag FROM k WHERE col = 0
UNION ALL SELECT tid || '.r' || r || '.c' || col, tid || '.r' || r, 'table_cell', 'row:' || r || ';col:' || col, CAST(start AS INT), CAST(start + length(cell) AS INT), md5(cell), 'route:tabular_lookup' FROM k""")
def table_parts(table):
    """Rows and cells of the documents that hold bars, each taken as a table; one in four has a child already and stays whole."""
    docs = table("documents").where(F.contains("text", F.lit(" | ")))
    ident = F.concat(F.col("doc_id").cast("string"), F.lit("_t"))
    whole = docs.select("doc_id", ident.alias("element_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("table").alias("element_type"), F.lit(5).alias("char_start"), "text")
    child = docs.where("doc_id % 4 = 0").select("doc_id", F.concat(ident, F.lit(".x")).alias("element_id"), ident.alias("parent_id"), F.lit("table_cell").alias("element_type"), F.lit(5).alias("char_start"), "text")
    found = tables.table_parts(whole.unionByName(child))
    tag = F.coalesce(tables.route_tag(F.col("element_type"), F.lit(None).cast("string")), F.lit("-"))
    return found.select("element_id", "parent_id", "element_type", "numbering", "char_start", "char_end", F.md5(F.col("text").cast("binary")).alias("digest"), tag.alias("tag"))


BLOCK_RE = r"(?is)<(h[1-6]|p|li)(?:\s[^>]*)?>(.*?)</(?:h[1-6]|p|li)>"
BLOCKS_SQL = rf"""bl AS (SELECT page_id, unnest(regexp_extract_all(h, '{BLOCK_RE}', 2)) AS body, generate_subscripts(regexp_extract_all(h, '{BLOCK_RE}', 1), 1) - 1 AS seq FROM (SELECT page_id, {PAGE_SQL} AS h FROM pages)),
tx AS (SELECT page_id, seq, trim(regexp_replace(regexp_replace(body, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM bl)"""


@query(rf"""WITH {BLOCKS_SQL}, a AS (SELECT page_id, seq AS block_id, lower(text) AS x FROM tx WHERE text <> ''),
b AS (SELECT page_id, seq * 1000 + generate_subscripts(string_split(text, '. '), 1) - 1 AS row_id, lower(trim(regexp_replace(unnest(string_split(text, '. ')), '\s+', ' ', 'g'))) AS y FROM tx WHERE text <> ''
UNION ALL SELECT page_id, 10000000 + seq, lower(trim(regexp_replace(regexp_replace(label, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) FROM ({ANCHORS_SQL})),
s AS (SELECT page_id, block_id, row_id, CASE WHEN contains(x, y) OR contains(y, x) THEN least(length(x), length(y)) / greatest(length(x), length(y)) ELSE len(list_intersect(string_split(x, ' '), string_split(y, ' '))) / len(list_distinct(list_concat(string_split(x, ' '), string_split(y, ' ')))) END AS score FROM a JOIN b USING (page_id) WHERE y <> '')
SELECT page_id AS page, block_id, row_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY page_id, block_id ORDER BY score DESC, row_id) AS r FROM s WHERE score >= 0.3) WHERE r = 1""")
def layout_overlap(table):
    """The sentence or link label of its page that each block of a page overlaps best."""
    blocks = elements.html_blocks(table("pages")).select(F.col("page_id").alias("page"), F.col("seq").cast("long").alias("block_id"), "text")
    side = lambda block, row, text: F.struct(block.cast("long").alias("block_id"), row.cast("long").alias("row_id"), text.alias("text"))
    none = F.lit(None)
    parts = F.transform(F.split("text", r"\. ", -1), lambda t, at: side(none, F.col("block_id") * 1000 + at, t))
    both = blocks.select("page", F.explode(F.concat(F.array(side(F.col("block_id"), none, F.col("text"))), parts)).alias("x")).select("page", "x.*")
    labels = elements.anchors(table("pages")).select(F.col("page_id").alias("page"), none.cast("long").alias("block_id"), (F.lit(10000000) + F.col("seq")).cast("long").alias("row_id"), F.col("label").alias("text"))
    best = overlap.best_of_sides(both.unionByName(labels))
    return best.withColumn("block_id", F.col("block_id").cast("int")).withColumn("score", F.round("score", 6))


@query(rf"""WITH c AS (SELECT page_id, regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<noscript[^>]*>.*?</noscript>|<!--.*?-->', '<i>', 'g') AS h FROM pages),
r AS (SELECT page_id, unnest(string_split(h, '<')) AS piece, generate_subscripts(string_split(h, '<'), 1) - 1 AS k FROM c),
t AS (SELECT page_id, k, lower(regexp_extract(piece, '^/?([a-zA-Z0-9]+)', 1)) AS tag, piece LIKE '/%' AS shut, trim(regexp_replace(regexp_extract(piece, '(?s)>(.*)$', 1), '\s+', ' ', 'g')) AS txt FROM r),
g AS (SELECT *, count(*) FILTER (tag IN (SELECT unnest({sql_list(html.BREAKS)}))) OVER (PARTITION BY page_id ORDER BY k) AS grp FROM t),
b AS (SELECT page_id, min(k) AS k, arg_min(tag, k) AS tag, arg_min(shut, k) AS shut, replace(replace(string_agg(txt, ' ' ORDER BY k) FILTER (txt <> ''), '&quot;', '"'), '&amp;', '&') AS text FROM g GROUP BY page_id, grp),
o AS (SELECT page_id, k, tag, text, regexp_matches(tag, '^h[1-6]$') AS head, row_number() OVER w - 1 AS seq, sum(length(text) + 1) OVER w - length(text) - 1 AS char_start FROM b WHERE NOT shut AND text IS NOT NULL AND (tag IN ('p', 'li', 'table') OR regexp_matches(tag, '^h[1-6]$')) WINDOW w AS (PARTITION BY page_id ORDER BY k)),
e AS (SELECT *, CASE WHEN head THEN CAST(substr(tag, 2) AS INT) ELSE 7 END AS rank, CASE WHEN head AND regexp_matches(text, '(?i)\b(section|sec\.?|s\.)\s+\d') THEN 'section' WHEN head AND regexp_matches(text, '(?i)\b(article|art\.?)\s+\d') THEN 'article' WHEN head THEN 'heading' WHEN tag = 'li' THEN 'list_item' WHEN tag = 'table' THEN 'table' ELSE 'paragraph' END AS element_type FROM o),
i AS (SELECT *, page_id || '_' || CASE element_type WHEN 'section' THEN 's' || regexp_extract(text, '(?i)\b(section|sec\.?|s\.)\s+(\d+[A-Za-z]?(\(\d+\)(\([a-z]+\))?)?)', 2) WHEN 'article' THEN 'art' || regexp_extract(text, '(?i)\b(article|art\.?)\s+(\d+[A-Za-z]?(\(\d+\)(\([a-z]+\))?)?)', 2) ELSE element_type || '_' || seq END AS element_id FROM e)
SELECT page_id, seq, element_id, element_type, CAST(char_start AS INT) AS char_start, CAST(char_start + length(text) AS INT) AS char_end, md5(text) AS digest,
CASE WHEN NOT head THEN (SELECT arg_max(x.element_id, x.seq) FROM i x WHERE x.page_id = i.page_id AND x.seq < i.seq AND x.head) END AS parent_id,
(SELECT arg_max(x.element_id, x.seq) FROM i x WHERE x.page_id = i.page_id AND x.seq < i.seq AND x.rank < i.rank) AS outline_id FROM i""")
def html_elements(table):
    found = html.html_elements(table("pages"))
    return found.select("page_id", "seq", "element_id", "element_type", "char_start", "char_end", F.md5(F.col("text").cast("binary")).alias("digest"), "parent_id", "outline_id")


SITE_BUDGET = 24


@query(rf"""WITH a AS (SELECT *, {URL_SQL.replace('u,', 'v,').replace('(u', '(v')} AS source FROM (SELECT *, regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') AS v FROM ({ANCHORS_SQL}))),
p AS (SELECT page_id, {URL_SQL} AS source FROM (SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') AS u FROM pages)),
s AS (SELECT regexp_extract(source, '^[a-z]+://([^/?#]+)', 1) AS site, source AS url, min(page_id) AS page_id FROM p GROUP BY source),
l0 AS (SELECT site, url, 0 AS depth, row_number() OVER (PARTITION BY site ORDER BY page_id, url) AS place FROM s), k AS (SELECT * FROM l0 WHERE place <= {SITE_BUDGET}),
n AS (SELECT k.site, regexp_replace(regexp_extract(a.source, '^[a-z]+://[^/?#]+') || a.href, '/+$', '') AS url, min((k.place, a.seq)) AS arrival FROM k JOIN s USING (site, url) JOIN a ON a.page_id = s.page_id WHERE a.href LIKE '/%' GROUP BY ALL),
l1 AS (SELECT site, url, 1 AS depth, (SELECT count(*) FROM k WHERE k.site = n.site) + row_number() OVER (PARTITION BY site ORDER BY arrival, url) AS place FROM n ANTI JOIN k USING (site, url))
SELECT * FROM k UNION ALL SELECT * FROM l1 WHERE place <= {SITE_BUDGET}""")
def site_crawl(table):
    """The addresses that a budget of pages reaches on each host, from its pages in order."""
    pages = table("pages")
    url = T.normalised_url(F.col("url"))
    seeds = pages.select(T.host(url).alias("site"), url.alias("url"), F.col("page_id").alias("seq"))
    return crawl.crawled(crawl.page_links(pages), seeds, SITE_BUDGET)

"""Queries over documents and pages: elements, tokens, languages, entities, links."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evigrain.functions import text as T
from evigrain.functions.tokenizer import token_rows
from evigrain.operators import elements, relational
from evigrain.plans.registry import query, sql_list, tokens_sql

LINES_SQL = "SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq FROM documents"
PAGE_SQL = r"regexp_replace(html, '(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>|<!--.*?-->', ' ', 'g')"
ANCHORS_SQL = rf"""SELECT page_id, url, unnest(regexp_extract_all(h, '(?is)<a\s[^>]*href\s*=\s*["'']([^"''#]+)["''][^>]*>(.*?)</a>', 1)) AS href, unnest(regexp_extract_all(h, '(?is)<a\s[^>]*href\s*=\s*["'']([^"''#]+)["''][^>]*>(.*?)</a>', 2)) AS label, generate_subscripts(regexp_extract_all(h, '(?is)<a\s[^>]*href\s*=\s*["'']([^"''#]+)["''][^>]*>(.*?)</a>', 1), 1) - 1 AS seq FROM (SELECT page_id, url, {PAGE_SQL} AS h FROM pages)"""
URL_SQL = r"lower(regexp_extract(u, '^([a-zA-Z]+://[^/?#]+)', 1)) || substr(u, length(regexp_extract(u, '^([a-zA-Z]+://[^/?#]+)', 1)) + 1)"


@query(f"""WITH l AS ({LINES_SQL}),
o AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY seq) - length(line) - 1 AS char_start FROM l)
SELECT doc_id || '_p' || seq AS element_id, doc_id, seq, CAST(char_start AS INT) AS char_start, CAST(char_start + length(line) AS INT) AS char_end, line AS text FROM o WHERE trim(line) <> ''""")
def corpus_paragraphs(table):
    return elements.paragraphs(table("documents"))


@query(f"""SELECT lang, token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, lang, unnest({tokens_sql('text', 'lang')}) AS token FROM documents) GROUP BY ALL""")
def token_frequency_by_lang(table):
    words = token_rows(table("documents"), ["doc_id", "lang"], "text", "lang")
    by_doc = words.groupBy("lang", "token", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return by_doc.groupBy("lang", "token").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"))


def _hits_sql(lang: str) -> str:
    return f"len(list_filter(w, lambda x: list_contains({sql_list(T.STOPWORDS[lang])}, x)))"


@query(f"""WITH t AS (SELECT doc_id, lang, text, regexp_extract_all(lower(text), '[a-zA-ZÀ-ÿ]+') AS w FROM documents),
h AS (SELECT *, {_hits_sql('en')} AS en, {_hits_sql('fr')} AS fr, {_hits_sql('es')} AS es FROM t)
SELECT lang AS actual, CASE WHEN length(trim(text)) < 12 OR greatest(en, fr, es) = 0 THEN 'en' WHEN en >= greatest(fr, es) THEN 'en' WHEN fr >= es THEN 'fr' ELSE 'es' END AS detected, count(*) AS n FROM h GROUP BY ALL""")
def language_detect_confusion(table):
    return table("documents").groupBy(F.col("lang").alias("actual"), T.detected_language(F.col("text")).alias("detected")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""SELECT page_id, length(title) AS title_chars, title, length(h1) AS h1_chars, items FROM (SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title, trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '\s+', ' ', 'g')) AS h1, len(regexp_extract_all(html, '(?i)<li[ >]')) AS items FROM pages)""")
def html_titles(table):
    one = lambda tag: F.trim(F.regexp_replace(F.regexp_extract("html", rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1), r"\s+", " "))
    rows = table("pages").select("page_id", one("title").alias("title"), one("h1").alias("h1"), F.regexp_count("html", F.lit("(?i)<li[ >]")).alias("items"))
    return rows.select("page_id", F.length("title").alias("title_chars"), "title", F.length("h1").alias("h1_chars"), "items")


@query(rf"""WITH b AS (SELECT page_id, unnest(regexp_extract_all(h, '(?is)<(h[1-6]|p|li)(?:\s[^>]*)?>(.*?)</(?:h[1-6]|p|li)>', 1)) AS tag, unnest(regexp_extract_all(h, '(?is)<(h[1-6]|p|li)(?:\s[^>]*)?>(.*?)</(?:h[1-6]|p|li)>', 2)) AS body, generate_subscripts(regexp_extract_all(h, '(?is)<(h[1-6]|p|li)(?:\s[^>]*)?>(.*?)</(?:h[1-6]|p|li)>', 1), 1) - 1 AS seq FROM (SELECT page_id, {PAGE_SQL} AS h FROM pages)),
t AS (SELECT page_id, seq, lower(tag) AS tag, trim(regexp_replace(regexp_replace(body, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM b)
SELECT page_id, seq, CASE WHEN tag = 'p' THEN 'paragraph' WHEN tag = 'li' THEN 'list_item' ELSE 'heading' END AS element_type, text, CAST(sum(length(text) + 1) OVER (PARTITION BY page_id ORDER BY seq) - length(text) - 1 AS INT) AS char_start FROM t WHERE text <> ''""")
def html_blocks(table):
    return elements.html_blocks(table("pages"))


@query(f"SELECT page_id, seq, href, trim(regexp_replace(regexp_replace(label, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS label, href LIKE '/%' AS relative FROM ({ANCHORS_SQL})")
def anchors(table):
    return elements.anchors(table("pages")).select("page_id", "seq", "href", "label", F.col("href").startswith("/").alias("relative"))


@query(f"""SELECT page_id, url, regexp_matches(lower(url), '(^|[^a-z])(act|acts|statute|statutes|regulation|regulations|law|laws|gazette)($|[^a-z])|\\.pdf($|[^a-z])') AS legal, host FROM (SELECT *, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)) AS host FROM pages)""")
def legal_hint(table):
    return table("pages").select("page_id", "url", F.col("url").rlike(T.LEGAL).alias("legal"), T.host(F.col("url")).alias("host"))


@query(f"""WITH n AS (SELECT page_id, {URL_SQL} AS url FROM (SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') AS u FROM pages))
SELECT url, min(page_id) AS page_id, count(*) AS copies, md5(url) AS source_id FROM n GROUP BY url""")
def url_dedup(table):
    rows = table("pages").select("page_id", T.normalised_url(F.col("url")).alias("url"))
    return rows.groupBy("url").agg(F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("copies")).withColumn("source_id", F.md5(F.col("url").cast("binary")))


@query("""WITH cur AS (SELECT url, sha256(html) AS sha FROM pages), prev AS (SELECT url, CASE WHEN length(html) % 3 = 0 THEN sha256(html) ELSE sha256(url) END AS sha FROM pages WHERE length(html) % 5 <> 0)
SELECT cur.url, CASE WHEN prev.url IS NULL THEN 'new' WHEN prev.sha <> cur.sha THEN 'changed' ELSE 'unchanged' END AS status FROM cur LEFT JOIN prev USING (url)""")
def source_diff(table):
    """An earlier crawl, made up from the pages, against this one."""
    now = table("pages").select("url", "html")
    size = F.length("html")
    earlier = now.where(size % 5 != 0).select("url", F.when(size % 3 == 0, F.sha2("html", 256)).otherwise(F.sha2("url", 256)).alias("old"))
    status = F.when(F.col("old").isNull(), "new").when(F.col("old") != F.sha2("html", 256), "changed").otherwise("unchanged")
    return now.join(earlier, "url", "left").select("url", status.alias("status"))


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)) AS src, lower(href) AS dst FROM ({ANCHORS_SQL})
 UNION SELECT DISTINCT lower(href), lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)) FROM ({ANCHORS_SQL})),
r(node, depth) AS (SELECT lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)), 0 FROM pages WHERE page_id = 0 UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON r.node = e.src WHERE r.depth < 2)
SELECT node, min(depth) AS depth FROM r GROUP BY node""")
def bfs_discovery(table):
    """Hosts and paths within two links of the first page's host."""
    links = elements.anchors(table("pages")).select(T.host(F.col("url")).alias("src"), F.lower("href").alias("dst"))
    both = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seed = table("pages").where("page_id = 0").select(T.host(F.col("url")).alias("node"))
    return relational.reachable(both, seed, 2)


ENTITY_SQL = {
    "iso_date": r"\b\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])\b",
    "money": r"(?:USD|EUR|GBP|JPY|INR|SGD|AUD|CAD|CHF|CNY)\s?\d[\d,]*(?:\.\d+)?|[$£€¥₹]\s?\d[\d,]*(?:\.\d+)?",
    "cross_ref": r"(?i)\b(?:section|article|paragraph|sub-section|sub-paragraph)\s+\d+[A-Za-z]?(?:\(\d+[A-Za-z]?\))?",
}


@query(" UNION ALL ".join(f"SELECT DISTINCT doc_id, '{k}' AS kind, lower(trim(regexp_replace(e, '\\s+', ' ', 'g'))) AS entity FROM (SELECT doc_id, unnest(regexp_extract_all(text || ' section 12(1) of 2024-02-03, USD 1,200.50', '{p}')) AS e FROM documents)" for k, p in ENTITY_SQL.items()))
def entity_extraction(table):
    """Entities by kind, with a fixed sentence after each text."""
    docs = table("documents").select("doc_id", F.concat("text", F.lit(" section 12(1) of 2024-02-03, USD 1,200.50")).alias("text"))
    return elements.entities(docs, ENTITY_SQL)


@query(f"""WITH l AS ({LINES_SQL}), r AS (SELECT doc_id, seq, string_split(line, ' | ') AS c FROM l WHERE line LIKE '% | %')
SELECT doc_id, seq AS row_no, generate_subscripts(c, 1) - 1 AS column_no, trim(unnest(c)) AS cell FROM r""")
def tabular_cells(table):
    return elements.cells(elements.paragraphs(table("documents")))


@query(f"""WITH l AS ({LINES_SQL}) SELECT doc_id, source, count(*) AS lines, md5(string_agg(line, chr(10) ORDER BY seq)) AS text_md5 FROM l WHERE trim(line) <> '' AND length(line) < 40 GROUP BY doc_id, source""")
def treaty_membership(table):
    """One row for each document: its short lines, joined in order."""
    rows = elements.paragraphs(table("documents")).where("length(text) < 40").join(table("documents").select("doc_id", "source"), "doc_id")
    found = rows.groupBy("doc_id", "source").agg(F.count(F.lit(1)).alias("lines"), F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("parts"))
    return found.select("doc_id", "source", "lines", F.md5(F.array_join(F.transform("parts", lambda p: p["text"]), "\n").cast("binary")).alias("text_md5"))


@query(rf"""WITH RECURSIVE l AS ({LINES_SQL}), o AS (SELECT *, doc_id || '_p' || seq AS element_id FROM l WHERE trim(line) <> ''),
w AS (SELECT doc_id, element_id, line, unnest(regexp_extract_all(line, '\s*\S+')) AS piece, generate_subscripts(regexp_extract_all(line, '\s*\S+'), 1) AS i FROM o),
e AS (SELECT *, CAST(sum(length(piece)) OVER (PARTITION BY element_id ORDER BY i) AS BIGINT) AS stop, count(*) OVER (PARTITION BY element_id) AS n FROM w),
b AS (SELECT *, stop - length(regexp_extract(piece, '\S+')) AS start FROM e),
x AS (SELECT b.element_id, b.i, b.start, b.n, greatest(b.i, max(c.i) FILTER (c.stop <= b.start + 480)) AS last FROM b JOIN b c ON b.element_id = c.element_id AND c.i >= b.i AND c.start <= b.start + 480 GROUP BY b.element_id, b.i, b.start, b.n),
y AS (SELECT x.*, z.stop FROM x JOIN b z ON z.element_id = x.element_id AND z.i = x.last),
k AS (SELECT y.element_id, y.i, y.start, y.stop, y.last = y.n AS done, greatest(y.i + 1, least(y.last + 1, min(c.i) FILTER (c.start >= y.stop - 64))) AS next FROM y JOIN b c ON c.element_id = y.element_id AND c.i >= y.i AND c.i <= y.last + 1 GROUP BY y.element_id, y.i, y.start, y.stop, y.last, y.n),
r AS (SELECT element_id, i, start, stop, done, next, 0 AS part FROM k WHERE i = 1 UNION ALL SELECT k.element_id, k.i, k.start, k.stop, k.done, k.next, r.part + 1 FROM r JOIN k ON k.element_id = r.element_id AND k.i = r.next WHERE NOT r.done)
SELECT o.doc_id, element_id, element_id || '__c' || part AS child_id, CAST(start AS INT) AS char_start, CAST(stop AS INT) AS char_end, substr(line, start + 1, stop - start) AS snippet FROM r JOIN o USING (element_id)""")
def chunk_text(table):
    return elements.chunks(elements.paragraphs(table("documents")))


@query("""WITH t AS (SELECT doc_id, lang, list_sort(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'))) AS s FROM documents),
c AS (SELECT *, min(doc_id) OVER (PARTITION BY lang, s) AS class_id FROM t WHERE len(s) > 0), u AS (SELECT * FROM c WHERE doc_id = class_id)
SELECT lang, class_id AS left_id, doc_id AS right_id, 1.0::DOUBLE AS similarity FROM c WHERE doc_id <> class_id
UNION ALL SELECT a.lang, a.doc_id, b.doc_id, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 6)
FROM u a JOIN u b ON a.lang = b.lang AND a.doc_id < b.doc_id AND len(a.s) >= 0.8 * len(b.s) AND len(b.s) >= 0.8 * len(a.s) WHERE len(list_intersect(a.s, b.s)) >= 0.8 * len(list_distinct(list_concat(a.s, b.s)))""")
def near_duplicates(table):
    """Documents of a language that share most of their words: pairs of the first documents of each word set, and every other document with the first of its set."""
    members, sets = relational.set_classes(table("documents").select("doc_id", "lang", "text"), "doc_id", ["lang"], T.tokens(F.col("text")))
    copies = members.where("ident <> class_id").select("lang", F.col("class_id").alias("left_id"), F.col("ident").alias("right_id"), F.lit(1.0).alias("similarity"))
    return copies.unionByName(relational.similar_pairs(sets, ["lang"], 0.8)).withColumn("similarity", F.round("similarity", 6))


@query("""WITH t AS (SELECT doc_id, lang, string_split(text, chr(10)) AS l FROM documents), w AS (SELECT doc_id, lang, regexp_extract_all(lower(l[-1]), '[\\p{L}\\p{N}_]+') AS a, regexp_extract_all(lower(array_to_string(l[:-2], chr(10))), '[\\p{L}\\p{N}_]+') AS s FROM t WHERE len(l) > 1)
SELECT doc_id, lang, len(a) AS words, round(CASE WHEN len(a) = 0 THEN 0 ELSE len(list_filter(a, lambda x: NOT list_contains(s, x))) / len(a) END, 6) AS rate FROM w""")
def hallucinated_words_rate(table):
    """Share of the last line's words that the lines before it don't have."""
    docs = table("documents").select("doc_id", "lang", F.split("text", "\n", -1).alias("l")).where("size(l) > 1")
    words, source = T.tokens(F.element_at("l", -1)), T.tokens(F.array_join(F.slice("l", F.lit(1), F.size("l") - 1), "\n"))
    docs = docs.select("doc_id", "lang", words.alias("a"), F.array_distinct(source).alias("s"))
    known = F.array_intersect(F.array_distinct("a"), F.col("s"))
    alien = F.size(F.filter("a", lambda x: ~F.array_contains(F.col("known"), x)))
    docs = docs.withColumn("known", known)
    return docs.select("doc_id", "lang", F.size("a").alias("words"), F.round(F.coalesce(F.try_divide(alien, F.size("a")), F.lit(0.0)), 6).alias("rate"))


@query("""WITH t AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM documents) SELECT lang, doc_id, r AS rank FROM t WHERE r <= 5""")
def longest_by_lang(table):
    return relational.top_k(table("documents").select("lang", "doc_id", "n_chars"), ["lang"], [F.desc("n_chars"), F.asc("doc_id")], 5).select("lang", "doc_id", "rank")


@query(f"""WITH l AS ({LINES_SQL}), s AS (SELECT doc_id, seq, line, CASE WHEN regexp_matches(line, '^[A-Z]') AND length(line) < 60 THEN seq END AS h FROM l WHERE trim(line) <> '')
SELECT doc_id, seq, CAST(coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING), -1) AS INT) AS section_seq, coalesce(lag(seq) OVER (PARTITION BY doc_id ORDER BY seq), -1) AS previous_seq FROM s""")
def carried_sections(table):
    """The last short capitalised line before each element stands for its section."""
    rows = elements.paragraphs(table("documents"))
    order = Window.partitionBy("doc_id").orderBy("seq")
    head = F.when(F.col("text").rlike("^[A-Z]") & (F.length("text") < 60), F.col("seq"))
    return rows.select("doc_id", "seq", F.last(head, True).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("section_seq"), F.lag("seq").over(order).alias("previous_seq")).na.fill(-1, ["section_seq", "previous_seq"])

"""Queries over entities of laws, their graph, and spans over documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evigrain.operators import entities, spans
from evigrain.plans.corpus import LINES_SQL
from evigrain.plans.registry import query
from evigrain.plans.structure import ELEMENTS_SQL, law_elements

FOUND_SQL = " UNION ALL ".join(f"SELECT doc_id, element_id, '{kind}' AS kind, unnest(regexp_extract_all(text, '{pattern}', {group})) AS surface FROM e" for kind, pattern, group in entities.PATTERNS)
ENTITY_SQL = f"""{ELEMENTS_SQL}, fo AS ({FOUND_SQL}), en AS (SELECT doc_id, element_id, kind, lower(trim(regexp_replace(surface, '\\s+', ' ', 'g'))) AS key, min(surface) AS surface FROM fo GROUP BY ALL)"""


@query(f"WITH {ENTITY_SQL} SELECT doc_id, kind, key, count(*) AS elements FROM en GROUP BY doc_id, kind, key")
def entity_nodes(table):
    """Every law's entities by kind."""
    return entities.node_index(entities.element_entities(law_elements(table)))


@query(f"""WITH {ENTITY_SQL}, ks AS (SELECT DISTINCT doc_id, element_id, key FROM en), pr AS (SELECT doc_id, a.key AS x, b.key AS y FROM ks a JOIN ks b USING (doc_id, element_id)
UNION ALL SELECT a.doc_id, a.key, b.key FROM ks a JOIN e ON e.doc_id = a.doc_id AND e.element_id = a.element_id JOIN ks b ON b.doc_id = e.doc_id AND b.element_id = e.parent_id),
d AS (SELECT DISTINCT doc_id, least(x, y) AS left_key, greatest(x, y) AS right_key FROM pr WHERE x <> y) SELECT left_key, right_key, count(*) AS n FROM d GROUP BY ALL""")
def entity_cooccurrence(table):
    """In how many laws two entities share an element, or an element and its parent."""
    tree = law_elements(table)
    pairs = entities.cooccurrence(entities.element_entities(tree), tree)
    return pairs.groupBy("left_key", "right_key").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {ENTITY_SQL}, cl AS (SELECT doc_id, element_id, parent_id, lag(element_id) OVER (PARTITION BY doc_id, parent_id ORDER BY seq) AS sibling FROM e), ev AS (SELECT doc_id, element_id AS claim_id, parent_id AS cited FROM cl WHERE parent_id IS NOT NULL UNION SELECT doc_id, element_id, sibling FROM cl WHERE parent_id IS NOT NULL AND sibling IS NOT NULL),
kn AS (SELECT DISTINCT ev.claim_id, en.key FROM ev JOIN en ON en.doc_id = ev.doc_id AND en.element_id = ev.cited), na AS (SELECT en.element_id AS claim_id, en.kind, en.surface, kn.key IS NULL AS missing FROM en LEFT JOIN kn ON kn.claim_id = en.element_id AND kn.key = en.key)
SELECT cl.element_id AS claim_id, (SELECT count(*) FROM ev WHERE ev.claim_id = cl.element_id) AS elements, count(na.kind) AS entities, coalesce(string_agg(na.kind || ':' || na.surface, ',' ORDER BY na.kind || ':' || na.surface) FILTER (missing), '') AS unresolved, count(*) FILTER (missing) = 0 AS passed
FROM cl LEFT JOIN na ON na.claim_id = cl.element_id WHERE parent_id IS NOT NULL GROUP BY cl.element_id""")
def graph_grounding(table):
    """Are the entities of each element known to its parent or to the element before it."""
    tree = law_elements(table)
    inner = tree.withColumn("sibling", F.lag("element_id").over(Window.partitionBy("doc_id", "parent_id").orderBy("seq"))).where("parent_id is not null")
    cited = inner.select(F.col("element_id").alias("claim_id"), "doc_id", F.explode(F.array("parent_id", "sibling")).alias("element_id")).where("element_id is not null")
    found = entities.graph_grounding(inner.select(F.col("element_id").alias("claim_id"), "text"), cited, tree)
    return found.select("claim_id", "elements", "entities", F.array_join("unresolved", ",").alias("unresolved"), "passed")


SPANS_SQL = f"""l AS ({LINES_SQL}), o AS (SELECT doc_id, seq, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY seq) - length(line) - 1 AS s FROM l), w AS (SELECT doc_id, 'a' || seq AS span_id, s AS b, s + 40 AS e FROM o UNION ALL SELECT doc_id, 'b' || seq, s + 25, s + 60 FROM o),
c AS (SELECT doc_id, span_id, least(b, length(text)) AS b, least(e, length(text)) AS e FROM w JOIN documents USING (doc_id)), k AS (SELECT * FROM c WHERE e > b)"""


def _spans(table):
    """Two spans that overlap at the beginning of each line, and run on into the next one where a line is short."""
    rows = table("documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("seq", "line"))
    start = F.sum(F.length("line") + 1).over(Window.partitionBy("doc_id").orderBy("seq")) - F.length("line") - 1
    span = lambda name, a, b: F.struct(F.concat(F.lit(name), F.col("seq").cast("string")).alias("span_id"), (F.col("start") + a).alias("char_start"), (F.col("start") + b).alias("char_end"))
    rows = rows.withColumn("start", start).select("doc_id", F.explode(F.array(span("a", 0, 40), span("b", 25, 60))).alias("x"))
    return rows.select("doc_id", "x.*")


@query(f"""WITH {SPANS_SQL}, t AS (SELECT doc_id, b AS pos FROM k UNION SELECT doc_id, e FROM k), s AS (SELECT doc_id, pos, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS stop FROM t)
SELECT s.doc_id, CAST(s.pos AS INT) AS char_start, CAST(s.stop AS INT) AS char_end, string_agg(DISTINCT k.span_id, ',' ORDER BY k.span_id) AS span_ids FROM s JOIN k ON k.doc_id = s.doc_id AND k.b <= s.pos AND k.e >= s.stop GROUP BY ALL""")
def highlight_segments(table):
    """Disjoint stretches of every document with the spans that cover them."""
    found = spans.segments(spans.clamped(_spans(table), table("documents")))
    return found.select("doc_id", "char_start", "char_end", F.array_join("span_ids", ",").alias("span_ids"))


HTML_SQL = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query(f"""WITH {SPANS_SQL}, i AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k), j AS (SELECT *, sum(CASE WHEN before IS NULL OR b > before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY b, e) AS n FROM i), m AS (SELECT doc_id, n, CAST(min(b) AS BIGINT) AS b, CAST(max(e) AS BIGINT) AS e FROM j GROUP BY doc_id, n),
v AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS last FROM m), h AS (SELECT doc_id, string_agg({HTML_SQL.format('substr(text, last + 1, b - last)')} || '<mark>' || {HTML_SQL.format('substr(text, b + 1, e - b)')} || '</mark>', '' ORDER BY b) AS html, max(e) AS stop, count(*) AS marks FROM v JOIN documents USING (doc_id) GROUP BY doc_id)
SELECT doc_id, md5(coalesce(html, '') || {HTML_SQL.format('substr(text, coalesce(stop, 0) + 1)')}) AS digest, CAST(coalesce(marks, 0) AS INT) AS marks FROM documents LEFT JOIN h USING (doc_id)""")
def marked_texts(table):
    """Every document as escaped text with its spans marked."""
    found = spans.marked_texts(table("documents"), _spans(table))
    return found.select("doc_id", F.md5(F.col("html").cast("binary")).alias("digest"), "marks")

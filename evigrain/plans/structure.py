"""Queries over the element trees of laws that are laid out from the documents' lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigrain.operators import structure
from evigrain.plans.registry import query
from evigrain.plans.review import BLOCKS_SQL
from evigrain.sources.staging import written

LAW_SQL = r"""t AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE i % 4
WHEN 1 THEN CASE WHEN i % 8 = 5 THEN 'Chapter ' || i || chr(10) || chr(10) ELSE '' END || 'Section ' || i || CASE WHEN i = 1 THEN ' Interpretation' ELSE ' Duty' END || chr(10) || '(1) "' || regexp_extract(x, '^(\S+)', 1) || '" means ' || x
WHEN 2 THEN '(2) Subsection (1) does not apply to ' || x WHEN 3 THEN chr(10) || 'Notwithstanding section ' || (i - 2) || '(1), ' || x ELSE '  (a) under section ' || (i - 3) || '(2), ' || x || chr(10) END), chr(10)) AS text FROM documents)"""
SECTION_SQL, ARTICLE_SQL = r"\b(?i:section|sec\.?|s\.)\s+", r"\b(?i:article|art\.?)\s+"
HEAD_SQL, REF_SQL = r"(\d+[A-Za-z]?(?:\(\d+\)(?:\([a-z]+\))?)?)", r"(\d+[A-Za-z]?(?:\(\d+\))?(?:\([A-Za-z]+\))?)"
DEFS_SQL = r"(?i)\b(definitions?|interpretation)\b"
ELEMENTS_SQL = rf"""{LAW_SQL}, {BLOCKS_SQL},
k AS (SELECT doc_id, block, char_start + length(regexp_extract(text, '^\n+')) AS start0, regexp_replace(text, '^\n+|\n+$', '', 'g') AS text FROM b),
h AS (SELECT *, trim(string_split(text, chr(10))[1]) AS l1 FROM k),
c AS (SELECT *, CASE WHEN regexp_matches(l1, '(?i)^chapter\s+') THEN 'chapter' WHEN regexp_matches(l1, '(?i)^(section|sec\.?|s\.)\s+\d+') THEN 'section' WHEN regexp_matches(l1, '(?i)^(article|art\.?)\s+\d+') THEN 'article' END AS kind FROM h),
l AS (SELECT doc_id, block, start0, kind, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM c),
m AS (SELECT *, start0 + sum(length(line) + 1) OVER w - length(line) - 1 AS start, CASE WHEN kind = 'chapter' OR (kind IS NOT NULL AND pos = 1) THEN -1 ELSE sum(CASE WHEN pos > 1 AND regexp_matches(line, '^\s*\((\d+|[a-z]+)\)(\s|$)') THEN 1 ELSE 0 END) OVER w END AS part FROM l WINDOW w AS (PARTITION BY doc_id, block ORDER BY pos)),
g AS (SELECT doc_id, block, part, any_value(kind) AS kind, min(start) AS start, string_agg(line, chr(10) ORDER BY pos) AS text FROM m GROUP BY doc_id, block, part),
s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block, part) - 1 AS seq, part = -1 AS heading, string_split(text, chr(10))[1] AS l1 FROM g WHERE regexp_matches(text, '\S')),
n AS (SELECT *, CASE WHEN heading THEN coalesce('s. ' || nullif(regexp_extract(l1, '{SECTION_SQL}{HEAD_SQL}', 1), ''), 'art. ' || nullif(regexp_extract(l1, '{ARTICLE_SQL}{HEAD_SQL}', 1), ''), 'ch. ' || upper(nullif(regexp_extract(l1, '\b(?i:chapter)\s+((?i:[IVXLCDM]+)|\d+)', 1), ''))) END AS own FROM s),
u AS (SELECT *, sum(heading::INT) OVER (PARTITION BY doc_id ORDER BY seq) AS under FROM n),
v AS (SELECT *, row_number() OVER (PARTITION BY doc_id, own ORDER BY seq) AS again, max(CASE WHEN heading THEN own END) OVER (PARTITION BY doc_id, under) AS hn, coalesce(bool_or(heading AND kind <> 'chapter' AND regexp_matches(l1, '{DEFS_SQL}')) OVER (PARTITION BY doc_id, under), false) AS defs,
CASE WHEN NOT heading THEN nullif(regexp_extract(text, '^\s*\((\d+)\)\s', 1), '') END AS number, CASE WHEN NOT heading THEN nullif(regexp_extract(text, '^\s*\(([a-z]+)\)\s', 1), '') END AS letter FROM u),
y AS (SELECT *, CASE WHEN heading AND kind = 'chapter' THEN 'heading' WHEN heading THEN kind WHEN defs THEN 'definition' WHEN number IS NOT NULL OR letter IS NOT NULL THEN 'list_item' ELSE 'paragraph' END AS element_type, hn || '(' || number || ')' AS numbered FROM v),
z AS (SELECT *, coalesce(last_value(numbered IGNORE NULLS) OVER (PARTITION BY doc_id, under ORDER BY seq ROWS UNBOUNDED PRECEDING), hn) AS base, doc_id || '_' || CASE WHEN heading AND kind <> 'chapter' AND own IS NOT NULL AND again = 1 THEN replace(replace(own, ' ', ''), '.', '') ELSE CASE WHEN element_type = 'heading' THEN 'chapter' ELSE element_type END || '_' || seq END AS element_id FROM y),
e AS (SELECT doc_id, seq, element_id, CASE WHEN element_type = 'heading' THEN NULL WHEN heading THEN last_value(CASE WHEN element_type = 'heading' THEN element_id END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING) ELSE max(CASE WHEN heading THEN element_id END) OVER (PARTITION BY doc_id, under) END AS parent_id, element_type,
CASE WHEN heading THEN own WHEN number IS NOT NULL THEN numbered ELSE base || '(' || letter || ')' END AS numbering, CAST(start + CASE WHEN heading THEN 0 ELSE length(regexp_extract(text, '^\s*')) END AS INT) AS char_start, CAST(start + length(text) AS INT) AS char_end, trim(CASE WHEN heading THEN text ELSE regexp_replace(text, '\s+', ' ', 'g') END) AS text FROM z)"""
EDGES_SQL = rf"""{ELEMENTS_SQL}, f AS (SELECT doc_id, element_id, list_transform(regexp_extract_all(text, '{SECTION_SQL}{REF_SQL}', 1), lambda r: 's. ' || r) || list_transform(regexp_extract_all(text, '{ARTICLE_SQL}{REF_SQL}', 1), lambda r: 'art. ' || r)
|| list_transform(regexp_extract_all(text, '\b(?i:sub-?section)\s+(\(\d+\)(?:\([A-Za-z]+\))?)', 1), lambda r: nullif(regexp_extract(numbering, '^(?:s\.|art\.) \d+[A-Za-z]?'), '') || r) AS refs FROM e),
r1 AS (SELECT doc_id, element_id, unnest(refs) AS numbering, generate_subscripts(refs, 1) AS place FROM f), ix AS (SELECT doc_id, numbering, arg_min(element_id, seq) AS to_element FROM e WHERE numbering IS NOT NULL GROUP BY ALL),
rs AS (SELECT doc_id, element_id AS from_element, to_element, place FROM r1 JOIN ix USING (doc_id, numbering) WHERE element_id <> to_element),
di AS (SELECT *, last_value(CASE WHEN element_type IN ('heading', 'section', 'article') THEN regexp_matches(text, '{DEFS_SQL}') END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS inside, lag(element_id) OVER (PARTITION BY doc_id, parent_id ORDER BY seq) AS sibling, lower(trim(regexp_extract(text, '["“]([^"”]{{2,80}})["”]\s+(?i:means)\b', 1))) AS term FROM e),
tm AS (SELECT doc_id, term, arg_min(element_id, seq) AS from_element FROM di WHERE inside AND term <> '' GROUP BY ALL),
ed AS (SELECT doc_id, from_element, to_element, 'cross_reference' AS edge_type FROM rs
UNION SELECT doc_id, from_element, element_id, 'defines' FROM tm JOIN e USING (doc_id) WHERE contains(lower(text), term) AND (doc_id, element_id) NOT IN (SELECT doc_id, from_element FROM tm)
UNION SELECT doc_id, element_id, coalesce(parent_id, sibling), 'proviso' FROM di WHERE regexp_matches(text, '(?i)(?:^|\.\s+)provided\s+(?:further\s+|also\s+)?that\b|\bsub-?section\s*\(\d+\)\s+does\s+not\s+apply\b') AND coalesce(parent_id, sibling) IS NOT NULL
UNION SELECT doc_id, element_id, coalesce(to_element, parent_id), 'notwithstanding' FROM e LEFT JOIN (SELECT doc_id, from_element AS element_id, arg_min(to_element, place) AS to_element FROM rs GROUP BY ALL) USING (doc_id, element_id) WHERE regexp_matches(text, '(?i)(?:^|\.\s+)notwithstanding\b') AND coalesce(to_element, parent_id) IS NOT NULL)"""


def laws(table):
    """Each document's lines as sections with subsections, references, exceptions and a defined term."""
    n = lambda i, less=0: (i + 1 - less).cast("string")
    line = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    opening = lambda x, i: line(F.when(i % 8 == 4, line("Chapter ", n(i), "\n\n")).otherwise(""), "Section ", n(i), F.when(i == 0, " Interpretation").otherwise(" Duty"), '\n(1) "', F.regexp_extract(x, r"^(\S+)", 1), '" means ', x)
    laid = F.transform(
        F.split("text", "\n", -1),
        lambda x, i: F.when(i % 4 == 0, opening(x, i)).when(i % 4 == 1, line("(2) Subsection (1) does not apply to ", x))
        .when(i % 4 == 2, line("\nNotwithstanding section ", n(i, 2), "(1), ", x)).otherwise(line("  (a) under section ", n(i, 3), "(2), ", x, "\n")),
    )
    return table("documents").select("doc_id", F.array_join(laid, "\n").alias("text"))


def law_elements(table):
    """The laws' elements as a written table."""
    return written(structure.element_tree(laws(table)), "elements")


@query(f"WITH {ELEMENTS_SQL} SELECT doc_id, seq, element_id, coalesce(parent_id, '-') AS parent_id, element_type, coalesce(numbering, '-') AS numbering, char_start, char_end, md5(text) AS digest FROM e")
def element_tree(table):
    found = structure.element_tree(laws(table)).withColumn("digest", F.md5(F.col("text").cast("binary"))).drop("text")
    return found.na.fill("-", ["parent_id", "numbering"])


@query(f"WITH {EDGES_SQL} SELECT doc_id, from_element, to_element, edge_type FROM ed WHERE from_element <> to_element")
def structure_edges(table):
    """Typed edges between the elements of every law."""
    return structure.edges(law_elements(table))


def _round_sql(depth: int) -> str:
    """One round: what the last round's elements lead to, by place and edge, without what was seen before."""
    seen = " UNION ALL ".join(f"SELECT * FROM f{d}" for d in range(depth))
    roles = " ".join(f"WHEN '{kind}' THEN '{role}'" for kind, role in structure.ROLES.items())
    return f"""w{depth} AS (SELECT f.claim_id, f.doc_id, bo.other AS element_id, f.place, bo.edge_type, bo.from_element, bo.to_element, row_number() OVER (PARTITION BY f.claim_id, bo.other ORDER BY f.place, bo.edge_type, bo.from_element, bo.to_element) AS r FROM f{depth - 1} f JOIN bo ON bo.doc_id = f.doc_id AND bo.element_id = f.element_id),
n{depth} AS (SELECT claim_id, count(*) AS n FROM ({seen}) GROUP BY claim_id),
f{depth} AS (SELECT claim_id, doc_id, element_id, {depth} AS depth, n + row_number() OVER (PARTITION BY claim_id ORDER BY place, edge_type, from_element, to_element, element_id) - 1 AS place, CASE edge_type {roles} ELSE 'member' END AS role
FROM w{depth} JOIN n{depth} USING (claim_id) WHERE r = 1 AND (claim_id, element_id) NOT IN (SELECT claim_id, element_id FROM ({seen})) AND (doc_id, element_id) IN (SELECT doc_id, element_id FROM e))"""


@query(f"""WITH {EDGES_SQL}, de AS (SELECT * FROM ed WHERE from_element <> to_element), bo AS (SELECT doc_id, from_element AS element_id, to_element AS other, edge_type, from_element, to_element FROM de UNION ALL SELECT doc_id, to_element, from_element, edge_type, from_element, to_element FROM de),
cl AS (SELECT doc_id, doc_id || '_claim' AS claim_id, CASE WHEN doc_id % 3 = 1 THEN 'none' ELSE doc_id || '_s1' END AS primary_id, doc_id || '_s1' AS clause_id, [doc_id || '_s5', doc_id || '_definition_1', 'none'] AS hints FROM documents),
f0 AS (SELECT claim_id, doc_id, CASE WHEN (doc_id, primary_id) IN (SELECT doc_id, element_id FROM e) THEN primary_id ELSE clause_id END AS element_id, 0 AS depth, 0::BIGINT AS place, 'primary' AS role FROM cl WHERE (doc_id, clause_id) IN (SELECT doc_id, element_id FROM e) OR (doc_id, primary_id) IN (SELECT doc_id, element_id FROM e)),
{_round_sql(1)}, {_round_sql(2)}, al AS (SELECT * FROM f0 UNION ALL SELECT * FROM f1 UNION ALL SELECT * FROM f2), na AS (SELECT claim_id, count(*) AS n FROM al GROUP BY claim_id),
hi AS (SELECT doc_id, claim_id, unnest(hints) AS element_id, generate_subscripts(hints, 1) AS hint_no FROM cl), hk AS (SELECT hi.*, e.element_type FROM hi JOIN e USING (doc_id, element_id) WHERE (claim_id, element_id) NOT IN (SELECT claim_id, element_id FROM al) AND claim_id IN (SELECT claim_id FROM f0))
SELECT claim_id, element_id, depth, place, role FROM al UNION ALL SELECT claim_id, element_id, -1, n + row_number() OVER (PARTITION BY claim_id ORDER BY hint_no) - 1, CASE WHEN element_type = 'definition' THEN 'definition' ELSE 'member' END FROM hk JOIN na USING (claim_id)""")
def regime_assembly(table):
    """What belongs to each law's first section: over two edges, with the role that the first edge gives, and hinted elements."""
    tree = law_elements(table)
    named = lambda suffix: F.concat("doc_id", F.lit(suffix))
    primary = F.when(F.col("doc_id") % 3 == 1, "none").otherwise(named("_s1"))
    claims = table("documents").select("doc_id", named("_claim").alias("claim_id"), primary.alias("primary_id"), named("_s1").alias("clause_id"), F.array(named("_s5"), named("_definition_1"), F.lit("none")).alias("hinted_ids"))
    return structure.regimes(claims, tree, written(structure.edges(tree), "edges"))

"""Element trees of statutes, their numbering and references, and the typed edges between elements.

All of it works on a table of documents at once: windows and groups are by document, and every
join has the document in its key, so equal numberings of two laws never meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigrain.operators.blocks import OPENS_SUB, heading_class, text_blocks
from evigrain.sources.staging import written

#: What names a unit, and the short form that its numbering begins with.
UNITS = {"s. ": r"(?i:section|sec\.?|s\.)", "art. ": r"(?i:article|art\.?)"}
CHAPTER = r"\b(?i:chapter)\s+((?i:[IVXLCDM]+)|\d+)"
#: What opens a definitions heading, a defined term, a proviso, an exception.
DEFINITIONS = r"(?i)\b(definitions?|interpretation)\b"
DEFINED = r"[\"“]([^\"”]{2,80})[\"”]\s+(?i:means)\b"
PROVISO = r"(?i)(?:^|\.\s+)provided\s+(?:further\s+|also\s+)?that\b|\bsub-?section\s*\(\d+\)\s+does\s+not\s+apply\b"
NOTWITHSTANDING = r"(?i)(?:^|\.\s+)notwithstanding\b"


def numbering(heading: Column) -> Column:
    """``s. 26(1)(a)``, ``art. 5`` or ``ch. IV`` of a heading, sections before articles before chapters; null without a number."""
    forms = []
    for short, unit in UNITS.items():
        pattern = rf"\b{unit}\s+(\d+[A-Za-z]?(?:\(\d+\)(?:\([a-z]+\))?)?)"
        forms.append(F.when(heading.rlike(pattern), F.concat(F.lit(short), F.regexp_extract(heading, pattern, 1))))
    forms.append(F.when(heading.rlike(CHAPTER), F.concat(F.lit("ch. "), F.upper(F.regexp_extract(heading, CHAPTER, 1)))))
    return F.coalesce(*forms)


def _prefixed(values: Column, prefix: str) -> Column:
    return F.transform(values, lambda v: F.concat(F.lit(prefix), v))


def references(text: Column) -> Column:
    """Canonical references of a text, each once: to sections, articles, subsections of the same section, paragraphs."""
    every = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    found = [_prefixed(every(rf"\b{unit}\s+(\d+[A-Za-z]?(?:\(\d+\))?(?:\([A-Za-z]+\))?)"), short) for short, unit in UNITS.items()]
    found.append(F.transform(every(r"\b(?i:sub-?section)\s+(\(\d+\)(?:\([A-Za-z]+\))?)"), lambda r: F.concat(F.lit("(subsection "), r, F.lit(")"))))
    found.append(F.transform(every(r"\b(?i:paragraph)\s+\(([A-Za-z]+)\)"), lambda r: F.concat(F.lit("(paragraph "), r, F.lit(")"))))
    return F.array_distinct(F.concat(*found))


def _parts(docs: DataFrame) -> DataFrame:
    """Headings (part -1) and the parts of bodies: ``(doc_id, seq, kind, heading, start, text)``; ``kind`` is that of the block."""
    bare = F.regexp_replace("text", r"^\n+|\n+$", "")
    begin = F.col("char_start") + F.length(F.regexp_extract("text", r"^\n+", 0))
    lines = text_blocks(docs).select("doc_id", "block", begin.alias("begin"), heading_class(bare).alias("kind"), F.posexplode(F.split(bare, "\n", -1)).alias("at", "line"))
    inside = Window.partitionBy("doc_id", "block").orderBy("at")
    upto = F.sum(F.length("line") + 1).over(inside)
    heading = (F.col("kind").isNotNull() & (F.col("at") == 0)) | F.coalesce(F.col("kind") == "chapter", F.lit(False))
    opened = F.sum(F.when(F.col("line").rlike(OPENS_SUB) & (F.col("at") > 0), 1).otherwise(0)).over(inside)
    lines = lines.select("doc_id", "block", "kind", "at", "line", (F.col("begin") + upto - F.length("line") - 1).alias("start"), F.when(heading, -1).otherwise(opened).alias("part"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n")
    parts = lines.groupBy("doc_id", "block", "part").agg(F.first("kind").alias("kind"), F.min("start").alias("start"), joined.alias("text")).where(F.col("text").rlike(r"\S"))
    seq = (F.row_number().over(Window.partitionBy("doc_id").orderBy("block", "part")) - 1).alias("seq")
    return parts.select("doc_id", seq, "kind", (F.col("part") == -1).alias("heading"), "start", "text")


def element_tree(docs: DataFrame) -> DataFrame:
    """``(doc_id, seq, element_id, parent_id, element_type, numbering, char_start, char_end, text)`` of each document's elements, in order.

    Bodies belong to the last section or article of the last chapter, or to the chapter. A part that
    opens with a number takes its parent's numbering and that number, one that opens with a letter
    the numbering of the last numbered part before it. Parts under a definitions heading are
    definitions. Where a numbering repeats, only its first heading is named after it. Null and blank
    texts have no elements.
    """
    order = Window.partitionBy("doc_id").orderBy("seq")
    group = Window.partitionBy("doc_id", "under").orderBy("seq")
    heading, text = F.col("heading"), F.col("text")
    first_line = F.get(F.split("text", "\n"), F.lit(0))
    rows = _parts(docs).withColumn("own", F.when(heading, numbering(first_line))).withColumn("under", F.sum(heading.cast("int")).over(order))
    again = F.row_number().over(Window.partitionBy("doc_id", "own").orderBy("seq"))
    # the heading of a group is its first row
    head = lambda c: F.first(F.when(heading, c), ignorenulls=True).over(group)
    rows = rows.withColumns({"again": again, "head_numbering": head(F.col("own")), "definitions": F.coalesce(head((F.col("kind") != "chapter") & first_line.rlike(DEFINITIONS)), F.lit(False))})
    number, letter = (F.nullif(F.regexp_extract("text", rf"^\s*\(({p})\)\s", 1), F.lit("")) for p in (r"\d+", "[a-z]+"))
    rows = rows.withColumns({"number": F.when(~heading, number), "letter": F.when(~heading, letter)})
    kind = F.when(heading & (F.col("kind") == "chapter"), "heading").when(heading, F.col("kind")).when(F.col("definitions"), "definition")
    kind = kind.when(F.col("number").isNotNull() | F.col("letter").isNotNull(), "list_item").otherwise("paragraph")
    numbered = F.concat("head_numbering", F.lit("("), "number", F.lit(")"))
    rows = rows.withColumn("element_type", kind).withColumn("base", F.coalesce(F.last(numbered, ignorenulls=True).over(group), "head_numbering"))
    lettered = F.concat("base", F.lit("("), "letter", F.lit(")"))
    named = heading & (F.col("kind") != "chapter") & F.col("own").isNotNull() & (F.col("again") == 1)
    label = F.when(F.col("element_type") == "heading", "chapter").otherwise(F.col("element_type"))
    ident = F.when(named, F.concat_ws("_", "doc_id", F.translate("own", " .", ""))).otherwise(F.concat_ws("_", "doc_id", label, "seq"))
    rows = rows.withColumn("element_id", ident)
    chapter = F.last(F.when(heading & (F.col("kind") == "chapter"), F.col("element_id")), ignorenulls=True).over(order)
    parent = F.when(F.col("element_type") == "heading", F.lit(None)).when(heading, chapter).otherwise(head(F.col("element_id")))
    begin = F.col("start") + F.when(heading, 0).otherwise(F.length(F.regexp_extract("text", r"^\s*", 0)))
    shown = F.trim(F.when(heading, text).otherwise(F.regexp_replace("text", r"\s+", " ")))
    return rows.select(
        "doc_id", "seq", "element_id", parent.alias("parent_id"), "element_type", F.when(heading, F.col("own")).when(F.col("number").isNotNull(), numbered).otherwise(lettered).alias("numbering"),
        begin.cast("int").alias("char_start"), (F.col("start") + F.length("text")).cast("int").alias("char_end"), shown.alias("text"),
    )


def _resolved(elements: DataFrame) -> DataFrame:
    """References that name an element of the same document: ``(doc_id, from_element, to_element, at)``; the first holder of a numbering is meant."""
    own = F.nullif(F.regexp_extract("numbering", r"^(?:s\.|art\.) \d+[A-Za-z]?", 0), F.lit(""))
    refs = elements.select("doc_id", F.col("element_id").alias("from_element"), own.alias("own"), F.posexplode(references(F.col("text"))).alias("at", "ref"))
    inner = F.regexp_extract("ref", r"^\(subsection (.*)\)$", 1)
    refs = refs.withColumn("target", F.when(inner != "", F.concat("own", inner)).otherwise(F.col("ref"))).where("target is not null")
    index = elements.where("numbering is not null").groupBy("doc_id", F.col("numbering").alias("target")).agg(F.min_by("element_id", "seq").alias("to_element"))
    return refs.join(index, ["doc_id", "target"]).where("from_element <> to_element").select("doc_id", "from_element", "to_element", "at")


def _defines(elements: DataFrame) -> DataFrame:
    heading = F.col("element_type").isin("heading", "section", "article")
    inside = F.last(F.when(heading, F.col("text").rlike(DEFINITIONS)), ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("seq"))
    term = F.lower(F.trim(F.regexp_extract("text", DEFINED, 1)))
    terms = elements.withColumn("inside", inside).where("inside").select("doc_id", "element_id", "seq", term.alias("term")).where("term <> ''")
    terms = terms.groupBy("doc_id", "term").agg(F.min_by("element_id", "seq").alias("from_element"))
    others = elements.join(terms.select("doc_id", F.col("from_element").alias("element_id")).distinct(), ["doc_id", "element_id"], "left_anti")
    others = others.select("doc_id", F.col("element_id").alias("to_element"), F.lower("text").alias("low"))
    return terms.join(others, "doc_id").where(F.contains("low", "term")).select("doc_id", "from_element", "to_element")


def edges(elements: DataFrame) -> DataFrame:
    """``(doc_id, from_element, to_element, edge_type)`` between the elements of each document, each edge once and none to itself.

    ``cross_reference`` by numbering; ``defines`` from a term's first definition to every element
    that holds it; ``proviso`` to the parent, or to the sibling before where there is none;
    ``notwithstanding`` to the first reference that can be resolved, else to the parent. Each kind
    reads ``elements``, so these should be a written table.
    """
    resolved = written(_resolved(elements), "references")
    sibling = F.lag("element_id").over(Window.partitionBy("doc_id", "parent_id").orderBy("seq"))
    provisos = elements.withColumn("to_element", F.coalesce("parent_id", sibling)).where(F.col("text").rlike(PROVISO))
    first = resolved.groupBy("doc_id", "from_element").agg(F.min_by("to_element", "at").alias("named"))
    aside = elements.where(F.col("text").rlike(NOTWITHSTANDING)).withColumnRenamed("element_id", "from_element").join(first, ["doc_id", "from_element"], "left")
    kinds = {
        "cross_reference": resolved,
        "defines": _defines(elements),
        "proviso": provisos.withColumnRenamed("element_id", "from_element"),
        "notwithstanding": aside.withColumn("to_element", F.coalesce("named", "parent_id")),
    }
    union = None
    for kind, found in kinds.items():
        rows = found.select("doc_id", "from_element", "to_element", F.lit(kind).alias("edge_type"))
        union = rows if union is None else union.unionByName(rows)
    return union.where("to_element is not null and from_element <> to_element").distinct()


#: What an element is to a regime, by the kind of the edge that it is first reached over.
ROLES = {"defines": "definition", "proviso": "exception", "notwithstanding": "exception"}


def regimes(claims: DataFrame, elements: DataFrame, found: DataFrame, max_depth: int = 2) -> DataFrame:
    """``(claim_id, element_id, depth, place, role)``: each claim's primary element and what the edges lead to, whatever their direction.

    ``claims`` are ``(claim_id, doc_id, primary_id, clause_id, hinted_ids)``. A claim begins at its
    primary element or, where the document has none of that id, at its clause; where it has neither
    it has no rows. In each round elements are reached in the order of the elements before them and
    of the edges, by kind, ``from_element`` and ``to_element``; the edge of first arrival decides the
    role, ``definition``, ``exception`` or ``member``. Hinted elements that the document has come
    last, with depth -1, as definitions where they are of that type. ``place`` counts from 0.
    """
    if max_depth < 0:
        raise ValueError("max_depth must not be negative")
    known = elements.select("doc_id", "element_id", "element_type")
    ids = known.select("doc_id", F.col("element_id"))
    primary = claims.join(ids.withColumn("_p", F.lit(True)).withColumnRenamed("element_id", "primary_id"), ["doc_id", "primary_id"], "left")
    clause = primary.join(ids.withColumn("_c", F.lit(True)).withColumnRenamed("element_id", "clause_id"), ["doc_id", "clause_id"], "left")
    begin = clause.select("claim_id", "doc_id", F.when(F.col("_p"), F.col("primary_id")).when(F.col("_c"), F.col("clause_id")).alias("element_id")).where("element_id is not null")
    begin = written(begin, "primaries")
    seen = begin.select("claim_id", "doc_id", "element_id", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("place"), F.lit("primary").alias("role"))
    way = lambda a, b: F.struct(F.col(a).alias("element_id"), F.col(b).alias("other"))
    both = found.select("doc_id", "edge_type", "from_element", "to_element", F.explode(F.array(way("from_element", "to_element"), way("to_element", "from_element"))).alias("x"))
    both = both.select("doc_id", "x.element_id", "x.other", F.struct("edge_type", "from_element", "to_element").alias("edge"))
    role = F.lit("member")
    for kind, name in ROLES.items():
        role = F.when(F.col("way.edge.edge_type") == kind, name).otherwise(role)
    frontier = seen
    for depth in range(1, max_depth + 1):
        step = frontier.select("claim_id", "doc_id", "element_id", "place").join(both, ["doc_id", "element_id"])
        step = step.groupBy("claim_id", "doc_id", F.col("other").alias("element_id")).agg(F.min(F.struct("place", "edge")).alias("way"))
        step = step.join(seen.select("claim_id", "element_id"), ["claim_id", "element_id"], "left_anti").join(ids, ["doc_id", "element_id"], "left_semi")
        order = F.row_number().over(Window.partitionBy("claim_id").orderBy("way", "element_id"))
        sizes = seen.groupBy("claim_id").agg(F.count(F.lit(1)).alias("before"))
        frontier = step.withColumn("order", order).join(sizes, "claim_id").select("claim_id", "doc_id", "element_id", F.lit(depth).alias("depth"), (F.col("before") + F.col("order") - 1).alias("place"), role.alias("role"))
        frontier = written(frontier, "frontier")
        seen = seen.unionByName(frontier)
    hints = claims.select("claim_id", "doc_id", F.posexplode("hinted_ids").alias("at", "element_id")).join(begin.select("claim_id"), "claim_id", "left_semi")
    hints = hints.groupBy("claim_id", "doc_id", "element_id").agg(F.min("at").alias("at")).join(known, ["doc_id", "element_id"]).join(seen.select("claim_id", "element_id"), ["claim_id", "element_id"], "left_anti")
    sizes = seen.groupBy("claim_id").agg(F.count(F.lit(1)).alias("before"))
    order = F.row_number().over(Window.partitionBy("claim_id").orderBy("at"))
    hinted = hints.withColumn("order", order).join(sizes, "claim_id").select("claim_id", "doc_id", "element_id", F.lit(-1).alias("depth"), (F.col("before") + F.col("order") - 1).alias("place"), F.when(F.col("element_type") == "definition", "definition").otherwise("member").alias("role"))
    return seen.unionByName(hinted).select("claim_id", "element_id", "depth", "place", "role")

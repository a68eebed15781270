"""Entities of elements: references, dates, money and defined terms; their graph, and whether a claim's entities are in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigrain.functions import text as T

MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
CURRENCIES = ["USD", "EUR", "GBP", "JPY", "INR", "SGD", "AUD", "CAD", "CHF", "CNY"]
AMOUNT, NTH = r"\s?\d[\d,]*(?:\.\d+)?", r"\d{1,2}(?:st|nd|rd|th)?"
#: Kind, pattern and the group that is the entity, in order.
PATTERNS = [
    ("defined_term", r'(?i)"([^"\n]{1,120})"\s+(?:shall\s+mean|means|refers\s+to)\b', 1),
    ("cross_ref", r"(?i)\b(?:section|article|paragraph|sub-section|sub-paragraph)\s+\d+[A-Za-z]?(?:\(\d+[A-Za-z]?\))?", 0),
    ("date", r"\b\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])\b", 0),
    ("date", rf"(?i)\b(?:{NTH}\s+)?(?:{'|'.join(MONTHS)})(?:\s+{NTH},?)?\s+\d{{4}}\b", 0),
    ("money", rf"(?:(?:{'|'.join(CURRENCIES)}){AMOUNT}|[$£€¥₹]{AMOUNT})", 0),
]


def entities_in(text: Column) -> Column:
    """``(kind, key, surface)`` of a text's entities, each kind and key once, by the order of kinds and places. A null text has none."""
    of = lambda kind: lambda e: F.struct(F.lit(kind).alias("kind"), T.collapsed(e).alias("key"), e.alias("surface"))
    found = F.concat(*(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), of(kind)) for kind, pattern, group in PATTERNS))
    return F.coalesce(found, F.array().cast("array<struct<kind:string,key:string,surface:string>>"))


def element_entities(elements: DataFrame) -> DataFrame:
    """``(doc_id, element_id, kind, key)``, each once. ``elements`` are ``(doc_id, element_id, text)``."""
    return elements.select("doc_id", "element_id", F.explode(entities_in(F.col("text"))).alias("e")).select("doc_id", "element_id", "e.kind", "e.key").distinct()


def node_index(found: DataFrame) -> DataFrame:
    """``(doc_id, kind, key, elements)``: a document's entities by kind, with the number of elements that hold them."""
    return found.groupBy("doc_id", "kind", "key").agg(F.count(F.lit(1)).alias("elements"))


def cooccurrence(found: DataFrame, elements: DataFrame) -> DataFrame:
    """``(doc_id, left_key, right_key)`` of different entities that share an element, or an element and its parent; each pair once.

    ``elements`` are ``(doc_id, element_id, parent_id)``. A pair is made where both sides are in one
    element's set, or one in its own and one in its parent's, so only pairs of the graph arise.
    """
    sets = found.groupBy("doc_id", "element_id").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    inside = sets.select("doc_id", "keys", F.posexplode("keys").alias("i", "a")).select("doc_id", "a", F.explode(F.slice("keys", F.col("i") + 2, F.size("keys"))).alias("b"))
    children = sets.join(elements.where("parent_id is not null").select("doc_id", "element_id", "parent_id"), ["doc_id", "element_id"])
    parents = sets.select("doc_id", F.col("element_id").alias("parent_id"), F.col("keys").alias("above"))
    across = children.join(parents, ["doc_id", "parent_id"]).select("doc_id", F.explode("keys").alias("a"), "above").select("doc_id", "a", F.explode("above").alias("b")).where("a <> b")
    both = inside.unionByName(across)
    return both.select("doc_id", F.least("a", "b").alias("left_key"), F.greatest("a", "b").alias("right_key")).distinct()


def graph_grounding(claims: DataFrame, evidence: DataFrame, elements: DataFrame) -> DataFrame:
    """``(claim_id, elements, entities, unresolved, passed, detail)`` of each claim.

    ``claims`` are ``(claim_id, text)``, ``evidence`` names ``(claim_id, doc_id, element_id)``, and
    ``elements`` are ``(doc_id, element_id, text)``. A claim passes if each of its entities, of
    whatever kind, is one of its elements'; if it names none it passes too. A claim none of whose
    elements is known is flagged, whatever it names. Nothing is ever rejected.
    """
    cited = evidence.select("claim_id", "doc_id", "element_id").distinct().join(elements.select("doc_id", "element_id", "text"), ["doc_id", "element_id"])
    known = cited.groupBy("claim_id").agg(F.count(F.lit(1)).alias("elements"))
    nodes = cited.select("claim_id", F.explode(entities_in(F.col("text"))).alias("e")).select("claim_id", "e.key").distinct()
    named = claims.select("claim_id", F.explode(entities_in(F.col("text"))).alias("e")).groupBy("claim_id", "e.kind", "e.key").agg(F.min("e.surface").alias("surface"))
    counts = named.groupBy("claim_id").agg(F.count(F.lit(1)).alias("entities"))
    missing = named.join(nodes, ["claim_id", "key"], "left_anti").groupBy("claim_id").agg(F.array_sort(F.collect_list(F.concat_ws(":", "kind", "surface"))).alias("unresolved"))
    rows = claims.select("claim_id").join(known, "claim_id", "left").join(counts, "claim_id", "left").join(missing, "claim_id", "left")
    rows = rows.select("claim_id", F.coalesce("elements", F.lit(0)).alias("elements"), F.coalesce("entities", F.lit(0)).alias("entities"), F.coalesce("unresolved", F.array().cast("array<string>")).alias("unresolved"))
    detail = F.when(F.col("elements") == 0, "no element").when(F.col("entities") == 0, "no entity").when(F.size("unresolved") > 0, "unresolved").otherwise("resolved")
    rows = rows.withColumn("unresolved", F.when(F.col("elements") > 0, F.col("unresolved")).otherwise(F.array().cast("array<string>")))
    return rows.withColumns({"passed": detail.isin("no entity", "resolved"), "detail": detail})

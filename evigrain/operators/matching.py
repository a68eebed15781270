"""One-to-one matches of predictions and gold rows, what they score, and tags of what is new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigrain.functions import text as T
from evigrain.operators import relational
from evigrain.sources.staging import written

#: Fixed value: the label of a side that has no row.
NO_CLAIM = "<no_claim>"
FIELDS = ["indicator", "band", "tier"]


def _key(value: Column) -> Column:
    return T.folded(F.regexp_replace(value, r"\s+", " "))


def _keyed(df: DataFrame) -> DataFrame:
    """Keys of jurisdiction, indicator and document; null counts as empty."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    return df.withColumns({"k_jurisdiction": _key(empty("jurisdiction")), "k_indicator": F.trim(empty("indicator")), "k_doc": T.document_key(empty("doc"))})


def same_provision(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """``(gold_id, predicted_id)`` with equal keys of jurisdiction, indicator and document, in the order of the ids, each used once.

    Sides are ``(id, jurisdiction, indicator, doc)``. Where keys repeat, the first gold row takes the
    first prediction, and so on.
    """
    cell = ["k_jurisdiction", "k_indicator", "k_doc"]
    sides = [relational.ranked(_keyed(df), cell, "id", "place").select(*cell, "place", F.col("id").alias(name)) for df, name in ((gold, "gold_id"), (predicted, "predicted_id"))]
    return sides[0].join(sides[1], [*cell, "place"]).select("gold_id", "predicted_id")


#: What a gold row and a claim have to share, best first.
TIERS = [["doc", "indicator"], ["doc"], ["jurisdiction", "indicator"], ["jurisdiction"]]


def best_claims(gold: DataFrame, claims: DataFrame, tiers: list[list[str]] = TIERS) -> DataFrame:
    """``(gold_id, claim_id, tier)``: each gold row with at most one claim and each claim with at most one gold row.

    Every free gold row proposes to the free claims that share a tier's columns with it, and the
    pairs of a tier are taken in the order of the ids before the next tier is looked at. So a claim
    goes to the gold row that it fits best, and no pair of a gold row and a claim would both fit
    better with each other. Each tier is one join on its columns and places within them.
    """
    found: list[DataFrame] = []
    free_gold, free_claims = gold, claims
    for number, tier in enumerate(tiers, 1):
        known = F.lit(True)
        for c in tier:
            known = known & F.col(c).isNotNull()
        sides = [relational.ranked(df.where(known), tier, "id", "place").select(*tier, "place", F.col("id").alias(name)) for df, name in ((free_gold, "gold_id"), (free_claims, "claim_id"))]
        pairs = sides[0].join(sides[1], [*tier, "place"]).select("gold_id", "claim_id", F.lit(number).alias("tier"))
        found.append(pairs)
        if number < len(tiers):
            free_gold = free_gold.join(pairs.select(F.col("gold_id").alias("id")), "id", "left_anti")
            free_claims = free_claims.join(pairs.select(F.col("claim_id").alias("id")), "id", "left_anti")
    union = found[0]
    for pairs in found[1:]:
        union = union.unionByName(pairs)
    return union


def first_claims(gold: DataFrame, claims: DataFrame) -> DataFrame:
    """``(gold_id, claim_id)``: for each gold row the first claim of its jurisdiction and document, one of its indicator if there is any; claims may serve again.

    Claims are reduced to the first of each key before the join, so a frequent key joins one row.
    """
    cell = ["jurisdiction", "doc"]
    same = claims.groupBy(*cell, "indicator").agg(F.min("id").alias("same_id"))
    any_ = claims.groupBy(*cell).agg(F.min("id").alias("any_id"))
    met = gold.select(*cell, "indicator", F.col("id").alias("gold_id")).join(any_, cell).join(same, [*cell, "indicator"], "left")
    return met.select("gold_id", F.coalesce("same_id", "any_id").alias("claim_id"))


def outcomes(gold: DataFrame, predicted: DataFrame, pairs: DataFrame) -> DataFrame:
    """A row for each pair, each gold row that was missed, and each prediction that has no gold row.

    Sides are ``(id, jurisdiction, indicator, doc, band, tier, span)``, predictions with ``tag``. Columns
    ``gold`` and ``predicted`` are structs, null where a side is missing; ``kind`` is matched,
    missed, spurious, or new for a prediction tagged NEW that no gold row has.
    """
    g = gold.select(F.col("id").alias("gold_id"), F.struct(*gold.columns).alias("gold"))
    p = predicted.select(F.col("id").alias("predicted_id"), F.struct(*predicted.columns).alias("predicted"))
    met = g.join(pairs.select("gold_id", "predicted_id"), "gold_id", "left").join(p, "predicted_id", "full_outer")
    new = F.upper(F.trim(F.coalesce(F.col("predicted.tag"), F.lit("")))) == "NEW"
    kind = F.when(F.col("gold").isNotNull() & F.col("predicted").isNotNull(), "matched").when(F.col("gold").isNotNull(), "missed").when(new, "new").otherwise("spurious")
    text = lambda side: T.folded(F.regexp_replace(F.coalesce(F.col(f"{side}.span"), F.lit("")), r"\s+", " "))
    a, b = text("gold"), text("predicted")
    verbatim = (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))
    same = {c: F.trim(F.coalesce(F.col(f"gold.{c}"), F.lit(""))) == F.trim(F.coalesce(F.col(f"predicted.{c}"), F.lit(""))) for c in FIELDS}
    return met.select("gold", "predicted", kind.alias("kind"), verbatim.alias("verbatim"), *(same[c].alias(f"same_{c}") for c in FIELDS))


def _share(hits: Column, of: Column) -> Column:
    return F.coalesce(F.try_divide(F.count_if(hits & of), F.count_if(of)), F.lit(0.0))


def scores(found: DataFrame, by: list[Column] | None = None) -> DataFrame:
    """Accuracies of matched pairs, the share of scored gold rows that were missed, and counts, over all rows or by ``by``."""
    matched = F.col("kind") == "matched"
    fields = F.lit(True)
    for c in FIELDS:
        fields = fields & F.col(f"same_{c}")
    scored = F.col("gold").isNotNull() & ~F.coalesce(F.col("gold.band"), F.lit("null")).isin("0", "null", "None")
    parts = {"field_accuracy": _share(fields, matched), **{f"{c}_accuracy": _share(F.col(f"same_{c}"), matched) for c in FIELDS}, "citation_fidelity": _share(F.col("verbatim"), matched), "false_zero_rate": _share(F.col("kind") == "missed", scored)}
    counts = {"tp": matched, "fn": F.col("kind") == "missed", "fp": F.col("kind") == "spurious", "discovery_new": F.col("kind") == "new", "gold_total": F.col("gold").isNotNull(), "predicted_total": F.col("predicted").isNotNull()}
    columns = [c.alias(name) for name, c in parts.items()] + [F.count_if(c).alias(name) for name, c in counts.items()]
    return found.groupBy(*by).agg(*columns) if by else found.agg(*columns)


def labelled(found: DataFrame) -> DataFrame:
    """``(truth, predicted)`` indicators of all rows that count, for precision and recall; a missing side has a label of its own."""
    side = lambda c: F.coalesce(F.trim(F.col(f"{c}.indicator")), F.lit(NO_CLAIM))
    return found.where("kind <> 'new'").select(side("gold").alias("truth"), side("predicted").alias("predicted"))


def discovery_tags(docs: DataFrame, gold: DataFrame, cell: list[str], least: float, tokens: str | Column = "tokens") -> DataFrame:
    """``(doc_id, tag)``: KNOWN where the document is in ``gold`` or its ``tokens``, a column or what makes it, overlap with those of a gold row of its cell by ``least`` or more, else NEW."""
    members, sets = relational.set_classes(docs, "doc_id", cell, tokens)
    members = members.select(F.col("ident").alias("doc_id"), "class_id")
    listed = written(members.join(gold, "doc_id", "left_semi").select("class_id").distinct(), "listed")
    pairs = written(relational.similar_pairs(sets, cell, least, listed=listed).select("left_id", "right_id"), "similar")
    both = pairs.unionByName(pairs.select(F.col("right_id").alias("left_id"), F.col("left_id").alias("right_id")))
    near = both.join(listed, F.col("right_id") == F.col("class_id"), "left_semi").select(F.col("left_id").alias("class_id"))
    hit = members.join(near.unionByName(listed).distinct(), "class_id", "left_semi").select("doc_id").unionByName(gold.select("doc_id")).distinct().withColumn("tag", F.lit("KNOWN"))
    return docs.select("doc_id").join(hit, "doc_id", "left").select("doc_id", F.coalesce("tag", F.lit("NEW")).alias("tag"))

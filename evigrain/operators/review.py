"""Claims under review: statuses, routing, promotion, filters, second layer, scores against a gold set, retrieval with reranking.

Claims are rows ``(claim_id, jurisdiction, indicator_id, status, ...)``; every rule is a column
expression or a join, so it runs on any table with these columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigrain.functions import text as T

#: Coverage states by risk, and score bands with their numbers.
RISK = ("insufficient_coverage", "no_evidence_in_searched_corpus", "evidence_found")
BANDS = {"0": 0.0, "0.5": 0.5, "1": 1.0}
FEW_SHOT_LEAST = 0.15


def layer1_status(passed: Column, unstable: Column) -> Column:
    return F.when(~passed, "rejected").when(unstable, "flagged").otherwise("pending_verification")


def demoted(status: Column, survives: Column) -> Column:
    """An advisory check can only turn ``verified`` into ``flagged``."""
    return F.when((status == "verified") & ~survives, "flagged").otherwise(status)


def routing_reason(confidence: Column, threshold: Column, usable: Column, insufficient: Column) -> Column:
    """Why a verified claim goes to review by its confidence; null if it doesn't."""
    below = F.format_string("model confidence %.3f below validated threshold %.3f", confidence, threshold)
    return (
        F.when(insufficient, F.lit(None)).when(~usable, "confidence not screened on gold set — routed to review").when(threshold.isNull(), F.lit(None))
        .when(confidence.isNull(), "model confidence missing — routed to review").when(confidence < threshold, below)
    )


def routed(claims: DataFrame, screens: DataFrame) -> DataFrame:
    """``claims`` with ``status`` and ``reason`` after routing by each pillar's screen ``(pillar_id, threshold, usable, insufficient)``; pillars without one route nothing."""
    both = claims.join(screens, "pillar_id", "left")
    reason = routing_reason(F.col("confidence"), F.col("threshold"), F.coalesce("usable", F.lit(False)), F.coalesce("insufficient", F.lit(True)))
    both = both.withColumn("reason", F.when(F.col("status") == "verified", reason))
    return both.withColumn("status", F.when(F.col("reason").isNotNull(), "flagged").otherwise(F.col("status"))).drop("threshold", "usable", "insufficient")


def promoted(claims: DataFrame, decisions: DataFrame) -> DataFrame:
    """Flagged claims that a decision ``(claim_id, verdict)`` accepts become verified; nothing else changes."""
    accepted = decisions.where(F.lower("verdict") == "accept").select("claim_id", F.lit(True).alias("accepted")).distinct()
    both = claims.join(accepted, "claim_id", "left")
    return both.withColumn("status", F.when((F.col("status") == "flagged") & F.col("accepted"), "verified").otherwise(F.col("status"))).drop("accepted")


def primary_span(spans: Column) -> Column:
    """The first span with the role ``primary``, else the first one."""
    return F.coalesce(F.get(F.filter(spans, lambda s: s["role"] == "primary"), F.lit(0)), F.get(spans, F.lit(0)))


def decomposition_sentence(subject: Column, condition: Column, constraint: Column, context: Column) -> Column:
    there = lambda x, begin, end="": F.when(F.length(x) > 0, F.concat(F.lit(begin), x, F.lit(end)))
    sentence = F.concat_ws(" ", F.trim(F.concat_ws(" ", subject, there(condition, "when "), F.concat(F.lit("must "), constraint))), there(context, "(context: ", ")"))
    return F.when(sentence.endswith("."), sentence).otherwise(F.concat(sentence, F.lit(".")))


def matching(claims: DataFrame, **wanted: str | None) -> DataFrame:
    """Claims whose columns have the wanted values; a None asks for nothing."""
    for column, value in wanted.items():
        claims = claims if value is None else claims.where(F.col(column) == value)
    return claims


def qualifying(claims: DataFrame) -> DataFrame:
    """Claims that count as evidence: only verified ones."""
    return claims.where("status = 'verified'")


def exported(claims: DataFrame) -> DataFrame:
    return claims.where("status <> 'rejected' or status is null")


def fetched_locally(sources: DataFrame) -> DataFrame:
    return sources.where("local_path is not null")


def built(registry: DataFrame, selected: DataFrame) -> DataFrame:
    """Registry rows that are selected and built."""
    return registry.where("status = 'built'").join(selected.select("indicator_id").distinct(), "indicator_id", "left_semi")


def needs_wider_sources(state: Column) -> Column:
    return state == "insufficient_coverage"


def risk_rank(state: Column) -> Column:
    """0 for the state most at risk; unknown states come last."""
    return F.coalesce(*(F.when(state == name, rank) for rank, name in enumerate(RISK)), F.lit(99))


def pillar_of(indicator: Column) -> Column:
    return F.split_part(indicator, F.lit("."), F.lit(1))


def contained_either_way(a: Column, b: Column) -> Column:
    """Whether one text, collapsed and lower-cased, holds the other one; never for blank ones."""
    a, b = T.collapsed(a), T.collapsed(b)
    return F.coalesce((F.length(a) > 0) & (F.length(b) > 0) & (F.contains(a, b) | F.contains(b, a)), F.lit(False))


def no_evidence_reason(recall: Column) -> Column:
    miss = F.bround((1 - recall) * 100).cast("int")
    return F.format_string("no clauses passed verification; recall=%.2f, miss risk ~%d%% based on gold-set recall", recall, miss)


def band_number(band: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in BANDS.items() for x in pair)), band)


def few_shot_bands(claims: DataFrame, examples: DataFrame, least: float = FEW_SHOT_LEAST) -> DataFrame:
    """``(claim_id, band, overlap)``: the band of the example with the most similar words, the first among equals, null below ``least``.

    Claims are ``(claim_id, indicator_id, text)``, examples, a small configured table, are
    ``(ord, label, band, text)``; a blank label fits every indicator.
    """
    words = lambda x: F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0)))
    known = examples.where(F.col("band").isin(list(BANDS))).select("ord", "label", "band", words("text").alias("theirs")).where(F.size("theirs") > 0)
    own = claims.select("claim_id", "indicator_id", words("text").alias("ours"))
    fits = F.col("label").isNull() | (F.col("label") == "") | (F.col("label") == F.col("indicator_id"))
    met = own.where(F.size("ours") > 0).join(F.broadcast(known), fits).withColumn("shared", F.size(F.array_intersect("ours", "theirs"))).where("shared > 0")
    met = met.withColumn("overlap", F.col("shared") / (F.size("ours") + F.size("theirs") - F.col("shared")))  # both are distinct words
    best = met.groupBy("claim_id").agg(F.max_by(F.struct("band", "overlap"), F.struct("overlap", -F.col("ord"))).alias("best"))
    found = claims.select("claim_id").join(best, "claim_id", "left")
    return found.select("claim_id", F.when(F.col("best.overlap") >= least, F.col("best.band")).alias("band"), F.coalesce("best.overlap", F.lit(0.0)).alias("overlap"))


def covered_share(wanted: Column, given: Column) -> Column:
    """Share of one set of tokens that the other one holds; 0 where either is empty. Context recall and faithfulness are both this."""
    return F.when((F.size(wanted) > 0) & (F.size(given) > 0), F.size(F.array_intersect(wanted, given)) / F.size(F.array_distinct(wanted))).otherwise(F.lit(0.0))


def error_rate(stored: Column, expected: Column) -> Column:
    """An aggregate: share of pairs with a stored value that isn't the expected one; 0 without any."""
    return F.coalesce(F.avg(F.when(stored.isNotNull(), (stored != expected).cast("double"))), F.lit(0.0))


def false_zero_rate(coverage: DataFrame, gold: DataFrame) -> DataFrame:
    """``(pillar_id, rows, false_zeros, rate)``: of a pillar's rows that claim no evidence, those for which the gold set has some."""
    present = gold.select("jurisdiction", "indicator_id").distinct().withColumn("present", F.lit(1))
    zero = coverage.where("state = 'no_evidence_in_searched_corpus'").join(present, ["jurisdiction", "indicator_id"], "left")
    found = zero.groupBy(pillar_of(F.col("indicator_id")).alias("pillar_id")).agg(F.count(F.lit(1)).alias("rows"), F.count("present").alias("false_zeros"))
    return found.withColumn("rate", F.col("false_zeros") / F.col("rows"))


def indicator_breakdown(pairs: DataFrame) -> DataFrame:
    """Precision, recall and support by indicator from ``(gold, predicted)``, one side null where nothing matched.

    A pair with two different labels counts twice: as missed for its gold label and as wrong for
    the predicted one.
    """
    right = F.coalesce(F.col("gold") == F.col("predicted"), F.lit(False))
    roles = F.array(F.struct(F.col("gold").alias("indicator_id"), F.lit("gold").alias("role")), F.when(~right, F.struct(F.col("predicted").alias("indicator_id"), F.lit("predicted").alias("role"))))
    rows = pairs.select(right.alias("right"), F.explode(F.array_compact(roles)).alias("r")).select("right", "r.indicator_id", "r.role").where("indicator_id is not null and indicator_id <> ''")
    count = lambda test: F.count_if(test)
    sums = rows.groupBy("indicator_id").agg(count(F.col("right")).alias("tp"), count(~F.col("right") & (F.col("role") == "gold")).alias("fn"), count(F.col("role") == "predicted").alias("fp"))
    share = lambda a, b: F.when(b > 0, a / F.nullif(b, F.lit(0))).otherwise(F.lit(0.0))
    sums = sums.withColumns({"precision": share(F.col("tp"), F.col("tp") + F.col("fp")), "recall": share(F.col("tp"), F.col("tp") + F.col("fn"))})
    f1 = share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return sums.select("indicator_id", "tp", "fp", "fn", "precision", "recall", f1.alias("f1"), (F.col("tp") + F.col("fn")).alias("support"))


def second_layer(claims: DataFrame, coverage: DataFrame) -> DataFrame:
    """Verified claims with their coverage by jurisdiction and indicator; those without a coverage row fall out."""
    return qualifying(claims).join(coverage, ["jurisdiction", "indicator_id"])


def retrieved(hits: DataFrame, wanted: DataFrame, rerank: Column, first: int = 40, keep: int = 10, top_k: int = 8) -> DataFrame:
    """Per query: over-fetch, filter, rerank: ``(query_id, id, score, rerank_score, rank)``.

    ``hits`` are fused ``(query_id, id, score, jurisdiction, ...)``, ``wanted`` is ``(query_id,
    jurisdiction)``, null for any. Of the best ``4 * first`` hits those of another jurisdiction go,
    the best ``first`` of the rest are sorted by ``rerank``, and at most ``top_k`` of the best
    ``keep`` stay. Equal scores go by id. A batch of queries is one job with bounded windows.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= 4 * first)
    both = best.join(wanted.withColumnRenamed("jurisdiction", "asked"), "query_id")
    both = both.where(F.col("asked").isNull() | F.col("jurisdiction").isNull() | (F.col("jurisdiction") == F.col("asked")))
    some = both.withColumn("place", F.row_number().over(order)).where(F.col("place") <= first).withColumn("rerank_score", rerank.cast("double"))
    again = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "place")
    return some.withColumn("rank", F.row_number().over(again)).where(F.col("rank") <= min(top_k, max(keep, top_k))).select("query_id", "id", "score", "rerank_score", "rank")


def identity_rerank(place: Column) -> Column:
    return 1.0 - 0.01 * (place - 1)


def passage_recall(pairs: DataFrame, gold: DataFrame, passages: DataFrame) -> DataFrame:
    """``(gold_id, claim_id, context_recall, faithfulness)`` of matched ``pairs (gold_id, claim_id, constraint)``.

    ``gold`` is ``(gold_id, text)``, ``passages`` are ``(claim_id, text)``, any number for a claim:
    recall is the share of the gold text's words that a passage of the claim holds, faithfulness that
    of the constraint's words. Empty sides give 0. Words travel as rows, so a claim may have any
    number of passages; a repeated pair counts once.
    """
    found = lambda df, keys, text: df.select(*keys, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))).alias("word"))
    key = ["gold_id", "claim_id"]
    pairs = pairs.select(*key, "constraint").dropDuplicates(key)
    given = found(passages, ["claim_id"], "text").distinct().withColumn("there", F.lit(1))
    asked = pairs.select(*key).join(found(gold, ["gold_id"], "text").distinct(), "gold_id").select(*key, "word", F.lit("context_recall").alias("side"))
    asked = asked.unionByName(found(pairs, key, "constraint").withColumn("side", F.lit("faithfulness")))
    of = lambda side: F.avg(F.when(F.col("side") == side, F.coalesce("there", F.lit(0))))
    shares = asked.join(given, ["claim_id", "word"], "left").groupBy(*key).agg(of("context_recall").alias("context_recall"), of("faithfulness").alias("faithfulness"))
    return pairs.select(*key).join(shares, key, "left").na.fill(0.0, ["context_recall", "faithfulness"])


def mean_recall(scored: DataFrame) -> DataFrame:
    """Means over all pairs, 0 without any."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0)).alias(c)
    return scored.agg(mean("context_recall"), mean("faithfulness"), F.count(F.lit(1)).alias("pairs"))


def grid(cells: DataFrame, row: str, column: str, value: Column) -> DataFrame:
    """``cells`` with a column for each value of ``column``, in the natural order of the numbers in them (``6.9`` before ``6.10``); null values have none.

    The names are listed first by a distinct query, as columns of a plan have to be known; they are
    those of a configured set of indicators, a few hundred at most by Spark's own bound on pivots.
    """
    numbers = F.transform(F.regexp_extract_all(column, F.lit(r"\d+"), F.lit(0)), lambda x: F.lpad(x, 20, "0"))
    names = cells.where(F.col(column).isNotNull()).select(column).distinct().orderBy(F.regexp_replace(column, r"\d+.*", ""), numbers, column)
    return cells.groupBy(row).pivot(column, [r[0] for r in names.collect()]).agg(value)

"""The second layer: score bands recommended for verified claims, with the reasons and the questions left to a reviewer.

Claims are rows ``(claim_id, jurisdiction, indicator_id, status, text, clause_pattern, members,
exceptions, definitions)``, the last three being sizes of the claim's regime. Indicators are a
configured table ``(indicator_id, name, criteria map<string, string>, positive array<string>,
negative array<string>, clause_pattern)``; criteria have the bands as keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigrain.operators import review, rules

FOUND = "evidence_found"
#: The pattern that moves the bands, and how far it and other signs move them.
CONDITIONAL = "conditional_regime"
KEYWORD, CUE_ONE, CUE_HALF, SAME_PATTERN, CONDITIONAL_HALF, CONDITIONAL_ONE = 0.25, -0.5, 0.25, 0.5, 0.75, -0.25
#: What a reviewer is asked, and what a recommendation says without a band.
ASK_COVERAGE = "Corpus coverage is insufficient — widen authoritative sources before confirming a score."
ASK_NO_EVIDENCE = "No verified evidence for this indicator in the searched corpus — confirm whether a RDTII score is defensible."
ASK_MEMBERS = "Regime graph contains only the primary clause — confirm whether implementing regulations or exceptions exist elsewhere."
ASK_EXCEPTIONS = "Conditional-regime structure detected but no exception members were assembled — confirm adequacy-list breadth and authorisation mechanics."
ASK_DEFINITIONS = "No definitional cross-references were assembled — confirm scope terms (e.g. personal data categories) from other sections."
ASK_PATTERN = "Claim clause pattern (%s) differs from the indicator's expected pattern (%s) — confirm the mapping before scoring."
NOT_COUNTED = "Claim is verified but not counted in coverage for this indicator — review jurisdiction / indicator alignment before scoring."
CLOSING = "Final restrictiveness is a regime-level judgment — reviewer must confirm."


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))


def _met(low: Column, values: Column) -> Column:
    """How many of the values a lower-cased text holds; a value listed twice counts twice, null values and lists count nothing."""
    return F.coalesce(F.size(F.filter(values, lambda v: F.coalesce(F.contains(low, F.lower(v)), F.lit(False)))), F.lit(0))


def band_scores(text: Column, pattern: Column, criteria: Column, positive: Column, negative: Column, expected: Column) -> list[Column]:
    """Scores of the bands 0, 0.5 and 1.

    Words shared with a band's criteria count one each. A keyword raises all bands, a negative cue
    moves from 1 to 0.5, and so does a conditional regime; the expected pattern raises 0.5.
    """
    low, words = F.lower(text), _words(text)
    overlap = [F.coalesce(F.size(F.array_intersect(words, _words(F.element_at(criteria, F.lit(band))))), F.lit(0)).cast("double") for band in review.BANDS]
    both, cues = _met(low, positive) * KEYWORD, _met(low, negative)
    conditional = F.coalesce(pattern == CONDITIONAL, F.lit(False))
    when = lambda test, by: F.when(test, by).otherwise(0.0)
    half = cues * CUE_HALF + when(pattern == expected, SAME_PATTERN) + when(conditional, CONDITIONAL_HALF)
    return [overlap[0] + both, overlap[1] + both + half, overlap[2] + both + cues * CUE_ONE + when(conditional, CONDITIONAL_ONE)]


def open_questions(state: Column, pattern: Column, expected: Column, members: Column, exceptions: Column, definitions: Column) -> Column:
    """What a reviewer has to confirm, in a fixed order; sizes that are null count as zero."""
    size = lambda c: F.coalesce(c, F.lit(0))
    asked = [
        F.when(state == "insufficient_coverage", ASK_COVERAGE).when(state == "no_evidence_in_searched_corpus", ASK_NO_EVIDENCE),
        F.when(size(members) <= 1, ASK_MEMBERS), F.when((size(exceptions) == 0) & (pattern == CONDITIONAL), ASK_EXCEPTIONS), F.when(size(definitions) == 0, ASK_DEFINITIONS),
        F.when(expected.isNotNull() & ~pattern.eqNullSafe(expected), F.format_string(ASK_PATTERN, pattern, expected)),
    ]
    return F.array_compact(F.array(*asked))


def rationale(band: Column, name: Column, pattern: Column, rubric: Column, state: Column, members: Column, exceptions: Column, definitions: Column) -> Column:
    """Why a band is recommended: structure, rubric if the band has one, regime and coverage."""
    size = lambda c: F.coalesce(c, F.lit(0))
    head = F.format_string("Structure = %s (%s); recommended band %s.", name, pattern, band)
    regime = F.format_string("Regime assembly: %d member(s), %d exception(s), %d definition(s).", size(members), size(exceptions), size(definitions))
    return F.concat_ws(" ", head, F.concat(F.lit("Rubric: "), F.nullif(rubric, F.lit(""))), regime, F.concat(F.lit("Coverage state: "), state, F.lit(".")), F.lit(CLOSING))


def recommendations(claims: DataFrame, indicators: DataFrame, coverage: DataFrame, counted: DataFrame, examples: DataFrame) -> DataFrame:
    """A recommendation ``(claim_id, jurisdiction, indicator_id, band, rationale, open_questions)`` for each verified claim whose indicator and coverage are known.

    ``coverage`` is ``(jurisdiction, indicator_id, state, reason)``; of repeated rows of a cell the
    state most at risk holds. ``counted (claim_id, jurisdiction, indicator_id)`` are the claims that
    coverage counts; ``examples`` are those of ``review.few_shot_bands``. The band is null without
    evidence or for claims that aren't counted, else that of the closest example, else the best of
    the criteria. Texts meet the indicators only; all later joins are of narrow rows.
    """
    known = indicators.select("indicator_id", "name", "criteria", "positive", "negative", F.col("clause_pattern").alias("expected"))
    verified = review.qualifying(claims)
    met = verified.join(known, "indicator_id")
    scores = band_scores(F.col("text"), F.col("clause_pattern"), F.col("criteria"), F.col("positive"), F.col("negative"), F.col("expected"))
    rows = met.select("claim_id", "jurisdiction", "indicator_id", "clause_pattern", "members", "exceptions", "definitions", "name", "criteria", "expected", *(s.alias(n) for n, s in zip(("s0", "s5", "s1"), scores, strict=True)))
    cells = coverage.groupBy("jurisdiction", "indicator_id").agg(F.min_by(F.struct("state", "reason"), review.risk_rank(F.col("state"))).alias("cover"))
    rows = rows.join(cells.select("jurisdiction", "indicator_id", "cover.state", "cover.reason"), ["jurisdiction", "indicator_id"])
    marks = counted.select("claim_id", "jurisdiction", "indicator_id", F.lit(True).alias("counted")).distinct()
    shots = review.few_shot_bands(verified, examples).select("claim_id", F.col("band").alias("shot")).distinct()
    rows = rows.join(marks, ["claim_id", "jurisdiction", "indicator_id"], "left").join(shots, "claim_id", "left")
    found, is_counted = F.col("state") == FOUND, F.coalesce("counted", F.lit(False))
    rows = rows.withColumn("band", F.when(found & is_counted, F.coalesce("shot", rules.band_pick(F.col("s0"), F.col("s5"), F.col("s1")))))
    sizes = [F.col(c) for c in ("members", "exceptions", "definitions")]
    no_band = F.concat(F.lit("No verified evidence band recommended — coverage is "), "state", F.coalesce(F.concat(F.lit(" ("), F.nullif("reason", F.lit("")), F.lit(")")), F.lit("")), F.lit("."))
    why = F.when(~found, no_band).when(~is_counted, NOT_COUNTED).otherwise(rationale(F.col("band"), F.col("name"), F.col("clause_pattern"), F.element_at("criteria", F.col("band")), F.col("state"), *sizes))
    return rows.select("claim_id", "jurisdiction", "indicator_id", "band", why.alias("rationale"), open_questions(F.col("state"), F.col("clause_pattern"), F.col("expected"), *sizes).alias("open_questions"))


def on_claims(claims: DataFrame, found: DataFrame) -> DataFrame:
    """``claims`` with their recommendation as JSON in ``layer2``, null for those without; a person has to confirm each."""
    parts = F.struct("indicator_id", F.coalesce("band", F.lit("null")).alias("recommended_band"), "rationale", "open_questions", F.lit(True).alias("human_confirmation_required"))
    return claims.join(found.select("claim_id", F.to_json(parts).alias("layer2")), "claim_id", "left")


def listed(claims: DataFrame) -> DataFrame:
    """The recommendations that ``on_claims`` put on claims, read back."""
    schema = "indicator_id string, recommended_band string, rationale string, open_questions array<string>, human_confirmation_required boolean"
    return claims.where(F.col("layer2").isNotNull()).select("claim_id", F.from_json("layer2", schema).alias("r")).select("claim_id", "r.*")

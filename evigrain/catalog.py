"""All queries of the engine outside the training-data operators, with their SQL counterparts."""

from __future__ import annotations

from evigrain.plans import checks, claims, corpus, evaluation, evidence, gold, graph, layout, review, structure, submission  # noqa: F401
from evigrain.plans.registry import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "coverage_3state"

"""The registered queries of the decision-log operators and their SQL oracles."""

from __future__ import annotations

from feltloom.operators import estimators
from feltloom.plans import base
from feltloom.plans import estimators as _estimators  # noqa: F401
from feltloom.plans import ledger as _ledger  # noqa: F401
from feltloom.plans import pairs as _pairs  # noqa: F401
from feltloom.plans import profile as _profile  # noqa: F401
from feltloom.plans import sources as _sources  # noqa: F401
from feltloom.sources import bindings


def flagship(spark, sf_dir):
    """Like-for-like skill of each entity; thresholds fit the smallest tables."""
    return estimators.evaluate(bindings.v(spark, sf_dir), estimators.Params(min_eligible=3)).skill


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict:
    return dict(base.ORACLES)

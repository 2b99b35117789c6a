"""Similarity of two names: one Arrow-batched score and its native upper bounds."""

from __future__ import annotations

from dataclasses import dataclass
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@dataclass(frozen=True)
class MatchRule:
    """Gates and weights of a fuzzy match."""

    company_gate: float = 0.6
    title_gate: float = 0.85
    composite_gate: float = 0.80
    company_weight: float = 0.5
    title_weight: float = 0.4
    location_weight: float = 0.1


@F.pandas_udf(DoubleType())
def ratio(incoming: pd.Series, existing: pd.Series) -> pd.Series:
    """matching-blocks ratio, each pair of a batch once; the order of the arguments matters."""
    seen: dict[tuple[str, str], float] = {}
    for pair in zip(incoming, existing):
        if pair not in seen:
            seen[pair] = SequenceMatcher(None, *pair).ratio()
    return pd.Series([seen[pair] for pair in zip(incoming, existing)], dtype="float64")


def composite(company: Column, title: Column, location: Column, rule: MatchRule) -> Column:
    """the weighted sum of the three ratios."""
    return (
        F.lit(rule.company_weight) * company
        + F.lit(rule.title_weight) * title
        + F.lit(rule.location_weight) * location
    )


def gates_pass(company: Column, title: Column, score: Column, rule: MatchRule) -> Column:
    """All three gates."""
    return (
        (company >= rule.company_gate)
        & (title >= rule.title_gate)
        & (score >= rule.composite_gate)
    )

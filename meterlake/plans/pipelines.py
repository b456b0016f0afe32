"""The deployment profiles as compositions of stages, each (DataFrame) -> DataFrame without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame

from meterlake.operators.canonical import canonicalise, normalise_resource
from meterlake.operators.checks import order_faults
from meterlake.operators.privacy import PROFILES, final, initial
from meterlake.operators.traces import evaluation_branch

#: The stages in their order, which is part of the meaning; each takes (rows, signal, profile).
STAGES = {
    "normalise": lambda rows, signal, profile: normalise_resource(rows, profile),
    "initial": initial,
    "canonicalise": canonicalise,
    "final": final,
}
ORDER = ("normalise", "initial", "canonicalise", "final")


def process(flat: DataFrame, signal: str, profile: str = "core") -> DataFrame:
    """Flat logs, spans or points through the stages of ``profile``."""
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile!r}")
    if faults := order_faults(list(STAGES), ORDER):
        raise ValueError(f"stages out of order: {', '.join(faults)}")
    for stage in STAGES.values():
        flat = stage(flat, signal, profile)
    return flat


def evaluation_spans(spans: DataFrame) -> DataFrame:
    """The second branch of the evaluation profile: processed spans that qualify for the evaluation store."""
    return evaluation_branch(process(spans, "spans", "evaluation"))

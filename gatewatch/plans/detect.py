"""The whole detection: requests, classes, epochs, strategies, candidates, campaign records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalogs import Catalog, load
from ..functions.scalars import is_ipv4
from ..operators import panes
from ..operators.campaigns import MIN_CONFIDENCE, candidates, fires, fold
from ..operators.classify import classify
from ..operators.epochs import STEP_MS, WINDOW_MS, scan_range
from ..operators.strategies import Context
from ..tables import written


@dataclass(frozen=True)
class Detection:
    context: Context
    fired: DataFrame
    candidates: DataFrame
    campaigns: DataFrame


def context_of(requests: DataFrame, window_ms: int = WINDOW_MS, step_ms: int = STEP_MS, from_ms: int | None = None, to_ms: int | None = None, catalog: Catalog | None = None, markers: DataFrame | None = None) -> Context:
    """Classified IPv4 requests, summed up in panes and written once: metrics and strategies all read them by epoch."""
    catalog = catalog or load()
    kept = requests.where(is_ipv4(F.col("ip")))
    from_ms, to_ms = scan_range(kept, from_ms, to_ms)
    summed = panes.in_panes(classify(kept, catalog), from_ms, to_ms, panes.pane_ms(window_ms, step_ms))
    return context_of_panes(written(summed, "requests-in-panes"), from_ms, to_ms, window_ms, step_ms, catalog, markers)


def context_of_panes(summed: DataFrame, from_ms: int, to_ms: int, window_ms: int, step_ms: int, catalog: Catalog, markers: DataFrame | None = None) -> Context:
    return Context(panes.in_epochs(summed, from_ms, to_ms, window_ms, step_ms), catalog, markers)


def detect(requests: DataFrame, min_confidence: float = MIN_CONFIDENCE, only: str | None = None, **how) -> Detection:
    """All strategies over all epochs; ``only`` filters what is reported, not what runs."""
    return detected(context_of(requests, **how), min_confidence, only)


def detected(context: Context, min_confidence: float = MIN_CONFIDENCE, only: str | None = None) -> Detection:
    fired = fires(context, min_confidence)
    shown = fired.where(F.col("strategy_id") == only) if only else fired
    found = written(candidates(context, shown), "candidates")
    return Detection(context, shown, found, fold(found))

"""Candidates from fired strategies, and their fold into campaign records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import subnet24, threat_band
from ..tables import written
from .epochs import MARKER_MS
from .strategies import STRATEGIES, Context, Strategy

#: The least confidence that fires, and how many samples a candidate carries.
MIN_CONFIDENCE = 0.5
SAMPLE_PATHS = 10
SAMPLE_AGENTS = 5


def fires(context: Context, min_confidence: float = MIN_CONFIDENCE, strategies: tuple[Strategy, ...] = STRATEGIES) -> DataFrame:
    """All groups that score enough: ``strategy_id, epoch, end_ms, key, identifier, confidence, evidence``.

    Strategies run in order over all epochs at once; each sees what earlier ones fired.
    """
    fired: dict[str, DataFrame] = {}
    for strategy in strategies:
        found = strategy.scored(context, fired).where(F.col("confidence").isNotNull() & ~F.isnan("confidence") & (F.abs("confidence") != float("inf")) & (F.col("confidence") >= min_confidence))
        fired[strategy.strategy_id] = written(found, f"fires-{strategy.strategy_id}")
    return reduce(DataFrame.unionByName, [f.withColumn("strategy_id", F.lit(k)) for k, f in fired.items()])


def markers_of(fired: DataFrame) -> DataFrame:
    """Markers that the fires leave behind: ``scope_type, scope_value, marker_name, expires_ms``; the latest expiry holds."""
    subnets = fired.where(F.col("strategy_id") == "subnet-fingerprint-overlap")
    return subnets.groupBy(F.lit("asn_subnet").alias("scope_type"), F.col("key").alias("scope_value"), F.lit("seen_in_subnet_spray").alias("marker_name")).agg((F.max("end_ms") + MARKER_MS).alias("expires_ms"))


def active_markers(markers: DataFrame, as_of_ms: int) -> DataFrame:
    """Markers that still hold, with ``ttl_ms``."""
    return markers.where(F.col("expires_ms") > as_of_ms).withColumn("ttl_ms", F.col("expires_ms") - as_of_ms)


def markers_for(markers: DataFrame, rows: DataFrame, as_of_ms: int) -> DataFrame:
    """Active markers of the addresses, networks or subnets that ``rows`` (``ip, asn``) name."""
    scopes = rows.select(
        F.explode(
            F.array(
                F.struct(F.lit("ip").alias("scope_type"), F.col("ip").alias("scope_value")),
                F.struct(F.lit("asn").alias("scope_type"), F.col("asn").cast("string").alias("scope_value")),
                F.struct(F.lit("asn_subnet").alias("scope_type"), subnet24(F.col("ip")).alias("scope_value")),
            )
        ).alias("s")
    ).select("s.*").where("scope_value IS NOT NULL").distinct()
    return active_markers(markers, as_of_ms).join(scopes, ["scope_type", "scope_value"], "left_semi")


def _first_seen(rows: DataFrame, group: list[str], wanted: dict[str, int | None]) -> DataFrame:
    """For each column its distinct values in each fire, in the order in which they were first seen, so many at most.

    All columns go through one aggregation together, as pairs of name and value. Lists are called ``<column>_list``.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("v")) for c in wanted]))
    seen = rows.select(*group, "first_ms", "first_id", pairs.alias("pair")).select(*group, "first_ms", "first_id", "pair.*").where("v IS NOT NULL")
    seen = seen.groupBy(*group, "name", "v").agg(F.min(F.struct("first_ms", "first_id")).alias("first"))
    nth = F.row_number().over(Window.partitionBy(*group, "name").orderBy("first", "v"))
    bounds = [(F.col("name") == c) & (F.col("nth") > most) for c, most in wanted.items() if most is not None]
    top = seen.withColumn("nth", nth).where(~reduce(lambda x, y: x | y, bounds, F.lit(False)))
    listed = lambda c: F.array_sort(F.collect_list(F.when(F.col("name") == c, F.struct("first", "v"))))
    found = top.groupBy(*group).agg(*[F.transform(listed(c), lambda x: x["v"]).alias(f"{c}_list") for c in wanted])
    return found.select(*group, *[F.when(F.size(f"{c}_list") > 0, F.col(f"{c}_list")).alias(f"{c}_list") for c in wanted])


def candidates(context: Context, fired: DataFrame, strategies: tuple[Strategy, ...] = STRATEGIES) -> DataFrame:
    """Fires with their band, type, tags, time range, sample routes and agents, and contributing addresses."""
    observed = []
    for s in strategies:
        keys = fired.where(F.col("strategy_id") == s.strategy_id).select("epoch", "key")
        rows = s.observed(context).select("epoch", F.col("key").cast("string").alias("key"), "n", "first_ms", "first_id", "first_at", "last_at", "route", "user_agent", "ip")
        observed.append(rows.join(keys, ["epoch", "key"], "left_semi").withColumn("strategy_id", F.lit(s.strategy_id)))
    rows = written(reduce(DataFrame.unionByName, observed), "observed")
    group = ["strategy_id", "epoch", "key"]
    span = rows.groupBy(*group).agg(F.min("first_at").alias("first_seen"), F.max("last_at").alias("last_seen"), F.sum("n").alias("request_count"))
    samples = _first_seen(rows, group, {"route": SAMPLE_PATHS, "user_agent": SAMPLE_AGENTS, "ip": None})
    out = fired.join(span, group).join(samples, group, "left")
    kinds = {s.strategy_id: s for s in strategies}
    pick = lambda of: F.create_map(*[F.lit(x) for k, s in kinds.items() for x in (k, of(s))])[F.col("strategy_id")]
    none = F.array().cast("array<string>")
    return out.select(
        "strategy_id", "epoch", "end_ms", "key", "identifier", "confidence", "evidence", threat_band(F.col("confidence")).alias("campaign_threat_level"),
        pick(lambda s: s.campaign_type).alias("campaign_type"), F.split(pick(lambda s: ",".join(s.tags)), ",").alias("related_strategy_tags"),
        "first_seen", "last_seen", "request_count", F.coalesce("route_list", none).alias("sample_paths_probed"), F.coalesce("user_agent_list", none).alias("sample_user_agents"), F.col("ip_list").alias("contributing_ips"),
    )


_NEWEST = ("confidence", "campaign_threat_level", "sample_paths_probed", "sample_user_agents", "related_strategy_tags", "evidence")


def fold(found: DataFrame, order: Column | str = "epoch", source: str = "backtest") -> DataFrame:
    """One record per identifier from its candidates in call order.

    Time range, peak and addresses accumulate; confidence, samples and evidence are the newest's; the history
    holds the evidence wherever it differs from the one before. Type and strategy keep their first value.
    """
    call = F.col(order) if isinstance(order, str) else order
    rows = found.withColumn("__call", call)
    w = Window.partitionBy("identifier").orderBy("__call")
    rows = rows.withColumn("__changed", ~F.lag("evidence").over(w).eqNullSafe(F.col("evidence")) | F.lag("__call").over(w).isNull())
    entry = F.struct("__call", F.col("last_seen").alias("observed_at"), "confidence", "evidence")
    history = F.transform(F.array_sort(F.collect_list(F.when(F.col("__changed"), entry))), lambda e: F.struct(e["observed_at"].alias("observed_at"), e["confidence"].alias("confidence"), e["evidence"].alias("evidence")))
    ips = F.array_sort(F.array_distinct(F.flatten(F.collect_list("contributing_ips"))))
    return rows.groupBy("identifier").agg(
        F.min_by("strategy_id", "__call").alias("strategy_id"), F.min_by("campaign_type", "__call").alias("campaign_type"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.count("*").cast("int").alias("times_fired"),
        F.max("confidence").alias("peak_confidence"), *[F.max_by(c, "__call").alias(c) for c in _NEWEST], ips.alias("contributing_ips"), history.alias("evidence_history"),
    ).withColumns({"source": F.lit(source), "status": F.lit("active")})


def upsert(campaigns: DataFrame, found: DataFrame, order: str = "epoch", source: str = "backtest") -> DataFrame:
    """``campaigns`` after ``found``: open records of the same identifier and source take the candidates in, closed ones stay.

    Returns the whole new table; write it beside the old one and swap.
    """
    new = fold(found, order, source)
    is_open = (F.col("status") != "closed") & (F.col("source") == source)
    old = campaigns.where(is_open).select([F.col(c).alias(f"o_{c}") for c in campaigns.columns])
    j = new.join(old, new["identifier"] == old["o_identifier"], "full")
    last = F.element_at("o_evidence_history", -1)["evidence"]
    newest_before = F.coalesce(F.col("o_evidence"), last)
    first_new = F.element_at("evidence_history", 1)["evidence"]
    appended = F.when(first_new.eqNullSafe(newest_before), F.slice("evidence_history", 2, F.size("evidence_history"))).otherwise(F.col("evidence_history"))
    both = lambda c: F.coalesce(F.col(c), F.col(f"o_{c}"))
    merged = {
        "first_seen": F.least("first_seen", "o_first_seen"), "last_seen": F.greatest("last_seen", "o_last_seen"), "peak_confidence": F.greatest("peak_confidence", "o_peak_confidence"),
        "times_fired": (F.coalesce("times_fired", F.lit(0)) + F.coalesce("o_times_fired", F.lit(0))).cast("int"),
        "contributing_ips": F.array_sort(F.array_union(F.coalesce("contributing_ips", "o_contributing_ips"), F.coalesce("o_contributing_ips", "contributing_ips"))),
        "strategy_id": F.coalesce("o_strategy_id", "strategy_id"), "campaign_type": F.coalesce("o_campaign_type", "campaign_type"), "status": F.coalesce("o_status", "status"),
        "evidence_history": F.when(F.col("o_identifier").isNull(), F.col("evidence_history")).when(F.col("identifier").isNull(), F.col("o_evidence_history")).otherwise(F.concat("o_evidence_history", appended)),
    }
    updated = j.select([merged.get(c, both(c)).alias(c) for c in new.columns])
    return updated.unionByName(campaigns.where(~is_open).select(new.columns))


def by_status(campaigns: DataFrame, status: str) -> DataFrame:
    return campaigns.where(F.col("status") == status).orderBy(F.col("peak_confidence").desc(), "identifier")


def find_open(campaigns: DataFrame, identifier: str) -> DataFrame:
    return campaigns.where((F.col("identifier") == identifier) & (F.col("status") != "closed"))

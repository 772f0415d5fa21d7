"""Campaign strategies. A strategy turns classified requests in epochs into scored groups.

Each gives ``strategy_id, epoch, end_ms, key, identifier, confidence, evidence`` and the requests behind a group.
Only gates that hold give a row. Confidence bands, midpoints and steepnesses are fixed values.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalogs import Catalog
from ..functions.scalars import is_exploit_tool, is_ipv4, sigmoid, subnet24
from ..tables import written
from . import metrics
from .epochs import MARKER_MS


@dataclass(frozen=True)
class Context:
    """What strategies share: the requests in epochs, the catalog, and markers from outside.

    ``markers`` has ``scope_type, scope_value, marker_name, expires_ms`` or is None.
    """

    rows: DataFrame
    catalog: Catalog
    markers: DataFrame | None = None
    _made: dict[str, DataFrame] = field(default_factory=dict, compare=False)

    def once(self, name: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """What ``make`` computes from the requests, written when it is first asked for."""
        if name not in self._made:
            self._made[name] = written(make(self.rows), name)
        return self._made[name]


class Strategy(Protocol):
    strategy_id: str
    campaign_type: str
    tags: tuple[str, ...]

    def observed(self, context: Context) -> DataFrame:
        """Requests that count for the strategy, with ``key``."""

    def scored(self, context: Context, fired: dict[str, DataFrame]) -> DataFrame:
        """``epoch, end_ms, key, identifier, confidence, evidence`` of the groups that pass the gates."""


def _evidence(**fields: Column) -> Column:
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def _groups(scored: DataFrame, identifier: Column, confidence: Column, **evidence: Column) -> DataFrame:
    return scored.select("epoch", "end_ms", F.col("key").cast("string").alias("key"), identifier.alias("identifier"), confidence.alias("confidence"), _evidence(**evidence).alias("evidence"))


class SubnetOverlap:
    """A /24 whose addresses probe alike (cohesion) or share out a list (breadth)."""

    strategy_id = "subnet-fingerprint-overlap"
    campaign_type = "asn-subnet-env-spray"
    tags = ("coordinated_scan", "credential_harvester_family")

    def observed(self, context: Context) -> DataFrame:
        rows = context.rows.where(metrics.is_threat() & metrics.not_tor())
        return rows.withColumn("key", subnet24(F.col("ip"))).where("key IS NOT NULL")

    def scored(self, context: Context, fired: dict[str, DataFrame]) -> DataFrame:
        grouped = self.observed(context).groupBy("epoch", "end_ms", "key").agg(
            F.min_by("asn", F.struct("first_ms", "first_id")).alias("asn"),
            F.count_distinct("ip").alias("ips"),
            F.count_distinct(F.when(F.col("is_attack"), F.col("route"))).alias("attack"),
            F.count_distinct("route").alias("paths"),
        )
        passed = written(grouped.where("asn IS NOT NULL AND ips >= 3 AND attack >= 1 AND paths >= 2"), "subnets-passed")
        some = context.rows.withColumn("key", subnet24(F.col("ip"))).join(passed.select("epoch", "key", "asn"), ["epoch", "key", "asn"], "left_semi").drop("key")
        cohesion = metrics.subnet_cohesion(some).withColumnRenamed("subnet", "key")
        found = passed.join(cohesion, ["epoch", "asn", "key"], "left").withColumn("cohesion", F.coalesce("cohesion", F.lit(0.0)))
        size, alike, broad = sigmoid((F.col("ips") - 5) / 2), sigmoid((F.col("cohesion") - 0.4) / 0.12), sigmoid((F.col("attack") - 8) / 5)
        return _groups(
            found, F.concat(F.lit(f"{self.strategy_id}|subnet="), "key"), size * 0.4 + F.greatest(alike, broad) * 0.6,
            cohesion=F.col("cohesion"), distinctIpsInSubnet=F.col("ips"), attackPathCount=F.col("attack"), pathUnionSize=F.col("paths"), sizeScore=size, cohesionScore=alike, breadthScore=broad,
        )


class FingerprintCluster:
    """Addresses of one network with the very same route set, across its subnets."""

    strategy_id = "asn-path-fingerprint-cluster"
    campaign_type = "asn-path-fingerprint-cluster"
    tags = ("coordinated_scan", "volume_anomaly")

    def _members(self, context: Context) -> tuple[DataFrame, DataFrame]:
        prints = context.once("fingerprints", metrics.fingerprints)
        best = context.once("dominant-sets", lambda _: metrics.dominant_sets(prints))
        return best, prints.join(best, ["epoch", "asn", "set_id"]).select("epoch", "asn", "ip")

    def observed(self, context: Context) -> DataFrame:
        _, members = self._members(context)
        rows = context.rows.where(metrics.is_threat() & F.col("asn").isNotNull())
        return rows.join(members, ["epoch", "asn", "ip"], "left_semi").withColumn("key", F.col("asn").cast("string"))

    def scored(self, context: Context, fired: dict[str, DataFrame]) -> DataFrame:
        best, members = self._members(context)
        rotation = members.join(context.once("per-ip", metrics.per_ip).select("epoch", "ip", "ua_diversity"), ["epoch", "ip"]).groupBy("epoch", "asn").agg((metrics.exact_sum(F.col("ua_diversity")) / F.count("*")).alias("rotation"))
        ends = context.rows.select("epoch", "end_ms").distinct()
        passed = metrics.with_fingerprints(best.where("ip_count >= 3 AND path_union_size >= 2"), context.rows)
        found = passed.join(rotation, ["epoch", "asn"]).join(ends, "epoch").withColumn("key", F.col("asn"))
        turns, size, broad = sigmoid((F.col("rotation") - 0.8) / 0.1), sigmoid((F.col("ip_count") - 5) / 2), sigmoid((F.col("path_union_size") - 20) / 10)
        return _groups(
            found, F.concat(F.lit(f"{self.strategy_id}|asn="), F.col("asn").cast("string"), F.lit("|fp="), "fingerprint"), turns * 0.5 + size * 0.3 + broad * 0.2,
            fingerprint=F.col("fingerprint"), ipCount=F.col("ip_count"), pathUnionSize=F.col("path_union_size"), uaRotation=F.col("rotation"), rotationScore=turns, clusterSizeScore=size, breadthScore=broad,
        )


class ToolReputation:
    """Agents that name an exploit tool; weak evidence alone."""

    strategy_id = "ua-reputation"
    campaign_type = "known-exploit-tooling"
    tags = ("known_tooling", "rce_probe")

    def observed(self, context: Context) -> DataFrame:
        return context.rows.where(is_exploit_tool(F.col("user_agent"), context.catalog)).withColumn("key", F.col("ip"))

    def scored(self, context: Context, fired: dict[str, DataFrame]) -> DataFrame:
        found = self.observed(context).groupBy("epoch", "end_ms", "key").agg(F.sort_array(F.collect_set("user_agent")).alias("agents"), F.sum("n").alias("n"))
        return _groups(found, F.concat(F.lit(f"{self.strategy_id}|ip="), "key"), F.lit(0.5), matchedUas=F.col("agents"), requestCount=F.col("n"))


class SingleBurst:
    """One address with many requests to many routes, in a burst or over days, unless its group already fired."""

    strategy_id = "single-ip-burst"
    campaign_type = "comprehensive-credential-harvester"
    tags = ("volume_anomaly", "credential_harvester_family")

    def observed(self, context: Context) -> DataFrame:
        return context.rows.where(metrics.is_threat()).withColumn("key", F.col("ip"))

    def scored(self, context: Context, fired: dict[str, DataFrame]) -> DataFrame:
        groups = self.observed(context).where(is_ipv4(F.col("ip"))).groupBy("epoch", "end_ms", "key").agg(F.min_by("asn", F.struct("first_ms", "first_id")).alias("asn"))
        groups = groups.withColumn("subnet", subnet24(F.col("key")))
        producer = fired.get(SubnetOverlap.strategy_id)
        if producer is not None:
            f = producer.select(F.col("epoch").alias("f_epoch"), F.col("end_ms").alias("f_end"), F.col("key").alias("f_key"))
            groups = groups.join(f, (F.col("subnet") == F.col("f_key")) & (F.col("f_epoch") <= F.col("epoch")) & (F.col("f_end") + MARKER_MS > F.col("end_ms")), "left_anti")
        if context.markers is not None:
            m = context.markers.toDF("scope_type", "scope_value", "marker_name", "expires_ms")
            subnets = m.where("scope_type = 'asn_subnet' AND marker_name = 'seen_in_subnet_spray'")
            networks = m.where("scope_type = 'asn' AND marker_name = 'seen_in_tor_distributed_scan'")
            groups = groups.join(subnets, (F.col("subnet") == F.col("scope_value")) & (F.col("expires_ms") > F.col("end_ms")), "left_anti")
            groups = groups.join(networks, (F.col("asn").cast("string") == F.col("scope_value")) & (F.col("expires_ms") > F.col("end_ms")), "left_anti")
        found = groups.join(context.once("per-ip", metrics.per_ip).withColumnRenamed("ip", "key"), ["epoch", "key"])
        volume, diversity = sigmoid((F.col("volume") - 100) / 50), sigmoid((F.col("unique_paths") - 80) / 40)
        burst = F.when(F.col("burst_sec") < 60, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - (F.col("burst_sec") - 60) / 540))
        days = F.when(F.col("burst_sec") == float("inf"), F.lit(0.0)).otherwise(F.col("burst_sec") / 86_400)
        found = found.withColumns({"burst": burst, "days": days})
        lasting = sigmoid((F.col("days") - 7) / 3)
        in_time = F.greatest("burst", lasting)
        return _groups(
            found, F.concat(F.lit(f"{self.strategy_id}|ip="), "key"), volume * 0.4 + diversity * 0.4 + in_time * 0.2,
            volume=F.col("volume"), uniquePaths=F.col("unique_paths"), burstSec=F.col("burst_sec"), volumeScore=volume, diversityScore=diversity, burstScore=F.col("burst"), spanDays=F.col("days"), persistenceScore=lasting, timeScore=in_time,
        )


#: In the order in which they run: a strategy sees what those before it fired.
STRATEGIES: tuple[Strategy, ...] = (SubnetOverlap(), FingerprintCluster(), ToolReputation(), SingleBurst())

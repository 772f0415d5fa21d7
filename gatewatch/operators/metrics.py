"""Metrics of requests in epochs, as :mod:`gatewatch.operators.panes` sums them up.

Rows: ``epoch, n, first_ms, first_id, first_at, last_at, ip, route, user_agent, asn, is_tor, threat_rank, is_attack``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import route_fingerprint, subnet24
from ..tables import written
from .epochs import millis


def is_threat() -> Column:
    return F.col("threat_rank") > 0


def not_tor() -> Column:
    return ~F.coalesce("is_tor", F.lit(False))


def exact_sum(x: Column) -> Column:
    """The sum of fractions from 0 to 1 as a double that does not depend on their order: equal groups give equal sums."""
    return F.sum(x.cast("decimal(18,17)")).cast("double")


def per_ip(rows: DataFrame) -> DataFrame:
    """Volume, distinct routes, seconds from first to last (infinite for one request) and agent diversity of all requests.

    A missing agent counts as one more distinct agent.
    """
    n = F.sum("n")
    return rows.groupBy("epoch", "ip").agg(
        n.alias("volume"),
        F.count_distinct("route").alias("unique_paths"),
        F.when(n < 2, F.lit(float("inf"))).otherwise((millis(F.max("last_at")) - millis(F.min("first_at"))) / 1000.0).alias("burst_sec"),
        ((F.count_distinct("user_agent") + F.max(F.col("user_agent").isNull().cast("int"))) / n).alias("ua_diversity"),
    )


def per_asn(rows: DataFrame) -> DataFrame:
    """Distinct addresses and distinct attack routes of each network's threats outside the anonymity network."""
    found = rows.where(is_threat() & not_tor() & F.col("asn").isNotNull())
    return found.groupBy("epoch", "asn").agg(F.count_distinct("ip").alias("distinct_ips"), F.count_distinct(F.when(F.col("is_attack"), F.col("route"))).alias("path_union_size"))


def subnet_cohesion(rows: DataFrame) -> DataFrame:
    """Mean Jaccard likeness of the attack-route sets of all pairs of addresses in a /24: ``epoch, asn, subnet, cohesion``.

    Only pairs with a common route are formed, by a join on the route; all others add 0 to the mean. A /24
    has 254 addresses, which bounds the pairs of a route.
    """
    found = rows.where(is_threat() & not_tor() & F.col("asn").isNotNull()).withColumn("subnet", subnet24(F.col("ip"))).where("subnet IS NOT NULL")
    place = ["epoch", "asn", "subnet"]
    sets = found.groupBy(*place, "ip").agg(F.count_distinct(F.when(F.col("is_attack"), F.col("route"))).alias("routes"))
    sizes = sets.groupBy(*place).agg(F.count("*").alias("n"))
    routes = found.where("is_attack").select(*place, "ip", "route").distinct().join(sets, [*place, "ip"])
    other = routes.select(*place, "route", F.col("ip").alias("ip2"), F.col("routes").alias("routes2"))
    shared = routes.join(other, [*place, "route"]).where("ip < ip2").groupBy(*place, "ip", "ip2", "routes", "routes2").agg(F.count("*").alias("both"))
    likeness = shared.groupBy(*place).agg(exact_sum(F.col("both") / (F.col("routes") + F.col("routes2") - F.col("both"))).alias("total"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return sizes.join(likeness, place, "left").select(*place, F.when(F.col("n") > 1, F.coalesce("total", F.lit(0.0)) / pairs).otherwise(F.lit(0.0)).alias("cohesion"))


def fingerprints(rows: DataFrame) -> DataFrame:
    """Each threatening address's route set (anonymity network included): ``epoch, asn, ip, set_id, n_routes, first_ms, first_id``.

    ``set_id`` is the set's size and the sums of its routes' hashes (128 bits), which do not depend on any order:
    routes are summed where they are, and no row holds a set.
    """
    found = rows.where(is_threat() & F.col("asn").isNotNull())
    routes = found.groupBy("epoch", "asn", "ip", "route").agg(F.min(F.struct("first_ms", "first_id")).alias("first"))
    hashes = [F.xxhash64(F.lit(salt), "route") for salt in (1, 2)]
    halves = [x for h in hashes for x in (h.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(h, 32))]
    sets = routes.groupBy("epoch", "asn", "ip").agg(F.count("*").alias("n_routes"), F.min("first").alias("first"), *[F.sum(x).alias(f"s{k}") for k, x in enumerate(halves)])
    set_id = F.concat_ws("-", "n_routes", *[f"s{k}" for k in range(len(halves))])
    return sets.select("epoch", "asn", "ip", set_id.alias("set_id"), F.col("n_routes").cast("int").alias("n_routes"), "first.first_ms", "first.first_id")


def set_clusters(prints: DataFrame) -> DataFrame:
    """Addresses with one route set of two routes or more: ``epoch, asn, set_id, member, ip_count, path_union_size, first_ms, first_id``.

    ``member`` is the address that was seen first.
    """
    first = F.min(F.struct("first_ms", "first_id", "ip"))
    found = prints.where("n_routes >= 2").groupBy("epoch", "asn", "set_id").agg(F.count("*").alias("ip_count"), F.max("n_routes").alias("path_union_size"), first.alias("first"))
    return found.select("epoch", "asn", "set_id", F.col("first.ip").alias("member"), "ip_count", "path_union_size", "first.first_ms", "first.first_id")


def with_fingerprints(clusters: DataFrame, rows: DataFrame) -> DataFrame:
    """``clusters`` with ``fingerprint``, the digest of their routes. One member's routes are read for each cluster."""
    routes = rows.where(is_threat() & F.col("asn").isNotNull()).select("epoch", "asn", F.col("ip").alias("member"), "route")
    wanted = routes.join(clusters.select("epoch", "asn", "member"), ["epoch", "asn", "member"], "left_semi")
    digests = wanted.groupBy("epoch", "asn", "member").agg(route_fingerprint(F.collect_set("route")).alias("fingerprint"))
    return clusters.join(digests, ["epoch", "asn", "member"])


def fingerprint_clusters(rows: DataFrame) -> DataFrame:
    """All clusters of equal route sets: ``epoch, asn, fingerprint, ip_count, path_union_size``."""
    clusters = written(set_clusters(fingerprints(rows)), "set-clusters")
    return with_fingerprints(clusters, rows).select("epoch", "asn", "fingerprint", "ip_count", "path_union_size")


def dominant_sets(prints: DataFrame) -> DataFrame:
    """The cluster with the most addresses of each network; of equal ones, the one that was seen first."""
    best = F.min(F.struct((-F.col("ip_count")).alias("most"), "first_ms", "first_id", "set_id", "member", "ip_count", "path_union_size"))
    return set_clusters(prints).groupBy("epoch", "asn").agg(best.alias("b")).select("epoch", "asn", "b.set_id", "b.member", "b.ip_count", "b.path_union_size")


def dominant_clusters(rows: DataFrame) -> DataFrame:
    """``epoch, asn, fingerprint, ip_count, path_union_size`` of each network's dominant cluster."""
    best = written(dominant_sets(fingerprints(rows)), "dominant-sets")
    return with_fingerprints(best, rows).select("epoch", "asn", "fingerprint", "ip_count", "path_union_size")

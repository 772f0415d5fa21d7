"""Mining of classified requests: uncaught shapes, clusters, what-if patterns and scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.regex import to_java
from ..functions.scalars import sigmoid, subnet24
from ..tables import small, written
from .epochs import STEP_MS, millis
from .metrics import subnet_cohesion

#: Routes of ordinary visitors, which no proposed pattern should match.
ORDINARY_ROUTES = (
    "/", "/cart", "/cart/checkout", "/api/inventory", "/api/inventory?category=potions", "/api/auth/me", "/api/lux/state",
    "/api/lux/trigger", "/api/sidequests/active", "/api/sidequests/complete", "/favicon.ico", "/robots.txt", "/sitemap.xml",
    "/.well-known/security.txt", "/assets/index-Bx2f.js", "/assets/index-Cq1a.css", "/static/js/main.chunk.js",
    "/images/logo.png", "/fonts/inter.woff2", "/manifest.json", "/index.html",
)


def _samples(rows: DataFrame, group: list[str], wanted: dict[str, tuple[Column, int | None]]) -> DataFrame:
    """For each name the first distinct values (so many, or None: all) of each group, by the smallest id that has them.

    All columns go through one aggregation and one ranking together, as pairs of name and value.
    """
    types = rows.select(*[value.alias(name) for name, (value, _) in wanted.items()]).schema
    pairs = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), value.cast("string").alias("v")) for name, (value, _) in wanted.items()]))
    seen = rows.select(*group, "id", pairs.alias("pair")).select(*group, "id", "pair.*").where("v IS NOT NULL").groupBy(*group, "name", "v").agg(F.min("id").alias("at"))
    nth = F.row_number().over(Window.partitionBy(*group, "name").orderBy("at", "v"))
    bounds = [(F.col("name") == name) & (F.col("nth") > most) for name, (_, most) in wanted.items() if most is not None]
    top = seen.withColumn("nth", nth).where(~reduce(lambda x, y: x | y, bounds, F.lit(False)))
    listed = lambda name: F.array_sort(F.collect_list(F.when(F.col("name") == name, F.struct("at", "v"))))
    of_type = lambda name: lambda x: x["v"].cast(types[name].dataType)
    found = top.groupBy(*group).agg(*[F.transform(listed(name), of_type(name)).alias(name) for name in wanted])
    return found.select(*group, *[F.when(F.size(name) > 0, F.col(name)).alias(name) for name in wanted])


def agent_text(rows: DataFrame) -> Column:
    return F.when(F.coalesce("user_agent", F.lit("")) != "", F.substring("user_agent", 1, 160))


def uncaught_shapes(rows: DataFrame) -> DataFrame:
    """Method and URL of requests that match nothing: counts and samples, the most frequent first.

    ``stored_level`` is the level that a row came with, if it came with one.
    """
    group = ["method", "full_url"]
    calm = rows.where("threat_rank = 0")
    base = calm.groupBy(*group).agg(F.count("*").alias("count"), F.count_distinct("ip").alias("ip_count"))
    wanted: dict[str, tuple[Column, int | None]] = {"sample_ids": (F.col("id"), 5), "user_agents": (agent_text(calm), 5), "ips": (F.col("ip"), 10)}
    for name, most in (("status_code", None), ("stored_level", None), ("request_body", 3)):
        if name in rows.columns:
            value = F.when(~F.col(name).isin("{}", ""), F.substring(name, 1, 300)) if name == "request_body" else F.col(name)
            wanted[{"request_body": "request_bodies"}.get(name, f"{name}s")] = (value, most)
    return base.join(_samples(calm, group, wanted), group, "left").orderBy(F.col("count").desc(), "method", "full_url")


def cluster_key(kind: str, org: Column | None = None) -> Column:
    """Key of a cluster kind: ``ip``, ``subnet`` (IPv4 only) or ``asn`` (number, blank, organisation if known)."""
    if kind == "ip":
        return F.col("ip")
    if kind == "subnet":
        return subnet24(F.col("ip"))
    named = F.lit("") if org is None else F.coalesce(org, F.lit(""))
    return F.when(F.coalesce("asn", F.lit(0)) != 0, F.concat(F.lit("AS"), F.col("asn").cast("string"), F.lit(" "), named))


def clusters(rows: DataFrame, kind: str) -> DataFrame:
    """Requests by address, /24 or network, of clusters large or broad enough, the largest first."""
    keyed = rows.withColumn("key", cluster_key(kind, F.col("org") if "org" in rows.columns else None)).where("key IS NOT NULL")
    count = lambda level: F.count_if(F.col("threat_level") == level).alias(f"{level}_count")
    base = keyed.groupBy("key").agg(
        F.count("*").alias("request_count"), F.count_distinct("ip").alias("unique_ips"), F.count_distinct("full_url").alias("unique_paths"), F.count_distinct(agent_text(keyed)).alias("ua_count"),
        F.array_sort(F.collect_set("method")).alias("methods"), F.count_if(F.coalesce("is_tor", F.lit(False))).alias("tor_count"), *[count(x) for x in ("none", "low", "medium", "high")],
        F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"),
    )
    n, ips, paths = F.col("request_count"), F.col("unique_ips"), F.col("unique_paths")
    enough = {"ip": (n >= 10) | (paths >= 5), "subnet": (ips >= 2) & ((n >= 10) | (paths >= 3)), "asn": (ips >= 3) & (paths >= 3)}[kind]
    base = written(base.where(enough), "clusters")
    keyed = keyed.join(small(base.select("key")), "key", "left_semi")  # samples of the clusters that count
    hits = keyed.groupBy("key", "full_url").agg(F.count("*").alias("n"), F.min("id").alias("at"))
    top = hits.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy(F.col("n").desc(), "at"))).where("nth <= 40")
    top = top.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", F.concat(F.col("n").cast("string"), F.lit("x "), "full_url").alias("v")))), lambda x: x["v"]).alias("top_paths"))
    wanted: dict[str, tuple[Column, int | None]] = {"ips": (F.col("ip"), 15), "user_agents": (agent_text(keyed), 8)}
    for name, most in (("asn", None), ("org", 5), ("ip_type", None)):
        if name in rows.columns:
            wanted[f"{name}s"] = (F.when(F.col(name) != 0, F.col(name)) if name == "asn" else F.when(F.col(name) != "", F.col(name)), most)
    return base.join(top, "key", "left").join(_samples(keyed, ["key"], wanted), "key", "left").orderBy(F.col("request_count").desc(), "key")


def level_counts(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by, "threat_level").agg(F.count("*").alias("requests"))


def unknown_networks(rows: DataFrame) -> DataFrame:
    """Networks whose type is unknown, with their organisations, by hits."""
    org = F.col("org") if "org" in rows.columns else F.lit(None).cast("string").alias("org")
    return rows.where("ip_type = 'unknown'").groupBy("asn", org).agg(F.count("*").alias("hits")).orderBy(F.col("hits").desc(), "asn", "org")


def score_tuning(rows: DataFrame, window_ms: int = STEP_MS) -> DataFrame:
    """What-if scores of every /24's best window: windows start at the first threat and are not cut at the end.

    A last request exactly on a window's start belongs to none.
    """
    threats = rows.where("threat_rank > 0 AND NOT coalesce(is_tor, false)").select(millis(F.col("created_at")).alias("ms"), "ip", "route", "path_rank")
    # classified once; the /24 comes after: pushed below, its condition repeats what makes an address, in a method too long for the JVM to compile
    threats = written(threats, "threats").withColumn("subnet", subnet24(F.col("ip"))).where("subnet IS NOT NULL")
    bounds = threats.agg(F.min("ms").alias("a"), F.max("ms").alias("b")).first()
    start, end = (bounds.a, bounds.b) if bounds.a is not None else (0, 0)
    windows = threats.withColumn("epoch", F.floor((F.col("ms") - start) / window_ms).cast("int")).where(F.lit(start) + F.col("epoch").cast("long") * window_ms < end)
    windows = written(windows.select("epoch", "subnet", "ip", "route", "path_rank").distinct(), "window-routes")  # equal requests once
    base = windows.groupBy("epoch", "subnet").agg(F.count_distinct("ip").alias("distinct_ips"), F.count_distinct("route").alias("union_size"), F.count_distinct(F.when(F.col("path_rank") > 0, F.col("route"))).alias("attack_path_count"), F.max("path_rank").alias("max_path_rank"))
    base = base.where("distinct_ips >= 3 AND attack_path_count >= 1")
    base = written(base, "subnets-passed")
    some = windows.join(base.select("epoch", "subnet"), ["epoch", "subnet"], "left_semi")  # cohesion only where it counts
    same = some.withColumns({"asn": F.lit(0), "is_tor": F.lit(False), "threat_rank": F.lit(1)})
    alike = lambda attack, name: subnet_cohesion(same.withColumn("is_attack", attack)).select("epoch", "subnet", F.col("cohesion").alias(name))
    found = base.join(alike(F.col("path_rank") > 0, "cohesion_attack"), ["epoch", "subnet"]).join(alike(F.lit(True), "cohesion_all"), ["epoch", "subnet"])
    s, c, b = sigmoid((F.col("distinct_ips") - 5) / 2), sigmoid((F.col("cohesion_attack") - 0.4) / 0.12), sigmoid((F.col("attack_path_count") - 8) / 5)
    scored = found.withColumns({"baseline": c * 0.5 + s * 0.3 + b * 0.2, "max_or": s * 0.4 + F.greatest(c, b) * 0.6, "weighted": s * 0.3 + c * 0.3 + b * 0.4, "sum_cap": s * 0.34 + F.least(F.lit(1.0), c + b) * 0.66})
    best = F.row_number().over(Window.partitionBy("subnet").orderBy(F.col("max_or").desc(), "epoch"))
    return scored.withColumn("nth", best).where("nth = 1").drop("nth").orderBy(F.col("max_or").desc(), "subnet")


def validate_patterns(rows: DataFrame, proposals: list[dict], ordinary_routes: tuple[str, ...] = ORDINARY_ROUTES) -> DataFrame:
    """What proposals (``name, pattern, flags, target``) would catch.

    Shapes they hit, shapes and rows that nothing catches yet, and ordinary routes that they match by
    mistake. Body proposals test the body and the URL, all others the URL. One scan tests all proposals.
    """
    spark: SparkSession = rows.sparkSession
    ordinary = spark.createDataFrame([(r,) for r in ordinary_routes], "full_url string")
    patterns = [to_java(p["pattern"], "i" in p.get("flags", "i")) for p in proposals]
    no = F.lit(False)

    def test(p: dict, pattern: str) -> Column:
        in_url = F.coalesce(F.col("full_url").rlike(pattern), no)
        in_body = p.get("target") == "BODY_THREATS" and "request_body" in rows.columns
        return in_url | F.coalesce(F.col("request_body").rlike(pattern), no) if in_body else in_url

    tested = rows.select("method", "full_url", (F.col("threat_rank") == 0).alias("calm"), F.array(*[test(p, x) for p, x in zip(proposals, patterns, strict=True)]).alias("hit"))
    each = range(len(proposals))
    shapes = tested.groupBy("method", "full_url").agg(*[F.count_if(F.col("hit")[k]).alias(f"n{k}") for k in each], *[F.count_if(F.col("hit")[k] & F.col("calm")).alias(f"u{k}") for k in each])
    found = [(F.count_if(F.col(f"n{k}") > 0).alias(f"s{k}"), F.count_if(F.col(f"u{k}") > 0).alias(f"w{k}"), F.coalesce(F.sum(f"u{k}"), F.lit(0)).alias(f"r{k}")) for k in each]
    counts = shapes.agg(*[c for three in found for c in three])
    wrong = ordinary.agg(*[F.count_if(F.col("full_url").rlike(x)).alias(f"o{k}") for k, x in enumerate(patterns)])
    named = [F.struct(F.lit(p["name"]).alias("name"), F.lit(p.get("target", "PATH_THREATS")).alias("target"), F.col(f"s{k}").alias("shapes_hit"), F.col(f"w{k}").alias("newly_caught_shapes"), F.col(f"r{k}").alias("rows_newly_caught"), F.col(f"o{k}").alias("ordinary_hits")) for k, p in enumerate(proposals)]
    return counts.crossJoin(wrong).select(F.explode(F.array(*named)).alias("p")).select("p.*")  # one row by one row


def probes_by_asn(rows: DataFrame, word: str) -> DataFrame:
    """Requests with a path signal whose description has ``word``, by network."""
    hit = F.exists("threat_details", lambda s: (s["category"] == "path") & s["description"].contains(word))
    return rows.where(F.coalesce(hit, F.lit(False)) & F.col("asn").isNotNull()).groupBy("asn").agg(F.count("*").alias("probes"), F.count_distinct("ip").alias("ips")).orderBy(F.col("probes").desc(), "asn")

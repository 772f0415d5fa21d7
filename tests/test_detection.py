"""Scenarios of small request logs."""

import datetime as dt
import hashlib
import itertools
import json
import math
import random
import re
from pathlib import Path

import pytest
from gatewatch import catalogs
from gatewatch.operators import campaigns, epochs, metrics, panes
from gatewatch.operators.classify import add_rate_limits, check_addresses, classify, is_attack_path, path_severity
from gatewatch.operators.strategies import STRATEGIES, FingerprintCluster, SingleBurst, SubnetOverlap, ToolReputation
from gatewatch.plans.detect import context_of, detect
from gatewatch.sources import sinks
from pyspark.sql import functions as F

T0 = dt.datetime(2025, 2, 3, 7)
START = int(T0.replace(tzinfo=dt.UTC).timestamp() * 1000)


def catalog_routes(most: int) -> list[str]:
    """Routes from those path patterns of the catalog that are plain text."""
    plain = [p.pattern.replace("\\", "") for p in catalogs.load().paths if re.fullmatch(r"(\\[/.]|[\w/-])+", p.pattern)]
    return [r if r.startswith("/") else f"/{r}" for r in plain][:most]


ROUTES = catalog_routes(30)


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x))


def log(spark, rows):
    """Rows of (ip, route, seconds after the start) and optional fields."""
    full = []
    for k, (ip, route, at, *more) in enumerate(rows):
        extra = more[0] if more else {}
        full.append((k + 1, ip, route, route, extra.get("method", "GET"), extra.get("ua", "ua"), T0 + dt.timedelta(seconds=at), extra.get("asn", 64500), extra.get("tor", False), extra.get("body")))
    return spark.createDataFrame(full, "id long, ip string, route string, full_url string, method string, user_agent string, created_at timestamp, asn int, is_tor boolean, request_body string")


def scored(spark, strategy, rows, markers=None):
    context = context_of(log(spark, rows), window_ms=30 * 86_400_000, step_ms=30 * 86_400_000, markers=markers)
    return {r.key: (r.confidence, json.loads(r.evidence), r.identifier) for r in strategy.scored(context, {}).collect()}, context


def test_routes_of_the_catalog(spark):
    paths = catalogs.load().paths
    rank = {"low": 1, "medium": 2, "high": 3}
    calm = ["/", "/about-us", "/img/cat.png"]
    df = spark.createDataFrame([(r,) for r in ROUTES + calm], "p string")
    got = {r.p: (r.a, r.s) for r in df.select("p", is_attack_path(F.col("p"), catalogs.load()).alias("a"), path_severity(F.col("p"), catalogs.load()).alias("s")).collect()}
    for route in ROUTES:
        hits = [p.severity for p in paths if re.search(p.pattern, route, re.I if p.ignore_case else 0)]
        assert got[route] == (True, max(hits, key=rank.get))
    assert all(got[r] == (False, "none") for r in calm) and len(ROUTES) == 30


def test_classification(spark):
    rows = [("1.1.1.1", "/.env", 0), ("1.1.1.1", "/", 1, {"ua": None}), ("1.1.1.1", "/", 2), ("1.1.1.1", "/", 3, {"method": "TRACE"}), ("1.1.1.1", "/s?q=1 UNION SELECT 2", 4), ("1.1.1.1", "/", 5, {"body": '{"q":"<script>"}'}), ("1.1.1.1", "/", 6, {"body": '"<script>"'}), ("1.1.1.1", "/", 7, {"method": "|'|'|"}), ("bad ip!", "/", 8), ("1.1.1.1", "/", 9, {"body": "{}"})]
    got = {r.id: r for r in check_addresses(classify(log(spark, rows).withColumn("threat_rank", F.lit(9)))).collect()}
    assert [got[k].threat_level for k in range(1, 11)] == ["high", "low", "none", "high", "high", "high", "none", "high", "high", "none"]
    assert got[3].threat_details is None and got[1].threat_details[0].matched == "/.env" and got[5].threat_details[0].category == "url"
    assert got[8].threat_details[0].category == "method" and got[8].threat_details[0].matched is None and got[9].ip == "0.0.0.0"
    assert [r.threat_level for r in classify(log(spark, rows), body_is_object=False).orderBy("id").collect()][5] == "none"
    limited = add_rate_limits(classify(log(spark, rows[:3])).withColumns({"rate_tier": F.when(F.col("id") == 3, "burst"), "rate_severity": F.lit("medium"), "rate_count": F.lit(9), "rate_limit": F.lit(5)}))
    last = limited.orderBy("id").collect()[2]
    assert last.threat_level == "medium" and last.threat_details[0].description == "burst rate limit exceeded (9/5)"


def test_ranks_are_those_of_the_details_without_making_them(spark):
    union, hello = '{"q": "1 UNION SELECT name FROM users"}', '{"q": "hello"}'
    requests = itertools.product(("/", "/.env", "/search?q=1 UNION SELECT 1", None), ("GET", "PROPFIND", "GET<script>", None), (union, hello, "{}", None), ("ua", "", None))
    rows = classify(spark.createDataFrame([*requests], "full_url string, method string, request_body string, user_agent string"))
    assert not {"url_rank", "method_rank", "body_signals"} & set(rows.columns)
    order = {"low": 1, "medium": 2, "high": 3}
    found = rows.collect()
    assert {r.threat_rank for r in found} == {0, 1, 2, 3}
    assert all(r.threat_rank == max((order[s.severity] for s in r.threat_details or []), default=0) for r in found)
    assert all((r.threat_level == "none") == (r.threat_details is None) for r in found)
    plan = rows.select("threat_rank")._jdf.queryExecution().executedPlan().toString()
    assert "url_rank" in plan and "path_signals" not in plan


def test_agents_and_bursts_of_an_address(spark):
    """A missing agent is one more agent; the burst is the time from first to last."""
    cases = {"198.51.100.4": (6, 6), "198.51.100.5": (6, 2), "198.51.100.6": (5, 1)}
    rows = [(ip, ROUTES[k % 3], 7 * k, {"ua": f"u{k % agents}" if k % agents else None}) for ip, (requests, agents) in cases.items() for k in range(requests)]
    m = {r.ip: r for r in metrics.per_ip(context_of(log(spark, [*rows, ("198.51.100.7", ROUTES[0], 3)])).rows).collect()}
    for ip, (requests, agents) in cases.items():
        assert (m[ip].volume, m[ip].unique_paths, m[ip].burst_sec) == (requests, min(3, requests), 7.0 * (requests - 1))
        assert m[ip].ua_diversity == pytest.approx(agents / requests)
    assert m["198.51.100.7"].burst_sec == float("inf")


def test_dominant_cluster_is_the_largest_of_two_routes_or_more(spark):
    wide = [(f"198.51.{k}.9", r, 100 + 10 * k + j) for k in range(4) for j, r in enumerate(ROUTES[:3])]
    early = [(f"203.0.{k}.9", r, 10 * k + j) for k in range(4) for j, r in enumerate(ROUTES[3:5])]
    single = [(f"192.0.2.{k}", ROUTES[9], 200 + k) for k in range(9)]
    best = lambda rows: [(r.ip_count, r.path_union_size) for r in metrics.dominant_clusters(context_of(log(spark, rows)).rows).collect()]
    assert best(wide + single) == [(4, 3)] and best(wide + early + single) == [(4, 2)] and best(single) == []  # of equal ones the first seen


def test_cohesion_is_the_mean_likeness_of_all_pairs(spark):
    sets = [ROUTES[:2], ROUTES[:3], ROUTES[1:2], []]
    rows = [(f"203.0.113.{k}", r, 10 * k + j) for k, some in enumerate(sets) for j, r in enumerate(some)] + [("203.0.113.3", "/calm", 90, {"method": "TRACE"}), ("203.0.113.77", ROUTES[0], 95, {"tor": True})]
    pairs = [len(set(x) & set(y)) / len(set(x) | set(y)) for x, y in itertools.combinations(sets, 2)]
    (got,) = metrics.subnet_cohesion(context_of(log(spark, rows)).rows).collect()
    assert got.cohesion == pytest.approx(sum(pairs) / len(pairs))


def test_subnet_overlap(spark):
    """/24s of some widths whose addresses all probe five routes, share out routes by three, or probe one."""
    spreads = {"same": lambda k: ROUTES[:5], "shared out": lambda k: [ROUTES[(3 * k + j) % 30] for j in range(3)], "one each": lambda k: ROUTES[:1]}
    cases = {f"10.7.{n}": (width, routes) for n, (width, routes) in enumerate(itertools.product((3, 7, 20), spreads.values()))}
    probes = [(net, k, j, r) for net, (width, routes) in cases.items() for k in range(width) for j, r in enumerate(routes(k))]
    rows = [(f"{net}.{k + 1}", r, 10 * k + j) for net, k, j, r in probes]
    rows += [(f"{net}.{k + 1}".replace("10.7", "10.8"), r, 10 * k + j, {"tor": True}) for net, k, j, r in probes]
    rows += [(f"{net}.{k + 1}".replace("10.7", "10.9"), r, 10 * k + j, {"asn": None}) for net, k, j, r in probes]
    got, _ = scored(spark, SubnetOverlap(), rows)
    for net, (width, routes) in cases.items():
        union = {r for k in range(width) for r in routes(k)}
        if len(union) < 2:
            continue
        sets = [set(routes(k)) for k in range(width)]
        likeness = [len(x & y) / len(x | y) for x, y in itertools.combinations(sets, 2)]
        cohesion = sum(likeness) / len(likeness)
        want = 0.4 * sigmoid((width - 5) / 2) + 0.6 * max(sigmoid((cohesion - 0.4) / 0.12), sigmoid((len(union) - 8) / 5))
        confidence, evidence, identifier = got.pop(f"{net}.0/24")
        assert confidence == pytest.approx(want) and evidence["cohesion"] == pytest.approx(cohesion)
        assert (evidence["distinctIpsInSubnet"], evidence["attackPathCount"], identifier) == (width, len(union), f"subnet-fingerprint-overlap|subnet={net}.0/24")
    assert got == {}


def test_fingerprint_cluster(spark):
    """Networks of addresses in different subnets with the same routes, each with some agents; one address goes elsewhere."""
    cases = {64501: (2, 4, 9), 64502: (3, 2, 1), 64503: (6, 4, 9), 64504: (12, 25, 2)}
    rows = [(f"{n - 64400}.51.{k}.20", r, 40 * k + j, {"ua": f"a{k}-{j % agents}", "asn": n}) for n, (width, depth, agents) in cases.items() for k in range(width) for j, r in enumerate(ROUTES[:depth])]
    rows += [(f"203.0.113.{k}", ROUTES[29], 5, {"asn": n}) for k, n in enumerate(cases)]
    got, context = scored(spark, FingerprintCluster(), rows)
    members = {r.ip for r in FingerprintCluster().observed(context).collect()}
    for n, (width, depth, agents) in cases.items():
        assert members >= {f"{n - 64400}.51.{k}.20" for k in range(width)}
        if width < 3:
            continue
        want = 0.5 * sigmoid((min(agents, depth) / depth - 0.8) / 0.1) + 0.3 * sigmoid((width - 5) / 2) + 0.2 * sigmoid((depth - 20) / 10)
        confidence, evidence, identifier = got.pop(str(n))
        assert confidence == pytest.approx(want) and (evidence["ipCount"], evidence["pathUnionSize"]) == (width, depth) and identifier.endswith(evidence["fingerprint"])
    assert got == {} and not any(ip.startswith("203.") for ip in members)


def test_tool_reputation(spark):
    agents = ["libredtail-http", "Opera/9", None, "", "x libredtail-http y"]
    rows = [(f"203.0.113.{k}", "/", 10 * k + j, {"ua": agent}) for k, agent in enumerate(agents) for j in range(k + 1)]
    got, _ = scored(spark, ToolReputation(), rows)
    tools = [re.compile(p.pattern, re.I if p.ignore_case else 0) for p in catalogs.load().tools]
    want = {f"203.0.113.{k}": {"matchedUas": [a], "requestCount": k + 1} for k, a in enumerate(agents) if a and any(t.search(a) for t in tools)}
    assert {k: e for k, (_, e, _) in got.items()} == want and want and {c for c, _, _ in got.values()} == {0.5}


def test_single_burst(spark):
    """So many requests to as many routes, evenly over a time."""
    cases = {f"203.0.{k}.50": case for k, case in enumerate([(1, 0), (90, 20), (150, 300), (150, 20 * 86_400)])}
    rows = [(ip, f"{ROUTES[k % 30]}/{k}", k * seconds // max(1, requests - 1)) for ip, (requests, seconds) in cases.items() for k in range(requests)]
    got, _ = scored(spark, SingleBurst(), [*rows, ("2001:db8::1", ROUTES[0], 1)])
    for ip, (requests, seconds) in cases.items():
        confidence, evidence, _ = got.pop(ip)
        burst = 0 if requests == 1 else 1 if seconds < 60 else max(0, 1 - (seconds - 60) / 540)
        lasting = sigmoid(((0 if requests == 1 else seconds / 86_400) - 7) / 3)
        want = 0.4 * sigmoid((requests - 100) / 50) + 0.4 * sigmoid((requests - 80) / 40) + 0.2 * max(burst, lasting)
        assert confidence == pytest.approx(want) and (evidence["burstSec"] == "Infinity") == (requests == 1)
        assert evidence["burstScore"] == pytest.approx(burst) and evidence["persistenceScore"] == pytest.approx(lasting) and evidence["timeScore"] == pytest.approx(max(burst, lasting))
    assert got == {}


def test_outside_markers_suppress_single_bursts(spark):
    rows = [(ip, f"{ROUTES[k % 30]}/{k}", k) for ip in ("203.0.113.50", "198.51.100.50") for k in range(40)]
    kinds = "scope_type string, scope_value string, marker_name string, expires_ms long"
    for mark, left in [
        (("asn_subnet", "203.0.113.0/24", "seen_in_subnet_spray", 1 << 50), {"198.51.100.50"}),
        (("asn_subnet", "203.0.113.0/24", "seen_in_subnet_spray", 5), {"203.0.113.50", "198.51.100.50"}),
        (("asn", "64500", "seen_in_tor_distributed_scan", 1 << 50), set()),
    ]:
        assert set(scored(spark, SingleBurst(), rows, spark.createDataFrame([mark], kinds))[0]) == left


@pytest.mark.parametrize(("hours", "suppressed"), [(0, True), (7.9, True), (8.1, False)])
def test_marker_hand_over(spark, hours, suppressed):
    spray = [(f"203.0.113.{k}", ROUTES[3 * k + j], 0) for k in range(8) for j in range(3)]
    burst = [("203.0.113.200", f"{ROUTES[k % 30]}/{k}", 60 + int(hours * 3600) + k // 3) for k in range(300)]
    minute = 60_000
    found = detect(log(spark, spray + burst), window_ms=minute, step_ms=minute, from_ms=START, to_ms=START + int(hours * 3_600_000) + 5 * minute, min_confidence=0.5)
    keys = {r.identifier for r in found.fired.collect()}
    assert "subnet-fingerprint-overlap|subnet=203.0.113.0/24" in keys and ("single-ip-burst|ip=203.0.113.200" in keys) != suppressed


def test_epochs(spark):
    rows = log(spark, [("1.1.1.1", "/", 0), ("1.1.1.1", "/", 10), ("1.1.1.1", "/", 25)])
    start = START
    assert epochs.scan_range(rows) == (start, start + 25_001)
    tumbling = epochs.epochs(spark, start, start + 25_001, 10_000, 10_000).collect()
    assert [(r.start_ms - start, r.end_ms - start) for r in tumbling] == [(0, 10_000), (10_000, 20_000), (20_000, 25_001)]
    sliding = epochs.in_epochs(rows, start, start + 25_001, 10_000, 5_000).select("id", "epoch").collect()
    assert sorted((r.id, r.epoch) for r in sliding) == [(1, 0), (2, 1), (2, 2), (3, 4), (3, 5)]
    gaps = epochs.in_epochs(rows, start, start + 25_001, 5_000, 10_000).collect()
    assert [(r.id, r.epoch) for r in gaps] == [(1, 0), (2, 1)]
    with pytest.raises(ValueError):
        epochs.epochs(spark, 0, 10, 5, 0)
    with pytest.raises(ValueError):
        epochs.scan_range(rows.limit(0))


def test_candidates_and_report(spark):
    rows = [(f"198.51.100.{k}", p, 10 * k + j, {"ua": f"agent{j % 7}"}) for k in range(4) for j, p in enumerate(ROUTES[:12])]
    found = detect(log(spark, rows), only="subnet-fingerprint-overlap", min_confidence=0.1)
    (c,) = found.candidates.collect()
    assert c.sample_paths_probed == ROUTES[:10] and c.sample_user_agents == [f"agent{k}" for k in range(5)] and c.contributing_ips == [f"198.51.100.{k}" for k in range(4)]
    assert c.first_seen == T0 and c.request_count == 48 and c.campaign_type in {x.campaign_id for x in catalogs.load().campaigns}
    assert {s.campaign_type for s in STRATEGIES} <= {x.campaign_id for x in catalogs.load().campaigns}


def test_report(spark):
    fires = candidate(spark, (0, 0.7, '{"score":0.25,"n":4}', 10, 45, ["x"]), (1, 0.9, '{"score":0.5,"n":5}', 50, 60, ["y"]))
    first, second = [r.line for r in sinks.report_lines(fires).orderBy("confidence").collect()]
    assert first.splitlines() == ["0.700  single-ip-burst|ip=192.0.2.31", "        score=0.250 n=4", "        2025-02-03T07:10:00.000Z -> 2025-02-03T07:45:00.000Z", "        paths: /.env"]
    assert second == "0.900  single-ip-burst|ip=192.0.2.31  (re-fire #2)"
    rows = [json.loads(r.line) for r in sinks.report_lines(fires, "jsonl").collect()]
    assert [(r["confidence"], r["outcome"], r["times_fired"]) for r in rows] == [(0.9, "updated", 2), (0.7, "inserted", 1)]
    assert sinks.rendered(campaigns.fold(fires)).first().line.endswith("(re-fire #1)")
    with pytest.raises(ValueError):
        sinks.report_lines(fires, "xml")


def candidate(spark, *rows):
    full = [("single-ip-burst", e, "single-ip-burst|ip=192.0.2.31", c, ev, "medium", "some-campaign", ["tag"], T0 + dt.timedelta(minutes=a), T0 + dt.timedelta(minutes=b), ["/.env"], ["ua"], ips) for e, c, ev, a, b, ips in rows]
    return spark.createDataFrame(full, "strategy_id string, epoch int, identifier string, confidence double, evidence string, campaign_threat_level string, campaign_type string, related_strategy_tags array<string>, first_seen timestamp, last_seen timestamp, sample_paths_probed array<string>, sample_user_agents array<string>, contributing_ips array<string>")


def test_fold_and_upsert(spark):
    first = candidate(spark, (0, 0.7, "a", 10, 45, ["x", "y"]), (1, 0.9, "a", 50, 60, ["y", "z"]), (2, 0.6, "b", 0, 5, ["w"]), (3, 0.65, "a", 70, 80, ["x"]))
    (r,) = campaigns.fold(first).collect()
    assert (r.times_fired, r.peak_confidence, r.confidence, r.contributing_ips) == (4, 0.9, 0.65, ["w", "x", "y", "z"])
    assert [h.evidence for h in r.evidence_history] == ["a", "b", "a"] and r.first_seen == T0 and r.last_seen == T0 + dt.timedelta(minutes=80)
    table = campaigns.fold(first)
    (u,) = campaigns.upsert(table, candidate(spark, (9, 0.95, "a", 90, 99, ["q"]))).collect()
    assert (u.times_fired, u.peak_confidence, u.confidence, len(u.evidence_history)) == (5, 0.95, 0.95, 3) and "q" in u.contributing_ips and "z" in u.contributing_ips
    (u,) = campaigns.upsert(table, candidate(spark, (9, 0.5, "c", 90, 99, ["q"]))).collect()
    assert len(u.evidence_history) == 4 and u.peak_confidence == 0.9
    closed = table.withColumn("status", F.lit("closed"))
    again = campaigns.upsert(closed, candidate(spark, (9, 0.5, "c", 90, 99, ["q"])))
    assert sorted((x.status, x.times_fired) for x in again.collect()) == [("active", 1), ("closed", 4)]
    other = campaigns.upsert(table, candidate(spark, (9, 0.5, "c", 90, 99, ["q"])), source="live")
    assert sorted(x.source for x in other.collect()) == ["backtest", "live"] and campaigns.find_open(other, "single-ip-burst|ip=192.0.2.31").count() == 2
    assert campaigns.by_status(again, "closed").count() == 1


def test_campaign_folder(spark, tmp_path):
    store = sinks.CampaignFolder(spark, str(tmp_path / "campaigns"))
    with pytest.raises(LookupError):
        store.by_status("active")
    one, two = candidate(spark, (0, 0.7, "a", 10, 45, ["x"])), candidate(spark, (1, 0.9, "b", 50, 60, ["y"]))
    name = "single-ip-burst|ip=192.0.2.31"
    outcome = lambda found, source: [(r.identifier, r.outcome) for r in store.upsert(found, source).collect()]
    assert outcome(one, "live") == [(name, "inserted")] and outcome(two, "live") == [(name, "updated")]
    assert outcome(two, "backtest") == [(name, "inserted")] and store.version() == 3
    assert sorted((r.source, r.times_fired) for r in store.find_open(name).collect()) == [("backtest", 1), ("live", 2)]
    store.put(store.table(2).withColumn("status", F.lit("closed")), 4)
    (tmp_path / "campaigns" / "version=9").mkdir()  # not whole
    assert store.version() == 4 and store.by_status("closed").count() == 1 and store.find_open(name).count() == 0


def test_live_detector_matches_batches(spark, tmp_path):
    from gatewatch.streaming.live import Detector

    start, hour = START, 3_600_000
    rows = [(f"198.51.100.{k}", p, h * 3600 + 10 * k + j) for h in range(4) for k in range(6) for j, p in enumerate(ROUTES[: 8 + h])]
    whole = log(spark, rows).drop("request_body")
    live = Detector(spark, str(tmp_path), start, hour, 0.3)
    cut = lambda a, b: whole.where((F.col("created_at") >= T0 + dt.timedelta(minutes=a)) & (F.col("created_at") < T0 + dt.timedelta(minutes=b)))
    for n, (a, b) in enumerate([(0, 30), (30, 150), (150, 150), (150, 300)]):
        live(cut(a, b), n)
    live(cut(150, 300), 3)  # a repeated batch changes nothing
    batch = detect(whole, 0.3, window_ms=hour, step_ms=hour, from_ms=start, to_ms=start + 3 * hour)
    key = lambda t: sorted((r.identifier, r.times_fired, r.peak_confidence, r.contributing_ips, len(r.evidence_history)) for r in t.collect())
    assert key(live.campaigns()) == key(batch.campaigns) and batch.campaigns.count() > 0


def test_live_detector_waits_for_late_requests(spark, tmp_path):
    from gatewatch.streaming.live import Detector

    start, hour = START, 3_600_000
    rows = [(f"198.51.100.{k}", p, h * 3600 + 10 * k + j) for h in range(4) for k in range(6) for j, p in enumerate(ROUTES[: 8 + h])]
    whole = log(spark, rows).drop("request_body")
    second = F.col("created_at").cast("double") - start / 1000
    live = Detector(spark, str(tmp_path), start, hour, 0.3, late_ms=hour)
    for n, part in enumerate([second < 30, (second >= 3600) & (second < 7200), (second >= 30) & (second < 3600), second >= 7200]):
        live(whole.where(part), n)
        assert n == 3 or live.campaigns() is None
    batch = detect(whole, 0.3, window_ms=hour, step_ms=hour, from_ms=start, to_ms=start + 2 * hour)
    key = lambda t: sorted((r.identifier, r.times_fired, r.peak_confidence, r.contributing_ips, len(r.evidence_history)) for r in t.collect())
    assert key(live.campaigns()) == key(batch.campaigns) and batch.campaigns.count() > 0


def test_live_detector_in_any_order_within_the_delay(spark, tmp_path):
    """Batches read their own rows and the panes that close; nothing but the stored rows piles up."""
    from gatewatch.streaming.live import Detector
    from gatewatch.tables import scratch_dir

    hour = 3_600_000
    rng = random.Random(5)
    rows = [(f"198.51.{100 + k % 2}.{k}", p, h * 3600 + 300 * k + 20 * j, {"ua": f"ua{j % 3}"}) for h in range(6) for k in range(8) for j, p in enumerate(ROUTES[: 8 + h]) if h != 3 or k < 2]
    late = sorted(((r[2] + rng.random() * 3_590, k) for k, r in enumerate(rows)))
    whole = log(spark, rows).drop("request_body")
    live = Detector(spark, str(tmp_path), START, hour, 0.3, late_ms=hour)
    tables = Path(scratch_dir(spark)) / "tables"
    before = {p.name for p in tables.iterdir()} if tables.exists() else set()
    size = -(-len(late) // 7)
    for n in range(7):
        ids = [k + 1 for _, k in late[n * size : (n + 1) * size]]
        live(whole.where(F.col("id").isin(ids)), n)
        assert {p.name for p in tables.iterdir()} <= before
        assert len(list((tmp_path / "campaigns").glob("version=*"))) <= 2 and len(list((tmp_path / "newest").glob("batch=*"))) <= 2
    closed = live.store.version()
    assert closed >= 4 and min(int(p.name.rpartition("=")[2]) for p in (tmp_path / "panes").glob("pane=*")) >= closed - 8
    batch = detect(whole, 0.3, window_ms=hour, step_ms=hour, from_ms=START, to_ms=START + closed * hour)
    key = lambda t: sorted((r.identifier, r.times_fired, r.peak_confidence, r.contributing_ips, len(r.evidence_history)) for r in t.collect())
    assert key(live.campaigns()) == key(batch.campaigns) and batch.campaigns.count() > 0


def test_marker_scan(spark):
    marks = spark.createDataFrame([("ip", "1.1.1.1", "m", 10), ("asn", "7", "m", 20), ("asn_subnet", "2.2.2.0/24", "m", 30), ("asn_subnet", "9.9.9.0/24", "m", 30)], "scope_type string, scope_value string, marker_name string, expires_ms long")
    rows = spark.createDataFrame([("1.1.1.1", 7), ("2.2.2.9", None)], "ip string, asn int")
    got = {(r.scope_value, r.ttl_ms) for r in campaigns.markers_for(marks, rows, 10).collect()}
    assert got == {("7", 10), ("2.2.2.0/24", 20)}


@pytest.mark.parametrize(("window", "step"), [(10_000, 1_000), (10_000, 10_000), (4_000, 10_000), (6_000, 4_000)])
def test_panes_give_the_epochs_of_single_requests(spark, window, step):
    rng = random.Random(window + step)
    data = [(rng.choice(["1.1.1.1", "1.1.1.2"]), rng.choice(["/", "/.env", "/x"]), rng.randint(0, 40_000) / 1000, {"ua": rng.choice(["a", "b", None])}) for _ in range(300)]
    rows = classify(log(spark, data))
    start, end = epochs.scan_range(rows)
    size = panes.pane_ms(window, step)
    whole = panes.in_panes(rows, start, end, size)
    halves = [panes.in_panes(rows.where(F.col("id") % 2 == k), start, end, size) for k in (0, 1)]
    merged = panes.merged(halves[0].unionAll(halves[1]))
    assert sorted(map(repr, merged.collect())) == sorted(map(repr, whole.select(merged.columns).collect()))
    got = {(r.epoch, r.ip): tuple(r)[2:] for r in metrics.per_ip(panes.in_epochs(merged, start, end, window, step)).collect()}
    want = {}
    single = epochs.in_epochs(rows, start, end, window, step).select("epoch", "end_ms", "ip", "route", "user_agent", epochs.millis(F.col("created_at")).alias("ms")).collect()
    for key in {(r.epoch, r.ip) for r in single}:
        mine = [r for r in single if (r.epoch, r.ip) == key]
        times = [r.ms for r in mine]
        want[key] = (len(mine), len({r.route for r in mine}), (max(times) - min(times)) / 1000 if len(mine) > 1 else math.inf, len({r.user_agent for r in mine}) / len(mine))
    assert got == want
    ends = {r.epoch: r.end_ms for r in panes.in_epochs(merged, start, end, window, step).select("epoch", "end_ms").distinct().collect()}
    assert ends == {r.epoch: r.end_ms for r in single}


def test_equal_route_sets_share_an_id_and_no_others(spark):
    rows = [("10.0.0.1", "/.env", 0), ("10.0.0.1", "/.git/config", 1), ("10.0.1.2", "/.git/config", 2), ("10.0.1.2", "/.env", 3), ("10.0.1.2", "/.env", 4), ("10.0.2.3", "/.env", 5), ("10.0.2.3", "/phpinfo.php", 6), ("10.0.3.4", "/.env", 7)]
    context = context_of(log(spark, rows))
    prints = {r.ip: r.set_id for r in metrics.fingerprints(context.rows).collect()}
    assert prints["10.0.0.1"] == prints["10.0.1.2"] and len(set(prints.values())) == 3
    (best,) = metrics.dominant_clusters(context.rows).collect()
    assert (best.ip_count, best.path_union_size, best.fingerprint) == (2, 2, hashlib.sha1(b"/.env\n/.git/config").hexdigest())
    assert sorted((r.ip_count, r.path_union_size) for r in metrics.fingerprint_clusters(context.rows).collect()) == [(1, 2), (2, 2)]


def test_sums_do_not_depend_on_the_order_of_rows(spark):
    """Equal groups of likenesses have equal sums, so that the evidence history sees no change where there is none."""
    parts = [5 / 6] * 39 + [1.0] * 70 + [1 / 3] * 11 + [2 / 7] * 5
    orders = []
    for seed in range(40):
        random.Random(seed).shuffle(parts)
        orders += [(seed, k, x) for k, x in enumerate(parts)]
    df = spark.createDataFrame(orders, "g int, k int, x double").coalesce(1).sortWithinPartitions("k", "g")
    plain = df.groupBy("g").agg(F.sum("x").alias("s")).select("s").distinct().count()
    exact = [r.s for r in df.groupBy("g").agg(metrics.exact_sum(F.col("x")).alias("s")).select("s").distinct().collect()]
    assert plain > 1 and exact == [pytest.approx(sum(parts))]

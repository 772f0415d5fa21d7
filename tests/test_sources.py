import base64
import datetime as dt
import gzip
import hashlib
import hmac
import json
import re
from pathlib import Path

import pytest
from gatewatch.operators import mining
from gatewatch.operators.classify import classify
from gatewatch.operators.enrich import geography, with_ip_type, with_location, with_tor_flag
from gatewatch.sources import requests, sinks
from gatewatch.sources.refresh import Refreshed
from gatewatch.streaming import live
from gatewatch.tables import scratch_dir
from pyspark.sql import functions as F

LINES = [
    '1.2.3.4 - - [05/Jan/2024:10:00:00 +0100] "GET /.env HTTP/1.1" 404 12 "-" "curl/8"',
    '1.2.3.4 - bob [05/Jan/2024:10:00:01 +0000] "GET /a b c HTTP/1.1" 200 - "http://r" "-"',
    "garbage",
    '1.2.3.4 - - [05/Foo/2024:10:00:01 +0000] "GET / HTTP/1.1" 200 1 "-" ""',
    '1.2.3.4 - - [2024-01-05] "GET / HTTP/1.1" 200 1 "-" "x"',
]


def test_access_log(spark, tmp_path):
    (tmp_path / "access.log").write_text("\n".join(LINES))
    with gzip.open(tmp_path / "access.log.2.gz", "wt") as f:
        f.write(LINES[0].replace("1.2.3.4", "5.6.7.8"))
    (tmp_path / "other.txt").write_text(LINES[0])
    rows = {(r.ip, r.full_url): r for r in requests.read_log(spark, str(tmp_path)).collect()}
    assert set(rows) == {("1.2.3.4", "/.env"), ("1.2.3.4", "/a b c"), ("5.6.7.8", "/.env")}
    a, b = rows["1.2.3.4", "/.env"], rows["1.2.3.4", "/a b c"]
    assert (a.created_at, a.response_size, a.user_agent, a.referer, a.is_tor) == (dt.datetime(2024, 1, 5, 9), 12, "curl/8", None, None)
    assert (b.response_size, b.user_agent, b.referer) == (None, None, "http://r")
    done = {r.full_url: r for r in requests.imported(requests.read_log(spark, str(tmp_path))).collect()}
    assert (done["/.env"].threat_level, done["/.env"].source, done["/a b c"].source, done["/.env"].is_tor, done["/.env"].forwarding_chain) == ("high", "curl", "no-agent", None, None)
    with pytest.raises(ValueError):
        requests.not_imported_yet(requests.read_log(spark, str(tmp_path)))
    assert requests.gap(requests.read_log(spark, str(tmp_path)), dt.datetime(2024, 1, 5, 9), dt.datetime(2024, 1, 5, 10, 0, 1)).count() == 1


def test_dumps(spark, tmp_path):
    row = {"id": 3, "ip": "1.1.1.1", "method": "GET", "route": "/", "full_url": "/", "user_agent": None, "request_body": "{}", "status_code": 200, "threat_level": "none", "ip_type": None, "ip_location": '{"asn": 5, "org": "o"}', "is_tor": False, "created_at": "2024-01-05T09:00:00.000Z"}
    (tmp_path / "logs_requests_202401050900.json").write_text(json.dumps({"logs_requests": []}))
    (tmp_path / "logs_requests_202401060900.json").write_text(json.dumps({"logs_requests": [row, row | {"id": 4, "ip_location": "broken{"}]}))
    (tmp_path / "notes.json").write_text("{}")
    path = requests.latest_dump(spark, str(tmp_path))
    assert path.endswith("202401060900.json")
    rows = requests.read_dump(spark, path)
    assert {r.id: r.asn for r in rows.collect()} == {3: 5, 4: None} and requests.max_id(rows) == 4
    with pytest.raises(ValueError):
        requests.max_id(rows.limit(0))
    (tmp_path / "bad.json").write_text(json.dumps({"other": 1}))
    with pytest.raises(ValueError):
        requests.read_dump(spark, str(tmp_path / "bad.json"))
    name = requests.dump_name(dt.datetime(2024, 2, 1, 3, 4))
    sinks.write_dump(rows.drop("asn"), str(tmp_path / name))
    assert requests.latest_dump(spark, str(tmp_path)).endswith(name) and name == "logs_requests_202402010304.json"
    back = requests.read_dump(spark, str(tmp_path / name))
    assert back.columns == rows.columns and sorted(map(repr, back.collect())) == sorted(map(repr, rows.collect()))
    pretty = tmp_path / "logs_requests_202501010000.json"
    pretty.write_text(json.dumps({"logs_requests": [row, row]}, indent=1))
    assert requests.read_dump(spark, str(pretty)).count() == 2
    many = rows.crossJoin(spark.range(2_500).select("id").toDF("k"))
    sinks.write_dump(many.withColumn("id", F.col("k")).drop("k", "asn"), str(tmp_path / "many"))
    assert requests.read_dump(spark, str(tmp_path / "many")).select("id").distinct().count() == 2_500
    assert max(len(json.loads(line)["logs_requests"]) for f in (tmp_path / "many").glob("*.json") for line in f.read_text().splitlines()) <= sinks.DUMP_ROWS
    with pytest.raises(ValueError):
        requests.since(rows, -1)


def test_enrichment(spark, tmp_path):
    rows = spark.createDataFrame([("1.2.3.4", 63949, None), ("1.2.9.9", 999999, "Big Telecom"), ("127.0.0.1", 0, None), ("::1", None, None), ("9.9.9.9", 999999, "x")], "ip string, asn int, org string")
    kinds = {r.ip: r.ip_type for r in with_ip_type(rows, org="org").collect()}
    assert kinds == {"1.2.3.4": "hosting", "1.2.9.9": "isp", "127.0.0.1": None, "::1": None, "9.9.9.9": "unknown"}
    (tmp_path / "exits").write_text("9.9.9.9 \n\n1.2.3.4\n")
    flags = {r.ip: r.is_tor for r in with_tor_flag(rows, requests.read_exits(spark, str(tmp_path / "exits"))).collect()}
    assert [ip for ip, f in flags.items() if f] == ["1.2.3.4", "9.9.9.9"]
    cities = spark.createDataFrame([("1.0.0.0/8", "AU", "", -27.0, 0.0), ("1.2.3.0/24", "NZ", "Town", 1.0, 2.0)], "network string, country string, city string, latitude double, longitude double")
    nets = spark.createDataFrame([("1.2.0.0/16", 77, "Org")], "network string, asn int, org string")
    at = {r.ip: r.ip_location for r in with_location(rows.drop("asn", "org"), geography(cities, nets)).collect()}
    assert (at["1.2.3.4"].city, at["1.2.3.4"].asn, at["1.2.9.9"].country, at["1.2.9.9"].city, at["1.2.9.9"].longitude) == ("Town", 77, "AU", None, 0.0)
    assert at["127.0.0.1"] is None and at["::1"] is None and at["9.9.9.9"] is None


def test_mining(spark):
    data = [(k, f"10.0.0.{k % 3}", "GET", "/calm" if k % 2 else "/.env", "ua" * 100 if k % 4 else None, 5, False, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=k), "{}") for k in range(24)]
    rows = classify(spark.createDataFrame(data, "id long, ip string, method string, full_url string, user_agent string, asn int, is_tor boolean, created_at timestamp, request_body string").withColumn("route", F.col("full_url")))
    (shape,) = mining.uncaught_shapes(rows).collect()
    assert (shape.full_url, shape["count"], shape.sample_ids, shape.ips, shape.user_agents) == ("/calm", 12, [1, 3, 5, 7, 9], ["10.0.0.1", "10.0.0.0", "10.0.0.2"], [("ua" * 100)[:160]])
    (by_net,) = mining.clusters(rows, "subnet").collect()
    assert (by_net.key, by_net.request_count, by_net.top_paths, by_net.high_count) == ("10.0.0.0/24", 24, ["12x /.env", "12x /calm"], 12)
    assert by_net.asns == [5]
    named = rows.withColumn("org", F.when(F.col("id") % 2 == 0, "Two Words")).withColumn("ip", F.concat(F.lit("10.1.0."), F.col("id") % 8)).withColumn("full_url", F.concat("full_url", F.lit("/"), F.col("id") % 6))
    assert {r.key: r.orgs for r in mining.clusters(named, "asn").collect()} == {"AS5 ": None, "AS5 Two Words": ["Two Words"]}
    levels = rows.withColumn("stored_level", F.when(F.col("id") > 8, "low").otherwise("none")).withColumn("status_code", F.col("id") + 100)
    (shape,) = mining.uncaught_shapes(levels).collect()
    assert shape.stored_levels == ["none", "low"] and len(shape.status_codes) == 12
    assert mining.clusters(rows, "asn").count() == 0 and mining.clusters(rows.limit(0), "ip").count() == 0
    found = {r.name: r for r in mining.validate_patterns(rows, [{"name": "c", "pattern": "^/CALM$"}, {"name": "r", "pattern": "^/$"}]).collect()}
    assert (found["c"].shapes_hit, found["c"].rows_newly_caught, found["c"].ordinary_hits, found["r"].ordinary_hits) == (1, 12, 0, 1)
    tuned = mining.score_tuning(rows, 600_000).collect()
    assert len(tuned) == 1 and tuned[0].distinct_ips == 3 and tuned[0].cohesion_attack == 1.0


def test_score_tuning_reads_requests_in_methods_that_the_jvm_compiles(spark, tmp_path, monkeypatch):
    events = spark.range(60).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01' AS ts", "id AS user_id", "'signup' AS event_type", """'{"k": 3}' AS props""")
    events.write.parquet(str(tmp_path / "events.parquet"))
    first = []
    monkeypatch.setattr(mining, "written", lambda df, name: first.append(df) or df)
    mining.score_tuning(classify(requests.derived(spark, str(tmp_path))))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = first[0].select("*")
        code = rows._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) < 8000  # bytes; the JVM leaves longer methods to its interpreter


def test_score_tuning_classifies_requests_once(spark, tmp_path, monkeypatch):
    events = spark.range(60).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, id) AS ts", "id AS user_id", "'signup' AS event_type", """'{"k": 3}' AS props""")
    events.write.parquet(str(tmp_path / "events.parquet"))
    made, write = [], mining.written
    monkeypatch.setattr(mining, "written", lambda df, name: made.append(df) or write(df, name))
    made.append(mining.score_tuning(classify(requests.derived(spark, str(tmp_path)))))
    from_events = [any("events.parquet" in f for f in df.inputFiles()) for df in made]
    assert from_events[0] and not any(from_events[1:])  # all that follows reads written tables


def test_streaming(spark, tmp_path):
    schema = "id long, ip string, route string, full_url string, method string, user_agent string, created_at timestamp"
    rows = [(1, "1.1.1.1", "/.env", "/.env", "GET", "ua", dt.datetime(2024, 1, 1)), (2, "1.1.1.1", "/health", "/health", "GET", "ua", dt.datetime(2024, 1, 1)), (3, "1.1.1.1", "/", "/", "GET", None, dt.datetime(2024, 1, 1, 1))]
    spark.createDataFrame(rows, schema).write.json(str(tmp_path / "in"))
    stream = live.classified(live.requests_stream(spark, str(tmp_path / "in"), schema, ("/health",)))
    live.append_to(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    got = {r.id: (r.threat_level, r.source) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {r.id: r.threat_level for r in classify(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: ("high", "unknown"), 3: ("low", "no-agent")} and batch[1] == "high" and batch[3] == "low"
    seen = []
    live.each_batch(stream, lambda df, n: seen.append(df.count()), str(tmp_path / "cp2")).awaitTermination(60)
    assert sum(seen) == 2
    assert live.level_windows(stream).isStreaming


def test_streamed_bodies(spark, tmp_path):
    schema = "id long, route string, full_url string, method string, user_agent string, request_body string, created_at timestamp"
    at = dt.datetime(2024, 1, 1)
    bodies = [(1, '{"q": "1 UNION SELECT password FROM users"}'), (2, '{"q": "hello"}'), (3, "{}"), (4, None), (5, "1 UNION SELECT password FROM users")]
    rows = spark.createDataFrame([(k, "/", "/", "POST", "ua", body, at) for k, body in bodies], schema)
    rows.write.json(str(tmp_path / "in"))
    (tmp_path / "in" / "nested.json").write_text(json.dumps({"id": 6, "route": "/", "full_url": "/", "method": "POST", "user_agent": "ua", "request_body": {"q": "1 UNION SELECT password FROM users"}}))
    raw = live.requests_stream(spark, str(tmp_path / "in"), schema)
    live.append_to(live.classified(raw), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    got = {r.id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.id: r for r in classify(rows).collect()}
    assert want[1].threat_level == "high" and len(got) == 6
    assert all((got[k].threat_level, got[k].threat_details) == (want[k].threat_level, want[k].threat_details) for k in want)
    assert got[6].threat_level == "high" and got[5].threat_level == "none"
    live.append_to(live.classified(raw, body_is_object=False), str(tmp_path / "out2"), str(tmp_path / "cp2")).awaitTermination(60)
    assert {r.threat_level for r in spark.read.parquet(str(tmp_path / "out2")).collect()} == {"none"}


def test_capture(spark, tmp_path):
    """The live path stores what the batch functions give: checked addresses, rate limits, chains, redaction, tokens."""
    code = lambda x: base64.urlsafe_b64encode(x).rstrip(b"=").decode()
    text = f"{code(b'{\"alg\":\"HS256\"}')}.{code(b'{\"user_id\":7,\"session_id\":\"s\"}')}"
    token = f"{text}.{code(hmac.new(b'k', text.encode(), hashlib.sha256).digest())}"
    calm = {"route": "/", "full_url": "/", "method": "GET", "user_agent": "ua", "created_at": "2024-01-01T00:00:00Z"}
    rows = [
        {"id": 1, "ip": "no address", "x_forwarded_for": "no address"},
        {"id": 2, "ip": "1.1.1.1", "rate_tier": "burst", "rate_severity": "medium", "rate_count": 9, "rate_limit": 5},
        {"id": 3, "ip": "1.1.1.1", "x_forwarded_for": "9.9.9.9, 8.8.8.8, 7.7.7.7"},
        {"id": 4, "ip": "1.1.1.1", "request_body": '{"password": "1 UNION SELECT x FROM y"}'},
        {"id": 5, "ip": "1.1.1.1", "cookies": {"b": token}, "headers": {"a": ""}},
        {"id": 6, "ip": "1.1.1.1", "cookies": {"b": "forged"}, "headers": {"auth": token}},
        {"id": 7, "cookies": None, "headers": None},
        {"id": 8, "headers": {"origin": "https://x.example"}, "response_headers": {"content-length": "512"}, "started_ms": 1_000, "finished_ms": 1_037},
        {"id": 9, "headers": {}, "response_headers": {"content-length": "many"}},
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "rows.json").write_text("\n".join(json.dumps(calm | r) for r in rows))
    schema = "id long, ip string, route string, full_url string, method string, user_agent string, created_at timestamp, request_body string, x_forwarded_for string, rate_tier string, rate_severity string, rate_count int, rate_limit int, cookies map<string,string>, headers map<string,string>, response_headers map<string,string>, started_ms long, finished_ms long"
    stored = live.captured(live.requests_stream(spark, str(tmp_path / "in"), schema), secret="k", token_names=("Auth", "b"))
    live.append_to(stored, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    got = {r.id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert [got[k].threat_level for k in range(1, 8)] == ["high", "medium", "none", "high", "none", "none", "none"]
    assert (got[1].ip, got[1].threat_details[0].raw_xff, got[7].ip) == ("0.0.0.0", "no address", "0.0.0.0")
    assert got[2].threat_details[0].description == "burst rate limit exceeded (9/5)"
    assert (got[3].forwarding_chain.spoofed, got[3].forwarding_chain.claimed_ip, got[4].forwarding_chain) == (True, "9.9.9.9", None)
    assert got[4].request_body == '{"password":"[REDACTED]"}' and got[4].threat_details[0].category == "body"
    assert [(got[k].user_id, got[k].session_id) for k in (4, 5, 6, 7)] == [(None, None), (7, "s"), (7, "s"), (None, None)]
    assert [(got[k].origin, got[k].content_length, got[k].response_time_ms) for k in (7, 8, 9)] == [(None, None, None), ("https://x.example", 512, 37), (None, None, None)]
    assert not set(live._TRANSIENT) & set(got[1].asDict())
    plain = live.captured(live.requests_stream(spark, str(tmp_path / "in"), "id long, ip string, route string, full_url string, method string, user_agent string"))
    assert {"forwarding_chain", "threat_level", "source"} <= set(plain.columns) and "user_id" not in plain.columns


def test_stored_rows_are_enriched_with_lookups_that_are_read_again(spark, tmp_path):
    now, lists = [0.0], [["9.9.9.9 ", ""], None, ["1.1.1.1"]]
    exits_file = tmp_path / "exits"

    def read_exits():
        found = lists.pop(0)
        if found is None:
            raise OSError("the list could not be fetched")
        exits_file.write_text("\n".join(found))
        return requests.read_exits(spark, str(exits_file))

    cities = spark.createDataFrame([("1.1.0.0/16", "AU", "Town", 1.0, 2.0)], "network string, country string, city string, latitude double, longitude double")
    nets = spark.createDataFrame([("1.1.1.0/24", 63949, "Org")], "network string, asn int, org string")
    exits = Refreshed(read_exits, clock=lambda: now[0])
    places = Refreshed(lambda: geography(cities, nets), clock=lambda: now[0])
    store = live.Capture(str(tmp_path / "stored"), places, exits)
    schema = "id long, ip string, route string, full_url string, method string, user_agent string, created_at timestamp"
    (tmp_path / "in").mkdir()
    stream = live.captured(live.requests_stream(spark, str(tmp_path / "in"), schema))
    tables = Path(scratch_dir(spark)) / "tables"
    for n, hours in enumerate([0, 1, 13, 26]):
        now[0] = hours * 3_600.0
        calm = {"route": "/", "full_url": "/", "method": "GET", "user_agent": "ua", "created_at": "2024-01-01T00:00:00Z"}
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps(calm | {"id": 10 * n + k, "ip": ip}) for k, ip in enumerate(["1.1.1.1", "9.9.9.9", "::1"])))
        live.each_batch(stream, store, str(tmp_path / "cp")).awaitTermination(120)
        if n == 0:
            left = len(list(tables.iterdir()))
    got = {r.id: r for r in spark.read.parquet(str(tmp_path / "stored")).collect()}
    assert [[got[10 * n + k].is_tor for k in range(3)] for n in range(4)] == [[False, True, False]] * 3 + [[True, False, False]]
    assert (got[0].ip_location.city, got[0].ip_location.asn, got[0].ip_type) == ("Town", 63949, "hosting")
    assert (got[1].ip_location, got[1].ip_type, got[2].ip_location, len(got), got[0].threat_level) == (None, None, None, 12, "none")
    assert len(list(tables.iterdir())) <= left + 6 and not lists
    with pytest.raises(OSError):
        Refreshed(lambda: open(tmp_path / "none")).value()
    assert Refreshed(lambda: open(tmp_path / "none"), otherwise="stand-in").value() == "stand-in"


def test_recent(spark):
    rows = spark.createDataFrame([(k, dt.datetime(2024, 1, 1, k // 2)) for k in range(9)], "id long, created_at timestamp")
    assert [r.id for r in requests.recent(rows, 3).collect()] == [8, 7, 6] and requests.recent(rows.limit(0), 3).count() == 0

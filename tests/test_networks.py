"""Longest-prefix lookup against the standard library, over thousands of nested networks."""

import ipaddress
import random

import pytest
from gatewatch.operators import networks
from gatewatch.operators.enrich import geography, with_location
from gatewatch.tables import written
from pyspark.sql import functions as F

ADDRESSES = {
    "1.2.3.4": "::ffff:1.2.3.4", "255.255.255.255": "::ffff:ffff:ffff", "::": "::", "::1": "::1", "1::": "1::", "2001:DB8::12": "2001:db8::12", "1:2:3:4:5:6:7:8": "1:2:3:4:5:6:7:8",
    "1:2:3:4:5:6:7::": "1:2:3:4:5:6:7:0", "::ffff:10.0.0.1": "::ffff:10.0.0.1", "64:ff9b::1.2.3.4": "64:ff9b::102:304", "1:2:3:4:5:6:1.2.3.4": "1:2:3:4:5:6:102:304",
}
NO_ADDRESS = ["", "1.2.3", "1.2.3.4.5", "256.1.1.1", "01.2.3.4", "1:2:3", "1::2::3", ":::", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7::8", "12345::", "g::", "fe80::1%eth0", "::1.2.3", "1.2.3.4\n", "1.2.3.4:80", ":1::", None]


def test_keys(spark):
    rows = spark.createDataFrame([(a,) for a in [*ADDRESSES, *NO_ADDRESS]], "ip string").select("ip", networks.address_key(F.col("ip")).alias("key")).collect()
    assert {r.ip: r.key for r in rows} == {a: format(int(ipaddress.IPv6Address(b)), "032x") for a, b in ADDRESSES.items()} | dict.fromkeys(NO_ADDRESS)
    rows = spark.createDataFrame([("0" * 32,), ("0" * 30 + "af",), ("f" * 32,), ("00ff" + "f" * 28,)], "key string").select(networks.next_key(F.col("key")).alias("n")).collect()
    assert [r.n for r in rows] == ["0" * 31 + "1", "0" * 30 + "b0", None, "01" + "0" * 30]


def nested(n, seed=1):
    rng = random.Random(seed)
    tops4, tops6 = [rng.getrandbits(32) for _ in range(40)], [rng.getrandbits(128) for _ in range(40)]
    out = []
    for _ in range(n):
        if rng.random() < 0.5:
            bits = rng.randint(0, 32)
            base = rng.choice(tops4) ^ rng.getrandbits(rng.randint(1, 32))
            out.append(str(ipaddress.IPv4Network((base, bits), strict=False)))
        else:
            bits = rng.randint(0, 128)
            base = rng.choice(tops6) ^ rng.getrandbits(rng.randint(1, 128))
            out.append(str(ipaddress.IPv6Network((base, bits), strict=False)))
    some4 = [rng.choice(tops4) ^ rng.getrandbits(rng.randint(1, 32)) for _ in range(400)]
    some6 = [rng.choice(tops6) ^ rng.getrandbits(rng.randint(1, 128)) for _ in range(400)]
    return out, [str(ipaddress.IPv4Address(x)) for x in some4] + [str(ipaddress.IPv6Address(x)) for x in some6]


def mapped(text):
    net = ipaddress.ip_network(text)
    if net.version == 6:
        return int(net.network_address), net.prefixlen
    return (0xFFFF << 32) | int(net.network_address), net.prefixlen + 96


@pytest.mark.parametrize("most", [networks.BROADCAST_INTERVALS, 0])
def test_lookup_is_the_longest_prefix(spark, most):
    texts, addresses = nested(10_000)
    named = [(t, k) for k, t in enumerate(texts)]
    nets = written(networks.prefixes(spark.createDataFrame([*named, ("1.2.3.4/33", -1), ("x/8", -1), ("1.2.3.4/", -1), (None, -1)], "network string, value int")).drop("network"), "t")
    assert nets.count() == len(texts)
    table = written(networks.intervals(nets), "t")
    keys = spark.createDataFrame([(a,) for a in addresses], "ip string").select(networks.address_key(F.col("ip")).alias("key")).distinct()
    got = {r.key: r.net and r.net.value for r in networks.looked_up(keys, table, nets, most=most).collect()}
    by = {}
    for t, k in named:
        base, bits = mapped(t)
        by.setdefault((bits, base >> (128 - bits)), k)
    want = {}
    for a in addresses:
        x = ipaddress.ip_address(a)
        x = int(x) if x.version == 6 else (0xFFFF << 32) | int(x)
        want[format(x, "032x")] = next((by[b, x >> (128 - b)] for b in range(128, -1, -1) if (b, x >> (128 - b)) in by), None)
    assert got == want and len({v for v in want.values()}) > 100
    starts = sorted(r.start for r in table.collect())
    assert starts[0] == "0" * 32 and len(set(starts)) == len(starts)


def test_locations_of_both_families(spark):
    cities = spark.createDataFrame([("2001:db8::/32", "DE", "Wide", 1.0, 2.0), ("2001:db8:1::/48", "DE", "", 0.0, 0.0), ("10.0.0.0/8", "AU", "Ten", 3.0, 4.0)], "network string, country string, city string, latitude double, longitude double")
    nets = spark.createDataFrame([("2001:db8:1:2::/64", 7, "Org"), ("::1/128", 8, "no")], "network string, asn int, org string")
    ips = ["2001:db8::5", "2001:DB8:1:0:0:0:0:9", "2001:db8:1:2::1", "::ffff:10.1.1.1", "10.1.1.1", "::1", "::ffff:127.0.0.1", "0.0.0.0", "nonsense", "3::", None]
    places = geography(cities, nets)
    at = {r.ip: r.ip_location and tuple(r.ip_location) for r in with_location(spark.createDataFrame([(i,) for i in ips], "ip string"), places).collect()}
    ten = ("AU", "Ten", 3.0, 4.0, None, None)
    assert at == {"2001:db8::5": ("DE", "Wide", 1.0, 2.0, None, None), "2001:DB8:1:0:0:0:0:9": ("DE", None, 0.0, 0.0, None, None), "2001:db8:1:2::1": ("DE", None, 0.0, 0.0, 7, "Org"), "::ffff:10.1.1.1": ten, "10.1.1.1": ten} | dict.fromkeys(ips[5:])
    empty = geography(cities.limit(0), nets.limit(0))
    assert with_location(spark.createDataFrame([("10.1.1.1",)], "ip string"), empty).first().ip_location is None


def test_long_groups_of_derived_addresses_against_sql(spark, tmp_path):
    """Ids from 10,000 on give derived IPv6 texts groups of five digits; the query's SQL reads their first four."""
    import duckdb
    from gatewatch.plans.queries import QUERIES, oracle_sql

    rows = spark.range(600).selectExpr("id AS event_id", "timestamp_ntz'2024-01-05 00:00:00' AS ts", "49694 + id AS user_id", "'view' AS event_type", "concat('{\"k\": ', id % 100, '}') AS props")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["address_locations"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = con.execute(f"select {', '.join(got.columns)} from ({oracle_sql()['address_locations']})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert sum(r[0].startswith("2001:db8::1") and len(r[0]) > 14 and r[2] is not None for r in want) > 0

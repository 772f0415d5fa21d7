"""The database source reads back what a small writer of the format put into a file."""

import ipaddress
import json
import random
import struct

import pytest
from gatewatch.operators.enrich import geography, with_location
from gatewatch.sources import mmdb


def encoded(v):
    def control(kind, size):
        extra = b""
        if size >= 65_821:
            extra, size = (size - 65_821).to_bytes(3, "big"), 31
        elif size >= 285:
            extra, size = (size - 285).to_bytes(2, "big"), 30
        elif size >= 29:
            extra, size = bytes([size - 29]), 29
        return (bytes([kind << 5 | size]) if kind < 8 else bytes([size, kind - 7])) + extra

    if isinstance(v, bool):
        return control(14, int(v))
    if isinstance(v, str):
        return control(2, len(v.encode())) + v.encode()
    if isinstance(v, float):
        return control(3, 8) + struct.pack(">d", v)
    if isinstance(v, int):
        if v < 0:
            return control(8, 4) + struct.pack(">i", v)
        raw = v.to_bytes((v.bit_length() + 7) // 8, "big")
        return control(5 if len(raw) <= 2 else 6 if len(raw) <= 4 else 9 if len(raw) <= 8 else 10, len(raw)) + raw
    if isinstance(v, list):
        return control(11, len(v)) + b"".join(map(encoded, v))
    return control(7, len(v)) + b"".join(encoded(k) + encoded(x) for k, x in v.items())


def write(path, networks, bits, version=6):
    """``networks``: text to record; the longest prefix wins. In an IPv6 tree, mapped IPv4 addresses share the IPv4 subtree."""
    root = [None, None]

    def put(node, prefix, length, value, at=0):
        bit = prefix >> length - 1 - at & 1
        if at == length - 1:
            node[bit] = value
            return
        if not isinstance(node[bit], list):
            node[bit] = [node[bit], node[bit]]
        put(node[bit], prefix, length, value, at + 1)

    data, place = b"", {}
    for text, record in sorted(networks.items(), key=lambda x: (ipaddress.ip_network(x[0]).prefixlen + (96 if ipaddress.ip_network(x[0]).version == 4 else 0))):
        net = ipaddress.ip_network(text)
        length = net.prefixlen + (96 if version == 6 and net.version == 4 else 0)
        raw = encoded(record)
        if raw not in place:
            place[raw] = len(data)
            data += raw
        put(root, int(net.network_address) >> net.max_prefixlen - net.prefixlen, length, ("at", place[raw]))
    if version == 6:
        v4 = root
        for _ in range(96):
            v4 = v4[0] if isinstance(v4, list) else None
        if isinstance(v4, list):
            put(root, 0xFFFF, 96, v4)
            put(root, 0x2002, 16, v4)
    nodes, number = [], {}
    waiting = [root]
    while waiting:
        node = waiting.pop()
        if id(node) not in number:
            number[id(node)] = len(nodes)
            nodes.append(node)
            waiting += [x for x in node if isinstance(x, list)]
    value = lambda x: len(nodes) if x is None else number[id(x)] if isinstance(x, list) else len(nodes) + 16 + x[1]
    tree = b""
    for left, right in (map(value, n) for n in nodes):
        if bits == 28:
            tree += (left & 0xFFFFFF).to_bytes(3, "big") + bytes([left >> 24 << 4 | right >> 24]) + (right & 0xFFFFFF).to_bytes(3, "big")
        else:
            tree += left.to_bytes(bits // 8, "big") + right.to_bytes(bits // 8, "big")
    about = {"node_count": len(nodes), "record_size": bits, "ip_version": version, "database_type": "Test", "languages": ["en"]}
    path.write_bytes(tree + b"\0" * 16 + data + b"\xab\xcd\xefMaxMind.com" + encoded(about))


def disjoint(n, version, seed):
    rng = random.Random(seed)
    out = {}
    size = 32 if version == 4 else 128
    for _ in range(n):
        length = rng.randint(6, size)
        kind = ipaddress.IPv4Network if version == 4 else ipaddress.IPv6Network
        net = kind((rng.getrandbits(size) | (1 << size - 2 if version == 6 else 0), length), strict=False)
        if not any(net.overlaps(ipaddress.ip_network(x)) for x in out):
            out[str(net)] = {"id": rng.randint(0, 2**rng.randint(1, 120)), "f": rng.random(), "minus": -rng.randint(1, 9), "yes": rng.random() < 0.5, "names": {"en": "é" * rng.choice([1, 40, 400])}, "list": [1, "two"]}
    return out


@pytest.fixture(scope="module")
def source(spark):
    spark.dataSource.register(mmdb.MmdbSource)
    return lambda path, **options: spark.read.format("mmdb").options(**options).load(str(path))


@pytest.mark.parametrize("bits", [24, 28, 32])
def test_what_went_in_comes_out(source, tmp_path, bits):
    both = {x: r for x, r in disjoint(120, 6, bits).items() if not ipaddress.ip_network(x).overlaps(ipaddress.ip_network("2002::/16"))} | disjoint(80, 4, bits)
    write(tmp_path / "db", both, bits)
    df = source(tmp_path / "db", partitions=40)
    assert df.rdd.getNumPartitions() >= 40
    got = [(r.network, json.loads(r.record)) for r in df.collect()]
    assert len(got) == len(both) and dict(got) == both
    only = disjoint(60, 4, bits + 1)
    write(tmp_path / "four", only, bits, version=4)
    assert {r.network: json.loads(r.record) for r in source(tmp_path / "four").collect()} == only
    (tmp_path / "none").write_bytes(b"x" * 100)
    with pytest.raises(Exception, match="not a network database"):
        source(tmp_path / "none").collect()


def test_pointers():
    text = encoded("shared text")
    for more, low in ((1, 0), (2, 2_048), (3, 526_336), (4, 0)):
        target = low + 5
        offset = target - low
        first = 1 << 5 | (more - 1) << 3 | (offset >> 8 * more & 7 if more < 4 else 0)
        data = bytearray(target + 64)
        data[target : target + len(text)] = text
        pointer = bytes([first]) + (offset & (1 << 8 * more) - 1).to_bytes(more, "big")
        at = target + 32
        data[at : at + len(pointer)] = pointer
        assert mmdb._Decoder(bytes(data), 0).value(at) == ("shared text", at + len(pointer))


def test_locations_from_two_databases(spark, source, tmp_path):
    town = {"country": {"iso_code": "AU"}, "city": {"names": {"en": "Town"}}, "location": {"latitude": 1.5, "longitude": -2.0}}
    write(tmp_path / "city", {"10.0.0.0/8": {"country": {"iso_code": "NZ"}}, "10.1.0.0/16": town, "2001:db8::/32": town}, 28)
    write(tmp_path / "asn", {"10.1.2.0/24": {"autonomous_system_number": 64500, "autonomous_system_organization": "Org"}}, 24)
    places = geography(mmdb.cities(source(tmp_path / "city")), mmdb.networks(source(tmp_path / "asn")))
    ips = spark.createDataFrame([(i,) for i in ("10.9.9.9", "10.1.2.3", "2001:db8::7", "11.1.1.1")], "ip string")
    at = {r.ip: r.ip_location and tuple(r.ip_location) for r in with_location(ips, places).collect()}
    assert at == {"10.9.9.9": ("NZ", None, None, None, None, None), "10.1.2.3": ("AU", "Town", 1.5, -2.0, 64500, "Org"), "2001:db8::7": ("AU", "Town", 1.5, -2.0, None, None), "11.1.1.1": None}

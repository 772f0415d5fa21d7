"""A Spark data source for binary network databases (MaxMind DB file format 2.0).

    spark.dataSource.register(MmdbSource)
    spark.read.format("mmdb").load(path)          # network string, record string (JSON)

The file is a binary tree over address bits whose leaves point to records. The driver walks the tree's upper
levels only; each partition is a subtree, which a task walks on its own, so a database of any size is read by
all tasks. The path is one that all workers can open (a mounted folder, or any URI that Arrow's file systems know).
"""

from __future__ import annotations

import ipaddress
import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed values of the file format: what stands before the metadata, how much of the file's end may hold it, and
#: the zero bytes between tree and records.
_MARK = b"\xab\xcd\xefMaxMind.com"
_METADATA_BYTES = 128 << 10
_GAP = 16
#: Subtrees that the driver deals out, at least (if the tree has so many).
PARTITIONS = 64
_CITY = "country struct<iso_code:string>, city struct<names:struct<en:string>>, location struct<latitude:double,longitude:double>"
_NETWORK = "autonomous_system_number int, autonomous_system_organization string"


class _Decoder:
    """Values of a data section. Pointers count from ``base``."""

    def __init__(self, data: bytes, base: int):
        self.data, self.base = data, base

    def value(self, at: int) -> tuple[object, int]:
        """The value at a place, and the place after it."""
        kind, size, at = self._control(at)
        if kind == 1:
            target, at = self._pointer(size, at)
            return self.value(target)[0], at
        if kind == 7:
            out = {}
            for _ in range(size):
                key, at = self.value(at)
                out[key], at = self.value(at)
            return out, at
        if kind == 11:
            items = []
            for _ in range(size):
                item, at = self.value(at)
                items.append(item)
            return items, at
        if kind == 14:
            return bool(size), at
        raw = self.data[at : at + size]
        return self._plain(kind, raw), at + size

    def _control(self, at: int) -> tuple[int, int, int]:
        first = self.data[at]
        at, kind = at + 1, first >> 5
        if kind == 0:
            kind, at = 7 + self.data[at], at + 1
        size = first & 31
        if kind != 1 and size >= 29:
            more = size - 28
            size = (29, 285, 65_821)[more - 1] + int.from_bytes(self.data[at : at + more], "big")
            at += more
        return kind, size, at

    def _pointer(self, size: int, at: int) -> tuple[int, int]:
        more, high = (size >> 3) + 1, size & 7
        raw = int.from_bytes(self.data[at : at + more], "big")
        target = raw if more == 4 else (raw | high << 8 * more) + (0, 2_048, 526_336)[more - 1]
        return self.base + target, at + more

    @staticmethod
    def _plain(kind: int, raw: bytes) -> object:
        if kind == 2:
            return raw.decode()
        if kind == 3:
            return struct.unpack(">d", raw)[0]
        if kind == 4:
            return raw.hex()
        if kind in (5, 6, 9, 10):
            return int.from_bytes(raw, "big")
        if kind == 8:
            return int.from_bytes(raw.rjust(4, b"\0"), "big", signed=len(raw) == 4)
        if kind == 15:
            return struct.unpack(">f", raw)[0]
        raise ValueError(f"a database value of unknown kind {kind}")


class Database:
    """A file's tree and records."""

    def __init__(self, data: bytes):
        start = data.rfind(_MARK, max(0, len(data) - _METADATA_BYTES))
        if start < 0:
            raise ValueError("not a network database")
        about = _Decoder(data, start + len(_MARK)).value(start + len(_MARK))[0]
        self.data, self.nodes, self.bits = data, about["node_count"], about["record_size"]
        if self.bits not in (24, 28, 32):
            raise ValueError(f"tree records of {self.bits} bits are unknown")
        self.depth = 128 if about["ip_version"] == 6 else 32
        tree = self.nodes * self.bits // 4
        self.records = _Decoder(data, tree + _GAP)
        self.v4 = self._below(0, 96) if self.depth == 128 else 0

    def _below(self, node: int, zeros: int) -> int:
        for _ in range(zeros):
            if node < self.nodes:
                node = self.children(node)[0]
        return node

    def children(self, node: int) -> tuple[int, int]:
        size = self.bits // 4
        raw = self.data[node * size : (node + 1) * size]
        if self.bits == 28:
            return int.from_bytes(raw[:3], "big") | raw[3] >> 4 << 24, int.from_bytes(raw[4:], "big") | (raw[3] & 15) << 24
        half = size // 2
        return int.from_bytes(raw[:half], "big"), int.from_bytes(raw[half:], "big")

    def _again(self, node: int, prefix: int, length: int) -> bool:
        """Whether this is the IPv4 subtree under one of its other names."""
        return self.depth == 128 and node == self.v4 and node < self.nodes and not (length == 96 and prefix == 0)

    def subtrees(self, least: int) -> list[tuple[int, int, int]]:
        """``node, prefix, length`` of subtrees that together hold the whole tree, a level down until there are enough."""
        level, leaves = [(0, 0, 0)], []
        while level and len(level) + len(leaves) < least:
            below = []
            for node, prefix, length in level:
                for bit, child in enumerate(self.children(node)):
                    place = (child, prefix << 1 | bit, length + 1)
                    if child < self.nodes:
                        if not self._again(*place):
                            below.append(place)
                    elif child > self.nodes:
                        leaves.append(place)
            level = below
        return level + leaves

    def networks(self, node: int, prefix: int, length: int) -> Iterator[tuple[str, str]]:
        """``network, record`` of a subtree, in the order of addresses; each record as JSON."""
        texts: dict[int, str] = {}
        waiting = [(node, prefix, length)]
        while waiting:
            node, prefix, length = waiting.pop()
            if node < self.nodes:
                if not self._again(node, prefix, length):
                    left, right = self.children(node)
                    waiting += [(right, prefix << 1 | 1, length + 1), (left, prefix << 1, length + 1)]
            elif node > self.nodes:
                if node not in texts:
                    if len(texts) >= 10_000:
                        texts.clear()
                    texts[node] = json.dumps(self.records.value(self.records.base + node - self.nodes - _GAP)[0], ensure_ascii=False)
                yield self._spelled(prefix, length), texts[node]

    def _spelled(self, prefix: int, length: int) -> str:
        address = prefix << self.depth - length
        if self.depth == 32 or length >= 96 and address >> 32 == 0:
            return f"{ipaddress.IPv4Address(address)}/{length - (self.depth - 32)}"
        return f"{ipaddress.IPv6Address(address)}/{length}"


def _opened(path: str) -> Database:
    import pyarrow.fs

    fs, name = pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    with fs.open_input_file(name) as file:
        return Database(file.read())


@dataclass
class Subtree(InputPartition):
    node: int
    prefix: int
    length: int


class MmdbReader(DataSourceReader):
    def __init__(self, path: str, least: int):
        self.path, self.least = path, least

    def partitions(self) -> list[Subtree]:
        return [Subtree(*place) for place in _opened(self.path).subtrees(self.least)]

    def read(self, partition: Subtree) -> Iterator[tuple[str, str]]:
        return _opened(self.path).networks(partition.node, partition.prefix, partition.length)


class MmdbSource(DataSource):
    """Option ``path``; option ``partitions`` is how many subtrees to deal out at least."""

    @classmethod
    def name(cls) -> str:
        return "mmdb"

    def schema(self) -> str:
        return "network string, record string"

    def reader(self, schema) -> MmdbReader:
        return MmdbReader(self.options["path"], int(self.options.get("partitions", PARTITIONS)))


def cities(records: DataFrame) -> DataFrame:
    """A city database's ``network, country, city, latitude, longitude``, for :func:`gatewatch.operators.enrich.geography`."""
    r = F.from_json("record", _CITY)
    return records.select("network", r["country"]["iso_code"].alias("country"), r["city"]["names"]["en"].alias("city"), r["location"]["latitude"].alias("latitude"), r["location"]["longitude"].alias("longitude"))


def networks(records: DataFrame) -> DataFrame:
    """A network database's ``network, asn, org``."""
    r = F.from_json("record", _NETWORK)
    return records.select("network", r["autonomous_system_number"].alias("asn"), r["autonomous_system_organization"].alias("org"))

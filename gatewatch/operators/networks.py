"""Addresses of both families as 128-bit keys, and longest-prefix lookup.

A key is an address as 32 hexadecimal digits, so that text order is address order. An IPv4 address is its
mapped IPv6 address (``::ffff:a.b.c.d``). Networks nest; their ends cut the key space into intervals that do
not overlap, each with the values of the narrowest network around it. An address then belongs to the last
interval that starts at or before it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The upper 96 bits of IPv4 addresses.
V4 = "0" * 20 + "ffff"
#: Most intervals whose starts (16 bytes each) are sent to all tasks; larger tables are matched by prefix.
BROADCAST_INTERVALS = 2_000_000
_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_QUAD = rf"{_OCTET}(\.{_OCTET}){{3}}"


def _quad_digits(quad: Column) -> Column:
    """Eight hexadecimal digits of an address of four parts."""
    return F.concat(*[F.lpad(F.lower(F.hex(F.split_part(quad, F.lit("."), F.lit(k)).cast("int"))), 2, "0") for k in range(1, 5)])


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _groups(text: Column) -> Column:
    return F.filter(F.split(text, ":", -1), lambda g: (text != "") | (g != ""))


def _joined_groups(sides: Column) -> Column:
    """The eight groups of what stands before and after ``::`` as 32 digits; null if they do not fit."""
    short = F.size(sides) == 2
    parts = F.transform(sides, _groups)
    n = F.aggregate(parts, F.lit(0), lambda so_far, p: so_far + F.size(p))
    filled = F.when(short & (n < 8), F.concat(parts[0], F.array_repeat(F.lit("0"), 8 - n), F.try_element_at(parts, F.lit(2)))).when(~short & (F.size(sides) == 1) & (n == 8), parts[0])
    fits = lambda groups: F.when(F.forall(groups, lambda g: g.rlike(r"^[0-9a-f]{1,4}\z")), F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), ""))
    return _bound(filled, fits)


def address_key(ip: Column) -> Column:
    """The key of an IPv4 or IPv6 address; null for any other text.

    IPv6 may be shortened by one ``::`` and may end in an IPv4 address; zones (``%eth0``) and leading zeros in
    IPv4 parts make it no address.
    """
    ends_in_quad = rf"^(.*:)({_QUAD})\z"
    before, quad = (F.regexp_extract(ip, ends_in_quad, k) for k in (1, 2))
    spelled = _bound(quad, lambda q: F.when(q != "", _bound(_quad_digits(q), lambda d: F.concat(before, F.substring(d, 1, 4), F.lit(":"), F.substring(d, 5, 4)))).otherwise(""))
    v6 = _bound(F.when(ip.contains("."), spelled).otherwise(ip), lambda text: _bound(F.split(F.lower(text), "::", -1), _joined_groups))
    return F.when(ip.rlike(rf"^{_QUAD}\z"), F.concat(F.lit(V4), _quad_digits(ip))).when(ip.contains(":"), v6)


def _masked(key: Column, bits: Column, ones: bool) -> Column:
    """``key`` with all but its first ``bits`` bits cleared, or set."""
    whole = F.floor(bits / 4).cast("int")
    nibble = F.conv(F.substr(key, whole + 1, F.lit(1)), 16, 10).cast("int")
    free = F.pow(F.lit(2), 4 - F.pmod(bits, F.lit(4))).cast("int") - 1
    cut = nibble.bitwiseOR(free) if ones else nibble - nibble.bitwiseAND(free)
    edge = F.when(F.pmod(bits, F.lit(4)) == 0, F.lit("")).otherwise(F.lower(F.hex(cut.cast("long"))))
    return F.rpad(F.concat(F.substr(key, F.lit(1), whole), edge), 32, "f" if ones else "0")


def next_key(key: Column) -> Column:
    """The key after; null after the last one."""
    rest = F.regexp_extract(key, r"^(.*?)([0-9a-e])(f*)\z", 1)
    digit = F.regexp_extract(key, r"^(.*?)([0-9a-e])(f*)\z", 2)
    return F.when(digit != "", F.rpad(F.concat(rest, F.lower(F.hex(F.conv(digit, 16, 10).cast("long") + 1))), 32, "0"))


def prefixes(networks: DataFrame, network: str = "network") -> DataFrame:
    """``networks`` with ``first, last`` (keys) and ``bits`` (0 to 128) of texts like ``10.0.0.0/8`` or ``2001:db8::/32``.

    Host bits are cleared; a text without ``/`` is one address. Rows that are no network are left out.
    """
    address, length = F.substring_index(network, "/", 1), F.regexp_extract(network, r"/(\d{1,3})\z", 1)
    v4 = ~address.contains(":")
    most = F.when(v4, 32).otherwise(128)
    given = F.when(F.col(network).contains("/"), F.when(length != "", length).cast("int")).otherwise(most)
    rows = networks.withColumns({"__key": address_key(address), "bits": F.when(given <= most, given + F.when(v4, 96).otherwise(0))}).where("__key IS NOT NULL AND bits IS NOT NULL")
    return rows.withColumns({"first": _masked(F.col("__key"), F.col("bits"), False), "last": _masked(F.col("__key"), F.col("bits"), True)}).drop("__key")


def matched(keys: DataFrame, nets: DataFrame, key: str = "key") -> DataFrame:
    """``keys`` (distinct) with ``net``: the struct of the narrowest network of ``nets`` (see :func:`prefixes`), or null.

    Each key asks once for every prefix length that the table has (129 at most), by an equality join, so that
    no network is compared with more keys than it holds. Of equal networks the smallest values win.
    """
    values = [c for c in nets.columns if c not in ("first", "last", "bits")]
    held = nets.groupBy("bits", "first").agg(F.min(F.struct(*values)).alias("net"))
    lengths = sorted(r.bits for r in nets.select("bits").distinct().collect())  # 129 at most
    if not lengths:
        return keys.withColumn("net", F.lit(None).cast(held.schema["net"].dataType))
    asked = keys.select(key, F.explode(F.array(*map(F.lit, lengths))).alias("bits"))
    hits = asked.withColumn("first", _masked(F.col(key), F.col("bits"), False)).join(held, ["bits", "first"])
    best = hits.groupBy(key).agg(F.max_by("net", "bits").alias("net"))
    return keys.join(best, key, "left")


def intervals(nets: DataFrame) -> DataFrame:
    """``start, net`` of intervals that cover all keys and do not overlap; ``net`` is null where no network is.

    An interval ends where the next one starts; one starts at each network's first key and after its last.
    """
    ends = nets.select(F.explode(F.array(F.lit("0" * 32), "first", next_key(F.col("last")))).alias("key")).where("key IS NOT NULL").distinct()
    return matched(ends, nets).select(F.col("key").alias("start"), "net")


def _starts(keys: Column, starts) -> Column:
    """The last of the broadcast sorted ``starts`` at or before each key."""

    @F.pandas_udf("string")
    def start_of(texts: pd.Series) -> pd.Series:
        known = texts.notna().to_numpy()
        raw = np.frombuffer(bytes.fromhex("".join(texts[known])), dtype="S16") if known.any() else np.zeros(0, "S16")
        out = np.full(len(texts), None, dtype=object)
        if known.any():
            at = np.searchsorted(starts.value, raw, side="right") - 1
            out[known] = [starts.value[k].ljust(16, b"\0").hex() for k in at.tolist()]
        return pd.Series(out)

    return start_of(keys)


def looked_up(keys: DataFrame, table: DataFrame, nets: DataFrame, key: str = "key", most: int = BROADCAST_INTERVALS) -> DataFrame:
    """``keys`` (distinct) with ``net`` of the interval that holds each (``table``: :func:`intervals` of ``nets``, written).

    Up to ``most`` intervals, tasks search their sorted starts; beyond it keys are matched by prefix. Both give
    the same rows.
    """
    n = table.count()
    if not 0 < n <= most:
        return matched(keys, nets, key)
    sorted_starts = np.sort(np.frombuffer(bytes.fromhex("".join(r.start for r in table.select("start").toLocalIterator())), dtype="S16"))
    starts = keys.sparkSession.sparkContext.broadcast(sorted_starts)
    found = keys.withColumn("__start", _starts(F.col(key), starts))
    return found.join(table.withColumnRenamed("start", "__start"), "__start", "left").drop("__start")

"""Facts about addresses: network type, anonymity network, geography."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalogs import Catalog, load
from ..functions.scalars import ip_type
from ..tables import per_distinct, written
from .networks import address_key, intervals, looked_up, prefixes

LOCATION = "struct<country:string,city:string,latitude:double,longitude:double,asn:int,org:string>"


def asn_registry(spark: SparkSession, catalog: Catalog) -> DataFrame:
    return spark.createDataFrame(list(catalog.asn_types), "asn int, registered string")


def with_ip_type(rows: DataFrame, catalog: Catalog | None = None, asn: str = "asn", org: str | None = None) -> DataFrame:
    """``rows`` with ``ip_type``. The registry is a few hundred rows of the catalog, hence broadcast."""
    catalog = catalog or load()
    registry = F.broadcast(asn_registry(rows.sparkSession, catalog).withColumnRenamed("asn", "__asn"))
    organisation = F.col(org) if org else F.lit(None).cast("string")
    joined = rows.drop("ip_type", "registered").join(registry, rows[asn] == F.col("__asn"), "left")
    return joined.withColumn("ip_type", ip_type(F.col(asn), organisation, F.col("registered"), catalog)).drop("__asn", "registered")


def with_tor_flag(rows: DataFrame, exits: DataFrame, ip: str = "ip") -> DataFrame:
    """``rows`` with ``is_tor``: the trimmed address is in ``exits`` (column ``ip``). Empty or null is not."""
    listed = exits.select(F.col("ip").alias("__ip")).distinct().withColumn("__listed", F.lit(True))
    return rows.drop("is_tor").join(listed, F.trim(rows[ip]) == F.col("__ip"), "left").withColumn("is_tor", F.coalesce("__listed", F.lit(False))).drop("__ip", "__listed")


@dataclass(frozen=True)
class Geography:
    """Networks of two tables, with their intervals, all written once."""

    cities: DataFrame
    city_intervals: DataFrame
    networks: DataFrame
    network_intervals: DataFrame


def geography(cities: DataFrame, networks: DataFrame) -> Geography:
    """Prepares ``cities`` (``network, country, city, latitude, longitude``) and ``networks`` (``network, asn, org``) for lookups.

    Networks of both families may nest as they like; rows that are no network are left out.
    """
    c = written(prefixes(cities.select("network", "country", "city", F.col("latitude").cast("double").alias("latitude"), F.col("longitude").cast("double").alias("longitude"))).drop("network"), "cities")
    n = written(prefixes(networks.select("network", F.col("asn").cast("int").alias("asn"), "org")).drop("network"), "networks")
    return Geography(c, written(intervals(c), "city-intervals"), n, written(intervals(n), "network-intervals"))


def with_location(rows: DataFrame, places: Geography, ip: str = "ip") -> DataFrame:
    """``rows`` with ``ip_location``.

    Each distinct address is looked up once; the narrowest network of each table wins. Null for loopback and
    unspecified addresses, for texts that are no address, and for addresses that neither table has. Empty names
    become null; zero coordinates stay.
    """

    def look_up(addresses: DataFrame) -> DataFrame:
        a = F.col(ip)
        keyed = addresses.withColumn("__key", F.when(~a.isin("0.0.0.0", "127.0.0.1", "::1") & ~a.startswith("::ffff:127."), address_key(a)))
        keys = written(keyed.where("__key IS NOT NULL").select("__key").distinct(), "address-keys")
        city = looked_up(keys, places.city_intervals, places.cities, "__key").toDF("__c", "c")
        net = looked_up(keys, places.network_intervals, places.networks, "__key").toDF("__n", "n")
        found = keyed.join(city, F.col("__key") == F.col("__c"), "left").join(net, F.col("__key") == F.col("__n"), "left")
        name = lambda c: F.when(F.col(c) != "", F.col(c))
        where = F.struct(name("c.country").alias("country"), name("c.city").alias("city"), F.col("c.latitude").alias("latitude"), F.col("c.longitude").alias("longitude"), F.col("n.asn").alias("asn"), name("n.org").alias("org"))
        return found.select(ip, F.when(F.col("c").isNotNull() | F.col("n").isNotNull(), where).alias("ip_location"))

    return per_distinct(rows.drop("ip_location"), ip, look_up)


def enriched(rows: DataFrame, places: Geography, exits: DataFrame, catalog: Catalog | None = None, ip: str = "ip") -> DataFrame:
    """``rows`` with ``ip_location``, ``ip_type`` (from the location's network and organisation) and ``is_tor``."""
    located = with_location(rows, places, ip)
    named = located.withColumns({"__network": F.col("ip_location.asn"), "__org": F.col("ip_location.org")})
    return with_tor_flag(with_ip_type(named, catalog, "__network", "__org").drop("__network", "__org"), exits, ip)
